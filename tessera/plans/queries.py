"""The registered queries (one per operator group of the inventory) and their
DuckDB oracles. Arrays are returned as space-joined strings and doubles are
rounded, so results hash the same on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import get_template, render, render_sql
from ..functions.tokens import CP_EOS, CodePoints, codepoints_sql, ids_text
from ..operators.tokenize import cut_fields, tokenize_records
from ..sources import tables
from .registry import register

CUTOFF = 256          # length limit of the evaluation jobs (their default)
ALPACA = get_template("alpaca")


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _tokens_out(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep,
                     ids_text(F.col("input_ids")).alias("input_ids"),
                     ids_text(F.col("attention_mask")).alias("attention_mask"),
                     ids_text(F.col("labels")).alias("labels"),
                     F.size("input_ids").cast("bigint").alias("n_tokens"))


def _eos_sql(ids: str, cutoff: int | None) -> str:
    cond = f"coalesce({ids}[-1] <> {CP_EOS}, true)"
    if cutoff is not None:
        cond += f" and len({ids}) < {cutoff}"
    return f"(case when {cond} then list_append({ids}, {CP_EOS}) else {ids} end)"


TOKENS_OUT_SQL = """select id, array_to_string(ids, ' ') as input_ids,
       array_to_string(list_transform(ids, lambda x: 1), ' ') as attention_mask,
       array_to_string(labels, ' ') as labels, cast(len(ids) as bigint) as n_tokens
from masked"""


# --- T1-T3, T5, T6 (train_on_inputs=True): the flagship --------------------------

@register("train_records", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(ALPACA, 'instruction', 'input', 'output'), CUTOFF)} as ids0 from inst)""",
    f"""masked as (select id, {_eos_sql('ids0', CUTOFF)} as ids, {_eos_sql('ids0', CUTOFF)} as labels from enc)""",
) + TOKENS_OUT_SQL)
def train_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inst -> alpaca prompt -> code points cut at 256 -> end-of-text -> mask/labels."""
    recs = tables.inst(spark, sf_dir)
    tok = tokenize_records(recs, ALPACA, CodePoints(), cutoff_len=CUTOFF, train_on_inputs=True)
    return _tokens_out(tok, "id")


# --- W3-W6: exact rank, split, shuffle ------------------------------------------

from ..functions.tokens import CP_PAD  # noqa: E402
from ..operators import batches as B  # noqa: E402
from ..operators import order as O  # noqa: E402

SEED = 42            # split seed of the training job
VAL_DOCS = 100       # validation rows when splitting the documents table (fewer than its 200 rows at the smallest scale)
VAL_RECORDS = 20     # validation rows when splitting the instruction records
BATCH = B.device_batch_size(16, 2)   # micro batch 16 over 2 processes -> 8
FOOTPRINT_SIZES = [1, 2, 4, 8, 16, 32, 64, 128]


def _rank_sql(id_expr: str, seed=SEED) -> str:
    return f"row_number() over (order by md5(cast({id_expr} as varchar) || ':{seed}'), {id_expr})"


@register("shuffle_order", sql=f"""
select doc_id, cast({_rank_sql('doc_id')} as bigint) as rank from documents""")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded exact global order of all documents."""
    docs = tables.documents(spark, sf_dir).select("doc_id")
    return O.shuffle_rows(docs, "doc_id", SEED).select("doc_id", "rank")


@register("exact_split", sql=f"""
with r as (select doc_id, {_rank_sql('doc_id')} as g from documents)
select doc_id, case when g <= {VAL_DOCS} then 'validation' else 'train' end as split,
       cast(case when g <= {VAL_DOCS} then g else g - {VAL_DOCS} end as bigint) as position
from r""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly VAL_DOCS documents to validation, seeded; positions continue the order."""
    docs = tables.documents(spark, sf_dir).select("doc_id")
    return O.exact_split(docs, "doc_id", VAL_DOCS, SEED).ranked.select("doc_id", "split", "position")


@register("exact_split_reshuffled", sql=f"""
with r as (select doc_id, {_rank_sql('doc_id')} as g from documents),
s as (select doc_id, case when g <= {VAL_DOCS} then 'validation' else 'train' end as split from r)
select doc_id, split, cast(row_number() over (partition by split
       order by md5(cast(doc_id as varchar) || ':7'), doc_id) as bigint) as position
from s""")
def exact_split_reshuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + W5: split by seed 42, then each part shuffled again by seed 7."""
    docs = tables.documents(spark, sf_dir).select("doc_id")
    return O.exact_split(docs, "doc_id", VAL_DOCS, SEED, shuffle_seed=7).ranked.select(
        "doc_id", "split", "position")


@register("no_split", sql=f"""
select doc_id, 'train' as split, cast({_rank_sql('doc_id')} as bigint) as position from documents""")
def no_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation size 0, every row is train (shuffled)."""
    docs = tables.documents(spark, sf_dir).select("doc_id")
    return O.exact_split(docs, "doc_id", 0, SEED).ranked.select("doc_id", "split", "position")


# --- B1, B2: training batches (T5 -> W3 -> W5 -> B1 -> B2) --------------------------

def _pad_sql(arr: str, width: str, value: int) -> str:
    return (f"list_concat(list_transform(range(greatest({width} - len({arr}), 0)), "
            f"lambda x: {value}), {arr})")


@register("train_batches", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(ALPACA, 'instruction', 'input', 'output'), CUTOFF)} as ids0 from inst)""",
    f"""tok as (select id, {_eos_sql('ids0', CUTOFF)} as ids from enc)""",
    f"""r as (select *, {_rank_sql('id')} as g from tok)""",
    f"""s as (select *, case when g <= {VAL_RECORDS} then 'validation' else 'train' end as split,
       case when g <= {VAL_RECORDS} then g else g - {VAL_RECORDS} end as position from r)""",
    f"""b as (select *, (position - 1) // {BATCH} as batch from s)""",
    """m as (select *, cast(((max(len(ids)) over (partition by split, batch) + 7) // 8) * 8 as integer) as width from b)""",
) + f"""select id, split, cast(position as bigint) as position, cast(batch as bigint) as batch, width,
       array_to_string({_pad_sql('ids', 'width', CP_PAD)}, ' ') as input_ids,
       array_to_string({_pad_sql("list_transform(ids, lambda x: 1)", 'width', 0)}, ' ') as attention_mask,
       array_to_string({_pad_sql('ids', 'width', -100)}, ' ') as labels
from m""")
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 -> exact split (20 validation rows) -> shuffled -> batches of 8 -> left pad to x8."""
    recs = tables.inst(spark, sf_dir).select("id", "instruction", "input", "output")
    recs = cut_fields(recs, CodePoints(), CUTOFF)
    order = O.exact_split(recs, "id", VAL_RECORDS, SEED).derive(
        lambda d: tokenize_records(d, ALPACA, CodePoints(), cutoff_len=CUTOFF,
                                   train_on_inputs=True,
                                   keep=["id", "split", "position", "_bucket"]))
    padded = B.pad_batches(order, BATCH, pad_id=CP_PAD)
    return padded.select("id", "split", "position", "batch", "width",
                         ids_text(F.col("input_ids")).alias("input_ids"),
                         ids_text(F.col("attention_mask")).alias("attention_mask"),
                         ids_text(F.col("labels")).alias("labels"))


def _bytes_sql(ids: str) -> str:
    """Hex digits of the little-endian 32-bit bytes of an integer list."""
    h = "printf('%08x', (x + 4294967296) % 4294967296)"
    return (f"array_to_string(list_transform({ids}, lambda x: substr({h}, 7, 2) || substr({h}, 5, 2) || "
            f"substr({h}, 3, 2) || substr({h}, 1, 2)), '')")


@register("batch_tensors", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(ALPACA, 'instruction', 'input', 'output'), CUTOFF)} as ids0 from inst)""",
    f"""tok as (select id, {_eos_sql('ids0', CUTOFF)} as ids from enc)""",
    f"""r as (select *, {_rank_sql('id')} as g from tok)""",
    f"""s as (select *, case when g <= {VAL_RECORDS} then 'validation' else 'train' end as split,
       case when g <= {VAL_RECORDS} then g else g - {VAL_RECORDS} end as position from r)""",
    f"""b as (select *, (position - 1) // {BATCH} as batch from s)""",
    """m as (select *, cast(((max(len(ids)) over (partition by split, batch) + 7) // 8) * 8 as integer) as width from b)""",
    f"""x as (select split, batch, width, position, {_bytes_sql(_pad_sql('ids', 'width', CP_PAD))} as i,
       {_bytes_sql(_pad_sql("list_transform(ids, lambda x: 1)", 'width', 0))} as k,
       {_bytes_sql(_pad_sql('ids', 'width', -100))} as l from m)""",
) + """select split, cast(batch as bigint) as batch, cast(count(*) as integer) as n_rows, any_value(width) as width,
       any_value(width) as label_width, md5(unhex(string_agg(i, '' order by position))) as ids,
       md5(unhex(string_agg(k, '' order by position))) as mask, md5(unhex(string_agg(l, '' order by position))) as labels
from x group by split, batch""")
def batch_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 as one row per batch: shape and digests of the little-endian ids, mask and labels."""
    recs = tables.inst(spark, sf_dir).select("id", "instruction", "input", "output")
    order = O.exact_split(cut_fields(recs, CodePoints(), CUTOFF), "id", VAL_RECORDS, SEED).derive(
        lambda d: tokenize_records(d, ALPACA, CodePoints(), cutoff_len=CUTOFF, train_on_inputs=True,
                                   keep=["id", "split", "position", "_bucket"]))
    out = B.batch_tensors(order, B.pad_batches(order, BATCH, pad_id=CP_PAD), BATCH)
    return out.select("split", "batch", "n_rows", "width", "label_width",
                      *[F.md5(c).alias(c) for c in ("ids", "mask", "labels")])


@register("batch_footprint", sql=f"""
with r as (select {_rank_sql('doc_id')} as rank, length(text) as len from documents),
c as (select rank, len, unnest({FOOTPRINT_SIZES}) as batch_size from r),
pb as (select batch_size, (rank - 1) // batch_size as batch, count(*) as n, sum(len) as rl,
              max(len) as mx from c group by all),
rep as (select batch_size, sum(n) as rows, count(*) as batches, sum(rl) as real_tokens,
               sum(n * ((mx + 7) // 8) * 8) as padded_tokens, max(((mx + 7) // 8) * 8) as widest
        from pb group by batch_size)
select cast(batch_size as bigint) as batch_size, cast(rows as bigint) as rows,
       cast(batches as bigint) as batches, cast(real_tokens as bigint) as real_tokens,
       cast(padded_tokens as bigint) as padded_tokens, cast(widest as bigint) as widest,
       round(1 - real_tokens / padded_tokens, 6) as waste
from rep""")
def batch_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate batch size, real vs padded characters of all documents."""
    docs = tables.documents(spark, sf_dir)
    return B.footprint(docs, "doc_id", F.length("text"), FOOTPRINT_SIZES).select(
        "batch_size", "rows", "batches", "real_tokens", "padded_tokens", "widest", "waste")


@register("length_grouped", sql=f"""
with r as (select doc_id, length(text) as len, {_rank_sql('doc_id')} as rank,
                  count(*) over () as total from documents),
ms as (select *, greatest(least(total // {BATCH * 4}, 50), 1) * {BATCH} as msize from r),
mg as (select *, (rank - 1) // msize as mega from ms),
ps as (select *, row_number() over (partition by mega order by len desc, rank) as pos from mg),
top as (select mega as top from ps where pos = 1 order by len desc, mega limit 1),
sw as (select ps.*, case when pos = 1 and mega = 0 then (select top from top)
                         when pos = 1 and mega = (select top from top) then 0
                         else mega end as nm from ps)
select doc_id, cast(nm * msize + pos as bigint) as grouped_rank,
       cast((nm * msize + pos - 1) // {BATCH} as bigint) as batch
from sw""")
def length_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-grouped batch order of the shuffled documents (batches of 8)."""
    # only (id, length) crosses the shuffles, never the text
    docs = tables.documents(spark, sf_dir).select("doc_id", F.length("text").alias("len"))
    order = O.exact_rank(docs, "doc_id", SEED)
    g = B.length_grouped_order(order, BATCH, F.col("len"))
    return g.select("doc_id", "grouped_rank",
                    B.batch_of(F.col("grouped_rank"), BATCH).alias("batch"))


# --- T4, T6: masked records; R1/R2 rendering; R3 per-row template ------------------

from ..functions.templates import fill_sql, parse_format, sql_literal  # noqa: E402


@register("train_records_masked", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(ALPACA, 'instruction', 'input', 'output'), CUTOFF)} as ids0,
       least(length({render_sql(ALPACA, 'instruction', 'input')}), {CUTOFF}) as n from inst)""",
    f"""e2 as (select id, n, {_eos_sql('ids0', CUTOFF)} as ids from enc)""",
    """masked as (select id, ids, list_concat(list_transform(range(n), lambda x: -100),
       case when len(ids) > n then ids[n + 1:] else []::integer[] end) as labels from e2)""",
) + TOKENS_OUT_SQL)
def train_records_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As train_records but the prompt part of the labels is -100."""
    recs = tables.inst(spark, sf_dir)
    tok = tokenize_records(recs, ALPACA, CodePoints(), cutoff_len=CUTOFF, train_on_inputs=False)
    return _tokens_out(tok, "id")


@register("render_prompts", sql=_with(tables.INST_SQL) + f"""
select id, {render_sql(ALPACA, 'instruction', 'input', 'output')} as full_prompt,
       {render_sql(ALPACA, 'instruction', 'input')} as user_prompt,
       {render_sql(get_template('alpaca_japanese'), 'instruction', 'input', 'output')} as full_prompt_ja
from inst""")
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full training prompt, user-only prompt, and the Japanese template's full prompt."""
    recs = tables.inst(spark, sf_dir)
    ins, inp, out = F.col("instruction"), F.col("input"), F.col("output")
    return recs.select("id", render(ALPACA, ins, inp, out).alias("full_prompt"),
                       render(ALPACA, ins, inp).alias("user_prompt"),
                       render(get_template("alpaca_japanese"), ins, inp, out).alias("full_prompt_ja"))


TEMPLATE_BY_LANG = {"ja": "alpaca_japanese", "en": "vqa"}   # others: the default template


def _template_case(lang, mapping, build):
    expr = None
    for code, name in mapping.items():
        v = build(get_template(name))
        expr = F.when(lang == code, v) if expr is None else expr.when(lang == code, v)
    return expr.otherwise(build(get_template("")))


@register("template_by_lang", sql=f"""
select doc_id,
       case {' '.join(f"when lang = {sql_literal(k)} then {sql_literal(v)}" for k, v in TEMPLATE_BY_LANG.items())}
            else 'alpaca' end as template,
       case {' '.join(f"when lang = {sql_literal(k)} then {render_sql(get_template(v), 'text', sql_literal(''))}" for k, v in TEMPLATE_BY_LANG.items())}
            else {render_sql(get_template(''), 'text', sql_literal(''))} end as prompt
from documents""")
def template_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 per row: each whole document rendered as an instruction through the
    template its language picks (a CASE over the few templates: no join)."""
    docs = tables.documents(spark, sf_dir)
    lang, text = F.col("lang"), F.col("text")
    return docs.select(
        "doc_id",
        _template_case(lang, TEMPLATE_BY_LANG, lambda t: F.lit(t.name)).alias("template"),
        _template_case(lang, TEMPLATE_BY_LANG,
                       lambda t: render(t, text, F.lit(""))).alias("prompt"))


@register("decode_ids", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(ALPACA, 'instruction', 'input', 'output'))} as ids0 from inst)""",
    f"""e2 as (select id, {_eos_sql('ids0', None)} as ids from enc)""",
) + f"""select id, array_to_string(list_transform(list_filter(ids, lambda i: i < {CP_EOS}),
       lambda i: chr(i)), '') as text from e2""")
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the whole training records back to text, special ids skipped."""
    recs = tables.inst(spark, sf_dir)
    tok = tokenize_records(recs, ALPACA, CodePoints(), cutoff_len=None, truncation=False)
    return tok.select("id", CodePoints().decode(F.col("input_ids")).alias("text"))


# --- S2, F1, R7-R10, W1, W2: inference prompts -----------------------------------------

from ..operators import evalsets as E  # noqa: E402
from ..operators import guards as G  # noqa: E402
from ..operators import scoring as S  # noqa: E402
from ..functions.text import PY_WHITESPACE, sql_chars  # noqa: E402

SHOTS = 7
MAX_LENGTH = 256          # length limit of the inference job
NEW_TOKENS = 5            # tokens generated per reply


def _label_word_sql(col: str) -> str:
    whens = " ".join(f"when {col} = {k} then {sql_literal(w)}" for k, w in E.NLI_LABEL_WORDS.items())
    return f"(case {whens} else error('unknown label') end)"


def _nli_prompt_sql(s1: str, s2: str, response: str, example: str = "''") -> str:
    return fill_sql(parse_format(E.NLI_PROMPT), {
        "example": example, "input1": s1, "input2": s2, "response": sql_literal(response)})


def _shots_sql(shot: int) -> str:
    block = fill_sql(parse_format(E.NLI_SHOT), {
        "sentence1": "sentence1", "sentence2": "sentence2", "label": _label_word_sql("label")})
    return f"""shots as (
  select coalesce(string_agg(block, '' order by i), '') as txt, count(*) as n from (
    select (rn - 1) * 3 + label as i, {block} as block from (
      select *, row_number() over (partition by label order by sentence_pair_id) as rn
      from nli where split = 'train') where (rn - 1) * 3 + label < {shot}))"""


@register("nli_pairs", sql=_with(tables.NLI_SQL) + """
select sentence_pair_id, sentence1, sentence2, label from nli where split = 'validation'""")
def nli_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation split of the sentence pairs (line pairs of labelled documents)."""
    return E.select_split(tables.nli(spark, sf_dir), "validation").select(
        "sentence_pair_id", "sentence1", "sentence2", "label")


@register("nli_label_filter", sql=_with(tables.NLI_SQL) + """
select sentence_pair_id, sentence1, sentence2 from nli where split = 'train' and label = 1""")
def nli_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train pairs of label 1."""
    train = E.select_split(tables.nli(spark, sf_dir), "train")
    return E.filter_label(train, 1).select("sentence_pair_id", "sentence1", "sentence2")


NLI_ZERO_SQL = f"""nli_eval as (
  select sentence_pair_id, {_nli_prompt_sql('sentence1', 'sentence2', E.RESPONSE_MARKERS['ja'])} as prompts,
         {_label_word_sql('label')} as expected
  from nli where split = 'validation')"""


@register("nli_prompts", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL) + "select * from nli_eval")
def nli_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7-R10 (Japanese marker), zero-shot: (id, prompts, expected)."""
    return E.nli_eval_set(tables.nli(spark, sf_dir), shot=0, language="ja")


@register("nli_prompts_few_shot", sql=_with(tables.NLI_SQL, _shots_sql(SHOTS)) + f"""
select sentence_pair_id,
       case when (select n from shots) < {SHOTS} then error('too few shots') else
       {_nli_prompt_sql('sentence1', 'sentence2', E.RESPONSE_MARKERS['en'], '(select txt from shots)')} end as prompts,
       {_label_word_sql('label')} as expected
from nli where split = 'validation'""")
def nli_prompts_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2 + R8 with 7 shots and the English final marker (examples keep the Japanese one)."""
    return E.nli_eval_set(tables.nli(spark, sf_dir), shot=SHOTS, language="en")


@register("nli_encode_guard", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL) + f"""
select sentence_pair_id, cast(len({codepoints_sql('prompts')}) as bigint) as n_ids,
       len({codepoints_sql('prompts')}) + {NEW_TOKENS} <= {MAX_LENGTH} as fits
from nli_eval""")
def nli_encode_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 + F3 (flag mode): encode each prompt, flag rows whose ids plus the
    new tokens exceed the length limit."""
    ev = E.nli_eval_set(tables.nli(spark, sf_dir), shot=0, language="ja")
    enc = ev.select("sentence_pair_id", CodePoints().encode(F.col("prompts")).alias("input_ids"))
    flagged = G.length_guard(enc, MAX_LENGTH, reserve=NEW_TOKENS, mode="flag")
    return flagged.select("sentence_pair_id", F.size("input_ids").cast("bigint").alias("n_ids"),
                          "fits")


WS_SQL = sql_chars(PY_WHITESPACE)
LABELS = sorted(E.NLI_LABEL_WORDS)
PAIR_TEXT_SQL = "string_split(concat_ws(' ', sentence1, sentence2), ' ')"
GEN_SQL = f"""lw as (select label, unnest({PAIR_TEXT_SQL}) as tok from nli where split = 'train' and label is not null),
lc as (select tok, {', '.join(f"count(*) filter (label = {k}) as n{k}" for k in LABELS)} from lw group by tok),
lt as (select count(*) as v, {', '.join(f"coalesce(sum(n{k}), 0) as t{k}" for k in LABELS)} from lc),
rw as (select sentence_pair_id, unnest({PAIR_TEXT_SQL}) as tok from nli where split = 'validation'),
rs as (select sentence_pair_id, {', '.join(f"round(-avg(ln((coalesce(n{k}, 0) + 1) / greatest(t{k} + v, 1))), 6) as s{k}" for k in LABELS)}
       from rw left join lc on lc.tok = rw.tok cross join lt group by sentence_pair_id),
rl as (select sentence_pair_id, case when s0 <= s1 and s0 <= s2 then 0 when s1 <= s2 then 1 else 2 end as label from rs),
rep as (select sentence_pair_id, {_label_word_sql('label')} as reply from rl),
gen as (select e.sentence_pair_id, e.expected, e.prompts || rep.reply || chr(10) as generated
        from nli_eval e join rep on rep.sentence_pair_id = e.sentence_pair_id),
ans as (select sentence_pair_id, expected, generated,
        trim(split_part(generated, {sql_literal(E.RESPONSE_MARKERS['ja'])}, -1), {WS_SQL}) as answer from gen)"""


def _nli_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label word that the count model conditioned on the label, fitted on the whole
    train split, prefers for each validation pair."""
    pairs = tables.nli(spark, sf_dir)
    chosen = S.choose_label(E.select_split(pairs, "train"), E.select_split(pairs, "validation"),
                            F.concat_ws(" ", "sentence1", "sentence2"), F.col("label"), LABELS,
                            id_col="sentence_pair_id")
    return chosen.select("sentence_pair_id", E.label_word(F.col("label")).alias("reply"))


def _nli_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``expected, answer`` without whole prompts in the join: the text after the last marker of
    prompt and reply is that of the reply and what follows the prompt's own last marker."""
    marker = E.RESPONSE_MARKERS["ja"]
    ev = E.require_columns(E.nli_eval_set(tables.nli(spark, sf_dir), shot=0, language="ja")).select(
        "sentence_pair_id", "expected", F.split_part("prompts", F.lit(marker), F.lit(-1)).alias("tail"))
    both = S.pair(ev, _nli_replies(spark, sf_dir), "sentence_pair_id")
    return both.select("expected", S.answer_after_last(F.concat("tail", "reply", F.lit("\n")), marker).alias("answer"))


def _nli_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = E.require_columns(E.nli_eval_set(tables.nli(spark, sf_dir), shot=0, language="ja"))
    both = S.pair(ev, _nli_replies(spark, sf_dir), "sentence_pair_id")
    gen = both.withColumn("generated", F.concat("prompts", "reply", F.lit("\n")))
    return gen.withColumn("answer", S.answer_after_last(F.col("generated"), E.RESPONSE_MARKERS["ja"]))


@register("nli_pair_replies", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL, GEN_SQL) + """
select e.sentence_pair_id, e.expected, rep.reply from nli_eval e
join rep on rep.sentence_pair_id = e.sentence_pair_id""")
def nli_pair_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 per label + M3: expected words and the model's replies, matched on the pair id."""
    ev = E.nli_eval_set(tables.nli(spark, sf_dir), shot=0, language="ja")
    return S.pair(ev.select("sentence_pair_id", "expected"), _nli_replies(spark, sf_dir), "sentence_pair_id")


@register("nli_generate", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL, GEN_SQL) +
          "select sentence_pair_id, expected, generated, answer from ans")
def nli_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + X3 + M3: prompt and reply as a model emits them, the text after the last
    marker, stripped."""
    return _nli_answers(spark, sf_dir).select("sentence_pair_id", "expected", "generated", "answer")


@register("nli_accuracy", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL, GEN_SQL) + """
select 'jnli' as task, cast(count(*) as bigint) as n,
       round(avg(case when coalesce(contains(answer, expected), false) then 1.0 else 0.0 end), 4) as value
from ans""")
def nli_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M4: substring accuracy of the extracted answers, 4 digits."""
    ans = _nli_choices(spark, sf_dir)
    return S.report(ans, "jnli", S.accuracy(F.col("expected"), F.col("answer")), 4)


@register("nli_choice_share", sql=_with(tables.NLI_SQL, NLI_ZERO_SQL, GEN_SQL) + f"""
select 'jnli' as task, cast(count(*) as bigint) as n,
       round(avg(case when answer in ({', '.join(sql_literal(w) for w in E.NLI_LABEL_WORDS.values())})
                 then 1.0 else 0.0 end), 4) as value
from ans""")
def nli_choice_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: share of answers that are exactly one of the three label words."""
    ans = _nli_choices(spark, sf_dir)
    return S.report(ans, "jnli", S.choice_share(F.col("answer"), E.NLI_LABEL_WORDS.values()), 4)


# --- R4-R6, R1 (vqa), T5 masked, F2, G3, G2, M2: perplexity ------------------------------

from ..functions.templates import evaluation_template  # noqa: E402

PPL_MAX_LENGTH = 4096     # context length of the scoring model (whole conversations fit)
VQA = evaluation_template("en")


def _vqa_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = tables.inst(spark, sf_dir).select("id", F.col("instruction").alias("question"),
                                           F.col("output").alias("answer"))
    ev = E.require_columns(E.rename_qa_to_eval(qa))
    recs = E.empty_input(E.rename_eval_to_instruction(ev))
    tok = tokenize_records(recs, VQA, CodePoints(), cutoff_len=None, train_on_inputs=False,
                           truncation=False)
    return G.length_guard(tok, PPL_MAX_LENGTH, mode="fail")


VQA_TOK_SQL = f"""enc as (select id, {codepoints_sql(render_sql(VQA, 'instruction', "''", 'output'))} as ids0,
       length({render_sql(VQA, 'instruction', "''")}) as n from inst),
tok as (select id, {_eos_sql('ids0', None)} as ids, n from enc),
masked as (select id, ids, list_concat(list_transform(range(n), lambda x: -100),
       case when len(ids) > n then ids[n + 1:] else []::integer[] end) as labels from tok
       where case when len(ids) <= {PPL_MAX_LENGTH} then true else error('row too long') end),
counts as (select t as tok, count(*) as c from (select unnest(ids) as t from masked) group by t),
nv as (select sum(c) as n, count(*) as v from counts),
lp as (select tok, c, ln((c + 1.0) / (n + v)) as logprob from counts, nv),
pos as (select id, ids, labels, unnest(range(2, len(ids) + 1)) as j from masked),
sc as (select pos.id, -avg(lp.logprob) as loss from pos join lp on lp.tok = pos.ids[j]
       where pos.labels[j] <> -100 group by pos.id),
losses as (select m.id, coalesce(sc.loss, 'NaN'::double) as loss from masked m left join sc on sc.id = m.id)"""


@register("vqa_records", sql=_with(tables.INST_SQL, VQA_TOK_SQL) + TOKENS_OUT_SQL)
def vqa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 -> R5 -> R6 -> vqa template -> T5 without truncation, prompt masked -> F2 (fail)."""
    return _tokens_out(_vqa_tokens(spark, sf_dir), "id")


@register("token_logprob", sql=_with(tables.INST_SQL, VQA_TOK_SQL) + """
select cast(tok as integer) as tok, cast(c as bigint) as n, round(logprob, 6) as logprob from lp""")
def token_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one unigram log-probability of every token of the scored table."""
    t, _ = S.count_model(_vqa_tokens(spark, sf_dir))
    return t.select("tok", F.col("n").cast("bigint").alias("n"),
                    F.round("logprob", 6).alias("logprob"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, losses = S.count_model(_vqa_tokens(spark, sf_dir))
    return losses


@register("example_loss", sql=_with(tables.INST_SQL, VQA_TOK_SQL) + """
select id, round(loss, 6) as loss from losses""")
def example_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted mean negative log-probability of each example's unmasked labels."""
    return _losses(spark, sf_dir).select("id", F.round("loss", 6).alias("loss"))


@register("vqa_perplexity", sql=_with(tables.INST_SQL, VQA_TOK_SQL) + """
select 'ppl-vqa' as task, cast(count(*) as bigint) as n, round(exp(avg(loss)), 6) as value from losses""")
def vqa_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M4: exp of the mean example loss, 6 digits."""
    return S.report(_losses(spark, sf_dir), "ppl-vqa", S.perplexity(F.col("loss")), 6)


# --- C1-C6, T9: conversations ---------------------------------------------------------

from ..functions.tokens import cut_prompt  # noqa: E402
from ..operators import chat as C  # noqa: E402


def _role_sql(role: str) -> str:
    return (f"(case {role} when 'user' then {sql_literal(C.JAPANESE_ROLES[0])} "
            f"when 'assistant' then {sql_literal(C.JAPANESE_ROLES[1])} else {role} end)")


def _msg_sql(role_name: str, text: str) -> str:
    sep = sql_literal(C.JAPANESE_SEP)
    return (f"(case when coalesce(length({text}) > 0, false) then {role_name} || ': ' || {text} || {sep} "
            f"else {role_name} || ':' end)")


CHAT_SYS_SQL = """sys as (select conv_id, arg_min(text, turn) as s from conversations where role = 'system' group by conv_id)"""


@register("chat_prompts", sql=_with(
    CHAT_SYS_SQL,
    f"""msgs as (select conv_id, turn, role, {_msg_sql(_role_sql('role'), 'text')} as m
         from conversations where role <> 'system')""",
    """hist as (select conv_id, turn, role, array_to_string(list(m) over (partition by conv_id order by turn
         rows between unbounded preceding and current row), '') as h from msgs)""",
) + f"""select h.conv_id, h.turn,
       coalesce(sys.s, {sql_literal(C.JAPANESE_SYSTEM)}) || {sql_literal(C.JAPANESE_SEP)} || h.h
       || {sql_literal(C.JAPANESE_ROLES[1] + ':')} as prompt
from hist h left join sys on sys.conv_id = h.conv_id where h.role = 'user'""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation prompt of every user turn, whole history."""
    return C.conversation_prompts(tables.conversations(spark, sf_dir))


@register("chat_prompts_no_context", sql=_with(CHAT_SYS_SQL) + f"""
select c.conv_id, c.turn,
       coalesce(sys.s, {sql_literal(C.JAPANESE_SYSTEM)}) || {sql_literal(C.JAPANESE_SEP)}
       || {_msg_sql(sql_literal(C.JAPANESE_ROLES[0]), 'c.text')} || {sql_literal(C.JAPANESE_ROLES[1] + ':')} as prompt
from conversations c left join sys on sys.conv_id = c.conv_id where c.role = 'user'""")
def chat_prompts_no_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of the current user message only (plus the system text)."""
    return C.no_context_prompts(tables.conversations(spark, sf_dir))


@register("chat_single_turn", sql=f"""
select conv_id, turn, {fill_sql(parse_format(C.SINGLE_TURN_PROMPT), {'text': 'text'})} as prompt
from conversations where role = 'user' and length(text) > 0""")
def chat_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 + C3: non-empty user messages as single-turn prompts."""
    users = C.non_empty_user_turns(tables.conversations(spark, sf_dir))
    return users.select("conv_id", "turn", C.single_turn_prompt(F.col("text")).alias("prompt"))


@register("chat_replies", sql=f"""
with p as (
  select u.conv_id, u.turn, {fill_sql(parse_format(C.SINGLE_TURN_PROMPT), {'text': 'u.text'})} as prompt,
         replace(a.text, chr(10), {sql_literal(C.NEWLINE_MARKER)}) || {sql_literal(C.JAPANESE_STOP)} || 'tail' as raw
  from conversations u join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user' and length(u.text) > 0),
ids as (select conv_id, turn, {codepoints_sql('prompt')} as pids, {codepoints_sql('prompt || raw')} as oids from p)
select conv_id, turn,
       split_part(replace(array_to_string(list_transform(oids[len(pids) + 1:], lambda i: chr(i)), ''),
                          {sql_literal(C.NEWLINE_MARKER)}, chr(10)), {sql_literal(C.JAPANESE_STOP)}, 1) as reply
from ids""")
def chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 + C4 + C5: the reply part of an output id sequence decoded, newline
    markers restored, cut at the stop string. The output sequence is the
    single-turn prompt followed by the recorded assistant message (newlines
    as markers) and a stop string, as a model would emit it."""
    conv = tables.conversations(spark, sf_dir)
    users = C.non_empty_user_turns(conv).select("conv_id", "turn", "text")
    replies = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    enc = CodePoints()
    p = users.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", C.single_turn_prompt(F.col("text")).alias("prompt"),
        F.concat(F.replace(F.col("reply"), F.lit("\n"), F.lit(C.NEWLINE_MARKER)),
                 F.lit(C.JAPANESE_STOP + "tail")).alias("raw"))
    ids = p.select("conv_id", "turn", enc.encode(F.col("prompt")).alias("pids"),
                   enc.encode(F.concat("prompt", "raw")).alias("oids"))
    gen = enc.decode(cut_prompt(F.col("oids"), F.size("pids")))
    return ids.select("conv_id", "turn", C.cut_at_stop(C.decode_newlines(gen)).alias("reply"))


# --- variants: bounded chat history, Japanese question template ------------------------

from .evaluation import perplexity_records  # noqa: E402

RECENT = 4   # messages of history a bounded-context model keeps


@register("chat_prompts_recent", sql=_with(
    CHAT_SYS_SQL,
    f"""msgs as (select conv_id, turn, role, {_msg_sql(_role_sql('role'), 'text')} as m
         from conversations where role <> 'system')""",
    f"""hist as (select conv_id, turn, role, array_to_string(list(m) over (partition by conv_id order by turn
         rows between {RECENT - 1} preceding and current row), '') as h from msgs)""",
) + f"""select h.conv_id, h.turn,
       coalesce(sys.s, {sql_literal(C.JAPANESE_SYSTEM)}) || {sql_literal(C.JAPANESE_SEP)} || h.h
       || {sql_literal(C.JAPANESE_ROLES[1] + ':')} as prompt
from hist h left join sys on sys.conv_id = h.conv_id where h.role = 'user'""")
def chat_prompts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with a bounded history (an option of ours for models with a short context): the
    latest 4 messages, by a sliding frame."""
    return C.conversation_prompts(tables.conversations(spark, sf_dir), max_messages=RECENT)


VQA_JA = evaluation_template("ja")


@register("vqa_records_ja", sql=_with(
    tables.INST_SQL,
    f"""enc as (select id, {codepoints_sql(render_sql(VQA_JA, 'instruction', "''", 'output'))} as ids0,
       length({render_sql(VQA_JA, 'instruction', "''")}) as n from inst)""",
    f"""tok as (select id, {_eos_sql('ids0', None)} as ids, n from enc)""",
    """masked as (select id, ids, list_concat(list_transform(range(n), lambda x: -100),
       case when len(ids) > n then ids[n + 1:] else []::integer[] end) as labels from tok)""",
) + TOKENS_OUT_SQL)
def vqa_records_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 (language ja -> Japanese question template) + T5 without truncation, prompt masked."""
    qa = tables.inst(spark, sf_dir).select("id", F.col("instruction").alias("question"),
                                           F.col("output").alias("answer"))
    return _tokens_out(perplexity_records(qa, "ja", CodePoints(), PPL_MAX_LENGTH), "id")


# --- X1: the response part of a rendered prompt -----------------------------------------

@register("prompt_response", sql=_with(tables.INST_SQL) + f"""
select id, case when contains(p, {sql_literal(ALPACA.response_split)})
                then trim(split_part(p, {sql_literal(ALPACA.response_split)}, 2), {WS_SQL})
                else null end as response
from (select id, {render_sql(ALPACA, 'instruction', 'input', 'output')} as p from inst)""")
def prompt_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X3: the text after the template's response marker (up to a second one),
    stripped, of every rendered training prompt."""
    recs = tables.inst(spark, sf_dir)
    p = render(ALPACA, F.col("instruction"), F.col("input"), F.col("output"))
    return recs.select("id", S.answer_after_first(p, ALPACA.response_split).alias("response"))


# --- S3, S4: nested question lists ---------------------------------------------------------

from ..sources.readers import NESTED_QA_SCHEMA, flatten_qa  # noqa: E402


@register("qa_flatten", sql="""
select u.text as question, a.text as answer from conversations u left join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""")
def qa_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4: documents with a ``qas`` list (one user turn each, with a key of its own,
    and without the answer key where no reply follows), read as JSON and flattened."""
    conv = tables.conversations(spark, sf_dir)
    reply = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = conv.filter(F.col("role") == "user").join(reply, ["conv_id", "turn"], "left").select(
        F.array(F.struct(F.col("text").alias("question"), "answer", "turn")).alias("qas"))
    nested = qa.select(F.from_json(F.to_json(F.struct("qas")), NESTED_QA_SCHEMA).alias("d")).select("d.qas")
    return flatten_qa(nested)
