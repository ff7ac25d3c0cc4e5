"""tessera: Spark-native data side of instruction tuning and evaluation.

Every operator is a lazy ``DataFrame -> DataFrame`` function (or a Column
expression) built from Spark SQL expressions, usable with ``df.transform``.
The most used ones are importable from here.
"""

__version__ = "0.1.0"

from .functions.templates import (  # noqa: E402,F401
    evaluation_template, get_template, load_template, render, training_template)
from .functions.tokens import CodePoints, Vocab, get_encoder  # noqa: E402,F401
from .operators.batches import (  # noqa: E402,F401
    device_batch_size, footprint, length_grouped_order, pad_batches)
from .operators.chat import (  # noqa: E402,F401
    conversation_prompts, cut_at_stop, decode_newlines, no_context_prompts, single_turn_prompt)
from .operators.evalsets import few_shot_text, label_word, nli_eval_set, select_split  # noqa: E402,F401
from .operators.guards import length_guard  # noqa: E402,F401
from .operators.order import exact_rank, exact_split, shuffle_rows  # noqa: E402,F401
from .operators.scoring import (  # noqa: E402,F401
    Scorer, accuracy, answer_after_first, answer_after_last, choice_share, count_model,
    example_loss, perplexity, py_strip, report, score)
from .operators.tokenize import decode_column, encode_column, tokenize_records  # noqa: E402,F401
from .sources.readers import read_instructions, read_nested_qa  # noqa: E402,F401
from .sources.sinks import write_csv, write_jsonl, write_results  # noqa: E402,F401
from .plans import evaluation, training  # noqa: E402,F401
from .plans import chat  # noqa: E402,F401
