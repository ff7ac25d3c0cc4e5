"""Scale check of the exact rank/split (W3/W6) and padding (B1/B2) beyond
the test tables: generated ids (``spark.range``), so it measures the
algorithms, not a query. Each result is checked independently.

Usage: python tools/scale_check.py [rows ...]
       SCALE_JOB_COPIES=100 python tools/scale_check.py   # also the training job on 100x documents
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import batches as B  # noqa: E402
from tessera.operators import order as O  # noqa: E402
from tessera.session import local_session  # noqa: E402


def check_split(spark, n: int) -> str:
    df = spark.range(n).withColumnRenamed("id", "rid")
    t = time.time()
    r = O.exact_split(df, "rid", 2000, 42).ranked.agg(
        F.count(F.lit(1)).alias("c"), F.countDistinct("split", "position").alias("d"),
        F.max("position").alias("m")).first()
    ok = r.c == n and r.d == n and r.m == n - 2000
    return f"exact_split n={n:,}: {time.time() - t:.1f}s ok={ok}"


def check_pad(spark, n: int) -> str:
    df = spark.range(n).withColumnRenamed("id", "rid")
    t = time.time()
    o = O.exact_split(df, "rid", 2000, 42).derive(lambda d: d.withColumn(
        "input_ids", F.array_repeat(F.lit(1), (F.col("rid") % 37 + 1).cast("int")))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
        .withColumn("labels", F.col("input_ids")))
    p = B.pad_batches(o, 8, pad_id=0)
    bad = (p.select("split", "batch", "width", (F.col("rid") % 37 + 1).alias("n"))
           .groupBy("split", "batch")
           .agg(F.countDistinct("width").alias("w"), F.max("width").alias("mw"), F.max("n").alias("mx"))
           .filter((F.col("w") != 1) | (F.col("mw") != F.floor((F.col("mx") + 7) / 8) * 8)).count())
    return f"pad_batches n={n:,}: {time.time() - t:.1f}s wrong_batches={bad}"


def check_training_job(spark, sf_dir: str, copies: int, work: str) -> str:
    """The whole training data job on ``copies`` copies of the documents table
    (each copy a distinct id; whole texts as instructions), written as parquet."""
    from tessera.functions.templates import get_template
    from tessera.functions.tokens import CodePoints
    from tessera.plans import training as TR

    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    recs_path = os.path.join(work, "records")
    (docs.select("doc_id", "text", "source",
                 F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"))
     .select((F.col("k") * 1_000_000 + F.col("doc_id")).alias("id"),
             F.col("text").alias("instruction"), F.lit("").alias("input"),
             F.col("source").alias("output"))
     .write.parquet(recs_path))
    recs = spark.read.parquet(recs_path)
    t = time.time()
    out_path = os.path.join(work, "batches")
    TR.write_batches(TR.training_batches(recs, get_template("alpaca"), CodePoints(), 256, 16, 2,
                                         val_set_size=2000), out_path)
    el = time.time() - t
    out = spark.read.parquet(out_path)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"),
                F.sum(F.when(F.col("split") == "validation", 1).otherwise(0)).alias("val")).first()
    mixed = (out.groupBy("split", "batch").agg(F.countDistinct(F.size("input_ids")).alias("k"))
             .filter("k <> 1").count())
    return (f"training job rows={r.n:,}: {el:.1f}s distinct_ids={r.ids:,} validation={r.val} "
            f"mixed_width_batches={mixed}")


def main() -> None:
    sizes = [int(x) for x in sys.argv[1:]] or [10_000_000, 40_000_000]
    spark = local_session(8, shuffle_partitions=64)
    for n in sizes:
        print(check_split(spark, n), flush=True)
    print(check_pad(spark, min(sizes[0], 5_000_000)), flush=True)
    if os.environ.get("SCALE_JOB_COPIES"):
        import tempfile
        work = tempfile.mkdtemp(prefix="tessera-scale-")   # local experiment only
        print(check_training_job(spark, os.environ.get("SCALE_SF_DIR", "/root/testdata/sf0.1"),
                                 int(os.environ["SCALE_JOB_COPIES"]), work), flush=True)


if __name__ == "__main__":
    main()
