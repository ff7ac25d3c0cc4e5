"""Python workers import the package even when the driver runs elsewhere."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
from tessera.functions.templates import get_template
from tessera.functions.tokens import get_encoder
from tessera.operators.tokenize import tokenize_records
from tessera.sources import tables
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["nli_accuracy"](spark, "/root/testdata/sf0.001").count(),
      tokenize_records(tables.inst(spark, "/root/testdata/sf0.001"), get_template("alpaca"),
                       get_encoder("byte_bpe_50k"), cutoff_len=256).count() > 0)
"""


def test_python_workers_from_other_cwd():
    cwd = tempfile.mkdtemp(prefix="tessera-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 1 True" in out.stdout, out.stderr[-2000:]
