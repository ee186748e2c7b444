"""The driver's contract, and queries that don't depend on how rows are dealt out."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from parchmill import plans

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(plans.QUERIES) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["segment_pack", "rate_slots", "tm_topk"])
def test_partitions_do_not_matter(spark, small, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k" if n > 1 else "128m")
        return sorted(map(tuple, entry.queries()[name](spark, small).collect()))

    one, many = run(1), run(7)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert one == many


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_training_operators(tmp_path, pipeline):
    """Without the subpackage, and with or without the pipeline that uses it."""
    for p in ("parchmill", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "parchmill/llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
