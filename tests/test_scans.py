"""Scans over ranges against the windows over whole keys: one hot key, small keys, a null key, ties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parchmill.operators import jobs, scans

LOG = "owner string, n long, at double, outcome string, wait long, payload string, status string, extra long"
ORDER = ["at", "n"]


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(6)
    rows = []
    for owner, many in (("hot", 700), (None, 40), ("a", 5), ("b", 1), ("c", 60)):
        at = 0.0
        for _ in range(many):
            at += r.choice([0, 1, 1, 2, 40, 400])
            rows.append((owner, len(rows), at, r.choice(["refused", "refused", "refused", "success", "other", None]), r.choice([None, 0, 7, 90]), r.choice(["x", "y", None]), r.choice(["running"] * 60 + ["failed"]), 1))
    r.shuffle(rows)
    return spark.createDataFrame(rows, LOG).cache()


def same(a, b):
    rows = [sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str) for df in (a, b)]
    assert rows[0] == rows[1] and len(rows[0])


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_equal_windows(log, parts):
    same(scans.rate_slots(log, "owner", ORDER, "at", 3, partitions=parts), jobs.rate_slots(log, "owner", ORDER, "at", 3))
    same(scans.cooldowns(log, "owner", ORDER, "at", "outcome", "wait", partitions=parts), jobs.cooldowns(log, "owner", ORDER, "at", "outcome", "wait"))
    same(scans.stalls(log, "owner", ORDER, "at", 40, partitions=parts), jobs.stalls(log, "owner", ORDER, "at", 40))
    same(scans.frozen(log.drop("n"), "owner", ["at", "payload"], "wait", partitions=parts), scans.frozen(log.drop("n"), "owner", ["at", "payload"], "wait", partitions=1))
    frozen = jobs.frozen(log.withColumn("o", F.struct("at", "n")), "owner", "o", "wait").drop("o")
    same(scans.frozen(log, "owner", ORDER, "wait", partitions=parts), frozen)


@pytest.mark.parametrize("most", [3, 1800])
def test_changes_equal_windows(log, most):
    for status in (None, "status"):
        ranged = scans.changes(log, "owner", ORDER, "payload", status, ("failed",), most, partitions=7)
        same(ranged, jobs.changes(log.where("true"), "owner", ORDER, "payload", status, most))


def test_ranges_are_bounded(log):
    """No task holds the hot key: its rows are dealt over ranges, in order."""
    table = scans.ranged(log, [F.col("owner"), F.col("at"), F.col("n")], "ranges", 20)
    sizes = [r["count"] for r in table.where("owner = 'hot'").groupBy(scans.PART).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 150
    placed = [(r["at"], r["n"]) for r in table.where("owner = 'hot'").orderBy(scans.PART, scans.POS).collect()]
    assert placed == sorted(placed)


def test_quota_equals_the_fold(log):
    for parts in (1, 6):
        for window, most in ((50, 2), (3000, 5), (10**9, 1)):
            same(scans.upload_quota(log, "owner", ORDER, "at", window, most, partitions=parts), jobs.upload_quota(log, "owner", ORDER, "at", window, most))


def test_quota_over_blocks(log):
    for window, most, bits in ((50, 2, 3), (400, 5, 5), (3000, 3, 0)):
        same(scans.upload_quota(log, "owner", ORDER, "at", window, most, partitions=3, block_bits=bits), jobs.upload_quota(log, "owner", ORDER, "at", window, most))


def test_quota_doubles_pointers_of_blocks_only(spark, monkeypatch):
    """The rows of all pointer tables together are a small multiple of the log, however long a chain is."""
    written, keep = [], scans.Scratch.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        written.extend([kept.count()] * (name in ("jumps", "hops")))
        return kept

    monkeypatch.setattr(scans.Scratch, "keep", counted)
    log = spark.range(4000).select(F.lit("hot").alias("owner"), F.col("id").alias("n"), F.col("id").cast("double").alias("at"))
    assert scans.upload_quota(log, "owner", ORDER, "at", 2, 1, partitions=3).where("allowed").count() == 2000
    assert sum(written) <= 3 * 4000


def test_empty_log(log):
    none = log.where("false")
    assert scans.rate_slots(none, "owner", ORDER, "at", 3).count() == 0 and scans.cooldowns(none, "owner", ORDER, "at", "outcome", "wait").count() == 0
    assert scans.changes(none, "owner", ORDER, "payload").count() == 0 and scans.upload_quota(none, "owner", ORDER, "at").count() == 0
