"""Job rows from event logs, progress, limits and stalls as window plans.

Each rule that a service keeps in mutable state is a closed form over an ordered window
here, or a fold over one key's sorted rows where it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stages in order with their relative weights.
STAGES = (
    ("parse", 28.0), ("split", 1.0), ("context", 5.0), ("translate", 42.0), ("assemble", 1.0),
    ("scoring", 4.0), ("review", 8.0), ("retranslate", 4.0), ("backtranslation", 6.0), ("latex_fix", 3.0),
    ("layout_fix", 6.0), ("figures", 4.0), ("export", 10.0), ("render_check", 2.0), ("learn", 1.0),
)
ALWAYS = ("parse", "split", "translate", "assemble")
TERMINAL = ("completed", "failed", "partial")


def latest(log: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Rows of partial updates -> the current row of each key: the last value of each field that isn't null."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return log.groupBy(key).agg(F.min(order).alias("created_at"), F.max(order).alias("updated_at"), *last)


def newest(rows: DataFrame, owner: str | None, limit: int) -> DataFrame:
    """An owner's jobs, or all, newest first."""
    chosen = rows.where(F.col("owner") == owner) if owner is not None else rows
    return chosen.orderBy(F.desc("created_at"), "job_id").limit(limit)


def page(segments: DataFrame, job: str, order: str, offset: int = 0, limit: int = 50, only_failed: bool = False, key: str = "job_id") -> DataFrame:
    """Some segments of a job in order, each with how many there are before paging; the other columns settle ties."""
    chosen = segments.where(F.col(key) == job)
    chosen = chosen.where(~F.col("ok")) if only_failed else chosen
    total = F.count("*").over(Window.partitionBy(key))
    return chosen.withColumn("total", total).orderBy(order, *[c for c in chosen.columns if c != order]).offset(max(0, offset)).limit(min(max(1, limit), 200))


def with_segments(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Jobs with what their segments sum up to; a job without segments has zeros."""
    sums = segments.groupBy("job_id").agg(F.count("*").alias("segments"), F.count_if(~F.col("ok")).alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return jobs.join(sums, "job_id", "left").select(*jobs.columns, zero("segments"), zero("failed"))


def replace_children(children: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Children of the keys in ``new`` give way to it, numbered anew from 0."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    kept = children.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.withColumn("order", number))


def pause_requested(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    return jobs.join(requests.where("pause_requested").select("job_id"), "job_id", "left_semi")


def stage_plan(spark: SparkSession, enabled: set[str]) -> DataFrame:
    """(position, key, weight, start): enabled stages, weights as shares, start as the sum before."""
    rows = [(k, name, weight) for k, (name, weight) in enumerate(STAGES) if name in ALWAYS or name in enabled]
    order = Window.orderBy("position")
    plan = spark.createDataFrame(rows, "position int, key string, raw double")
    share = F.col("raw") / F.sum("raw").over(Window.partitionBy())
    return plan.withColumn("weight", share).withColumn("start", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("raw")


def overall_progress(ticks: DataFrame, plan: DataFrame) -> DataFrame:
    """Ticks (stage, fraction) plus ``progress``; an unknown stage counts by its fraction alone."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    joined = ticks.join(F.broadcast(plan.select(F.col("key").alias("stage"), "weight", "start")), "stage", "left")  # fifteen rows at most
    return joined.withColumn("progress", F.coalesce(F.col("start") + F.col("weight") * clamped, clamped)).drop("weight", "start")


def frozen(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last known value repeated where there is none."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def rate_slots(calls: DataFrame, key: str, order: list[str], at: str, interval: int) -> DataFrame:
    """Calls plus ``slot``: evenly spaced slots, each the later of its call and the slot before plus the interval.

    Unrolled, slot i is i * interval plus the running maximum of call j less j * interval.
    """
    w = Window.partitionBy(key).orderBy(*order)
    place = F.row_number().over(w).cast("long")
    shifted = calls.withColumn("__i", place)
    running = F.max(F.col(at) - F.col("__i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return shifted.withColumn("slot", F.col("__i") * interval + running).drop("__i")


def cooldowns(calls: DataFrame, key: str, order: list[str], at: str, outcome: str, retry_after: str, base: float = 15.0, most: float = 120.0) -> DataFrame:
    """Calls plus ``cooldown`` (of refused ones) and ``deadline``: the gate's end after each call.

    Successes cut a key's calls into islands; in one, the k-th refusal's own penalty is
    base * 2 ** (k - 1), unless the server gave a time; both up to a limit.
    """
    w = Window.partitionBy(key).orderBy(*order)
    islands = calls.withColumn("__s", F.sum(F.when(F.col(outcome) == "success", 1).otherwise(0)).over(w))
    refused = F.col(outcome) == "refused"
    k = F.sum(F.when(refused, 1).otherwise(0)).over(Window.partitionBy(key, "__s").orderBy(*order))
    numbered = islands.withColumn("__k", F.least(k, F.lit(40)))
    penalty = F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("__k") - 1), F.lit(most))
    wait = F.when(refused, F.least(F.coalesce(F.when(F.col(retry_after) > 0, F.col(retry_after).cast("double")), penalty), F.lit(most)))
    timed = numbered.withColumn("cooldown", wait)
    return timed.withColumn("deadline", F.max(F.col(at) + F.col("cooldown")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s", "__k")


def stalls(beats: DataFrame, key: str, order: list[str], at: str, seconds: float) -> DataFrame:
    """Gaps of ``seconds`` at least between beats: (key, from, to, idle), one for each stall."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(*order))
    gaps = beats.withColumn("stalled_at", before).withColumn("idle", F.col(at) - F.col("stalled_at"))
    return gaps.where(F.col("idle") >= seconds).select(key, "stalled_at", F.col(at).alias("resumed_at"), "idle")


def changes(rows: DataFrame, key: str, order: list[str], payload: str, status: str | None = None, most: int = 1800) -> DataFrame:
    """Rows whose payload differs from the one before, up to the first terminal status."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = rows.withColumn("__n", F.row_number().over(w)).withColumn("__b", F.lag(payload).over(w))
    if status:
        ended = F.coalesce(F.max(F.when(F.col(status).isin(*TERMINAL), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seen = seen.withColumn("__e", ended).where("__e = 0").drop("__e")
    first_or_new = (F.col("__n") == 1) | ~F.col(payload).eqNullSafe(F.col("__b"))
    return seen.where((F.col("__n") <= most) & first_or_new).drop("__n", "__b")


def _fold(rows: DataFrame, key: str, order: list[str], needs: list[str], start: Callable[[], dict], step: Callable[..., object], out: str, kind: str) -> DataFrame:
    """Rows plus a column from a fold over each key's rows in order.

    Rows are dealt out by key, sorted and streamed; a task holds a batch and the state of one key,
    however many rows the key has.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for frame in frames:
            found = []
            for owner, *values in zip(frame[key], *(frame[c] for c in needs)):
                if owner != current:
                    current, state = owner, start()
                found.append(step(state, *values))
            yield frame.assign(**{out: found})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def upload_quota(uploads: DataFrame, key: str, order: list[str], at: str, window: int = 3600, most: int = 20) -> DataFrame:
    """Uploads plus ``allowed``: so many in a fixed window, which the first upload after the last window opens."""

    def step(state: dict, t) -> bool:
        if "opened" not in state or t >= state["opened"] + window:
            state |= {"opened": t, "used": 0}
        allowed = state["used"] < most
        state["used"] += allowed
        return bool(allowed)

    return _fold(uploads, key, order, [at], dict, step, "allowed", "boolean")


def provider_choice(calls: DataFrame, key: str, order: list[str], at: str, up: str, retry: float = 300.0) -> DataFrame:
    """Calls plus ``served_by``: the provider that answers, -1 if none does.

    ``up`` is the array of providers that would answer.  The provider that answered last
    is asked first, then those after it, then those before it; some time after the first
    provider was left, it is asked first again.
    """

    def step(state: dict, t, able) -> int:
        if state["active"] and t - state["left"] >= retry:
            state["active"] = 0
        turn = [*range(state["active"], len(able)), *range(state["active"])]
        chosen = next((i for i in turn if able[i]), -1)
        if chosen not in (-1, state["active"]):
            state |= {"active": chosen, "left": t if chosen else 0.0}
        return chosen

    return _fold(calls, key, order, [at, up], lambda: {"active": 0, "left": 0.0}, step, "served_by", "int")


def pause_counts(segments: DataFrame, key: str = "job_id") -> DataFrame:
    """Segments (job_id, kind, translation) -> how many of the translated kind are done and pending, as told on a pause."""
    wanted = F.col("kind") == "translate"
    done = F.coalesce("translation", F.lit("")) != ""
    return segments.groupBy(key).agg(F.count_if(wanted & done).alias("done"), F.count_if(wanted & ~done).alias("pending"))


def running_eta(job: Column, elapsed: Column, progress: Column) -> Column:
    """Time left of running jobs only."""
    from ..functions.scalars import eta_seconds

    return F.when(job == "running", eta_seconds(elapsed, progress))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: activity sessions of a key, by Spark's session windows."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")
