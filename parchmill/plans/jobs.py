"""Queries over the job log: limits, cooldowns, stalls, quotas, progress, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.text import eta_text
from ..operators import jobs, scans
from . import register, table
from .overlays import JOBS_SQL, job_log

ORDER = ["at", "event_id"]
SECOND = 1_000_000


@register(f"""
    WITH RECURSIVE {JOBS_SQL},
    r AS (SELECT owner, n, event_id, ts_us AS slot FROM jn WHERE n = 1
        UNION ALL SELECT j.owner, j.n, j.event_id, greatest(j.ts_us, r.slot + 7200000000) FROM r JOIN jn j ON j.owner = r.owner AND j.n = r.n + 1)
    SELECT owner, event_id, slot::BIGINT AS slot FROM r""")
def rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots two hours apart for each owner's calls; the SQL side steps from call to call."""
    return jobs.rate_slots(job_log(spark, sf_dir), "owner", ORDER, "at", 7200 * SECOND).select("owner", "event_id", "slot")


@register(f"""
    WITH RECURSIVE {JOBS_SQL},
    s AS (SELECT *, CASE WHEN retry_after % 2 = 0 THEN retry_after ELSE 0 END AS header FROM jn),
    r AS (SELECT owner, n, event_id, CASE WHEN outcome = 'refused' THEN least(CASE WHEN header > 0 THEN header::DOUBLE ELSE 15.0 END, 120.0) END AS cooldown,
            CASE WHEN outcome = 'refused' THEN 30.0 ELSE 15.0 END::DOUBLE AS penalty FROM s WHERE n = 1
        UNION ALL SELECT s.owner, s.n, s.event_id, CASE WHEN s.outcome = 'refused' THEN least(CASE WHEN s.header > 0 THEN s.header::DOUBLE ELSE r.penalty END, 120.0) END,
            CASE WHEN s.outcome = 'refused' THEN least(r.penalty * 2, 120.0) WHEN s.outcome = 'success' THEN 15.0 ELSE r.penalty END FROM r JOIN s ON s.owner = r.owner AND s.n = r.n + 1)
    SELECT owner, event_id, cooldown FROM r WHERE cooldown IS NOT NULL""")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = job_log(spark, sf_dir).withColumn("header", F.when(F.col("retry_after") % 2 == 0, F.col("retry_after")).otherwise(F.lit(0))).withColumn("seconds", F.col("at") / SECOND)
    gated = jobs.cooldowns(calls, "owner", ORDER, "seconds", "outcome", "header")
    return gated.where("cooldown is not null").select("owner", "event_id", "cooldown")


@register(f"""
    WITH {JOBS_SQL} SELECT owner, ts_us AS resumed_at, ts_us - before AS idle FROM (SELECT *, lag(ts_us) OVER (PARTITION BY owner ORDER BY ts_us, event_id) AS before FROM jl) WHERE ts_us - before >= 43200000000""")
def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stalls(job_log(spark, sf_dir), "owner", ORDER, "at", 43200 * SECOND).select("owner", "resumed_at", "idle")


@register(f"""
    WITH {JOBS_SQL} SELECT owner, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY owner ORDER BY ts_us, event_id) AS before FROM jn) WHERE event_type IS DISTINCT FROM before AND n <= 1800""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.changes(job_log(spark, sf_dir), "owner", ORDER, "event_type").select("owner", "event_id")


@register(f"""
    WITH RECURSIVE {JOBS_SQL}, u AS (SELECT owner, event_id, ts_us, row_number() OVER (PARTITION BY owner ORDER BY ts_us, event_id) AS n FROM jl WHERE event_type = 'signup'),
    r AS (SELECT owner, n, event_id, ts_us AS opened, 1 AS used, true AS allowed FROM u WHERE n = 1
        UNION ALL SELECT u.owner, u.n, u.event_id, CASE WHEN u.ts_us >= r.opened + 864000000000 THEN u.ts_us ELSE r.opened END,
            CASE WHEN u.ts_us >= r.opened + 864000000000 THEN 1 WHEN r.used < 3 THEN r.used + 1 ELSE r.used END, u.ts_us >= r.opened + 864000000000 OR r.used < 3 FROM r JOIN u ON u.owner = r.owner AND u.n = r.n + 1)
    SELECT owner, event_id, allowed FROM r""")
def upload_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three uploads in ten days; the SQL side steps from upload to upload."""
    uploads = job_log(spark, sf_dir).where("event_type = 'signup'").select("owner", "event_id", "at")
    return jobs.upload_quota(uploads, "owner", ORDER, "at", 864000 * SECOND, 3).select("owner", "event_id", "allowed")


@register(f"""
    WITH RECURSIVE {JOBS_SQL}, s AS (SELECT *, [retry_after % 3 <> 0, retry_after % 5 <> 0, retry_after % 7 <> 0] AS up FROM jn),
    c AS (SELECT *, list_filter([1, 2, 3], lambda i: up[i]) AS able FROM s),
    r AS (SELECT owner, n, event_id, CASE WHEN len(able) = 0 THEN -1 ELSE able[1] - 1 END AS served, CASE WHEN len(able) = 0 THEN 0 ELSE able[1] - 1 END AS active, CASE WHEN len(able) > 0 AND able[1] > 1 THEN ts_us ELSE 0 END AS left_at FROM c WHERE n = 1
        UNION ALL SELECT owner, n, event_id, served, CASE WHEN served < 0 THEN start ELSE served END, CASE WHEN served < 0 OR served = start THEN left_at WHEN served > 0 THEN ts_us ELSE 0 END FROM (
            SELECT *, CASE WHEN len(able) = 0 THEN -1 ELSE coalesce(list_min(list_filter(able, lambda i: i - 1 >= start)), list_min(able)) - 1 END AS served FROM (
            SELECT c.owner, c.n, c.event_id, c.ts_us, c.able, r.left_at, CASE WHEN r.active > 0 AND c.ts_us - r.left_at >= 18000000000 THEN 0 ELSE r.active END AS start FROM r JOIN c ON c.owner = r.owner AND c.n = r.n + 1)))
    SELECT owner, event_id, served::INT AS served_by FROM r""")
def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers of which some are down; the first is tried again after five hours."""
    k = F.col("retry_after")
    calls = job_log(spark, sf_dir).select("owner", "event_id", "at", F.array(k % 3 != 0, k % 5 != 0, k % 7 != 0).alias("up"))
    return jobs.provider_choice(calls, "owner", ORDER, "at", "up", 18000 * SECOND).select("owner", "event_id", "served_by")


@register("""
    WITH s(position, key, raw) AS (VALUES (0, 'parse', 28.0::DOUBLE), (1, 'split', 1.0), (3, 'translate', 42.0), (4, 'assemble', 1.0), (6, 'review', 8.0), (12, 'export', 10.0), (14, 'learn', 1.0)),
    w AS (SELECT position, key, raw / sum(raw) OVER () AS weight FROM s)
    SELECT position::INT AS position, key, round(weight, 6) AS weight, round(coalesce(sum(weight) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS start FROM w""")
def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = jobs.stage_plan(spark, {"review", "export", "learn"})
    return plan.select("position", "key", F.round("weight", 6).alias("weight"), F.round("start", 6).alias("start"))


@register(f"""
    WITH {JOBS_SQL}, p AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'parse' WHEN 'click' THEN 'translate' WHEN 'signup' THEN 'learn' ELSE 'unknown' END AS stage, (retry_after - 10) / 80.0 AS fraction FROM jl),
    c AS (SELECT event_id, stage, greatest(0.0, least(1.0, fraction)) AS f FROM p)
    SELECT event_id, round(CASE stage WHEN 'parse' THEN f * 28 / 91 WHEN 'translate' THEN 29.0 / 91 + f * 42 / 91 WHEN 'learn' THEN 90.0 / 91 + f / 91 ELSE f END, 6) AS progress FROM c""")
def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = jobs.stage_plan(spark, {"review", "export", "learn"})
    stage = F.when(F.col("event_type") == "view", "parse").when(F.col("event_type") == "click", "translate").when(F.col("event_type") == "signup", "learn").otherwise("unknown")
    ticks = job_log(spark, sf_dir).select("event_id", stage.alias("stage"), ((F.col("retry_after") - 10) / 80.0).alias("fraction"))
    return jobs.overall_progress(ticks, plan).select("event_id", F.round("progress", 6).alias("progress"))


@register(f"""
    WITH {JOBS_SQL}, e AS (SELECT event_id, CASE WHEN event_type <> 'error' AND retry_after >= 3 AND retry_after < 100 THEN event_id % 10000 * (1 - retry_after / 100.0) / (retry_after / 100.0) END AS s FROM jl)
    SELECT event_id, round(s, 4) AS eta, CASE WHEN s IS NULL THEN NULL WHEN s < 45 THEN 'меньше минуты' WHEN floor(s / 60 + 0.5) < 60 THEN '~' || floor(s / 60 + 0.5)::BIGINT || ' мин'
        WHEN floor(s / 60 + 0.5)::BIGINT % 60 > 0 THEN '~' || floor(s / 60 + 0.5)::BIGINT // 60 || ' ч ' || floor(s / 60 + 0.5)::BIGINT % 60 || ' мин' ELSE '~' || floor(s / 60 + 0.5)::BIGINT // 60 || ' ч' END AS said FROM e""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") != "error", "running").otherwise("failed")
    left = jobs.running_eta(status, F.col("event_id") % 10000, F.col("retry_after") / 100.0)
    return job_log(spark, sf_dir).select("event_id", left.alias("s")).select("event_id", F.round("s", 4).alias("eta"), eta_text(F.col("s")).alias("said"))


@register(f"""
    WITH {JOBS_SQL}
    SELECT owner, min(ts_us) AS created_at, max(ts_us) AS updated_at, arg_max(event_type, ts_us) AS status, arg_max(retry_after, ts_us) FILTER (event_type = 'error') AS error FROM jl GROUP BY owner""")
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = job_log(spark, sf_dir).select("owner", "at", F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.col("retry_after")).alias("error"))
    return jobs.latest(log, "owner", "at", ["status", "error"])


@register(f"WITH {JOBS_SQL} SELECT event_id AS job_id FROM jl WHERE owner = 7 ORDER BY ts_us DESC, event_id LIMIT 100")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = job_log(spark, sf_dir).select("owner", F.col("event_id").alias("job_id"), F.col("at").alias("created_at"))
    return jobs.newest(rows, 7, 100).select("job_id")


@register(f"WITH {JOBS_SQL} SELECT event_id, count(*) OVER ()::BIGINT AS total FROM jl WHERE owner = 7 AND outcome <> 'success' ORDER BY ts_us OFFSET 5 LIMIT 10")
def segments_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = job_log(spark, sf_dir).withColumn("ok", F.col("outcome") == "success").withColumnRenamed("owner", "job_id")
    return jobs.page(rows, 7, "at", 5, 10, only_failed=True).select("event_id", "total")


@register(f"""
    WITH {JOBS_SQL} SELECT owner, event_id, (row_number() OVER (PARTITION BY owner ORDER BY ts_us, event_id) - 1)::INT AS "order" FROM jl WHERE event_type = 'click'
    UNION ALL SELECT owner, event_id, -1 FROM jl WHERE event_type = 'view' AND owner NOT IN (SELECT owner FROM jl WHERE event_type = 'click')""")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = job_log(spark, sf_dir)
    old = log.where("event_type = 'view'").select("owner", "event_id", "at", F.lit(-1).alias("order"))
    new = log.where("event_type = 'click'").select("owner", "event_id", "at")
    return jobs.replace_children(old, new, "owner", ORDER).select("owner", "event_id", "order")


@register(f"WITH {JOBS_SQL} SELECT DISTINCT owner AS job_id FROM jl WHERE owner IN (SELECT owner FROM jl WHERE event_type = 'error' AND retry_after > 95)")
def pause_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = job_log(spark, sf_dir)
    requests = log.where("event_type = 'error'").select(F.col("owner").alias("job_id"), (F.col("retry_after") > 95).alias("pause_requested"))
    return jobs.pause_requested(log.select(F.col("owner").alias("job_id")).distinct(), requests)


@register("""
    SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'signup' THEN true END AS flag, CASE WHEN k BETWEEN 1 AND 64 THEN k END AS workers,
        CASE WHEN k % 4 > 0 THEN k % 4 WHEN k % 3 > 0 THEN k % 3 ELSE 99 END AS level, CASE WHEN k % 2 = 0 THEN 'docx' ELSE '' END AS unknown, substr(sha256(user_id::VARCHAR), 1, 24) AS tenant
    FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coercion and precedence of settings given as text."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    said = F.when(F.col("event_type") == "click", "Yes").when(F.col("event_type") == "view", "off").when(F.col("event_type") == "signup", "1").otherwise("maybe")
    formats = F.when(k % 2 == 0, F.lit("html, docx, ,pdf")).otherwise(F.lit("pdf"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        scalars.strict_flag(said).alias("flag"),
        scalars.strict_int(F.concat(F.lit(" "), k.cast("string")), 1, 64).alias("workers"),
        scalars.first_given(k % 4, k % 3, F.lit(99).cast("long")).alias("level"),
        F.array_join(scalars.unknown_formats(scalars.strict_list(formats), ("html", "pdf")), ",").alias("unknown"),
        scalars.tenant_key(F.col("user_id").cast("string")).alias("tenant"),
    )


@register("""
    SELECT event_id, least(power(2.0, event_id % 8), 30.0) AS delay, greatest(least(power(2.0, event_id % 8), 30.0), least((props->>'$.k')::DOUBLE, 60.0)) AS delay_asked, least(0.92, (event_id % 2000) / 1800.0) AS parse_share FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = (F.col("event_id") % 8).cast("double")
    asked = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    none = F.lit(None).cast("double")
    return table(spark, sf_dir, "events").select("event_id", scalars.retry_delay(attempt, none).alias("delay"), scalars.retry_delay(attempt, scalars.retry_after_seconds(asked)).alias("delay_asked"), scalars.parse_ticker(F.col("event_id") % 2000, F.lit(1800.0)).alias("parse_share"))


@register(f"""
    WITH {JOBS_SQL}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY owner ORDER BY ts_us, event_id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM jl),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY ts_us, event_id) AS n FROM g)
    SELECT owner, min(ts_us) AS start_us, count(*)::BIGINT AS n FROM s GROUP BY owner, s.n""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of activity with gaps under half an hour."""
    events = job_log(spark, sf_dir).withColumn("ts", F.timestamp_micros("at"))
    return jobs.sessions(events, "owner", "ts").select("owner", F.unix_micros("start").alias("start_us"), "n")


# one owner has the whole log: ranges of it are scanned apart
ALL_SQL = f"{JOBS_SQL}, al AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) AS i FROM jl)"


def _one_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_log(spark, sf_dir).withColumn("owner", F.lit(1))


@register(f"WITH {ALL_SQL} SELECT event_id, (i * 30000000 + max(ts_us - i * 30000000) OVER (ORDER BY i))::BIGINT AS slot FROM al")
def one_key_rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.rate_slots(_one_owner(spark, sf_dir), "owner", ORDER, "at", 30 * SECOND).select("event_id", "slot")


@register(f"""
    WITH {ALL_SQL}, s AS (SELECT *, CASE WHEN retry_after % 2 = 0 THEN retry_after ELSE 0 END AS header, sum((outcome = 'success')::INT) OVER (ORDER BY i) AS s FROM al),
    k AS (SELECT *, sum((outcome = 'refused')::INT) OVER (PARTITION BY s ORDER BY i) AS k FROM s),
    c AS (SELECT *, CASE WHEN outcome = 'refused' THEN least(CASE WHEN header > 0 THEN header::DOUBLE ELSE least(15.0::DOUBLE * power(2.0, least(k, 40) - 1), 120.0) END, 120.0) END AS cooldown FROM k)
    SELECT event_id, cooldown, round(max(ts_us / 1000000 + cooldown) OVER (ORDER BY i), 6) AS deadline FROM c""")
def one_key_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _one_owner(spark, sf_dir).withColumn("header", F.when(F.col("retry_after") % 2 == 0, F.col("retry_after")).otherwise(F.lit(0))).withColumn("seconds", F.col("at") / SECOND)
    return scans.cooldowns(calls, "owner", ORDER, "seconds", "outcome", "header").select("event_id", "cooldown", F.round("deadline", 6).alias("deadline"))


@register(f"WITH {ALL_SQL} SELECT ts_us AS resumed_at, idle FROM (SELECT *, ts_us - lag(ts_us) OVER (ORDER BY i) AS idle FROM al) WHERE idle >= 300000000")
def one_key_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.stalls(_one_owner(spark, sf_dir), "owner", ORDER, "at", 300 * SECOND).select("resumed_at", "idle")


@register(f"WITH {ALL_SQL} SELECT event_id FROM (SELECT *, lag(event_type) OVER (ORDER BY i) AS before FROM al) WHERE event_type IS DISTINCT FROM before")
def one_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.changes(_one_owner(spark, sf_dir), "owner", ORDER, "event_type", most=1 << 60).select("event_id")


@register(f"WITH {ALL_SQL} SELECT event_id, last_value(CASE WHEN outcome = 'refused' THEN retry_after END IGNORE NULLS) OVER (ORDER BY i) AS held FROM al")
def one_key_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _one_owner(spark, sf_dir).withColumn("held", F.when(F.col("outcome") == "refused", F.col("retry_after")))
    return scans.frozen(log, "owner", ORDER, "held").select("event_id", "held")


@register(f"""
    WITH RECURSIVE {ALL_SQL},
    r AS (SELECT i, event_id, ts_us AS opened, 1 AS used, true AS allowed FROM al WHERE i = 1
        UNION ALL SELECT a.i, a.event_id, CASE WHEN a.ts_us >= r.opened + 7200000000 THEN a.ts_us ELSE r.opened END,
            CASE WHEN a.ts_us >= r.opened + 7200000000 THEN 1 WHEN r.used < 20 THEN r.used + 1 ELSE r.used END, a.ts_us >= r.opened + 7200000000 OR r.used < 20 FROM r JOIN al a ON a.i = r.i + 1)
    SELECT event_id, allowed FROM r""")
def one_key_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events in two hours; the SQL side steps from event to event."""
    return scans.upload_quota(_one_owner(spark, sf_dir), "owner", ORDER, "at", 7200 * SECOND).select("event_id", "allowed")
