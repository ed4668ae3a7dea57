"""Registered queries of the views with state. Events come in three batches: most of the first half of
the month, then four days, then the rest with rows that are late, by less than the watermark's delay
or by more."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.plans.catalog import query, r6, run_dir
from newswake.plans.views import table
from newswake.streaming import stateful as st, sync

FILES = 2
ROWS_A_FILE = 100_000
DELAY = "10 days"


def arriving(spark: SparkSession, sf: str, out: str) -> DataFrame:
    """The events as a stream of three batches of as many files each: FILES, and as many more as leave
    ROWS_A_FILE rows to those of the smallest batch, so no task's work grows with the table."""
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", at.alias("ts"))
    late = (F.col("event_id") % 7 == 0) & (F.col("ts") < day(20)) & ((F.col("ts") < day(4)) | (F.col("ts") >= day(12)))
    batch = F.when(late, 2).when(F.col("ts") < day(16), 0).when(F.col("ts") < day(20), 1).otherwise(2)
    least = min(events.agg(*[F.count_if(batch == n) for n in range(3)]).first())
    files = max(FILES, least // ROWS_A_FILE)
    for n in range(3):
        events.filter(batch == n).repartition(files).write.parquet(f"{out}/batch={n}")
    return sync.article_stream(spark, f"{out}/batch=*", spark.read.parquet(f"{out}/batch=0").schema, files_per_batch=files)


#: what is not too late, and up to where results are settled
KEPT_SQL = """
kept AS (
  SELECT event_id, user_id, event_type, value, date_trunc('second', ts) AS ts FROM events
  WHERE NOT (event_id % 7 = 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-04')),
settled AS (SELECT max(ts) - INTERVAL 10 DAY AS until FROM kept)"""


@query("stream_sessions", f"""
WITH {KEPT_SQL},
marked AS (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new
  FROM kept),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
g AS (SELECT user_id, s, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*) AS n, sum(value) AS total
      FROM numbered GROUP BY 1, 2)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end,
       n, round(total, 4) AS total FROM g, settled WHERE b <= until""")
def stream_sessions(spark, sf):
    out = run_dir(spark, "sessions")
    st.append_to(st.sessions(arriving(spark, sf, out), "user_id", "ts", "value", "2 hours", DELAY),
                 f"{out}-found", f"{out}-state")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    found = spark.read.parquet(f"{out}-found")
    return r6(found.select("user_id", stamp("session_start"), stamp("session_end"), "n", "total"), "total", digits=4)


@query("stream_throttled", f"""
WITH RECURSIVE {KEPT_SQL},
numbered AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM kept),
walk AS (
  SELECT user_id, event_id, ts, n, ts AS last, true AS passed FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.user_id, b.event_id, b.ts, b.n, CASE WHEN b.ts >= w.last + INTERVAL 12 HOUR THEN b.ts ELSE w.last END,
    b.ts >= w.last + INTERVAL 12 HOUR
  FROM walk w JOIN numbered b ON b.user_id = w.user_id AND b.n = w.n + 1)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM walk, settled WHERE passed AND ts <= until""")
def stream_throttled(spark, sf):
    out = run_dir(spark, "throttled")
    alerts = st.throttled(arriving(spark, sf, out), "user_id", "event_id", "ts", timedelta(hours=12), DELAY)
    st.append_to(alerts, f"{out}-found", f"{out}-state")
    return spark.read.parquet(f"{out}-found").select(
        "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("stream_followed", f"""
WITH {KEPT_SQL.split(',' + chr(10) + 'settled')[0]},
c AS (SELECT user_id, event_id AS click_id, ts AS clicked FROM kept WHERE event_type = 'click'),
p AS (SELECT user_id, event_id AS purchase_id, ts AS bought FROM kept WHERE event_type = 'purchase'),
j AS (SELECT c.user_id, click_id, clicked, purchase_id FROM c LEFT JOIN p
      ON c.user_id = p.user_id AND bought >= clicked AND bought <= clicked + INTERVAL 6 HOUR)
SELECT user_id, click_id, purchase_id FROM j WHERE purchase_id IS NOT NULL OR clicked + INTERVAL 6 HOUR
  < least((SELECT max(clicked) FROM c), (SELECT max(bought) FROM p)) - INTERVAL 10 DAY""")
def stream_followed(spark, sf):
    """Purchases within six hours of a click; clicks without one when none can come any more."""
    out = run_dir(spark, "followed")
    events = arriving(spark, sf, out)
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    joined = st.followed(clicks, bought, "user_id", "clicked", "bought", "6 HOURS", DELAY)
    st.append_to(joined, f"{out}-found", f"{out}-state")
    return spark.read.parquet(f"{out}-found").select("user_id", "click_id", "purchase_id")
