"""Queries on counters over time."""

from pyspark.sql import functions as F

from sightline.operators import jobs, metrics, outcomes, sightings
from sightline.plans.collection import sighting_events
from sightline.plans.registry import query
from sightline.plans.verification import QUEUE, number_of, order_jobs, order_jobs_sql
from sightline.vocab import SESSION_MARKER


def series(t):
    """Running count per event type and minute."""
    made = metrics.counter_series(t.events, "event_type", "ts")
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SERIES_SQL = """
WITH c AS (SELECT date_trunc('minute', ts) AS ts, event_type AS metric_name, count(*) AS n
           FROM events GROUP BY ALL),
s AS (SELECT ts, metric_name, (sum(n) OVER (PARTITION BY metric_name ORDER BY ts))::BIGINT AS metric_value FROM c)
"""


@query("metric_series", SERIES_SQL + "SELECT * FROM s")
def _(t):
    return series(t)


def with_marker(t):
    """The series plus a session marker two days after the first event."""
    start = t.events.agg(F.min("ts").alias("ts")).select(
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
        F.lit(SESSION_MARKER).alias("metric_name"), F.lit(0).cast("bigint").alias("metric_value"),
    )
    return series(t).unionByName(start)


SESSION_SQL = SERIES_SQL + """,
b AS (SELECT min(ts) + INTERVAL 2 DAY AS start FROM events),
m AS (SELECT s.* FROM s, b WHERE ts >= start)
"""


@query("metric_latest", SESSION_SQL + """
SELECT metric_name, max_by(metric_value, ts) AS current_value, max(ts) AS ts FROM m GROUP BY 1""")
def _(t):
    return metrics.latest_values(with_marker(t))


@query("metric_current", SESSION_SQL + """,
cur AS (SELECT metric_name, max_by(metric_value, ts) AS v, max(ts) AS ts FROM m GROUP BY 1),
prev AS (SELECT m.metric_name, max_by(m.metric_value, m.ts) AS v, max(m.ts) AS ts
         FROM m JOIN cur ON m.metric_name = cur.metric_name AND m.ts <= cur.ts - INTERVAL 1 HOUR GROUP BY 1),
j AS (SELECT c.metric_name, c.v AS current_value, c.ts, coalesce(p.v, 0) AS value_1h_ago,
        (epoch_us(c.ts) - epoch_us(p.ts)) / 3600000000.0 AS h FROM cur c LEFT JOIN prev p USING (metric_name))
SELECT metric_name, current_value, ts, value_1h_ago, round(h, 6) AS hours_elapsed,
       CASE WHEN h > 0 AND current_value >= value_1h_ago
            THEN round((current_value - value_1h_ago) / h, 6) END AS rate FROM j""")
def _(t):
    return metrics.current_values(with_marker(t)).withColumns({
        "hours_elapsed": F.round("hours_elapsed", 6), "rate": F.round("rate", 6),
    })


HOURS_SQL = SESSION_SQL + """,
h AS (SELECT metric_name, epoch_ms(date_trunc('hour', ts)) AS t, max_by(metric_value, ts) AS value
      FROM m GROUP BY ALL),
r AS (SELECT metric_name, t, value, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM h
      WINDOW w AS (PARTITION BY metric_name ORDER BY t)),
q AS (SELECT metric_name, t, CASE WHEN value >= v0 THEN (value - v0) / ((t - t0) / 3600000.0) END AS rate
      FROM r WHERE t0 IS NOT NULL)
"""


@query("metric_history", HOURS_SQL + "SELECT * FROM h")
def _(t):
    return metrics.history(with_marker(t), None, interval="hour")


@query("metric_history_range", SESSION_SQL + """
SELECT metric_name, epoch_ms(date_trunc('minute', ts)) AS t, max_by(metric_value, ts) AS value FROM m
WHERE metric_name = 'error' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:30:00'
GROUP BY ALL""")
def _(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return metrics.history(with_marker(t), "error", day("2024-01-10"), day("2024-01-12 06:30:00"))


@query("metric_rates", HOURS_SQL + "SELECT metric_name, t, round(rate, 6) AS rate FROM q")
def _(t):
    made = metrics.rates(metrics.history(with_marker(t), None, interval="hour"))
    return made.withColumn("rate", F.round("rate", 6))


@query("series_align", HOURS_SQL + """,
base AS (SELECT t FROM h WHERE metric_name = 'signup')
SELECT base.t,
  """ + ", ".join(
    f"max(CASE WHEN h.metric_name = '{m}' THEN floor(q.rate + 0.5)::BIGINT END) AS {m}, "
    f"max(CASE WHEN h.metric_name = '{m}' THEN h.value END) AS {m}_raw"
    for m in ("signup", "purchase", "error")
) + """
FROM base JOIN h USING (t) LEFT JOIN q ON q.t = h.t AND q.metric_name = h.metric_name
WHERE h.metric_name IN ('signup', 'purchase', 'error') GROUP BY base.t""")
def _(t):
    points = metrics.history(with_marker(t), None, interval="hour")
    return metrics.aligned_series(points, ["absent", "signup", "purchase", "error"]).drop(
        "absent", "absent_raw"
    )


AS_OF = "2024-01-30 12:00:00"


@query("stats_row", order_jobs_sql(QUEUE) + f""",
f AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
h AS (SELECT max(date_trunc('minute', ts)) AS ts FROM events)
SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS total_items,
  (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS verified_last_1h,
  (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS verified_last_24h,
  (SELECT count(*) FROM f WHERE b > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS seen_last_1h,
  (SELECT count(*) FROM f WHERE a > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS new_last_1h,
  (SELECT count(*) FROM j WHERE status IN ('pending', 'verifying', 'failed')) AS queue_backlog,
  (SELECT count(*) FROM j WHERE status = 'verifying') AS verifying,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS verified_total,
  h.ts AS heartbeat_ts,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(h.ts)) / 1e6)::BIGINT AS stale_s,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(h.ts)) / 1e6) > 180 AS is_stale
FROM h""")
def _(t):
    items = t.events.filter(F.col("event_type") == "purchase").select(F.col("ts").alias("verified_at"))
    return metrics.status_row(
        items, sightings.fold_sightings(sighting_events(t)), order_jobs(t, QUEUE), series(t),
        F.lit(AS_OF).cast("timestamp_ntz"),
    )


@query("session_numbers", """
SELECT event_id, (sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
  OVER (ORDER BY ts, event_type <> 'signup' ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM events""")
def _(t):
    rows = t.events.select(
        "event_id", "ts",
        F.when(F.col("event_type") == "signup", F.lit(SESSION_MARKER))
        .otherwise(F.col("event_type")).alias("metric_name"),
    )
    return metrics.number_sessions(rows).select("event_id", "session")


def daily_snapshot(t):
    """One wide row of order counts per day."""
    is_status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(
        is_status("F").alias("verify_success"), is_status("O").alias("verify_fail"),
        F.count(F.lit(1)).alias("verify_attempts"),
    )


SNAPSHOT_SQL = """
WITH d AS (SELECT o_orderdate AS ts, count(*) FILTER (WHERE o_orderstatus = 'F') AS verify_success,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS verify_fail, count(*) AS verify_attempts
  FROM orders GROUP BY 1)
"""


@query("snapshot_rows", SNAPSHOT_SQL + """
SELECT ts, unnest(['verify_success', 'verify_fail', 'verify_attempts']) AS metric_name,
       unnest([verify_success, verify_fail, verify_attempts]) AS metric_value FROM d""")
def _(t):
    return metrics.snapshot_to_rows(daily_snapshot(t))


@query("snapshot_upsert", """
SELECT ts, metric_name, max_by(v, p) AS metric_value FROM (
  SELECT o_orderdate AS ts, o_orderstatus AS metric_name, 0 AS p, count(*) AS v FROM orders GROUP BY ALL
  UNION ALL SELECT l_shipdate, l_linestatus, 1, count(*) FROM lineitem GROUP BY ALL) GROUP BY ts, metric_name""")
def _(t):
    def rows(table, ts, name):
        return table.groupBy(F.col(ts).alias("ts"), F.col(name).alias("metric_name")).agg(
            F.count(F.lit(1)).alias("metric_value")
        )

    return metrics.merge_snapshots(
        rows(t.orders, "o_orderdate", "o_orderstatus"), rows(t.lineitem, "l_shipdate", "l_linestatus")
    )


@query("tick_rates", SNAPSHOT_SQL + """
SELECT ts, round((verify_success - coalesce(lag(verify_success) OVER w, verify_success)) / 86400.0 * 3600, 6) AS verified_per_hour
FROM d WINDOW w AS (ORDER BY ts)""")
def _(t):
    made = metrics.tick_rates(daily_snapshot(t), ["verify_success"], 86400.0)
    return made.select("ts", F.round("verify_success_per_hour", 6).alias("verified_per_hour"))


def attempts(t):
    """Events as fetch attempts: the type picks the phase, the number in props the error."""
    errors = ["timeout", "io", "handshake", "no_extension", "reject", "bad_piece", "no_metadata"]
    k = number_of()
    return t.events.select(
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type").isin("view", "click"), "connect").otherwise("metadata").alias("phase"),
        F.when(F.col("event_type") != "purchase",
               F.element_at(F.array(*[F.lit(e) for e in errors]), F.pmod(k, F.lit(7)) + 1)).alias("error"),
    )


ATTEMPTS_SQL = """
WITH a AS (SELECT ts::DATE AS day, event_type IN ('view', 'click') AS c, CASE WHEN event_type <> 'purchase' THEN
  (['timeout', 'io', 'handshake', 'no_extension', 'reject', 'bad_piece', 'no_metadata'])
  [CAST(json_extract_string(props, '$.k') AS INT) % 7 + 1] END AS e FROM events),
n AS (SELECT {by} count(*) AS fetch_attempts,
  count(*) FILTER (WHERE c AND e = 'timeout') AS fetch_connect_timeout,
  count(*) FILTER (WHERE c AND e <> 'timeout') AS fetch_connect_io,
  count(*) FILTER (WHERE NOT c AND e IN ('timeout', 'io')) AS fetch_io,
  count(*) FILTER (WHERE NOT c AND e = 'handshake') AS fetch_handshake,
  count(*) FILTER (WHERE NOT c AND e = 'no_extension') AS fetch_no_extension,
  count(*) FILTER (WHERE NOT c AND e = 'reject') AS fetch_reject,
  count(*) FILTER (WHERE NOT c AND e = 'bad_piece') AS fetch_bad_piece,
  count(*) FILTER (WHERE e = 'timeout') AS verify_timeouts FROM a {group})
"""


@query("attempt_counters", ATTEMPTS_SQL.format(by="day,", group="GROUP BY day") + "SELECT * FROM n")
def _(t):
    return outcomes.count_attempts(attempts(t), ["day"])


@query("failure_breakdown", ATTEMPTS_SQL.format(by="", group="") + """
SELECT * FROM (SELECT unnest(range(10))::INT AS position,
  unnest(['Source timeout', 'Source no peers', 'Connect timeout', 'Connect I/O', 'Handshake', 'No extension',
          'Reject', 'Bad piece', 'Transfer I/O', 'SHA1 mismatch']) AS label,
  unnest(['source_timeout', 'source_no_peers', 'fetch_connect_timeout', 'fetch_connect_io', 'fetch_handshake',
          'fetch_no_extension', 'fetch_reject', 'fetch_bad_piece', 'fetch_io', 'sha1_mismatch']) AS metric_name,
  unnest([NULL, NULL, fetch_connect_timeout, fetch_connect_io, fetch_handshake, fetch_no_extension,
          fetch_reject, fetch_bad_piece, fetch_io, NULL]) AS value FROM n)""")
def _(t):
    wide = outcomes.count_attempts(attempts(t)).withColumn("ts", F.lit(AS_OF).cast("timestamp_ntz"))
    rows = metrics.snapshot_to_rows(wide).withColumnRenamed("metric_value", "current_value")
    return metrics.failure_breakdown(rows)


@query("verify_counters", """
WITH o AS (SELECT ts::DATE AS day, event_type = 'purchase' AS win,
    (['sha1_mismatch', 'no_peers', 'source_timeout', 'no_metadata'])[CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] AS e
  FROM events WHERE event_type IN ('error', 'purchase'))
SELECT day, count(*) AS verify_attempts, count(*) FILTER (WHERE win) AS verify_success,
  count(*) FILTER (WHERE NOT win) AS verify_fail,
  count(*) FILTER (WHERE NOT win AND e = 'sha1_mismatch') AS sha1_mismatch,
  count(*) FILTER (WHERE NOT win AND e = 'no_peers') AS source_no_peers,
  count(*) FILTER (WHERE NOT win AND e = 'source_timeout') AS source_all_timeout
FROM o GROUP BY day""")
def _(t):
    from sightline.plans.verification import outcomes as outcome_log

    log = outcome_log(t).withColumn("day", F.to_date("ts"))
    return outcomes.count_verifications(log, ["day"])


def message_log(t):
    kinds = {"view": "get_peers", "click": "find_node", "signup": "announce_peer", "purchase": "ping"}
    kind = F.lit(None).cast("string")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, F.lit(name)).otherwise(kind)
    k = F.pmod(number_of(), F.lit(3))
    return t.events.select(
        F.to_date("ts").alias("day"), kind.alias("kind"),
        F.when(k == 1, "bep42").when(k == 2, "random").alias("pool"),
        (F.col("value") > 50).alias("token_ok"),
    )


MESSAGES_SQL = """
WITH l AS (SELECT ts::DATE AS day, event_type AS e, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS k,
  value > 50 AS ok FROM events)
"""


@query("message_counters", MESSAGES_SQL + """
SELECT day, count(*) FILTER (WHERE e = 'purchase') AS inbound_ping,
  count(*) FILTER (WHERE e = 'click') AS inbound_find_node,
  count(*) FILTER (WHERE e = 'view') AS inbound_get_peers,
  count(*) FILTER (WHERE e = 'signup') AS inbound_announce_peer,
  count(*) FILTER (WHERE e = 'error') AS inbound_invalid,
  count(*) FILTER (WHERE e = 'click' AND k = 1) AS inbound_find_node_bep42,
  count(*) FILTER (WHERE e = 'click' AND k = 2) AS inbound_find_node_random,
  count(*) FILTER (WHERE e = 'view' AND k = 1) AS inbound_get_peers_bep42,
  count(*) FILTER (WHERE e = 'view' AND k = 2) AS inbound_get_peers_random,
  count(*) FILTER (WHERE e = 'signup' AND k = 1) AS inbound_announce_bep42,
  count(*) FILTER (WHERE e = 'signup' AND k = 2) AS inbound_announce_random,
  count(*) FILTER (WHERE e = 'signup' AND k > 0 AND NOT ok) AS inbound_announce_invalid_token,
  count(*) FILTER (WHERE e = 'view' AND k > 0) AS tokens_issued
FROM l GROUP BY day""")
def _(t):
    return outcomes.count_messages(message_log(t), ["day"])


@query("pool_share", MESSAGES_SQL + """
SELECT day, round(CASE WHEN count(*) FILTER (WHERE e = 'view' AND k > 0) = 0 THEN 0
  ELSE count(*) FILTER (WHERE e = 'view' AND k = 2) * 100.0 / count(*) FILTER (WHERE e = 'view' AND k > 0) END, 6) AS random_share
FROM l GROUP BY day""")
def _(t):
    counted = outcomes.count_messages(message_log(t), ["day"])
    share = metrics.share_percent(
        F.col("inbound_get_peers_random"), F.col("inbound_get_peers_bep42")
    )
    return counted.select("day", F.round(share, 6).alias("random_share"))


@query("stage_funnel", """
WITH g AS (SELECT event_type, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER
  (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events
  WHERE ('0x' || substr(sha1(user_id::VARCHAR), 1, 4))::BIGINT / 65536.0 < 0.5)
SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS n_ids,
       quantile_disc(us / 1000000.0, 0.5) AS median_gap_s FROM g GROUP BY 1""")
def _(t):
    stages = t.events.select(
        F.unhex(F.sha1(F.col("user_id").cast("string"))).alias("infohash"),
        F.col("event_type").alias("stage"), "ts", "event_id",
    )
    return outcomes.stage_funnel(stages, "infohash", "stage", ["ts", "event_id"], sample_rate=0.5)
