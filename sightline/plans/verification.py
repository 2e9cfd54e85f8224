"""Queries on the verification queue, suppression, replies and throttling."""

from pyspark.sql import functions as F

from sightline.operators import jobs, peers, throttle
from sightline.plans.registry import query
from sightline.vocab import JOB_ERRORS


def number_of(props="props"):
    return F.get_json_object(props, "$.k").cast("int")


def outcomes(t):
    """Errors are failures, purchases successes; the number in props picks the error name."""
    names = F.array(*[F.lit(e) for e in JOB_ERRORS])
    return t.events.filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("infohash"),
        F.when(F.col("event_type") == "purchase", "verified").otherwise("failed").alias("outcome"),
        F.when(
            F.col("event_type") == "error",
            F.element_at(names, F.pmod(number_of(), F.lit(len(JOB_ERRORS))) + 1),
        ).alias("error"),
        "ts", "event_id",
    )


OUTCOMES_SQL = """
WITH o AS (SELECT user_id AS infohash, event_type = 'purchase' AS win, ts, event_id,
    CASE WHEN event_type = 'error' THEN (['sha1_mismatch', 'no_peers', 'source_timeout', 'no_metadata'])
      [CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] END AS error
  FROM events WHERE event_type IN ('error', 'purchase'))
"""

FOLD_SQL = OUTCOMES_SQL + """,
w AS (SELECT infohash, max(ts) AS last_win FROM o WHERE win GROUP BY 1),
f AS (SELECT o.* FROM o LEFT JOIN w USING (infohash)
      WHERE NOT win AND (last_win IS NULL OR ts > last_win)),
a AS (SELECT infohash, count(*) AS n, max(ts) AS t, max_by(error, ts) AS e FROM f GROUP BY 1),
j AS (SELECT infohash, CASE WHEN {dead} THEN 'dead' ELSE 'failed' END AS status,
      n::INT AS retry_count,
      CASE WHEN NOT ({dead}) THEN t + to_seconds({delay}) END AS next_retry_at,
      e AS last_error, t AS updated_at FROM a)
"""
EXPONENTIAL = FOLD_SQL.format(
    dead="n >= 4 OR (e = 'no_peers' AND n >= 2)", delay="(60 * pow(2, n - 1))::BIGINT"
)
BY_TABLE = FOLD_SQL.format(dead="n >= 4", delay="([60, 300, 1800, 7200, 43200])[n]")


@query("job_fold", EXPONENTIAL + "SELECT * FROM j")
def _(t):
    return jobs.fold_outcomes(outcomes(t))


@query("job_fold_table_schedule", BY_TABLE + "SELECT * FROM j")
def _(t):
    return jobs.fold_outcomes(outcomes(t), schedule="table")


@query("attempt_numbers", OUTCOMES_SQL + """,
g AS (SELECT *, coalesce(sum(win::INT) OVER (PARTITION BY infohash ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM o)
SELECT infohash, event_id, ts, row_number() OVER (PARTITION BY infohash, grp ORDER BY ts, event_id) AS attempt
FROM g""")
def _(t):
    return jobs.number_attempts(outcomes(t), "infohash", ["ts", "event_id"]).select(
        "infohash", "event_id", "ts", "attempt"
    )


def order_jobs(t, states):
    """Orders as job rows: status by letter, retry count by priority, times by order date."""
    status = F.lit(None).cast("string")
    for letter, state in states.items():
        status = F.when(F.col("o_orderstatus") == letter, F.lit(state)).otherwise(status)
    date = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("infohash"),
        status.alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("retry_count"),
        F.when(F.col("o_totalprice") > 20000, date).alias("next_retry_at"),
        F.lit(None).cast("string").alias("last_error"),
        date.alias("updated_at"),
    )


def order_jobs_sql(states):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in states.items())
    return f"""
WITH j AS (SELECT o_orderkey AS infohash, CASE o_orderstatus {cases} END AS status,
    substr(o_orderpriority, 1, 1)::INT - 1 AS retry_count,
    CASE WHEN o_totalprice > 20000 THEN o_orderdate END AS next_retry_at,
    NULL::VARCHAR AS last_error, o_orderdate AS updated_at FROM orders)
"""


QUEUE = {"F": "failed", "O": "pending", "P": "verifying"}
ENDED = {"F": "dead", "O": "verified", "P": "failed"}
NOON = "1997-06-15 12:00:00"


def at(text=NOON):
    return F.lit(text).cast("timestamp_ntz")


CLAIM_SQL = order_jobs_sql(QUEUE) + f""",
fresh AS (SELECT infohash, retry_count FROM j WHERE status = 'pending'
          ORDER BY next_retry_at NULLS FIRST, infohash LIMIT 700),
retries AS (SELECT infohash, retry_count FROM j
            WHERE status = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOON}')
              AND retry_count < 4
            ORDER BY retry_count, next_retry_at NULLS LAST, infohash LIMIT 300),
c AS (SELECT * FROM fresh UNION SELECT * FROM retries)
"""


@query("claim_due", CLAIM_SQL + "SELECT infohash, retry_count FROM c")
def _(t):
    return jobs.claim_due(order_jobs(t, QUEUE), at(), 1000)


@query("mark_claimed", CLAIM_SQL + f"""
SELECT j.infohash, CASE WHEN c.infohash IS NULL THEN j.status ELSE 'verifying' END AS status,
       j.retry_count, j.next_retry_at, j.last_error,
       CASE WHEN c.infohash IS NULL THEN j.updated_at ELSE TIMESTAMP '{NOON}' END AS updated_at
FROM j LEFT JOIN c USING (infohash)""")
def _(t):
    table = order_jobs(t, QUEUE)
    return jobs.mark_claimed(table, jobs.claim_due(table, at(), 1000), at())


@query("due_jobs", order_jobs_sql(QUEUE) + f"""
SELECT infohash FROM j WHERE status = 'failed' AND retry_count < 4
  AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOON}')""")
def _(t):
    return order_jobs(t, QUEUE).filter(jobs.is_due(at())).select("infohash")


@query("stale_recovery", order_jobs_sql(QUEUE) + f"""
SELECT infohash, CASE WHEN stale THEN 'pending' ELSE status END AS status, retry_count,
       CASE WHEN stale THEN TIMESTAMP '{NOON}' ELSE next_retry_at END AS next_retry_at, last_error,
       CASE WHEN stale THEN TIMESTAMP '{NOON}' ELSE updated_at END AS updated_at
FROM (SELECT *, status = 'verifying'
        AND updated_at < TIMESTAMP '{NOON}' - INTERVAL 5 MINUTE AS stale FROM j)""")
def _(t):
    return jobs.recover_stale(order_jobs(t, QUEUE), at())


@query("retention", order_jobs_sql(ENDED) + f"""
SELECT * FROM j WHERE NOT ((status = 'dead' AND updated_at < TIMESTAMP '{NOON}' - INTERVAL 1 DAY)
  OR (status = 'verified' AND updated_at < TIMESTAMP '{NOON}' - INTERVAL 1 HOUR))""")
def _(t):
    return jobs.retain(order_jobs(t, ENDED), at())


@query("retry_lookup", order_jobs_sql(QUEUE) + """
SELECT l_orderkey AS infohash, l_linenumber, coalesce(retry_count, 0) AS retry_count
FROM lineitem LEFT JOIN (SELECT * FROM j WHERE status = 'failed') f ON l_orderkey = f.infohash""")
def _(t):
    ids = t.lineitem.select(F.col("l_orderkey").alias("infohash"), "l_linenumber")
    return jobs.retry_counts(ids, order_jobs(t, QUEUE).filter(F.col("status") == "failed"))


@query("remove_verified", order_jobs_sql(QUEUE) + """
SELECT infohash, status FROM j
WHERE infohash NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    done = t.lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("infohash")
    )
    return jobs.remove_verified(order_jobs(t, QUEUE), done).select("infohash", "status")


@query("add_missing_jobs", order_jobs_sql(QUEUE) + f"""
SELECT infohash, status, retry_count, next_retry_at FROM j WHERE status <> 'pending'
UNION ALL
SELECT o_orderkey, 'pending', 0, TIMESTAMP '{NOON}' FROM orders WHERE o_orderstatus = 'O'""")
def _(t):
    table = order_jobs(t, QUEUE)
    legacy = t.lineitem.select(F.col("l_orderkey").alias("infohash")).unionByName(
        table.select("infohash")
    )
    known = table.filter(F.col("status") != "pending")
    ids = legacy.join(table.select("infohash"), "infohash", "left_semi")
    return jobs.add_missing_jobs(known, ids, "pending", at()).select(
        "infohash", "status", "retry_count", "next_retry_at"
    )


@query("queue_counts", order_jobs_sql(QUEUE) + """
SELECT count(*) FILTER (WHERE status IN ('pending', 'verifying', 'failed')) AS queue_backlog,
       count(*) FILTER (WHERE status = 'verifying') AS verifying FROM j""")
def _(t):
    return jobs.queue_counts(order_jobs(t, QUEUE))


@query("negative_cache", """
SELECT event_id, user_id, ts FROM events v WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = v.user_id
    AND b.ts <= v.ts AND v.ts < b.ts + INTERVAL 1 DAY)""")
def _(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    checks = events.filter(F.col("event_type") == "view").drop("event_type")
    bad = events.filter(F.col("event_type") == "error").drop("event_type")
    return peers.suppress_bad(checks, bad, "user_id", "ts", 86400, tie="event_id")


# the log of a user walked event by event; a view is a request, a click a reply
REPLIES_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, event_type = 'view' AS asks,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT user_id, n, event_id, ts, asks, CASE WHEN asks THEN ts END AS open_ts, CASE WHEN asks THEN event_id END AS open_id,
    false AS refused, NULL::BIGINT AS answers FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, e.ts, e.asks,
    CASE WHEN e.asks AND live THEN x.open_ts WHEN e.asks THEN e.ts END,
    CASE WHEN e.asks AND live THEN x.open_id WHEN e.asks THEN e.event_id END,
    e.asks AND live, CASE WHEN live AND NOT e.asks THEN x.open_id END
  FROM r x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1,
  LATERAL (SELECT coalesce(e.ts <= x.open_ts + INTERVAL 6 HOUR, false) AS live) l)
SELECT q.event_id, q.user_id, q.ts, a.ts AS reply_ts,
  CASE WHEN q.refused THEN 'refused' WHEN a.ts IS NULL THEN 'timeout' ELSE 'answered' END AS outcome
FROM r q LEFT JOIN r a ON a.answers = q.event_id AND a.user_id = q.user_id WHERE q.asks"""


@query("request_response", REPLIES_SQL)
def _(t):
    def of(kind):
        return t.events.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")

    return peers.match_replies(of("view"), of("click"), "user_id", "ts", 6 * 3600, tie="event_id")


# whole units: a token is 36 000 000 000 of them, a microsecond adds one, a bucket holds three tokens
THROTTLE_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, ts, us, 72000000000 AS units, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, e.ts, e.us, CASE WHEN f >= 36000000000 THEN f - 36000000000 ELSE f END, f >= 36000000000
  FROM r x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1,
  LATERAL (SELECT CASE WHEN e.us - x.us > 86400000000 THEN 108000000000
    ELSE least(108000000000, x.units + e.us - x.us) END AS f) l)
SELECT event_id, user_id, ts, allowed FROM r"""


@query("rate_limit", THROTTLE_SQL)
def _(t):
    hits = t.events.select("event_id", "user_id", "ts")
    return throttle.rate_limit(hits, "user_id", "ts", rate=1 / 36000, burst=3, tie="event_id",
                               idle_seconds=86400)
