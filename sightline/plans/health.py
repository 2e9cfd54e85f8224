"""Queries on unusual hours and on the reputation of peers."""

from pyspark.sql import functions as F

from sightline.operators import anomalies, lifetime, peers, reputation
from sightline.plans.registry import query

KINDS = ["view", "click", "error", "signup", "purchase"]

HOURLY_SQL = f"""
WITH g AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM events),
n AS (SELECT unnest({KINDS}) AS metric_name),
c AS (SELECT date_trunc('hour', ts) AS hour, event_type AS metric_name, count(*) AS n FROM events GROUP BY 1, 2),
h AS (SELECT g.hour::TIMESTAMP AS hour, metric_name, coalesce(c.n, 0) AS value, isodow(g.hour) * 24 + hour(g.hour) AS w
  FROM g CROSS JOIN n LEFT JOIN c USING (hour, metric_name))"""


def hourly(t):
    return anomalies.hourly_counts(t.events, "ts", "event_type", KINDS)


@query("metric_anomalies", HOURLY_SQL + """,
u AS (SELECT metric_name, w, quantile_disc(value, 0.5) AS usual FROM h GROUP BY 1, 2),
k AS (SELECT h.*, usual FROM h JOIN u USING (metric_name, w)),
s AS (SELECT metric_name, w, quantile_disc(abs(value - usual), 0.5) AS spread FROM k GROUP BY 1, 2),
x AS (SELECT hour, metric_name, value, usual, spread, abs(value - usual) / greatest(spread * 1.4826::DOUBLE, 1.0::DOUBLE) AS score
  FROM k JOIN s USING (metric_name, w))
SELECT hour, metric_name, value, usual, spread, round(score, 6) AS score, score > 5 AS anomaly FROM x""")
def _(t):
    return anomalies.anomalies(hourly(t)).withColumn("score", F.round("score", 6))


@query("hour_distances", HOURLY_SQL + """,
p AS (SELECT hour, sum(value) FILTER (WHERE metric_name = 'view')::DOUBLE AS x, sum(value) FILTER (WHERE metric_name = 'error')::DOUBLE AS y
  FROM h GROUP BY hour),
m AS (SELECT avg(x) AS ax, avg(y) AS ay, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p)
SELECT hour, round((yy * (x - ax) ** 2 - 2 * xy * (x - ax) * (y - ay) + xx * (y - ay) ** 2) / (xx * yy - xy * xy), 6) AS distance
FROM p, m""")
def _(t):
    return anomalies.distances(hourly(t), ["view", "error"]).withColumn("distance", F.round("distance", 6))


# not a decimal fraction: no average lies on the edge between two rounded values
RATE = 1 / 7

EMA_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, x::DOUBLE AS ema FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, (6.0::DOUBLE / 7) * r.ema + (1.0::DOUBLE / 7) * e.x FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)"""


@query("value_ema", EMA_SQL + "SELECT event_id, user_id, round(ema, 6) AS ema FROM r")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    made = reputation.moving_average(rows, "user_id", "ts", "value", RATE, tie="event_id", slice_seconds=86400)
    return made.select("event_id", "user_id", F.round("ema", 6).alias("ema"))


@query("peer_reputation", """
WITH RECURSIVE e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, value AS x,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, n, ok::INT::DOUBLE AS v FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, (6.0::DOUBLE / 7) * r.v + (1.0::DOUBLE / 7) * e.ok::INT FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
q AS (SELECT user_id, k, x::DOUBLE AS v FROM e WHERE ok AND k = 1
  UNION ALL SELECT e.user_id, e.k, (6.0::DOUBLE / 7) * q.v + (1.0::DOUBLE / 7) * e.x FROM q JOIN e ON e.user_id = q.user_id AND e.ok AND e.k = q.k + 1),
c AS (SELECT user_id, count(*) AS query_count, count(*) FILTER (WHERE NOT ok) AS fail_count, max(ts) FILTER (WHERE ok) AS last_response FROM e GROUP BY 1)
SELECT c.*, round((SELECT max_by(v, n) FROM r WHERE r.user_id = c.user_id), 6) AS success_ema,
  round((SELECT max_by(v, k) FROM q WHERE q.user_id = c.user_id), 6) AS rtt_ema FROM c""")
def _(t):
    log = t.events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"), "value")
    made = reputation.reputations(log, "user_id", "ts", "ok", "value", tie="event_id", rate=RATE, slice_seconds=86400)
    return made.withColumns({c: F.round(c, 6) for c in ("success_ema", "rtt_ema")})


LIVES_SQL = """
WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2),
l AS (SELECT event_type, a, epoch_us(b) - epoch_us(a) AS lived, TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR > b AS ended,
    epoch_us(TIMESTAMP '2024-01-31') - epoch_us(a) AS until FROM s),
c AS (SELECT event_type, date_trunc('week', a)::DATE AS week, CASE WHEN ended THEN lived ELSE until END // 3600000000 AS hour,
    count(*) FILTER (WHERE ended) AS ends, count(*) AS n FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type, week ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM c),
k AS (SELECT *, product(1 - ends / at_risk) OVER (PARTITION BY event_type, week ORDER BY hour ROWS UNBOUNDED PRECEDING) AS survival FROM r)
"""


def curves(t):
    """Pairs of user and event type as ids, by type and by the week in which they were first seen."""
    seen = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    lives = lifetime.lifetimes(seen, F.lit("2024-01-31").cast("timestamp"), 72)
    return lifetime.survival(
        lives.withColumn("week", F.date_trunc("week", "first_seen").cast("date")), ["event_type", "week"]
    )


@query("survival_curves", LIVES_SQL + """
SELECT event_type, week, hour, at_risk::BIGINT AS at_risk, ends, round(survival, 6) AS survival FROM k WHERE ends > 0""")
def _(t):
    return curves(t).withColumn("survival", F.round("survival", 6))


@query("median_lifetimes", LIVES_SQL + """
SELECT event_type, week, min(hour) FILTER (WHERE survival <= 0.5) AS median_hours FROM k WHERE ends > 0 GROUP BY 1, 2""")
def _(t):
    return lifetime.median_lifetime(curves(t), ["event_type", "week"])


@query("last_peers", """
WITH a AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS l_shipdate FROM lineitem
  WHERE l_returnflag <> 'R' AND l_shipdate >= DATE '1995-01-01' GROUP BY 1, 2)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_suppkey) <= 3""")
def _(t):
    """Suppliers as peers of a part; what was returned is no answer."""
    answers = t.lineitem.filter("l_returnflag <> 'R'").select("l_partkey", "l_suppkey", "l_shipdate")
    return peers.last_peers(answers, "l_partkey", "l_suppkey", "l_shipdate", 3, F.lit("1995-01-01").cast("date"))


LAST_USERS_SQL = """
WITH a AS (SELECT event_type, user_id, max(ts) AS ts FROM events WHERE value >= 50 GROUP BY 1, 2)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id) <= 8"""
