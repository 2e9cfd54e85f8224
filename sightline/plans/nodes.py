"""Queries on node tables: nearest ids, pools, buckets."""

from pyspark.sql import functions as F

from sightline.functions import ids
from sightline.operators import nodes
from sightline.plans.registry import query


def sha(column):
    return F.unhex(F.sha1(F.col(column).cast("string")))


def customer_nodes(t):
    return t.customer.select(sha("c_name").alias("id"), "c_custkey")


def supplier_targets(t):
    return t.supplier.select(sha("s_name").alias("target"))


# the first 60 bits decide here; whole ids are compared in the tests
NEAREST_SQL = """
WITH n AS (SELECT sha1({node}) AS id, ('0x' || substr(sha1({node}), 1, 15))::BIGINT AS w FROM {nodes}),
t AS (SELECT DISTINCT sha1({target}) AS target, ('0x' || substr(sha1({target}), 1, 15))::BIGINT AS w FROM {targets}),
r AS (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY xor(t.w, n.w)) AS rank FROM t, n
      QUALIFY rank <= {k})
"""


@query("xor_knn", NEAREST_SQL.format(
    node="c_name", nodes="customer", target="s_name", targets="supplier", k=8
) + "SELECT * FROM r")
def _(t):
    found = nodes.closest(customer_nodes(t), supplier_targets(t), 8)
    return found.select(
        ids.to_hex(F.col("target")).alias("target"), ids.to_hex(F.col("id")).alias("id"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("nearest_pool", NEAREST_SQL.format(
    node="s_name", nodes="supplier", target="c_name", targets="customer", k=1
) + """
SELECT r.target, CASE WHEN s_nationkey < 12 THEN 'bep42' ELSE 'random' END AS pool
FROM r JOIN supplier ON sha1(s_name) = r.id""")
def _(t):
    pool = F.when(F.col("s_nationkey") < 12, "bep42").otherwise("random")
    members = t.supplier.select(sha("s_name").alias("id"), pool.alias("pool"))
    targets = t.customer.select(sha("c_name").alias("target"))
    return nodes.nearest_pool(members, targets).withColumn("target", ids.to_hex(F.col("target")))


@query("merge_candidates", NEAREST_SQL.format(
    node="s", nodes="(SELECT p_name AS s FROM part UNION SELECT c_name FROM customer) x",
    target="n_name", targets="nation", k=12,
) + "SELECT * FROM r")
def _(t):
    old = t.part.select(sha("p_name").alias("id"))
    new = t.customer.select(sha("c_name").alias("id"))
    found = nodes.merge_candidates(old, new, t.nation.select(sha("n_name").alias("target")), 12)
    return found.select(
        ids.to_hex(F.col("target")).alias("target"), ids.to_hex(F.col("id")).alias("id"),
        F.col("rank").cast("bigint").alias("rank"),
    )


OWN = "own node"


@query("bucket_topk", f"""
WITH n AS (SELECT sha1(o_custkey::VARCHAR) AS id, min(o_orderkey) AS f, max_by(o_orderpriority, o_orderkey) AS addr
           FROM orders GROUP BY 1),
b AS (SELECT *, (159 - 60 + length(bin(xor(('0x' || substr(id, 1, 15))::BIGINT,
        ('0x' || substr(sha1('{OWN}'), 1, 15))::BIGINT))))::INT AS bucket FROM n)
SELECT bucket, id, addr, row_number() OVER (PARTITION BY bucket ORDER BY f DESC) AS rank FROM b
QUALIFY rank <= 8""")
def _(t):
    seen = t.orders.select(
        sha("o_custkey").alias("id"), F.col("o_orderkey").alias("seen_ts"),
        F.col("o_orderpriority").alias("addr"),
    )
    kept = nodes.latest_arrivals(seen, F.unhex(F.sha1(F.lit(OWN))), 8)
    return kept.select(
        "bucket", ids.to_hex(F.col("id")).alias("id"), "addr", F.col("rank").cast("bigint").alias("rank")
    )


@query("bucket_retention")
def _(t):
    seen = t.orders.select(
        sha("o_custkey").alias("id"), F.col("o_orderkey").alias("seen_ts"),
        F.col("o_orderpriority").alias("addr"),
    )
    kept = nodes.retain_buckets(
        seen, F.unhex(F.sha1(F.lit(OWN))), 8, slices=F.floor(F.col("seen_ts") / 5000)
    )
    return kept.withColumn("id", ids.to_hex(F.col("id")))


@query("without_own", """
SELECT sha1(o_custkey::VARCHAR) AS id, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""")
def _(t):
    seen = t.orders.select(sha("o_custkey").alias("id"))
    own = t.events.select(sha("user_id").alias("id"))
    return nodes.without_own(seen, own).groupBy(ids.to_hex(F.col("id")).alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
