"""Queries on collecting sightings, metadata payloads and peer addresses."""

from pyspark.sql import functions as F

from sightline.functions import ids
from sightline.functions.files import rolled_up
from sightline.operators import peers, search, sightings
from sightline.plans.registry import query
from sightline.sources import payloads


def sighting_events(t):
    return t.events.select(
        F.col("user_id").alias("infohash"), F.col("event_type").alias("source"), "ts"
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def sources_text(folded):
    return folded.select(
        "infohash", "first_seen", "last_seen",
        F.array_join(F.map_keys("source_counts"), ",").alias("sources"), "total_seen",
    )


SIGHTINGS_SQL = """
SELECT user_id AS infohash, min(ts) AS first_seen, max(ts) AS last_seen,
       array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources,
       count(*) AS total_seen
FROM events GROUP BY user_id"""


@query("sightings_fold", SIGHTINGS_SQL)
def _(t):
    return sources_text(sightings.fold_sightings(sighting_events(t), sources=EVENT_TYPES))


@query("sightings_fold_any_source", SIGHTINGS_SQL)
def _(t):
    return sources_text(sightings.fold_sightings(sighting_events(t)))


@query("sightings_true_counts", """
WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL)
SELECT user_id AS infohash,
       string_agg(event_type || '=' || c, ',' ORDER BY event_type) AS sources,
       sum(c)::BIGINT AS total_seen
FROM n GROUP BY user_id""")
def _(t):
    folded = sightings.fold_sightings(sighting_events(t), count_sources=True)
    pairs = F.transform(
        F.map_entries("source_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return folded.select("infohash", F.array_join(pairs, ",").alias("sources"), "total_seen")


@query("sightings_merge", SIGHTINGS_SQL)
def _(t):
    # stored rows and two later batches, told apart by the kind of event
    events = sighting_events(t)
    kinds = [F.col("source").isin("view", "click"), F.col("source") == "error",
             F.col("source").isin("purchase", "signup")]
    return sources_text(
        sightings.merge_sightings(*[sightings.fold_sightings(events.filter(k)) for k in kinds])
    )


@query("legacy_import", """
WITH stored AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b,
                       list(DISTINCT event_type) AS s
                FROM events WHERE event_type <> 'signup' AND event_type <> 'purchase' GROUP BY 1),
     imported AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events
                  WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(s.user_id, i.user_id) AS infohash,
       least(s.a, i.a) AS first_seen, greatest(s.b, i.b) AS last_seen,
       array_to_string(list_sort(CASE WHEN i.user_id IS NULL THEN s.s
            ELSE list_append(coalesce(s.s, []), 'legacy') END), ',') AS sources,
       coalesce(s.n, 1) AS total_seen
FROM stored s FULL JOIN imported i ON s.user_id = i.user_id""")
def _(t):
    events = sighting_events(t)
    stored = sightings.fold_sightings(
        events.filter((F.col("source") != "signup") & (F.col("source") != "purchase"))
    )
    imported = sightings.imported_sightings(events.filter(F.col("source") == "purchase"), "ts")
    return sources_text(sightings.apply_import(stored, imported))


@query("metadata_latest", """
SELECT user_id, event_id, ts, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return sightings.latest_rows(rows, ["user_id"], ["ts", "event_id"])


@query("first_seen_dedupe", """
SELECT event_id, ts, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def _(t):
    rows = t.events.select("event_id", "ts", "user_id", "event_type")
    return sightings.first_rows(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("rotating_dedupe", """
WITH p AS (SELECT event_id, user_id, ts, floor(epoch_us(ts) / 21600000000)::BIGINT AS period FROM events),
f AS (SELECT * FROM p
      QUALIFY row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) = 1),
r AS (SELECT *, period - row_number() OVER (PARTITION BY user_id ORDER BY period) AS run FROM f)
SELECT event_id, user_id, ts FROM r
QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY period) % 2 = 1""")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return sightings.rotating_dedupe(rows, "user_id", ["ts", "event_id"], 6 * 3600)


@query("unseen_ids", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def _(t):
    known = t.events.select(F.col("user_id").alias("o_custkey")).distinct()
    return sightings.unseen(t.orders.select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("distinct_ids", "SELECT count(DISTINCT user_id) AS unique_ids FROM events")
def _(t):
    return sightings.distinct_ids(t.events, "user_id", approximate=False)


@query("distinct_ids_sketch")
def _(t):
    return sightings.distinct_ids(t.lineitem, "l_orderkey")


@query("map_merge", """
SELECT p_partkey, 'kind=2,size=' || p_size || ',stock=7' AS merged FROM part""")
def _(t):
    big = lambda c: c.cast("bigint")
    left = F.create_map(F.lit("kind"), big(F.lit(1)), F.lit("size"), big(F.col("p_size")))
    right = F.create_map(F.lit("stock"), big(F.lit(7)), F.lit("kind"), big(F.lit(2)))
    entries = F.array_sort(F.map_entries(sightings.merge_maps(left, right)))
    texts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t.part.select("p_partkey", F.array_join(texts, ",").alias("merged"))


@query("hex_ids", """
WITH k AS (SELECT doc_id, CASE WHEN lang = 'en' THEN upper(sha1(text))
                               WHEN lang = 'fr' THEN md5(text) ELSE sha1(text) END AS key FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(lower(key), '[0-9a-f]{40}') THEN lower(key) END AS infohash
FROM k""")
def _(t):
    text = F.col("text")
    key = F.when(F.col("lang") == "en", F.upper(F.sha1(text))).when(
        F.col("lang") == "fr", F.md5(text)
    ).otherwise(F.sha1(text))
    rows = t.documents.select("doc_id", key.alias("key"))
    good, bad = search.split_keys(rows, "key")
    return good.select("doc_id", ids.to_hex(F.col("infohash")).alias("infohash")).unionByName(
        bad.select("doc_id", F.lit(None).cast("string").alias("infohash"))
    )


@query("sha1_check", """
SELECT doc_id, sha1(text) = (CASE WHEN lang = 'en' THEN sha1(text) ELSE sha1(source || text) END) AS ok
FROM documents""")
def _(t):
    claimed = F.when(F.col("lang") == "en", F.sha1("text")).otherwise(
        F.sha1(F.concat("source", "text"))
    )
    return t.documents.select(
        "doc_id", ids.sha1_matches(F.unhex(claimed), F.col("text").cast("binary")).alias("ok")
    )


@query("key_sample", """
SELECT doc_id FROM documents
WHERE ('0x' || substr(sha1(text), 1, 4))::BIGINT / 65536.0 < 0.25 OR lang = 'de'""")
def _(t):
    key = F.unhex(F.sha1("text"))
    wanted = F.when(F.col("lang") == "de", key)
    return t.documents.filter(
        ids.in_sample(key, 0.25) | F.coalesce(ids.in_sample(key, 0.0, wanted), F.lit(False))
    ).select("doc_id")


def packed_documents(t):
    """One info dictionary per document: two files, the whole text as its name."""

    def text(c):
        return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)

    number = lambda c: F.concat(F.lit("i"), c.cast("string"), F.lit("e"))
    payload = F.concat(
        F.lit("d5:filesld6:length"), number(F.col("n_chars")),
        F.lit("4:pathl"), text(F.col("lang")), text(F.col("source")), F.lit("ee"),
        F.lit("d6:length"), number(F.col("doc_id")), F.lit("4:pathl6:readmeeee"),
        F.lit("4:name"), text(F.col("text")), F.lit("12:piece length"), number(F.lit(16384)),
        F.lit("e"),
    ).cast("binary")
    rows = t.documents.select("doc_id", "source", payload.alias("payload"))
    # payloads of one source come with the id of something else
    key = F.when(F.col("source") == "src0", F.sha1("source")).otherwise(F.sha1("payload"))
    return rows.select(
        "doc_id", F.unhex(key).alias("infohash"), "payload",
        F.lit("2024-01-31").cast("timestamp_ntz").alias("ts"),
    )


PACKED_SQL = """
WITH p AS (SELECT *, 'd5:filesld6:lengthi' || n_chars || 'e4:pathl' || strlen(lang) || ':' || lang
    || strlen(source) || ':' || source || 'eed6:lengthi' || doc_id || 'e4:pathl6:readmeeee4:name'
    || strlen(text) || ':' || text || '12:piece lengthi16384ee' AS payload FROM documents)
"""


@query("payload_ingest", PACKED_SQL + """
SELECT sha1(payload) AS infohash, sha1(text) AS name_sha1, 16384::BIGINT AS piece_length,
       n_chars + doc_id AS total_size, 2 AS file_count,
       lang || '/' || source || ':' || n_chars || ',readme:' || doc_id AS files
FROM p WHERE source <> 'src0'""")
def _(t):
    metadata, _ = payloads.ingest(packed_documents(t), "ts")
    listed = F.transform(
        "files",
        lambda f: F.concat(F.array_join(f["path"], "/"), F.lit(":"), f["length"].cast("string")),
    )
    return metadata.select(
        ids.to_hex(F.col("infohash")).alias("infohash"), F.sha1("name").alias("name_sha1"),
        "piece_length", "total_size", "file_count", F.array_join(listed, ",").alias("files"),
    )


@query("ingest_failures", """
SELECT sha1(source) AS infohash, 'sha1_mismatch' AS error, count(*) AS n FROM documents
WHERE source = 'src0' GROUP BY ALL""")
def _(t):
    _, failed = payloads.ingest(packed_documents(t), "ts")
    return failed.groupBy(ids.to_hex(F.col("infohash")).alias("infohash"), "error").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("file_rollup", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 2 END::BIGINT AS file_count,
       CASE WHEN p_size > 25 THEN p_size ELSE p_size + greatest(25 - 2 * p_size, 0) END::BIGINT AS total_size
FROM part""")
def _(t):
    entry = lambda c: F.struct(
        c.cast("bigint").alias("length"), F.array(F.col("p_name")).alias("path")
    )
    files = F.when(
        F.col("p_size") <= 25, F.array(entry(F.col("p_size")), entry(25 - 2 * F.col("p_size")))
    )
    count, size = rolled_up(files, F.col("p_size").cast("bigint"))
    return t.part.select("p_partkey", count.alias("file_count"), size.alias("total_size"))


def packed_nodes(t):
    """Two packed nodes and a cut third per customer."""
    name = F.col("c_name")
    packed = F.concat(
        F.sha1(name), F.substring(F.md5(name), 1, 12),
        F.sha1(F.reverse(name)), F.substring(F.md5(F.reverse(name)), 1, 12), F.lit("ffee"),
    )
    return t.customer.select("c_custkey", F.unhex(packed).alias("nodes"))


NODES_SQL = """
WITH n AS (SELECT c_custkey, unnest([c_name, reverse(c_name)]) AS s FROM customer),
h AS (SELECT c_custkey, sha1(s) AS id, md5(s) AS m FROM n),
a AS (SELECT c_custkey, id, ('0x' || substr(m, 1, 2))::INT AS a, ('0x' || substr(m, 3, 2))::INT AS b,
      ('0x' || substr(m, 5, 2))::INT AS c, ('0x' || substr(m, 7, 2))::INT AS d,
      ('0x' || substr(m, 9, 4))::INT AS port FROM h)
"""


@query("node_expansion", NODES_SQL + """
SELECT c_custkey, id, a || '.' || b || '.' || c || '.' || d AS ip, port FROM a""")
def _(t):
    return peers.expand_nodes(packed_nodes(t), "nodes").withColumn("id", ids.to_hex(F.col("id")))


@query("peer_expansion", """
WITH h AS (SELECT c_custkey, md5(c_name) AS m FROM customer),
r AS (SELECT c_custkey, unnest([substr(m, 1, 12), substr(m, 13, 12)]) AS p FROM h)
SELECT c_custkey, ('0x' || substr(p, 1, 2))::INT || '.' || ('0x' || substr(p, 3, 2))::INT || '.'
       || ('0x' || substr(p, 5, 2))::INT || '.' || ('0x' || substr(p, 7, 2))::INT AS ip,
       ('0x' || substr(p, 9, 4))::INT AS port FROM r""")
def _(t):
    packed = t.customer.select("c_custkey", F.unhex(F.md5("c_name")).alias("peers"))
    return peers.expand_peers(packed, "peers")


@query("public_addresses", NODES_SQL + """
SELECT c_custkey, a || '.' || b || '.' || c || '.' || d AS ip FROM a
WHERE NOT (a IN (10, 100, 127) OR (a + b + c + d = 0) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a + b + c + d = 1020)
  OR a BETWEEN 224 AND 239)""")
def _(t):
    return peers.public_only(peers.expand_nodes(packed_nodes(t), "nodes")).select("c_custkey", "ip")


@query("first_peers", """
WITH f AS (SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY ALL)
SELECT event_type, user_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id) AS arrival
FROM f QUALIFY arrival <= 12""")
def _(t):
    found = peers.first_peers(
        t.events.select("event_type", "user_id", "ts"), "event_type", "user_id", "ts", 12
    )
    return found.withColumn("arrival", F.col("arrival").cast("bigint"))


@query("json_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
