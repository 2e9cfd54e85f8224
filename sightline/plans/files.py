"""Queries that write tables as files of each kind and read these back."""

from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions.ids import to_hex
from sightline.operators.backfill import IDS, RECORDS, backfill
from sightline.plans.registry import query
from sightline.session import work_path
from sightline.sources import files, records, sinks

@query("record_files", """
SELECT sha1(text) AS infohash, octet_length(encode(text)) AS size, sha1(text) AS payload_sha1 FROM documents
WHERE text IS NOT NULL""")
def _(t):
    path = work_path(t.spark, "record-files")
    rows = t.documents.filter("text IS NOT NULL").select(
        F.unhex(F.sha1("text")).alias("infohash"), F.col("text").cast("binary").alias("payload")
    )
    records.write_records(rows, path)
    return records.read_records(t.spark, path, range_bytes=4 << 20).select(
        to_hex(F.col("infohash")).alias("infohash"), F.octet_length("payload").cast("bigint").alias("size"),
        F.sha1("payload").alias("payload_sha1"),
    )


@query("json_lines", "SELECT doc_id, sha1(text) AS text_sha1, lang, n_chars FROM documents")
def _(t):
    path = work_path(t.spark, "json-lines")
    sinks.write_json_lines(t.documents, path)
    rows = files.read_jsonl(t.spark, path, t.documents.schema)
    return rows.select("doc_id", F.sha1("text").alias("text_sha1"), "lang", "n_chars")


@query("hex_id_file", """
SELECT sha1(user_id::VARCHAR) AS infohash, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error')
GROUP BY 1""")
def _(t):
    path = work_path(t.spark, "hex-ids")
    good, kind = F.sha1(F.col("user_id").cast("string")), F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit(" \t"), good, F.lit("  "))).when(kind == "click", F.upper(good))
        .when(kind == "error", good).when(kind == "signup", F.concat(good, F.lit("0"))).otherwise(F.repeat(F.lit("zz"), 20))
    )
    t.events.select(line.alias("value")).write.text(path)
    found = files.read_hex_ids(t.spark, path).groupBy("infohash").agg(F.count(F.lit(1)).alias("n"))
    return found.select(to_hex(F.col("infohash")).alias("infohash"), "n")


@query("label_map_file", "SELECT doc_id AS idx, lang AS category, n_chars > 1000 AS keep FROM documents")
def _(t):
    path = work_path(t.spark, "labels") + ".csv"
    rows = t.documents.select(F.col("doc_id").alias("idx"), F.col("lang").alias("category"), (F.col("n_chars") > 1000).alias("keep"))
    rows.write.option("header", True).csv(path)
    return files.read_label_map(t.spark, path).select(F.col("idx").cast("bigint").alias("idx"), "category", "keep")


@query("metrics_last_write", """
SELECT date_trunc('hour', ts) AS ts, event_type AS metric_name, count(*) AS metric_value FROM events GROUP BY 1, 2
UNION ALL SELECT max(ts), '_session_start', 0 FROM events""")
def _(t):
    """Two snapshots of the same hours: one without the last event of each, and then the whole one,
    which is also written a second time; the older one comes last."""
    path = work_path(t.spark, "metrics")
    whole = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name")).agg(
        F.count(F.lit(1)).alias("metric_value")
    )
    early = whole.withColumn("metric_value", F.col("metric_value") - 1)
    for number, rows in ((7, whole), (7, whole), (3, early)):
        sinks.write_metrics(rows, path, number)
    last = t.events.agg(F.max("ts").cast("timestamp").alias("ts"))
    sinks.write_metrics(sinks.session_marker(last, "ts"), path, 8)
    return sinks.read_metrics(t.spark, path).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "metric_name", "metric_value")


@query("backfill_job", """
WITH b AS (SELECT sha1(p_partkey::VARCHAR) AS infohash, p_name AS name, p_size::BIGINT AS total_size,
    p_size > 25 AS stored, p_size > 40 AS tried FROM part),
d AS (SELECT DISTINCT sha1(user_id::VARCHAR) AS infohash FROM events)
SELECT coalesce(b.infohash, d.infohash) AS infohash, name, total_size,
  CASE WHEN tried THEN 3 WHEN b.infohash IS NOT NULL THEN 0 END AS fetch_attempts,
  CASE WHEN stored THEN 'dht,legacy' ELSE 'legacy' END AS sources, CASE WHEN stored THEN total_size ELSE 1 END AS total_seen,
  CASE WHEN tried THEN 'failed' WHEN b.infohash IS NOT NULL THEN 'verified' ELSE 'pending' END AS status
FROM b FULL JOIN d ON b.infohash = d.infohash""")
def _(t):
    """Parts as records, users as listed ids; parts of some sizes are known before."""
    folder = work_path(t.spark, "backfill")
    of = lambda c: F.unhex(F.sha1(F.col(c).cast("string"))).alias("infohash")
    payload = F.concat(
        F.lit("d6:lengthi"), F.col("p_size").cast("string"), F.lit("e4:name"), F.octet_length("p_name").cast("string"),
        F.lit(":"), "p_name", F.lit("12:piece lengthi16384ee"),
    )
    records.write_records(t.part.select(of("p_partkey"), payload.cast("binary").alias("payload")), f"{folder}/{RECORDS}")
    t.events.select(F.sha1(F.col("user_id").cast("string")).alias("value")).write.text(f"{folder}/{IDS}")
    early = F.lit("2024-01-01").cast("timestamp")

    def stored(rows, schema, **values):
        have = {"infohash": of("p_partkey"), **values}
        return rows.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    made = backfill(
        t.spark, folder, F.lit("2024-06-01").cast("timestamp"),
        stored(t.part.filter("p_size > 25"), schemas.SIGHTINGS, first_seen=early, last_seen=early,
               source_counts=F.create_map(F.lit("dht"), F.lit(1)), total_seen=F.col("p_size")),
        stored(t.part.filter("p_size > 40"), schemas.METADATA, name=F.lit("old"), fetch_attempts=F.lit(3), verified_at=early),
        stored(t.part.filter("p_size > 40"), schemas.JOBS, status=F.lit("failed"), retry_count=F.lit(1), updated_at=early),
    )
    rows = made.sightings.join(made.metadata, "infohash", "left").join(made.jobs, "infohash", "left")
    return rows.select(
        to_hex(F.col("infohash")).alias("infohash"), "name", "total_size", "fetch_attempts",
        F.array_join(F.array_sort(F.map_keys("source_counts")), ",").alias("sources"), "total_seen", "status",
    )
