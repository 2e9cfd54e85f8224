"""Queries on search, lists, details, file trees and text forms of items."""

from functools import reduce

from pyspark.sql import functions as F

from sightline.functions import files as file_exprs
from sightline.functions import text
from sightline.operators import files, search, sightings
from sightline.operators.postings import write_postings
from sightline.plans.registry import query
from sightline.session import work_path
from sightline.sources.sinks import sample_export

TERM = "red widg"

# pieces of a text in DuckDB: words of letters and digits, padded, cut into threes
def pieces_sql(expr):
    return (
        "list_distinct(flatten(list_transform(list_filter("
        rf"string_split_regex(lower({expr}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def similarity_sql(name, term):
    a, b = pieces_sql(name), pieces_sql(f"'{term}'")
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared} / (len({a}) + len({b}) - {shared})::DOUBLE)"


ITEMS_SQL = f"""
WITH i AS (SELECT p_partkey, p_name AS name, (p_retailprice * 100)::BIGINT AS total_size,
    p_size AS file_count, TIMESTAMP '2024-01-01' + to_seconds(p_partkey) AS verified_at,
    {similarity_sql('p_name', TERM)} AS similarity FROM part),
m AS (SELECT * FROM i WHERE name ILIKE '%{TERM}%' OR similarity >= 0.3)
"""


def items(t):
    """Parts as items; the id is the part's number."""
    return t.part.select(
        "p_partkey", F.col("p_name").alias("name"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("total_size"),
        F.col("p_size").alias("file_count"),
        F.timestamp_seconds(F.col("p_partkey") + 1704067200).cast("timestamp_ntz").alias("verified_at"),
    )


COLUMNS = ["p_partkey", "name", "total_size", "file_count", "verified_at"]


@query("search_page", ITEMS_SQL + f"""
SELECT {', '.join(COLUMNS)} FROM m ORDER BY total_size DESC NULLS FIRST, p_partkey LIMIT 25 OFFSET 25""")
def _(t):
    return search.search(items(t), TERM, "size", "desc", page=2, key="p_partkey")


@query("search_by_name", ITEMS_SQL + f"""
SELECT {', '.join(COLUMNS)} FROM m ORDER BY name NULLS LAST, p_partkey LIMIT 100""")
def _(t):
    return search.search(items(t), f"  {TERM} ", "name", "asc", limit=500, key="p_partkey")


@query("search_relevance", ITEMS_SQL + f"""
SELECT {', '.join(COLUMNS)} FROM m ORDER BY similarity DESC, p_partkey LIMIT 40""")
def _(t):
    return search.search(items(t), TERM, limit=40, key="p_partkey")


@query("search_scores", ITEMS_SQL + """
SELECT p_partkey, round(similarity, 6) AS similarity FROM i WHERE similarity >= 0.3""")
def _(t):
    score = text.trigram_similarity(F.col("name"), TERM)
    return (
        items(t).withColumn("similarity", score).filter(F.col("similarity") >= 0.3)
        .select("p_partkey", F.round("similarity", 6).alias("similarity"))
    )


@query("search_by_index", ITEMS_SQL + """
SELECT p_partkey, round(similarity, 6) AS similarity FROM i WHERE similarity >= 0.3""")
def _(t):
    index = search.trigram_index(items(t), "p_partkey")
    return search.similar_by_index(index, TERM, "p_partkey").withColumn(
        "similarity", F.round("similarity", 6)
    )


def part_postings(t):
    return write_postings(items(t), work_path(t.spark, "part-postings"), "p_partkey")


@query("search_stored_index", ITEMS_SQL + f"""
SELECT {', '.join(COLUMNS)} FROM m ORDER BY similarity DESC, p_partkey LIMIT 100""")
def _(t):
    return search.search(items(t), TERM, limit=100, key="p_partkey", index=part_postings(t))


# terms of one character up to whole words, with a repeated window and with wildcards
TERMS = ["e", "re", "red widg", "ed", "widget", "RED", "d w", "%_", "nowhere", "b widget"]
TERMS_SQL = f"""
SELECT term, count(DISTINCT p_partkey) AS n, coalesce(sum(p_partkey), 0)::BIGINT AS keys
FROM (SELECT unnest({TERMS}) AS term) LEFT JOIN part ON contains(lower(p_name), lower(term)) GROUP BY term"""


@query("contains_stored_index", TERMS_SQL)
def _(t):
    index = part_postings(t)
    found = [index.containing(term).select(F.lit(term).alias("term"), "id") for term in TERMS]
    asked = t.spark.createDataFrame([(term,) for term in TERMS], "term string")
    return (
        asked.join(reduce(lambda a, b: a.union(b), found), "term", "left").groupBy("term")
        .agg(F.count("id").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("keys"))
    )


PHRASE = "the and attion"


@query("phrase_in_documents", f"SELECT doc_id FROM documents WHERE contains(lower(text), '{PHRASE}')")
def _(t):
    path = work_path(t.spark, "text-postings")
    index = write_postings(t.documents, path, "doc_id", "text", words=False)
    return index.containing(PHRASE).withColumnRenamed("id", "doc_id")


@query("search_total", ITEMS_SQL + """
SELECT count(*) AS total, greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages FROM m""")
def _(t):
    return search.search_total(items(t), TERM)


@query("list_newest", ITEMS_SQL + f"""
SELECT {', '.join(COLUMNS)} FROM i ORDER BY verified_at DESC NULLS FIRST, p_partkey LIMIT 25""")
def _(t):
    return search.search(items(t), key="p_partkey")


@query("list_after_row", """
SELECT o_orderkey, o_totalprice AS total_size FROM orders
WHERE o_totalprice < 250000 OR (o_totalprice = 250000 AND o_orderkey > 10)
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("total_size"))
    return search.search(
        rows, None, "size", "desc", limit=100, key="o_orderkey", after=(250000.0, 10)
    )


@query("detail_join", """
WITH s AS (SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen,
    array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources, count(*) AS total_seen
  FROM orders GROUP BY 1)
SELECT c_custkey, c_name, first_seen, last_seen, sources, total_seen
FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def _(t):
    folded = sightings.fold_sightings(
        t.orders, "o_custkey", source="o_orderstatus", ts="o_orderdate"
    ).withColumnRenamed("o_custkey", "c_custkey")
    rows = search.detail(t.customer.select("c_custkey", "c_name"), folded, key="c_custkey")
    return rows.select(
        "c_custkey", "c_name", "first_seen", "last_seen",
        F.array_join(F.map_keys("source_counts"), ",").alias("sources"), "total_seen",
    )


@query("detail_for_keys", """
SELECT c_custkey, c_name, n.total_seen FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS total_seen FROM orders GROUP BY 1) n ON c_custkey = o_custkey
WHERE c_custkey IN (SELECT user_id FROM events)""")
def _(t):
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("total_seen")
    )
    keys = t.events.select(F.col("user_id").alias("c_custkey"))
    return search.detail(t.customer.select("c_custkey", "c_name"), seen, keys, "c_custkey")


@query("magnet_links", """
SELECT doc_id, 'magnet:?xt=urn:btih:' || sha1(text) || '&dn='
  || replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')
     .replace('%2A', '*').replace('%7E', '~') AS magnet
FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", F.unhex(F.sha1("text")).alias("infohash"), "text")
    link = text.magnet_link(F.lower(F.hex("infohash")), F.col("text"))
    return rows.select("doc_id", link.alias("magnet"))


@query("like_escape", r"""
SELECT page_id, regexp_replace(html, '([\\%_])', '\\\1', 'g') AS pattern FROM pages""")
def _(t):
    return t.pages.select("page_id", text.escape_like(F.col("html")).alias("pattern"))


@query("human_numbers", """
WITH n AS (SELECT c_custkey, (abs(c_acctbal) * c_custkey * 1000)::BIGINT AS b, abs(c_acctbal) * 300 AS v FROM customer),
s AS (SELECT *, CASE WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 WHEN b < 1099511627776 THEN 3 ELSE 4 END AS p FROM n),
x AS (SELECT *, b / pow(1024, p) AS xb, CASE WHEN v >= 1e6 THEN v / 1e6 ELSE v / 1e3 END AS xv FROM s),
-- printf rounds the binary value itself and exact halves to even, which is down for .25 alone
d AS (SELECT *, CASE WHEN xb - floor(xb) = 0.25 THEN floor(xb)::BIGINT || '.3' ELSE printf('%.1f', xb) END AS tb,
  CASE WHEN xv - floor(xv) = 0.25 THEN floor(xv)::BIGINT || '.3' ELSE printf('%.1f', xv) END AS tv FROM x)
SELECT c_custkey,
  CASE WHEN b < 1024 THEN b || ' B' ELSE tb || ' ' || (['KB', 'MB', 'GB', 'TB'])[p] END AS size,
  CASE WHEN v >= 1e6 THEN tv || 'M' WHEN v >= 1e3 THEN tv || 'k'
       ELSE floor(v + 0.5)::BIGINT || '' END AS number
FROM d""")
def _(t):
    size = F.round(F.abs("c_acctbal") * F.col("c_custkey") * 1000).cast("bigint")
    return t.customer.select(
        "c_custkey", text.human_size(size).alias("size"),
        text.human_number(F.abs("c_acctbal") * 300).alias("number"),
    )


PAGE_FILES_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS parts,
    length(html) AS len FROM pages),
f AS (SELECT host, page_id, CASE WHEN len(parts) = 0 THEN ['<unnamed>'] ELSE parts END AS parts, len FROM u)
"""


def page_files(t):
    """Pages as files of their host: path segments of the address, length of the page."""
    return t.pages.select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.col("page_id").alias("pos"),
        F.filter(
            F.split(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != ""
        ).alias("path"),
        F.length("html").cast("bigint").alias("length"),
    )


@query("dir_tree", PAGE_FILES_SQL + """,
l AS (SELECT host, array_to_string(parts, '/') AS path, max_by(parts, page_id) AS parts,
      max(page_id) AS pos, max_by(len, page_id) AS own FROM f GROUP BY host, array_to_string(parts, '/')),
s AS (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.host = a.host AND b.pos > a.pos
      AND starts_with(a.path, b.path || '/'))),
c AS (SELECT host, parts, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.host = s.host AND b.own > 0
      AND starts_with(b.path, s.path || '/')) THEN 0 ELSE own END AS w FROM s),
n AS (SELECT host, w, unnest(list_transform(range(1, len(parts) + 1),
      lambda i: array_to_string(parts[1:i], '/'))) AS path FROM c)
SELECT host, path, sum(w)::BIGINT AS size FROM n GROUP BY host, path""")
def _(t):
    return files.directory_sizes(page_files(t), "host")


@query("top_dirs", PAGE_FILES_SQL + """
SELECT host, array_to_string(list_sort(list(DISTINCT parts[1])), ',') AS top_dirs FROM f GROUP BY host""")
def _(t):
    # the list of one host is rebuilt here from distinct first segments only
    first = F.when(F.size("path") > 0, F.col("path")[0]).otherwise(F.lit("<unnamed>"))
    per_host = page_files(t).groupBy("host").agg(
        F.collect_set(F.struct(F.lit(0).cast("bigint").alias("length"), F.array(first).alias("path"))).alias("files")
    )
    return per_host.select(
        "host", F.array_join(file_exprs.top_dirs(F.col("files")), ",").alias("top_dirs")
    )


@query("shown_files", """
SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand || ':' || p_size
    WHEN p_size > 10 THEN p_name || ':' || (p_retailprice * 100)::BIGINT ELSE '' END AS shown FROM part""")
def _(t):
    entry = F.struct(F.col("p_size").cast("bigint").alias("length"), F.array("p_brand").alias("path"))
    shown = file_exprs.shown_files(
        F.when(F.col("p_size") > 30, F.array(entry)), F.col("p_name"),
        F.round(F.col("p_retailprice") * 100).cast("bigint"), F.when(F.col("p_size") > 10, 1).otherwise(0),
    )
    texts = F.transform(
        shown, lambda f: F.concat(f["path"][0], F.lit(":"), f["length"].cast("string"))
    )
    return t.part.select("p_partkey", F.array_join(texts, ",").alias("shown"))


@query("input_text", r"""
SELECT doc_id, 'Name: ' || substr(text, 1, 300) || chr(10) || 'Files: ' || doc_id || '  Size: ' || n_chars
  || chr(10) || 'Top dirs: ' || lang || ', ' || source || ', ' || substr(text, 1, 100) AS input FROM documents""")
def _(t):
    made = text.input_text(
        F.col("text"), F.col("doc_id"), F.col("n_chars"), F.array("lang", "source", "text")
    )
    return t.documents.select("doc_id", made.alias("input"))


def escape_sql(expr, n):
    out = f"substr({expr}, 1, {n})"
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")]:
        out = f"replace({out}, '{char}', '{entity}')"
    return out


@query("xml_prompt", f"""
SELECT page_id, '<torrent>' || chr(10) || '  <infohash>' || sha1(url) || '</infohash>' || chr(10)
  || '  <name>' || {escape_sql('html', 500)} || '</name>' || chr(10)
  || '  <file_count>2</file_count>' || chr(10)
  || '  <total_size_bytes>' || length(html) || '</total_size_bytes>' || chr(10) || '  <files>' || chr(10)
  || '  <file>' || {escape_sql('url', 200)} || '</file>' || chr(10)
  || '  <file>' || {escape_sql('html', 200)} || '</file>' || chr(10) || '  </files>' || chr(10)
  || '</torrent>' AS record FROM pages""")
def _(t):
    record = text.xml_record(
        F.sha1("url"), F.col("html"), F.lit(2), F.length("html"), F.array("url", "html")
    )
    return t.pages.select("page_id", record.alias("record"))


@query("sample_export", "SELECT least(count(*), 500) AS n, 0 AS unnamed FROM part")
def _(t):
    # a random sample: what is fixed is its size and that every row is named
    rows = items(t).select(
        F.unhex(F.sha1(F.col("p_partkey").cast("string"))).alias("infohash"), "name", "file_count",
        "total_size",
        F.lit(None).cast("array<struct<length:bigint,path:array<string>>>").alias("files"),
    )
    return sample_export(rows, 500, seed=7).agg(
        F.countDistinct("infohash").alias("n"), F.count_if(F.col("name").isNull()).alias("unnamed")
    )
