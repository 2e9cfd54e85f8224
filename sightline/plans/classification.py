"""Queries on classification, labels and evaluation."""

from pyspark.sql import functions as F

from sightline.functions.vectors import top_scored
from sightline.operators import classify, evaluate, training
from sightline.plans.registry import query
from sightline.vocab import CATEGORIES


def anchors(t, last=False):
    """The first (or last) vector of each label as its anchor."""
    pick = F.max_by if last else F.min_by
    return t.embeddings.groupBy("label").agg(
        pick("embedding", "vec_id").alias("embedding")
    ).select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), "embedding",
        F.col("label").alias("place"),
    )


ANCHOR_SQL = """
WITH a AS (SELECT label, min_by(embedding, vec_id)::DOUBLE[] AS v, max_by(embedding, vec_id)::DOUBLE[] AS w
           FROM embeddings GROUP BY label),
s AS (SELECT vec_id, e.label AS own, 'c' || a.label AS category, a.label AS place,
        list_dot_product(e.embedding::DOUBLE[], a.v) AS x, list_dot_product(e.embedding::DOUBLE[], a.w) AS y
      FROM embeddings e, a),
best AS (SELECT vec_id, max_by(category, x) AS cx, max(x) AS x, max_by(category, y) AS cy, max(y) AS y
         FROM s GROUP BY vec_id)
"""


@query("anchor_argmax", ANCHOR_SQL + """
SELECT vec_id, cx AS category, round(x, 6) AS score FROM best""")
def _(t):
    scored = classify.anchor_scores(t.embeddings, anchors(t), "vec_id", order="place")
    best = F.try_element_at("candidates", F.lit(1))
    return scored.select(
        "vec_id", best["category"].alias("category"), F.round(best["confidence"], 6).alias("score")
    )


@query("top3", ANCHOR_SQL + """,
r AS (SELECT vec_id, category, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM s)
SELECT vec_id, k, category, round(x, 4) AS score FROM r WHERE k <= 3""")
def _(t):
    scored = classify.anchor_scores(t.embeddings, anchors(t), "vec_id", order="place", top=3)
    rows = scored.select("vec_id", F.posexplode("candidates").alias("k", "c"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("bigint").alias("k"), F.col("c.category").alias("category"),
        F.round("c.confidence", 4).alias("score"),
    )


@query("top_scored_array", """
WITH p AS (SELECT c_custkey, unnest(['Games', 'Music', 'Other', 'Movies']) AS category,
  unnest([c_acctbal / 10000, c_nationkey / 25.0, 0.25, (c_custkey % 100) / 100.0]) AS s FROM customer)
SELECT c_custkey, string_agg(category || ':' || printf('%.4f', s::DOUBLE), ',' ORDER BY s DESC, category DESC) AS best
FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, category DESC) <= 3)
GROUP BY c_custkey""")
def _(t):
    scores = F.array(
        F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0, F.lit(0.25),
        (F.col("c_custkey") % 100) / 100.0,
    )
    best = top_scored(["Games", "Music", "Other", "Movies"], scores, 3)
    texts = F.transform(
        best,
        lambda c: F.concat(c["category"], F.lit(":"), c["confidence"].cast("decimal(9,4)").cast("string")),
    )
    return t.customer.select("c_custkey", F.array_join(texts, ",").alias("best"))


def cascaded(t):
    linear = classify.anchor_scores(t.embeddings, anchors(t), "vec_id", order="place", top=3)
    near = classify.anchor_scores(t.embeddings, anchors(t, last=True), "vec_id", order="place")
    rows = linear.withColumnRenamed("candidates", "linear").join(
        near.withColumnRenamed("candidates", "near"), "vec_id"
    )
    return classify.cascade(
        rows, linear=F.col("linear"), anchor=F.try_element_at("near", F.lit(1)),
        linear_threshold=0.45, anchor_threshold=0.35, model="table", classifier="first-vector",
    )


CASCADE_SQL = ANCHOR_SQL + """,
c AS (SELECT vec_id, CASE WHEN x >= 0.45 THEN cx WHEN y >= 0.35 THEN cy ELSE 'Other' END AS category,
  CASE WHEN x >= 0.45 THEN round(x, 4) WHEN y >= 0.35 THEN round(y, 4) ELSE 0.0 END AS confidence,
  CASE WHEN x >= 0.45 THEN 'linear' WHEN y >= 0.35 THEN 'anchor' ELSE 'fallback' END AS method FROM best)
"""


@query("classify_cascade", CASCADE_SQL + "SELECT * FROM c")
def _(t):
    return cascaded(t).select("vec_id", "category", "confidence", "method")


@query("method_mix", CASCADE_SQL + """
SELECT method, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS percent
FROM c GROUP BY method""")
def _(t):
    return classify.method_mix(cascaded(t)).withColumn("percent", F.round("percent", 6))


@query("valid_predictions", CASCADE_SQL + """
SELECT vec_id, 'Other' AS category, confidence FROM c WHERE method = 'fallback'""")
def _(t):
    # the labels of this table are no known categories, so only fallbacks are valid
    return classify.valid_predictions(cascaded(t)).select("vec_id", "category", "confidence")


def answers(t):
    """Model answers of several shapes around the text of each conversation turn."""
    names = F.array(*[F.lit(c) for c in [*CATEGORIES, "TV"]])
    category = F.element_at(names, F.pmod(F.col("conv_id"), F.lit(10)).cast("int") + 1)
    number = F.format_string("%.2f", (F.pmod(F.col("conv_id"), F.lit(30)) * 4) / 100)
    block = F.concat(
        F.lit("<classification>\n  <category>"), category, F.lit("</category>\n  <confidence>"),
        number, F.lit("</confidence>\n</classification>"),
    )
    shape = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5))
    raw = (
        F.when(shape == 0, block)
        .when(shape == 1, F.concat(F.lit("```xml\n"), block, F.lit("\n```")))
        .when(shape == 2, F.concat(F.col("text"), F.lit("\n"), block, F.lit("\n"), F.col("text")))
        .when(shape == 3, F.concat(F.col("text"), F.substring_index(block, "\n</classification>", 1)))
        .otherwise(F.col("text"))
    )
    return t.conversations.select("conv_id", "turn", raw.alias("raw"), block.alias("block"))


ANSWERS_SQL = """
WITH b AS (SELECT *, (['Movies', 'Television', 'Games', 'Music', 'Applications', 'Anime', 'Documentaries',
      'Other', 'Unwanted', 'TV'])[conv_id % 10 + 1] AS cat, round((conv_id % 30) * 4 / 100.0, 2) AS num
  FROM conversations),
r AS (SELECT conv_id, turn, cat, num,
  (conv_id + turn) % 5 < 4 AND cat <> 'TV' AND num <= 1.0 AS ok FROM b)
"""


@query("llm_parse", ANSWERS_SQL + """
SELECT conv_id, turn, CASE WHEN ok THEN cat ELSE 'Other' END AS category,
  CASE WHEN ok THEN num ELSE 0.0 END AS confidence,
  CASE WHEN ok THEN 'success' ELSE 'parse_fail' END AS parse_status FROM r""")
def _(t):
    return classify.parse_answers(answers(t), "raw").drop("raw", "block")


@query("llm_run", ANSWERS_SQL + """
SELECT conv_id, CASE WHEN cat = 'TV' OR num > 1.0 THEN 'Other' ELSE cat END AS category,
  CASE WHEN cat = 'TV' OR num > 1.0 THEN 0.0 ELSE num END AS confidence,
  CASE WHEN cat = 'TV' OR num > 1.0 THEN 'parse_fail' ELSE 'success' END AS parse_status,
  cat = 'TV' OR num > 1.0 OR (conv_id % 2 = 1) AS retry_used
FROM (SELECT DISTINCT conv_id, cat, num FROM b)""")
def _(t):
    def model():
        # answers are read back from the prompt; odd items are understood on the second try only
        def reply(turns):
            name = turns[-1]["content"].split("<name>")[1].split("</name>")[0]
            number, block = name.split("|", 1)
            again = "exactly one XML block" in turns[0]["content"]
            if int(number) % 2 and not again:
                return "no idea"
            for coded, char in [("&lt;", "<"), ("&gt;", ">")]:
                block = block.replace(coded, char)
            return block

        return reply

    items = answers(t).groupBy("conv_id").agg(
        F.min(F.concat(F.col("conv_id").cast("string"), F.lit("|"), "block")).alias("name")
    ).select(
        "conv_id", "name", F.lit(0).alias("file_count"), F.lit(0).alias("total_size"),
        F.array().cast("array<string>").alias("top_dirs"),
    )
    found = classify.classify_with_model(
        items, model, system="Choose a category.", fewshot=[("a", "b")], key="conv_id", retry=True
    )
    return found.select("conv_id", "category", "confidence", "parse_status", "retry_used")


@query("run_summary", ANSWERS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS parse_fail,
  round(avg(turn * 10.0), 6) AS avg_latency_ms FROM r""")
def _(t):
    parsed = classify.parse_answers(answers(t), "raw").withColumn("latency_ms", F.col("turn") * 10.0)
    return classify.run_summary(parsed).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("embed_texts", """
SELECT doc_id, coalesce(length(text), 0) AS n_chars, 4 AS size FROM documents""")
def _(t):
    def model():
        return lambda texts: [[float(len(x)), 1.0, 0.0, -1.0] for x in texts]

    made = classify.embed(t.documents, "text", model)
    return made.select(
        "doc_id", F.col("embedding")[0].cast("bigint").alias("n_chars"), F.size("embedding").alias("size")
    )


@query("hashed_embedding", r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')) AS word FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
      FROM w WHERE word <> '' GROUP BY ALL)
SELECT doc_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM c""")
def _(t):
    made = classify.hashed_embedding(t.documents, "text", 64)
    return made.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0").select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value")
    )


@query("label_conversion", """
WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Movies' WHEN 'fr' THEN 'Music' ELSE '' END AS own FROM documents),
m AS (SELECT doc_id AS idx, CASE quality WHEN 1 THEN 'Games' ELSE 'Unwanted' END AS cat, toxic = 0 AS keep FROM labels)
SELECT doc_id, CASE WHEN own <> '' THEN own ELSE cat END AS label_category,
       CASE WHEN own <> '' THEN true ELSE keep END AS label_keep
FROM r LEFT JOIN m ON doc_id = idx WHERE own <> '' OR cat IS NOT NULL""")
def _(t):
    rows = t.documents.select(
        "doc_id", F.col("doc_id").alias("row_idx"),
        F.when(F.col("lang") == "en", "Movies").when(F.col("lang") == "fr", "Music").otherwise("").alias("label_category"),
        F.lit(None).cast("boolean").alias("label_keep"),
    )
    label_map = t.labels.select(
        F.col("doc_id").alias("idx"),
        F.when(F.col("quality") == 1, "Games").otherwise("Unwanted").alias("category"),
        (F.col("toxic") == 0).alias("keep"),
    )
    return evaluate.convert_labels(rows, label_map).select("doc_id", "label_category", "label_keep")


def pairs(t):
    """Labels as gold; a rule on length and language as prediction, missing for one source."""
    gold = F.when(F.col("toxic") == 1, "Unwanted").when(F.col("quality") == 1, "Games").otherwise("Music")
    pred = (
        F.when(F.col("n_chars") < 500, "Unwanted").when(F.col("n_chars") < 2500, "Games")
        .when(F.col("n_chars") < 6000, "Music").otherwise("Other")
    )
    predictions = t.documents.filter(F.col("source") != "src3").select(
        "doc_id", pred.alias("category"),
        F.when(F.col("lang") == "de", "parse_fail").otherwise("success").alias("parse_status"),
        "n_chars",
    )
    return evaluate.judged(t.labels.select("doc_id", gold.alias("gold")), predictions, "doc_id")


PAIRS_SQL = """
WITH p AS (SELECT CASE WHEN toxic = 1 THEN 'Unwanted' WHEN quality = 1 THEN 'Games' ELSE 'Music' END AS gold,
  CASE WHEN d.doc_id IS NULL OR lang = 'de' THEN 'MALFORMED' WHEN n_chars < 500 THEN 'Unwanted'
       WHEN n_chars < 2500 THEN 'Games' WHEN n_chars < 6000 THEN 'Music' ELSE 'Other' END AS pred
  FROM labels l LEFT JOIN (SELECT * FROM documents WHERE source <> 'src3') d USING (doc_id)),
g AS (SELECT gold AS category, count(*) AS support, count(*) FILTER (WHERE gold = pred) AS tp FROM p GROUP BY 1),
q AS (SELECT pred AS category, count(*) AS predicted FROM p GROUP BY 1),
c AS (SELECT category, CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS pr,
  tp / support::DOUBLE AS re, support FROM g LEFT JOIN q USING (category)),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM c)
"""


@query("confusion", PAIRS_SQL + "SELECT c.gold, " + ", ".join(
    f"count(p.pred) FILTER (WHERE p.pred = '{c}') AS {c}" for c in [*CATEGORIES, "MALFORMED"]
) + f" FROM (SELECT unnest({CATEGORIES}) AS gold) c LEFT JOIN p ON p.gold = c.gold GROUP BY c.gold")
def _(t):
    return evaluate.confusion(pairs(t))


@query("class_report", PAIRS_SQL + """
SELECT category, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f""")
def _(t):
    made = evaluate.class_report(pairs(t))
    return made.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("eval_summary", PAIRS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE pred <> 'MALFORMED') AS evaluated,
  count(*) FILTER (WHERE pred = 'MALFORMED') AS parse_fail,
  round(count(*) FILTER (WHERE pred = 'MALFORMED') * 100.0 / count(*), 6) AS parse_fail_percent,
  count(*) FILTER (WHERE pred = gold) AS correct,
  round(count(*) FILTER (WHERE pred = gold) / count(*) FILTER (WHERE pred <> 'MALFORMED')::DOUBLE, 6) AS accuracy,
  (SELECT round(avg(pr), 6) FROM f) AS macro_precision, (SELECT round(avg(re), 6) FROM f) AS macro_recall,
  (SELECT round(avg(f1), 6) FROM f) AS macro_f1 FROM p""")
def _(t):
    made = evaluate.eval_summary(pairs(t))
    ratios = ("parse_fail_percent", "accuracy", "macro_precision", "macro_recall", "macro_f1")
    return made.withColumns({c: F.round(c, 6) for c in ratios})


@query("class_weights", """
SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings)
  / ((SELECT count(DISTINCT label) FROM embeddings) * count(*))::DOUBLE, 6) AS weight
FROM embeddings GROUP BY label""")
def _(t):
    return evaluate.class_weights(t.embeddings, "label").withColumn("weight", F.round("weight", 6))


@query("stratified_split", """
SELECT label, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM embeddings GROUP BY label""")
def _(t):
    split = training.stratified_split(t.embeddings.select("vec_id", "label"), "label", "vec_id")
    return split.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test")
    )


def hold_out(t, train):
    split = training.stratified_split(t.embeddings, "label", "vec_id")
    trained = train(split.filter(~F.col("is_test")).drop("is_test"))
    scored = trained.predict(split.filter("is_test"))
    judged = scored.select(F.col("label").cast("string").alias("gold"), "pred")
    return evaluate.class_report(judged, trained.classes)


@query("logreg_report")
def _(t):
    return hold_out(t, lambda rows: training.train_logreg(rows, "label"))


@query("svm_report")
def _(t):
    return hold_out(t, lambda rows: training.train_svm(rows, "label", "vec_id"))
