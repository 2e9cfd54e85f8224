import pytest
from pyspark.sql import functions as F

from sightline.functions.text import input_text, xml_record
from sightline.operators import classify, evaluate, training
from sightline.plans import QUERIES
from sightline.sources.sinks import write_report
from sightline.vocab import CATEGORIES, MALFORMED

BLOCK = "<classification>\n  <category>{}</category>\n  <confidence>{}</confidence>\n</classification>"

ANSWERS = [
    (BLOCK.format("Movies", "0.98"), ("Movies", 0.98)),
    ("```xml\n" + BLOCK.format("Television", "0.90") + "\n```", ("Television", 0.9)),
    ("```XML " + BLOCK.format("Games", ".5") + "```", ("Games", 0.5)),
    ("Here you are:\n" + BLOCK.format("Music", "0.85") + "\nDone.", ("Music", 0.85)),
    (BLOCK.format("Nothing", "0.90"), None),
    (BLOCK.format("TV", "0.90"), None),
    (BLOCK.format("Movies", "1.5"), None),
    (BLOCK.format("Movies", "-0.1"), None),
    (BLOCK.format("Movies", "high"), None),
    ("not xml at all", None),
    ("", None),
    (None, None),
    (BLOCK.format("Other", "0.0"), ("Other", 0.0)),
    ("<classification><category> Anime </category><note/><confidence>\t1e-1</confidence></classification>", ("Anime", 0.1)),
    ("<answer><category>Movies</category><confidence>0.5</confidence></answer>", None),
    ("so: <category> Music </category> and <confidence>0.25</confidence>, cut", ("Music", 0.25)),
    ("<category>Music</category><confidence>0.2.5</confidence>", None),
    ("a " + BLOCK.format("Bad & worse", "0.5") + " <category>Games</category>", ("Games", 0.5)),
    ("a " + BLOCK.format("Nope", "0.5") + BLOCK.format("Games", "0.5"), None),
    (BLOCK.format("Movies", "0.123456"), ("Movies", 0.1235)),
    ("<classification><category>Mov&#105;es</category><confidence>0.5</confidence></classification>", ("Movies", 0.5)),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, raw string")
    got = {r.i: r for r in classify.parse_answers(df, "raw").collect()}
    for i, (_, expected) in enumerate(ANSWERS):
        row = got[i]
        if expected:
            assert (row.category, row.confidence, row.parse_status) == (*expected, "success"), i
        else:
            assert (row.category, row.confidence, row.parse_status) == ("Other", 0.0, "parse_fail"), i


def test_alias_and_every_category(spark):
    names = [*CATEGORIES, "TV"]
    df = spark.createDataFrame([(c, BLOCK.format(c, "0.50")) for c in names], "c string, raw string")
    found = classify.parse_answers(df, "raw", {"TV": "Television"})
    got = {r.c: r.category for r in found.collect()}
    assert got == {**{c: c for c in CATEGORIES}, "TV": "Television"}


def record(spark, name, files, **options):
    df = spark.createDataFrame([(name, files)], "n string, f array<string>")
    return df.select(
        xml_record(F.lit("abcd"), F.col("n"), F.lit(3), F.lit(9), F.col("f"), **options).alias("x")
    ).first().x


def test_record_escapes_after_cutting(spark):
    assert "<name>a &lt;b&gt; &amp; &quot;c&quot; &apos;d&apos;</name>" in record(spark, "a <b> & \"c\" 'd'", [])
    assert "<name>ab&amp;</name>" in record(spark, "ab&cdef", [], max_name=3)
    assert record(spark, "x", [f"f{i}" for i in range(50)], max_files=5).count("<file>") == 5
    assert "<files>\n\n  </files>" in record(spark, "x", None)


def test_input_text(spark):
    df = spark.createDataFrame([("n" * 400, ["d" * 200] * 12), (None, None)], "n string, d array<string>")
    a, b = [r.x for r in df.select(input_text(F.col("n"), F.lit(2), F.lit(None), F.col("d")).alias("x")).collect()]
    assert a == "Name: " + "n" * 300 + "\nFiles: 2  Size: 0\nTop dirs: " + ", ".join(["d" * 100] * 10)
    assert b == "Name: \nFiles: 2  Size: 0\nTop dirs: "


def test_messages(spark):
    row = spark.range(1).select(
        classify.messages("be brief", [("q", "a")], F.lit("<r/>"), retry=True).alias("m")
    ).first()
    assert [m.role for m in row.m] == ["system", "user", "assistant", "user"]
    assert row.m[0].content.startswith("be brief\nYou must output exactly one XML block.")
    assert row.m[3].content.endswith("\n<r/>")


def test_anchor_blocks_give_the_same_result(spark, monkeypatch):
    import random

    rng = random.Random(4)
    vector = lambda: [rng.randrange(-8, 9) / 8 for _ in range(6)]
    items = spark.createDataFrame([(i, vector()) for i in range(50)], "i long, embedding array<float>")
    rows = [(f"c{n % 5}", vector(), n) for n in range(23)]
    anchors = spark.createDataFrame(rows, "category string, embedding array<float>, place long")

    def result():
        scored = classify.anchor_scores(items, anchors, "i", order="place", top=3)
        return {r.i: [(c.category, c.confidence) for c in r.candidates] for r in scored.collect()}

    whole = result()
    monkeypatch.setattr(classify, "ANCHOR_BLOCK_BYTES", 8 * 6 * 4)
    parts = result()
    best = {}
    for i, v in ((r.i, r.embedding) for r in items.collect()):
        dots = [(sum(a * b for a, b in zip(v, w)), -n, c) for c, w, n in rows]
        per = {c: max(d for d in dots if d[2] == c) for c in {d[2] for d in dots}}
        best[i] = [(c, s) for s, _, c in sorted(per.values(), reverse=True)[:3]]
    assert whole == best
    assert parts == best


def test_items_without_a_vector_fall_back(spark):
    nan = float("nan")
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, []), (3, None), (4, [nan, 1.0]), (5, [None, 1.0])], "i long, embedding array<float>")
    anchors = spark.createDataFrame([("Games", [1.0, 0.0], 0)], "category string, embedding array<float>, place long")
    scored = classify.anchor_scores(items, anchors, "i", order="place")
    rows = classify.cascade(scored, anchor=F.try_element_at("candidates", F.lit(1))).collect()
    assert {r.i: (r.category, r.confidence, r.method) for r in rows} == {
        1: ("Games", 1.0, "anchor"), **dict.fromkeys([2, 3, 4, 5], ("Other", 0.0, "fallback"))}


def test_rounding_is_that_of_the_binary_value(spark):
    import random
    from decimal import Decimal

    from sightline.functions.text import human_number
    from sightline.functions.vectors import rounded

    rng = random.Random(3)
    values = [n / 100_000 for n in range(5, 100_000, 10)] + [rng.random() for _ in range(2000)]
    values += [-0.00035, 0.5, 0.03125, 0.09375, 1e-9, 1e18, 12345.00005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.x for r in df.select(rounded(F.col("v")).alias("x")).collect()] == [round(v, 4) for v in values]
    sizes = list(range(1000, 20_000, 10)) + [1_250_000, 1_450_000, 1_750_000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    for n, got in zip(sizes, [r.x for r in df.select(human_number(F.col("n")).alias("x")).collect()]):
        scaled = Decimal(n / 1e6) if n >= 10**6 else Decimal(n / 1e3)
        assert Decimal(got[:-1]) == scaled.quantize(Decimal("0.1"), "ROUND_HALF_UP"), n


def test_plain_and_xml_answers_round_alike(spark):
    plain = BLOCK.format("Movies", "0.00035")
    df = spark.createDataFrame([(plain,), ("so: " + plain,), (plain.replace("Movies", "Mov&#105;es"),)], "raw string")
    assert {r.confidence for r in classify.parse_answers(df, "raw").collect()} == {round(0.00035, 4)}


def test_cascade_thresholds(spark):
    kind = "array<struct<category:string,confidence:double>>"
    df = spark.createDataFrame(
        [([("Games", 0.6)], [("Music", 0.9)]), ([("Games", 0.59)], [("Music", 0.5)]),
         ([("Games", 0.59)], [("Music", 0.49)]), ([], [])], f"l {kind}, a {kind}",
    )
    rows = classify.cascade(df, linear=F.col("l"), anchor=F.try_element_at("a", F.lit(1))).collect()
    assert [(r.category, r.confidence, r.method) for r in rows] == [
        ("Games", 0.6, "linear"), ("Music", 0.5, "anchor"), ("Other", 0.0, "fallback"), ("Other", 0.0, "fallback"),
    ]


def test_evaluation(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("Games", "Games"), ("Games", "Music"), ("Music", MALFORMED), ("", "Games"), (MALFORMED, "Games")],
        "gold string, pred string",
    )
    report = {r.category: r for r in evaluate.class_report(pairs).collect()}
    assert set(report) == {"Games", "Music"}
    assert (report["Games"].precision, report["Games"].recall) == (0.5, 0.5)
    assert (report["Music"].f1, report["Music"].support) == (0.0, 1)
    s = evaluate.eval_summary(pairs).first()
    assert (s.total, s.evaluated, s.correct, s.accuracy, s.macro_f1) == (5, 4, 1, 0.25, 0.25)
    write_report(evaluate.report_frames(pairs), str(tmp_path))
    read = spark.read.json(f"{tmp_path}/summary/json").first()
    assert (read.correct, read.evaluated, read.accuracy) == (1, 4, 0.25)
    assert spark.read.option("header", True).csv(f"{tmp_path}/classes/csv").count() == 2
    rows = {r.gold: r for r in spark.read.json(f"{tmp_path}/confusion/json").collect()}
    assert (rows["Games"].Games, rows["Games"].Music, rows["Music"].MALFORMED) == (1, 1, 1)
    assert set(rows) == set(CATEGORIES)


def test_last_row_of_a_key_counts(spark):
    labels = spark.createDataFrame([("a", "Games", 1), ("a", "Music", 2)], "key string, gold string, n int")
    preds = spark.createDataFrame([("a", "Music", 1), ("a", "Games", 2)], "key string, category string, n int")
    row, = evaluate.judged(labels, preds, "key", order="n").collect()
    assert (row.gold, row.pred) == ("Music", "Games")


@pytest.fixture(scope="module")
def clusters(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(180):
        label = i % 3
        rows.append((i, f"c{label}", [(3.0 if j == label else 0.0) + rng.gauss(0, 0.5) for j in range(4)]))
    return spark.createDataFrame(rows, "id long, label string, embedding array<double>")


@pytest.mark.parametrize("algorithm", ["logreg", "svm"])
def test_training_learns_and_survives_saving(spark, clusters, algorithm, tmp_path):
    if algorithm == "logreg":
        model = training.train_logreg(clusters, "label", max_iter=20)
    else:
        model = training.train_svm(clusters, "label", "id", max_iter=5, folds=2)
    path = training.save(model, spark, str(tmp_path))
    assert algorithm in path
    again = training.load(spark, path)
    rows = again.predict(clusters).select("label", "pred", "linear").collect()
    assert sum(r.label == r.pred for r in rows) > 170
    assert abs(sum(c.confidence for c in rows[0].linear) - 1) < 1e-6
    first = model.predict(clusters).select("pred").collect()
    assert [r.pred for r in first] == [r.pred for r in rows]


def test_svm_iterations_are_not_cut(spark, clusters, monkeypatch):
    limits = []

    def watched(kind):
        return lambda **settings: limits.append(settings["maxIter"]) or kind(**settings | {"maxIter": 3})

    for name in ("LinearSVC", "LogisticRegression"):
        monkeypatch.setattr(training, name, watched(getattr(training, name)))
    training.train_svm(clusters, "label", "id", folds=2)
    assert limits == [2000] * 12

    class Reached(Exception):
        pass

    def train(*_, **settings):
        raise Reached(settings.get("max_iter"))

    monkeypatch.setattr(training, "train_svm", train)
    with pytest.raises(Reached, match="None"):
        QUERIES["svm_report"](spark, "/root/testdata/sf0.001")
