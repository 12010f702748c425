import random

from pyspark.sql import functions as F

from leafwork.operators import apparatus as A
from leafwork.operators import match as M
from leafwork.operators.concordance import in_context, inverted_index


def test_best_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 9, 0)], "g string, k int, s int")
    assert {tuple(r) for r in M.best(df, ["g"], [F.col("s")], [F.col("k")], ["k", "s"]).collect()} == {("a", 2, 7), ("b", 9, 0)}


def test_range_join_against_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice("xy"), rng.randrange(100)) for _ in range(60)]
    spans = [(rng.choice("xy"), lo, lo + rng.randrange(-2, 30)) for lo in (rng.randrange(90) for _ in range(30))]
    p, s = spark.createDataFrame(points, "g string, at int"), spark.createDataFrame(spans, "g string, lo int, hi int")
    for width in (1, 7, 200):
        got = sorted(tuple(r) for r in M.range_join(p, s, "at", "lo", "hi", width, ["g"]).select("g", "at", "lo", "hi").collect())
        assert got == sorted((g, a, lo, hi) for g, a in points for h, lo, hi in spans if g == h and lo <= a <= hi)


def test_anti_joins(spark):
    p = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "g string, at int")
    s = spark.createDataFrame([("a", 3, 9)], "g string, s int, e int")
    assert sorted(map(tuple, M.outside_spans(p, s, ["g"], "at", "s", "e").collect())) == [("a", 1), ("a", 9), ("b", 5)]
    assert sorted(map(tuple, M.not_near(p, s.select("g", F.col("s").alias("at")), ["g"], "at", 2).collect())) == [("a", 9), ("b", 5)]
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "g string, k int")
    assert sorted(map(tuple, M.multiset_difference(left, left.where("k = 2"), ["k"]).collect())) == [(1, "a"), (1, "a")]


def test_cascade_overlay_upsert(spark):
    base = spark.createDataFrame([("p1", "old"), ("p2", "old"), ("p3", None)], "id string, t string")
    over = spark.createDataFrame([("p2", None), ("p9", "new")], "id string, t string")
    assert sorted(map(tuple, M.overlay(base, over, "id", ["t"]).collect())) == [("p1", "old", "base"), ("p2", None, "overlay"), ("p3", None, "base")]
    got = M.cascade_lookup(base.select("id"), [("one", over.na.fill("x"), ["id"], "t"), ("two", base, ["id"], "t")], "v", "none")
    assert sorted(map(tuple, got.collect())) == [("p1", "old", "two"), ("p2", "x", "one"), ("p3", None, "none")]
    got = M.upsert_curated(base, over.withColumn("note", F.lit("c")), spark.createDataFrame([("p9",)], "id string"), "id")
    assert {r.id for r in got.collect()} == {"p1", "p2", "p3", "p9"} and got.columns == ["id", "t", "note"]
    a, b = F.lit("RHL"), F.lit("RH")
    assert spark.range(1).select(M.prefixes_agree(a, b), M.prefixes_agree(a, F.lit("R")), M.shared_letters(F.lit("abca"), F.lit("cab"))).first() == (True, False, 3)


def test_notes(spark):
    pages = spark.createDataFrame([("p", "mot[^1] et[^2] et[^1]\r\n[^1]: note[^9]\n[^3]: x")], "f string, body string")
    marks = A.note_marks(A.lines(pages, ["f"], "body"), ["f"])
    assert sorted((r.label, r.fault) for r in A.residual(marks, ["f"]).collect()) == [("2", "dangling"), ("3", "orphan"), ("9", "dangling")]
    assert marks.where("is_definition").count() == 2


EVENTS = [
    ("d", 1, "bare", None, None), ("d", 2, "full", "MORDAC", "Voix"), ("d", 3, "named", "Mordac", None), ("d", 4, "full", "MORDAC", "Pas"), ("d", 5, "named", "MORDAC", None), ("d", 6, "bare", None, None), ("d", 7, "named", "X", None),
    ("e", 1, "named", "MORDAC", None),
]


def test_back_references(spark):
    df = spark.createDataFrame(EVENTS, "doc string, seq long, kind string, author string, title string")
    want = {("d", 1): (None, "unresolved"), ("d", 3): ("Voix", "high"), ("d", 5): ("Pas", "medium"), ("d", 6): ("Pas", "low"), ("d", 7): (None, "unresolved"), ("e", 1): (None, "unresolved")}
    for got in (A.back_references(df, "doc"), A.back_references_exact(df)):
        assert {(r.doc, r.seq): (r.target_title, r.confidence) for r in got.collect()} == want
    more = spark.createDataFrame([*EVENTS[:2], ("d", 3, "full", "SOUREL", "Airs"), ("d", 4, "named", "MORDAC", None), ("d", 5, "id", None, None)], df.schema)
    assert {r.seq: r.target_title for r in A.back_references_exact(more).collect()}[5] == "Voix"


def test_word_index(spark):
    df = spark.createDataFrame([(1, "Le vers, le mot."), (2, "Vers"), (3, None)], "k int, t string")
    assert {(r.word, r.uses, r.places) for r in inverted_index(df, "k", "t").collect()} == {("le", 2, 1), ("vers", 2, 2), ("mot", 1, 1)}
    assert [tuple(r) for r in in_context(df, "k", "t", F.col("word") == "mot").collect()] == [(1, 3, "mot", "vers le", "")]
