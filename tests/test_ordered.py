from pyspark.sql import functions as F

from leafwork.operators import ordered as O


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols[:2]).collect()]


def test_islands_and_carry(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["", "x", "", "", "y"])] + [("b", 0, "z")], "d string, i int, v string")
    assert rows(O.islands(df, ["d"], ["i"], F.col("v") == ""), "d", "i", "island") == [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 3), ("b", 0, 0)]
    v = F.nullif("v", F.lit(""))
    assert [r[2] for r in rows(O.carry_forward(df, ["d"], ["i"], v, "c"), "d", "i", "c")] == [None, "x", "x", "x", "y", "z"]
    assert [r[2] for r in rows(O.carry_forward(df, ["d"], ["i"], v, "c", exclusive=True), "d", "i", "c")] == [None, None, "x", "x", "x", None]


def test_numbers_reset_at_given_ones(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, None, 7, None, 3, None])], "d string, i int, v int")
    assert [r[2] for r in rows(O.carry_number(df, ["d"], ["i"], F.col("v")), "d", "i", "number")] == [1, 2, 7, 8, 3, 4]


def test_ranges_pager_suffixes(spark):
    df = spark.createDataFrame([("a", 0), ("a", 4), ("b", 2)], "d string, i int")
    assert rows(O.ranges(df, ["d"], "i", F.lit(9)), "d", "i", "until") == [("a", 0, 3), ("a", 4, 9), ("b", 2, 9)]
    assert rows(O.pager(df, ["d"], ["i"], "i"), "d", "i", "previous", "following") == [("a", 0, None, 4), ("a", 4, 0, None), ("b", 2, None, None)]
    assert [r[1] for r in rows(O.suffix_repeats(df.withColumn("n", F.monotonically_increasing_id()), "d", ["i"], "x"), "i", "x")] == ["a", "b", "a-2"]


def test_running_distinct_and_ranks(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "y", "x", None, "z", "z"])], "d string, i int, v string")
    assert [r[2] for r in rows(O.running_distinct(df, ["d"], ["i"], "v", "n"), "d", "i", "n")] == [0, 1, 2, 2, 2, 3]
    df = spark.createDataFrame([("a", "p", 3), ("a", "q", 3), ("a", "r", 1)], "d string, k string, v int")
    assert rows(O.shared_rank(df, ["d"], "v", ["k"]), "d", "k", "cote", "spread") == [("a", "p", 2, -7.5), ("a", "q", 2, 7.5), ("a", "r", 1, 0.0)]


def test_fences(spark):
    text = ["a", "::: {lang=oc}", "b", ":::", "c", "::: {.x}", "d"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "d string, i int, line string")
    assert [r[2] for r in rows(O.fenced(df, ["d"], ["i"], "line"), "d", "i", "inside")] == [False, False, True, False, False, False, True]


def test_positional_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "d string, i int")
    right = spark.createDataFrame([("a", 9), ("a", 8), ("b", 1), ("b", 2)], "d string, j int")
    assert rows(O.zip_by_rank(left, right, ["d"], ["i"], ["j"]), "d", "i", "j") == [("a", 1, 8), ("a", 2, 9), ("b", 1, 1)]
    assert rows(O.zip_by_rank(left, right, ["d"], ["i"], ["j"], only_equal=True), "d", "i", "j") == [("a", 1, 8), ("a", 2, 9)]
    # Labels are paired in the order of their text: 10 comes before 2; a repeated reference counts twice.
    dangling = spark.createDataFrame([("v", 1, x) for x in ("2", "10", "2")], "v string, p int, label string")
    orphans = spark.createDataFrame([("v", 2, x) for x in ("7", "1")] + [("v", 4, "3")], "v string, p int, label string")
    assert rows(O.overflow_pairs(dangling, orphans, ["v"], "p", "label"), "label", "next_label") == [("10", "1"), ("2", "7")]


def test_headings_and_healing(spark):
    df = spark.createDataFrame([("a", i, *x) for i, x in enumerate([("I", None), (None, "A"), (None, None), ("II", None), (None, None)])], "d string, i int, h1 string, h2 string")
    got = rows(O.headings_cursor(df, ["d"], ["i"], [F.col("h1"), F.col("h2")]), "d", "i", "level1", "level2")
    assert [g[2:] for g in got] == [("I", None), ("I", "A"), ("I", "A"), ("II", None), ("II", None)]
    pages = spark.createDataFrame([("a", 1, "le manus-"), ("a", 2, "crit suit la tra-"), ("a", 3, "dition."), ("a", 4, "fin-")], "d string, i int, t string")
    assert [r[2] for r in rows(O.heal_words(pages, ["d"], "i", "t"), "d", "i", "healed")] == ["le manuscrit", "suit la tradition.", "", "fin-"]
