from pyspark.sql import functions as F

from leafwork.llm.matching import Rule, cascade, rule_precision, titles_agree

SCHEMA = "id string, author string, surname string, given string, title string, year int, pages string, to string, rule string"


def test_titles():
    full = "Dictionnaire de la poésie lyrique à Rondec, avec un glossaire"
    for other in ("DICTIONNAIRE DE LA POÉSIE LYRIQUE À RONDEC, AVEC UN GLOSSAIRE", "Dict. de la poés. lyr. à Ron. avec un glo.", "Dictionnaire de la poésie...", "Dictionnaire de la poesie lyrique a Ro", "Dictionnaire de la poésie (...)", "Dictionnaire de la poésie lyirque à Rondec"):
        assert titles_agree(full, other) and titles_agree(other, full), other
    for other in ("Histoire de la poésie lyrique à Rondec", "Dictionnaire de la cour à Rondec", "", "...", "Dictionnaire de la poésie lyrique à Taldoc, avec un glossaire"):
        assert not titles_agree(full, other), other


def test_cascade(spark):
    rules = [Rule("title year", (F.array("title"), F.array("year")), ("pages",)), Rule("title", (F.array("title"),), ("pages",)), Rule("author", (F.array("author"),), ("pages",))]
    targets = spark.createDataFrame([("A", "x", "x", "j.", "les voix du nord", 1900, "9", "", ""), ("B", "x", "x", "", "les voix du sud", 1910, "8", "", ""), ("C", "y", "y", "ida", "les voix du nord", None, None, "", "")], SCHEMA)
    rows = [
        ("1", "x", "x", "joseph", "les voix du nord", 1901, "9", "", ""), ("2", "x", "x", "joseph", "les voix du nord", 1900, "9", "", ""), ("3", "y", "y", "i.", "les voix du nord", 1950, "7", "", ""), ("4", "x", "x", None, "les voi. du sud", None, "1", "", ""),
        ("5", "x", "x", "ida", "les voix du nord", 1900, "9", "", ""), ("6", None, None, None, "les voix du nord", None, None, "", ""), ("2", "x", "x", "joseph", "les voix du nord", 1900, "9", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = cascade(df, targets, rules)
    got = {r.id: (r.to, r.rule) for r in found.collect()}
    assert got == {"2": ("A", "title year"), "1": ("A", "title"), "3": ("C", "title"), "4": ("B", "author")}
    assert cascade(df.limit(0), targets, rules).count() == 0 and cascade(df, targets.limit(0), rules).count() == 0
    right = {(r.rule, r.grade): r.precision for r in rule_precision(found, df.dropDuplicates(["id"]).withColumn("g", F.lit("high")), targets, rules, "g").collect()}
    # One of one right, the rule's share (1 + 1) / (1 + 2), smoothed by two matches of it.
    assert abs(right["title year", "high"] - (1 + 2 * 2 / 3) / 3) < 1e-9
    assert right["author", "high"] < 0.5
