from pyspark.sql import functions as F

from leafwork.llm.matching import Rule, cascade, same_works
from leafwork.llm.matching_queries import p5_found

SCHEMA = "id string, author string, surname string, given string, title string, year int"


def test_spellings_of_one_work(spark):
    title = "The songs of the poetic school at Vindan"
    rows = [
        ("a", "x", "x", "guy", f"{title}, with a gloss.", 1935), ("b", "x", "x", "g.", f"{title}, with a glossaay", 1935), ("c", "y", "y", "guy", f"{title}, with a glossary", 1935), ("d", "x", "x", "guy", "The court", 1935),
        ("e", "z", "z", "ida", "Les voix du nord", 1900), ("f", "z", "z", "ida", "Les voix...", 1900), ("g", "z", "z", "ida", "Les voix du soleil", 1900), ("h", "x", "x", "guy", f"{title}, with a glossary", 1960),
    ]
    got = {r.id: r.work for r in same_works(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: "a" if k in "ab" else k for k in "abcdefgh"}
    cards = spark.createDataFrame([("1", "x", "x", "guy", f"{title}, with a glossary", 1935)], SCHEMA)
    rules = [Rule("author year", (F.array("author"), F.array("year")), ("pages",))]
    apart = spark.createDataFrame([rows[0], rows[1]], SCHEMA)
    assert cascade(cards, apart, rules).count() == 0
    assert [(r.id, r.to) for r in cascade(cards, apart.withColumn("id", F.lit("a")), rules).collect()] == [("1", "a")]


def test_a_card_keeps_the_records_of_every_spelling(spark, tmp_path):
    title = "The songs of the poetic school at Vindan"
    entry = "section string, author string, title string, page int"
    tables = {
        "citations": ([(k, f"BRAULDAC, Guillaume, *{title}, with a {end}*, Paris, 1935.", None, "high") for k, end in ((5034, "gloss."), (5085, "glossaay"))], f"rec_id long, definition string, bibliography struct<{entry}>, confidence string"),
        "bibliography_entry": ([(1, "RUNSAC, Paul", "Les voix du nord", "- RUNSAC, Paul, *Les voix du nord*, Paris, 1900.")], "entry_id long, author string, title string, text string"),
        "library_records": ([(303, "Brauldac, Guillaume", f"{title}, with a glossary", "Paris, 1935", None), (304, "Brauldac, Guillaume", f"{title}, with a gloss.", "Paris, 1935", None)], "lib_id long, heading string, title_line string, imprint string, extent string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, p5_found(spark, str(tmp_path)).collect())) == [(5034, 303), (5034, 304), (5085, 303), (5085, 304)]
