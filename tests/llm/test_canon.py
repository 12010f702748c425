import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from leafwork.llm.canon import SUSPECT, _normal, alike_classes, alike_pairs, canonical, fingerprints

ALPHABET = "aeoνοА̧́­​ﬁｅé—-   \nçщῳ가"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(ALPHABET), st.text()))
def test_splicing_equals_normalizing_all(text):
    whole = _normal(text)
    assert canonical(text) == whole
    assert canonical(whole) == whole


def test_what_shows_and_what_does_not():
    assert canonical("ｆｉｎ d'​un") == "fin d'un"
    assert canonical("éte­") == "éte"
    assert canonical("Тоut ﬁnit‑là") == "Tout finit-là"
    assert canonical("été") != canonical("ete")
    assert canonical("a\nb") != canonical("a b")
    assert canonical("a—b") != canonical("a-b")
    assert canonical("Œuvre") == "Œuvre" and canonical("x²") == "x²"
    assert canonical("e​́") == "é"


def test_texts_without_suspects_are_canonical():
    import re

    suspect = re.compile(SUSPECT.replace("\\\\", "\\"))
    passed = "".join(chr(c) for c in range(0x20, 0x3000) if not suspect.match(chr(c)))
    assert canonical(passed) == passed == unicodedata.normalize("NFC", passed)


def test_pairs_against_brute_force(spark):
    texts = [("1", "fin"), ("2", "ﬁn"), ("3", "fin"), ("4", "ｆin"), ("5", "Fin"), ("6", None), ("7", ""), ("8", "​"), ("9", "ﬁn"), ("2", "ﬁn"), ("10", "x" * 100_000), ("11", "х" * 100_000)]
    df = spark.createDataFrame(texts, "id string, text string").withColumnRenamed("id", "key")
    got = {tuple(r) for r in alike_pairs(fingerprints(df, "t", df["key"], df["text"])).collect()}
    rows = {k: t for k, t in texts if t is not None}
    want = {("t", *sorted((a, b))) for a, b in combinations(rows, 2) if rows[a] != rows[b] and _normal(rows[a]) == _normal(rows[b])}
    assert got == want and len(want) == 10
    assert alike_pairs(fingerprints(df.limit(0), "t", df["key"], df["text"])).count() == 0


def test_classes_of_texts_that_print_alike(spark):
    rows = [(1, "café", "x"), (2, "cafe\u0301", "x"), (3, "café", "x"), (3, "café", "x"), (4, "cafe", "x"), (5, None, "x"), (6, "", "x")]
    prints = fingerprints(spark.createDataFrame(rows, "id long, text string, canon string"), "t", F.col("id"), F.col("text"))
    got = [(r.key, r.spellings) for r in alike_classes(prints).orderBy("key").collect()]
    assert got == [("1", 2), ("2", 2), ("3", 2)] and alike_classes(prints).select("class_id").distinct().count() == 1
    assert alike_classes(prints.limit(0)).count() == 0
