import pytest
from pyspark.sql import functions as F

from leafwork.functions import text as T

CASES = [
    (lambda c: T.fold_key(c), "L'École, 2e éd.", "lecole2eed"),
    (lambda c: T.squeeze(c), "  a \n b\t c ", "a b c"),
    (lambda c: T.short_title(c), "*Le vers long*, suivi d'un index", "Le vers long"),
    (lambda c: T.short_title(c, 12), "Le dictionnaire de la rime", "Le…"),
    (lambda c: T.acronym(c), "Revue d'histoire de la langue", "RHL"),
    (lambda c: T.upper_share(c), "ABcd 12", 0.5),
    (lambda c: T.upper_share(c), "12", None),
    (lambda c: T.balanced_quotes(c), 'un "mot" et "', False),
    (lambda c: T.strip_tags(c), "<b>vers</b> <i/>x", "vers x"),
    (lambda c: T.strip_marks(c), "*vers*[^3] [u]{.x}", "vers u"),
    (lambda c: T.surname_key(c), "Jean MORDÂC", "mordac"),
    (lambda c: T.last_capitals(c), "MORDAC, Jean TAUBERIN", "TAUBERIN"),
    (lambda c: T.last_capitals(c), "jean", None),
    (lambda c: T.title_case(c), "JEAN DE MORDAC", "Jean de Mordac"),
    (lambda c: T.superscript(c), "XII^e^ s.", "XII<sup>e</sup> s."),
    (lambda c: T.unique_locator(c), "p. 4 et pp. 4", "4"),
    (lambda c: T.unique_locator(c), "p. 4 et p. 5", None),
    (lambda c: T.locator_type(c), "pp. 4 et p.5", "p.\u202f4 et p.\u202f5"),
    (lambda c: F.array_join(T.split_references(c), "|"), "A, p. 4. B, 1901]. C", "A, p. 4|B, 1901]|C"),
    (lambda c: F.array_join(T.split_witnesses(c), "|"), "A 3, f. 2; C2 4, D 5", "A 3, f. 2|C2 4|D 5"),
    (lambda c: T.label_tail(c), "v1p003-12", "12"),
    (lambda c: T.url_quote(c), "N² a", "N%C2%B2%20a"),
    (lambda c: F.array_join(T.split_top(c), "|"), "a, b (c, d), e", "a|b (c, d)|e"),
    (lambda c: F.array_join(T.expand_optional(c), "|"), "am(o)r(s)", "amor|amors|amr|amrs"),
    (lambda c: T.common_prefix(c, F.lit("amors")), "amistat", 2),
    (lambda c: T.common_prefix(c, F.lit("x")), "amistat", 0),
    (lambda c: T.from_roman(c), "XXXIX", 39),
    (lambda c: T.from_roman(c), "xi", None),
    (lambda c: T.attributes(c)["keys"]["lang"], "::: {.verse lang=oc}", "oc"),
    (lambda c: T.attributes(c)["classes"][0], "::: {.verse lang=oc}", "verse"),
    (lambda c: T.outside_tags(c, F.upper), "<i>ab</i>c", "<i>AB</i>C"),
    (lambda c: T.replace_nth(c, "x", F.array(F.lit("1"), F.lit("2"))), "axbxcx", "a1b2cx"),
    (lambda c: T.is_heading(c), "LES VOIX II", True),
    (lambda c: T.is_heading(c), "Les voix", False),
    (lambda c: T.ends_sentence(c), "la fin. »[^2]", True),
    (lambda c: T.ends_sentence(c), "la suite", False),
    (lambda c: T.line_kind(c), "[^1]: note", "definition"),
    (lambda c: T.line_kind(c), "---", "rule"),
    (lambda c: T.line_kind(c), " + ", "star"),
]


@pytest.fixture(scope="module")
def answers(spark):
    cols = [f(F.lit(t)).alias(f"c{i}") for i, (f, t, _) in enumerate(CASES)]
    none = [f(F.lit(None).cast("string")).alias(f"n{i}") for i, (f, _, _) in enumerate(CASES)]
    return spark.range(1).select(*cols, *none).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(answers, i):
    assert answers[f"c{i}"] == CASES[i][2]


def test_roman_numbers_round_trip(spark):
    df = spark.range(1, 400).select("id", T.to_roman(F.col("id")).alias("r"))
    assert df.where(T.from_roman(F.col("r")) != F.col("id")).count() == 0
    assert df.where("id IN (4, 9, 39, 90, 399)").orderBy("id").select("r").collect() == [("IV",), ("IX",), ("XXXIX",), ("XC",), ("CCCXCIX",)]
