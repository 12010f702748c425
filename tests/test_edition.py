"""Rules of the edition's texts, one by one, and the operators on remarks."""

import pytest
from pyspark.sql import functions as F

from leafwork.functions import edition as E
from leafwork.functions.rules import replaced, spots
from leafwork.operators.lemmas import lemma_anchors, lemma_quotes, lemma_segments, verse_marks
from leafwork.operators.match import salted_join
from leafwork.plans.verses import mark_rank, references
from leafwork.sources.pages import isolated

N = "\u202f"
CASES = [
    (lambda c: E.typography(c), "Quoi ? « oui » - non:  si[^2^]", f"Quoi{N}? «{N}oui{N}» — non: si[^2]"),
    (lambda c: E.typography(c), "RO - BN et a - b", "RO - BN et a — b"),
    (lambda c: E.typography(c, False), "dos  vers ;", f"dos  vers{N};"),
    (lambda c: replaced(c, E.ASTERISMS), "a\n+\n\n+\n\nb", "a\n\n⁂\n\nb"),
    (lambda c: E.page_kind(c, F.lit("v1p020"), F.lit("")), "CHANSON IV : TEXTE\n\nBen", "chanson-texte"),
    (lambda c: E.page_kind(c, F.lit("v1p020"), F.lit("")), "<!-- page: v1p020 -->\n\n[CHANSON I ]{.underline} : REMARQUES", "chanson-remarques"),
    (lambda c: E.page_kind(c, F.lit("v1p003"), F.lit("")), "I N T R O D U C T I O N", "introduction"),
    (lambda c: E.page_kind(c, F.lit("v1p003"), F.lit("")), "INDEXATION", "front-matter"),
    (lambda c: E.page_kind(c, F.lit("v1p030"), F.lit("")), "x" * 80 + "INDEX", "plate-or-divider"),
    (lambda c: E.page_kind(c, F.lit("v1p030"), F.lit("12")), "le vers", "body"),
    (lambda c: E.index_kind(c), "I N D E X des M O T S", "index-mots"),
    (lambda c: E.index_kind(c), "INDEX", "index-noms"),
    (lambda c: E.is_siglum(c), "Mot", True), (lambda c: E.is_siglum(c), "ZPBa", True), (lambda c: E.is_siglum(c), "Motif", False), (lambda c: E.is_siglum(c), "C.R.", False), (lambda c: E.is_siglum(c), "P.-C.", True),
    (lambda c: E.opens_author(c), "MOURCEL, J., C.R. de RO", True), (lambda c: E.opens_author(c), "Le vers, suivi", False), (lambda c: E.opens_author(c), "[GRIL]{.underline}, Elisa", True),
    (lambda c: E.is_terminal(c), "la fin (30)", False), (lambda c: E.is_terminal(c), "la fin (ibid.)[^2]", True),
    (lambda c: E.mergeable(c, F.lit("Linda M.")), "par Mme", True), (lambda c: E.mergeable(c, F.lit("CHANSON II")), "par Mme", False),
    (lambda c: E.heading_letters(c), "<b>Index des œuvres</b>", "INDEXDESOEUVRES"),
    (lambda c: E.clean_title(c), "*G É N É R A L I T É S*", "Généralités"), (lambda c: E.clean_title(c), "Etudes  du vers", "Études du vers"),
    (lambda c: replaced(c, E.QUOTES), "BRAC, 'L'art d'Italie', dans *RO*, X", 'BRAC, "L\'art d\'Italie", dans *RO*, X'),
    (lambda c: replaced(c, E.GLUED), "E.TAUPF et C.Runel", "E. TAUPF et C. Runel"),
    (lambda c: replaced(c, E.FENCE), "```md\n<!-- page: x -->\nle vers\n```\n", "le vers"),
    (lambda c: replaced(replaced(c, E.HANDS), E.CAESURA), "a   b [[hand: sic]]", 'a<span class="caesura"> </span>b <span class="hand">sic</span>'),
    (lambda c: E.head_words(c), "## [1. Sincérité]{.underline}  et", "1. sincérité et"),
    (lambda c: E.short_author(c), "Ugo Silvio ARVAL", "U. S. ARVAL"), (lambda c: E.short_author(c), "A.-M. KOLB et Jean DE RIQ", "A.-M. KOLB et J. DE RIQ"), (lambda c: E.short_author(c), "A. UN et B. DEUX et C. TROIS", "A. UN et al."), (lambda c: E.short_author(c), "Guilhem", "Guilhem"),
    (lambda c: E.entry_title(c), "'Le mot clef', dans *RO*", "Le mot clef"), (lambda c: E.match_title(c), "*Étude du vers.*", "etude du vers"),
    (lambda c: F.to_json(E.cited_points(c)), "dans *RO*, LX, (1932), pp. 3-30; puis pp. 40 — 45", '[{"vol":"LX","lo":3,"hi":30},{"lo":40,"hi":45}]'),
    (lambda c: E.title_score(c, F.lit("dizionarietto di lettere")), "dizionariettu", 5), (lambda c: E.title_score(c, F.lit("dizionarietto di lettere")), "dizionarietto", 6), (lambda c: E.title_score(c, F.lit("minneliederbuch")), "minne liederbuch", 6),
    (lambda c: E.title_score(c, F.lit("poesies provencales inedites")), "prov. ined.", 4), (lambda c: E.title_score(c, F.lit("provenzalische chrestomathie")), "prov. ined.", 0), (lambda c: E.title_score(c, F.lit("abc")), "abc", 0),
    (lambda c: E.with_locus(c, F.lit("II"), F.lit(248)), "MORD, *Choix*, Paris, 6 vols.", "MORD, *Choix*, Paris, vol. II, p. 248"), (lambda c: E.with_locus(c, F.lit(None).cast("string"), F.lit(4)), "X, XVI + 680 pp.", "X, p. 4"),
    (lambda c: E.printed_label(c, F.lit("5")), "3", "pp. 3–5"), (lambda c: E.printed_label(c, F.lit("3")), "3", "p. 3"),
    (lambda c: E.hanging_indent(c), "[MARC]{.underline} : 3, 4", 7), (lambda c: E.hanging_indent(c), "sans", 0),
    (lambda c: E.lemma_and_reference(c)["lemma"], "AMAIRE (se metre) XXV, 5", "AMAIRE (se metre)"), (lambda c: E.lemma_and_reference(c)["ref"], "COR (v. XX, 3) XXV, 5", "XXV, 5"), (lambda c: E.lemma_and_reference(c)["ref"], "COR", ""),
    (lambda c: mark_rank(c, F.lit("amor")), "amors", 504), (lambda c: mark_rank(c, F.lit("amor")), "amar", None), (lambda c: mark_rank(c, F.lit("amor")), "amor", 1004), (lambda c: mark_rank(c, F.lit("chantador")), "chantar", 6),
    (lambda c: E.rebuilt_table(c), "| a |  | |---|---| | 1 | 2 | |  | 4 |", "| a |  |\n| --- | --- |\n| 1 | 2 |\n|  | 4 |"), (lambda c: E.rebuilt_table(c), "| a | b | c |", None),
    (lambda c: E.witness_key(c, F.array(F.lit("N2"), F.lit("N"), F.lit("D"))), "[N^2^]{.underline}", "N2"), (lambda c: E.witness_key(c, F.array(F.lit("N"), F.lit("D"))), "*N2*", "N"), (lambda c: E.witness_key(c, F.array(F.lit("N"), F.lit("D"))), "d", None),
    (lambda c: F.to_json(spots(c, "[*][^*]+[*]")), "é *a* *a*", '[{"at":2,"found":"*a*"},{"at":6,"found":"*a*"}]'),
    (lambda c: E.siglum_short(F.lit("MORDAC"), c, F.lit("x")), "*Les voix*, suite", "Mordac, Les voix"),
]


@pytest.fixture(scope="module")
def answers(spark):
    cols = [f(F.lit(t)).alias(f"c{i}") for i, (f, t, _) in enumerate(CASES)]
    none = [f(F.lit(None).cast("string")).alias(f"n{i}") for i, (f, _, _) in enumerate(CASES)]
    return spark.range(1).select(*cols, *none).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(answers, i):
    assert answers[f"c{i}"] == CASES[i][2]


def test_references_of_an_index(spark):
    rows = [(1, 1, 1, "amor", "III, 27 ; V, 41, 42"), (1, 2, 1, "cor", "XXX, passim"), (1, 3, 1, "dos", "XXXVI, (14 x)"), (1, 4, 1, "en", "I, 9(a)"), (1, 5, 1, "fi", "XXX, 11 (v. XVIII, 63)")]
    got = [(r.lemma, r.song, r.label, r.verse) for r in references(spark.createDataFrame(rows, "doc_id long, no long, vol int, lemma string, ref string")).orderBy("no").collect()]
    assert sorted(got) == [("amor", "III", "27", 27), ("amor", "V", "41", 41), ("amor", "V", "42", 42), ("cor", "XXX", "passim", None), ("dos", "XXXVI", "14 ×", None), ("en", "I", "9(a)", 9), ("fi", "XXX", "11", 11)]


def test_remarks(spark):
    text = ["CHANSON I : REMARQUES", "CHANSON I : REMARQUES[^1]", "tête", "", "v.4", "", "un mot", "v. 5 dans le texte", "", "[vv.6-9]{.underline}", "", "deux", "", "v. 4 sv.", "<!-- page: v1p002 -->", "trois"]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "song string, no int, line string")
    rows = lemma_segments(lines, ["song"], "no", "line").where("trim(line) <> ''").orderBy("no").collect()
    assert [(r.line, r.segment, r.first, r.last, r.open) for r in rows] == [
        ("CHANSON I : REMARQUES[^1]", 0, None, None, None), ("tête", 0, None, None, None), ("un mot", 1, 4, None, False), ("v. 5 dans le texte", 1, 4, None, False),
        ("deux", 2, 6, 9, False), ("<!-- page: v1p002 -->", 3, 4, None, True), ("trois", 3, 4, None, True),
    ]
    lemmas = lemma_anchors(spark.createDataFrame([("s", 1, 4, None, False), ("s", 2, 6, 9, False), ("s", 3, 4, None, True), ("s", 4, 90, None, False)], "song string, segment int, first int, last int, open boolean"), ["song"], "segment")
    assert [(r.anchor, r.label) for r in lemmas.orderBy("segment").collect()] == [("rem-v4", "v. 4"), ("rem-v6-9", "vv. 6–9"), ("rem-v4-2", "v. 4 sv."), ("rem-v90", "v. 90")]
    verses = spark.createDataFrame([("s", n, f"vers {n}") for n in range(1, 12)], "song string, verse int, text string")
    quotes = {r.segment: (r.quote, r.present) for r in lemma_quotes(lemmas, verses, ["song"], "segment").collect()}
    assert quotes == {1: ("vers 4", True), 2: ("vers 6  /  vers 7  …", True), 3: ("vers 4  …", True), 4: ("", False)}
    assert {r.verse: r.marks for r in verse_marks(lemmas, verses, ["song"]).where("size(marks) > 0").collect()} == {4: ["rem-v4", "rem-v4-2"], 6: ["rem-v6-9"]}


def test_hot_keys_are_salted(spark):
    left = spark.range(500).selectExpr("id", "if(id < 400, 'hot', concat('k', id)) AS k")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k450", 3), ("none", 4)], "k string, v int")
    got = sorted(tuple(r) for r in salted_join(left, right, ["k"], rows=30).select("id", "v").collect())
    assert got == sorted([(i, v) for i in range(400) for v in (1, 2)] + [(450, 3)])
    assert salted_join(left.limit(0), right, ["k"]).count() == 0


def test_failures_of_single_rows(spark):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, None)], "id int, t string")
    got = {r.key: (r.value, (r.error or "").split(":")[0]) for r in isolated(df, "id", "t", lambda t: str(int(t) * 2)).collect()}
    assert got == {1: ("6", ""), 2: (None, "ValueError"), 3: (None, "TypeError")}
