import pytest

from leafwork.llm import quality as q
from leafwork.llm.quality import autocorrelation, describe, period, quality, skeleton

FORMS = {
    "natural": [
        "La dame du poème évoque le navire.\n\n| Rondec | 3,48 | Taldoc | 1,2 |\n\nLe scribe suit la strophe du manuscrit.", "Ben plolans de dos lo clar\nQu'ieu fauvija mi lo grau\nDomna de naida ben brolas", "Der Schreiber kennt das Lied,\np. 527.", "x",
        "La rima del testo spiega\nla strofa della canzone.[^1]\n\n[^1]: Rondec, p. 59.",
    ],
    "list": ["- MORDAC, Ida, *Les voix*, Lyon, 1900, pp. 3-9.\n- TAUBERIN, J., *Les pas*, Rome, 1901, pp. 3-9.", "• le pronom\nla cobla (3)\n– la rime (17)\nle vers", "Rondec 32, 447\nTaldoc 3, 84", "1. vunt raulelh\n2. dutalh grains", "brir XI, 46; XIII, 13\nsis I, 4; II, 7", "* ZPBa = Zeitschrift de Rondec\n* Co.Bra. = Corpus de Taldoc", "- MORDAC, Ida, *Les voix*,\n  Lyon, 1900.\n- TAUBERIN, J., *Les pas*,\n  Rome, 1901."],
    "table": ["AB\t+\t3,2\nC\t-\t7", "AB;jal;9\nC;-;7,5", "AB      +      3,2\nC       -      7", "| ms. | I |\n|---|---|\n| A | 3 |", "1  AB: + .... 7\n2  C: - .... jal"],
    "junk": ["", " ", None, "RiÃ©nÂ nÃ©Â prouvÃ©Â quÃ©Â lÃ", "bamida bamida bamida bamida bamida bamida bamida bamida bamida", "jlz tbrbr ahqrnd chchkltdc lqpxj aljf jp gtkx", ". . . . . . . .", "<br/><br/>\n[[3]]\n{{ page.num }}\n</div>", "L'am t d| :o:r| a0teu ra!pe0l\\ ~/|c\\nj /tur// °e", "5ppwarewKYrQjWs0BmtLHkQ3R8F1D4H+iDwVeQvGv807194NKs4Q7Mb8Ccos"],
}


def test_forms():
    for form, texts in FORMS.items():
        for text in texts:
            assert describe(text)[-1] == form, (form, text)


def test_statistics():
    words, mean, symbols, ended, common, _ = describe("Le vers, le mot.\nUn pas")
    assert (words, round(mean, 3), round(symbols, 4), ended) == (6, 2.667, round(2 / 18, 4), 0.5) and common == round(4 / 6, 6)


def test_rows_of_all_kinds(spark):
    rows = [(1, "Le vers.", "a"), (1, "Le vers.", "a"), (2, None, "b"), (3, "le mot " * 40_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = sorted((r.doc_id, r.form) for r in quality(df).collect())
    assert got == [(1, "natural"), (1, "natural"), (2, "junk"), (3, "natural")]
    assert quality(df.limit(0)).count() == 0


def test_series():
    assert autocorrelation([1, 2]) == 0 and autocorrelation([4, 4, 4]) == 1 and autocorrelation([1, 9, 1, 9, 1, 9]) < 0 < autocorrelation([1, 9, 1, 9, 1, 9], 2)
    assert period([0, 2, 2] * 4) == 3 and period([0, 4] * 5) == 2 and period([3] * 9) == 1 and period([60, 61, 59, 60, 12, 61, 58, 60, 59, 61, 30]) == 1 and period([]) == 1


def test_what_lines_are_made_of():
    assert [skeleton(x) for x in ("Rondec 32, 447", "brir XI, 46; XIII, 13", "le jeu verbal (83)", "Me.Vol. = Mémoires de Taldoc", "")] == ["a9,9", "aR,9;R,9", "a(9)", "a=a", ""]


COLUMNS = "mot      vers      rime\nun       trois     sept\ndeux     quatre    huit"
RAGGED = "mot  vers suit la rime\nun deux  trois et sept\ndeux trois  quatre et huit\nla suite du vers  vient"
HANGING = "\n".join(x for k in range(5) for x in (f"Taldoc{'a' * k}, voix du poème {'et des rimes ' * k}", "    à Rondec"))
LONG_SHORT = "\n".join(x for k in range(6) for x in (f"Rondec {k}4, 9{k} voir encore la cobla seconde du recueil perdu", "de Taldoc"))
WORDS = "rossinhol clar\nvers\nla plus haute tempesta\ndos\nmarvelhosa sazo"


@pytest.mark.parametrize(
    ("signal", "off", "text", "form"),
    [
        ("_aligned", lambda a, b: False, COLUMNS, "table"),
        ("period", lambda xs: 1, HANGING, "list"),
        ("period", lambda xs: 1, LONG_SHORT, "list"),
        ("autocorrelation", lambda xs, lag=1: 1.0, WORDS, "list"),
        ("_alike", lambda a, b: False, "Rondec Taldoc Vinhac Pulassac 32, 447\nTaldoc Vinhac Rostic 3, 84\nVinhac Cessec Rundec Rostic 7, 1", "list"),
    ],
)
def test_every_signal_decides(monkeypatch, signal, off, text, form):
    assert describe(text)[-1] == form
    monkeypatch.setattr(q, signal, off)
    assert describe(text)[-1] != form


def test_gaps_that_are_not_in_columns():
    assert describe(RAGGED)[-1] == "natural"
    assert describe("La rime du poème suit\nla mesure du vers que\nle scribe donne dans le\nrecueil de la tradition")[-1] == "natural"


def test_long_lines_are_read_whole():
    tail = " de la cobla" * 20
    assert describe(f"- Rondec{tail}, 3\n- Taldoc{tail}, 4")[-1] == "list"
    assert describe("\n".join(f"Rondec Taldoc Vinhac Lossassac Pulassac Braulvamont Rundec Cessec Gaundeval Vinhac Rostic Taurmin {k}, {k}7" for k in range(3)))[-1] == "list"
