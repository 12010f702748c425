import pandas as pd
import pytest

from leafwork.llm import scan_queries
from leafwork.llm.channel import PRIOR, learn_confusions, likelihood, misread_words, suspects
from leafwork.llm.scan import cut_stem, cuts_of, edge_keys, fit_numbers, from_roman, head_key, lines_of, to_roman, tokens_of

HEADS = frozenset({"lalangue", "etudessurrondec"})


def kinds(body, expected=""):
    return [x.kind for x in lines_of(body, HEADS, expected)]


def test_kinds_of_lines():
    assert kinds("LA LAN9UE . 12\n\nLe vers suit.\n— 12 —", "12") == ["header", "blank", "text", "folio"]
    assert kinds("12 É T U D E S   S U R   R O N D E C\nLe vers\nÉTUDES SUR RONDEC\nsuit la rime.\n\n[^1]: Taldoc.\n suite\n1S.", "15") == ["header", "text", "header", "text", "blank", "note", "note", "folio"]
    assert kinds("Le vers.\n\nNOTES\n\n1936.\n\nLa fin, p.\n15.", "15") == ["text", "blank", "text", "blank", "text", "blank", "text", "text"]
    assert kinds("PLANCHE I") == ["text"] and kinds("") == [] and kinds(None) == []
    assert kinds("::: {lang=oc}\nBen plolans\n:::\nLe vers.") == ["fence", "verse", "fence", "text"]
    assert kinds("le poème suit une\nlangue.\n\nx") == ["text", "text", "blank", "text"]
    assert head_key("viii LE5 M@NUSCRITS") == "lesmanuscrits" and head_key("II. LA LANGUE") == "iilalangue"
    assert ("lalangue", 1) in edge_keys("LA LANGUE\n\nLe vers.") and ("notes", 0) in edge_keys("Un.\n\nNOTES\n\nDeux.")


def test_cut_words():
    lines = lines_of("Le manus\xad\ncrit suit là-\ndessus la tra-\nLA LANGUE 3\ndition. Il faut lire bra-\n\n[^1]: Une no‐\nte.", HEADS, "")
    assert cuts_of(lines) == {1: ("manus", "crit", 2), 2: ("là", "dessus", 3), 3: ("tra", "dition", 5), 5: ("bra", None, 0), 7: ("no", "te", 8)}
    words = [(t.word, t.no, t.rest) for t in tokens_of(lines, cuts_of(lines))]
    assert ("manuscrit", 1, 2) in words and ("tradition", 3, 5) in words and ("crit", 2, 0) not in words and ("note", 7, 8) in words
    assert cut_stem("le mot") is None and cut_stem("le – ") is None and cut_stem("3-") is None and cut_stem("tra¬ ") == "tra" and cut_stem("") is None


def test_numbers_of_leaves():
    read = ["", "vii", "vlii", "321", "32Z", "828", "", "325", "325 bis", "326", "", "327", "32"]
    plates = {0, 10}
    got = fit_numbers([(i, s, i in plates) for i, s in enumerate(read)])
    assert list(got.values()) == ["", "vii", "viii", "321", "322", "323", "324", "325", "325 bis", "326", "", "327", "328"]
    assert fit_numbers([]) == {} and fit_numbers([(3, "", False)]) == {3: ""}
    assert all(from_roman(to_roman(n)) == n for n in range(1, 400)) and from_roman("iiii") == 0 and from_roman("") == 0


def test_ways_between_words():
    odds = {("a", "@"): 0.01, ("o", "0"): 0.02, ("m", "rn"): 0.03, ("cl", "d"): 0.04}
    assert likelihood("tradition", "tr@diti0n", odds) == pytest.approx(0.0002)
    assert likelihood("rime", "rirne", odds) == 0.03 and likelihood("éclaire", "édaire", odds) == 0.04
    assert likelihood("rime", "xyz", odds) == 0 and likelihood("rime", "rime", odds) == 0 and likelihood("", "", odds) == 0


def test_channel(spark):
    text = ["la rime suit la tradition du vers", "le vers suit la rime"] * 40
    odd = ["la rirne suit la tr@dition du vcrs", "le vers5 suit"]
    rows = [(f"l{i}", t.split(), 7) for i, t in enumerate(text + odd)]
    df = spark.createDataFrame([*rows, ("x", [None], 0), ("y", None, 0), ("z", [], 0), (None, ["vcrs"], 0)], "line string, words array<string>, n int")
    got = {(r.line, r.pos, r.word, r.right) for r in misread_words(df).collect()}
    assert got == {("l80", 1, "rirne", "rime"), ("l80", 4, "tr@dition", "tradition"), ("l80", 6, "vcrs", "vers")}
    assert misread_words(df.limit(0)).count() == 0


def test_neighbouring_misread_words(spark):
    """A run of suspects is decoded together, by the pairs of its candidates."""
    text = ["il lit le fort vent du nord", "il lit le port vers du sud"] * 60
    rows = [(f"l{i}", t.split()) for i, t in enumerate([*text, "il lit le f0rt v3nt du nord", "il lit le f0rt vcnt du nord"])]
    got = {(r.line, r.word, r.right) for r in misread_words(spark.createDataFrame(rows, "line string, words array<string>")).collect()}
    assert got == {("l120", "f0rt", "fort"), ("l121", "f0rt", "fort"), ("l121", "vcnt", "vent")}


def test_rare_right_word_is_proposed(spark):
    """What is known does not depend on the size of the corpus: five uses do among a billion words."""
    df = spark.createDataFrame([("le", 10**9), ("traverse", 5), ("tr@ver5e", 1), ("navire", 45), ("navjre", 4)], "word string, n long")
    got = {r.word: [(c.cand, c.cn) for c in r.cands] for r in suspects(df).collect()}
    assert got == {"tr@ver5e": [("traverse", 5)]}


def test_confusions_are_learned(spark):
    """A corpus in which k is read lc, and two words that differ by a letter without being misread."""
    right = ["tokamar", "blokin", "sukarel", "makolin", "perkut", "kolimar", "vestin"]
    rows = [(w, 4000) for w in right] + [(w.replace("k", "lc"), 8) for w in right if "k" in w] + [("vestan", 10), ("tokamor", 30)]
    odds = learn_confusions(spark.createDataFrame(rows, "word string, n long"), prior=())
    assert set(odds) == {("k", "lc")} and 0.001 < odds["k", "lc"] < 0.004
    assert set(learn_confusions(spark.createDataFrame(rows, "word string, n long"))) == {("k", "lc"), *PRIOR}


@pytest.fixture
def small(tmp_path):
    prose = "La rime suit la tradition du poème et le vers suit le navire.\n" * 40
    body = ["LA LANGUE\n\n" + prose, "12 ÉTUDES SUR RONDEC\n\n" + prose + "\nLa tra-\ndition suit la rirne et la r!me du poè\xad", "me. Le vers suit.\n\n— 13 —", None, ""]
    pages = pd.DataFrame({"file_name": [f"corpus/v1p{i:03d}.md" for i in range(5)], "pageid": [f"v1p{i:03d}" for i in range(5)], "body": body, "fault": "x"})
    pages = pd.concat([pages, pages.iloc[:1], *[pages.iloc[:1].assign(file_name=f"corpus/v1p1{i}0.md", pageid=f"v1p1{i}0", body=f"{h} {i}\n\n{prose}") for i, h in enumerate(["LA LANGUE", "ÉTUDES SUR RONDEC"] * 5)]])
    pages.to_parquet(tmp_path / "page_files.parquet")
    stamp = pd.Timestamp("2020-01-01")
    pd.DataFrame({"pageid": pages.pageid.unique()[:4], "vol": 1, "idx": range(4), "kind": "body", "printed": ""}).astype({"vol": "int32", "idx": "int32"}).to_parquet(tmp_path / "manifest.parquet")
    pd.DataFrame({"pageid": ["v1p000", "v1p001", "v1p002", "v1p003", "v9p999"], "printed_number": ["11", "12", "18", "", "7"], "read_at": stamp, "loaded_at": stamp}).to_parquet(tmp_path / "page_numbers.parquet")
    return str(tmp_path)


def test_faults_and_paragraphs(spark, small):
    found = {tuple(r) for r in scan_queries.p2_found(spark, small).collect()}
    one, two = "corpus/v1p001.md", "corpus/v1p002.md"
    assert {x for x in found if x[0] in (one, two, "v1p002", "v9p999")} == {(one, 1, "header"), (one, 44, "cut"), (one, 45, "misread"), (one, 45, "cut"), (two, 3, "folio"), ("v1p002", 0, "number")}
    text = {(r.file_name, r.paragraph): r.text for r in scan_queries.p2_paragraphs(spark, small).collect()}
    assert text[one, 1] == "La tradition suit la rime et la rime du poème" and text[two, 0] == ". Le vers suit."
    assert "LA LANGUE" not in text["corpus/v1p000.md", 0]
