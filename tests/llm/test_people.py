from itertools import combinations

from leafwork.llm.cites import Name, parse_card, parse_definition, parse_name
from leafwork.llm.people import block_keys, jaro_winkler, learned_forms, people, phonetic, refines, same_person_pairs, settled
from leafwork.llm.people_queries import work_key


def test_names_in_any_dress():
    for text in ("Joseph TAUBERIN", "TAUBERIN, Joseph", "TAUBERIN (Joseph)", "l'abbé Jo Tauberin", "Tauberin Joseph", "Joseph van TAUBERIN", "Tauberin, Joseph (1870-....)", "Ｊｏｓｅｐｈ ТАUВЕRIN"):
        assert parse_name(text) == Name("tauberin", "joseph"), text
    assert parse_name("J.-B.TAUBERIN") == Name("tauberin", "j.-b.") and parse_name("A.E. Tauberin").given == "a."
    assert parse_name("TAUBERIN") == Name("tauberin", "") and parse_name("Tauberin Z") == Name("tauberin", "z.")
    assert parse_name(None) is None and parse_name(" , ") is None and parse_name("(1900)") is None


def test_definitions():
    w = parse_definition("Voir TAUBERIN, J., *Les voix à Rondec* (réimpr. Lyon, 1990).")
    assert w.author == Name("tauberin", "j.") and w.title == "Les voix à Rondec" and w.year is None
    w = parse_definition("*Les voix*, par Joseph TAUBERIN, Lyon, 1901")
    assert (w.author.given, w.place, w.year) == ("joseph", "Lyon", "1901")
    w = parse_definition("J. TAUBERIN, *Les voix*, dans *Mélanges offerts à Ida MORDAC*, Lyon, 1901")
    assert w.author.surname == "tauberin" and w.year == "1901"
    assert parse_definition("TAUBERIN, Joseph, Les voix du nord").title == "Les voix du nord"
    for none in (None, "", "*Revue des voix*, Lyon (periodical), fiche n° 3", "chansonniers ABC", "x" * 10_000 + "*"):
        assert parse_definition(none) is None or none.startswith("x")
    card = parse_card(None, "Les voix : avec un index / par J. Tauberin", "Lyon : [s.n.], [1901]", "xii-90 p. ; 20 cm")
    assert (card.author, card.title, card.year, card.pages, card.place) == (Name("tauberin", "j."), "Les voix, avec un index", "1901", "90", "Lyon")


def test_codes_and_similarity():
    assert phonetic("tauberin") == phonetic("dauperin") and set(block_keys("tauberin")) & set(block_keys("taubrein"))
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert refines("j.", "joseph") and refines("", "joseph") and not refines("j.", "jean-baptiste") and refines("j.-b.", "jean-baptiste") and not refines("jo", "joseph")


def test_linked_records(spark):
    rows = [
        ("1", "tauberin", "joseph", "w1"), ("1", "taubrein", "", "w1"), ("2", "tauberin", "j.", "w2"), ("3", "tauberin", "", "w1"), ("4", "tauberin", "mathilde", "w3"),
        ("5", "tauberin", "", "w3"), ("6", "tauberin", "", "w9"), ("7", "taubeirn", "mathilde", None), ("8", "mordac", None, None), ("9", "mordac", "ida", None), ("9", "mordac", "ida", None), ("10", None, "x", None), ("11", "", "", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "rec string, surname string, given string, work string, cluster string, special int")
    found = people(df)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.person, set()).add(r.rec)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3"], ["4", "5", "7"], ["8", "9"]]
    assert {tuple(r) for r in same_person_pairs(found).collect()} == {p for g in groups.values() for p in combinations(sorted(g), 2)}
    assert people(df.limit(0)).count() == 0


def test_long_titles_are_whole_keys():
    begun = "Dictionnaire de la poésie lyrique des troubadours à Rondec"
    assert work_key(begun + ", premier tome") != work_key(begun + ", second tome") and work_key(None) is None


def test_short_names_have_their_own_keys():
    assert set(block_keys("li")) & set(block_keys("lii")) and not set(block_keys("lo")) & set(block_keys("mu")) and not set(block_keys("noe")) & set(block_keys("tim"))


def test_order_of_names_is_learned(spark):
    """Given names that no list has: names of one order tell what the open ones mean."""
    sure = [("r1", "brauldac", "zéphyrin"), ("r2", "tauberin", "quirin"), ("r3", "mordac", "quirin")]
    rows = [(*r, None, None, "w") for r in sure] + [("r4", "zéphyrin", "brauldac", "brauldac", "zéphyrin", "w"), ("r5", "tauberin", "quirin", "quirin", "tauberin", "w"), ("r6", "un", "deux", "deux", "un", "w")]
    df = spark.createDataFrame(rows, "rec string, surname string, given string, other_surname string, other_given string, work string")
    got = {r.rec: (r.surname, r.given) for r in settled(df).collect()}
    assert (got["r4"], got["r5"], got["r6"]) == (("brauldac", "zéphyrin"), ("tauberin", "quirin"), ("un", "deux"))
    assert settled(df.limit(0)).count() == 0


def test_short_forms_are_learned(spark):
    """Two given names on one work of one surname, with three surnames, are one; with two they are not."""
    rows = [(f"s{k}", f"w{k}", g) for k in range(3) for g in ("zéphyrin", "fifi")] + [(f"s{k}", f"w{k}", g) for k in range(2) for g in ("quirin", "titi")] + [("s9", "w9", "zéphyrin"), ("s7", "w7", "zéphyrin"), ("s8", None, "fifi")]
    df = spark.createDataFrame(rows, "cluster string, work string, given string")
    assert [tuple(r) for r in learned_forms(df).collect()] == [("fifi", "zéphyrin")]
