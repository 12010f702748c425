import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafwork.llm.bktree import BKTree, levenshtein
from leafwork.llm.listing import Listing, map_to_list

LIST = [("MLSerm", "Mémoires de linguistique de Sermossac"), ("Ca.Gar.", "Cahiers de linguistique de Garmec"), ("Ca.Les.", "Cahiers des parlers de Lestocourt"), ("RHTAL", "Revue d'histoire littéraire de Taldacourt"), ("AEMU", None)]


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", max_size=9), max_size=30), st.text("abcé", max_size=9), st.integers(0, 4))
def test_tree_against_brute_force(keys, query, radius):
    got = sorted(BKTree((k, i) for i, k in enumerate(keys)).within(query, radius))
    assert got == sorted((d, i) for i, k in enumerate(keys) if (d := slow(query, k)) <= radius)
    assert all(levenshtein(query, k) == slow(query, k) for k in keys)


def test_forms_of_one_entry():
    listing = Listing(LIST)
    forms = {"ML5erm": "MLSerm", "« MLSerm »": "MLSerm", "M. L. S. e. r. m.": "MLSerm", "MLSerm, XLI": "MLSerm", "MLSrem": "MLSerm", "R. H. T. A. L.": "RHTAL", "[Ca.Gar.]{.underline}": "Ca.Gar."}
    forms |= {"Cahi. des parl. de Les.": "Ca.Les.", "Cahiers de lignuistique de Garmec": "Ca.Gar.", "Cah. Lestocourt": "Ca.Les.", "aemu": "AEMU", "МLЅеrm": "MLSerm"}
    assert {k: listing.closest(k)[1] for k in forms} == forms
    for none in ("AEM", "SOUGRAJ", "", " ", "«»", "x" * 50_000, "Cah. Rundec"):
        assert listing.closest(none) is None


def test_shards_nulls_and_clashing_columns(spark):
    typed = spark.createDataFrame([("aemu", 1, "x"), ("aemu", 1, "x"), (None, 2, "y"), ("nobody", 3, "z")], "siglum string, listed int, cost string")
    entries = spark.createDataFrame([*LIST, *LIST, (None, "T")], "siglum string, title string")
    for rows in (20_000, 2):
        assert {tuple(r) for r in map_to_list(typed, entries, shard_rows=rows).collect()} == {("aemu", "AEMU"), ("nobody", "")}
    assert {tuple(r) for r in map_to_list(typed, entries.limit(0)).collect()} == {("aemu", ""), ("nobody", "")}
    assert map_to_list(typed.limit(0), entries).count() == 0


def test_short_sigla_by_the_rule_of_all():
    """Length does not matter: one edit or swap counts where one siglum is as near, and says nothing where two are."""
    listing = Listing([("ROMA", "Romania de Taldoc"), ("BN", "Bulletin de Rundec"), ("BL", "Blätter von Cessec"), ("Zt", "Zeitschrift")])
    assert listing.closest("ROMB")[1] == listing.closest("RMOA")[1] == listing.closest("ROM")[1] == "ROMA"
    assert listing.closest("bx") is None and listing.closest("zt")[1] == listing.closest("zta")[1] == "Zt"


def test_shards_give_what_one_list_gives(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdr") for _ in range(rng.randint(2, 5)))
    entries = [(s, f"Revue de {name()} {name()}") for s in sorted({name() for _ in range(60)})]
    typed = [(name(),) for _ in range(150)] + [(t.title(),) for _, t in entries[:20]] + [(t[:9] + t[10:],) for _, t in entries[20:40]]
    values, listed = spark.createDataFrame(typed, "siglum string"), spark.createDataFrame(entries, "siglum string, title string")
    one, many = ({tuple(r) for r in map_to_list(values, listed, shard_rows=n, values_at_once=40).collect()} for n in (20_000, 7))
    assert one == many and len({x for _, x in one}) > 20
