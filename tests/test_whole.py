"""Queries over whole tables, on small tables with cases that a part of them would miss."""

import random
import re

from leafwork import plans


def _saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _rows(spark, name, folder):
    return sorted(tuple(r) for r in plans.all_queries()[name](spark, folder).collect())


def test_song_gaps_in_every_volume(spark, tmp_path):
    d = _saved(spark, tmp_path, chansons=([(1, 1), (1, 3), (1, 3), (5, 2), (5, 7), (9, 1), (9, 2)], "vol int, num int"))
    assert _rows(spark, "song_gaps_all", d) == [(1, 2), (5, 1), (5, 3), (5, 4), (5, 5), (5, 6)]


def test_usage_of_every_volume(spark, tmp_path):
    d = _saved(spark, tmp_path, siglum_usage=([(1, "AB", 2), (4, "AB", 3), (4, "AB", 1), (90, "CD", 5)], "vol int, siglum string, uses int"))
    assert _rows(spark, "usage_matrix_all", d) == [("AB", 1, 2), ("AB", 4, 4), ("CD", 90, 5)]


def test_index_targets_in_every_volume(spark, tmp_path):
    songs = ([(10, 1, 1), (11, 2, 1), (20, 7, 4), (21, 7, 4)], "chanson_id long, vol int, num int")
    d = _saved(spark, tmp_path, chansons=songs, documents=([(1, "amor I, 3; IV, 2, 5\njoi L, 9")], "doc_id long, text string"))
    got = {(r.song, r.vol): (r.num, r.uses, r.words, r.chanson_id, r.missing) for r in plans.all_queries()["index_targets_all"](spark, d).collect()}
    assert got == {("I", 1): (1, 1, 1, 10, False), ("I", 2): (1, 1, 1, 11, False), ("IV", 7): (4, 2, 1, 20, False), ("L", None): (50, 1, 1, None, True)}


def test_verse_numbers_as_printed(spark, tmp_path):
    body = "::: {.verse}\nun vers\n12. autre vers\n\nvers\n40 · vers\nvers de 7\n:::\n9. prose"
    d = _saved(spark, tmp_path, page_files=([("corpus/v1p001.md", "v1p001", "base", body)], "file_name string, pageid string, provenance string, body string"))
    assert [(n, v) for _, n, v in _rows(spark, "verse_numbers_read", d)] == [(2, 1), (3, 12), (5, 13), (6, 40), (7, 41)]


def test_quotes_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    bodies = ["\n".join("".join(rng.choice("*()ab ") for _ in range(rng.choice((5, 20, 40)))) for _ in range(20)) for _ in range(6)]
    bodies += ["*mot* et *mot*", "(*mot*) et *mot*", "x" * 500 + " *loin*"]
    files = [(f"corpus/v1p{k:03}.md", f"v1p{k:03}", "base", b) for k, b in enumerate(bodies)]
    d = _saved(spark, tmp_path, page_files=(files, "file_name string, pageid string, provenance string, body string"))
    want = []
    for name, _, _, body in files:
        for no, line in enumerate(body.split("\n"), 1):
            spans = [m.span() for m in re.finditer(r"\([^)]+\)", line)]
            want += [(name, no, m.start() + 1, m.group()) for m in re.finditer(r"\*[^*]+\*", line) if not any(a <= m.start() < b for a, b in spans)]
    assert _rows(spark, "quotes_in_notes_all", d) == sorted(want)
    assert [r[2] for r in want if r[3] in ("*mot*", "*loin*")] == [1, 10, 12, 502]


def test_words_of_every_language(spark, tmp_path):
    texts = [(1, "Le rossinhol canta", "fr"), (2, "lo rossignol", None), (3, "rossi und mehr", "und"), (4, "autre", "fr")]
    d = _saved(spark, tmp_path, documents=(texts, "doc_id long, text string, lang string"))
    assert [r[:3] for r in _rows(spark, "word_in_context_all", d)] == [(1, 1, "rossinhol"), (2, 1, "rossignol"), (3, 0, "rossi")]


def test_events_of_every_type(spark, tmp_path):
    events = [(1, 7, "signup", 1), (2, 7, "click", 2), (3, 7, "error", 3), (4, 8, "click", 1)]
    d = _saved(spark, tmp_path, events=(events, "event_id long, user_id long, event_type string, ts long"))
    got = {r.event_id: (r.previous, r.following) for r in plans.all_queries()["event_pager_all"](spark, d).collect()}
    assert got == {1: (None, 2), 2: (1, 3), 3: (2, None), 4: (None, None)}
