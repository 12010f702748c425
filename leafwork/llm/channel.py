"""Noisy channel for words that a scan misreads.

The confusions of characters are learned from the corpus: pairs of a frequent
and a rare word that differ in one place. Candidates for a word come from them;
a path through the candidates of a line is chosen by Viterbi, from the
confusions' probabilities and the corpus counts of words and word pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.session import cut, small, spread

# What is printed and what scans often make of it. They stand in where a corpus is too small to learn from; others are learned.
PRIOR = (
    ("e", "c"), ("c", "e"), ("o", "0"), ("a", "@"), ("n", "u"), ("u", "n"), ("s", "5"), ("i", "!"), ("l", "1"), ("é", "6"), ("d", "cl"), ("m", "rn"),
    ("è", "ê"), ("ê", "è"), ("é", "è"), ("è", "é"), ("é", "ê"), ("ê", "é"), ("g", "9"), ("f", "t"), ("v", "y"), ("h", "b"), ("in", "m"), ("ri", "n"),
    ("li", "h"), ("cl", "d"), ("rn", "m"), ("b", "6"), ("b", "8"), ("i", "1"), ("l", "!"), ("t", "f"), ("q", "g"),
)
#: Confusions are learned from words seen so often, which must be so many times as frequent as the rarer word of a pair.
FREQUENT, RATIO = 100, 50
#: A confusion must show in so many word places, and in such a share of those where its frequency lets it be expected.
PLACES, COVERED = 3, 0.4
#: Rows of a side that is broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A word of letters seen so often can be what was printed.
KNOWN = 5
# Misreadings of a word may be so many times as frequent as its letters alone let expect: short words have few ways to go wrong.
_EXCESS = 16
_LETTERS = r"^[\p{L}-]+$"

Odds = dict[tuple[str, str], float]


def _gaps(word: Column) -> Column:
    """Every part of one or two letters of a word: the word with a gap for it, and the part."""
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length(word) - (k - 1)), lambda i: F.struct(F.concat(F.substr(word, F.lit(1), i - 1), F.lit("*"), F.substr(word, i + k)).alias("gap"), F.substr(word, i, F.lit(k)).alias("part")))
    return F.filter(F.concat(at(1), at(2)), lambda x: F.length(x["gap"]) >= 5)


def learn_confusions(counts: DataFrame, prior: tuple[tuple[str, str], ...] = PRIOR) -> Odds:
    """(printed, read) -> probability, for parts of one or two letters, of those learned and those of ``prior``.

    ``counts`` has word and n. A frequent word of letters and a much rarer one
    that are equal but for a gap are a pair; of the frequent words of a gap the
    commonest counts. A true confusion turns up in every frequent word that has
    its letters, as often as its probability lets expect; two words of the
    language that differ by a letter do so here and there. What is collected is
    bounded by the alphabet: parts, their counts by powers of two, pairs of parts.
    """
    words = counts.where(F.length("word") >= 4)
    part = F.explode(_gaps(F.col("word")))
    frequent = words.where((F.col("n") >= FREQUENT) & F.col("word").rlike(_LETTERS)).select("n", part.alias("x")).select("n", "x.*")
    had = frequent.groupBy("part", F.floor(F.log2("n")).alias("size")).agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n")).collect()
    best = cut(frequent.groupBy(F.xxhash64("gap").alias("gap")).agg(F.max_by("part", F.struct("n", "part")).alias("right"), F.max("n").alias("often")))
    rare = words.select("n", part.alias("x")).select("n", F.xxhash64("x.gap").alias("gap"), F.col("x.part").alias("wrong"))
    pairs = rare.join(small(best, BROADCAST_ROWS), "gap").where(f"often >= {RATIO} * n AND substr(right, 1, 1) <> substr(wrong, 1, 1) AND substr(right, -1, 1) <> substr(wrong, -1, 1)")
    seen = pairs.groupBy("right", "wrong").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
    expected_somehow = F.concat_ws(">", "right", "wrong").isin([f"{a}>{b}" for a, b in prior])
    seen = {(r.right, r.wrong): (r.n, r.places) for r in seen.where((F.col("places") >= PLACES) | expected_somehow).collect()}
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in had:
        bins.setdefault(r.part, []).append((r.places, r.n))
    out: Odds = {}
    for right, wrong in {**dict.fromkeys(prior), **dict.fromkeys(seen)}:
        n, places = seen.get((right, wrong), (0, 0))
        total = sum(k for _, k in bins.get(right, ()))
        expected = sum(k * (1 - exp(-n / total * m / k)) for k, m in bins[right]) if n else 0.0
        if (right, wrong) in prior or places >= max(PLACES, COVERED * expected):
            out[right, wrong] = (n + 0.5) / (total + 1000)
    return out


def steps(word: str, changes: dict[str, list[str]]) -> set[str]:
    """The words that one change at one place makes of ``word``."""
    out = set()
    for size in (1, 2):
        for i in range(len(word) - size + 1):
            for put in changes.get(word[i : i + size], ()):
                out.add(word[:i] + put + word[i + size :])
    out.discard(word)
    return out


def _changes(odds: Odds, back: bool) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for right, wrong in odds:
        a, b = (wrong, right) if back else (right, wrong)
        out.setdefault(a, []).append(b)
    return out


def likelihood(right: str, wrong: str, odds: Odds) -> float:
    """Probability that at most two confusions turn ``right`` into ``wrong``: of the ways there are, the likeliest."""
    best = 0.0
    ahead = _changes(odds, False)
    targets = steps(wrong, _changes(odds, True)) | {wrong}
    for first in steps(right, ahead):
        if first in targets:
            p = _one(right, first, odds) * (1.0 if first == wrong else _one(first, wrong, odds))
            best = max(best, p)
    return best


def _one(a: str, b: str, odds: Odds) -> float:
    """Probability of the likeliest single confusion that makes ``b`` of ``a``."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    best = 0.0
    for i in range(max(0, k - 1), k + 1):
        for size in (1, 2):
            put = len(b) - len(a) + size
            if put in (1, 2) and a[i + size :] == b[i + put :] and a[:i] == b[:i]:
                best = max(best, odds.get((a[i : i + size], b[i : i + put]), 0.0))
    return best


def _reached(odds: Odds, back: bool):
    changes = _changes(odds, back)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(w, n, s) for w, n in zip(x["word"], x["n"], strict=True) for s in (w, *steps(w, changes))]
            yield pd.DataFrame(rows, columns=["word", "n", "form"])

    return run


def _weighed(odds: Odds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["p"] = [likelihood(c, w, odds) for c, w in zip(x["cand"], x["word"], strict=True)]
            yield x[x["p"] > 0]

    return run


def suspects(counts: DataFrame) -> DataFrame:
    """word, n, expected, cands: words that a scan may have made of known ones, cands being cand, cn, p of each.

    ``counts`` has word and n. A known word of letters, seen five times, becomes
    a candidate if at most two confusions lead from it to the word. The ways
    meet in the middle: what one confusion makes of known words is joined to
    what undoing one makes of words, so that neither the vocabulary nor the
    forms two steps away are ever in one place. A candidate that is itself no
    more frequent than its own candidates explain is dropped.
    """
    odds = learn_confusions(counts)
    hashed = lambda df, w, n: df.select(F.xxhash64("form").alias("form"), F.col("word").alias(w), F.col("n").alias(n))
    known = counts.where((F.col("n") >= KNOWN) & F.col("word").rlike(_LETTERS))
    ahead = cut(hashed(spread(known).mapInPandas(_reached(odds, False), "word string, n long, form string"), "cand", "cn"))
    back = hashed(spread(counts).mapInPandas(_reached(odds, True), "word string, n long, form string"), "word", "n")
    odd = ~F.col("word").rlike(_LETTERS)
    near = back.join(small(ahead, BROADCAST_ROWS), "form").where((F.col("word") != F.col("cand")) & ((F.col("cn") >= 8 * F.col("n")) | (odd & (F.col("cn") >= 2 * F.col("n"))))).select("word", "n", "cand", "cn").distinct()
    pairs = near.mapInPandas(_weighed(odds), "word string, n long, cand string, cn long, p double")
    per_word = pairs.groupBy("word").agg(F.first("n").alias("n"), (_EXCESS * F.sum(F.col("cn") * F.col("p"))).alias("expected"), F.collect_list(F.struct("cand", "cn", "p")).alias("cands"))
    fits = F.when(odd, F.filter("cands", lambda c: F.col("n") <= 0.5 * c["cn"])).otherwise(F.when(F.col("n") <= 3 + F.col("expected"), F.filter("cands", lambda c: c["cn"] >= 8 * F.col("n"))))
    found = cut(per_word.withColumn("cands", fits).where(F.size("cands") > 0))
    explained = found.where(F.col("n") <= F.col("expected")).select(F.col("word").alias("cand"), F.lit(True).alias("gone"))
    kept = found.select("word", "n", "expected", F.explode("cands").alias("c")).select("word", "n", "expected", "c.*").join(explained, "cand", "left").where("gone IS NULL")
    return kept.groupBy("word").agg(F.first("n").alias("n"), F.first("expected").alias("expected"), F.collect_list(F.struct("cand", "cn", "p")).alias("cands"))


Pairs = dict[tuple[str, str], tuple[int, int, int]]


def _own(token: dict) -> float:
    """What the occurrences of a suspect word speak for it: those its candidates do not explain, and none with signs among its letters."""
    return max(token["n"] - token["expected"], 0.02) if token["word"].replace("-", "").isalpha() else 0.02


def decode(run: list[dict], pairs: Pairs, total: int) -> list[str]:
    """The likeliest words of a run of neighbouring suspect tokens, between two words taken as they stand.

    A token has word, n, expected, cands (cand, cn, p), before and after; pairs
    give (times, times of the first, times of the second) for two words. Only
    what is no suspect form has pairs: those of a misread form are its own.
    """
    best: dict[str, tuple[float, tuple[str, ...]]] = {run[0]["before"] or "": (0.0, ())}
    sound = {run[0]["before"] or "": True}
    for token in run:
        options = [(token["word"], 0.0, _own(token), False)] + [(c, log(p), cn, True) for c, cn, p in token["cands"]]
        after: dict[str, tuple[float, tuple[str, ...]]] = {}
        for c, channel, n, paired in options:
            for a, (score, path) in best.items():
                k, na, _ = pairs.get((a, c), (0, 1, 0)) if paired and sound[a] else (0, 1, 0)
                s = score + channel + log(0.7 * k / max(na, 1) + 0.3 * n / total)
                if c not in after or s > after[c][0]:
                    after[c] = (s, (*path, c))
        best, sound = after, {c: paired for c, _, _, paired in options}
    last = run[-1]["after"]
    if last is not None:
        times = next((nb for (_, b), (_, _, nb) in pairs.items() if b == last), 1)
        for a, (score, path) in best.items():
            k, na, _ = pairs.get((a, last), (0, 1, 0)) if sound[a] else (0, 1, 0)
            best[a] = (score + log(0.7 * k / max(na, 1) + 0.3 * max(times, 1) / total), path)
    return list(max(best.values())[1])


def _runs(tokens) -> Iterator[list[dict]]:
    run: list[dict] = []
    for t in sorted(tokens, key=lambda t: t["pos"]):
        t = {**t, "cands": [(c["cand"], c["cn"], c["p"]) for c in t["cands"]]}
        if run and t["pos"] != run[-1]["pos"] + 1:
            yield run
            run = []
        run.append(t)
    if run:
        yield run


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word pairs that decoding a line looks at."""
    for x in batches:
        rows = set()
        for key, tokens in zip(x["line"], x["tokens"], strict=True):
            for run in _runs(tokens):
                sides = [[run[0]["before"]], *([c for c, _, _ in t["cands"]] for t in run), [run[-1]["after"]]]
                rows |= {(key, a, b) for left, right in zip(sides, sides[1:], strict=False) for a in left for b in right if a is not None and b is not None}
        yield pd.DataFrame(sorted(rows), columns=["line", "a", "b"])


def _viterbi(total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, tokens, pairs in zip(x["line"], x["tokens"], x["pairs"], strict=True):
                known = {(p["a"], p["b"]): (p["k"], p["na"], p["nb"]) for p in (pairs if pairs is not None else ())}
                for r in _runs(tokens):
                    rows += [(key, t["pos"], t["word"], c) for t, c in zip(r, decode(r, known, total), strict=True) if c != t["word"]]
            yield pd.DataFrame(rows, columns=["line", "pos", "word", "right"])

    return run


def misread_words(lines: DataFrame) -> DataFrame:
    """line, pos, word, right: words that are likelier a misread other word, with that word; pos counts from 0.

    ``lines`` has line (a unique key) and words, its words in order, in lower
    case. Counts of words and of neighbouring words cover the whole corpus.
    Only runs of suspect words are decoded: a word without candidates has one
    reading, so the paths on its two sides do not depend on each other. Word
    pairs are counted if decoding looks at them. Sides are broadcast up to half
    a million rows, and joined by shuffles beyond. A null key, list or word is left out; an empty
    table gives no rows.
    """
    rows = lines.select("line", F.filter("words", lambda w: w.isNotNull()).alias("words")).where("line IS NOT NULL AND size(words) > 0")
    counts = cut(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    found = cut(suspects(counts))
    # Each word with its neighbours: the list shifted by one either way.
    size, none = F.size("words"), F.array(F.lit(None).cast("string"))
    beside = F.arrays_zip(F.sequence(F.lit(0), size - 1).alias("pos"), F.col("words").alias("word"), F.concat(none, F.slice("words", F.lit(1), size - 1)).alias("before"), F.concat(F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))), none).alias("after"))
    tokens = rows.select("line", F.explode(beside).alias("t")).select("line", "t.*")
    tokens = tokens.join(small(found.select("word"), BROADCAST_ROWS), "word", "left_semi").join(found, "word")
    lattice = cut(tokens.groupBy("line").agg(F.collect_list(F.struct("pos", "word", "before", "after", "n", "expected", "cands")).alias("tokens")))
    wanted = cut(spread(lattice).mapInPandas(_wanted, "line string, a string, b string"))
    asked = cut(wanted.select("a", "b").distinct())
    couples = rows.select(F.explode(F.arrays_zip(F.slice("words", F.lit(1), size - 1).alias("a"), F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))).alias("b"))).alias("t")).select("t.*")
    both = F.xxhash64("a", "b").alias("both")
    couples = couples.withColumn("both", both).join(small(asked.select(both), BROADCAST_ROWS), "both", "left_semi")
    times = couples.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    seen = asked.join(times, ["a", "b"], "left").join(counts.toDF("a", "na"), "a", "left").join(counts.toDF("b", "nb"), "b", "left").na.fill(0, ["k", "na", "nb"])
    of_line = wanted.join(seen, ["a", "b"]).groupBy("line").agg(F.collect_list(F.struct("a", "b", "k", "na", "nb")).alias("pairs"))
    return lattice.join(of_line, "line", "left").mapInPandas(_viterbi(total), "line string, pos long, word string, right string")
