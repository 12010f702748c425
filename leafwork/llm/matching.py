"""Records of two sources matched without a common key, by a cascade of exact rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.bktree import levenshtein
from leafwork.llm.listing import plain
from leafwork.llm.people import compatible, jaro_winkler
from leafwork.session import cut, forget, scratch, small

_CUT_OFF = re.compile(r"(?:\(?\.{3}\)?|…|,)\s*$|\(\.\.\.\)")


@dataclass(frozen=True)
class Rule:
    """Attributes that must be equal. ``keys`` are arrays of the values of each, ``theirs`` those of targets where they differ, ``checks`` what is left to label by."""

    name: str
    keys: tuple[Column, ...]
    checks: tuple[str, ...]
    theirs: tuple[Column, ...] | None = None


def title_words(title: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain(title))


def titles_agree(a: str, b: str) -> bool:
    """Whether two titles can be one: equal but for slips, words cut short, or an end left out."""
    cut_off = bool(_CUT_OFF.search(a) or _CUT_OFF.search(b))
    x, y = title_words(_CUT_OFF.sub("", a)), title_words(_CUT_OFF.sub("", b))
    s, t = "".join(x), "".join(y)
    if len(s) > len(t):
        x, y, s, t = y, x, t, s
    if not s:
        return False
    slips = max(2, len(s) // 16)
    if abs(len(s) - len(t)) <= slips and levenshtein(s, t) <= slips:
        return True
    if len(x) > len(y):
        return False
    # Word by word: each is the other's beginning, at most one or two slips in all.
    wrong = 0
    for i, (v, w) in enumerate(zip(x, y, strict=False)):
        short, long = sorted((v, w), key=len)
        if long.startswith(short) and (len(short) > 2 or short == long or i == len(x) - 1):
            continue
        d = levenshtein(v, w)
        wrong += min(d, levenshtein(short, long[: len(short)]) + 1 if len(short) > 2 else d)
    if wrong > slips:
        return False
    return len(x) == len(y) or cut_off or len(x) >= 4


#: Targets that are broadcast to the pairs, at most; more are joined by a shuffle.
SENT = 200_000
#: Records that may share a key before it is cut into parts.
HOT_ROWS = 20_000
_KEPT = ("title", "surname", "author", "given", "year")


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        keep = []
        for ta, tb, sa, sb, ca, cb, ga, gb, ya, yb in zip(x["title"], x["to_title"], x["surname"], x["to_surname"], x["author"], x["to_author"], x["given"], x["to_given"], x["year"], x["to_year"], strict=True):
            years = pd.isna(ya) or pd.isna(yb) or abs(int(ya) - int(yb)) <= 1
            keep.append(years and compatible(ga or "", gb or "") and (ca == cb or jaro_winkler(sa or "", sb or "") >= 0.8) and titles_agree(ta, tb))
        yield x[keep][["a", "b", "rules"]]


def _met(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """a, b, rules: shapes that share a key, each pair once, with the bits of all the keys it shares, which ``a`` has. A key of more than ``hot_rows`` rows of ``a`` is cut into parts, each with all its rows of ``b``."""
    hot = cut(a.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("salts")).where("salts > 1"))
    on = ["key"]
    if not hot.isEmpty():
        # So few that they are sent: the rows cross no more often than they do without hot keys.
        hot, on, one = small(hot, SENT), ["key", "salt"], F.coalesce("salts", F.lit(1))
        a = a.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("a"), one).cast("int")).drop("salts")
        b = b.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    return a.join(b, on).groupBy("a", "b").agg(F.bit_or("bit").alias("rules"))


def _agreed(pairs: DataFrame, left: DataFrame, right: DataFrame, rules: Column | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """a, b, rules: pairs of shapes that agree; ``rules`` reads those that met by and ``parts``, of targets as to_ those.

    What pairs are judged by comes to them from the targets first, which are sent
    if they are few, then from the records, and they are judged where they stand then.
    """
    theirs = right.select(F.col("shape").alias("b"), *[F.col(c).alias(f"to_{c}") for c in (*_KEPT, *parts)])
    both = pairs.join(small(theirs, SENT), "b").join(left.select(F.col("shape").alias("a"), *_KEPT, *parts), "a")
    if rules is not None:
        both = both.withColumn("rules", rules).drop(*parts, *[f"to_{c}" for c in parts])
    kind = dict(left.dtypes)["shape"]
    return both.mapInPandas(_agree, f"a {kind}, b {kind}, rules int")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that spellings of one title share: its first letters, its last, the beginnings of its first words."""
    for x in batches:
        keys = []
        for author, title in zip(x["author"], x["title"], strict=True):
            words = title_words(title or "")
            letters = "".join(words)
            keys.append([{"rule": k, "key": f"{author}|{key}"} for k, key in enumerate((letters[:10], letters[-10:], " ".join(w[:3] for w in words[:3]))) if author and key])
        yield x.assign(keys=keys)


def same_works(works: DataFrame) -> DataFrame:
    """id, work: spellings of one work of an author bear the smallest id of them.

    Spellings belong together if each agrees with each and none of them agrees
    with another: a title cut so short that it agrees with two different ones
    joins neither, nor them to each other. Titles of an author that share their
    first ten letters, last ten or the beginnings of three words are compared.
    """
    types = dict(works.dtypes)
    rows = works.select("id", *_KEPT).mapInPandas(_blocks, ", ".join(f"{c} {types[c]}" for c in ("id", *_KEPT)) + ", keys array<struct<rule int, key string>>")
    hashed = F.transform("keys", lambda k: F.xxhash64(k["rule"], k["key"]))
    with scratch() as keep:
        rows = keep(rows.withColumn("keys", hashed).withColumn("shape", F.col("id").cast("string")))
        side = lambda name: rows.select(F.col("shape").alias(name), F.explode("keys").alias("key"))
        near = keep(_met(side("a").withColumn("bit", F.lit(0)), side("b"), HOT_ROWS).where("a < b"))
        pairs = cut(_agreed(near, rows, rows).select(F.col("a").alias("id"), F.col("b").alias("to")))
    both = pairs.unionByName(pairs.select(F.col("to").alias("id"), F.col("id").alias("to"))).unionByName(works.select("id", F.col("id").alias("to")))
    near = both.groupBy("id").agg(F.array_sort(F.collect_set("to")).alias("near"))
    edges = near.select("id", "near", F.explode("near").alias("to")).join(near.select(F.col("id").alias("to"), F.col("near").alias("theirs")), "to")
    return edges.groupBy("id").agg(F.bool_and(F.col("near") == F.col("theirs")).alias("closed"), F.first("near").alias("near")).select("id", F.when(F.col("closed"), F.array_min("near")).otherwise(F.col("id")).alias("work"))


def cascade(records: DataFrame, targets: DataFrame, rules: list[Rule], strong: int = 3) -> DataFrame:
    """id, to, rule, step: the target each record matches and the first rule that finds exactly one; see :func:`cascade_with_ties`."""
    return cascade_with_ties(records, targets, rules, strong)[0]


def cascade_with_ties(records: DataFrame, targets: DataFrame, rules: list[Rule], strong: int = 3, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(id, to, rule, step; id of records that only ties are left of).

    Both sides have id, author, surname, given, title and year, and what the
    rules read; other columns are ignored. Targets may repeat an id with
    other spellings, of which one is enough. Rules run from the strongest to the
    weakest: each joins records to targets on equal keys, holds the pairs
    against the whole titles, names and years and resolves the records that are
    left with one target; those it resolves are out for the rules after it. A
    rule with a null or missing key part finds nothing for that row. Repeated
    rows and ties leave a record to the next rule; what no rule resolves is not
    matched, and has ties or nothing; empty tables give no rows.

    The ``strong`` rules are joined at once and what they resolve is taken out
    by an anti-join, then the others are. Within such a pass the rules find
    their pairs together: of each record the first rule with one target counts,
    which is what anti-joins between them would leave. Records and targets that
    look alike are judged once. Pairs are joined as two hashes, what they are
    judged by comes to those that met. Answers are written by ``keep``, all else
    is deleted.
    """
    parts, of = _parts(rules)
    hashes = [f"p{n}" for n in range(len(parts))]
    with scratch() as inside:
        def shaped(df: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
            """(id and shape; the shapes): rows that look alike, keys included, are one shape."""
            rows = df.select("id", *_KEPT, *[_hashed(p[side]).alias(h) for p, h in zip(parts, hashes, strict=True)])
            looks = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _KEPT]
            rows = rows.withColumn("shape", F.unhex(F.md5(F.concat_ws("\x1f", *looks, F.xxhash64(*hashes).cast("string")))))
            return inside(rows.select("id", "shape")), inside(rows.drop("id").dropDuplicates(["shape"]))

        todo, left = shaped(records, 0)
        known, right = shaped(targets, 1)
        known = known.select(F.col("id").alias("to"), F.col("shape").alias("b"))
        answers: list[DataFrame] = []
        for lo, hi in ((0, min(strong, len(rules))), (strong, len(rules))):
            if lo >= hi:
                continue
            # Rows that share a rule's key share that of each rule with less to it. These alone are joined by; for the others the rest is held together.
            least = [n for n in range(lo, hi) if not any(of[m] < of[n] or (of[m] == of[n] and m < n) for m in range(lo, hi))]
            by = {n: next(m for m in least if of[m] <= of[n]) for n in range(lo, hi)}
            met_by = lambda n: F.col("rules").bitwiseAND(1 << by[n]) != 0  # noqa: B023, E731
            more = lambda n: [F.arrays_overlap(F.col(hashes[p]), F.col(f"to_{hashes[p]}")) for p in sorted(of[n] - of[by[n]])]  # noqa: B023, E731
            bits = reduce(Column.bitwiseOR, [F.when(reduce(Column.__and__, more(n), met_by(n)), F.lit(1 << n)).otherwise(F.lit(0)) for n in range(lo, hi)])
            key = lambda n: _block(n, [F.col(hashes[p]) for p in sorted(of[n])])
            bit = lambda n: F.transform(key(n), lambda k: F.struct(F.lit(1 << n).alias("bit"), k.alias("key")))  # noqa: B023, E731
            open_ = left if lo == 0 else left.join(todo.select("shape").distinct(), "shape", "left_semi")
            a = open_.select(F.col("shape").alias("a"), F.explode(F.flatten(F.array(*map(bit, least)))).alias("k")).select("a", "k.bit", "k.key")
            b = right.select(F.col("shape").alias("b"), F.explode(F.flatten(F.array(*map(key, least)))).alias("key"))
            pairs = inside(_met(a, b, HOT_ROWS))
            held = tuple(hashes[p] for p in sorted(set().union(*(of[n] - of[by[n]] for n in range(lo, hi)))))
            # Pairs that outnumber the rows are judged in turns, by their records: with their texts, no more than about as many as there are rows are on disk at once.
            turns = max(1, -(-pairs.count() // max(1, left.count() + right.count())))
            turn = lambda df, c, k: df if turns == 1 else df.where(F.pmod(F.xxhash64(c), F.lit(turns)) == k)  # noqa: B023, E731
            agreed = [inside(_agreed(turn(pairs, "a", k), turn(left, "shape", k), right, bits, held)) for k in range(turns)]
            forget(pairs)
            met = reduce(DataFrame.unionByName, agreed).join(todo.withColumnRenamed("shape", "a"), "a").join(known, "b")
            met = met.select("id", "to", F.explode(F.array(*[F.when(F.col("rules").bitwiseAND(1 << n) != 0, F.lit(n)) for n in range(lo, hi)])).alias("step")).where("step IS NOT NULL")
            sole = met.groupBy("id", "step").agg(F.min("to").alias("to"), (F.min("to") == F.max("to")).alias("one"))
            first = F.min(F.when(F.col("one"), F.struct("step", "to"))).alias("first")
            answers.append(keep(sole.groupBy("id").agg(first).select("id", "first.to", "first.step")))
            forget(*agreed)
            if hi < len(rules):
                before, todo = todo, inside(todo.join(answers[-1].where("step IS NOT NULL").select("id"), "id", "left_anti"))
                forget(before)
    names = F.array(*[F.lit(r.name) for r in rules])
    answered = reduce(DataFrame.unionByName, answers)
    matched = answered.where("step IS NOT NULL").select("id", "to", F.element_at(names, F.col("step") + 1).alias("rule"), "step")
    return matched, answered.where("step IS NULL").select("id").distinct().join(matched.select("id"), "id", "left_anti")


def _parts(rules: list[Rule]) -> tuple[list[tuple[Column, Column]], list[frozenset[int]]]:
    """(the different attributes of the rules, of records and of targets; of each rule, their numbers)."""
    parts: list[tuple[Column, Column]] = []
    number: dict[tuple[int, int], int] = {}
    of = []
    for r in rules:
        for p in (pairs := list(zip(r.keys, r.theirs or r.keys, strict=True))):
            if (id(p[0]), id(p[1])) not in number:
                number[id(p[0]), id(p[1])] = len(parts)
                parts.append(p)
        of.append(frozenset(number[id(a), id(b)] for a, b in pairs))
    return parts, of


def _hashed(part: Column) -> Column:
    """Hashes of the values of an attribute; none if it is null."""
    return F.coalesce(F.transform(F.array_distinct(F.filter(part, lambda v: v.isNotNull())), lambda v: F.xxhash64(v.cast("string"))), F.array().cast("array<bigint>"))


def _block(number: int, parts: list[Column]) -> Column:
    """Hashes of every combination of the values of the parts, with the rule's number."""
    return reduce(lambda begun, part: F.flatten(F.transform(begun, lambda o: F.transform(part, lambda v: F.xxhash64(o, v)))), parts, F.array(F.lit(number).cast("bigint")))


def rule_precision(found: DataFrame, records: DataFrame, targets: DataFrame, rules: list[Rule], grade: str) -> DataFrame:
    """rule, grade, precision: how often a rule is right among records of a grade.

    A match is labelled by the attributes its rule does not use and both sides
    have: right if all agree, wrong if one does not, without label if there is
    none. The share of right ones is smoothed towards that of the whole rule by
    two matches' weight, and the rule's towards one half by two more.
    """
    checks = sorted({c for r in rules for c in r.checks})
    a = records.select("id", F.coalesce(grade, F.lit("")).alias("grade"), *checks)
    b = targets.select(F.col("id").alias("to"), *[F.col(c).alias(f"to_{c}") for c in checks])
    used = F.create_map(*[F.lit(x) for r in rules for x in (r.name, ",".join(r.checks))])
    both = found.join(a, "id").join(b, "to").withColumn("checks", F.split(used[F.col("rule")], ","))
    known = {c: F.array_contains("checks", c) & F.col(c).isNotNull() & F.col(f"to_{c}").isNotNull() for c in checks}
    right = reduce(Column.__and__, [~known[c] | (F.col(c) == F.col(f"to_{c}")) for c in checks])
    label = F.when(reduce(Column.__or__, known.values()), right.cast("int"))
    by_grade = both.groupBy("rule", "grade").agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("k"))
    by_rule = by_grade.groupBy("rule").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("whole"))
    return by_grade.join(by_rule, "rule").select("rule", "grade", ((F.col("k") + 2 * F.col("whole")) / (F.col("n") + 2)).alias("precision"))
