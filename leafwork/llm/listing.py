"""Values typed freely, mapped to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.bktree import BKTree
from leafwork.llm.canon import canonical
from leafwork.session import cut, spread

_MARKUP = re.compile(r"\{\.[a-z]+\}")
_VOLUME = re.compile(r"(?:\s*[,;]\s*|\s+)(?:t\.|tome|vol\.|n°)?\s*[IVXLC]+\s*[.,;:]*$|(?:\s*[,;]\s*|\s+)(?:t\.|tome|vol\.|n°)\s*\d+\s*[.,;:]*$")
_EDGE = " \t\n\"'«»“”‘’()[]{}*_<>,;:"
_SMALL = {"de", "des", "du", "d"}
# Digits read or typed for a letter.
_DIGITS = str.maketrans("012568", "olzsgb")
_NOT_WORD = re.compile(r"[^0-9a-z]+")


def plain(text: str) -> str:
    """Lower-case letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return [w for w in _NOT_WORD.split(plain(text)) if w]


def undress(typed: str) -> str:
    """``typed`` without quotes, brackets, markup and a volume number behind it."""
    text = _MARKUP.sub("", canonical(typed)).strip(_EDGE)
    while (cut := _VOLUME.sub("", text).strip(_EDGE)) != text and cut:
        text = cut
    return text


def _short(word: str) -> str:
    return word[:2]


def _letters(typed: str) -> str:
    return "".join(words(typed)).translate(_DIGITS)


def _content(text: str) -> list[str]:
    every = words(text)
    return [w for i, w in enumerate(every) if w not in _SMALL or i == len(every) - 1]


def _case(text: str) -> str:
    return re.sub(r"[\s.]", "", text)


class Listing:
    """One shard of the reference list: BK-trees over sigla, titles and word beginnings.

    ``rows`` are (siglum, title). A typed value is compared by its letters with
    the sigla, by its words with the titles, and by the first letters of its
    words with those of the titles, where an abbreviated title must then begin
    each word as the title does. All entries within the radius are looked at.
    """

    def __init__(self, rows: list[tuple[str, str | None]]):
        sigla, titles, starts, ends = [], [], [], []
        for siglum, title in rows:
            sigla.append((_letters(siglum), (siglum, _letters(siglum))))
            long = _content(title or "")
            if long:
                titles.append((" ".join(long), (siglum, long)))
                starts.append((" ".join(map(_short, long)), (siglum, long)))
                if len(long) > 2:
                    ends.append((" ".join(map(_short, (long[0], long[-1]))), (siglum, [long[0], long[-1]])))
        self.sigla, self.titles, self.starts, self.ends = map(BKTree, (sigla, titles, starts, ends))

    def closest(self, typed: str) -> tuple[float, str] | None:
        """(cost, siglum) of the closest entry, or None if none is within the radius; ties go to the first siglum."""
        by_letters = self.by_letters(typed)
        return by_letters[:2] if by_letters and by_letters[2] == 1 else self.by_title(typed)

    def by_letters(self, typed: str) -> tuple[float, str, int] | None:
        """(cost, siglum, how many at that cost) of the sigla nearest by their letters.

        A siglum may be one edit or one swap of neighbours away, whatever its
        length. It counts if no other is as near: where several are, the letters
        tell nothing. Sigla of the very letters typed are one entry, the first.
        """
        for text in self._dresses(typed):
            letters = _letters(text)
            if not letters:
                continue
            # Letter case tells sigla of the same letters apart, and hardly weighs otherwise.
            same, near = [], []
            for d, (siglum, key) in self.sigla.within(letters, 2):
                cost = 0.01 * (_case(text) != _case(siglum))
                if d == 0:
                    same.append((cost, siglum))
                elif (d == 1 or sorted(letters) == sorted(key)) and not self._manuscripts(text):
                    near.append((1 + cost, siglum))
            if same or near:
                best = min(same or near)
                return (*best, 1 if same else sum(c == best[0] for c, _ in near))
        return None

    def by_title(self, typed: str) -> tuple[float, str] | None:
        """(cost, siglum) of the title nearest by its words or their beginnings."""
        found = []
        long = _content(undress(typed))
        if len(long) > 1 and max(map(len, long)) > 2:
            whole = " ".join(long)
            for d, (siglum, _) in self.titles.within(whole, max(1, len(whole) // 8)):
                found.append((1 + d, siglum))
            start = " ".join(map(_short, long))
            for tree, cost in ((self.starts, 1.5), (self.ends, 1.75)):
                for d, (siglum, title) in tree.within(start, 1):
                    miss = self._abbreviates(long, title)
                    if miss is not None:
                        found.append((cost + d + miss, siglum))
        return min(found, default=None)

    @staticmethod
    def _dresses(typed: str) -> list[str]:
        return list(dict.fromkeys((_MARKUP.sub("", canonical(typed)).strip(_EDGE), undress(typed))))

    @staticmethod
    def _manuscripts(text: str) -> bool:
        """A row of single capitals in order stands for manuscripts; one more or less is no slip."""
        capitals = re.sub(r"[\^²2]", "", text)
        return capitals.isupper() and list(capitals) == sorted(set(capitals))

    @staticmethod
    def _abbreviates(short: list[str], long: list[str]) -> float | None:
        """How many words do not begin as the title's do, where at most one misses by one edit; else None."""
        if len(short) != len(long):
            return None
        miss = 0.0
        for a, b in zip(short, long, strict=True):
            if not b.startswith(a):
                tree = BKTree([(b[: len(a) + k], None) for k in (-1, 0, 1)])
                if len(a) < 3 or not tree.within(a, 1):
                    return None
                miss += 1
        return miss if miss <= 1 else None


def map_to_list(values: DataFrame, entries: DataFrame, typed: str = "siglum", shard_rows: int = 20_000, values_at_once: int = 200_000) -> DataFrame:
    """typed, listed: every distinct value and the siglum of the entry it stands for, ``''`` for none.

    ``entries`` has siglum and title. Values are made distinct first, so a value
    that a third of all rows bears is looked up once. A list of up to
    ``shard_rows`` entries is sent to the tasks; a longer one is cut into shards
    of about as many, and each task brings one shard, from which it builds the
    BK-trees, together with up to ``values_at_once`` of the values; no list
    passes through the driver. Every value is held against every shard and the
    cheapest winner of all shards stays; a siglum near by letters counts only
    if it is the nearest of all shards, other ties go to the first siglum. A
    null value is left out; a null siglum or title in the list is skipped; an
    empty list maps all to ``''``; repeated list rows change nothing.
    """
    # The values are few bytes and much work, so they are spread whatever their size.
    queries = values.select(F.col(typed).alias("typed")).where("typed IS NOT NULL").distinct()
    listed = cut(entries.select("siglum", "title").where("siglum IS NOT NULL").distinct())
    shards = max(1, ceil(listed.count() / shard_rows))
    if shards == 1:
        rows = values.sparkSession.sparkContext.broadcast(sorted(map(tuple, listed.collect()), key=str))
        won = spread(queries, F.xxhash64("typed")).mapInPandas(_lookup(rows), _WON)
    else:
        queries = cut(queries)
        parts = max(1, ceil(queries.count() / values_at_once))
        shard, part = F.pmod(F.xxhash64("siglum"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("typed"), F.lit(parts)).alias("part")
        left = queries.select("typed", part, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        right = listed.select("siglum", "title", shard, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        by = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("shard", "part")}).groupBy("shard", "part")
        won = by(left).cogroup(by(right)).applyInPandas(_held, "typed string, stage int, cost double, listed string, ties long")
        least = won.groupBy("typed", "stage").agg(F.min("cost").alias("cost"))
        best = won.join(least, ["typed", "stage", "cost"]).groupBy("typed", "stage").agg(F.min("listed").alias("listed"), F.sum("ties").alias("ties"), F.min("cost").alias("cost"))
        sure = F.when((F.col("stage") == 1) | (F.col("ties") == 1) | (F.col("cost") < 1), F.col("listed"))
        won = best.groupBy("typed").agg(F.min_by(sure, F.when(sure.isNotNull(), F.col("stage"))).alias("listed"))
        won = queries.select("typed").join(won, "typed", "left")
    return won.select("typed", F.coalesce("listed", F.lit("")).alias("listed"))


_WON = "typed string, listed string"


def _held(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """What one shard has for each value: by letters, and by title unless the letters are the very same."""
    listing, rows = Listing(sorted(zip(entries["siglum"], entries["title"], strict=True), key=str)), []
    for t in values["typed"]:
        by_letters = listing.by_letters(t)
        if by_letters:
            rows.append((t, 0, *by_letters))
        if not by_letters or by_letters[0] >= 1:
            by_title = listing.by_title(t)
            if by_title:
                rows.append((t, 1, *by_title, 1))
    return pd.DataFrame(rows, columns=["typed", "stage", "cost", "listed", "ties"])


def _lookup(rows):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listing = Listing(rows.value)
        for x in batches:
            yield pd.DataFrame({"typed": x["typed"], "listed": [(listing.closest(t) or (0, None))[1] for t in x["typed"]]})

    return run
