"""Queries on the faults of scanned pages."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.channel import misread_words
from leafwork.llm.scan import Line, cuts_of, edge_keys, first_letters, fit_numbers, lines_of, tokens_of
from leafwork.session import cut, spread
from leafwork.sources.tables import table


def _place(df: DataFrame) -> DataFrame:
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract("pageid", r"^v(\d+)p(\d+)$", k), F.lit("")), F.lit("9999999")).cast("int")
    return df.withColumns({"vol": part(1), "idx": part(2)})


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame([(f, v, k, o) for f, v, b in zip(x["file_name"], x["vol"], x["body"], strict=True) for k, o in edge_keys(b or "")], columns=["file_name", "vol", "key", "outer"]).astype({"vol": "Int32"})


def _without_one(key: str) -> Column:
    """A key and the key with each letter left out."""
    return F.explode(F.array_distinct(F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substr(F.col(key), F.lit(1), i - 1), F.substr(F.col(key), i + 1)))))).alias("form")


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    leaves = [(int(i), s or "", bool(p)) for i, s, p in zip(group["idx"], group["printed"], group["plate"], strict=True)]
    found = fit_numbers(leaves)
    return pd.DataFrame({"pageid": group["pageid"], "number": [found[int(i)] for i in group["idx"]]})


def leaf_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pageid, number: what each leaf of the manifest bears. A volume, the group fitted at once, has a fixed number of leaves.

    Manifest rows without page, volume or index are left out; a null reading is
    none; a page entered at several places has the number of the first.
    """
    manifest = table(spark, sf_dir, "manifest").where("pageid IS NOT NULL AND vol IS NOT NULL AND idx IS NOT NULL")
    leaves = manifest.groupBy("pageid", "vol", "idx").agg(F.coalesce(F.max((F.col("kind") == "plate-or-divider").cast("int")), F.lit(0)).alias("plate"))
    leaves = leaves.groupBy("pageid").agg(F.min_by(F.struct("vol", "idx", "plate"), F.struct("vol", "idx")).alias("at")).select("pageid", "at.*")
    read = table(spark, sf_dir, "page_numbers").groupBy("pageid").agg(F.max_by("printed_number", F.struct("read_at", "loaded_at", "printed_number")).alias("printed"))
    return spread(leaves.join(read, "pageid", "left"), "vol").groupBy("vol").applyInPandas(_fit, "pageid string, number string")


def bodies(spark: SparkSession, sf_dir: str, numbers: DataFrame) -> DataFrame:
    """file_name, pageid, vol, idx, body, heads, number: every page with the running heads of its volume and its leaf's number.

    The running heads of a volume are the outer lines that three of its pages
    share, those that four pages share in all and that it has, also misread,
    if they are not more often headings within pages. Of files of one name the last transcribed counts.
    The bodies are shuffled once, by file name; what is joined to them is a
    short row for each file.
    """
    pages = table(spark, sf_dir, "page_files")
    at = F.col("transcribed_at") if "transcribed_at" in pages.columns else F.lit(None).cast("timestamp")
    files = _place(pages.select("file_name", "pageid", "body", at.alias("transcribed_at")).where("body IS NOT NULL AND file_name IS NOT NULL"))
    keys = files.select("file_name", "vol", "body").mapInPandas(_edge_rows, "file_name string, vol int, key string, outer int").distinct()
    of_volume = keys.groupBy("vol", "key").agg(F.count_if(F.col("outer") == 1).alias("outer"), F.count_if(F.col("outer") == 0).alias("inner"))
    every = of_volume.groupBy("key").agg(F.sum("outer").alias("all_outer"), F.sum("inner").alias("all_inner")).where("all_inner <= all_outer")
    shared = of_volume.join(every, "key")
    common = every.where("all_outer >= 4").select("key")
    # A misread head has no key of its own: the common head an edit or two away, which shares a form with a letter left out, serves for it.
    odd = of_volume.join(common, "key", "left_anti").select("vol", F.col("key").alias("odd"))
    near = odd.select("vol", "odd", _without_one("odd")).join(common.select("key", _without_one("key")), "form").where(F.levenshtein("odd", "key") <= F.greatest(F.lit(1), F.floor(F.length("key") / 6)))
    known = shared.where("outer >= 3 OR all_outer >= 4").select("vol", "key").union(near.select("vol", "key")).distinct()
    heads = known.groupBy("vol").agg(F.array_sort(F.collect_list("key")).alias("heads"))
    context = files.select("file_name", "pageid", "vol").distinct().join(heads, "vol", "left").join(numbers, "pageid", "left").select("file_name", "pageid", "heads", "number")
    last = files.groupBy("file_name").agg(F.max_by(F.struct("pageid", "vol", "idx", "body"), F.struct("transcribed_at", F.xxhash64("body"))).alias("f")).select("file_name", "f.*")
    return last.join(context.withColumnRenamed("pageid", "_page"), (last["file_name"] == context["file_name"]) & F.col("pageid").eqNullSafe(F.col("_page"))).select(last["file_name"], "pageid", "vol", "idx", "body", "heads", "number")


def _lines(row) -> list[Line]:
    return lines_of(row.body, frozenset(row.heads if row.heads is not None else ()), row.number or "")


_READ = (
    "file_name string, pageid string, vol int, idx int, header array<int>, folio array<int>, "
    "cut array<int>, stem array<string>, rest array<string>, words array<string>, no array<int>, split array<int>, behind array<int>, goes_on boolean"
)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A page's faults of form, its cut lines and its words, in one pass over its body."""
    for x in batches:
        rows = []
        for row in x.itertuples(index=False):
            lines = _lines(row)
            of = lambda kind: [y.no for y in lines if y.kind == kind]  # noqa: B023, E731
            cuts = cuts_of(lines)
            tokens = tokens_of(lines, cuts)
            first = next((y.text.lstrip()[:2] for y in lines if tokens and y.no == tokens[0].no), "")
            goes_on = bool(tokens) and tokens[0].start and not any(c.isupper() for c in first)
            ends = [(no, stem.lower(), rest and rest.lower()) for no, (stem, rest, _) in cuts.items()]
            rows.append((row.file_name, row.pageid, row.vol, row.idx, of("header"), of("folio"), *map(list, zip(*ends, strict=True) if ends else ((), (), ())), *map(list, zip(*[(t.word, t.no, t.split, t.rest) for t in tokens], strict=True) if tokens else ((), (), (), ())), goes_on))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")]).astype({"vol": "Int32", "idx": "Int32"})


class Repair:
    """The steps that find the faults of all pages."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.numbers = cut(leaf_numbers(spark, sf_dir))
        self.bodies = bodies(spark, sf_dir, self.numbers)
        self.pages = cut(self.bodies.mapInPandas(_read, _READ))

    def lines(self, kind: str) -> DataFrame:
        return self.pages.select("file_name", F.explode(kind).alias("no"))

    def cuts(self) -> DataFrame:
        """file_name, no, vol, idx, last: lines that end inside a word; a hyphen of the word's own, by the corpus, is none."""
        ends = self.pages.select("file_name", "vol", "idx", F.explode(F.arrays_zip(F.col("cut").alias("no"), "stem", "rest")).alias("e")).select("file_name", "vol", "idx", "e.*")
        spelled = ends.where("rest IS NOT NULL").select(F.concat("stem", "rest").alias("joined"), F.concat_ws("-", "stem", "rest").alias("whole")).distinct()
        asked = spelled.select(F.explode(F.array("joined", "whole")).alias("word")).distinct()
        counts = self.pages.select(F.explode("words").alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        own = spelled.join(counts.toDF("whole", "nw"), "whole").join(counts.toDF("joined", "nj"), "joined", "left").where("nw > coalesce(nj, 0)").select("joined", "whole")
        ends = ends.withColumns({"joined": F.concat("stem", "rest"), "whole": F.concat_ws("-", "stem", "rest")})
        return ends.join(own, ["joined", "whole"], "left_anti").select("file_name", "no", "vol", "idx", F.col("rest").isNull().alias("last"))

    def misread(self) -> DataFrame:
        """file_name, no, word, right, split, rest for every misread word; no is the line with the wrong letters.

        The rest of a word that the page before cuts, at the head of a page, is
        no word to judge.
        """
        wrong = misread_words(self.pages.select(F.col("file_name").alias("line"), "words")).withColumnRenamed("line", "file_name")
        ended = self.pages.where(F.exists("rest", lambda r: r.isNull())).select("vol", (F.col("idx") + 1).alias("idx"), F.lit(True).alias("ended")).distinct()
        at = self.pages.select("file_name", "no", "split", "behind", F.when(F.col("goes_on"), F.struct("vol", "idx")).alias("after"))
        placed = wrong.join(at, "file_name")
        of = lambda c: F.get(c, F.col("pos").cast("int")).alias(c)
        placed = placed.select("file_name", "pos", "word", "right", of("no"), of("split"), of("behind").alias("rest"), F.when(F.col("pos") == 0, F.col("after.vol")).alias("vol"), F.when(F.col("pos") == 0, F.col("after.idx")).alias("idx"))
        return placed.join(ended, ["vol", "idx"], "left").where("ended IS NULL").select("file_name", "no", "word", "right", "split", "rest")


def _misread_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        nos = []
        for word, right, no, split, rest in zip(x["word"], x["right"], x["no"], x["split"], x["rest"], strict=True):
            spots = [i for op, i, _, _, _ in SequenceMatcher(None, word, right, autojunk=False).get_opcodes() if op != "equal"]
            nos.append(rest if split and spots and spots[0] >= split else no)
        yield pd.DataFrame({"rec_key": x["file_name"], "line_no": nos})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    repair = Repair(spark, sf_dir)
    fault = lambda df, f: df.select("rec_key", F.col("line_no").cast("int").alias("line_no"), F.lit(f).alias("fault"))
    line = lambda df: df.select(F.col("file_name").alias("rec_key"), F.col("no").alias("line_no"))
    heads, folios = (fault(line(repair.lines(k)), k) for k in ("header", "folio"))
    misread = fault(repair.misread().mapInPandas(_misread_lines, "rec_key string, line_no long"), "misread")
    read = table(spark, sf_dir, "page_numbers").select("pageid", "printed_number").where("printed_number <> ''").join(repair.numbers, "pageid").where("printed_number <> number")
    numbers = read.select(F.col("pageid").alias("rec_key"), F.lit(0).alias("line_no"), F.lit("number").alias("fault"))
    return heads.unionByName(folios).unionByName(fault(line(repair.cuts()), "cut")).unionByName(misread).unionByName(numbers).distinct()


def _pages_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for x in batches:
        for row in x.itertuples(index=False):
            yield row, _lines(row)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, lines in _pages_of(batches):
        right = {}
        for w in row.fixes if row.fixes is not None else ():
            right.setdefault(w["no"], []).append((w["word"], w["right"], w["split"]))
        cuts = {n: c for n, c in cuts_of(lines).items() if n in set(row.cut if row.cut is not None else ())}
        texts, skip = {}, {}
        for y in lines:
            if y.kind in ("text", "note"):
                text = y.text
                if y.no in cuts:
                    stem, rest, at = cuts[y.no]
                    text = text.rstrip("-¬") + (rest or "")
                    if at:
                        skip[at] = len(rest)
                if y.no in skip:
                    lead = len(text) - len(text.lstrip())
                    text = text[lead + skip[y.no] :]
                for word, good, _ in right.get(y.no, ()):
                    text = _swap(text, word, good)
                texts[y.no] = text
            elif y.kind == "verse":
                texts[y.no] = y.text
        blocks: list[tuple[str, list[str]]] = []
        last = "blank"
        for y in lines:
            if y.kind in ("header", "folio"):
                continue
            kind = "blank" if y.kind in ("blank", "fence") else y.kind
            if kind != "blank":
                if kind != last or (kind == "note" and y.text.startswith("[^")):
                    blocks.append((kind, []))
                blocks[-1][1].append(texts[y.no].strip())
            last = kind
        rows = [(row.file_name, k, ("\n" if kind == "verse" else " ").join(filter(None, block))) for k, (kind, block) in enumerate(blocks)]
        if row.carried and rows and row.taken:
            head = row.taken
            if rows[0][2].lower().startswith(head):
                rows[0] = (rows[0][0], rows[0][1], rows[0][2][len(head) :].lstrip())
        if row.tail and rows:
            body = max((r for r in rows if not r[2].startswith("[^")), default=None)
            if body:
                rows[body[1]] = (body[0], body[1], body[2] + row.tail)
        yield pd.DataFrame(rows, columns=["file_name", "paragraph", "text"])


def _swap(text: str, word: str, good: str) -> str:
    at = text.lower().find(word)
    if at < 0:
        return text
    old = text[at : at + len(word)]
    new = good.upper() if old.isupper() and len(old) > 1 else good.capitalize() if old[:1].isupper() else good
    return text[:at] + new + text[at + len(word) :]


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, lines in _pages_of(batches):
        first = next((y for y in lines if y.kind in ("text", "verse", "note")), None)
        word = first_letters(first.text) if first and first.kind == "text" else None
        if word and word[0].islower():
            yield pd.DataFrame({"vol": [row.vol], "idx": [row.idx], "file_name": [row.file_name], "word": [word]})


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, paragraph, text: every body as continuous paragraphs.

    Running heads and leaf numbers are left out, cut words joined, misread
    words replaced, lines of a paragraph put in one; verse keeps its lines. A
    word cut at the end of a page gets its rest from the next page's base file,
    where it is taken away.
    """
    repair = Repair(spark, sf_dir)
    cuts = cut(repair.cuts())
    fixes = repair.misread().groupBy("file_name").agg(F.collect_list(F.struct("no", "word", "right", "split")).alias("fixes"))
    of_page = cuts.groupBy("file_name").agg(F.collect_list("no").alias("cut"))
    starts = cut(repair.bodies.mapInPandas(_starts, "vol int, idx int, file_name string, word string"))
    ends = cuts.where("last").select("file_name", "vol", "idx").distinct()
    tail = ends.join(starts.groupBy("vol", (F.col("idx") - 1).alias("idx")).agg(F.min_by("word", "file_name").alias("tail")), ["vol", "idx"]).select("file_name", "tail")
    taken = starts.join(ends.select("vol", (F.col("idx") + 1).alias("idx")).distinct(), ["vol", "idx"], "left_semi").select("file_name", F.lower("word").alias("taken"), F.lit(True).alias("carried"))
    pages = repair.bodies
    for part in (fixes, of_page, tail, taken):
        pages = pages.join(part, "file_name", "left")
    return pages.na.fill({"carried": False}).mapInPandas(_paragraphs, "file_name string, paragraph long, text string")


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}
