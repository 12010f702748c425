"""Operators on rows in an order: islands, carried values, ranges, positional joins.

``part`` are the columns within which rows are ordered, ``order`` those of the
order. All are windows over a partition, never over a whole table; choose
partitions (a document, a volume, a user) that one task can sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(part: list[str], order: list[str], end: int = 0):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def islands(df: DataFrame, part: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number of the run a row is in; a row with ``breaks`` starts a new one."""
    return df.withColumn(name, F.sum(breaks.cast("int")).over(_upto(part, order)))


def carry_forward(df: DataFrame, part: list[str], order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """Last value that is not null up to this row, or up to the one before."""
    return df.withColumn(name, F.last_value(value, True).over(_upto(part, order, -1 if exclusive else 0)))


def carry_number(df: DataFrame, part: list[str], order: list[str], given: Column, name: str = "number") -> DataFrame:
    """A given number, else one more than the row before; counting starts at 1."""
    rows = df.withColumns({"_pos": F.row_number().over(Window.partitionBy(*part).orderBy(*order)), "_given": given.cast("long")})
    up = _upto(part, order)
    base = F.last_value("_given", True).over(up)
    at = F.last_value(F.when(F.col("_given").isNotNull(), F.col("_pos")), True).over(up)
    return rows.withColumn(name, F.coalesce(base + F.col("_pos") - at, F.col("_pos").cast("long"))).drop("_pos", "_given")


def ranges(df: DataFrame, part: list[str], at: str, end: Column | None = None) -> DataFrame:
    """``until``: the position before the next row's ``at``; ``end`` for the last row of a part."""
    return df.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(*part).orderBy(at)) - 1, end if end is not None else F.lit(None)))


def pager(df: DataFrame, part: list[str], order: list[str], column: str) -> DataFrame:
    """``previous`` and ``following`` values of ``column``."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumns({"previous": F.lag(column).over(w), "following": F.lead(column).over(w)})


def suffix_repeats(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """A key's second row gets ``-2`` behind it, and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("-", key, "_n")).otherwise(F.col(key))).drop("_n")


def running_distinct(df: DataFrame, part: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """How many different values came before this row: the sum of first occurrences, not a growing set."""
    first = F.row_number().over(Window.partitionBy(*part, value).orderBy(*order)) == 1
    rows = df.withColumn("_first", (first & F.col(value).isNotNull()).cast("long"))
    return rows.withColumn(name, F.coalesce(F.sum("_first").over(_upto(part, order, -1)), F.lit(0))).drop("_first")


def shared_rank(df: DataFrame, part: list[str], value: str, tie: list[str], step: float = 15.0) -> DataFrame:
    """``cote``, a dense rank that ties share, and ``spread``, their places centred on it."""
    w = Window.partitionBy(*part, value)
    rows = df.withColumn("cote", F.dense_rank().over(Window.partitionBy(*part).orderBy(value)))
    place = F.row_number().over(w.orderBy(*tie)) - 1 - (F.count(F.lit(1)).over(w) - 1) / 2
    return rows.withColumn("spread", place * step)


def fenced(df: DataFrame, part: list[str], order: list[str], line: str) -> DataFrame:
    """``inside``: whether a line lies in a block that ``::: {…}`` opens and ``:::`` closes; the fences themselves do not."""
    event = F.when(F.col(line).rlike(r"^:::\s*\{"), 1).when(F.col(line).rlike(r"^:::\s*$"), 0)
    rows = carry_forward(df, part, order, event, "_open")
    return rows.withColumn("inside", (F.coalesce("_open", F.lit(0)) == 1) & ~F.col(line).startswith(":::")).drop("_open")


def zip_by_rank(left: DataFrame, right: DataFrame, part: list[str], left_order: list[str], right_order: list[str], only_equal: bool = False) -> DataFrame:
    """The i-th left row of a part with the i-th right one, and ``place`` i; with ``only_equal``, parts with as many on both sides only."""
    number = lambda df, order: df.withColumns({"place": F.row_number().over(Window.partitionBy(*part).orderBy(*order)), "_of": F.count(F.lit(1)).over(Window.partitionBy(*part))})
    out = number(left, left_order).join(number(right, right_order).withColumnRenamed("_of", "_of_right"), [*part, "place"])
    return (out.where("_of = _of_right") if only_equal else out).drop("_of", "_of_right")


def overflow_pairs(dangling: DataFrame, orphans: DataFrame, part: list[str], page: str, label: str) -> DataFrame:
    """The i-th dangling label of a page with the i-th orphan of the next, both in the order of their text.

    Both have ``part``, ``page`` (an integer) and ``label``; the result has
    part, page, label and next_label; the longer side's rest stays unpaired.
    """
    keys = [*part, page]
    a = dangling.select(*keys, label)
    b = orphans.select(*part, (F.col(page) - 1).alias(page), F.col(label).alias("next_label"))
    return zip_by_rank(a, b, keys, [label], ["next_label"]).drop("place")


def headings_cursor(df: DataFrame, part: list[str], order: list[str], levels: list[Column]) -> DataFrame:
    """``level1`` … : the heading of each level a row is under; a higher heading clears the lower ones."""
    rows = df
    above: list[str] = []
    for k, level in enumerate(levels, 1):
        rows = carry_forward(rows, [*part, *above], order, level, f"level{k}")
        rows = islands(rows, [*part, *above], order, level.isNotNull(), f"_run{k}")
        above.append(f"_run{k}")
    return rows.drop(*above)


def asof(events: DataFrame, part: list[str], order: list[str], is_target: Column, value: Column, name: str) -> DataFrame:
    """The last earlier target's value for every row."""
    return carry_forward(events, part, order, F.when(is_target, value), name, exclusive=True)


def heal_words(pages: DataFrame, part: list[str], order: str, text: str) -> DataFrame:
    """A page that ends in letters and a hyphen takes the next page's first word, which that page loses."""
    w = Window.partitionBy(*part).orderBy(order)
    open_ = r"([\p{L}0-9]+)-$"
    rows = pages.withColumns({"_next": F.regexp_extract(F.lead(text).over(w), r"^(\S+)", 1), "_before": F.coalesce(F.lag(text).over(w).rlike(open_), F.lit(False))})
    own = F.when(F.col("_before"), F.regexp_replace(F.col(text), r"^\S+\s*", "")).otherwise(F.col(text))
    healed = F.when(F.col(text).rlike(open_) & (F.coalesce("_next", F.lit("")) != ""), F.concat(F.regexp_replace(own, "-$", ""), "_next")).otherwise(own)
    return rows.withColumn("healed", healed).drop("_next", "_before")
