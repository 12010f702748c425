from datetime import datetime

from pyspark.sql import functions as F

from leafwork.operators.references import Child, Parent, broken_reference_report, broken_references

T = [None] + [datetime(2020, m, 5) for m in range(1, 13)]
PARENTS = [("a", 1, None), ("a", 9, None), ("b", 1, 5), ("b", 2, 3), ("c", 8, None), (None, 1, None), ("d", None, None)]
CHILDREN = [("1", "a", 2), ("2", "b", 2), ("3", "c", 2), ("3", "c", 2), ("4", "x", 2), ("5", None, 2), ("6", "c", 9), ("7", "x", None), ("8", "c", None), ("9", "d", 1)]


def tables(spark):
    p = spark.createDataFrame([(k, s and T[s], e and T[e], "clash") for k, s, e in PARENTS], "k string, since timestamp_ntz, until timestamp_ntz, status string")
    c = spark.createDataFrame([(r, k, t and T[t], 1) for r, k, t in CHILDREN], "rec string, k string, at timestamp_ntz, key int")
    return p, c


def ask(p, c):
    return broken_references([Parent("p", p, (F.col("k"),), F.col("since"), F.col("until"))], [Child("c.k", "p", c, (F.col("k"),), F.col("rec"), F.col("at"))])


def test_each_status(spark):
    p, c = tables(spark)
    got = {tuple(r) for r in ask(p, c).collect()}
    assert got == {("c.k", "2", "b", "deleted", "2020-02"), ("c.k", "3", "c", "late", "2020-02"), ("c.k", "4", "x", "missing", "2020-02"), ("c.k", "7", "x", "missing", None)}
    report = {tuple(r) for r in broken_reference_report(ask(p, c)).collect()}
    assert ("c.k", "2020-02", "missing", 1, 1) in report and len(report) == 4


def test_empty_tables(spark):
    p, c = tables(spark)
    assert ask(p, c.limit(0)).count() == 0
    assert {r.status for r in ask(p.limit(0), c).collect()} == {"missing"}
