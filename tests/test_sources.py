import json
import os
import time

import pytest
from pyspark.sql import functions as F

from leafwork.plans.stages import Stage, in_order, rebuild, status
from leafwork.sources import pages, sinks
from leafwork.streaming.arrivals import drain, page_stream, words_per_day


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "pages"
    (d / "sub").mkdir(parents=True)
    (d / "v1p000.md").write_bytes("<!-- page: v1p000 -->\r\n\r\nLe vers\r\nsuit.".encode())
    (d / "sub" / "v2p013.md").write_text("rien")
    (d / "other.md").write_text("x")
    return str(d)


def test_pages(spark, folder):
    rows = {r.pageid: r for r in pages.page_files(spark, folder).collect()}
    assert set(rows) == {"v1p000", "v2p013"} and rows["v1p000"].body == "\nLe vers\nsuit." and rows["v1p000"].anchor == "<!-- page: v1p000 -->"
    assert rows["v2p013"].vol == 2 and rows["v2p013"].idx == 13 and rows["v2p013"].anchor == "" and rows["v2p013"].modified is not None
    assert pages.page_files(spark, folder, only=["v2p013"]).count() == 1 and pages.page_files(spark, folder, vol=1).count() == 1
    want = pages.expected_pages(spark, {1: 2, 2: 0})
    assert sorted(r.pageid for r in want.collect()) == ["v1p000", "v1p001"]
    assert [r.pageid for r in pages.not_done(want, pages.page_files(spark, folder)).collect()] == ["v1p001"]


def test_side_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("pageid,printed\nv1p000,\nv1p001,ix\n")
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1, "r": [{"text": "x"}]}, {"a": 2}]))
    (tmp_path / "w.txt").write_text("oc fr\noc")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "XII_C_45r_lib.jpg").write_bytes(b"\xff")
    assert [tuple(r) for r in pages.csv_table(spark, str(tmp_path / "n.csv"), "pageid string, printed string").collect()] == [("v1p000", None), ("v1p001", "ix")]
    assert pages.json_document(spark, str(tmp_path / "b.json"), "a int, r array<struct<text string>>").where("r IS NULL").count() == 1
    assert {r.word for r in pages.word_set(spark, str(tmp_path / "w.txt")).collect()} == {"oc", "fr"}
    r = pages.image_names(spark, str(tmp_path / "img")).first()
    assert (r.roman, r.siglum, r.folio, r.source) == ("XII", "C", "45r", "lib")
    empty = pages.optional(spark, lambda: spark.read.schema("a int").json(str(tmp_path / "none.json")), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k", 2, "deux"), ("k", 1, "un"), ("l", 1, "é")], "g string, i int, t string")
    assert {tuple(r) for r in sinks.joined_text(df, ["g"], "i", "t", "+").collect()} == {("k", "un+deux"), ("l", "é")}
    sinks.json_document(df, str(tmp_path / "j"), ["g", "i"])
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)[0] == {"g": "k", "i": 1, "t": "un"}
    sinks.csv_log(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    sinks.json_lines(df, str(tmp_path / "jl"))
    sinks.text_by(df, str(tmp_path / "t"), "g", "t")
    assert spark.read.text(str(tmp_path / "t")).where("g = 'l'").first().value == "é"
    after = df.withColumn("t", F.when(F.col("i") == 2, "zwei").otherwise(F.col("t"))).withColumn("key", F.concat("g", "i"))
    assert [r.key for r in sinks.changed_only(df.withColumn("key", F.concat("g", "i")), after, "key", "t").collect()] == ["k2"]
    flags = spark.createDataFrame([("s", "a", "1", "x"), ("s", "b", "2", "y"), ("s", "b", "3", "z")], "stage string, category string, key string, detail string")
    assert [tuple(r) for r in sinks.report(flags).collect()] == [("b", 2, "- 2: y\n- 3: z"), ("a", 1, "- 1: x")]


def test_stages(tmp_path):
    src, out, log = tmp_path / "in.txt", tmp_path / "out.txt", []
    stage = Stage("one", lambda: (log.append(1), out.write_text("x")), (str(out),), (str(src),))
    assert status(stage) == "MISSING"
    out.write_text("x")
    assert status(stage) == "NODEPS"
    src.write_text("y")
    os.utime(out, (time.time() - 100,) * 2)
    assert status(stage) == "STALE" and rebuild([stage]) == ["one"]
    os.utime(src, (time.time() - 200,) * 2)
    assert status(stage) == "FRESH" and rebuild([stage]) == [] and rebuild([stage], every=True) == ["one"] and len(log) == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    row = lambda day, body: spark.createDataFrame([("f", "v1p000", "base", "", body)], "file_name string, pageid string, provenance string, anchor string, body string").withColumn("transcribed_at", F.expr(f"timestamp_ntz'2020-01-{day:02d} 10:00:00'"))
    row(1, "un deux").write.mode("append").parquet(src)
    drain(words_per_day(page_stream(spark, src)), out, cp)
    row(20, "trois").write.mode("append").parquet(src)
    row(21, "quatre").write.mode("append").parquet(src)
    drain(words_per_day(page_stream(spark, src)), out, cp)
    assert (1, 2) in {(r.pages, r.words) for r in spark.read.parquet(out).collect()}


def test_stages_in_order():
    a, b, c = (Stage(n, lambda: None, (f"{n}.out",), given) for n, given in (("a", ("b.out", "x")), ("b", ()), ("c", ("a.out", "b.out"))))
    assert [s.name for s in in_order([c, a, b])] == ["b", "a", "c"] and in_order([]) == []
    with pytest.raises(ValueError, match="a, d"):
        in_order([Stage("a", lambda: None, ("a.out",), ("d.out",)), Stage("d", lambda: None, ("d.out",), ("a.out",))])
