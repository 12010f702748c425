import time
from pathlib import Path

from pyspark.sql import functions as F

from leafwork.llm.matching import Rule, cascade
from leafwork.llm.matching_queries import p5_found
from leafwork.session import cut

DATA = Path("/root/testdata/sf0.01")


def test_steps_leave_less_on_disk_than_four_times_the_input(spark):
    """What p5_found has written when it returns, in shuffles and in the checkpoint folder: it used to keep a copy of the rows for every step."""
    cut(spark.range(1))
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written() -> dict[str, int]:
        files = blocks.getAllFiles()
        shuffles = [files.apply(i) for i in range(files.size())]
        return {str(f): f.length() for f in shuffles} | {str(p): p.stat().st_size for p in folder.rglob("*") if p.is_file()}

    before = set(written())
    found = p5_found(spark, str(DATA))
    limit = 4 * sum(p.stat().st_size for t in ("citations", "bibliography_entry", "library_records") for p in (DATA / f"{t}.parquet", *(DATA / f"{t}.parquet").rglob("*")) if p.is_file())
    for _ in range(40):  # shuffles are deleted by the workers in their own time
        left = sum(n for f, n in written().items() if f not in before)
        if left <= limit:
            break
        time.sleep(0.25)
    assert left <= limit, f"{left} bytes, {limit} allowed"
    assert not [p for p in folder.glob("kept-*") if str(p) not in before and any(p.iterdir())]
    assert found.count() > 0


def test_more_pairs_than_rows(spark):
    """Five authors of one title and year: 50 pairs of 15 rows are judged in four turns, and each record keeps its one target."""
    schema = "id long, author string, surname string, given string, title string, year int"
    names = ["brauldac", "nerovi", "goiboil", "runsacet", "chimadu"]
    rows = [(k, names[k % 5], names[k % 5], "", "les voix du nord", 1900 + k // 5) for k in range(10)]
    got = cascade(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:5], schema), [Rule("title", (F.array("title"),), ("year",))])
    assert sorted((r.id, r.to) for r in got.collect()) == [(k, k % 5) for k in range(10)]
