"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master or "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="leafwork-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run here are deleted when it has run, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there; nothing else is left of what made it."""
    _folder(df.sparkSession)
    with _shuffles_deleted(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, as shuffles are deleted by the setting a plan began with


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut`, in compressed columns: a fraction of the size, and only the columns that are asked for are read. The files stay until :func:`forget`."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/kept-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """:func:`kept`, for frames that are deleted at the end; what is to be read after it must be cut within."""
    frames: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        frames.append(kept(df))
        return frames[-1]

    try:
        yield keep
    finally:
        forget(*frames)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; beyond that it is left to be joined by a shuffle. It is counted, so cut it before."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of few bytes and much work, kept in as many tasks as the session shuffles to: adaptive execution would put them in one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def forget(*frames: DataFrame) -> None:
    """Delete what :func:`cut` or :func:`kept` wrote for frames that nothing reads any more, so that no files of old steps stay."""
    for df in frames:
        try:
            jvm, at = df.sparkSession._jvm, getattr(df, "_kept_at", None)
            if at is None:
                file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
                at = file.get() if file.isDefined() else None
            if at is not None:
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        except (AttributeError, TypeError):  # no classic session, or no checkpoint: the files stay
            continue


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="leafwork-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
