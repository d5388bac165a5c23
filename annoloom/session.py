"""Session helpers: local sessions for tests, the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_made: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("annoloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python has it whatever their path is."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="annoloom-")) / "annoloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of this machine only on a local master where none is set."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='annoloom-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        with suppress(Exception):
            drop_table(spark, path)


atexit.register(_clean)


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    The table is removed when the driver's Python ends, or earlier with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annoloom-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._annoloom_path = path  # noqa: SLF001
    return back


def stored_with(df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, tuple]:
    """stored(df) and aggregates of its rows, taken while they are written."""
    seen = Observation()
    back = stored(df.observe(seen, *(c.alias(name) for name, c in measures.items())))
    values = seen.get
    return back, tuple(values.get(name) for name in measures)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end all tables stored inside it: for callers that run many queries and have taken their results."""
    before = {path for _, path in _made}
    try:
        yield
    finally:
        for spark, path in [x for x in _made if x[1] not in before]:
            with suppress(Exception):
                drop_table(spark, path)
            _made[:] = [x for x in _made if x[1] != path]


def release(df: DataFrame | None) -> None:
    """Removes the table behind stored(); for loops whose last state is no longer read."""
    path = getattr(df, "_annoloom_path", None)
    if path:
        with suppress(Exception):
            drop_table(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def shards(rows: int, each: int, least: int = 1) -> int:
    """So many groups that none holds more than about `each` of `rows`: the number follows the data, not the cluster."""
    return max(least, math.ceil(rows / each))


def size_of(df: DataFrame) -> int:
    """Bytes of df as the optimizer's statistics know them, without a job; rows times 32 where they know nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return size if size < 1 << 56 else 32 * df.count()


def large(df: DataFrame) -> DataFrame:
    """df, kept from being broadcast in the next join: the optimizer takes exploded rows for as small as the file they come from, and columns of a file for as
    small as they are when packed; a broadcast of them would fill the driver's memory."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, such as one small file, over all cores; larger ones as they are. Rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)  # noqa: SLF001
