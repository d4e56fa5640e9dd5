"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "terrane") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none (tests, single machine) a temporary folder is set once for the context. A session with
    another master than local[...] must name one, as a folder of one machine would be lost with it.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[str] = []
_hooked: list[bool] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted as the program ends."""
    if not _hooked:
        atexit.register(_removed, spark)
        _hooked.append(True)
    _written.append(f"{shared_dir(spark).rstrip('/')}/terrane-{uuid.uuid4().hex}")
    return _written[-1]


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and its size is known to the planner."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was staged, as the program ends; a context that has gone already leaves it to the folder's owner."""
    with contextlib.suppress(Exception):
        for p in _written[since:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _written[since:]


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was staged inside, so that a long session doesn't fill the shared folder. Results made inside
    must be written or collected before."""
    since = len(_written)
    try:
        yield
    finally:
        _removed(spark, since)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str, times: int = 4) -> DataFrame:
    """df over `times` as many tasks as there are cores if it has fewer, for steps whose work far outweighs a move of rows.

    Rows are dealt by a hash of the columns, so that a task that is run again gets the same rows; give enough of them that
    no value (such as a null key) stands for many rows. A table of more splits than that, as any large one, is left as it
    lies.
    """
    wanted = times * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, F.xxhash64(*columns))
