"""Session defaults, table access and lineage cuts.

Lineage is cut by writing a table into the folder all executors share
(``spark.checkpoint.dir``), never by a local checkpoint: a table there outlives
the executor that wrote it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; an explicit ``conf`` entry wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; Spark's file server hands it out."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="lectern-")) / f"{root.name}.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and all runs on this machine (tests) a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="lectern-")
    return _own_dir[app]


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, deleted at exit."""
    ship(spark)
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe against lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that ``materialize`` wrote; called at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is already gone; the folder's owner cleans up
            pass


atexit.register(release)


#: Tables are broadcast up to so many rows, joined by shuffle beyond.
SMALL = 200_000


def by_size(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= limit


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if by_size(df, SMALL if limit is None else limit) else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in as many partitions as the session shuffles into, if its scan has fewer than the cluster has cores; a larger table is cut finer anyway and isn't shuffled.

    For work that costs far more a byte than a scan does. What comes out of a shuffle, which may have been drawn together to few partitions, is shuffled.
    """
    spark = df.sparkSession
    # only a plan of narrow steps can be asked for its partitions without running it
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)


def narrowed(df: DataFrame, waves: int = 4) -> DataFrame:
    """``df`` in at most ``waves`` tasks for each core, without a shuffle: for work whose tasks each put out a bounded result, so that there aren't more results than cores can use."""
    return df.coalesce(waves * df.sparkSession.sparkContext.defaultParallelism)
