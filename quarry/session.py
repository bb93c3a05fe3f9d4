"""Session helpers shared by operators: table access, lineage cuts, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, columns pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget its lineage.

    The files go to the folder the cluster names in ``spark.checkpoint.dir``, so they
    outlive an executor.  Only where that setting is absent, no folder has been set and the master is
    local (tests, a laptop) a temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one where it names none and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, made, True)
    return made


def shuffle_width(df: DataFrame) -> int:
    """The number of partitions an explicit range partitioning should use."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, so helper columns can't clash with the caller's."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name.lower() in taken:
            i += 1
            name = f"__{stem}{i}"
        taken.add(name.lower())
        names.append(name)
    return names


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, exactly spelled, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
