"""Session helpers: local sessions for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", app: str = "factweave") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset a temporary one is set for a local master, and others are refused."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not wanted and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="factweave-checkpoint-"))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once: they may have neither its folder nor its path.

    Spark serves the archive from the driver to every executor, also to those that come later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="factweave-code-"), "factweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame, costly: bool = False) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files every executor can read, so a lost executor costs no redo.

    Spark works out the last stage of a checkpoint twice, once to count it and once to write it. Where that stage is
    ``costly`` (Python in it) its rows are kept on disk in between, and given up once they are written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not costly:
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def saved(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(the rows as a table written to the shared checkpoint folder, a function that deletes it when it is done with).

    Cuts the lineage as ``cut`` does and works every stage out once, but doesn't keep the order or the partitions of the rows.
    """
    spark = df.sparkSession
    where = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)

    def drop() -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(where), drop


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are worked out once for each row.

    The optimiser puts a projection's expressions into the next one, once for each use; where a costly one is used many
    times that multiplies work and plan. It does not do so across a generator, so the new columns pass through one.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*df.columns, packed.alias("__pinned")).select(*kept, *[F.col(f"__pinned.{n}").alias(n) for n in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
