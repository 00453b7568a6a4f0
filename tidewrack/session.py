"""Session defaults and the two guards every operator shares: a reliable cut of lineage and a checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def session(app: str = "tidewrack", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` wins over the defaults."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        build = build.config(key, str(value))
    return build.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small table may be one file that can't be split. Larger
    tables have more splits than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master gets a folder of its own when none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="tidewrack-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


#: Materialised tables after which what is no longer referred to is let go.
RELEASE_EVERY = 4
_made = 0


def release(spark: SparkSession) -> None:
    """Spark drops shuffle files, broadcasts and checkpoints once the driver's collector finds that nothing refers to them. An
    operator of many short steps leaves many of them long before a collection is due, so one is asked for now and then."""
    spark.sparkContext._jvm.java.lang.System.gc()


def _count(spark: SparkSession) -> None:
    global _made
    _made += 1
    if _made % RELEASE_EVERY == 0:
        release(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation of its past."""
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    _count(df.sparkSession)
    return done


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table: for wide rows that later plans read in part."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    _count(df.sparkSession)
    return df.sparkSession.read.parquet(path)


#: Paths of the stored tables that are still there.
_tables: list[str] = []


def tables() -> int:
    """A mark for ``forget``: how many stored tables there are."""
    return len(_tables)


def forget(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the tables stored after the mark ``since``, but for those that ``keep`` reads. For steps whose result is a
    table of its own: nothing that is still to be computed may need the others."""
    wanted = " ".join(keep.inputFiles())
    for path in _tables[since:]:
        if path.rpartition("/")[2] not in wanted:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _tables.remove(path)


def lookup(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` if it is counted to have at most ``most`` rows; give materialised or cheap input."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
