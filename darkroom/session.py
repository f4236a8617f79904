"""Session construction, table access and the few shared physical helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
#: Nodes of a plan whose output is no larger than their input, so that the optimizer's estimate, which begins at the sizes of files, bounds it.
_BOUNDED = {"Project", "Filter", "Aggregate", "Distinct", "Deduplicate", "Union", "LocalLimit", "GlobalLimit", "Sort", "SubqueryAlias", "RepartitionByExpression", "Repartition", "LogicalRelation", "LocalRelation"}


def build_session(app: str = "darkroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> str:
    """Makes ``DataFrame.checkpoint`` usable and returns the folder.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting wins. Only local mode without one (tests) gets a folder of its own;
    on a cluster it would lie on each machine apart, so there its absence is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured and not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder; a cluster needs one")
        context.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "darkroom-checkpoints"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, so that a plan read twice is computed once and survives lost executors. Keeps partitions and their order."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder. Unlike ``materialise`` it is read by columns and its size is that of its files, so the optimizer
    chooses joins by a measured size. Rows come back in any order. The table is removed when the process ends."""
    path = f"{checkpoint_ready(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the session is gone, and with it the way to the folder
        return


def plan_bytes(df: DataFrame) -> int | None:
    """A bound of a plan's size, or null where there is none: the optimizer's estimate follows file sizes through projections, filters and aggregates, but
    knows nothing of what joins, generators and Python functions give. Store such a frame to have it measured."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().split()[0] not in _BOUNDED and not node.nodeName().startswith("Relation"):
            return None
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return int(str(plan.stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= (BROADCAST_LIMIT_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hints a broadcast only of a frame whose size is bounded by ``limit``; otherwise the join strategy is left to AQE, which measures."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the cluster has cores, twice: for few bytes that cost much Python time each, which would else be put into one task.
    The hash of the keys is taken, not the keys: a repartitioning that the plan already has would be left out, and its partitions put together."""
    context = df.sparkSession.sparkContext
    parts = max(2 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, F.xxhash64(*keys))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join for a big side with hot keys: its rows are spread over ``salts`` copies of the (unique-keyed) small side.

    A small side whose size is bounded by the broadcast limit is broadcast instead and nothing is shuffled. ``how`` is inner, left or
    left_semi / left_anti. Null keys never match, as in any equi-join.
    """
    if is_small(small):
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, salt], how).drop(salt)


def _hashable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.simpleString().startswith("map") and "map<" not in df.schema[name].dataType.simpleString()
