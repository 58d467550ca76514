"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from weakref import WeakKeyDictionary, ref

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings that every job here relies on; all are session-scoped.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys: split the oversized partitions, even when that costs an
    # extra shuffle downstream of the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SPARK_DEFAULT_PARTITIONS = "200"
# Rows that a task sorts or groups without writing some of them to disk meanwhile.
ROWS_A_TASK = 500_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks share a machine's folders: `local` and `local[n]`, not `local-cluster[...]`."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def get_spark(app: str = "tallyhouse", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    # AQE merges shuffle partitions that turn out small but never adds any, so a
    # cluster starts wide. An explicit setting of the session stays.
    given = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions") != SPARK_DEFAULT_PARTITIONS
    if not one_machine(spark) and not given:
        spark.conf.set(INITIAL_PARTITIONS, str(max(200, 4 * context.defaultParallelism)))
    return spark


def widen(spark: SparkSession, rows: int) -> None:
    """Start shuffles wide enough for tables of `rows` rows. It only ever adds partitions; AQE merges those that turn out small."""
    wide = -(-rows // ROWS_A_TASK)
    if wide > int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(wide))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: `spark.checkpoint.dir` of the session.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyhouse-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder, with the session's codec or `codec`, and read it back.

    Cuts the lineage like a reliable checkpoint (it survives lost executors), but
    stays columnar, so later steps prune columns and push filters into it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: WeakKeyDictionary[DataFrame, dict[object, tuple[list[ref], DataFrame]]] = WeakKeyDictionary()


def stage_once(inputs: Sequence[DataFrame], label: str, build: Callable[[], DataFrame], **params: str) -> DataFrame:
    """`stage(build(), label)`, written at the first call for these very `inputs` and `params` and read at later ones.

    A DataFrame lists its files once, so the same object stands for the same rows; a table that is loaded
    again is another object, and its result is written anew.
    """
    first, *others = inputs
    known = _STAGED.setdefault(first, {})
    key = (first.sparkSession.sparkContext.applicationId, label, tuple(sorted(params.items())), tuple(map(id, others)))
    if key not in known or any(seen() is not now for seen, now in zip(known[key][0], others)):
        known[key] = ([ref(x) for x in others], stage(build(), label))
    return known[key][1]
