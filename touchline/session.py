"""Session set-up and the two helpers that touch cluster state: checkpoints and broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Shuffle partitions are left to the cluster unless given: AQE coalesces them, so a large
    default is harmless for small inputs and needed for large ones.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("touchline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Where it is unset, a folder below the session's warehouse, which all executors share as well.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder, so a lost executor costs no recompute."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` only if it has at most `max_rows` rows of `max_bytes` in all; otherwise leave the join to AQE.

    The probe stops after `max_rows + 1` rows, so it never reads a large side in full. Pass
    something cheap to evaluate: a settled table, or a small aggregate.
    """
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + 4 * F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A reduced table (an aggregate, a dimension) computed once, settled, and broadcast if it is small.

    Saves shuffling the large side for it; past `broadcast_within`'s bounds the join is left to AQE.
    """
    return broadcast_within(settle(df), max_rows)
