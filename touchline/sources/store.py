"""Per-round result store and run registry, as partitioned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("predictions", "actuals", "team_strengths")


def partition_report(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count of every requested partition; absent ones are reported, not fatal."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        wanted.join(counts, list(keys), "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
        .withColumn("status", F.when(F.col("n_rows") == 0, "missing").otherwise("ok"))
    )


def write_round_table(df: DataFrame, root: str, table: str, *, fmt: str = "parquet", by: str = "round") -> None:
    """Replace only the rounds present in `df`; other rounds stay untouched, so a rerun is safe."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .format(fmt)
        .save(f"{root}/{table}")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def read_table(spark: SparkSession, root: str, table: str, *, fmt: str = "parquet") -> DataFrame:
    path = f"{root}/{table}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"no table {table!r} under {root}")
    return spark.read.format(fmt).load(path)


def read_round(spark: SparkSession, root: str, table: str, round_number: int, *, fmt: str = "parquet") -> DataFrame:
    """One round, by partition pruning; an error when it was never written."""
    df = read_table(spark, root, table, fmt=fmt).where(F.col("round") == round_number)
    if df.isEmpty():
        raise LookupError(f"no {table} stored for round {round_number}")
    return df


def round_inventory(tables: Mapping[str, DataFrame], by: str = "round") -> DataFrame:
    """Which rounds each stored table holds: `has_<table>` per round."""
    marked = None
    for name, df in tables.items():
        rounds = df.select(by).distinct().withColumn("_table", F.lit(name))
        marked = rounds if marked is None else marked.unionByName(rounds)
    return marked.groupBy(by).agg(*[F.bool_or(F.col("_table") == n).alias(f"has_{n}") for n in tables])


def stored_inventory(spark: SparkSession, root: str, *, fmt: str = "parquet") -> DataFrame:
    """Inventory of a store folder; a table never written counts as empty."""
    empty = spark.createDataFrame([], "round int")
    found = {t: read_table(spark, root, t, fmt=fmt).select("round") if _exists(spark, f"{root}/{t}") else empty for t in TABLES}
    return round_inventory(found)


def finished_rounds(inventory: DataFrame, by: str = "round") -> DataFrame:
    """Rounds every table already holds."""
    flags = [c for c in inventory.columns if c.startswith("has_")]
    complete = F.lit(True)
    for c in flags:
        complete = complete & F.col(c)
    return inventory.where(complete).select(by)


def rounds_to_process(
    completed: DataFrame,
    *,
    start_round: int = 2,
    end_round: int | None = None,
    skip_rounds: Sequence[int] = (),
    step: int = 1,
    finished: DataFrame | None = None,
) -> DataFrame:
    """Every `step`-th completed round in range, leaving out skipped and (optionally) finished ones.

    The input is one row per round, so ranking it globally is cheap.
    """
    chosen = completed.where(F.col("round") >= start_round)
    if end_round is not None:
        chosen = chosen.where(F.col("round") <= end_round)
    if skip_rounds:
        chosen = chosen.where(~F.col("round").isin(*skip_rounds))
    nth = F.row_number().over(Window.orderBy("round"))
    chosen = chosen.select("round", nth.alias("_nth")).where((F.col("_nth") - 1) % step == 0).select("round")
    return chosen if finished is None else chosen.join(finished.select("round"), "round", "left_anti")


def round_from_path(path: Column) -> Column:
    """N from a folder name `round_N` in a file path; NULL without one."""
    found = F.regexp_extract(path, r"round_(\d+)(?:/|$)", 1)
    return F.when(found != "", found).cast("int")


def read_round_folders(spark: SparkSession, root: str, file: str, schema: str | None = None) -> DataFrame:
    """Files laid out as `round_N/<file>`, one JSON document each, with the round taken from the folder."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.json(f"{root}/round_*/{file}")
    return df.withColumn("round", round_from_path(F.col("_metadata.file_path")))


def run_registry(rows: DataFrame, run_id: Column, created_at: Column | None = None) -> DataFrame:
    """One row per trained cut-off: observations and distinct teams of all rounds up to it, and their last kickoff.

    Rows are reduced to one per round, and teams to the round they first appear in, before anything is accumulated.
    """
    per_round = rows.groupBy("round").agg(F.count(F.lit(1)).alias("_obs"), F.max("datetime").alias("_kickoff"))
    first_seen = rows.groupBy("team").agg(F.min("round").alias("round")).groupBy("round").agg(F.count(F.lit(1)).alias("_new"))
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)  # a row per round
    return (
        per_round.join(first_seen, "round", "left")
        .withColumns({"n_obs": F.sum("_obs").over(upto), "n_teams": F.coalesce(F.sum("_new").over(upto), F.lit(0)), "_last": F.max("_kickoff").over(upto)})
        .select(
            F.col("round").alias("trained_to_round"), run_id.alias("run_id"), "n_obs", "n_teams",
            (created_at if created_at is not None else F.date_format("_last", "yyyy-MM-dd")).alias("created_at"),
        )
    )


def save_run(root: str, run_id: str, tables: Mapping[str, DataFrame]) -> None:
    """Persist a training outcome: draws, observations and dimensions as tables of one run."""
    for name, df in tables.items():
        write_round_table(df.withColumn("run_id", F.lit(run_id)), root, name, by="run_id")


def load_run(spark: SparkSession, root: str, run_id: str, table: str) -> DataFrame:
    df = read_table(spark, root, table).where(F.col("run_id") == run_id)
    if df.isEmpty():
        raise LookupError(f"no trained run {run_id!r}")
    return df.drop("run_id")


def run_status(registry: DataFrame) -> DataFrame:
    """Whether anything is trained, and the latest run."""
    return registry.agg(
        (F.count(F.lit(1)) > 0).alias("model_trained"),
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"),
        F.max("created_at").alias("last_modified"),
    )
