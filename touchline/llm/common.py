"""What the operators here share: tables, written intermediate results, tokenizer files."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, so later steps do not repeat it.

    The rows survive lost executors. The folder belongs to the cluster, which also empties it.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables once what was made of them is settled itself; nothing that is left to run may read them."""
    for df in tables:
        path = getattr(df, "settled_at", None)
        jvm = getattr(df.sparkSession, "_jvm", None)
        if path and jvm:
            found = jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(found, True)


def in_fold(doc_id: str | Column) -> Column:
    """True for the held-out fifth of the rows: crc32 of the id as text, modulo 5, is 0. NULL ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


_HELD: dict = {}


def held(key: tuple, make):
    """What a worker keeps from one batch to the next, made once. One thing at a time: the next stage's takes the place of the last one's."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what an earlier stage kept in this worker."""
    _HELD.clear()


@contextmanager
def no_collection() -> Iterator[None]:
    """Work that makes many objects but no cycles: a collection would only walk through what the worker keeps, again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Keep the session's Arrow batches below so many bytes: a worker holds several copies of the one it works on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(64 << 20)).rstrip("bB")) > most_bytes:
        spark.conf.set(name, str(most_bytes))


def arrow_schema(ddl: str):
    """The Arrow form of a schema string; on the driver, since it is Spark that reads the string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
