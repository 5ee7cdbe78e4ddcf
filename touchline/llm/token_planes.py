"""Token ids on disk as compressed bit or byte planes.

`write_planes` encodes documents in ascending order of their ids, cuts the id stream of each shard
(one range of document ids) into blocks of a fixed number of ids, transposes a block so that equal
bits (or bytes) of all its ids lie together, compresses every plane with zstandard and stores it as
one row. The other columns of a row are the block index: where the block starts, how long its planes
are, and which slices of which documents it holds. `read_pieces` and `read_documents` undo it.

Rows: NULL or empty texts hold only the end id; NULL ids come first; rows with equal ids are ordered
by their texts; an empty table gives an empty one. Only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import arrow_schema
from touchline.llm.word_cache import encode_texts

BLOCK_IDS = 65_536
BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids int, kind string, planes array<binary>, plane_bytes array<int>, "
    "docs array<struct<ordinal: long, doc_id: long, doc_first: long, n_tokens: long, piece: int, begin: int, stop: int>>"
)
PIECE_SCHEMA = "shard int, ordinal long, doc_id long, doc_first long, n_tokens long, piece int, ids binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first, each compressed; planes of zeros are empty."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    out = []
    for plane in octets:
        if not plane.any():
            out += [b""] * (8 if kind == "bit" else 1)
        elif kind == "byte":
            out.append(press(plane.tobytes()))
        else:
            for bit in range(8):
                bits = np.packbits((plane >> bit) & 1)
                out.append(press(bits.tobytes()) if bits.any() else b"")
    return out


def from_planes(planes: list[bytes], n_ids: int, kind: str) -> np.ndarray:
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress
    octets = np.zeros((4, n_ids), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        raw = np.frombuffer(unpress(plane), np.uint8)
        if kind == "byte":
            octets[k] = raw
        else:
            octets[k // 8] |= np.unpackbits(raw, count=n_ids) << (k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


def _blocks(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, end_id: int, kind: str, block_ids: int
) -> Iterator[pa.RecordBatch]:
    shard, block, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
    held: list[np.ndarray] = []  # ids of the block being filled
    slices: list[dict] = []
    filled = 0
    end = np.array([end_id], "<u4").tobytes()

    def full() -> pa.RecordBatch:
        nonlocal block, held, slices, filled
        planes = to_planes(np.concatenate(held), kind)
        row = {
            "shard": shard, "block": block, "first": first - filled, "n_ids": filled, "kind": kind,
            "planes": planes, "plane_bytes": [len(p) for p in planes], "docs": slices,
        }
        block, held, slices, filled = block + 1, [], [], 0
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for start in range(0, len(doc_ids), 2048):
            encoded = encode_texts(path, batch.column(1).slice(start, 2048))
            for doc_id, raw in zip(doc_ids[start : start + 2048], encoded):
                ids = np.frombuffer(raw + end, "<u4")
                doc_first, at, piece = first, 0, 0
                while at < len(ids):
                    take = min(len(ids) - at, block_ids - filled)
                    slices.append({
                        "ordinal": ordinal, "doc_id": doc_id, "doc_first": doc_first, "n_tokens": len(ids),
                        "piece": piece, "begin": filled, "stop": filled + take,
                    })
                    held.append(ids[at : at + take])
                    at, filled, first, piece = at + take, filled + take, first + take, piece + 1
                    if filled == block_ids:
                        yield full()
                ordinal += 1
    if filled:
        yield full()


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    kind: str = "byte", block_ids: int = BLOCK_IDS,
) -> None:
    """Encode `docs` with the tokenizer file and write blocks of planes (`kind`: bit or byte) below `path`.

    The texts are dealt out by ranges of ids, so a shard is a range and shard numbers ascend with ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    schema = arrow_schema(BLOCK_SCHEMA)
    blocks = ordered.mapInArrow(lambda b: _blocks(b, schema, tokenizer, end_id, kind, block_ids), BLOCK_SCHEMA)
    blocks.write.mode("overwrite").option("compression", "none").parquet(path)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """The index alone: no plane is read."""
    return spark.read.parquet(path).select("shard", "block", "first", "n_ids", "kind", "plane_bytes", "docs")


def read_pieces(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """A row per document and block it lies in: its ids there. `split` picks documents in one or in several blocks."""
    schema = arrow_schema(PIECE_SCHEMA)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted = [d for d in row["docs"] if split is None or split == (d["stop"] - d["begin"] < d["n_tokens"])]
                if not wanted:
                    continue
                raw = from_planes(row["planes"], row["n_ids"], row["kind"]).tobytes()
                yield pa.RecordBatch.from_pylist([
                    {
                        "shard": row["shard"], "ordinal": d["ordinal"], "doc_id": d["doc_id"], "doc_first": d["doc_first"],
                        "n_tokens": d["n_tokens"], "piece": d["piece"], "ids": raw[4 * d["begin"] : 4 * d["stop"]],
                    }
                    for d in wanted
                ], schema)

    return spark.read.parquet(path).select("shard", "n_ids", "kind", "planes", "docs").mapInArrow(pieces, PIECE_SCHEMA)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits each).

    Only documents that lie in several blocks are shuffled.
    """
    import pandas as pd

    def join(key, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("piece")
        out = parts.iloc[:1].copy()
        out["ids"] = [b"".join(parts["ids"])]
        return out

    totals = block_index(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = totals.select(
        "shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    whole = read_pieces(spark, path, split=False)
    joined = read_pieces(spark, path, split=True).groupBy("shard", "ordinal").applyInPandas(join, PIECE_SCHEMA)
    # a row per shard: as many as the write had partitions
    return whole.unionByName(joined).join(F.broadcast(before), "shard").select(
        "doc_id", (F.col("_before") + F.col("doc_first")).alias("start"), "n_tokens", "ids"
    )
