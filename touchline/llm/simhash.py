"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A 64-bit fingerprint is eight bytes, each with a position. Two fingerprints that differ in at most
r bits share at least 8 - r positional bytes, the guaranteed minimum of matches. A posting list of a
single byte holds a 256th of the corpus, so the index is keyed by the combinations of positional bytes in
which such a pair must agree: the eight bytes are four blocks of two, of which two at least are
whole, hence six keys of four bytes. For every pair met in a posting list the shared positional bytes
are tallied, pairs below the minimum are dropped, and the rest are verified bit by bit.

A posting list longer than `LONGEST_LIST` is not expanded into pairs. Its members are indexed by all fingerprints
within one bit instead: two fingerprints within two bits have such a neighbour in common, and all that share
one are within two bits of each other, so linking each to the least of them loses no component.

Equal fingerprints are one node; copies are never paired.

NULL and empty texts have the fingerprint zero and are linked like any other. NULL ids get a
component (the least id of it; NULL if it has none). Repeated rows stay. Extra columns are passed through.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import settle
from touchline.llm.components import connected_components

#: Longest posting list that is expanded into pairs.
LONGEST_LIST = 32
MINIMUM_SHARED = 6
#: Shingles hashed at a time.
PART = 65_536
RADIUS = 2


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    w = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, PART):  # in parts, so that a long text does not need 64 bytes a word
        part = w[start : start + PART + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | Column, words: int = 3, seed: int = 42) -> Column:
    """A bit is one if it is set in more than half of the XXH64 hashes of the text's word shingles (with repeats)."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        return pa.array(np.array([fingerprint_of(t or b"", words, seed) for t in raw], np.uint64).view(np.int64))

    return prints(text)


def shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of an exclusive or are zero."""
    return sum((x.bitwiseAND(F.lit(0xFF << 8 * k if k < 7 else -(1 << 56)).cast("long")) == 0).cast("int") for k in range(8))


def _keys() -> Column:
    """The six keys of a fingerprint: which two blocks, and their value."""
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = list(combinations(range(4), 2))
    return F.array(*[
        F.struct(F.lit(n).alias("which"), (F.shiftleft(block[i], 16) + block[j]).alias("value")) for n, (i, j) in enumerate(pairs)
    ])


def links(prints: DataFrame) -> DataFrame:
    """Links (`a`, `b`) between distinct fingerprints `fp` that connect all pairs within two bits.

    Pairs from short posting lists are all there; of those from long lists, enough to reach every member.
    """
    keyed = prints.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.which", "k.value")
    sizes = keyed.groupBy("which", "value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    listed = settle(keyed.join(sizes, ["which", "value"]), "postings")
    short = listed.where(F.col("_n") <= LONGEST_LIST)
    left, right = short.select("which", "value", F.col("fp").alias("a")), short.select("which", "value", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tallied = left.join(right, ["which", "value"]).where("a < b").where(shared_bytes(differ) >= MINIMUM_SHARED)
    near = tallied.where(F.bit_count(differ) <= RADIUS).select("a", "b")

    crowded = listed.where(F.col("_n") > LONGEST_LIST).select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    around = crowded.select("fp", F.explode(bits).alias("_bit")).select("fp", F.col("fp").bitwiseXOR(F.col("_bit")).alias("_near"))
    least = around.groupBy("_near").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).where("b < _top").select("_near", "b")
    starred = around.join(least, "_near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    starred = starred.where((shared_bytes(differ) >= MINIMUM_SHARED) & (F.bit_count(differ) <= RADIUS))
    return near.union(starred).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, `fingerprint`, `component_id`) for every row of `docs`; the id keeps its name."""
    prints = settle(docs.select(F.col(id_col), fingerprint(text_col).alias("_fp")), "fingerprints")
    nodes = settle(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("_least")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.select("fp", "_root").join(least, "_root").select("fp", "component_id")
    return prints.join(named, prints["_fp"] == named["fp"]).select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
