"""Token counts of documents without their ids: pieces are counted once per distinct pre-token.

A sentencepiece BPE model spells a text with `▁` for spaces. No piece of the vocabulary spans a place where
a `▁` follows another letter (checked when the model is loaded), so a text falls into pre-tokens there
and its count is the sum over them. Likewise before a line feed, which no piece contains, and before a full
stop or comma after a letter or digit, if no piece has that.

1. The most frequent pre-tokens, at most `HEAD` of at most `HEAD_BYTES` bytes each, are found by one pass of
   counting; their piece counts, a table of bounded size, are broadcast.
2. A second pass turns every document into pre-token frequencies. Frequencies of head pre-tokens meet
   their counts at once; the others are joined by a shuffle on the pre-token, where each distinct one is counted once.
3. Products are summed by document.

The head only saves shuffling: any choice of it gives the same counts.

NULL or empty texts have 0 bytes and 0 tokens. Rows with equal or NULL ids are separate documents. An empty
table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_schema, settle

HEAD, HEAD_BYTES = 250_000, 48
#: Distinct pre-tokens a task counts before it passes its counts on and starts anew.
COUNTED = 1_000_000
#: Marks a pre-token that is written out in full, where its spaces are not the usual single one.
FULL = "\x02"
SLOW = re.compile("▁+[^▁\n]*|\n[^▁\n]*")


class PieceCounter:
    """A model of a worker: the pre-tokens of texts, and the number of pieces of a pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size()) if not self.model.is_byte(k)]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model span pre-tokens")
        before = {c: {a for p in pieces for a, b in zip(p, p[1:]) if b == c} for c in ".,"}
        # a sign that no piece has after a letter or digit starts a pre-token there
        self.signs = [c for c in ".," if not any(a.isalnum() for a in before[c])]
        odd = [f"[{re.escape(''.join(before[c]) + ' ')}]{re.escape(c)}" for c in self.signs]
        self.odd = re.compile("|".join([f"^[ \n.,]|  | \n|▁|{FULL}", *odd]))
        self.bare = set(["\n", *self.signs])

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text. A `▁` stands before each that is not marked and starts with no line feed or sign."""
        if not text:
            return []
        if self.odd.search(text):
            found = SLOW.findall("▁" + text.replace(" ", "▁"))
            return [p if p[0] == "\n" else FULL + p for p in found]
        text = text.replace("\n", " \n")
        for sign in self.signs:
            text = text.replace(sign, " " + sign)
        return text.split(" ")

    def count(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of pre-tokens. The library puts a `▁` of its own in front; a line feed, itself a byte, keeps that apart."""
        spelled = [p[2:] if p[:1] == FULL else "\n" + p if p[:1] in self.bare else p for p in pre_tokens]
        return [
            1 if not s else len(i) - 2 * (p[0] in self.bare)
            for p, s, i in zip(pre_tokens, spelled, self.model.encode(spelled, num_threads=1))
        ]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def head_counts(texts: DataFrame, path: str) -> dict[str, int]:
    """Piece counts of the most frequent pre-tokens of the only column: at most `HEAD`, all above some frequency."""
    schema = arrow_schema("pre_token string, n long")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cut = Counter(), piece_counter(path).pre_tokens
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(cut(text or ""))
                if len(counts) >= COUNTED:
                    yield from passed_on(counts)
        yield from passed_on(counts)

    def passed_on(counts: Counter) -> Iterator[pa.RecordBatch]:
        short = [(p, n) for p, n in counts.items() if len(p.encode()) <= HEAD_BYTES]
        counts.clear()
        for start in range(0, len(short), 50_000):
            part = short[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], schema=schema)

    @F.arrow_udf("int")
    def counted(values: pa.Array) -> pa.Array:
        return pa.array(piece_counter(path).count(values.to_pylist()), pa.int32())

    counts = texts.mapInArrow(seen, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n")).where("n > 1")
    # a step on a scale of at most 256 * 63 steps: how many pre-tokens have each is known without sorting them
    counts = settle(counts.withColumn("step", F.floor(256 * F.log2("n")).cast("int")), "vocabulary")
    room, least = HEAD, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return {}
    found = counts.where(F.col("step") >= least).select("pre_token", counted("pre_token").alias("pieces")).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def frequencies(texts: DataFrame, head: dict[str, int], path: str) -> DataFrame:
    """(`row`, `doc_id`, `n_bytes`, `in_head`, `rest`) from (doc_id, text): tokens of head pre-tokens, and the other pre-tokens with frequencies."""
    ddl = "doc_id long, n_bytes long, in_head long, rest array<struct<pre_token: string, n: int>>"
    schema, shared = arrow_schema(ddl), texts.sparkSession.sparkContext.broadcast(head)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = shared.value.get, piece_counter(path).pre_tokens
        for batch in batches:
            sums, rest_p, rest_n, offsets = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                total = 0
                for p, n in Counter(cut(text or "")).items():
                    pieces = known(p)
                    if pieces is None:
                        rest_p.append(p)
                        rest_n.append(n)
                    else:
                        total += pieces * n
                sums.append(total)
                offsets.append(len(rest_p))
            rest = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(rest_p, pa.string()), pa.array(rest_n, pa.int32())], ["pre_token", "n"]),
            )
            columns = [batch.column(0), batch.column(2), pa.array(sums, pa.int64()), rest]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return texts.mapInArrow(rows, ddl).withColumn("row", F.monotonically_increasing_id())


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`doc_id`, `n_bytes`, `n_tokens`) of every row of `docs`, by the sentencepiece model at `path`."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    found = settle(frequencies(texts, head_counts(texts.select("text"), path), path), "frequencies")

    @F.arrow_udf("int")
    def counted(runs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Sorted values: a pre-token that goes on from the batch before is not counted again."""
        last: tuple[str | None, int] = (None, 0)
        for values in runs:
            coded = values.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            again = bool(distinct) and distinct[0] == last[0]
            counts = ([last[1]] if again else []) + piece_counter(path).count(distinct[again:])
            if distinct:
                last = (distinct[-1], counts[-1])
            yield pa.array(counts, pa.int32()).take(coded.indices)

    rest = found.select("row", F.explode("rest").alias("r")).select("row", "r.pre_token", "r.n")
    met = rest.repartition("pre_token").sortWithinPartitions("pre_token")
    sums = met.select("row", (counted("pre_token") * F.col("n")).alias("_t")).groupBy("row").agg(F.sum("_t").alias("_rest"))
    return found.select("row", "doc_id", "n_bytes", "in_head").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("in_head") + F.coalesce("_rest", F.lit(0))).alias("n_tokens")
    )
