"""WARC archives, and capture histories merged from their indexes.

`write_archives` writes one record per capture. Of captures with equal payloads of at least `SMALLEST`
bytes the one with the least id is a response; the others are revisits that refer to it and hold no
payload. Records are text, so archives go through the text writer (gzip, bounded numbers of records a
file) to whatever store the path names.

`read_captures` parses archives by their content lengths, recomputes lengths and digests of the payloads it finds
and gives every archive's captures as a run sorted by URL key, time and id.

`merge_runs` deals the runs out by ranges of that key and merges the pieces of the runs in each range with
a loser tree. A range holds its share of rows even if one URL has a third of all captures, since time and id
are parts of the key. Ranges ascend, so the histories are in order over all archives.

NULL payloads are empty. NULL URLs have the key '' and no target line, NULL ids no record id. Ids that
occur several times are kept as they are; those with the least id of equal payloads are all
responses. Line breaks in URLs are percent-encoded. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import arrow_schema, settle

SMALLEST = 100
RECORDS_PER_FILE = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CAPTURE = (
    "url_key string, captured_at timestamp, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, archive string, offset long"
)


def mark_revisits(captures: DataFrame) -> DataFrame:
    """`captures` (`page_id`, `url`, `captured_at`, `payload`) with `n_bytes`, `digest` and `refers_to`."""
    rows = captures.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumns(
        {"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    # a row per payload that occurs twice or more; counted before the shuffle
    firsts = rows.where(F.col("n_bytes") >= SMALLEST).groupBy("digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1 and _first is not null").select("digest", "_first")
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.col(page_id).cast("string"), F.lit(">"))


def write_archives(captures: DataFrame, path: str) -> None:
    """Write `captures` as gzipped WARC files below `path`."""
    revisit = F.col("refers_to").isNotNull()
    marked = mark_revisits(captures)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        _line("WARC-Record-ID", _urn("page_id")),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Date", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", _urn("refers_to")),
        _line("Payload-Length", F.col("n_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    marked.select(record.alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, so that captures of a site lie together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    host = rest[:cut].translate(str.maketrans(UPPER, LOWER))
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:]


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, header lines by name, block) of every record of an uncompressed archive."""
    at, whole = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        block = end + 4
        stop = block + int(head["Content-Length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, head, whole[block:stop]
        at = stop + 4


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:capture:") : -1]) if urn else None


def _order(row: dict) -> tuple:
    """NULL times and ids first, as the range partitioning has them."""
    when, page = row["captured_at"], row["page_id"]
    return row["url_key"], (when is not None, when), (page is not None, page)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below `path`, each archive's in order."""
    from datetime import datetime, timezone

    schema = arrow_schema(CAPTURE)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = []
                for offset, head, block in records(gzip.decompress(content.as_py())):
                    digest, when = hashlib.sha256(block).hexdigest(), head.get("WARC-Date")
                    response = head["WARC-Type"] == "response"
                    if response and head["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{name}: the payload at {offset} has another digest")
                    run.append({
                        "url_key": url_key(head.get("WARC-Target-URI")),
                        "captured_at": datetime.strptime(when, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc) if when else None,
                        "page_id": _number(head.get("WARC-Record-ID")), "record_type": head["WARC-Type"],
                        "payload_bytes": len(block) if response else int(head["Payload-Length"]),
                        "payload_digest": digest if response else head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        "refers_to": _number(head.get("WARC-Refers-To")), "archive": name, "offset": offset,
                    })
                if run:
                    yield pa.RecordBatch.from_pylist(sorted(run, key=_order), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(parse, CAPTURE)


class LoserTree:
    """Merges sorted lists: the least head wins, each inner node remembers the loser of its match."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(r) for r in range(self.k)]
        self.losers = [-1] * self.k  # node 0: the winner
        for leaf in range(self.k):
            self._replay(leaf)

    def _head(self, run: int):
        """(1, ) past the end, which loses against everything."""
        if run < len(self.runs) and self.at[run] < len(self.runs[run]):
            return (0, self.key(self.runs[run][self.at[run]]), run)
        return (1,)

    def _replay(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival < 0:  # first match here: wait for the rival
                self.losers[node] = winner
                return
            if self.heads[rival] < self.heads[winner]:
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while True:
            run = self.losers[0]
            if len(self.heads[run]) == 1:
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            self._replay(run)


def merge_runs(captures: DataFrame) -> DataFrame:
    """`captures` in order of URL key, time and id, with `position` counted from 0 over all of them."""
    ddl = CAPTURE + ", shard int, place long"
    schema = arrow_schema(ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[list[dict]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts = runs.setdefault(row["archive"], [[]])
                if parts[-1] and _order(row) < _order(parts[-1][-1]):
                    parts.append([])  # a run may arrive in several pieces
                parts[-1].append(row)
        shard, held, place = TaskContext.get().partitionId(), [], 0
        for row in LoserTree([part for parts in runs.values() for part in parts], _order):
            held.append(row | {"shard": shard, "place": place})
            place += 1
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    dealt = settle(captures, "runs").repartitionByRange("url_key", "captured_at", "page_id")
    merged = settle(dealt.mapInArrow(merge, ddl), "histories")
    totals = merged.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select(
        "shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    return merged.join(before, "shard").withColumn("position", F.col("_before") + F.col("place")).drop("shard", "place", "_before")
