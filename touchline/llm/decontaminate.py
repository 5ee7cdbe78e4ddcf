"""Benchmark decontamination: BM25 over test items with block-max WAND, then a check of word overlap.

An inverted index holds the test items; every passage of every training text is a query. Impacts are BM25
weights divided by the item's weight against itself, so a score is the share of the item that the passage
covers and one threshold serves all items. Passages are as long as two of the longest item and overlap by
half, so each place where an item could stand lies whole in some passage.

For a passage the bounds of all blocks of items come first: the sums of the largest impacts of its words in
each block. Blocks that can reach the threshold are searched by WAND with those bounds, which
returns every item at or above it. In every passage where an item is met, question and answer are then compared with
the passage and its surroundings by runs of three words (all words if there are fewer): both must be covered. One changed word
takes up to three runs, so a part that lacks no more has no veto if the item as a whole is covered. Of the passages that hold an item so, the one with the largest score is reported.

The index is built in shards of at most `SHARD_BYTES` of item text, each small enough to
broadcast; texts are read once a shard. Document frequencies and lengths are those of all items.

NULL or empty items are never met; NULL or empty texts meet none. Items with equal texts are all reported. An empty answer counts as
covered. Rows with NULL or equal ids are separate. Extra columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import settle

K1, B = 1.2, 0.75
THRESHOLD, COVERED, RUN = 0.5, 0.6, 3
#: Items in a block; most bounds kept (blocks get wider beyond); item text in a shard; rounding of bounds.
BLOCK, MOST_BOUNDS, SHARD_BYTES, SLACK = 4, 1 << 23, 8 << 20, 1e-5
#: Bytes that separate words, besides white space: ASCII signs.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
TO_BLANK = bytes.maketrans(SIGNS, b" " * len(SIGNS))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII signs."""
    return (text or "").lower().encode().translate(TO_BLANK).split()


def split_item(text: str | Column) -> list[Column]:
    """`question` and `answer` of an item in one text: its first line, and the rest."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.regexp_extract(text, "(?s)^\\s*([^\\n]*)", 1).alias("question"), F.regexp_extract(text, "(?s)^\\s*[^\\n]*\\n(.*)$", 1).alias("answer")]


class Index:
    """Postings of one shard of items: by term, item numbers in order and impacts; by block of items, the largest impact of each term.

    Items are numbered so that those with the same most common word, and about the same length, lie
    together: the bounds of a block are then close to what its items can reach.
    """

    def __init__(self, items: list[tuple], frequency: dict[bytes, int], n_items: int, mean_length: float):
        common = lambda i: max(((frequency[w], w) for w in i[1] + i[2]), default=(0, b""))
        self.items = sorted(items, key=lambda i: (common(i), len(i[1]) + len(i[2])))  # (id, question words, answer words)
        self.term: dict[bytes, int] = {}
        self.postings: list[list[tuple[int, float]]] = []
        for k, (_, question, answer) in enumerate(self.items):
            words = question + answer
            weights = {}
            for w, tf in Counter(words).items():
                idf = np.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = float(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            total = sum(weights.values())
            for w, x in weights.items():
                t = self.term.setdefault(w, len(self.term))
                if t == len(self.postings):
                    self.postings.append([])
                self.postings[t].append((k, x / total))
        blocks = max(1, min(-(-len(items) // BLOCK), MOST_BOUNDS // (len(self.postings) + 1)))
        self.width = max(1, -(-len(items) // blocks))
        self.tops = np.zeros((len(self.postings) + 1, blocks), np.float32)  # the last row: words of no item
        for t, posting in enumerate(self.postings):
            for k, x in posting:
                self.tops[t, k // self.width] = max(self.tops[t, k // self.width], x)

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """All items of a block whose impacts for these distinct terms sum to `least` or more."""
        end, tops = (block + 1) * self.width, self.tops[terms, block].tolist()
        cursors = []  # item, place in the posting list, term, bound
        for t, top in zip(terms, tops):
            if top > 0:
                posting = self.postings[t]
                at = bisect_left(posting, (block * self.width,))
                cursors.append([posting[at][0], at, t, top])
        found = []
        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= least - SLACK:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            if cursors[0][0] == pivot:
                own = [c for c in cursors if c[0] == pivot]
                score = sum(self.postings[t][at][1] for _, at, t, _ in own)
                if score >= least - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                own, target = [c for c in cursors if c[0] < pivot], pivot
            for c in own:
                posting = self.postings[c[2]]
                c[1] = bisect_left(posting, (target,), c[1])
                c[0] = posting[c[1]][0] if c[1] < len(posting) else end

    def hits(self, words: list[bytes], length: int, least: float) -> list[dict]:
        """Items met in a text and covered there; of each the covered passage with the largest score."""
        get, none = self.term.get, len(self.postings)
        terms = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        best: dict[int, dict] = {}
        for start in range(0, max(1, len(words) - length // 2), max(1, length // 2)):
            query = np.unique(terms[start : start + length])
            bounds = self.tops[query].sum(axis=0)
            if bounds.max() < least - SLACK:
                continue
            query = query[query < none].tolist()
            near = Runs(words[max(0, start - length // 2) : start + length + length // 2])
            for block in np.flatnonzero(bounds >= least - SLACK).tolist():
                for item, score in self.search(query, block, least):
                    if item in best and score <= best[item]["score"]:
                        continue
                    name, question, answer = self.items[item]
                    q, a = near.covered(question), near.covered(answer)
                    if (q >= COVERED and a >= COVERED) or (
                        _few_lack(q, question) and _few_lack(a, answer) and near.covered(question + answer) >= COVERED
                    ):
                        best[item] = {"item_id": name, "score": score, "question_overlap": q, "answer_overlap": a, "passage": start}
        return [best[item] for item in sorted(best)]


class Runs:
    """The runs of words that stand in a text, by their length."""

    def __init__(self, words: list[bytes]):
        self.words, self.runs = words, {}

    def covered(self, wanted: list[bytes]) -> float:
        """Share of the wanted runs of words that stand here; 1 if nothing is wanted."""
        if not wanted:
            return 1.0
        n = min(RUN, len(wanted))
        if n not in self.runs:
            self.runs[n] = set(zip(*(self.words[k:] for k in range(n))))
        runs = list(zip(*(wanted[k:] for k in range(n))))
        return sum(r in self.runs[n] for r in runs) / len(runs)


def _few_lack(share: float, part: list[bytes]) -> bool:
    """Whether this part is covered, or one changed word may be what it lacks."""
    return share >= COVERED or round((1 - share) * max(1, len(part) - RUN + 1)) <= RUN


def _postings(items: DataFrame) -> DataFrame:
    """(`term`, `n`): in how many items of `items` (`_words` text) each word stands."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for text in batch.column(0).to_pylist() for w in set(words_of(text)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    return items.mapInArrow(terms, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def indexes(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[Index, int]]:
    """The shards of the index of `items` (`item_id`, `question`, `answer`), and the length of a passage."""
    whole = F.concat_ws(" ", "question", "answer")
    kept = settle(items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")), "items")
    length = F.size(F.split(F.trim(F.regexp_replace(whole, "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+", " ")), " "))
    n_items, n_words, longest, n_bytes = kept.agg(F.count(F.lit(1)), F.sum(length), F.max(length), F.sum(F.octet_length(whole))).first()
    if not n_items:
        return
    frequency = settle(_postings(kept.select(whole.alias("_words"))), "item_terms")
    shards = -(-n_bytes // shard_bytes) or 1
    for shard in range(shards):
        own = kept.where(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)) == shard)
        rows = [(r["item_id"], words_of(r["question"]), words_of(r["answer"])) for r in own.collect()]
        rows = [r for r in rows if r[1] or r[2]]
        wanted = _postings(own.select(whole.alias("_words"))).select("term")
        counts = {bytes(r["term"]): r["n"] for r in frequency.join(wanted, "term", "left_semi").collect()}
        yield Index(rows, counts, n_items, max(1.0, n_words / n_items)), 2 * longest


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "hits", least: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`docs` with an array of the items found in each text: item_id, score, question_overlap, answer_overlap, passage (its first word)."""
    kind = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double, passage: int>>"
    found = []
    for index, length in indexes(items, shard_bytes):
        found.append(_search(docs.sparkSession.sparkContext.broadcast(index), length, least, kind)(text_col))
    return docs.withColumn(name, F.concat(*found) if found else F.array().cast(kind))


def _search(shared, length: int, least: float, kind: str):
    @F.arrow_udf(kind)
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.hits(words_of(t), length, least) for t in texts.to_pylist()], _KIND)

    return search


_KIND = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage", pa.int32()),
]))
