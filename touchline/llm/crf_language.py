"""Language of words and texts by a linear-chain conditional random field.

A word with a letter is a position of the chain; its language is the state. A state's weight at a position is
the sum of learned weights of the word's features: prefixes and suffixes of up to three letters,
letter trigrams, and for each language whether the word is in its lexicon (the most frequent words of
that language's training texts). Learned transitions say how likely the language changes. Forward-backward gives
each word's distribution over languages; a text gets the language with the largest mean, and that mean as score.

Training texts each have one language; chains for training are spliced from passages of texts of several languages, so that
transitions are learned on code-switched text. Training uses about `TEXTS` texts of every language there is, picked by a hash, of longer ones a
window of `LONGEST_TRAINING` characters; prediction uses all words of whole texts, in chains of at most `CHAIN` words.

NULL texts and texts without a letter are `und` with score 0. Without training texts all are `und`. Rows
with NULL or equal ids are separate. NULL languages are not learned. Extra columns are passed through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import held, in_fold, no_collection

TEXTS, LONGEST_TRAINING, LEXICON = 250, 20_000, 400
#: Hashed features; words in a chain; chains, epochs and step of training; words a worker remembers.
SLOTS, CHAIN, CHAINS, EPOCHS, STEP, REMEMBERED = 1 << 16, 256, 1_500, 30, 0.4, 250_000
UNKNOWN = "und"
#: Positions of chains computed at once.
CELLS = 300_000


def core(word: str) -> str:
    """A word's letters from the first to the last, in lower case; empty if it has none."""
    if not word.isalpha():
        at = [k for k, c in enumerate(word) if c.isalpha()]
        word = word[at[0] : at[-1] + 1] if at else ""
    return word.lower()


def features_of(word: str) -> list[int]:
    """Slots of a core's affixes and trigrams."""
    names = [f"<{word[:k]}" for k in (1, 2, 3)] + [f"{word[-k:]}>" for k in (1, 2, 3)]
    framed = f"^{word}$"
    names += [framed[k : k + 3] for k in range(len(framed) - 2)]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every position, and the expected number of each transition.

    `emit`: positions x chains x states, as logarithms; positions past a chain's length are ignored.
    """
    steps, chains, states = emit.shape
    power = np.exp(emit - emit.max(axis=2, keepdims=True))
    go = np.exp(move).astype(power.dtype)  # single precision where emissions are
    ahead = np.empty_like(power)
    ahead[0] = power[0] / power[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[t - 1] @ go) * power[t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((chains, states), power.dtype)
    out, moves, least = np.zeros_like(power), np.zeros((states, states)), np.finfo(power.dtype).tiny
    for t in range(steps - 1, -1, -1):
        inside = (t < lengths)[:, None]
        both = ahead[t] * back
        out[t] = np.where(inside, both / both.sum(axis=1, keepdims=True), 0)
        if t:
            message = np.where(inside, power[t] * back, 0)
            earlier = message @ go.T
            total = np.where(inside[:, 0], (ahead[t - 1] * earlier).sum(axis=1), 1)
            moves += go * ((ahead[t - 1] / total[:, None]).T @ message)
            back = np.where(inside, earlier / np.maximum(earlier.sum(axis=1, keepdims=True), least), 1)
    return out, moves


@dataclass
class Field:
    """Learned weights: hashed slots and lexicons by state, and transitions."""

    languages: list[str]
    lexicons: dict[str, list[int]]
    weights: np.ndarray  # (SLOTS + languages) x states
    move: np.ndarray

    def slots(self, word: str) -> list[int]:
        return features_of(word) + [SLOTS + k for k in self.lexicons.get(word, ())]


def train(texts: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """A field from (text, language) pairs."""
    rng = np.random.default_rng(seed)
    spoken = [([c for w in text.split() if (c := core(w))], lang) for text, lang in sorted(texts)]
    spoken = [(words, lang) for words, lang in spoken if words]
    if not spoken:
        return None
    languages = sorted({lang for _, lang in spoken})
    state = {lang: k for k, lang in enumerate(languages)}
    lexicons: dict[str, list[int]] = {}
    for lang in languages:
        seen = Counter(w for words, own in spoken if own == lang for w in words)
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(state[lang])
    by_state = [[words for words, lang in spoken if lang == own] for own in languages]
    n, field = len(languages), Field(languages, lexicons, np.zeros((SLOTS + len(languages), len(languages))), np.zeros((len(languages),) * 2))

    number: dict[str, int] = {}
    chains = []
    for _ in range(CHAINS):
        chain, truth = [], []
        for own in rng.integers(0, n, rng.integers(1, 4)):
            words = by_state[own][rng.integers(len(by_state[own]))]
            start = int(rng.integers(len(words)))
            part = words[start : start + int(rng.integers(5, 30))]
            chain += [number.setdefault(w, len(number)) for w in part]
            truth += [int(own)] * len(part)
        chains.append((chain, truth))
    slots = [field.slots(w) for w in number]
    flat = np.concatenate([np.array(s) for s in slots])
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])

    lengths = np.array([len(c) for c, _ in chains])
    words, truth = np.zeros((lengths.max(), len(chains)), np.int64), np.full((lengths.max(), len(chains)), -1)
    for k, (c, y) in enumerate(chains):
        words[: len(c), k], truth[: len(c), k] = c, y
    inside = truth >= 0
    wanted = np.eye(n)[np.where(inside, truth, 0)] * inside[:, :, None]
    pairs = inside[1:]
    wanted_moves = np.einsum("tbi,tbj->ij", wanted[:-1] * pairs[:, :, None], wanted[1:])
    past_w, past_m = np.full_like(field.weights, 1e-8), np.full_like(field.move, 1e-8)
    for _ in range(EPOCHS):
        by_word = np.stack([np.bincount(owner, field.weights[flat, k], len(slots)) for k in range(n)], axis=1)
        found, moves = forward_backward(by_word[words], lengths, field.move)
        error = (wanted - found)[inside]
        per_word = np.stack([np.bincount(words[inside], error[:, k], len(slots)) for k in range(n)], axis=1)
        slope = np.stack([np.bincount(flat, per_word[owner, k], len(field.weights)) for k in range(n)], axis=1) / lengths.sum()
        slope -= 1e-6 * field.weights
        slope_m = (wanted_moves - moves) / lengths.sum() - 1e-6 * field.move
        past_w += slope**2
        past_m += slope_m**2
        field.weights += STEP * slope / np.sqrt(past_w)
        field.move += STEP * slope_m / np.sqrt(past_m)
    field.weights = field.weights.astype(np.float32)
    return field


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", held_out: bool = True) -> Field | None:
    """A field from a bounded sample of the rows outside the held-out fold (all rows if `held_out` is false)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & (F.col("_lang") != UNKNOWN) & (F.length("_text") > 0))
    if held_out:
        rows = rows.where(~in_fold("_id"))
    counts = rows.groupBy("_lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["_lang"]), F.lit(min(1.0, TEXTS / r["count"])))])[F.col("_lang")]
    # repeated rows without ids are told apart by their places
    row = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    mark = F.when(row.isNull(), F.xxhash64("_id", "_text")).otherwise(F.xxhash64("_text", row))
    place = F.pmod(mark, F.lit(1 << 20)) / float(1 << 20)
    start = 1 + F.pmod(mark, F.greatest(F.length("_text") - LONGEST_TRAINING + 1, F.lit(1)))
    picked = rows.withColumns({"_place": place, "_start": start}).where(F.col("_place") < share).select(F.substr("_text", "_start", F.lit(LONGEST_TRAINING)).alias("_text"), "_lang").collect()
    return train([(r["_text"], r["_lang"]) for r in picked])


class Reader:
    """A worker's view of a field: emissions of the words it has met."""

    def __init__(self, field: Field):
        self.field, n = field, len(field.languages)
        self.move = field.move
        self.rows: dict[str, int] = {}
        self.emit = np.zeros((1 << 12, n), np.float32)

    def _row(self, word: str) -> int:
        """Row of a word's emission, or -1 if it has no letter."""
        bare = core(word)
        if not bare:
            return -1
        at = self.rows.get(bare + " ")  # cores have a key of their own
        if at is None:
            at = self.used
            if at == len(self.emit):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[at] = self.field.weights[self.field.slots(bare)].sum(axis=0)
            self.rows[bare + " "] = at
            self.used += 1
        return at

    used = 0

    def chain(self, text: str | None) -> np.ndarray:
        """Rows of the words of a text that have a letter."""
        words = (text or "").split()
        get, rows = self.rows.get, self.rows
        found = list(map(get, words))
        if None in found:
            for k, at in enumerate(found):
                if at is None:
                    at = get(words[k])
                    if at is None:
                        at = rows[words[k]] = self._row(words[k])
                    found[k] = at
        chain = np.array(found, np.int64)
        return chain[chain >= 0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language of each text, its mean share, and the mean of the largest share of each word."""
        n = len(self.field.languages)
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
            self.used = 0
        sums, sizes, sure = np.zeros((len(texts), n)), np.zeros(len(texts)), np.zeros(len(texts))
        chains, owners = [], []
        for k, text in enumerate(texts):
            chain = self.chain(text)
            sizes[k] = len(chain)
            for start in range(0, len(chain), CHAIN):
                chains.append(chain[start : start + CHAIN])
                owners.append(k)
        lengths = np.array([len(c) for c in chains], np.int64)
        order, owners = np.argsort(lengths, kind="stable"), np.array(owners, np.int64)
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * lengths[order[stop]] <= CELLS:
                stop += 1
            part = order[start:stop]
            words = np.zeros((lengths[part].max(), len(part)), np.int64)
            for k, c in enumerate(part):
                words[: lengths[c], k] = chains[c]
            found, _ = forward_backward(self.emit[words], lengths[part], self.move)
            np.add.at(sums, owners[part], found.sum(axis=0))
            np.add.at(sure, owners[part], found.max(axis=2).sum(axis=0))
            start = stop
        best = sums.argmax(axis=1)
        none = sizes == 0
        scores = np.where(none, 0.0, np.clip(sums[np.arange(len(texts)), best] / np.maximum(sizes, 1), 0, 1))
        return [UNKNOWN if z else self.field.languages[b] for b, z in zip(best, none)], scores.tolist(), np.clip(sure / np.maximum(sizes, 1), 0, 1).tolist()


def predict(text: str | Column, field: Field | None, spark) -> Column:
    """Struct of `lang_pred`, `score` and `certainty`, that of the words whatever their languages, for every whole text."""
    if field is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("certainty"))
    import uuid

    token, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(field)

    @F.arrow_udf("struct<lang_pred: string, score: double, certainty: double>")
    def languages(texts: pa.Array) -> pa.Array:
        reader, names, scores, sure = held(("field", token), lambda: Reader(shared.value)), [], [], []
        for start in range(0, len(texts), 1_000):
            with no_collection():
                part = reader.predict(texts.slice(start, 1_000).to_pylist())
            names += part[0]
            scores += part[1]
            sure += part[2]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], ["lang_pred", "score", "certainty"])

    return languages(text)
