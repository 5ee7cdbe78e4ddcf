"""Ids of white-space-delimited pieces of text, encoded by the tokenizers library once and remembered.

A tokenizer whose pre-tokenizer never joins what white space separates, and drops the white space,
gives a text the ids of its pieces, one after the other. Pieces repeat, so a worker remembers them, up to a fixed number.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from touchline.llm.bpe_automaton import byte_letters
from touchline.llm.common import held, no_collection
from touchline.llm.pieces import Memory, Strings, cut, runs

#: Most pieces in each of a worker's two generations, and the longest; others are encoded where they occur.
MOST_PIECES, LONGEST_PIECE = 450_000, 64
#: A character that stands between pieces when many are encoded in one call.
MARK = "\x01"
#: A run of Latin-1 letters, then perhaps a run of signs: two pre-tokens at most, which NFC leaves alone.
PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)\\z"


class PieceCache:
    """Ids of pieces as little-endian unsigned 32-bit integers, and a worker's memory of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lowers = any(s["type"] == "Lowercase" for s in steps)
        mark = self._encode([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.memory = Memory(LONGEST_PIECE)
        self.bare = self._bare_tokenizer(path, spec)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bare_tokenizer(self, path: str, spec: dict):
        """The model alone, for words already spelled in byte letters, if the file cuts letters from signs and marks where words end."""
        kinds = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if not (suffix and self.lowers and kinds == ["Split", "ByteLevel"]):
            return None
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        bare = Tokenizer.from_file(path)
        bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(bare.get_vocab_size(), bool)
        self.ends_word[[k for token, k in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        return bare

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin-1 letters, a thousand at a time, told apart by tokens that end a word."""
        out: list[bytes] = []
        for start in range(0, len(words), 1000):
            part = words[start : start + 1000]
            part = map(str.lower, part)  # texts with special strings come here as they are
            spelled = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part])
            ids = np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            at, raw = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]
        if len(out) != len(words):
            raise ValueError("a word without an end")
        return out

    def _odd(self, pieces: list[str]) -> list[bytes]:
        """Ids of any pieces, a hundred at a time, told apart by the mark's id."""
        found: dict[str, bytes] = {}
        plain = [p for p in pieces if MARK not in p] if self.mark is not None else []
        for start in range(0, len(plain), 100):
            part = plain[start : start + 100]
            ids = np.array(self._encode([f" {MARK} ".join(part)])[0], "<u4")
            at, raw = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            found.update(zip(part, [raw[i:j] for i, j in zip([0, *(k + 4 for k in at)], [*at, len(raw)])], strict=True))
        for p in pieces:
            if p not in found:
                found[p] = np.array(self._encode([p])[0], "<u4").tobytes()
        return [found[p] for p in pieces]

    def _known(self, pieces: pa.Array) -> Strings:
        """Ids of distinct pieces: letters and the signs behind them apart where that is the same, the rest as they are."""
        if self.bare is None:
            return Strings.of(self.memory.of(pieces.to_pylist(), MOST_PIECES, self._odd))
        split = pc.extract_regex(pieces, PLAIN)
        plain = split.is_valid()
        words, signs = (split.filter(plain).field(k).dictionary_encode() for k in range(2))
        odd = pieces.filter(pc.invert(plain))
        parts = self.memory.of(words.dictionary.to_pylist(), MOST_PIECES, self._words)
        parts += self.memory.of(signs.dictionary.to_pylist(), MOST_PIECES, self._odd)
        parts += self.memory.of(odd.to_pylist(), MOST_PIECES, self._odd)
        parts.append(b"")
        places, plain = np.full((len(pieces), 2), len(parts) - 1), plain.to_numpy(zero_copy_only=False)
        places[plain, 0] = words.indices.to_numpy()
        places[plain, 1] = len(words.dictionary) + signs.indices.to_numpy()
        places[~plain, 0] = len(parts) - 1 - len(odd) + np.arange(len(odd))
        both = Strings.of(parts).take(places.ravel())
        return Strings(both.values, both.sizes.reshape(-1, 2).sum(1))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, cut at spaces and line feeds. A-Z are lowered first where the tokenizer does so anyway."""
        if self.lowers:
            low = pc.ascii_lower(texts)
            for s in self.special:
                low = pc.if_else(pc.match_substring(low, s.lower()), texts, low)
            texts = low
        pieces, at, offsets = cut(pc.replace_substring(texts, "\n", " "))
        return self._known(pieces).take(at).joined(offsets)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [x for run in runs(pa.array(texts, pa.string())) for x in self.encode(run)]


def piece_cache(path: str) -> PieceCache:
    """A worker's memory for the tokenizer file at `path`."""
    return held(("pieces", path), lambda: PieceCache(path))


def encode_texts(path: str, texts: list[str | None] | pa.Array) -> list[bytes]:
    """Ids of every whole text (NULL: of the empty text)."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    out: list[bytes] = []
    for run in runs(texts):
        cache = piece_cache(path)
        with no_collection():
            out += cache.encode(run)
    return out
