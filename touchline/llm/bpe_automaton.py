"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton accepts exactly the token sequences that the merges can produce. It starts as one
state with an arc for every byte. Each merge (u, v) -> w, in order of rank, applies one gadget:

* the arcs labelled v leave the state that u leads to (u before v is no longer a final spelling);
* every state that has an arc u, and from there had v, gains an arc w;
* w leads to a copy of the state v led to, as it was before later merges.

So a state is named by the token that leads to it, and a transition is a pair of tokens. Copies are not written out: after the last gadget the
automaton is compiled into flat arrays - the state each state was copied from, the rank at which, and a hash table of (state, label) with the rank
at which that arc was cut - and an arc is looked up by walking a few of their entries.

A word is encoded by running through its bytes once: at every position exactly one state is reached, since each prefix has
exactly one spelling, and the arcs taken are the tokens. Words that a worker has not met are run together, one position of all of them at a
time, so that time goes with their bytes times the length of the longest tokens that begin there.

Texts: NULL is the empty text and gives no ids. Special tokens in a text become their own ids. Whole texts are encoded, however long; words
of more than `LONGEST_WORD` bytes are run one by one. Repeated rows get equal ids, empty tables give none, other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.llm.common import held, no_collection
from touchline.llm.pieces import Memory, Strings, cut, runs

#: Fixed values of byte-level vocabularies: the pattern that splits a text into words. Classes of characters are filled in below.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
COMMON = "\u0558"
#: Most words in each of a worker's two generations; the longest word that is run with others; bytes run at a time.
MOST, LONGEST_WORD, CELLS = 350_000, 64, 400_000
#: Logarithm of the number of answers about arcs that are kept.
ANSWER_BITS = 20
#: Pieces that are a run of Latin-1 letters, a word together with the space before it, and perhaps a run of signs, another word.
PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)\\z"
#: Texts that are not cut at spaces: those with characters from `COMMON` on, or with a space inside or at the end of a run of
#: white space, which the last but one of `WORDS` takes as one word. At other spaces a word begins or white space ends.
WHOLE = "[^\\x{0}-\\x{557}]|[\\x{9}-\\x{d} \\x{85}\\x{a0}] (?:[\\x{9}-\\x{d} \\x{85}\\x{a0}]|\\z)"


class Table:
    """Integer keys (not negative) to integers: open addressing in two arrays, asked for many keys at once."""

    def __init__(self, entries: dict[int, int]):
        keys = np.fromiter(entries.keys(), np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int64, len(entries))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        home, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            at = home[left] + self.probes & len(self.keys) - 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, self.probes = left[~here], self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for keys that are not there."""
        at = self._home(keys)
        out, found = self.values[at], self.keys[at]
        out[found != keys] = -1
        left = np.flatnonzero((found != keys) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            place = at[left] + probe & len(self.keys) - 1
            found = self.keys[place]
            here = found == keys[left]
            out[left[here]] = self.values[place[here]]
            left = left[~here & (found >= 0)]
        return out


def common_pattern() -> re.Pattern:
    """`WORDS` for texts below `COMMON`, with letters, numbers and white space as ranges."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": [*range(9, 14), 0x20, 0x85, 0xA0]}
    for code in range(ord(COMMON)):
        kinds.get(unicodedata.category(chr(code))[0], []).append(code)
    kinds["S"] = sorted({c for c in kinds["S"] if chr(c).isspace() and c not in range(28, 32)})

    def ranges(codes: list[int]) -> str:
        begin = [c for c in codes if c - 1 not in codes]
        end = [c for c in codes if c + 1 not in codes]
        return "".join(f"\\u{i:04x}-\\u{j:04x}" for i, j in zip(begin, end))

    return re.compile(re.sub("[LNS]", lambda m: ranges(kinds[m[0]]), WORDS))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class Automaton:
    """States and arcs compiled from merges, one gadget per merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        self.label: dict[int, bytes] = {}
        self.left: dict[int, int] = {}
        self.origin: dict[int, int] = {}  # the state a state was copied from
        self.born: dict[int, int] = {}  # the rank of the gadget that made the state; -1 for bytes
        self.cut: dict[tuple[int, int], int] = {}  # (state, label) -> rank at which the arc was cut
        self.step: dict[int, int] = {}  # (node of the labels' prefix tree << 8 | byte) -> node
        self.token = [-1]  # by node: the token spelled so far, or -1
        self.node: dict[int, int] = {}  # by token
        for letter in letters:
            if letter in vocab:
                self._add(vocab[letter], spell(letter), -1)
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self._compile()

    def _add(self, token: int, label: bytes, rank: int) -> None:
        if token in self.born:
            raise ValueError(f"two merges form token {token}")
        self.label[token], self.born[token] = label, rank
        node = 0
        for byte in label:
            key = node << 8 | byte
            if (node := self.step.get(key)) is None:
                node = self.step[key] = len(self.token)
                self.token.append(-1)
        self.token[node], self.node[token] = token, node

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u not in self.born or v not in self.born:
            raise ValueError(f"merge {rank} uses a token that no earlier merge forms")
        reachable = self._has(u, v, rank)
        self.left[w], self.origin[w] = u, v
        self._add(w, self.label[u] + self.label[v], rank)
        if not reachable:  # other merges always come first: no state has this arc
            self.token[self.node[w]] = -1
        self.cut[u, v] = rank

    def _has(self, state: int, label: int, before: int) -> bool:
        """Whether `state` has an arc `label`, counting the gadgets of ranks below `before`."""
        until = before
        while True:
            s, limit = state, until
            while True:  # along the copies, each frozen at the rank of the copy
                rank = self.cut.get((s, label))
                if rank is not None and rank < limit:
                    return False
                if s not in self.origin:
                    break
                s, limit = self.origin[s], min(limit, self.born[s])
            if label not in self.left:
                return True
            # an arc w was added where the state had u when w's own cut was already made
            until, label = min(until, self.born[label] + 1), self.left[label]

    def _compile(self) -> None:
        """The flat arrays that words are run through."""
        size = max(self.born, default=-1) + 1
        self.flat_left, self.flat_origin, self.flat_born = (np.full(size, -1, np.int64) for _ in range(3))
        for flat, of in ((self.flat_left, self.left), (self.flat_origin, self.origin), (self.flat_born, self.born)):
            flat[list(of)] = list(of.values())
        self.cuts = Table({u << 32 | v: rank for (u, v), rank in self.cut.items()})
        self.steps, self.tokens = Table(self.step), np.array(self.token, np.int64)
        del self.left, self.origin, self.born, self.cut, self.node  # of use to the gadgets only
        self.asked, self.answers = np.full(1 << ANSWER_BITS, -1, np.int64), np.zeros(1 << ANSWER_BITS, bool)

    def follows(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each state has its arc. Answers are kept where their pair's number points to; pairs of the same place take turns."""
        key = state << 32 | label
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ANSWER_BITS)).view(np.int64)
        ok, new = self.answers[place], np.flatnonzero(self.asked[place] != key)
        if len(new):
            found = ok[new] = self._walk(state[new], label[new])
            # key and answer of one assignment each go by the same order, so of pairs that share a place one leaves both
            self.asked[place[new]] = key[new]
            stays = self.asked[place[new]] == key[new]
            self.answers[place[new[stays]]] = found[stays]
        return ok

    def _walk(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The same by a walk along copies and added arcs, as in `_has`, for all pairs at once."""
        ok = np.ones(len(state), bool)
        todo, s, label = np.arange(len(state)), state.copy(), label.copy()
        first, until = state.copy(), np.full(len(state), 1 << 40, np.int64)
        limit = until.copy()
        while len(todo):
            rank = self.cuts.get(s << 32 | label)
            cut = (rank >= 0) & (rank < limit)
            ok[todo[cut]] = False
            origin, left = self.flat_origin[s], self.flat_left[label]
            copied = origin >= 0
            # on to the state this one was copied from, or, where copies end, to the arc this arc was added for
            new_s = np.where(copied, origin, first)
            new_limit = np.where(copied, np.minimum(limit, self.flat_born[s]), np.minimum(until, self.flat_born[label] + 1))
            until = np.where(copied, until, new_limit)
            goes = ~cut & (copied | (left >= 0))
            label = np.where(copied, label, left)[goes]
            todo, s, limit, until, first = todo[goes], new_s[goes], new_limit[goes], until[goes], first[goes]
        return ok

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * len(words[order[stop]]) <= CELLS:
                stop += 1
            part = order[start:stop]
            for k, ids in zip(part, self._run([words[k] for k in part])):
                out[k] = ids
            start = stop
        return out

    def _run(self, words: list[bytes]) -> list[bytes]:
        """The same for words of ascending lengths, all positions in one matrix."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths[-1])
        if not width:
            return [b""] * len(words)
        cells = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).astype(np.int64)
        begin = np.flatnonzero(np.arange(width)[None, :] < lengths[:, None])
        last = begin // width * width + lengths[begin // width]  # the cell behind its word
        node, arcs, size = np.zeros(len(begin), np.int64), [], 0
        while len(begin):  # every token that begins in a cell, by length
            node = self.steps.get(node << 8 | cells[begin + size])
            size += 1
            token = np.where(node >= 0, self.tokens[node], -1)
            arcs.append((begin[token >= 0], np.full(int((token >= 0).sum()), size), token[token >= 0]))
            on = (node >= 0) & (begin + size < last)
            begin, last, node = begin[on], last[on], node[on]
        begin, size, token = (np.concatenate(c) for c in zip(*arcs))
        column = begin % width
        by_column = np.argsort(column, kind="stable")
        border = np.searchsorted(column[by_column], np.arange(width + 1))
        reached, came = np.full(len(words) * (width + 1), -1, np.int64), np.zeros(len(words) * (width + 1), np.int64)
        place = begin + begin // width  # a column more: a word's end is a position, too
        for k in range(width):
            here = by_column[border[k] : border[k + 1]]
            if k:
                here = here[self.follows(reached[place[here]], token[here])]
            reached[place[here] + size[here]] = token[here]
            came[place[here] + size[here]] = size[here]
        at, row = np.arange(len(words)) * (width + 1) + lengths, np.arange(len(words))
        taken, count = np.zeros((len(words), width), "<u4"), np.zeros(len(words), np.int64)
        row, at = row[lengths > 0], at[lengths > 0]
        while len(row):
            count[row] += 1
            taken[row, width - count[row]] = reached[at]
            at = at - came[at]
            on = at % (width + 1) > 0
            row, at = row[on], at[on]
        raw, stride = taken.tobytes(), 4 * width
        return [raw[(k + 1) * stride - 4 * n : (k + 1) * stride] for k, n in enumerate(count.tolist())]

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word, of any length."""
        n, step = len(word), self.step.get
        reached, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            ends, node = [], 0
            for j in range(i, n):
                node = step(node << 8 | word[j])
                if node is None:
                    break
                if self.token[node] >= 0:
                    ends.append((j + 1, self.token[node]))
            if i:
                fits = self.follows(np.full(len(ends), reached[i], np.int64), np.array([t for _, t in ends], np.int64)).tolist()
                ends = [e for e, ok in zip(ends, fits) if ok]
            for j, token in ends:
                reached[j], came[j] = token, i
        out, at = [], n
        while at:
            out.append(reached[at])
            at = came[at]
        return out[::-1]


class Codec:
    """A tokenizer file's vocabulary, merges and special tokens; a worker's memory of words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = Automaton(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = dict(self.automaton.label) | {i: s.encode() for s, i in self.special.items()}
        self.known_ids = np.zeros(max(labels, default=-1) + 1, bool)
        self.known_ids[list(labels)] = True
        self.labels = Strings.of([labels.get(i, b"") for i in range(len(self.known_ids))], "u1")
        self.pattern = common_pattern()
        self.library_split = None
        self.path = path
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.memory = Memory(LONGEST_WORD)

    def words(self, text: str) -> list[str]:
        """Words of a text or piece. Versions of Unicode disagree on letters beyond `COMMON`; there the library splits."""
        if text.isascii() or max(text) < COMMON:
            return self.pattern.findall(text)
        if self.library_split is None:
            from tokenizers import Tokenizer

            self.library_split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        return [text[begin:end] for _, (begin, end) in self.library_split(text)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, run through the automaton, and of special tokens, which no word equals."""
        raw = [w.encode() for w in words]
        out = [b""] * len(words)
        short = []
        for k, (word, w) in enumerate(zip(words, raw)):
            if word in self.special:
                out[k] = np.array([self.special[word]], "<u4").tobytes()
            elif len(w) > LONGEST_WORD:
                out[k] = np.array(self.automaton.encode(w), "<u4").tobytes()
            else:
                short.append(k)
        for k, ids in zip(short, self.automaton.encode_many([raw[k] for k in short])):
            out[k] = ids
        return out

    def _parts(self, text: str) -> list[str]:
        """Words of a text, and the special tokens in it, which no word equals."""
        if not text:
            return []
        if not (self.specials and any(s in text for s in self.special)):
            return self.words(text)
        return [w for k, part in enumerate(self.specials.split(text)) if part for w in ([part] if k % 2 else self.words(part))]

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of lists of words."""
        words = list({w for parts in texts for w in parts})
        ids = dict(zip(words, self.memory.of(words, MOST, self._learn)))
        return [b"".join(map(ids.__getitem__, parts)) for parts in texts]

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose words are those of their pieces, a space before every piece but the first."""
        pieces, at, offsets = cut(texts)
        first = offsets[:-1]
        split = pc.extract_regex(pieces, PLAIN)
        plain = split.is_valid()
        words, signs = (split.filter(plain).field(k).dictionary_encode() for k in range(2))
        spaced = pc.binary_join_element_wise("", words.dictionary, " ").to_pylist()
        odd = [self.words(" " + p) for p in pieces.filter(pc.invert(plain)).to_pylist()]
        odd += [self.words(p) for p in pieces.take(at[first]).to_pylist()]
        parts = self.memory.of(spaced + signs.dictionary.to_pylist(), MOST, self._learn) + self._joined(odd) + [b""]
        # a piece is a word and its signs, or one of the odd ones, which the first pieces of texts follow
        places, plain = np.full((len(pieces) + len(first), 2), len(parts) - 1), plain.to_numpy(zero_copy_only=False)
        places[: len(pieces)][plain, 0] = words.indices.to_numpy()
        places[: len(pieces)][plain, 1] = len(spaced) + signs.indices.to_numpy()
        places[~np.r_[plain, np.zeros(len(first), bool)], 0] = len(parts) - 1 - len(odd) + np.arange(len(odd))
        both = Strings.of(parts).take(places.ravel())
        at = at.copy()
        at[first] = len(pieces) + np.arange(len(first))
        return Strings(both.values, both.sizes.reshape(-1, 2).sum(1)).take(at).joined(offsets)

    def encode_run(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        whole = pc.match_substring_regex(texts, WHOLE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        spaced = iter(self._spaced(texts.filter(pc.invert(whole))))
        taken_whole = iter(self._joined([self._parts(t) for t in texts.filter(whole).to_pylist()]))
        return [next(taken_whole if w else spaced) for w in whole.to_pylist()]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_run(pa.array([text], pa.string()))[0]

    def decode_run(self, ids: list[bytes]) -> list[str]:
        """The text of each row of ids."""
        found = Strings.of(ids)
        if len(found.values) and (int(found.values.max()) >= len(self.known_ids) or not self.known_ids[found.values].all()):
            raise KeyError("an id that is not in the vocabulary")
        raw = self.labels.take(found.values).joined(np.r_[0, np.cumsum(found.sizes)])
        return [r.decode("utf-8", "replace") for r in raw]

    def decode(self, ids: bytes) -> str:
        return self.decode_run([ids])[0]


def codec(path: str) -> Codec:
    """A worker's memory for the tokenizer file at `path`."""
    return held(("codec", path), lambda: Codec(path))


def encode(text: str | Column, path: str) -> Column:
    """Ids of whole texts by the tokenizer file at `path`: little-endian unsigned 32-bit integers, one binary value a row."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(path)
        with no_collection():
            return pa.array([ids for run in runs(texts) for ids in c.encode_run(run)], pa.binary())

    return ids(text)


def decode(ids: str | Column, path: str) -> Column:
    """The text of ids, special tokens included; bytes that are not UTF-8 become the replacement character. NULL stays NULL."""

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        c = codec(path)
        parts = (c.decode_run(run.to_pylist()) for run in runs(values.fill_null(b"")))
        found = [t for part in parts for t in part]
        return pa.array(found, pa.string(), mask=values.is_null().to_numpy(zero_copy_only=False))

    return texts(ids)
