"""Texts cut at spaces, and ids put together again, on whole arrays: Python's own objects are distinct pieces only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut together. A longer text is cut alone.
RUN_BYTES = 4 << 20


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Slices of about so many bytes; NULL becomes the empty text."""
    texts = pc.fill_null(texts, pa.scalar("").cast(texts.type))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces between single spaces, the places among them of all pieces, and where each text's pieces begin."""
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), lists.offsets.to_numpy()


@dataclass
class Strings:
    """Strings of numbers, end to end."""

    values: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, parts: list[bytes], dtype: str = "<u4") -> Strings:
        values = np.frombuffer(b"".join(parts), dtype)
        return cls(values, np.fromiter(map(len, parts), np.int64, len(parts)) // values.itemsize)

    def take(self, at: np.ndarray) -> Strings:
        """The strings at these places, in their order."""
        begin, n = np.cumsum(self.sizes) - self.sizes, self.sizes[at]
        ends = np.cumsum(n)
        return Strings(self.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[at] - ends + n, n)], n)

    def joined(self, offsets: np.ndarray) -> list[bytes]:
        """Bytes of the strings between one offset and the next."""
        ends = (np.r_[0, np.cumsum(self.sizes)][offsets] * self.values.itemsize).tolist()
        raw = self.values.tobytes()
        return [raw[i:j] for i, j in zip(ends, ends[1:])]


class Memory:
    """What a worker remembers of strings. When the young generation is full it becomes the old one, so strings in use survive."""

    def __init__(self, longest: int):
        self.longest = longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str], most: int, learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of every one of the distinct keys; `most` in a generation; `learn` gives those of new keys."""
        wanted = [k for k in keys if k not in self.young]
        if wanted and len(self.young) + len(wanted) > most:
            self.old, self.young, wanted = self.young, {}, keys
        new = []
        for k in wanted:
            if (value := self.old.get(k)) is None:
                new.append(k)
            else:
                self.young[k] = value
        self.young.update(zip(new, learn(new), strict=True))
        out = list(map(self.young.__getitem__, keys))
        for k in new:
            if len(k) > self.longest:
                del self.young[k]
        return out
