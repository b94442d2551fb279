"""Ids of words met before, kept from batch to batch in Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of each list's."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.empty(int(sizes.sum()), dtype=np.uint32)
    at = 0
    for ids in lists:
        flat[at : at + len(ids)] = ids
        at += len(ids)
    return flat, sizes


class WordStore:
    """Encodes each word once while the store holds it; emptied when it outgrows ``max_bytes``.

    encode gives the ids of an Arrow array of words and the number of each word's. There is no Python
    object per word; a batch's distinct words are looked up in one Arrow call.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], max_bytes: int = 16_000_000, block: int = 20_000):
        self.encode, self.max_bytes, self.block = encode, max_bytes, block
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place in flat and sizes; words: without nulls."""
        if self.words.nbytes + self.flat.nbytes + self.sizes.nbytes > self.max_bytes:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        found = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            found[missing] = len(self.words) + np.arange(len(missing))
            new = words.take(pa.array(missing))
            parts = [self.encode(new.slice(low, self.block)) for low in range(0, len(new), self.block)]
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, *(p[0] for p in parts)])
            self.sizes = np.concatenate([self.sizes, *(p[1].astype(np.int32) for p in parts)])
        return found
