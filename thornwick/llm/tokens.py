"""Exact encoding by the public tokenizers, with each distinct piece of text encoded once a worker.

A byte-level vocabulary (keeps_space) is cut before white space, which its pattern never crosses from the left, so a piece
is white space with the word after it; a vocabulary that drops white space is cut at it. Pieces are found, hashed and
looked up as arrays, about half a million bytes of text at once; only those not seen before go to the tokenizer. Texts with white
space outside ASCII are encoded whole where white space counts. Keys are 64-bit hashes of a piece within one worker's
memory, which is bounded: a full store keeps its earliest, most frequent half.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from thornwick.llm.common import mix, run_hash, text_chunks, words_of

_U = np.uint64
STORE = 400_000
CHUNK = 1 << 19


def load(name: str):
    """A tokenizer of the public folder, by file name or path; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where a white-space character outside ASCII starts (U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000)."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(at):
        return at
    padded = np.r_[data, np.zeros(2, np.uint8)]
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    e2 = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[two | three | e2]


class Cached:
    """Encodes columns of texts; holds the ids of the pieces that it has met."""

    def __init__(self, name: str, keeps_space: bool, store: int | None = None) -> None:
        self.tokenizer, self.keeps_space, self.store = load(name), keeps_space, store or STORE
        self.slot: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of a slot's ids, which start where the slot before it ends
        self.lengths = np.zeros(1 << 16, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        for i in range(0, len(pieces), 20_000):
            some = pieces[i : i + 20_000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.asarray(found.word_ids, np.int64), np.arange(1, len(some) + 1))
            first = len(self.slot)
            base = int(self.ends[first - 1]) if first else 0
            n, m = first + len(some), base + len(found.ids)
            while n > len(self.ends):
                self.ends, self.lengths = np.r_[self.ends, np.zeros_like(self.ends)], np.r_[self.lengths, np.zeros_like(self.lengths)]
            while m > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            self.ids[base:m] = found.ids
            self.ends[first:n] = base + ends
            self.lengths[first:n] = np.diff(ends, prepend=0)
            self.slot.update(zip(keys[i : i + 20_000], range(first, n), strict=True))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, byte starts, byte ends of a chunk's pieces, and the index of each row's first one (and the end)."""
        keys, starts, ends, first = words_of(data, offsets)
        if not self.keeps_space:
            return keys, starts, ends, first
        before = np.empty(len(starts), np.int64)
        if len(starts):
            before[0], before[1:] = 0, ends[:-1]
            has = first[:-1] < first[1:]
            before[first[:-1][has]] = offsets[:-1][has]
        gap = starts - before
        mark = np.where(gap == 0, 0, data[np.minimum(before, max(len(data) - 1, 0))]) if len(starts) else gap
        keys = mix(keys + mark.astype(_U) + _U(1))
        odd = np.flatnonzero(gap > 1)
        if len(odd):
            keys[odd] = run_hash(data.astype(_U) + _U(1), before[odd], ends[odd]) ^ _U(0x5BD1E995)
        # white space that ends a text is a piece of its own
        last = np.where(first[:-1] < first[1:], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        rest = np.flatnonzero(last < offsets[1:])
        if len(rest):
            more = run_hash(data.astype(_U) + _U(1), last[rest], offsets[1:][rest]) ^ _U(0x5BD1E995)
            place = first[1:][rest]
            keys, before, ends = np.insert(keys, place, more), np.insert(before, place, last[rest]), np.insert(ends, place, offsets[1:][rest])
            first = first + np.searchsorted(rest, np.arange(len(first)))
        return keys, before, ends, first

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For stretches of rows i to j: their ids one after another, and the bounds of each row's."""
        for i, j, data, offsets in text_chunks(column, CHUNK):
            keys, starts, ends, first = self._pieces(data, offsets)
            distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.slot) > self.store:
                self.slot = {k: s for k, s in self.slot.items() if s < self.store // 2}
            names = distinct.tolist()
            slots = list(map(self.slot.get, names))
            missing = [k for k, s in enumerate(slots) if s is None]
            if missing:
                raw = data.tobytes()
                self._learn([names[k] for k in missing], [raw[starts[at[k]] : ends[at[k]]].decode() for k in missing])
                for k in missing:
                    slots[k] = self.slot[names[k]]
            slot = np.asarray(slots, np.int64)[inverse]
            lengths = self.lengths[slot]
            upto = np.concatenate(([0], np.cumsum(lengths)))
            ids = self.ids[np.repeat(self.ends[slot] - lengths - upto[:-1], lengths) + np.arange(upto[-1])]
            bounds = upto[first]
            if self.keeps_space and len(wide := _wide_space(data)):
                ids, bounds = self._replace(data, offsets, ids, bounds, np.unique(np.searchsorted(offsets, wide, "right") - 1))
            yield i, j, ids, bounds

    def _replace(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        for r in rows.tolist():
            parts[r] = self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode())
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [ids[s:e] for _, _, ids, bounds in self.encode_column(pa.array(texts, pa.string())) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def cached(name: str, keeps_space: bool, store: int | None = None) -> Cached:
    """The worker's own encoder, which later tasks of the worker find filled; store pieces take about 150 bytes each."""
    return Cached(name, keeps_space, store)
