"""Token ids of many texts at once.

The byte-level vocabulary never merges across its pre-tokens, so a text's ids are those of
its pre-tokens in a row. Pre-tokens are cut by numpy over whole batches, hashed, and only
the distinct ones of a batch that the task has not met before go to the tokenizer. Texts
with characters beyond U+00FF, or with rare white space, go to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from tidemark.llm import textbytes as tb

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _class_of(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)[0]
    return _SPACE if c.isspace() else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER


_CLASS = np.array([_class_of(k) for k in range(256)], np.uint8)
#: Bytes that send a text to the tokenizer whole: beyond U+00FF, and separators that regular expressions disagree on.
_RARE = np.zeros(256, bool)
_RARE[0xC4:] = True
_RARE[0x1C:0x20] = True
_MOST_CACHED = 400_000


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of texts without rare bytes; pre-tokens tile the texts.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    kind[lead] = kind[lead + 1] = _CLASS[((data[lead] & 3) << 6) | (data[lead + 1] & 63)]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    spaces = kind[starts] == _SPACE
    at_end = first[ends]
    blank_before = np.zeros(len(starts), bool)
    blank_before[1:] = (data[starts[1:] - 1] == 0x20) & ~first[starts[1:]]
    mark = np.zeros(n + 1, bool)
    mark[starts[~spaces] - blank_before[~spaces]] = True
    blank_last = data[ends - 1] == 0x20
    own = spaces & (at_end | (ends - starts > 1) | ~blank_last)
    mark[starts[own]] = True
    mark[ends[spaces & ~at_end & ~blank_last] - 1] = True
    # contractions: an apostrophe by itself, without a blank before, and the letters after it
    lone = np.flatnonzero((data[starts] == 0x27) & (ends - starts == 1) & ~blank_before & ~at_end)
    if len(lone):
        lone = lone[kind[np.minimum(ends[lone], n - 1)] == _LETTER]
        at, stop = starts[lone], ends[np.minimum(lone + 1, len(ends) - 1)]
        one, two = data[at + 1], np.where(at + 2 < stop, data[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        size = np.where(short, 1, np.where(long, 2, 0))
        at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
        mark[at + 1] = False
        rest = at + 1 + size < stop
        mark[(at + 1 + size)[rest]] = True
    return np.flatnonzero(mark[:n])


class BatchTokenizer:
    """Ids by a ``tokenizers`` file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.edges = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encoded = self._encode(texts)
        sizes = np.array([len(x) for x in encoded], np.int64)
        self.slots = np.concatenate([self.slots, len(self.edges) - 1 + np.arange(len(keys))])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in encoded for y in x), np.uint32, int(sizes.sum()))])
        self.keys = np.concatenate([self.keys, keys])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.slots = self.keys[order], self.slots[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of the texts in ``data``."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        # U+0080 to U+00A0 hold white space; their second byte follows 0xC2
        rare = _RARE[data]
        rare[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        slow = tb.segment_sums(rare.astype(np.int64), sizes) > 0
        counts = np.zeros(n, np.int64)
        if slow.any():
            whole = dict(zip(np.flatnonzero(slow).tolist(), self._encode([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in np.flatnonzero(slow)])))
            keep = np.repeat(~slow, sizes)
            fast_data, fast_offsets = data[keep], np.concatenate([[0], np.cumsum(sizes[~slow])])
        else:
            whole, fast_data, fast_offsets = {}, data, offsets
        ids, fast_counts = self._fast(fast_data, fast_offsets)
        if not whole:
            return ids, fast_counts
        counts[~slow] = fast_counts
        pieces, at = [], 0
        for k in range(n):
            if k in whole:
                counts[k] = len(whole[k])
                pieces.append(np.array(whole[k], np.uint32))
            else:
                pieces.append(ids[at : at + counts[k]])
                at += counts[k]
        return np.concatenate(pieces), counts

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        starts = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        kinds, first, inverse = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > _MOST_CACHED:
            self._forget()
        slot = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = self.keys[slot] != kinds if len(self.keys) else np.ones(len(kinds), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(kinds[new], [raw[starts[k] : ends[k]].decode() for k in first[new]])
            slot = np.searchsorted(self.keys, kinds)
        token = self.slots[slot][inverse]
        begin, size = self.edges[token], self.edges[token + 1] - self.edges[token]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(int(total[-1]))]
        return ids, tb.segment_sums(size, np.diff(np.searchsorted(starts, offsets)))


_loaded: dict[str, BatchTokenizer] = {}


def tokenizer(path: str) -> BatchTokenizer:
    """The worker's tokenizer for a file."""
    if path not in _loaded:
        _loaded[path] = BatchTokenizer(path)
    return _loaded[path]


def encode_column(path: str, column: pa.Array):
    """Yield (first row, end row, ids, ids per text) for parts of a column."""
    for row, end, data, offsets in tb.chunks(column, 1 << 20):
        yield row, end, *tokenizer(path).encode(data, offsets)
