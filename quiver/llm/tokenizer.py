"""Encoding of a corpus with a public byte-level BPE vocabulary.

The distinct words of a block of rows are laid out in one array of symbols. An index maps each pair of neighbouring
symbols to all its positions in the block; the active ranks are taken in ascending order from a heap, all positions
of a rank are merged at once, and only the lists of the pairs that this makes or breaks are updated. As a merged
symbol occurs in later ranks only, one ascending pass gives what merging word by word gives.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files of public tokenizers are found.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")

#: The published pattern that splits a text into words before byte-level merges, and the white space
#: of its engine. `Words` finds the same words with array operations.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Characters in a block of rows, and words that a worker keeps encoded between blocks.
BLOCK_CHARS, KEPT_WORDS = 4_000_000, 400_000


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of the bytes in byte-level vocabularies: bytes in Latin-1's visible ranges stand
    for themselves, the others for the characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Symbols and ranked merges of one vocabulary file (JSON with `model.vocab` and `model.merges`)."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text())["model"]
        ids, to_byte = model["vocab"], _byte_characters()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for name, byte in to_byte.items():
            self.of_byte[byte] = ids[name]
        self.base = max(ids.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index of all of them."""
        if not words:
            return []
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        symbol = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(data)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        after[ends[lengths > 0]] = n
        before[starts[lengths > 0]] = -1
        live = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            """Put positions into the lists of their pairs' ranks."""
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        first = np.flatnonzero(after < n)
        note(first, self.rank(symbol[first], symbol[after[first]]))
        by_rank_left, by_rank_right = np.empty(len(self.made), dtype=np.int64), np.empty(len(self.made), dtype=np.int64)
        by_rank_left[self.ranks], by_rank_right[self.ranks] = self.keys // self.base, self.keys % self.base
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            left, right = by_rank_left[r], by_rank_right[r]
            # positions whose pair an earlier rank has changed are no longer in the list's pair
            at = at[live[at] & (symbol[at] == left)]
            nxt = after[at]
            keep = nxt < n
            at, nxt = at[keep], nxt[keep]
            keep = symbol[nxt] == right
            at, nxt = at[keep], nxt[keep]
            if left == right and len(at) > 1:  # overlapping runs: every other position, from the left
                fresh = np.concatenate(([True], nxt[:-1] != at[1:]))
                run = np.cumsum(fresh) - 1
                place = np.arange(len(at)) - np.flatnonzero(fresh)[run]
                at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
            if not len(at):
                continue
            symbol[at] = self.made[r]
            live[nxt] = False
            far = after[nxt]
            after[at] = far
            inner = far < n
            before[far[inner]] = at[inner]
            note(at[inner], self.rank(symbol[at[inner]], symbol[far[inner]]))
            near = before[at]
            outer = near >= 0
            note(near[outer], self.rank(symbol[near[outer]], symbol[at[outer]]))
        kept = np.flatnonzero(live)
        counts = np.bincount(word[kept], minlength=len(data))
        flat = symbol[kept].tolist()
        out, start = [], 0
        for c in counts.tolist():
            out.append(flat[start : start + c])
            start += c
        return out


_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4


def _classes(code: np.ndarray) -> np.ndarray:
    """Character class of each code point; each distinct one is looked up once."""
    top = int(code.max()) + 1
    table = np.zeros(top, dtype=np.int8)
    used = np.flatnonzero(np.bincount(code, minlength=top))
    for c in used.tolist():
        ch = chr(c)
        table[c] = (
            _SPACE if ch in WHITE
            else _LETTER if regex.match(r"\p{L}", ch)
            else _NUMBER if regex.match(r"\p{N}", ch)
            else _OTHER
        )
    return table[code]


class Words:
    """The words of a block of texts: `code` numbers the distinct ones, `first` and `size` place one of each."""

    def __init__(self, texts: list[str]) -> None:
        self.joined = "".join(texts)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not n:
            self.code = self.first = self.size = np.empty(0, dtype=np.int64)
            self.per_text = np.zeros(len(texts), dtype=np.int64)
            return
        kind = _classes(points)
        begins = np.zeros(n + 1, dtype=bool)
        begins[np.cumsum(length) - length] = True
        begins[n] = True
        begins_text = begins.copy()
        change = np.empty(n, dtype=bool)
        change[0] = True
        change[1:] = kind[1:] != kind[:-1]
        space = kind == _SPACE
        # the last white space before a word is a word of its own, or the word's first character if it is a blank
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~begins_text[1:n]
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = (points[:-1] == 32) & ~begins_text[1:n] & ~space[1:]
        begins[:n] |= (change & ~after_blank) | last
        quote = np.flatnonzero((points == 39) & begins[:n])
        for suffix in SUFFIXES:
            k = len(suffix)
            at = quote[quote + k < n]
            for j, ch in enumerate(suffix, 1):
                at = at[(points[at + j] == ord(ch)) & ~begins_text[at + j]]
            begins[at + 1] = False
            begins[at + 1 + k] = True
        start = np.flatnonzero(begins[:n])
        size = np.diff(np.append(start, n))
        self.per_text = np.diff(np.append(np.searchsorted(start, np.cumsum(length) - length), len(start)))
        # hash of each word from prefix sums of a polynomial modulo 2**64; equal hashes are compared below
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(n, base, dtype=np.uint64))
        back = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), dtype=np.uint64))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power)))
        mark = (total[start + size] - total[start]) * back[start]
        self.code, kinds = pd.factorize(mark)
        self.first = np.empty(len(kinds), dtype=np.int64)
        self.first[self.code[::-1]] = start[::-1]
        self.size = np.empty(len(kinds), dtype=np.int64)
        self.size[self.code[::-1]] = size[::-1]
        shift = np.repeat(self.first[self.code] - start, size)
        if (self.size[self.code] != size).any() or (points[np.minimum(np.arange(n) + shift, n - 1)] != points).any():
            words = [self.joined[s : s + k] for s, k in zip(start.tolist(), size.tolist())]
            self.code, _ = pd.factorize(np.array(words, dtype=object))
            self.first = np.empty(self.code.max() + 1, dtype=np.int64)
            self.size = self.first.copy()
            self.first[self.code[::-1]], self.size[self.code[::-1]] = start[::-1], size[::-1]

    def distinct(self) -> list[str]:
        return [self.joined[s : s + k] for s, k in zip(self.first.tolist(), self.size.tolist())]


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in rows:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_LOADED: dict[str, Merges] = {}
#: Encoded words by vocabulary, kept by a worker process from task to task and emptied beyond KEPT_WORDS.
_KNOWN: dict[str, dict[str, np.ndarray]] = {}


def _merges(path: str) -> Merges:
    """The vocabulary, read once by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Token ids of every document's whole text, without special tokens: ``doc_id, ids`` (array of int).

    Empty and null texts give an empty list; the strings of special tokens are ordinary text. One row per input
    row, rows with the same or a null `doc_id` included. The file ``<vocabulary>.json`` in `folder` must be on
    every executor. No shuffle; a task holds one block of rows and a bounded number of encoded words.
    """
    path = f"{folder}/{vocabulary}.json"

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        known = _KNOWN.setdefault(path, {})
        for ids, texts in _blocks(rows):
            words = Words(texts)
            distinct = words.distinct()
            new = [w for w in distinct if w not in known]
            known.update((w, np.array(x, dtype=np.int32)) for w, x in zip(new, merges.encode(new)))
            coded = [known[w] for w in distinct]
            size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            offset = np.cumsum(size) - size
            store = np.concatenate(coded) if coded else np.empty(0, dtype=np.int32)
            # the words' ids, one after the other
            each = size[words.code]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            flat = store[np.arange(total) + np.repeat(offset[words.code] - (ends - each), each)]
            stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(words.per_text)))]
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["doc_id", "ids"])
            if len(known) > KEPT_WORDS:
                known.clear()

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")
