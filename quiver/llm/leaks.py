"""Evaluation texts that occur in training text.

Texts are compared as folded letters and digits, so wrapping, comment marks, case and punctuation don't matter. The
q-grams of all evaluation texts are looked up in every position of every document. By the q-gram lemma m characters with
k edits share at least ``m + 1 - q - k q`` of their q-grams with their source. `RATE` edits a character shift a passage
by at most ``RATE m`` diagonals; so shared q-grams are counted in diagonal bands of at least twice that width, which
overlap by half, and only regions that meet the bound are verified by an alignment within the band.

Q-grams that many evaluation texts have in common are their usual form and no evidence, so a verified region must also
share enough of the text's other q-grams. Texts that are alike as a whole are one class there, so that they don't make
each other usual.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram, and the least width of a diagonal band (bands overlap by half).
Q, BAND = 7, 48
#: The edit budget: share of an evaluation text that a passage holds at least ("about half"), and edits for each of its
#: characters. Within it every passage is nominated.
SHARE, RATE = 0.4, 1 / 9
#: What a nominated region must have: a span of this share of the evaluation text, at most so many edits for each
#: character, and this share of the text's own q-grams; within the budget of edits the share that the lemma leaves is enough.
SPAN, EDITS, OWN = 0.27, 0.3, 0.2
#: Classes of alike texts that may hold a q-gram which isn't usual, share of q-grams that alike texts have in common, and
#: least hashes of a text by which they are looked up.
USUAL, ALIKE, SIGNS = 12, 0.8, 8
#: Characters of documents that are compared at once; longer documents are read in overlapping parts.
BLOCK_CHARS = 1_000_000
#: Characters of evaluation texts that a task holds at once (some 60 bytes each); more are searched for group by group.
GROUP_CHARS = 4_000_000

_FOLD = np.array([c if c == 0 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)], dtype=np.uint32)


def _fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points of lower-case letters and digits with single blanks, each between zeros; their starts.

    Marks and signs count as blanks, beyond ASCII those of the blocks of general and CJK punctuation.
    """
    joined = "\0".join(t.replace("\0", " ") for t in ["", *texts, ""]).lower()
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    data = np.where(data < 128, _FOLD[data & 127], data)
    block = data >> 6
    data = np.where((data == 0xA0) | (block == 0x80) | (data >> 5 == 0x2060 >> 5) | (block == 0xC0), np.uint32(32), data)
    blank = data == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & (data[:-1] != 0)
    data = data[keep]
    return data, np.flatnonzero(data == 0)


def _grams(data: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each position, as one number; what two q-grams share by chance is left to the alignment.
    Those over a text's end stand for themselves, as they hold a zero."""
    wide = np.zeros(len(data) + Q, dtype=np.uint64)
    wide[: len(data)] = data
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(Q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + len(data)]
    return out


class Passages:
    """The q-gram index of the evaluation texts; equal texts are one, with all their owners."""

    def __init__(self, owner: list[int], texts: list[str]) -> None:
        owners: dict[str, set[int]] = {}
        for o, t in zip(owner, texts):
            owners.setdefault(t, set()).add(o)
        self.owners = [sorted(x) for x in owners.values()]
        data, zero = _fold(list(owners))
        self.data, self.start = data, zero[:-1] + 1
        self.length = np.diff(zero) - 1
        part = np.repeat(np.arange(len(owners)), self.length + 1)
        gram = _grams(data[1:])
        inside = np.arange(len(part)) + 1 + Q <= np.repeat(zero[1:], self.length + 1)
        gram, part, at = gram[inside], part[inside], (np.arange(len(part)) + 1)[inside]
        order = np.argsort(gram, kind="stable")
        gram, part, at = gram[order], part[order], at[order]
        self.gram, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)
        self.part, self.at = part.astype(np.int32), (at - self.start[part]).astype(np.int32)
        self.shift = np.uint64(64 - max(16, math.ceil(math.log2(16 * len(self.gram) + 1))))
        slot = self._slot(self.gram)
        #: number of the q-gram of each slot; -1 for none, -2 where several meet
        self.index = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int32)
        self.index[slot] = np.arange(len(self.gram))
        taken, times = np.unique(slot, return_counts=True)
        self.index[taken[times > 1]] = -2
        passage = SHARE * self.length
        self.need = np.maximum(1, np.ceil(passage + 1 - Q - RATE * passage * Q)).astype(np.int64)
        self.band = max(BAND, 2 * math.ceil(RATE * SHARE * max(self.length, default=0)))
        self.longest = max(map(len, owners), default=0)
        code = np.repeat(np.arange(len(self.gram)), self.count)
        kind = self._alike(code)[self.part]
        pairs = np.unique(code * np.int64(len(owners)) + kind)
        usual = np.bincount(pairs // max(1, len(owners)), minlength=len(self.gram)) > USUAL
        kept = np.bincount(self.part[~usual[code]], minlength=len(owners)) > 0
        own = ~usual[code] | ~kept[self.part]  # a text of usual wording alone has no other
        self.own = np.zeros(len(data), dtype=bool)
        self.own[(self.at + self.start[self.part])[own]] = True
        self.own_grams = np.bincount(self.part[own], minlength=len(owners))
        self.own_part = self.part[own]
        self.own_count = np.bincount(code[own], minlength=len(self.gram))
        self.own_first = np.cumsum(self.own_count) - self.own_count
        self.own_need = np.ceil(min(OWN, SHARE * (1 - RATE * Q)) * self.own_grams)

    def _alike(self, code: np.ndarray) -> np.ndarray:
        """Class of each text: alike ones that share one of their least hashes are in one."""
        n = len(self.length)
        order = np.argsort(self.part, kind="stable")
        grams = np.split(code[order], np.cumsum(np.bincount(self.part, minlength=n))[:-1]) if n else []
        sets = [np.unique(g) for g in grams]
        first: dict[int, int] = {}
        kind = np.arange(n)
        for i, own in enumerate(sets):
            signs = np.sort(self.gram[own] * np.uint64(0x9FB21C651E98DF25))[:SIGNS].tolist()
            for j in {first[x] for x in signs if x in first}:
                if len(np.intersect1d(own, sets[j], assume_unique=True)) >= ALIKE * max(len(own), len(sets[j])):
                    kind[i] = kind[j]
                    break
            for x in signs:
                first.setdefault(x, i)
        return kind

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0xD1B54A32D192ED03)) >> self.shift

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in data, and numbers of the q-grams of the index that start there."""
        gram = _grams(data)
        place = self.index[self._slot(gram)]
        at = np.flatnonzero(place != -1)
        place, gram = place[at], gram[at]
        if not len(self.gram) or not len(at):
            return at[:0], place[:0]
        several = np.flatnonzero(place == -2)
        place[several] = np.minimum(np.searchsorted(self.gram, gram[several]), len(self.gram) - 1)
        same = self.gram[place] == gram
        return at[same], place[same]

    def sharing(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers ``doc * texts + text`` of those that share enough of the text's own q-grams to be a leak at all."""
        times = self.own_count[place]
        entry = np.repeat(self.own_first[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair, count = np.unique(np.repeat(doc, times) * np.int64(len(self.length)) + self.own_part[entry], return_counts=True)
        return pair[count >= self.own_need[pair % max(1, len(self.length))]]

    def spread(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `at`, text, position in it) of all texts that hold the q-grams."""
        times = self.count[place]
        entry = np.repeat(self.first[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(np.arange(len(at), dtype=np.int32), times), self.part[entry], self.at[entry]


def _edits(texts: list[np.ndarray], windows: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distance of each text to a part of its window, which has `band` characters more on either side; within the
    band, all pairs at once, row by row."""
    n, wide = np.array([len(t) for t in texts]), 2 * band + 1
    rows = int(n.max())
    a, b = np.full((len(texts), rows), 1, dtype=np.uint32), np.zeros((len(texts), rows + wide), dtype=np.uint32)
    for i, (t, w) in enumerate(zip(texts, windows)):
        a[i, : len(t)], b[i, : len(w)] = t, w
    slope = np.arange(wide, dtype=np.int32)
    row = np.zeros((len(texts), wide), dtype=np.int32)
    out = np.zeros(len(texts), dtype=np.int64)
    for i in range(rows):
        step = row + (b[:, i : i + wide] != a[:, i : i + 1])
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        row = np.minimum.accumulate(step - slope, axis=1) + slope
        done = n == i + 1
        if done.any():
            out[done] = row[done].min(1)
    return out


def _regions(data: np.ndarray, passages: Passages) -> pd.DataFrame:
    """Regions whose bands hold enough different shared q-grams: doc, part, lo, hi (in the text), diagonal, and the share
    of the text's own q-grams."""
    columns = ["doc", "part", "lo", "hi", "diagonal", "own"]
    need, texts, half = passages.need, len(passages.length), passages.band // 2
    pos, place = passages.hits(data)
    if not len(pos):
        return pd.DataFrame(columns=columns, dtype=np.int64)
    doc = np.cumsum(data == 0, dtype=np.int32)[pos] - 1
    # a band can't have more than the document as a whole
    wanted = passages.sharing(doc, place)
    some = np.isin(doc, wanted // max(1, texts))
    pos, place, doc = pos[some], place[some], doc[some]
    row, part, at = passages.spread(pos, place)
    pair = doc[row] * np.int64(texts) + part
    near = np.flatnonzero(np.isin(pair, wanted))
    pair, part, at, diagonal = pair[near], part[near], at[near], pos[row[near]] - at[near]
    if not len(pair):
        return pd.DataFrame(columns=columns, dtype=np.int64)
    step = (diagonal - diagonal.min()) // half
    steps = int(step.max()) + 3
    key = pair * steps + step
    order = np.argsort(key, kind="stable")
    key, pair, part, at, diagonal = key[order], pair[order], part[order], at[order], diagonal[order]
    # a band is two neighbouring halves
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(first[1:], len(key))
    joined = np.append(key[first][1:] == key[first][:-1] + 1, False)
    stop = np.where(joined, np.append(end[1:], len(key)), end)
    out = []
    least = min(OWN, SHARE * (1 - RATE * Q))
    busy = np.flatnonzero(stop - first >= need[part[first]])
    for a, b in zip(first[busy].tolist(), stop[busy].tolist()):
        where = np.unique(at[a:b])
        p = part[a]
        if len(where) < need[p] or where[-1] - where[0] + Q < SPAN * passages.length[p]:
            continue
        own = np.count_nonzero(passages.own[passages.start[p] + where]) / passages.own_grams[p]
        if own >= least:
            # lone q-grams far from the rest are left out: half the density that the lemma leaves is the price of a gap
            price = (1 - RATE * Q) / 2 * where
            before = np.minimum.accumulate(np.arange(len(where)) - price)
            last = int(np.argmax(np.arange(1, len(where) + 1) - price - before))
            lo = where[int(np.argmin((np.arange(len(where)) - price)[: last + 1]))]
            out.append((pair[a] // texts, p, lo, where[last], int(np.sort(diagonal[a:b])[(b - a) // 2]), own))
    return pd.DataFrame(out, columns=columns)


def leaked(texts: list[str], passages: Passages) -> list[tuple[int, int, float]]:
    """(number of the text, owner of the evaluation text, share of its own q-grams) of all leaks in `texts`."""
    data, _ = _fold(texts)
    r = _regions(data, passages)
    out = []
    padded = np.concatenate((np.zeros(passages.band, dtype=np.uint32), data, np.zeros(passages.band, dtype=np.uint32)))
    for begin in range(0, len(r), 4096):
        some = r.iloc[begin : begin + 4096]
        pieces, windows = [], []
        for p, lo, hi, diagonal in zip(some.part, some.lo, some.hi, some.diagonal):
            start = passages.start[p]
            pieces.append(passages.data[start + lo : start + hi + Q])
            at_ = lo + diagonal  # a band before it in `data` is here in `padded`
            windows.append(padded[max(0, at_) : at_ + hi - lo + Q + 2 * passages.band])
        size = np.array([len(p) for p in pieces])
        edits = _edits(pieces, windows, passages.band)
        share = some.own.to_numpy()
        whole = passages.length[some.part.to_numpy(dtype=np.int64)]
        good = (size >= SPAN * whole) & (edits <= EDITS * size) & (share >= np.where(edits <= RATE * size + 2, SHARE * (1 - RATE * Q), OWN))  # 2: edits beside the ends
        for d, p, x in zip(some.doc[good], some.part[good], share[good].tolist()):
            out += [(int(d), o, x) for o in passages.owners[p]]
    return out


def leaked_items(documents: DataFrame, items: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Documents that hold a passage of an evaluation item: ``doc_id, item_id, share``.

    A passage is about half or more of the item's `prompt` or `solution`, verbatim or lightly altered; `share` is the
    greatest share of the q-grams of one of them that the passage holds, usual ones left out. Every passage of `SHARE` of a text with at most `RATE` edits a
    character is nominated, however many items hold the same wording. Every copy of a document has its rows. Null and
    blank texts, of documents or items, match nothing; texts are compared whole, and those without a passage as long
    as a q-gram match nothing. The items are held by every task, `group_chars` characters of them at once; for more,
    the documents are read once for each group.
    """
    spark = documents.sparkSession
    size = items.agg(F.sum(F.coalesce(F.length("prompt"), F.lit(0)) + F.coalesce(F.length("solution"), F.lit(0)))).first()[0] or 0
    groups = math.ceil(size / group_chars)
    numbered = items.select("item_id", "prompt", "solution", F.pmod(F.xxhash64("item_id"), F.lit(max(1, groups))).alias("g"))
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, share double")
    for g in range(groups):
        found = _search(documents, numbered.where(F.col("g") == g))
        out = found if found is not None and groups == 1 else out if found is None else out.unionByName(found)
    return out


def _search(documents: DataFrame, items: DataFrame) -> DataFrame | None:
    held = [
        (r["item_id"], t)
        for r in items.select("item_id", "prompt", "solution").toLocalIterator()
        for t in (r["prompt"], r["solution"])
        if t and t.strip()
    ]
    if not held:
        return None
    passages = documents.sparkSession.sparkContext.broadcast(Passages([i for i, _ in held], [t for _, t in held]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, float] = {}
        for ids, texts, last in _blocks(batches, 4 * passages.value.longest):
            for n, item, share in leaked(texts, passages.value):
                key = ids[n], item
                best[key] = max(share, best.get(key, 0.0))
            if last:  # no document goes on in the next block
                yield _rows(best)
                best = {}

    return documents.where(F.length("text") >= Q).select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id bigint, share double")


def _rows(best: dict[tuple, float]) -> pa.RecordBatch:
    columns = [[d for d, _ in best], [i for _, i in best], list(best.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "share"])


def _blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list, list, bool]]:
    """Ids and texts of about `BLOCK_CHARS` characters, longer texts in parts that overlap; whether the last one ends."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(text) > BLOCK_CHARS + overlap:
                if ids:
                    yield ids, texts, True
                    ids, texts, size = [], [], 0
                for at in range(0, len(text), BLOCK_CHARS):
                    yield [i], [text[at : at + BLOCK_CHARS + overlap]], at + BLOCK_CHARS >= len(text)
                continue
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield ids, texts, True
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, True
