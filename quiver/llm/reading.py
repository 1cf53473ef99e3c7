"""Reading level of prose, from the surprisal of its words under n-gram models of graded texts.

One interpolated trigram model (Witten-Bell) is trained for each band of the graded texts. The surprisals of all words of
a document are measured under all of them. For each step between two bands the document's score is how much less
surprising its sentences are to the models above than to those below. An isotonic regression for each step,
fitted on scores of texts that the models hadn't seen (cross-fitting, copies together), maps the score monotonically to
the share of texts above the step; the level is one plus the sum of the shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded documents that the models are fitted on at most, those with the least hash of their id.
MOST_GRADED = 6_000
#: Bands, parts of the cross-fitting, and a document's least band that counts as demanding.
BANDS, FOLDS, DEMANDING = 5, 5, 3.5
#: Nats that the surprisal of a sentence counts more or less at most, so that no sentence decides for a document.
MOST_CONTRAST = 1.0
#: Characters of documents that are measured at once.
BLOCK_CHARS = 2_000_000

_FENCED = re.compile(r"^(```|~~~)[^\n]*\n.*?(?:^\1[^\n]*$|\Z)", re.S | re.M)
_FOREIGN = re.compile(
    r"""^(?:[ ]{4,}|\t).*$                    # indented code
    |^\s{0,3}>.*(?:\n(?!\s*\n).+)*            # quotations, with the lines that continue them
    |^\s{0,3}(?:[-*+•]|\d+[.)]|\#\.)\s.*(?:\n[ \t]{2,}\S.*)*  # lists, with indented continuations
    |^\s{0,3}\#{1,6}\s.*$                     # headings
    |^\s*[=\-~^"'*+]{3,}\s*$                  # their underlines
    |^\s*\|.*$                                # tables
    |^\s*\.\.\s.*$|^\s*:\w[\w -]*:.*$         # directives and fields
    |<[^<>\n]{1,200}>|`[^`\n]*`|https?://\S+""",
    re.M | re.X,
)
_LONG_QUOTE = re.compile("[“„«][^”“»\n]{30,}[”“»]|\"[^\"\n]{60,}\"")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n\s*\n")
_TOKEN = re.compile(r"\d[\d.,]*|[^\W\d_]+(?:['’-][^\W\d_]+)*")


def own_wording(text: str) -> list[list[str]]:
    """Sentences of a text as lists of words, without quotations, code, lists, headings and markup. Numbers are `0`."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FENCED.sub("\n\n", text)
    text = _LONG_QUOTE.sub(" ", _FOREIGN.sub(" ", text))
    out = []
    for sentence in _SENTENCE.split(text):
        words = ["0" if w[0].isdigit() else w.lower() for w in _TOKEN.findall(sentence)]
        if words:
            out.append(words)
    return out


class BandModels:
    """Interpolated trigram counts of all bands over one vocabulary, as sorted arrays."""

    def __init__(self, texts: list[list[list[str]]], bands: np.ndarray) -> None:
        words = [w for t in texts for s in t for w in ("\0", "\0", *s)]
        codes, names = pd.factorize(np.array(words, dtype=object))
        self.ids = {w: i for i, w in enumerate(names)}
        v = self.size = len(names) + 1  # the last id is for unknown words
        sizes = [len(s) + 2 for t in texts for s in t]
        band = np.repeat(np.repeat(bands - 1, [len(t) for t in texts]), sizes).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        real = np.ones(len(codes), dtype=bool)
        real[first], real[first + 1] = False, False
        at = np.flatnonzero(real)
        w, b = codes[at], band[at]
        self.one = np.zeros((v, BANDS))
        np.add.at(self.one, (w, b), 1)
        two, three = codes[at - 1] * v + w, (codes[at - 2] * v + codes[at - 1]) * v + w
        self.two, self.two_n = self._count(two, b)
        self.three, self.three_n = self._count(three, b)
        self.after_one, self.kinds_one = self._history(self.two // v, self.two_n, np.arange(v))
        history = np.unique(self.three // v)
        self.pair = history
        self.after_two, self.kinds_two = self._history(self.three // v, self.three_n, history)

    @staticmethod
    def _count(keys: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unique, code = np.unique(keys, return_inverse=True)
        n = np.zeros((len(unique), BANDS))
        np.add.at(n, (code, band), 1)
        return unique, n

    @staticmethod
    def _history(history: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, kinds = np.zeros((len(wanted), BANDS)), np.zeros((len(wanted), BANDS))
        at = np.searchsorted(wanted, history)
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        return total, kinds

    @staticmethod
    def _rows(table: np.ndarray, values: tuple[np.ndarray, ...], keys: np.ndarray) -> list[np.ndarray]:
        if not len(table):
            return [np.zeros((len(keys), BANDS)) for _ in values]
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        same = (table[at] == keys)[:, None]
        return [np.where(same, x[at], 0.0) for x in values]

    def surprisals(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(surprisal of each word in each band, its sentence, the sentences' texts)."""
        sentences = [s for t in texts for s in t]
        of_text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        ids, v = self.ids, self.size
        start, unknown = ids.get("\0", v - 1), v - 1
        sizes = np.array([len(s) + 2 for s in sentences], dtype=np.int64)
        if not len(sizes):
            return np.zeros((0, BANDS)), np.zeros(0, dtype=int), of_text
        codes = np.full(sizes.sum(), start, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        real = np.ones(len(codes), dtype=bool)
        real[first], real[first + 1] = False, False
        at = np.flatnonzero(real)
        codes[at] = [ids.get(w, unknown) for s in sentences for w in s]
        w, h1, h2 = codes[at], codes[at - 1], codes[at - 2]
        # unigrams mix with equal shares, so an unknown word tells nothing
        total, kinds = self.one.sum(0), (self.one > 0).sum(0)
        p = (self.one[w] + kinds / v) / (total + kinds + 1e-9)
        for keys, table, n, history, known, after, kinds in (
            (h1 * v + w, self.two, self.two_n, h1, None, self.after_one, self.kinds_one),
            ((h2 * v + h1) * v + w, self.three, self.three_n, h2 * v + h1, self.pair, self.after_two, self.kinds_two),
        ):
            (count,) = self._rows(table, (n,), keys)
            c, k = (after[history], kinds[history]) if known is None else self._rows(known, (after, kinds), history)
            p = np.where(c > 0, (count + k * p) / np.maximum(c + k, 1e-9), p)
        return -np.log(np.maximum(p, 1e-12)), np.repeat(np.arange(len(sizes)), sizes - 2), of_text

    def contrasts(self, texts: list[list[list[str]]]) -> np.ndarray:
        """For each text and step between bands: surprisal of its sentences under the best of the models below, less that
        under the best above, bounded for each sentence and averaged over the words; NaN for a text without own wording."""
        bits, sentence, of_text = self.surprisals(texts)
        out = np.full((len(texts), BANDS - 1), np.nan)
        if not len(bits):
            return out
        n = np.bincount(sentence)
        mean = np.stack([np.bincount(sentence, bits[:, b]) / n for b in range(BANDS)], axis=1)
        words = np.bincount(of_text, n, minlength=len(texts))
        for step in range(1, BANDS):
            less = np.clip(n * (mean[:, :step].min(1) - mean[:, step:].min(1)), -MOST_CONTRAST, MOST_CONTRAST)
            out[:, step - 1] = np.bincount(of_text, n * less, minlength=len(texts)) / np.where(words > 0, words, np.nan)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of `y` to `x` (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for i in order.tolist():
        blocks.append([y[i], 1, x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = [(e, s / n) for s, n, lo, hi in blocks for e in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class ReadingLevel:
    """Band models with their maps from contrasts to shares above each step."""

    def __init__(self, texts: list[list[list[str]]], bands: np.ndarray, fold: np.ndarray) -> None:
        grade = np.clip(np.rint(bands), 1, BANDS).astype(int)
        held_out = np.full((len(texts), BANDS - 1), np.nan)
        for f in range(FOLDS):
            inside = np.flatnonzero(fold == f)
            outside = np.flatnonzero(fold != f)
            if len(inside) and len(outside):
                held_out[inside] = BandModels([texts[i] for i in outside], grade[outside]).contrasts([texts[i] for i in inside])
        self.models = BandModels(texts, grade)
        self.maps = []
        for step in range(1, BANDS):
            score, above = held_out[:, step - 1], np.clip(bands - step, 0.0, 1.0)
            known = ~np.isnan(score)
            if not known.any():  # one copy alone: the sign decides
                score, above, known = np.array([-1.0, 1.0]), np.array([0.0, 1.0]), np.array([True, True])
            self.maps.append(isotonic(score[known], above[known]))

    def bands(self, texts: list[list[list[str]]]) -> np.ndarray:
        score = self.models.contrasts(texts)
        level = 1 + sum(np.interp(np.nan_to_num(score[:, i]), *m) for i, m in enumerate(self.maps))
        return np.where(np.isnan(score[:, 0]), np.nan, level)


_PROSE = r"\.(?:md|rst|txt)$"


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_GRADED) -> ReadingLevel | None:
    """Fit on the graded prose, at most `most` documents; None if nothing usable is graded.

    A document's band is the mean over its raters; null bands, repeated rows and bands outside 1 to 5 are passed over.
    """
    grades = (
        labels.where(F.col("band").between(1, BANDS)).select("doc_id", "rater", "band").distinct()
        .groupBy("doc_id").agg(F.avg("band").alias("band"))
    )
    prose = documents.where(F.col("file_path").rlike(_PROSE) & (F.length(F.trim("text")) > 0)).select("doc_id", "text")
    rows = (
        prose.join(grades, "doc_id")
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(most)
        .select("doc_id", "text", "band", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"))
        .toPandas()
    )
    texts = [own_wording(t) for t in rows.text]
    keep = [i for i, t in enumerate(texts) if t]
    if not keep:
        return None
    return ReadingLevel([texts[i] for i in keep], rows.band.to_numpy()[keep], rows.fold.to_numpy()[keep])


def reading_levels(documents: DataFrame, labels: DataFrame, most: int = MOST_GRADED) -> DataFrame:
    """Reading level of every prose document (.md, .rst, .txt) with a text that isn't blank: ``doc_id, level``.

    `level` is a band as in `labels`, 1 easiest to 5 hardest, with fractions; null for a text that holds nothing but
    quotations, code, lists and headings, and for all if no usable label is given. Texts are read whole, every
    document on its own; copies each have a row. The models are of at most `most` graded documents, whatever the
    size of the corpus.
    """
    model = fit(documents, labels, most)
    held = documents.sparkSession.sparkContext.broadcast(model)
    prose = documents.where(F.col("file_path").rlike(_PROSE) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            level = held.value.bands([own_wording(t) for t in texts]) if held.value else np.full(len(ids), np.nan)
            columns = [pa.array(ids, pa.int64()), pa.array([None if np.isnan(x) else float(x) for x in level], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "level"])

    return prose.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, level double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def demanding(levels: DataFrame, least: float = DEMANDING) -> DataFrame:
    """Documents of a level of at least `least`."""
    return levels.where(F.col("level") >= least)


def level_profile(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """Documents per source and rounded level."""
    return (
        documents.select("doc_id", "source")
        .join(levels, "doc_id")
        .groupBy("source", F.round("level").cast("int").alias("band"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )
