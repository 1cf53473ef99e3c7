"""Most similar vectors for every vector, by an inverted multi-index.

Unit vectors are turned onto the principal axes of a sample, and the two halves are quantised apart; a cell of the
index is a pair of centroids. For every vector the centroid pairs are traversed in order of summed distance with a
heap, until as many entries are in reach as the wanted recall needs; how many that is gets measured on a few vectors
that are compared with all. Cells that lie near each other form a shard. An entry goes to the shard of its cell, once;
a vector also goes to the other shards that hold cells it visits, with the distance its traversal ended at. What a
vector costs so depends on what it visits, not on how many there are. Equal vectors form one class that is indexed
once, so that copies make no hot cell and no pairs. Cosines of the candidates are exact, in double precision.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.session import checkpointed

#: Vectors that axes and codebooks are fitted on at most, or as many for each centroid, and entries a cell should hold.
SAMPLE_ROWS, SAMPLE_OF_CENTROID, CELL_ROWS = 20_000, 16, 20
#: Centroids of a half at most: the sizes of their pairs are held by every task (8 bytes each).
MOST_CENTROIDS = 2_048
#: Vectors that the visits are measured on, share of their neighbours that must come into reach, and entries that are
#: visited in any case, as fewer cost nothing less.
MEASURED, RECALL, LEAST_VISITS = 512, 0.975, 1_500
#: Entries of a shard at most, and shards at least; asking vectors that a task compares at once.
SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS = 100_000, 8, 8_192
#: Parts that the members of equal vectors are spread over in joins.
SALTS = 16


def usable_vectors(embeddings: DataFrame, model: str, dimensions: int) -> DataFrame:
    """``vec_id, v`` of the rows of `model` with as many finite elements, not all zero.

    Null, empty, short, all-zero, NaN and infinite vectors are left out, whatever their row says of its dimensions.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.where((F.col("model") == model) & (F.size("vector") == dimensions) & finite)
        .where(F.exists(F.col("vector"), lambda x: x != 0))
        .select("vec_id", F.col("vector").alias("v"))
    )


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of `x` by k-means with a fixed start (evenly spaced rows), empty ones dropped."""
    k = min(k, len(x))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centre)
        count = np.bincount(nearest, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, nearest, x)
        centre = total[count > 0] / count[count > 0][:, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ centre.T, 0.0)


def _split(points: np.ndarray, weight: np.ndarray, most: float) -> list[np.ndarray]:
    """Groups of points near each other, of a weight of at most `most` each or a single point: halved along the main axis."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if weight[at].sum() <= most or len(at) == 1:
            out.append(at)
            continue
        w, x = weight[at], points[at]
        x = x - np.average(x, axis=0, weights=w)
        axis = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
        order = np.argsort(x @ axis, kind="stable")
        total = np.cumsum(w[order])
        half = min(max(int(np.searchsorted(total, total[-1] / 2)) + 1, 1), len(at) - 1)
        todo += [at[order[:half]], at[order[half:]]]
    return out


class MultiIndex:
    """Axes, codebooks of both halves, sizes of the cells, and the shards the cells are in."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.cut = (sample.shape[1] + 1) // 2
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        self.axes = np.ascontiguousarray(axes)
        turned = sample @ self.axes
        k = min(MOST_CENTROIDS, max(1, math.ceil(math.sqrt(rows / CELL_ROWS))))
        self.left, self.right = _kmeans(turned[:, : self.cut], k), _kmeans(turned[:, self.cut :], k)

    def turn(self, u: np.ndarray) -> np.ndarray:
        return u @ self.axes

    def cells(self, turned: np.ndarray) -> np.ndarray:
        """Number of the cell of each row."""
        return _nearest(turned[:, : self.cut], self.left) * len(self.right) + _nearest(turned[:, self.cut :], self.right)

    def halves(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row to all centroids of either half."""
        return _distances(turned[:, : self.cut], self.left), _distances(turned[:, self.cut :], self.right)

    def place(self, cell: np.ndarray, size: np.ndarray) -> None:
        """Take the sizes of the cells that aren't empty, and lay out the shards.

        A cell that alone is over a shard's size gets several shards: its entries are spread over them, and who visits
        the cell goes to all.
        """
        n = len(self.right)
        self.size = np.zeros((len(self.left), n), dtype=np.int32)
        self.size[cell // n, cell % n] = size
        most = max(1.0, min(SHARD_ROWS, size.sum() / LEAST_SHARDS))
        points = np.hstack([self.left[cell // n], self.right[cell % n]])
        self.shard = np.full((len(self.left), n), -1, dtype=np.int32)
        self.parts: dict[int, int] = {}
        self.shards = 0
        for group in _split(points, size.astype(float), most):
            at = cell[group]
            self.shard[at // n, at % n] = self.shards
            parts = math.ceil(size[group].sum() / SHARD_ROWS)
            if parts > 1:
                self.parts[self.shards] = parts
            self.shards += max(1, parts)

    def needed(self, turned: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Entries that must be in reach of each row until the given cell is."""
        left, right = self.halves(turned)
        n, out = len(self.right), []
        for i, c in enumerate(cells):
            pairs = left[i][:, None] + right[i][None]
            out.append(int(self.size[pairs <= pairs[c // n, c % n]].sum()))
        return np.array(out, dtype=np.int64)

    def traverse(self, turned: np.ndarray, wanted: int) -> tuple[np.ndarray, list[set[int]]]:
        """For each row the summed distance at which `wanted` entries are in reach, and the shards that hold them.

        The heap has one place for each left centroid that was reached, at its next right centroid; a left centroid
        runs on while it stays ahead of the rest of the heap.
        """
        left, right = self.halves(turned)
        lo, ro = left.argsort(1, kind="stable"), right.argsort(1, kind="stable")
        ld, rd = np.take_along_axis(left, lo, 1).tolist(), np.take_along_axis(right, ro, 1).tolist()
        lo, ro = lo.tolist(), ro.tolist()
        size, shard = self.size.tolist(), self.shard.tolist()
        ends, where = np.empty(len(turned)), []
        push, pop = heapq.heappush, heapq.heappop
        for row, (a, b, d, e) in enumerate(zip(lo, ro, ld, rd)):
            heap, place, found, seen, last = [(d[0] + e[0], 0)], [0] * len(a), 0, set(), 0.0
            while heap and found < wanted:
                last, i = pop(heap)
                j, base = place[i], d[i]
                if j == 0 and i + 1 < len(a):
                    push(heap, (d[i + 1] + e[0], i + 1))
                ahead = max(j + 1, bisect_right(e, heap[0][0] - base, j)) if heap else len(b)
                sizes, shards = size[a[i]], shard[a[i]]
                while j < ahead and found < wanted:
                    c = b[j]
                    if sizes[c]:
                        found += sizes[c]
                        seen.add(shards[c])
                    j += 1
                last = max(last, base + e[j - 1])
                if j < len(b):
                    place[i] = j
                    push(heap, (base + e[j], i))
            ends[row] = last
            where.append(seen)
        return ends, where


def _floats(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column of equally many numbers, in double precision."""
    if not len(column):
        return np.empty((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def _lists(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equally many numbers, as they are."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Best:
    """The best `keep` entries so far of each asking row."""

    def __init__(self, rows: int, keep: int) -> None:
        self.score, self.who, self.keep = np.full((rows, keep), -np.inf), np.full((rows, keep), -1, dtype=np.int64), keep

    def offer(self, rows: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """`score` of the entries `who` for `rows`."""
        better = np.flatnonzero(score.max(1) > self.score[rows].min(1))
        if not len(better):
            return
        rows, score = rows[better], score[better]
        if score.shape[1] > self.keep:
            top = np.argpartition(-score, self.keep - 1, axis=1)[:, : self.keep]
            score, name = np.take_along_axis(score, top, 1), who[top]
        else:
            name = np.broadcast_to(who, score.shape)
        score, name = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.who[rows], name], axis=1)
        top = np.argpartition(-score, self.keep - 1, axis=1)[:, : self.keep]
        self.score[rows], self.who[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors ``least, ids, v`` (`ids` are the k + 1 least of several, else null), and the members
    ``vec_id, least`` of classes that have several."""
    # a negative zero equals zero
    rows = vectors.select("vec_id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v"))
    key = [F.xxhash64("v").alias("h"), F.hash("v").alias("g")]
    classes = checkpointed(
        rows.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members")).select("v", "least", "members", *key)
    )
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    several = classes.where("members > 1")
    # a class may hold a third of all vectors, so its members are spread
    spread = rows.select("vec_id", *key, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = checkpointed(spread.join(several.select("h", "g", "least", salts), ["h", "g", "salt"]).select("vec_id", "least", "salt"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("least", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("least").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("least").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    ones = classes.where("members = 1").select("least", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    return ones.unionByName(several.select("least", "v").join(ids, "least").select("least", "ids", "v")), named


def nearest_neighbours(vectors: DataFrame, k: int = 5, recall: float = RECALL, least_visits: int = LEAST_VISITS) -> DataFrame:
    """The `k` other vectors with the highest cosine of each vector: ``vec_id, neighbour, cosine, place``.

    `vectors` are ``vec_id, v`` as `usable_vectors` gives them, all of one length. Cosines are of doubles, rounded to
    12 digits; ties go to the smaller vec_id. Every vector is indexed and asked for; only axes and codebooks are fitted
    on a sample. `recall` is the share of true neighbours that must be in reach, measured on `MEASURED` vectors
    against all; `least_visits` entries are visited anyway. Vectors of equal elements are one class: they are each
    other's nearest, and the class is searched once. With one vector or none there are no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id bigint, neighbour bigint, cosine double, place int"
    kind = np.float32 if dict(vectors.dtypes)["v"] == "array<float>" else np.float64
    classes, named = _classes(vectors, k)
    rows = classes.count()
    if not rows:
        return spark.createDataFrame([], schema)
    index, wanted = _fitted(classes, rows, k, recall, least_visits)
    held = spark.sparkContext.broadcast(index)  # two codebooks, and 8 bytes a pair of centroids

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as an entry for its own shard, and as a question for the others it visits."""
        one = held.value
        n = len(one.right)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, least, ids = _lists(batch.column("v")), batch.column("least").to_numpy(), batch.column("ids").to_pylist()
            turned = one.turn(_unit(raw))
            cell = one.cells(turned)
            ends, where = one.traverse(turned, wanted)
            home = one.shard[cell // n, cell % n]
            out: dict[str, list] = {c: [] for c in ("shard", "asks", "cell", "least", "ids", "tau", "v")}
            for i, (own, seen) in enumerate(zip(home.tolist(), where)):
                part = int(least[i]) % one.parts.get(own, 1)
                body = raw[i].tobytes()
                for s in seen | {own}:
                    for p in range(one.parts.get(s, 1)):
                        entry = s == own and p == part
                        for c, x in zip(out, (s + p, not entry, int(cell[i]), int(least[i]), ids[i] if entry else None, float(ends[i]), body)):
                            out[c].append(x)
            types = [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(zip(out, types))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a shard come first; they and the questions after them are compared with the cells they visit."""
        entries: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            first = int(np.argmax(asks)) if (asks := np.asarray(batch.column("asks").to_pylist(), dtype=bool)).any() else batch.num_rows
            if first:
                entries.append(batch.slice(0, first))
            if first < batch.num_rows:
                if shard is None:
                    shard = _Shard(held.value, entries, kind, k)
                    yield from shard.ask(entries)
                yield from shard.ask([batch.slice(first)])
        if shard is None and entries:
            yield from _Shard(held.value, entries, kind, k).ask(entries)

    sent = classes.mapInArrow(send, "shard int, asks boolean, cell int, least bigint, ids array<bigint>, tau double, v binary")
    found = sent.repartitionById(index.shards, "shard").sortWithinPartitions("asks", "cell").mapInArrow(compare, "least bigint, near array<struct<c:double,o:bigint>>")
    # one row a shard that was visited
    best = found.groupBy("least").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return _expand(named, classes.where("ids is not null").select("least", "ids"), best, k)


def _fitted(classes: DataFrame, rows: int, k: int, recall: float, least_visits: int) -> tuple[MultiIndex, int]:
    """The index, and how many entries a traversal must bring into reach."""
    spark = classes.sparkSession
    centroids = min(MOST_CENTROIDS, math.ceil(math.sqrt(rows / CELL_ROWS)))
    most = max(SAMPLE_ROWS, SAMPLE_OF_CENTROID * centroids)
    # the smallest hashes, so the same sample whatever the partitions
    picked = classes.select("v", "least", F.xxhash64("least").alias("h"))
    if rows > most:
        picked = picked.where(F.pmod("h", F.lit(1 << 20)) < math.ceil(1.2 * most / rows * (1 << 20)))
    table = picked.orderBy("h", "least").limit(most).toPandas()
    sample = _unit(np.stack(table["v"].to_numpy()))
    index = MultiIndex(sample, rows)
    held = spark.sparkContext.broadcast(index)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique(held.value.cells(held.value.turn(_unit(_lists(batch.column("v"))))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "n": pa.array(n, pa.int64())})

    sizes = classes.select("v").mapInArrow(locate, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # MOST_CENTROIDS ** 2 at most
    sizes = sizes.sort_values("cell")
    index.place(sizes["cell"].to_numpy(), sizes["n"].to_numpy())
    asked, names = sample[:MEASURED], table["least"].to_numpy()[:MEASURED]
    questions = spark.sparkContext.broadcast((asked, names))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names = questions.value
        best, cells, n = _Best(len(asked), k), {}, 0
        every = np.arange(len(asked))
        for batch in batches:
            if not batch.num_rows:
                continue
            u, least = _unit(_lists(batch.column("v"))), batch.column("least").to_numpy()
            score = asked @ u.T
            score[names[:, None] == least[None]] = -np.inf
            cell = held.value.cells(held.value.turn(u))
            cells[n] = cell
            best.offer(every, score, np.arange(n, n + len(u)))
            n += len(u)
        if n:
            cell = np.concatenate(list(cells.values()))
            at = np.flatnonzero(np.isfinite(best.score.ravel()))
            out = {"ask": pa.array(at // k, pa.int32()), "score": pa.array(best.score.ravel()[at]), "cell": pa.array(cell[best.who.ravel()[at]], pa.int32())}
            yield pa.RecordBatch.from_pydict(out)

    tops = classes.select("v", "least").mapInArrow(compare, "ask int, score double, cell int")
    tops = tops.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score")))).where(F.col("r") <= k)
    near = tops.select("ask", "cell").toPandas()  # MEASURED * k
    if not len(near):
        return index, least_visits
    needed = np.sort(index.needed(index.turn(asked[near["ask"].to_numpy()]), near["cell"].to_numpy()))
    return index, max(least_visits, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]))


class _Shard:
    """Entries of one shard, ordered by cell, and the comparison of asking vectors with them."""

    def __init__(self, index: MultiIndex, batches: list[pa.RecordBatch], kind: type, k: int) -> None:
        self.index, self.kind, self.k = index, kind, k
        cell = np.concatenate([b.column("cell").to_numpy() for b in batches])
        order = np.argsort(cell, kind="stable")
        self.unit = np.concatenate([_unit(_floats(b.column("v"), kind)) for b in batches])[order]
        self.least = np.concatenate([b.column("least").to_numpy() for b in batches])[order]
        ids = [x for b in batches for x in b.column("ids").to_pylist()]
        members = [ids[i] or [n] for i, n in zip(order.tolist(), self.least.tolist())]
        self.members = np.array([len(m) for m in members])
        self.first = np.cumsum(self.members) - self.members
        self.ids = np.array([x for m in members for x in m], dtype=np.int64)
        self.cell, start = np.unique(cell[order], return_index=True)
        self.start = np.append(start, len(order))

    def ask(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                yield self._block(batch.slice(at, BLOCK_ROWS))

    def _block(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        unit, name, tau = _unit(_floats(batch.column("v"), self.kind)), batch.column("least").to_numpy(), batch.column("tau").to_numpy()
        left, right = self.index.halves(self.index.turn(unit))
        best, n = _Best(len(unit), 2 * self.k), len(self.index.right)
        tau = tau + 1e-9
        for c, a, b in zip(self.cell.tolist(), self.start[:-1].tolist(), self.start[1:].tolist()):
            rows = np.flatnonzero(left[:, c // n] + right[:, c % n] <= tau)
            if not len(rows):
                continue
            score = unit[rows] @ self.unit[a:b].T
            score[name[rows][:, None] == self.least[a:b][None]] = -np.inf
            best.offer(rows, score, np.arange(a, b))
        row, place = np.nonzero(np.isfinite(best.score))
        who, score = best.who[row, place], np.round(best.score[row, place], 12)
        # classes to their members
        times = self.members[who]
        at = np.repeat(self.first[who] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        row, score, ids = np.repeat(row, times), np.repeat(score, times), self.ids[at]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < self.k
        row, score, ids = row[keep], score[keep], ids[keep]
        some, count = np.unique(row, return_counts=True)
        offsets = pa.array(np.append(0, np.cumsum(count)), pa.int32())
        near = pa.StructArray.from_arrays([pa.array(-score, pa.float64()), pa.array(ids, pa.int64())], names=["c", "o"])
        return pa.RecordBatch.from_arrays([pa.array(name[some], pa.int64()), pa.ListArray.from_arrays(offsets, near)], names=["least", "near"])


def _expand(named: DataFrame, several: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """From classes to vectors; members of one class are each other's nearest."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    none = F.array().cast("array<struct<c:double,o:bigint>>")
    # a class of several has a row even where no other class is near
    marked = checkpointed(several.join(best, "least", "full_outer").withColumn("near", F.coalesce("near", none)))  # read twice
    alone = marked.where("ids is null").select(F.col("least").alias("vec_id"), "near")
    own = F.transform(F.filter("ids", lambda i: i != F.col("vec_id")), lambda o: F.struct(F.lit(-1.0).alias("c"), o.alias("o")))
    shared = (
        named.join(marked.where("ids is not null").select("least", "ids", "near", salts), ["least", "salt"])
        .select("vec_id", F.slice(F.array_sort(F.concat(own, "near")), 1, k).alias("near"))
    )
    return (
        alone.unionByName(shared)
        .select("vec_id", F.posexplode("near").alias("p", "n"))
        .select("vec_id", F.col("n.o").alias("neighbour"), (-F.col("n.c")).alias("cosine"), (F.col("p") + 1).cast("int").alias("place"))
    )


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs ``vec_a < vec_b`` of which at least one is among the other's neighbours."""
    return neighbours.select(
        F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")
    ).distinct()
