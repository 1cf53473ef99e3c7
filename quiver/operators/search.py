"""Search by keyword, vector, both, and symbol; each ranks for a whole table of queries at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.operators import lookups

#: Constants of BM25 as documented for full-text indexes, and of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, spread: str) -> DataFrame:
    """The first `n` rows of each group in `order`, with their `place`; ranked in salted parts first, so that no task
    sorts a whole group."""
    part = lambda *more: Window.partitionBy(*by, *more).orderBy(*order)
    some = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(64))).withColumn("place", F.row_number().over(part("_salt"))).where(F.col("place") <= n)
    return some.drop("_salt").withColumn("place", F.row_number().over(part())).where(F.col("place") <= n)


def keyword_like(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Nodes that hold a query text in id, properties or labels, in any case; 1.0 if it is in the id, else 0.5.

    `queries` (query) are what people typed, a few rows, compared with every node; blank ones find nothing.
    """
    q = queries.where(F.trim("query") != "").select("query").distinct()
    text = F.lower("query")
    in_id = F.contains(F.lower("id"), text)
    hit = in_id | F.contains(F.lower(F.coalesce("properties", F.lit(""))), text) | F.contains(F.lower(F.array_join("labels", " ")), text)
    return nodes.join(q, hit).select("query", "graph_id", "id", F.when(in_id, 1.0).otherwise(0.5).alias("score"))


def terms(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def bm25(documents: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The `n` best documents for each query phrase: ``query, doc_id, score, place``.

    `documents` are (doc_id, text). A document must hold the query's words next to each other; it is then scored by
    BM25 over the phrase as one term. Statistics are of all documents. Blank queries find nothing.
    """
    q = queries.select("query", F.array_join(terms(F.col("query")), " ").alias("phrase")).where("phrase <> ''").distinct()
    words = documents.select("doc_id", terms(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("length"), F.concat(F.lit("  "), F.array_join("w", "  "), F.lit("  ")).alias("line")
    )
    size = words.agg(F.count(F.lit(1)).alias("total"), F.avg("length").alias("mean"))
    # words stand between two blanks, so that a match leaves the blank that the next one needs
    pattern = F.concat(F.lit(" "), F.regexp_replace("phrase", " ", "  "), F.lit(" "))
    tf = (F.length("line") - F.length(F.replace("line", pattern, F.lit("")))) / F.length(pattern)
    hits = words.join(q, F.contains(F.col("line"), pattern)).select("query", "doc_id", "length", tf.alias("tf"))
    df = hits.groupBy("query").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "query").crossJoin(F.broadcast(size))  # one row of statistics
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = rows.select("query", "doc_id", F.round(idf * weight, 6).alias("score"))
    return top(scored, ["query"], [F.desc("score"), F.col("doc_id")], n, "doc_id")


#: Places of words that a worker remembers.
KEPT_WORDS = 1_000_000
#: Query vectors that are held by a task at once, and that are multiplied at once.
HELD_QUERIES, BLOCK_QUERIES = 5_000, 256


def vector_topk(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The `n` vectors with the highest cosine for each query vector, by exact scan: ``query_id, vec_id, score, place``.

    `vectors` are (vec_id, v), `queries` (query_id, v), arrays of double; vectors of another length than the query, and
    zero norms, are passed over.
    """
    return best_cosines(vectors, queries, ["vec_id"], n)


def nearest_by_distance(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The same by Euclidean distance, as vector indexes rank: the score is 1 / (1 + distance), and zero vectors count."""
    return best_cosines(vectors, queries, ["vec_id"], n, distance=True)


def best_cosines(vectors: DataFrame, queries: DataFrame, key: list[str], n: int, bonus: str | None = None, distance: bool = False) -> DataFrame:
    """The `n` best vectors of each query (query_id, v): ``query_id, *key, score, place``; ties go to the least key.

    Scores are cosines (or 1 / (1 + distance)) to six digits, plus the column `bonus` of the vectors. Every vector is compared with every query by
    matrix products over batches; queries are held in groups of `HELD_QUERIES`, each of which reads the vectors once,
    and of a batch only the best go on.
    """
    spark = vectors.sparkSession
    total = queries.count()
    groups = max(1, -(-total // HELD_QUERIES))
    numbered = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g"))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = "query_id " + {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"] + ", " + ", ".join(f"{c} {types[c]}" for c in key) + ", score double"
    rows = vectors.select(*key, "v", (F.col(bonus) if bonus else F.lit(0.0)).cast("double").alias("_bonus"))
    out = None
    for g in range(groups):
        asked = numbered.where(F.col("g") == g).toPandas()
        held = spark.sparkContext.broadcast(_by_length(asked["query_id"].tolist(), asked["v"].tolist(), not distance))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch.sort_values(key, kind="stable").reset_index(drop=True)
                for at, unit in _by_length(np.arange(len(batch)), batch["v"].tolist(), not distance).values():
                    names, asked = held.value.get(unit.shape[1], (None, None))
                    if names is None:
                        continue
                    extra = batch["_bonus"].to_numpy()[at]
                    for begin in range(0, len(names), BLOCK_QUERIES):
                        block = asked[begin : begin + BLOCK_QUERIES]
                        score = block @ unit.T
                        if distance:
                            squares = (block * block).sum(1)[:, None] + (unit * unit).sum(1) - 2 * score
                            score = 1 / (1 + np.sqrt(np.maximum(squares, 0.0)))
                        score = np.round(np.round(score, 6) + extra, 6)
                        row, place = _firsts(score, n)
                        found = batch.iloc[at[place]][key].reset_index(drop=True)
                        found.insert(0, "query_id", names[begin + row])
                        yield found.assign(score=score[row, place])

        found = rows.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return top(out, ["query_id"], [F.desc("score"), *map(F.col, key)], n, key[-1])


def _by_length(names, vectors: list, unit: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Names and vectors by the vectors' length, in order, nulls left out; as unit vectors without those of zeros."""
    groups: dict[int, list] = {}
    for name, v in zip(names, vectors):
        if v is not None and len(v):
            groups.setdefault(len(v), []).append((name, v))
    out = {}
    for length, pairs in groups.items():
        x = np.array([v for _, v in pairs], dtype=np.float64)
        if not unit:
            out[length] = np.array([p for p, _ in pairs]), x
            continue
        norm = np.sqrt((x * x).sum(1))
        keep = norm > 0
        if keep.any():
            out[length] = np.array([p for p, _ in pairs])[keep], x[keep] / norm[keep][:, None]
    return out


def _firsts(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `n` highest of each row; of equals the first columns."""
    if score.shape[1] <= n:
        return tuple(x.ravel() for x in np.indices(score.shape))
    least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n][:, None]
    over = score > least
    equal = score == least
    return np.nonzero(over | (equal & (np.cumsum(equal, axis=1) <= n - over.sum(1, keepdims=True))))


def name_words(text: Column) -> Column:
    """Distinct words of a name: runs of letters and digits, in lower case."""
    return F.array_distinct(terms(text))


def word_ranking(nodes: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The `n` nodes whose names hold most words of each query (query_id, text): ``query_id, graph_id, id, score, place``.

    The score is the share of the query's words; a word is one side of an equi-join, so no query meets every node.
    """
    q = queries.select("query_id", name_words(F.col("text")).alias("w")).select("query_id", F.size("w").alias("words"), F.explode("w").alias("word"))
    names = nodes.select("graph_id", "id", F.explode(name_words(F.col("name"))).alias("word"))
    hits = names.join(q, "word").groupBy("query_id", "words", "graph_id", "id").agg(F.count(F.lit(1)).alias("n"))
    scored = hits.select("query_id", "graph_id", "id", F.round(F.col("n") / F.col("words"), 6).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.col("graph_id"), F.col("id")], n, "id")


def rrf(semantic: DataFrame, keyword: DataFrame, key: str, n: int) -> DataFrame:
    """Fuse two rankings (query, key, place) by the sum of 1 / (60 + place); ties go to the semantic place, then the key."""
    s = semantic.select("query", key, F.col("place").alias("ps"))
    k = keyword.select("query", key, F.col("place").alias("pk"))
    both = s.join(k, ["query", key], "full_outer")
    part = lambda p: F.when(F.col(p).isNotNull(), 1.0 / (RRF + F.col(p))).otherwise(0.0)
    scored = both.select("query", key, F.round(part("ps") + part("pk"), 6).alias("score"), F.coalesce("ps", F.lit(1 << 30)).alias("ps"))
    return top(scored, ["query"], [F.desc("score"), F.col("ps"), F.col(key)], n, key).drop("ps")


def symbol_search(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Nodes whose id is the query; if none, those whose name is; if none, those that hold it in id or names.

    ``query, graph_id, id, tier``, per graph; `queries` is a few rows.
    """
    q = queries.where(F.trim("query") != "").select("query").distinct()
    text = F.lower("query")
    fuzzy = F.contains(F.lower("id"), text) | F.contains(F.lower(F.coalesce("name", F.lit(""))), text) | F.contains(F.lower(F.coalesce("qualname", F.lit(""))), text)
    rows = nodes.join(q, fuzzy).select(
        "query", "graph_id", "id", F.when(F.col("id") == F.col("query"), 1).when(F.col("name") == F.col("query"), 2).otherwise(3).alias("tier")
    )
    best = rows.groupBy("query", "graph_id").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["query", "graph_id", "tier"], "left_semi")


def find_equivalent(vectors: DataFrame, queries: DataFrame, nodes: DataFrame, wanted: tuple[str, ...], hint: str, n: int) -> DataFrame:
    """The `n` nodes nearest to each query vector (query_id, v) among those with a wanted label, with 0.1 more for those
    whose module's words are all in the hint, if the hint is qualified (has a dot or slash).

    `vectors` are (graph_id, id, v). Every vector of a wanted node is scored, bonus included, before the best are taken.
    """
    word = lambda c: F.array_distinct(terms(c))
    rows = vectors.join(nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, wanted)))).select("graph_id", "id", "module"), ["graph_id", "id"])
    qualified = "." in hint or "/" in hint
    module = word(F.col("module"))
    inside = (F.size(module) > 0) & (F.size(F.array_except(module, word(F.lit(hint)))) == 0)
    bonus = F.when(inside, 0.1).otherwise(0.0) if qualified else F.lit(0.0)
    return best_cosines(rows.withColumn("bonus", bonus), queries, ["graph_id", "id"], n, "bonus")


def embedding_text(nodes: DataFrame) -> DataFrame:
    """The text a node is embedded by: ``name kind in module signature (parameters) : documentation``.

    Documentation is the first that isn't blank of docstring, documentation, snippet and the snippet's first line.
    """
    p = F.from_json("properties", "struct<signature:string,parameters:array<string>,docstring:string,documentation:string,snippet:string>")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = F.regexp_replace(F.element_at("labels", -1), "^Code", "")
    doc = F.coalesce(filled(F.col("p.docstring")), filled(F.col("p.documentation")), filled(F.col("p.snippet")))
    text = F.concat_ws(
        " ",
        filled(F.col("name")),
        F.lower(kind),
        F.concat(F.lit("in "), filled(F.col("module"))),
        filled(F.col("p.signature")),
        F.when(F.size("p.parameters") > 0, F.concat(F.lit("("), F.array_join("p.parameters", ", "), F.lit(")"))),
        F.concat(F.lit(": "), doc),
    )
    return nodes.withColumn("p", p).select("graph_id", "id", text.alias("text"))


def search(kind: str, *, semantic=None, keyword=None, hybrid=None, symbol=None) -> DataFrame:
    """Dispatch to one of the given searches (functions without arguments); an unknown kind means `hybrid`."""
    return {"semantic": semantic, "keyword": keyword, "symbol": symbol}.get(kind, hybrid)()


def code_search(nodes: DataFrame, queries: DataFrame, n: int, language: str | None = None) -> DataFrame:
    """Keyword search with the language filtered before the best `n` are taken."""
    rows = lookups.language(nodes)
    rows = rows if language is None else rows.where(F.col("language") == language)
    return top(keyword_like(rows, queries), ["query"], [F.desc("score"), F.col("graph_id"), F.col("id")], n, "id")


def embed(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """Vectors of texts (graph_id, id, text) as hashed bags of words, of unit length: ``graph_id, id, vector``.

    A word counts in the place its MD5 names, so a text has the same vector on every machine. Texts without words, and
    null ones, have a vector of zeros. Words are told apart by built-in expressions, batches of them are hashed together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for batch in batches:
            words = batch.column("words")
            flat = words.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            for w in names:
                if w not in place:
                    place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
            if len(place) > KEPT_WORDS:
                place = {w: place[w] for w in names}
            x = np.zeros((batch.num_rows, dimensions))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(row):
                np.add.at(x, (row, np.array([place[w] for w in names])[flat.indices.to_numpy(zero_copy_only=False)]), 1)
            norm = np.sqrt((x * x).sum(1))
            x /= np.where(norm > 0, norm, 1)[:, None]
            offsets = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("graph_id"), batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["graph_id", "id", "vector"])

    rows = texts.select("graph_id", "id", terms(F.col("text")).alias("words"))
    return rows.mapInArrow(count, "graph_id string, id string, vector array<double>")
