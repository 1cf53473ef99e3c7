"""Source files that don't parse.

A file is cut into chunks at line ends. A chunk is summarised as a map: for each state that the lexer can be in at its
start, the state at its end and the brackets that stay open or close something before it. Maps compose associatively,
so chunks are reduced in any grouping, within a task or over several; the map of the file decides on brackets, strings
and comments. A file in which they balance is parsed statement by statement with local grammars, which decide the rest.
"""

from __future__ import annotations

import ast
import pickle
import re
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.sources import script_grammar
from quiver.llm.chunk_maps import Entry, Piece, join, read, start, verdict

#: Characters of a chunk, characters of a text from which its chunks are spread over tasks, chunks that such a task
#: reduces at once, and parsed statements that a worker remembers.
CHUNK, SPREAD, FANOUT, KEPT = 2_048, 1_000_000, 64, 50_000
#: Calls that a grammar may nest.
DEPTH = 20_000


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about `size` characters that end with a line, not with a line that a backslash continues."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1
        while end and text[end - 2 : end - 1] in ("\\", "\r"):
            end = text.find("\n", end) + 1
        end = end or len(text)
        yield text[at:end]
        at = end


def clean(text: str, ending: str) -> str:
    """The text as the lexers read it: without a byte order mark, and for Python with line feeds alone."""
    text = text.removeprefix("\ufeff")
    return text.replace("\r\n", "\n").replace("\r", "\n") if ending == "py" else text


def summary(text: str, ending: str, size: int = CHUNK) -> Entry:
    """The map of a whole cleaned text at its one start state, from the maps of its chunks."""
    whole = None
    for chunk in chunks(text, size):
        if whole is None:
            whole = read(chunk, ending, start(ending))
        elif not whole.bad:
            whole = join(whole, Piece(chunk, ending))
    return whole or Entry(state=start(ending))


_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b")
_PARSED: dict[str, bool] = {}


def _python_statements(text: str, lines: list[tuple[int, int]]) -> Iterator[str]:
    """Top-level statements, cut at those of the line starts outside brackets and strings that have text in the first
    column."""
    cuts, decorated = [0], text[:1] == "@"
    for line, closed in lines:
        c = text[line : line + 1]
        if closed or not c or c.isspace() or c in "#\\" or _CONTINUES.match(text, line):
            continue
        if not decorated:
            cuts.append(line)
        decorated = c == "@"
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        yield text[a:b]


def _python_parses(code: str) -> bool:
    try:
        compile(code, "?", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    return True


def _statements_parse(text: str, ending: str, e: Entry) -> bool:
    """Whether the local grammars take all statements of a balanced text."""
    if ending != "py":
        return not script_grammar.parse(e.found, ending)
    for statement in _python_statements(text, e.found):
        sound = _PARSED.get(statement)
        if sound is None:
            sound = _python_parses(statement)
            if len(_PARSED) >= KEPT:
                _PARSED.clear()
            _PARSED[statement] = sound
        if not sound:
            return False
    return True


def judge(text: str, ending: str, e: Entry | None = None) -> bool | None:
    """Whether a file parses; None if it nests deeper than the grammars can follow.

    First its map decides (`e`, if it is known), then the grammars of its statements.
    """
    text = clean(text, ending)
    if e is None:
        e = summary(text, ending)
    if verdict(e):
        return False
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEPTH))
    try:
        return _statements_parse(text, ending, e)
    except (RecursionError, MemoryError):
        return None
    finally:
        sys.setrecursionlimit(limit)


_ENDING = r"\.(py|tsx?|js)$"


def _files(documents: DataFrame) -> DataFrame:
    ending = F.regexp_extract("file_path", _ENDING, 1)
    return documents.where((ending != "") & F.col("text").isNotNull()).select("doc_id", "text", ending.alias("ending"))


def _spread(files: DataFrame) -> DataFrame:
    """``key, ending, map`` of texts of `SPREAD` characters and more: their chunks are mapped in tasks of their own, and
    the maps reduced in two rounds. The map of the first chunk has the one start state."""
    keyed = files.select("key", "text", "ending").dropDuplicates(["key", "ending"])
    columns = [("key", pa.string()), ("ending", pa.string()), ("k", pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*columns, ("chunk", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                for k, chunk in enumerate(chunks(clean(r["text"], r["ending"]), SPREAD // FANOUT)):
                    yield pa.RecordBatch.from_pydict({"key": [r["key"]], "ending": [r["ending"]], "k": [k], "chunk": [chunk]}, schema=schema)

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*columns, ("map", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                piece = Piece(r["chunk"], r["ending"], (start(r["ending"]),) if r["k"] == 0 else None)
                yield pa.RecordBatch.from_pydict({"key": [r["key"]], "ending": [r["ending"]], "k": [r["k"]], "map": [pickle.dumps(piece)]}, schema=schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*columns, ("map", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                whole = None
                for m in r["maps"]:
                    piece = pickle.loads(m["map"])
                    whole = piece if whole is None else piece.after(whole)
                yield pa.RecordBatch.from_pydict({"key": [r["key"]], "ending": [r["ending"]], "k": [r["k"]], "map": [pickle.dumps(whole)]}, schema=schema)

    schema = "key string, ending string, k int, map binary"
    maps = keyed.mapInArrow(cut, "key string, ending string, k int, chunk string").repartition("key", "ending", "k").mapInArrow(map_chunks, schema)
    for group in ((F.col("k") / F.lit(FANOUT)).cast("int"), F.lit(0)):
        # FANOUT maps, then one for each FANOUT: together the length of one text
        maps = maps.groupBy("key", "ending", group.alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "map"))).alias("maps")).mapInArrow(reduce, schema)
    return maps.drop("k")


def judged_files(documents: DataFrame) -> DataFrame:
    """``doc_id, sound`` of the source files (.py, .ts, .tsx, .js) that don't parse in the language of their ending
    (`sound` is false) or nest deeper than the grammars can follow (null).

    Syntax alone counts. Empty and blank texts parse; null texts and other files give no rows; every copy of a file
    counts, whatever its `doc_id`. JavaScript may be a module or a script. Every text is cut into chunks and decided by
    its map and its statements; texts of `SPREAD` characters and more are mapped by several tasks, others where they lie.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                known = batch.schema.get_field_index("map")
                maps = batch.column(known).to_pylist() if known >= 0 else [None] * batch.num_rows
                ids, verdicts = [], []
                for i, text, ending, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), maps):
                    sound = judge(text, ending, pickle.loads(m).entries[start(ending)] if m is not None else None)
                    if not sound:
                        ids.append(i)
                        verdicts.append(sound)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(verdicts, pa.bool_())], names=["doc_id", "sound"])

    files = _files(documents)
    here = files.where(F.length("text") < SPREAD).mapInArrow(decide, "doc_id bigint, sound boolean")
    far = files.where(F.length("text") >= SPREAD).withColumn("key", F.sha2("text", 256))
    mapped = far.join(_spread(far), ["key", "ending"]).select("doc_id", "text", "ending", "map")
    return here.unionByName(mapped.mapInArrow(decide, "doc_id bigint, sound boolean"))


def broken_files(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the source files that don't parse; see `judged_files`."""
    return judged_files(documents).where(~F.col("sound")).select("doc_id")


def undecided_files(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the source files that nest too deep to be judged."""
    return judged_files(documents).where(F.col("sound").isNull()).select("doc_id")


def broken_rates(documents: DataFrame, broken: DataFrame) -> DataFrame:
    """Files, broken files and their rate per graph and ending."""
    ending = F.regexp_extract("file_path", _ENDING, 1)
    files = documents.where((ending != "") & F.col("text").isNotNull()).select("doc_id", "graph_id", ending.alias("ending"))
    marked = files.join(broken.select("doc_id", F.lit(1).alias("bad")).distinct(), "doc_id", "left")
    return marked.groupBy("graph_id", "ending").agg(
        F.count(F.lit(1)).alias("files"),
        F.count("bad").alias("broken"),
        F.round(F.count("bad") / F.count(F.lit(1)), 4).alias("rate"),
    )
