"""Functions paired with their documentation.

Texts are read by the lexers of `chunk_maps` and `script_grammar`, so brackets and definitions in strings, templates,
regular expressions and comments are none. Brackets are matched to delimit functions, and comments directly before a
definition are attached. Documentation counts if it holds a word beyond name, signature and the words that carry nothing,
and if it isn't one of the phrases that the corpus puts to functions of many names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import chunk_maps
from quiver.sources import script_grammar
from quiver.session import checkpointed

#: Share of all documentation from which on a phrase, put to at least so many names, is a placeholder; so there are at
#: most 1 / PLACEHOLDER_SHARE of them. Share from which on a word carries nothing.
PLACEHOLDER_SHARE, PLACEHOLDER_NAMES, COMMON_SHARE = 0.001, 20, 0.1

# Words that carry nothing about what a function does.
#: Grammar words, words for the thing itself, and tags of documentation languages.
_EMPTY_WORDS = frozenset(
    """a an the of to in on for by as at is are be it its this that these and or with from into used use uses using
    function functions method methods procedure def class object self cls module returns return param params parameter
    parameters arg args argument arguments type types rtype raises throws value values example see also note
    inheritdoc override""".split()
)
#: Words of placeholders and of notes to tools.
_PLACEHOLDER_WORDS = frozenset(
    """todo fixme xxx tbd tba hack wip t b d n na none nil null nothing description descriptions describe docstring
    docstrings doc docs documentation documented document summary comment comments text placeholder lorem ipsum dolor
    sit amet blah foo bar add write missing available no not yet see above below parent base super same cf here there
    later please proper goes insert your fill filled stub generated empty blank left purpose intentionally time when
    was will should
    noqa pragma cover eslint disable enable next line lines no-unused-vars unused vars unused-vars ts ignore nocheck
    expect error pylint mypy flake fmt off skip istanbul coverage prettier jshint jslint lint isort nosec""".split()
)
_KNOWN = _EMPTY_WORDS | _PLACEHOLDER_WORDS
_KNOWN |= {w[:-1] for w in _KNOWN if len(w) > 3 and w.endswith("s")}
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_FENCE = re.compile(r"\A\s*(```|~~~).*?(?:\n\s*\1[^\n]*|\Z)", re.S)
_TOOL_NOTE = re.compile(
    r"^\s*(?:noqa\b|pragma\b|type:\s*ignore|eslint-|ts-(?:ignore|nocheck|expect)|@ts-|istanbul\b|pylint:|mypy:|fmt:|prettier-|c8\b|v8\b|nosec\b|isort:|flake8\b|jshint\b)[^\n]*$",
    re.I | re.M,
)


def _words(text: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(text)}


def _plain(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def left_words(documentation: str | None, name: str | None, signature: str | None) -> tuple[list[str], str]:
    """Words that say something beyond name and signature, and all words as a phrase.

    A fenced signature at the start and notes to tools are passed over. What is left are words that are neither parts of
    the name or signature nor grammar, tag or placeholder words nor numbers.
    """
    text = _TOOL_NOTE.sub(" ", _FENCE.sub(" ", documentation or "", count=1))
    words = [w.lower() for w in _WORD.findall(text)]
    own = f"{name or ''} {signature or ''}"
    known = {p.lower() for p in _PARTS.findall(own)} | _words(own)
    known |= {_plain(w) for w in known}
    left = {w for w in words if w not in known and _plain(w) not in known and w not in _KNOWN and _plain(w) not in _KNOWN and not w.isdigit()}
    return sorted(left), " ".join(words)


def is_telling(documentation: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a documentation says something beyond the function's name and signature, the corpus aside."""
    return bool(left_words(documentation, name, signature)[0])


# A token is a comment, a string, a bracket or anything else; strings and comments come from the lexers.
_PLAIN = re.compile(r"(?P<line>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>\w+)|(?P<other>[^\s\w])")


def _python_tokens(text: str) -> list[tuple[str, str, int, int]]:
    out, at = [], 0
    for kind, start, end in [*chunk_maps.python_marks(text), ("", len(text), len(text))]:
        out += [(m.lastgroup, m.group(), m.start(), m.end()) for m in _PLAIN.finditer(text, at, start)]
        if kind:
            out.append((kind, text[start:end], start, end))
        at = end
    return out


_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
_STRINGS = {'"', "/r/", "``", "J"}


def _script_tokens(text: str, ending: str) -> list[tuple[str, str, int, int]]:
    """Templates are one string with what is in them."""
    out: list[tuple[str, str, int, int]] = []
    at, deep, began = 0, 0, 0
    for kind, start, end in script_grammar.tokens(text, ending):
        if deep:
            deep += (kind == "`{") - (kind == "}`")
            if not deep:
                out.append(("string", text[began:end], began, end))
                at = end
            continue
        out += [("line", "\n", at + i, at + i + 1) for i, c in enumerate(text[at:start]) if c == "\n"] if "\n" in text[at:start] else []
        at = end
        if kind == "`{":
            deep, began = 1, start
            continue
        token = text[start:end]
        group = "comment" if kind == "comment" else "string" if kind in _STRINGS else "open" if kind in _OPEN else "close" if kind in _CLOSE else "word" if token[0].isalnum() or token[0] in "_$" else "other"
        out.append((group, token, start, end))
    return out


_NOT_NAMES = frozenset("if for while switch catch return function await typeof new delete void do else with super import".split())


def _clean(comments: list[str]) -> str:
    """Text of comment tokens without their marks."""
    lines = []
    for c in comments:
        if c.startswith("/*"):
            body = c[2:-2] if c.endswith("*/") and len(c) > 3 else c[2:]
            lines += [re.sub(r"^\s*\*+ ?", "", x) for x in body.lstrip("*!").split("\n")]
        else:
            lines.append(re.sub(r"^(?:///?|#+:?!?) ?", "", c))
    return "\n".join(lines).strip()


def _unquote(token: str) -> str:
    token = token.lstrip("rRbBuUfF")
    for mark in ('"""', "'''", '"', "'"):
        if token.startswith(mark):
            return token[len(mark) : -len(mark)] if token.endswith(mark) and len(token) >= 2 * len(mark) else token[len(mark) :]
    return token


def _python_functions(text: str) -> Iterator[tuple[str, str, str]]:
    """(name, code, documentation) of every def: comments right above it or its decorators, and its docstring."""
    tokens = _python_tokens(text)
    above: list[str] = []
    first, at, depth = None, 0, 0  # start of the definition with its comments
    fresh, blank = True, 0
    while at < len(tokens):
        kind, token, start, end = tokens[at]
        if kind == "line":
            blank += 1
            if blank > 1 and depth == 0 and not (first is not None and above and text[first] == "@"):
                above, first = [], None
            fresh = True
        elif kind == "comment" and fresh and depth == 0:
            above.append(token)
            first, blank = start if first is None else first, 0
        elif fresh and token == "@" and depth == 0:
            first, blank, fresh = start if first is None else first, 0, False
            while at + 1 < len(tokens) and (tokens[at + 1][0] != "line" or depth):
                at += 1
                depth += (tokens[at][0] == "open") - (tokens[at][0] == "close")
        elif token == "async" and fresh:
            first = start if first is None else first
        elif token == "def" and kind == "word" and at + 1 < len(tokens) and (fresh or text[max(0, start - 6) : start].strip() == "async"):
            yield_from = _python_body(text, tokens, at, first if first is not None else start, above)
            if yield_from:
                yield yield_from
            above, first, fresh, blank = [], None, False, 0
        else:
            depth = max(0, depth + (kind == "open") - (kind == "close"))
            above, first, fresh, blank = [], None, False, 0
        at += 1


def _python_body(text: str, tokens: list, at: int, first: int, above: list[str]) -> tuple[str, str, str] | None:
    name, start = tokens[at + 1][1], tokens[at][2]
    indent = start - (text.rfind("\n", 0, start) + 1)
    indent = len(text[start - indent : start]) - len(text[start - indent : start].lstrip()) if indent else 0
    i, depth = at + 2, 0
    while i < len(tokens) and not (tokens[i][1] == ":" and depth == 0):
        depth += (tokens[i][0] == "open") - (tokens[i][0] == "close")
        i += 1
    j = i + 1
    while j < len(tokens) and tokens[j][0] in ("line", "comment"):
        j += 1
    docs = [_clean(above)] if above else []
    if j < len(tokens) and tokens[j][0] == "string" and (j + 1 == len(tokens) or tokens[j + 1][0] in ("line", "comment") or tokens[j + 1][1] == ";"):
        docs.append(_unquote(tokens[j][1]))
    # the body ends before the first line that is indented no deeper, outside brackets and strings
    end, k, depth = len(text), i + 1, 0
    while k < len(tokens):
        kind, token, where, _ = tokens[k]
        depth += (kind == "open") - (kind == "close")
        if kind == "line" and depth <= 0 and k + 1 < len(tokens) and tokens[k + 1][0] not in ("line", "comment"):
            nxt = tokens[k + 1][2]
            if nxt - (text.rfind("\n", 0, nxt) + 1) <= indent:
                end = where
                break
        k += 1
    return name, text[first:end].rstrip(), "\n".join(d for d in docs if d)


def _script_functions(text: str, ending: str) -> Iterator[tuple[str, str, str]]:
    """(name, code, documentation) of functions, methods and arrow functions bound to a name."""
    tokens = _script_tokens(text, ending)
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, (kind, *_rest) in enumerate(tokens):
        if kind == "open":
            stack.append(i)
        elif kind == "close" and stack:
            match[stack.pop()] = i
    above: list[str] = []
    first: int | None = None  # token of the statement's start
    blank = 0
    i = 0
    while i < len(tokens):
        kind, token, start, _ = tokens[i]
        if kind == "line":
            blank += 1
            if blank > 1 and first is None:
                above = []
        elif kind == "comment":
            if first is None:
                above = [*above, token] if blank <= 1 else [token]
                blank = 0
        elif token in ";{}" or kind == "close":
            above, first, blank = [], None, 0
        else:
            blank = 0
            first = i if first is None else first
            if token == "(" and i in match:
                name = _script_name(tokens, first, i)
                body = _script_body(tokens, match, match[i] + 1) if name else None
                if body:
                    last = match.get(body[0], len(tokens) - 1) if body[1] else body[0]
                    stop = tokens[last][3]
                    begin = tokens[first][2]
                    if above:
                        begin = text.rfind(above[0], 0, begin)
                    yield name, text[begin:stop], _clean(above)
                    i, above, first = body[0], [], None  # functions inside the body come next
                    i += 1
                    continue
                i = match[i]
        i += 1


def _script_name(tokens: list, first: int, at: int) -> str | None:
    """Name of the function whose parameters open at token `at`, in a statement that starts at `first`."""
    words = [(k, t) for k, t, *_ in tokens[first:at] if k != "line" and k != "comment"]
    texts = [t for _, t in words]
    if "function" in texts:
        f = texts.index("function")
        named = [t for k, t in words[f + 1 :] if k == "word"]
        if named:
            return named[0]
    if "=" in texts:
        e = texts.index("=")
        if all(t in ("async", "function", "*") for t in texts[e + 1 :]):
            named = [t for k, t in words[:e] if k == "word" and t not in ("export", "default", "const", "let", "var", "static", "public", "private", "readonly")]
            return named[0] if named else None
        return None
    if words and words[-1][0] == "word" and texts[-1] not in _NOT_NAMES and all(k == "word" or t in "*#@" for k, t in words):
        return texts[-1]
    return None


def _script_body(tokens: list, match: dict[int, int], i: int) -> tuple[int, bool] | None:
    """Token where a function's body opens after its parameters, behind a return type and an arrow."""
    colon = False
    while i < len(tokens):
        kind, token, *_ = tokens[i]
        if token == "{" and i in match:
            return i, True
        if token == "=>" and not (i + 1 < len(tokens) and tokens[i + 1][1] == "{"):
            j = i + 1
            while j < len(tokens) and tokens[j][1] not in (";", ")") and tokens[j][0] != "close":
                j = match.get(j, j) + 1 if tokens[j][0] == "open" else j + 1
            return min(j, len(tokens) - 1), False
        if token == ":":
            colon = True
        elif kind in ("line", "comment") or token == "=>":
            pass
        elif not colon or token in ";)":
            return None
        elif kind == "open":
            if i not in match:
                return None
            i = match[i]
        i += 1
    return None


def functions_of(text: str, ending: str) -> list[tuple[str, str, str]]:
    """All functions of a source text (py, js, ts or tsx) with the documentation found at them: (name, code, documentation)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return list(_python_functions(text) if ending == "py" else _script_functions(text, ending))


def _from_code(snippet: str, language: str | None, path: str | None = None) -> str:
    """Documentation of the first definition of a snippet."""
    ending = (path or "").rsplit(".", 1)[-1]
    if ending not in _ENDINGS:
        ending = {"python": "py", "typescript": "ts", "javascript": "js"}.get(language or "") or ("py" if re.search(r"^\s*(?:async\s+)?def\s", snippet, re.M) else "ts")
    return next((d for _, _, d in functions_of(snippet, ending)), "")


_ENDINGS = ("py", "js", "ts", "tsx")
_PROPERTIES = "struct<name:string,signature:string,snippet:string,docstring:string,documentation:string>"


_CANDIDATES = "array<struct<documentation:string,left:array<string>,phrase:string>>"


def _telling(rows: DataFrame) -> DataFrame:
    """The first telling one of `candidates` of each row as `documentation`; rows without one are dropped.

    `rows` (written down, as they are read twice) have `name` and `candidates`. Phrases and words are counted over all of
    them; what is held of the counts is bounded by the shares.
    """
    every = rows.select("name", F.explode("candidates").alias("c")).where(F.size("c.left") > 0).select("name", "c.phrase", "c.left")
    total = every.count()
    phrases = every.groupBy("phrase", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("phrase").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))
    usual = [r[0] for r in phrases.where((F.col("n") >= PLACEHOLDER_SHARE * total) & (F.col("names") >= PLACEHOLDER_NAMES)).select("phrase").collect()]
    words = every.select(F.explode("left").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    common = [r[0] for r in words.where((F.col("n") >= COMMON_SHARE * total) & (F.col("n") >= PLACEHOLDER_NAMES)).select("w").collect()]
    none = F.array().cast("array<string>")
    usual, common = (F.array(*map(F.lit, sorted(x))) if x else none for x in (usual, common))
    good = F.filter("candidates", lambda c: (F.size(F.array_except(c["left"], common)) > 0) & ~F.array_contains(usual, c["phrase"]))
    return rows.withColumn("documentation", F.get(good, F.lit(0))["documentation"]).where(F.col("documentation").isNotNull())


def _candidate(doc: str, name: str | None, signature: str | None) -> dict | None:
    left, phrase = left_words(doc, name, signature)
    return {"documentation": doc, "left": left, "phrase": phrase} if left else None


def documented_functions(nodes: DataFrame) -> DataFrame:
    """Pairs of code and telling documentation of function and method nodes: ``graph_id, id, code, documentation``.

    Stored documentation (`docstring`, `documentation`) is taken if it is telling, else that found in the snippet.
    Nodes whose `properties` are null, can't be read or hold no snippet that isn't blank give no row; of a node
    sent several times one row with a telling documentation is kept, the greatest by documentation and code.
    Texts of any length are read whole. Null names and signatures hold no words.
    """
    wanted = F.array_contains("labels", "CodeFunction") | F.array_contains("labels", "CodeMethod")
    p = F.from_json("properties", _PROPERTIES, {"mode": "PERMISSIVE"})
    rows = (
        nodes.where(wanted & F.col("properties").isNotNull() & F.expr("try_parse_json(properties) IS NOT NULL"))
        .select("graph_id", "id", "language", "file_path", p.alias("p"))
        .where(F.length(F.trim(F.regexp_replace("p.snippet", r"[\s\x{a0}]+", ""))) > 0)
        .select("graph_id", "id", "language", "file_path", "p.*")
        .distinct()
    )
    schema = pa.schema(
        [("graph_id", pa.string()), ("id", pa.string()), ("name", pa.string()), ("code", pa.string()), ("candidates", pa.list_(pa.struct([("documentation", pa.string()), ("left", pa.list_(pa.string())), ("phrase", pa.string())])))]
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for r in batch.to_pylist():
                name, signature = r["name"], r["signature"]
                docs = dict.fromkeys((r["docstring"], _stored(r["documentation"]), _from_code(r["snippet"], r["language"], r["file_path"])))
                found = [c for c in (_candidate(d, name, signature) for d in docs if d) if c]
                if found:
                    for k, v in zip(out, (r["graph_id"], r["id"], name, r["snippet"], found)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    found = _telling(checkpointed(rows.mapInArrow(pair, f"graph_id string, id string, name string, code string, candidates {_CANDIDATES}")))
    best = F.max(F.struct("documentation", "code")).alias("b")
    return found.groupBy("graph_id", "id").agg(best).select("graph_id", "id", "b.code", "b.documentation")


def _stored(documentation: str | None) -> str | None:
    """The `documentation` entry, a string or the JSON of a list of strings, without a fenced signature at its start."""
    if documentation and documentation.startswith("["):
        import json

        try:
            parts = [x for x in json.loads(documentation) if isinstance(x, str)]
        except ValueError:
            return documentation
        return "\n".join(x for i, x in enumerate(parts) if i or not x.lstrip().startswith(("```", "~~~")))
    return documentation


def documented_functions_of_files(documents: DataFrame) -> DataFrame:
    """The same from whole source files: ``doc_id, name, code, documentation``, functions in order of the file.

    Files that aren't Python, TypeScript or JavaScript by their ending, and null texts, give no rows.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("name", pa.string()), ("code", pa.string()), ("candidates", pa.list_(pa.struct([("documentation", pa.string()), ("left", pa.list_(pa.string())), ("phrase", pa.string())])))]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for r in batch.to_pylist():
                for name, code, doc in functions_of(r["text"], r["ending"]):
                    candidate = _candidate(doc, name, None)
                    if candidate:
                        for k, v in zip(out, (r["doc_id"], name, code, [candidate])):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    ending = F.regexp_extract("file_path", r"\.(py|tsx?|js)$", 1)
    files = documents.where(F.col("text").isNotNull() & (ending != "")).select("doc_id", "text", ending.alias("ending"))
    found = checkpointed(files.mapInArrow(extract, f"doc_id bigint, name string, code string, candidates {_CANDIDATES}"))
    return _telling(found).select("doc_id", "name", "code", "documentation")
