"""Facts of TypeScript and JavaScript files from their tokens: definitions, imports, calls, and imports nothing uses.

The facts have the columns of those of Python files, so the same rules run over both.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.sources import script_grammar
from quiver.sources.facts import _TYPES, FACT

_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
#: Token classes that add a way through a function.
_BRANCHES = frozenset(["if", "for", "while", "do", "case", "catch", "&&", "||", "??", "?"])
_DECLARES = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "namespace"}


class _File:
    """Tokens of one file without its comments."""

    def __init__(self, text: str, ending: str) -> None:
        self.text = text
        self.types = ending != "js"
        marks = [m for m in script_grammar.tokens(text, ending) if m[0] != "comment"]
        self.kind, self.start, self.end = ([m[i] for m in marks] for i in range(3)) if marks else ([], [], [])
        self.lines = [i for i, c in enumerate(text) if c == "\n"]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(self.kind):
            if k in _OPEN or k == "`{":
                stack.append(i)
            elif k in (")", "]", "}", "}`") and stack:
                self.match[stack.pop()] = i

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def at(self, i: int) -> str:
        return self.kind[i] if 0 <= i < len(self.kind) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.start[min(i, len(self.start) - 1)] - 1) + 1

    def is_name(self, i: int) -> bool:
        return self.at(i) == "i" or self.at(i) in script_grammar.CONTEXTUAL

    def named(self, i: int) -> bool:
        """Whether a method may be called so: any word, reserved ones too."""
        return self.is_name(i) or self.at(i) in script_grammar.RESERVED or self.at(i) == "#"

    def parameters(self, i: int) -> tuple[int, int]:
        """Number of parameters in the parentheses at `i`, and of those without a type."""
        end, depth, spans, first = self.match.get(i, i), i + 1, [], i + 1
        while depth < end:
            if self.kind[depth] == ",":
                spans.append((first, depth))
                first = depth + 1
            depth = self.match.get(depth, depth) + 1
        if first < end:
            spans.append((first, end))
        untyped = 0
        for a, b in spans:
            j = a
            while j < b and self.kind[j] not in (":", "="):
                j = self.match.get(j, j) + 1
            untyped += self.types and self.at(j) != ":" and self.at(a) != "this"
        return len(spans), untyped

    def body(self, i: int) -> int | None:
        """The brace that opens the body after the parentheses at `i`, behind a return type; None for a bare signature."""
        j = self.match.get(i, i) + 1
        if self.at(j) == ":":
            j += 1
            while j < len(self.kind) and self.kind[j] not in (";", "=>", ")", ","):
                if self.kind[j] == "{" and self.at(j - 1) not in (":", "|", "&", "<", ",", "=>"):
                    return j
                j = self.match.get(j, j) + 1
        return j if self.at(j) == "{" else None


def _imports(f: _File, i: int) -> tuple[int, str | None, list[tuple[str, str | None]]]:
    """(token after the import at `i`, module, names as (local, imported))."""
    names: list[tuple[str, str | None]] = []
    j = i + 1
    if f.at(j) == "type" and f.at(j + 1) != "from":
        j += 1
    while j < len(f.kind) and f.kind[j] not in ('"', ";"):
        if f.kind[j] == "{":
            end, first = f.match.get(j, j), j + 1
            for k in range(j + 1, end + 1):
                if f.kind[k] == "," or k == end:
                    part = [x for x in range(first, k) if f.kind[x] not in ("as",) and f.named(x)]
                    if len(part) > 1 and f.word(part[0]) == "type" and "as" not in f.kind[first:k]:
                        part = part[1:]
                    if part:
                        names.append((f.word(part[-1]), f.word(part[0])))
                    first = k + 1
            j = end
        elif f.kind[j] == "*" and f.at(j + 1) == "as":
            names.append((f.word(j + 2), "*"))
            j += 2
        elif f.is_name(j) and f.kind[j] != "from":
            names.append((f.word(j), "default"))
        j += 1
    module = f.word(j)[1:-1] if f.at(j) == '"' else None
    return j + 1, module, names


def script_file_facts(doc_id: int, text: str, ending: str) -> Iterator[tuple]:
    """Facts of one file; one that doesn't parse gives an `error` fact and what its readable tokens tell."""
    try:
        wrong = script_grammar.check(text.removeprefix("﻿"), ending)
    except RecursionError:
        wrong = "nested too deep"
    if wrong:
        yield doc_id, "error", "SyntaxError", None, None, None, None, None, None, wrong
    f = _File(text, ending)
    n = len(f.kind)
    used: dict[str, int] = {}
    for i in range(n):
        if f.kind[i] == "J":
            used["React"] = used.get("React", 0) + 1  # elements are made by it
            for w in _NAME.findall(f.word(i)):
                used[w] = used.get(w, 0) + 1
        elif f.is_name(i) and f.at(i - 1) not in (".", "?."):
            # a key of an object isn't a use, but its short form is
            key = f.at(i + 1) == ":" and f.at(i - 1) in ("{", ",")
            if not key:
                used[f.word(i)] = used.get(f.word(i), 0) + 1
    scopes: list[tuple[int, str, str]] = []  # last token, prefix, kind
    i = 0
    while i < n:
        while scopes and i > scopes[-1][0]:
            scopes.pop()
        prefix, inside = (scopes[-1][1], scopes[-1][2]) if scopes else ("", "module")
        k, before = f.kind[i], f.at(i - 1)
        if k == "import" and before != "." and f.at(i + 1) not in ("(", "."):
            after, module, names = _imports(f, i)
            own: dict[str, int] = {}
            for x in range(i, min(after, n)):
                if f.is_name(x):
                    own[f.word(x)] = own.get(f.word(x), 0) + 1
            for local, imported in names:
                kind = "import" if used.get(local, 0) > own.get(local, 0) else "unused_import"
                yield doc_id, kind, local, local, f.line(i), f.line(after - 1), None, None, None, f"{module}.{imported}"
            if not names and module:
                yield doc_id, "import", module, module, f.line(i), f.line(after - 1), None, None, None, module
            i = after
            continue
        if k in _DECLARES and before != "." and f.is_name(i + 1) and f.at(i + 2) in ("{", "<", "extends", "implements", "="):
            j = i + 2
            while j < n and f.kind[j] not in ("{", "=", ";"):
                j = f.match.get(j, j) + 1
            end = f.match.get(j, j) if f.at(j) == "{" else j
            base = f.text[f.end[i + 1] : f.start[j]].strip() if j < n else ""
            base = re.sub(r"\s+", " ", re.sub(r"^.*?\b(extends|implements)\b", r"\1", base)) if re.search(r"\b(extends|implements)\b", base) else ""
            name = f"{prefix}{f.word(i + 1)}"
            yield doc_id, _DECLARES[k], f.word(i + 1), name, f.line(i), f.line(end), None, None, None, base
            if f.at(j) == "{" and k in ("class", "namespace", "interface"):
                scopes.append((end, name + ".", k))
            i = j + 1 if f.at(j) == "{" else i + 2
            continue
        definition = None
        if k == "function" and (f.is_name(i + 1) or (f.at(i + 1) == "*" and f.is_name(i + 2))):
            at = i + 1 + (f.at(i + 1) == "*")
            definition = "function", at, at + 1
        elif inside == "class" and f.named(i) and f.at(i + 1) in ("(", "<") and before not in (".", "new", "=", "@", "return"):
            definition = "method", i, i + 1
        elif k == "=" and f.is_name(i - 1) and f.at(i - 2) in ("const", "let", "var") and (f.at(i + 1) in ("(", "async", "function")):
            j = i + 1 + (f.at(i + 1) == "async")
            j += (f.at(j) == "function") + (f.at(j + 1) == "*" if f.at(j) == "function" else 0)
            if f.at(j) == "(" and (f.at(f.match.get(j, j) + 1) in ("=>", ":") or f.at(i + 1) == "function" or f.at(j - 1) == "function"):
                definition = "function", i - 1, j
        if definition:
            kind, at, j = definition
            while f.at(j) == "<" and j < n:  # type parameters
                j += 1
                while j < n and f.kind[j] != "(":
                    j = f.match.get(j, j) + 1
            if f.at(j) == "(" and j in f.match:
                opening = f.body(j)
                if opening is None:
                    x = f.match[j] + 1
                    while x < n and f.kind[x] not in ("=>", ";", "{", "}"):
                        x = f.match.get(x, x) + 1
                    opening = x + 1 if f.at(x) == "=>" and f.at(x + 1) == "{" else None
                    arrow = f.at(x) == "=>"
                else:
                    arrow = False
                if opening is not None and opening in f.match or arrow:
                    end = f.match.get(opening, opening) if opening is not None else x + 1
                    count, untyped = f.parameters(j)
                    name = f"{prefix}{f.word(at)}"
                    branches = 1 + sum(f.kind[x] in _BRANCHES for x in range(j, min(end, n)))
                    yield doc_id, kind, f.word(at), name, f.line(at), f.line(end), count, untyped, branches, None
                    scopes.append((end, name + ".", "function"))
                    i = j + 1
                    continue
        if f.is_name(i) and f.at(i + 1) == "(" and before != "function" and inside != "interface":
            yield doc_id, "call", f.word(i), f"{prefix}{f.word(i)}", f.line(i), f.line(f.match.get(i + 1, i)), f.parameters(i + 1)[0], None, None, None
        i += 1


def script_facts(documents: DataFrame) -> DataFrame:
    """Definitions, imports and calls of every TypeScript and JavaScript file (.ts, .tsx, .js) with a text, one fact a row.

    An import counts as used if its name stands anywhere else but behind a dot or as a key. Null texts give no rows, a file
    that doesn't parse gives one `error` row besides what can be read of it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACT.split(", ")]
        for batch in batches:
            rows = [f for r in batch.to_pylist() for f in script_file_facts(r["doc_id"], r["text"], r["ending"])]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    ending = F.regexp_extract("file_path", r"\.(tsx?|js)$", 1)
    files = documents.where((ending != "") & F.col("text").isNotNull()).select("doc_id", "text", ending.alias("ending"))
    return files.mapInArrow(read, FACT)
