"""Maps of pieces of source text: from the state a lexer may be in at a piece's start to what the piece makes of it.

An `Entry` of a map holds the state at the end, the brackets that close something opened before, those left open, and
what the local grammars need (token classes of scripts, starts of lines outside everything for Python). A map holds an
entry for every state at the start of a line; pieces compose associatively, so they are reduced in any grouping. What
a closing brace means can depend on what it closes (a template or a field of a formatted string goes on after it).
Maps assume that it closes a brace; where composing shows that it doesn't, the later piece is read again from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quiver.sources import script_grammar

_CLOSES = {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Entry:
    """What a text makes of a start state. `bad` is the reason why no parse is possible, `rest` a last part that can only
    be read together with what follows."""

    state: tuple = ("",)
    closes: list = field(default_factory=list)
    opens: list = field(default_factory=list)
    found: list = field(default_factory=list)
    bad: str = ""
    rest: str = ""
    size: int = 0


# -- Python

_QUOTE = r"""(?:(?<!\w)(?P<prefix>[rRbBuUfF]{1,2}))?(?P<quote>\"{3}|'{3}|"|')"""
_PY_CODE = re.compile(r"\#[^\n]*|" + _QUOTE + r"|(?P<bracket>[()\[\]{}])|(?P<line>\n)")
_PY_FIELD = re.compile(r"\#[^\n]*|" + _QUOTE + r"|(?P<bracket>[()\[\]{}])|(?P<line>\n)|(?P<colon>:)")
_PY_END = {
    '"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*+"'),
    "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*+'"),
    '"""': re.compile(r'(?:[^\\"]|\\[\s\S]|"(?!""))*+"""'),
    "'''": re.compile(r"(?:[^\\']|\\[\s\S]|'(?!''))*+'''"),
}


def _formatted(quote: str, raw: bool) -> re.Pattern:
    """Text of a formatted string up to its end, a field or a stray brace."""
    q = quote[0]
    plain = rf"[^\\{{}}{q}\n]" if len(quote) == 1 else rf"[^\\{{}}{q}]|{q}(?!{q}{q})"
    name = "" if raw else r"\\N\{[^}\n]*\}|"
    return re.compile(rf"(?:{plain}|{name}\\(?:[^{{}}]|(?=[{{}}]))|\{{\{{|\}}\}})*+(?P<end>{re.escape(quote)}|\{{|\}})")


def _specification(quote: str) -> re.Pattern:
    """Format of a field up to its end or a field in it."""
    line = r"\n" if len(quote) == 1 else ""
    return re.compile(rf"[^{{}}{quote[0]}{line}]*+(?P<end>\{{|\}})" if len(quote) == 1 else rf"(?:[^{{}}{quote[0]}]|{quote[0]}(?!{quote[0] * 2}))*+(?P<end>\{{|\}})")


_TEXT = {(q, raw): _formatted(q, raw) for q in _PY_END for raw in (False, True)}
_SPEC = {(q, raw): _specification(q) for q in _PY_END for raw in (False, True)}


def _python(text: str, state: tuple, stack: list, e: Entry, marks: list | None = None) -> None:
    """Read a piece of Python; `marks` takes (kind, start, end) of strings and comments outside of strings. States: code, ``long q``, and ``text q raw`` and ``spec q raw`` of formatted strings.
    Open fields are on the stack as tuples of the state to go on with."""
    pos, began, outside = 0, 0, len(stack)
    while True:
        if marks is not None and state == ("",) and began >= 0 and not any(isinstance(x, tuple) for x in stack[outside:]):
            if began < pos:
                marks.append(("string", began, pos))
            began = -1
        if state[0] == "long":
            m = _PY_END[state[1]].match(text, pos)
            if not m:
                break
            state, pos = ("",), m.end()
            continue
        if state[0] in ("text", "spec"):
            m = (_TEXT if state[0] == "text" else _SPEC)[state[1:]].match(text, pos)
            if not m:
                if len(state[1]) == 1:
                    e.bad = "string without end"
                break
            pos, end = m.end(), m["end"]
            if end == "{":
                stack.append(state)
                state = ("",)
            elif end == "}":
                if state[0] == "text":
                    e.bad = "single brace in a formatted string"
                    break
                if not stack or not isinstance(stack[-1], tuple):
                    e.bad = "field without its start"
                    break
                state = stack.pop()
            else:
                state = ("",)
            continue
        inside = bool(stack) and isinstance(stack[-1], tuple)
        m = (_PY_FIELD if inside else _PY_CODE).search(text, pos)
        if not m:
            break
        pos = m.end()
        kind = m.lastgroup
        if marks is not None and began < 0:
            if kind is None:
                marks.append(("comment", m.start(), pos))
            elif kind == "quote":
                began = m.start()
        if kind == "line":
            if not stack and text[m.start() - 1 : m.start()] != "\\":
                e.found.append((pos, len(e.closes)))
        elif kind == "colon":
            # the frame below says where the field's end leads to
            state = ("spec", *stack[-1][1:])
        elif kind == "quote":
            quote, prefix = m["quote"], (m["prefix"] or "").lower()
            if "f" in prefix:
                state = ("text", quote, "r" in prefix)
            elif len(quote) == 3:
                state = ("long", quote)
            else:
                m = _PY_END[quote].match(text, pos)
                if not m:
                    e.bad = "string without end"
                    break
                pos = m.end()
        elif kind == "bracket":
            b = m["bracket"]
            if b not in _CLOSES:
                stack.append(b)
            elif not stack:
                e.closes.append(b)
            elif b == "}" and inside:
                state = stack.pop()
            elif stack[-1] == _CLOSES[b]:
                stack.pop()
            else:
                e.bad = f"{b} closes another bracket"
                break
    e.state, e.opens = state, stack


def python_marks(text: str) -> list[tuple[str, int, int]]:
    """(``string`` or ``comment``, start, end) of a Python text; formatted strings with what is in their fields."""
    marks: list[tuple[str, int, int]] = []
    e = Entry()
    _python(text, ("",), [], e, marks)
    return marks


# -- all

#: The states at a line's start that a map is worked out for; others (in a formatted string, say) when they are met.
STATES: dict[str, tuple[tuple, ...]] = {
    "py": (("",), ("long", '"""'), ("long", "'''")),
    "js": (("", ";"), ("", "i"), ("", "}"), ("/*", ";"), ("`a", "i")),
}
STATES["ts"] = STATES["tsx"] = STATES["js"]


def start(ending: str) -> tuple:
    """The state before a file's first character."""
    return ("",) if ending == "py" else ("", ";")


def read(text: str, ending: str, state: tuple, stack: list | None = None) -> Entry:
    """The entry of a text for one start state, with what is known to be open before it."""
    e = Entry(size=len(text))
    stack = list(stack or [])
    if ending == "py":
        _python(text, state, stack, e)
    else:
        script_grammar.read(text, ending, state, stack, e)
    return e


class Piece:
    """A piece of text with its map."""

    def __init__(self, text: str, ending: str, states: tuple[tuple, ...] | None = None) -> None:
        self.text, self.ending = text, ending
        self.entries = {s: read(text, ending, s) for s in (STATES[ending] if states is None else states)}

    def entry(self, state: tuple) -> Entry:
        if state not in self.entries:
            self.entries[state] = read(self.text, self.ending, state)
        return self.entries[state]

    def after(self, first: "Piece") -> "Piece":
        """The piece that `first` and this one make up."""
        out = Piece(first.text + self.text, self.ending, ())
        out.entries = {s: join(e, self) for s, e in first.entries.items()}
        return out


def join(e: Entry, piece: Piece) -> Entry:
    """The entry of what `e` is of, with a piece after it."""
    if e.bad:
        return Entry(e.state, e.closes, e.opens, e.found, e.bad, "", e.size + len(piece.text))
    stack, closes = list(e.opens), list(e.closes)
    later = None
    if not e.rest and not (stack and isinstance(stack[-1], tuple)):
        later = piece.entry(e.state)
        for b in later.closes:
            if not stack:
                closes.append(b)
                continue
            if stack[-1] != _CLOSES[b]:
                if stack[-1] in ("(", "[", "{"):
                    return Entry(later.state, closes, stack, [], f"{b} closes another bracket", "", e.size + len(piece.text))
                later = None  # it closes a field or a template
                break
            stack.pop()
            if stack and isinstance(stack[-1], tuple):
                later = None
                break
    if later is None:
        later = read(e.rest + piece.text, piece.ending, e.state, e.opens)
        found = e.found + _shift(later.found, piece.ending, e.size - len(e.rest), 0, len(e.closes))
        return Entry(later.state, e.closes + later.closes, later.opens, found, later.bad, later.rest, e.size + len(piece.text))
    found = e.found + _shift(later.found, piece.ending, e.size, len(e.opens), len(e.closes))
    return Entry(later.state, closes, stack + later.opens, found, later.bad, later.rest, e.size + len(piece.text))


def _shift(found: list, ending: str, by: int, opens: int, closed: int) -> list:
    """Places found in a later piece as places in the whole: of lines only those outside of the `opens` brackets before."""
    if ending != "py":
        return found
    return [(at + by, closed + n - opens) for at, n in found if n >= opens]


def verdict(e: Entry) -> str:
    """Why a whole file with this entry can't parse, as far as its brackets, strings and comments tell; '' if they balance."""
    if e.bad:
        return e.bad
    if e.closes:
        return f"{e.closes[0]} without its opening"
    if e.opens:
        return "bracket without its end"
    if e.rest or e.state[0] != "":
        return "text, comment or element without end"
    return ""
