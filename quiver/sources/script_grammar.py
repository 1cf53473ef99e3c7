"""Lexer and local grammars of JavaScript and TypeScript, as far as it takes to tell whether a text parses.

A text becomes a list of token classes: punctuators and reserved words stand for themselves, names that are keywords
in some places keep their text, all other names, numbers, strings, templates and regular expressions are one class
each. Whether a statement parses depends on the classes alone, so each distinct balanced statement is parsed once and
its verdict is kept.
"""

from __future__ import annotations

import re

RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else export extends finally for function if
    import in instanceof new return super switch this throw try typeof var void while with null true false enum""".split()
)
CONTEXTUAL = frozenset(
    """async await of get set static let yield as from type interface namespace module declare abstract readonly public
    private protected implements is keyof infer unique asserts satisfies override accessor out global target meta
    constructor require using any unknown never string number boolean object symbol undefined bigint""".split()
)
#: White space and line ends beyond ASCII.
_BLANKS = "".join(map(chr, [0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_LINES = chr(0x2028) + chr(0x2029)
_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\v\f\xa0BLANKS]+|//[^\n\rLINES]*)+)
    |(?P<line>[\n\rLINES]\s*)
    |(?P<name>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<number>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?
       |\d+(?:_\d+)*n|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)
    |(?P<comment>/\*[\s\S]*?\*/)
    |(?P<private>\#[^\W\d][\w$]*)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""".replace("BLANKS", _BLANKS).replace("LINES", _LINES),
    re.X,
)
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JSX_SPACE = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*(?:(?::|\.)[\w$-]+)*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^{}<>]*")
#: A token after which a slash or an angle bracket starts an expression.
_BEFORE_OPERAND = frozenset(
    """( , = : [ ! & | ? { } ; + - * % ~ ^ < > => == === != !== <= >= && || ?? << >> >>> += -= *= /= %= **= <<= >>= >>>=
    &= |= ^= &&= ||= ??= ... ++ -- `{ }`{ return typeof case do else in instanceof new void delete throw await yield of
    extends default""".split()
) | {"**"}


class Broken(Exception):
    """The text doesn't parse."""


def _regex_sound(body: str) -> bool:
    """Whether groups and classes of a regular expression end, and nothing is repeated at its start or after a bar."""
    depth, i, fresh = 0, 0, True
    while i < len(body):
        c = body[i]
        if c == "\\":
            i, fresh = i + 2, False
            continue
        if c == "[":
            i += 1
            while body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            fresh = False
        elif c == "(":
            depth, fresh = depth + 1, True
            m = _GROUP.match(body, i)
            if not m:
                return False
            i = m.end()
            continue
        elif c == ")":
            depth, fresh = depth - 1, False
            if depth < 0:
                return False
        elif c == "|":
            fresh = True
        elif c in "*+?":
            if fresh:
                return False
        else:
            fresh = False
        i += 1
    return depth == 0


_GROUP = re.compile(r"\((?:\?(?::|=|!|<=|<!|<[^\W\d][\w$]*>|[ims]*(?:-[ims]+)?:))?(?!\?)")
_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:[0-9a-fA-F]{1,5}|10[0-9a-fA-F]{4})\}))")
_ODD_NUMBER = re.compile(r"0\d+n|0[0-7]+\.\d|0\d*_")


def read(text: str, ending: str, state: tuple, stack: list, e, until_brace: bool = False, pos: int = 0, marks: list | None = None) -> int:
    """Read a piece of a script into `e`: `found` are token classes; a class on a new line starts with a line feed.

    States are pairs: code, a block comment, or a template (`a` opened, `b` gone on with after a brace; with a line feed
    if it started a line), or code that doesn't start a line (`-`); and the last class, as far as it tells what a slash means. On the stack are open brackets,
    and ``$`` for a part of a template. With `until_brace` reading ends before the brace that closes what was open
    before. `marks` takes (class, start, end) of every token and comment. Returns the position reached; `e` tells what is
    wrong or can't be told without what follows.
    """
    mode, last = state
    jsx, out, n, match = ending == "tsx", e.found, len(text), _TOKEN.match
    new_line = pos == 0 and mode != "-"
    mode = "" if mode == "-" else mode
    if pos == 0 and text.startswith("#!"):
        pos = len(text.split("\n", 1)[0])

    def leave(reason: str = "", rest: int = n) -> int:
        e.bad, e.rest, e.opens = reason, text[rest:], stack
        e.state = (mode, last if last in ("}", ";") else ";" if last in _BEFORE_OPERAND else "i")
        return rest

    if mode == "/*":
        end = text.find("*/", pos)
        if end < 0:
            return leave()
        new_line, pos, mode = True, end + 2, ""
    elif mode:
        m = _TEMPLATE.match(text, pos)
        if not m:
            return leave()
        inner = m.group(1) == "${"
        last = ("`{" if inner else "``") if mode[1] == "a" else ("}`{" if inner else "}`")
        if inner:
            stack.append("$")
        out.append("\n" + last if mode.endswith("\n") else last)
        new_line, pos, mode = False, m.end(), ""
    while pos < n:
        c = text[pos]
        if c == "/" and last in _BEFORE_OPERAND and text[pos + 1 : pos + 2] not in ("/", "*"):
            m = _REGEX.match(text, pos)
            if m:
                body, flags = m.group(1), m.group(2)
                if not _regex_sound(body) or len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
                    if last not in ("}", "++", "--"):
                        return leave("regular expression that can't be read")
                else:
                    last = "/r/"
                    out.append("\n/r/" if new_line else last)
                    if marks is not None:
                        marks.append((last, pos, m.end()))
                    new_line, pos = False, m.end()
                    continue
            elif last not in ("}", "++", "--"):
                return leave("regular expression without end")
        elif c == "`" or (c == "}" and stack and stack[-1] == "$"):
            m = _TEMPLATE.match(text, pos + 1)
            if c == "}":
                stack.pop()
            if not m:
                mode = ("`a" if c == "`" else "`b") + ("\n" if new_line else "")
                return leave()
            inner = m.group(1) == "${"
            if c == "`":
                last = "`{" if inner else "``"
            else:
                last = "}`{" if inner else "}`"
            if inner:
                stack.append("$")
            out.append("\n" + last if new_line else last)
            if marks is not None:
                marks.append((last, pos, m.end()))
            new_line, pos = False, m.end()
            continue
        elif jsx and c == "<" and last in _BEFORE_OPERAND and re.match(r"<(?:>|[^\W\d][\w$.:-]*(?:\s|/?>))", text[pos : pos + 80]) and not re.match(r"<[^\W\d]\w*(?:\s*,|\s+extends\s)", text[pos : pos + 80]):
            try:
                end = _jsx_element(text, pos)
            except Broken:
                mode = "" if new_line else "-"
                return leave("", pos)  # it may go on in the next piece
            last = "J"
            if marks is not None:
                marks.append((last, pos, end))
            pos = end
            out.append("\nJ" if new_line else last)
            new_line = False
            continue
        elif c == "<" and ending == "js" and text.startswith("<!--", pos):
            end = text.find("\n", pos)  # scripts know this comment
            pos = n if end < 0 else end
            continue
        elif c == "/" and text.startswith("/*", pos) and text.find("*/", pos + 2) < 0:
            mode = "/*"
            return leave()
        m = match(text, pos)
        if m is None:
            return leave(f"stray character {c!r}")
        kind = m.lastgroup
        end = m.end()
        if kind == "space":
            if marks is not None and "/" in m.group():
                marks += [("comment", pos + x.start(), pos + x.end()) for x in _LINE_COMMENT.finditer(m.group())]
            pos = end
            continue
        if kind == "line":
            new_line, pos = True, end
            continue
        if kind == "comment":
            new_line = new_line or "\n" in m.group()
            if marks is not None:
                marks.append(("comment", pos, end))
            pos = end
            continue
        if kind == "name":
            word = m.group()
            last = word if word in RESERVED or word in CONTEXTUAL else "i"
        elif kind == "op":
            last = m.group()
            if last in "({[":
                stack.append(last)
            elif last in ")}]":
                if not stack:
                    if until_brace and last == "}":
                        return leave("", pos)
                    e.closes.append(last)
                elif _MATCHES.get(stack.pop()) != last:
                    return leave(f"{last} closes another bracket")
        elif kind == "number":
            last = "0"
            if text[end : end + 1].isidentifier() or text[end : end + 1] in ("$", "\\"):
                return leave("name right after a number")
            if c == "0" and _ODD_NUMBER.match(text, pos):
                return leave("number that can't be read")
        else:
            last = '"' if kind == "string" else "#"
            if kind == "string" and "\\" in m.group() and _ESCAPES.search(m.group().replace("\\\\", "")):
                return leave("escape that can't be read")
        out.append("\n" + last if new_line else last)
        if marks is not None:
            marks.append((last, pos, end))
        new_line, pos = False, end
    return leave()


_LINE_COMMENT = re.compile(r"//[^\n]*")
_MATCHES = {"(": ")", "{": "}", "[": "]"}


class _Found:
    """What `read` leaves of a text that is read as one."""

    __slots__ = ("state", "closes", "opens", "found", "bad", "rest")

    def __init__(self) -> None:
        self.closes, self.found = [], []


def tokens(text: str, ending: str) -> list[tuple[str, int, int]]:
    """(class, start, end) of all tokens and comments; what can't be read is passed over."""
    marks: list[tuple[str, int, int]] = []
    pos = 0
    while pos < len(text):
        e = _Found()
        at = read(text, ending, ("", ";") if pos == 0 else ("-", ";"), [], e, pos=pos, marks=marks)
        if not e.bad and not e.rest:
            break
        # after a character that doesn't fit, from the last place that was read
        pos = max(marks[-1][2] if marks else 0, pos, at if e.rest else 0) + 1
    return marks


def lex(text: str, ending: str, pos: int = 0, until_brace: bool = False) -> tuple[list[str], int]:
    """Token classes of `text` from `pos`, and the position reached."""
    e = _Found()
    at = read(text, ending, ("", ";"), [], e, until_brace, pos)
    if e.bad or e.closes or e.opens or e.state[0] or (e.rest and not until_brace) or (until_brace and not e.rest.startswith("}")):
        raise Broken(e.bad or "bracket, text or comment without its counterpart")
    return e.found, at


def _jsx_element(text: str, pos: int) -> int:
    """Position after the element that opens at `pos`; what stands in braces is parsed as an expression."""

    def skip(p: int) -> int:
        return _JSX_SPACE.match(text, p).end()

    def braces(p: int, spread: bool, empty: bool) -> int:
        tokens, end = lex(text, "tsx", p, until_brace=True)
        if not tokens:
            if not empty:
                raise Broken("empty braces in a tag")
        else:
            parser = Parser(tokens, True, True)
            if spread:
                parser.need("...")
            elif empty:
                parser.eat("...")
            parser.flags |= {"async", "own", "constructor"}
            parser.expression()
            parser.at_end()
        return end + 1

    p = skip(pos + 1)
    m = _JSX_NAME.match(text, p)
    name = m.group() if m else ""
    p = skip(m.end() if m else p)
    while name and text[p : p + 1] not in (">", "/"):
        if text[p : p + 1] == "{":
            p = skip(braces(p + 1, True, False))
            continue
        m = _JSX_NAME.match(text, p)
        if not m:
            raise Broken("attribute expected in a tag")
        p = skip(m.end())
        if text[p : p + 1] == "=":
            p = skip(p + 1)
            if text[p : p + 1] == "{":
                p = braces(p + 1, False, False)
            elif text[p : p + 1] == "<":
                p = _jsx_element(text, p)
            else:
                m = _JSX_STRING.match(text, p)
                if not m:
                    raise Broken("value expected in a tag")
                p = m.end()
            p = skip(p)
    if text[p : p + 1] == "/":
        p = skip(p + 1)
        if text[p : p + 1] != ">":
            raise Broken("tag without end")
        return p + 1
    if text[p : p + 1] != ">":
        raise Broken("tag without end")
    p += 1
    while True:
        p = _JSX_TEXT.match(text, p).end()
        c = text[p : p + 1]
        if c == "{":
            p = braces(p + 1, False, True)
        elif c == "<":
            q = skip(p + 1)
            if text[q : q + 1] == "/":
                q = skip(q + 1)
                m = _JSX_NAME.match(text, q)
                if (m.group() if m else "") != name:
                    raise Broken("closing tag of another element")
                q = skip(m.end() if m else q)
                if text[q : q + 1] != ">":
                    raise Broken("tag without end")
                return q + 1
            p = _jsx_element(text, p)
        else:
            raise Broken("element without end")


_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % ** << >> >>> < > <= >= == === != !== & | ^ && || ?? in instanceof".split())
_PREFIX = frozenset("+ - ! ~ typeof void delete".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare accessor async".split())
_NOT_NAME = RESERVED
_OPENING = {"(": ")", "[": "]", "{": "}"}
#: Verdicts on balanced statements, kept by a worker process and emptied beyond this number.
KEPT = 200_000
_VERDICTS: dict[tuple, bool] = {}


class Parser:
    """Recursive descent over token classes; each method parses one thing at the current place or raises Broken."""

    def __init__(self, tokens: list[str], types: bool, jsx: bool, flags: frozenset | set = frozenset()) -> None:
        self.raw = tokens
        self.k = [t[1:] if t[0] == "\n" else t for t in tokens]
        self.k.append("")
        self.n, self.p = len(tokens), 0
        self.types, self.jsx = types, jsx
        self.flags = set(flags)
        self.made = 0
        self.match: dict[int, int] = {}
        open_at: list[int] = []
        for i, t in enumerate(self.k):
            if t in ("(", "[", "{", "`{"):
                open_at.append(i)
            elif t in (")", "]", "}", "}`"):
                if open_at:
                    self.match[open_at.pop()] = i
            elif t == "}`{" and open_at:
                self.match[open_at.pop()] = i
                open_at.append(i)

    # -- basics

    def peek(self) -> str:
        return self.k[self.p]

    def next(self) -> str:
        t = self.k[self.p]
        if self.p >= self.n:
            raise Broken("unexpected end")
        self.p += 1
        return t

    def new_line(self) -> bool:
        return self.p >= self.n or self.raw[self.p][0] == "\n"

    def eat(self, t: str) -> bool:
        if self.k[self.p] == t:
            self.p += 1
            return True
        return False

    def need(self, t: str) -> None:
        if self.k[self.p] != t or self.p >= self.n:
            raise Broken(f"{t} expected, found {self.k[self.p]!r}")
        self.p += 1

    def at_end(self) -> None:
        if self.p < self.n:
            raise Broken(f"unexpected {self.k[self.p]}")

    def is_name(self, t: str) -> bool:
        return t == "i" or t in CONTEXTUAL

    def name(self) -> None:
        if not self.is_name(self.k[self.p]):
            raise Broken(f"name expected, found {self.k[self.p]!r}")
        self.p += 1

    def semicolon(self) -> None:
        if self.eat(";") or self.peek() == "}" or self.p >= self.n or self.new_line():
            return
        raise Broken(f"; expected, found {self.peek()}")

    def attempt(self, parse) -> bool:
        at, flags = self.p, set(self.flags)
        try:
            parse()
            return True
        except Broken:
            self.p, self.flags = at, flags
            return False

    # -- statements

    def program(self) -> None:
        self.statements(self.n, top=True)
        self.at_end()

    def statements(self, end: int, top: bool = False) -> None:
        """Statements up to token `end`, each balanced one by its kept verdict."""
        k, raw = self.k, self.raw
        while self.p < end:
            start = i = self.p
            stop = None
            while i < end:
                t = k[i]
                if t in _OPENING:
                    j = self.match.get(i)
                    if j is None:
                        raise Broken("bracket without its end")
                    if t == "{" and j + 1 <= end and (j + 1 == end or (raw[j + 1][0] == "\n" and (k[j + 1] in ("i", "}", "@", "#") or k[j + 1] in _STARTS))):
                        stop = j + 1
                        break
                    i = j + 1
                    continue
                if t == "`{" or t == "}`{":
                    i = self.match.get(i, i + 1)
                    continue
                i += 1
                if t == ";":
                    stop = i
                    break
            if stop is None or k[stop] == "else" or stop - start > 120 or not self.known(start, stop, top):
                self.p = start
                self.statement(top)
                if self.p > end:
                    raise Broken("statement goes over its block")
            else:
                self.p = stop

    def known(self, start: int, stop: int, top: bool) -> bool:
        """Whether the tokens are statements of their own; False also if the cut was at a wrong place."""
        key = (self.types, self.jsx, top, frozenset(self.flags), tuple(self.raw[start:stop]))
        verdict = _VERDICTS.get(key)
        if verdict is None:
            part = Parser([self.k[start], *self.raw[start + 1 : stop]], self.types, self.jsx, self.flags)
            try:
                while part.p < part.n:
                    part.statement(top)
                verdict = True
            except Broken:
                verdict = False
            if len(_VERDICTS) >= KEPT:
                _VERDICTS.clear()
            _VERDICTS[key] = verdict
        return verdict

    def block(self) -> None:
        end = self.match.get(self.p) if self.peek() == "{" else None
        if end is None:
            raise Broken("{ expected")
        self.p += 1
        self.statements(end)
        self.need("}")

    def function_body(self, is_async: bool, generator: bool, also: frozenset | set = frozenset({"own"})) -> None:
        """`also` tells what the body may name: `own` new.target, `constructor` a call of super."""
        kept = self.flags
        self.flags = {"function"} | ({"async"} if is_async else set()) | ({"generator"} if generator else set()) | also
        self.block()
        self.flags = kept

    def within(self, flag: set, parse) -> None:
        kept = self.flags
        self.flags = self.flags | flag
        parse()
        self.flags = kept

    def statement(self, top: bool = False) -> None:
        t = self.peek()
        simple = _STATEMENTS.get(t)
        if simple:
            return simple(self, top)
        if t == "i":
            if self.k[self.p + 1] == ":":
                self.p += 2
                return self.statement()
            return self.expression_statement()
        if t == "async" and self.k[self.p + 1] == "function" and self.raw[self.p + 1][0] != "\n":
            self.p += 1
            return self.function(True, True)
        if t == "let" and (self.is_name(self.k[self.p + 1]) or self.k[self.p + 1] in ("[", "{")):
            return self.variables(False)
        if self.types and self.type_statement(top):
            return None
        if self.is_name(t) and self.k[self.p + 1] == ":":
            self.p += 2
            return self.statement()
        return self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def variables(self, in_for: bool) -> None:
        constant = self.next() == "const"
        if self.types and constant and self.eat("enum"):
            return self.enum_rest()
        while True:
            pattern = self.peek() in ("[", "{")
            self.binding()
            if self.types:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment(no_in=in_for)
            elif (constant or pattern) and not (in_for and self.peek() in ("of", "in")) and "ambient" not in self.flags:
                raise Broken("declaration without a value")
            if not self.eat(","):
                break
        if not in_for:
            self.semicolon()

    def binding(self) -> None:
        t = self.peek()
        if t == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if self.peek() != "]":
                    self.need(",")
        elif t == "{":
            self.p += 1
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    plain = self.is_name(self.peek())
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not plain:
                        raise Broken("name expected in a pattern")
                    if self.eat("="):
                        self.assignment()
                if self.peek() != "}":
                    self.need(",")
        else:
            self.name()

    def property_name(self) -> None:
        t = self.next()
        if t == "[":
            self.assignment()
            self.need("]")
        elif not (t in ("i", '"', "0", "#") or t in CONTEXTUAL or t in RESERVED):
            raise Broken(f"property name expected, found {t}")

    def function(self, declaration: bool, is_async: bool) -> None:
        self.need("function")
        generator = self.eat("*")
        if self.is_name(self.peek()) and self.peek() != "":
            self.name()
        elif declaration == "named" or (declaration is True):
            raise Broken("function without a name")
        self.signature()
        if self.types and declaration and self.peek() != "{":
            return self.semicolon()
        self.function_body(is_async, generator)

    def signature(self) -> None:
        """Type parameters, parameters and return type."""
        if self.types and self.peek() == "<":
            self.type_parameters()
        self.parameters()
        if self.types and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.decorators()
            if self.types:
                while self.peek() in ("public", "private", "protected", "readonly", "override") and (
                    self.is_name(self.k[self.p + 1]) or self.k[self.p + 1] in ("[", "{")
                ):
                    self.p += 1
            rest = self.eat("...")
            if self.types and self.peek() == "this":
                self.p += 1
            else:
                self.binding()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            if self.peek() != ")":
                if rest:
                    raise Broken("parameter after a rest parameter")
                self.need(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.need(")")
            else:
                self.name()
                while self.eat("."):
                    self.member_name()
            if self.types and self.peek() == "<":
                self.attempt(self.type_arguments)
            if self.peek() == "(":
                self.arguments()

    def class_(self, declaration: bool | str) -> None:
        self.need("class")
        if self.is_name(self.peek()) and self.peek() != "implements":
            self.name()
        elif declaration is True:
            raise Broken("class without a name")
        if self.types and self.peek() == "<":
            self.type_parameters()
        if self.eat("extends"):
            self.unary_target()
            if self.types and self.peek() == "<":
                self.type_arguments()
        if self.types and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        kept, self.made = self.made, 0
        try:
            while not self.eat("}"):
                if self.p >= self.n:
                    raise Broken("class without end")
                if not self.eat(";"):
                    self.member()
        finally:
            self.made = kept

    def member(self) -> None:
        self.decorators()
        ambient, is_async, static = "ambient" in self.flags, False, False
        while True:
            t, after = self.peek(), self.k[self.p + 1]
            modifier = t in ("static", "async", "get", "set", "accessor") or (self.types and t in _MODIFIERS)
            if not modifier or after in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or after == "":
                break
            if t in ("get", "set") and self.raw[self.p + 1][0] == "\n":
                break
            if t == "static" and after == "{":
                self.p += 1
                return self.function_body(False, False)
            static, is_async = static or t == "static", is_async or t == "async"
            ambient = ambient or t in ("abstract", "declare")
            self.p += 1
            if t in ("get", "set") and self.peek() != "*":
                self.property_name()
                self.signature()
                return self.semicolon() if self.types and self.peek() != "{" else self.function_body(False, False)
        generator = self.eat("*")
        if self.types and self.peek() == "[" and self.is_name(self.k[self.p + 1]) and self.k[self.p + 2] == ":":
            self.index_signature()
            return self.semicolon()
        makes = self.peek() == "constructor" and not static
        self.property_name()
        if self.types:
            self.eat("?") or self.eat("!")
        if self.peek() in ("(", "<"):
            self.signature()
            if self.types and self.peek() != "{":
                return self.semicolon()
            if makes:
                self.made += 1
                if self.made > 1:
                    raise Broken("second constructor")
            return self.function_body(is_async, generator, {"own", "constructor"} if makes else {"own"})
        if generator or is_async:
            raise Broken("method expected")
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            kept, self.flags = self.flags, {"function", "own"}
            self.assignment()
            self.flags = kept
        self.semicolon()

    def inner(self) -> None:
        """A statement that stands alone after a condition: no declaration."""
        t = self.peek()
        if t in ("const", "class") or (t == "let" and (self.k[self.p + 1] == "[" or (self.is_name(self.k[self.p + 1]) and self.raw[self.p + 1][0] != "\n"))):
            raise Broken("declaration without a block")
        self.statement()

    def if_(self, top: bool) -> None:
        self.p += 1
        self.condition()
        self.inner()
        if self.eat("else"):
            self.inner()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self, top: bool) -> None:
        self.p += 1
        awaits = self.eat("await")
        self.need("(")
        t = self.peek()
        if t in ("var", "const") or (t == "let" and self.k[self.p + 1] not in ("in", "of", ";")):
            self.variables(True)
        elif t != ";":
            self.expression(no_in=True)
        if self.eat("of"):
            self.assignment()
        elif self.eat("in") and not awaits:
            self.expression()
        else:
            self.need(";")
            if self.peek() != ";":
                self.expression()
            self.need(";")
            if self.peek() != ")":
                self.expression()
        self.need(")")
        self.within({"loop"}, self.inner)

    def while_(self, top: bool) -> None:
        self.p += 1
        self.condition()
        self.within({"loop"}, self.inner)

    def do_(self, top: bool) -> None:
        self.p += 1
        self.within({"loop"}, self.inner)
        self.need("while")
        self.condition()
        self.eat(";")

    def switch_(self, top: bool) -> None:
        self.p += 1
        self.condition()
        end = self.match.get(self.p)
        self.need("{")

        def cases() -> None:
            default = False
            while self.p < end:
                if self.eat("case"):
                    self.expression()
                elif not default and self.eat("default"):
                    default = True
                else:
                    raise Broken("case expected")
                self.need(":")
                while self.p < end and self.peek() not in ("case", "default"):
                    self.statement()

        if end is None:
            raise Broken("switch without end")
        self.within({"switch"}, cases)
        self.need("}")

    def try_(self, top: bool) -> None:
        self.p += 1
        self.block()
        found = False
        if self.eat("catch"):
            found = True
            if self.eat("("):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            found = True
            self.block()
        if not found:
            raise Broken("try without catch or finally")

    def jump(self, top: bool) -> None:
        t = self.next()
        labelled = self.is_name(self.peek()) and not self.new_line()
        if labelled:
            self.name()
        elif "loop" not in self.flags and not (t == "break" and "switch" in self.flags):
            raise Broken(f"{t} out of place")
        self.semicolon()

    def return_(self, top: bool) -> None:
        if "function" not in self.flags:
            raise Broken("return outside a function")
        self.p += 1
        if self.peek() not in (";", "}", "") and not self.new_line():
            self.expression()
        self.semicolon()

    def throw_(self, top: bool) -> None:
        self.p += 1
        if self.new_line():
            raise Broken("nothing to throw")
        self.expression()
        self.semicolon()

    def import_(self, top: bool) -> None:
        if self.k[self.p + 1] in ("(", "."):
            return self.expression_statement()
        if not top:
            raise Broken("import out of place")
        self.p += 1
        if self.eat('"'):
            return self.import_end()
        if self.types and self.peek() == "type" and (self.k[self.p + 1] in ("{", "*") or (self.is_name(self.k[self.p + 1]) and self.k[self.p + 1] != "from") or self.k[self.p + 2] == "from"):
            self.p += 1
        if self.is_name(self.peek()):
            self.name()
            if self.types and self.eat("="):
                self.expression()
                return self.semicolon()
            if not self.eat(","):
                return self.import_from()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.import_from()

    def import_from(self) -> None:
        self.need("from")
        self.need('"')
        self.import_end()

    def import_end(self) -> None:
        if self.peek() in ("with", "i") and self.k[self.p + 1] == "{" and not self.new_line():
            self.p += 1
            self.primary()
        self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.types and self.peek() == "type" and self.k[self.p + 1] not in (",", "}", "as"):
                self.p += 1
            self.module_name()
            if self.eat("as"):
                self.module_name()
            if self.peek() != "}":
                self.need(",")

    def module_name(self) -> None:
        t = self.next()
        if not (t in ("i", '"') or t in CONTEXTUAL or t in RESERVED):
            raise Broken("name expected")

    def export_(self, top: bool) -> None:
        if not top:
            raise Broken("export out of place")
        self.p += 1
        self.decorators()
        t = self.peek()
        if t == "default":
            self.p += 1
            self.decorators()
            t = self.peek()
            if t == "function" or (t == "async" and self.k[self.p + 1] == "function"):
                is_async = self.eat("async")
                return self.function("default", is_async)
            if t == "class":
                return self.class_("default")
            if self.types and t == "abstract" and self.k[self.p + 1] == "class":
                self.p += 1
                return self.class_("default")
            if self.types and t == "interface":
                return self.interface()
            self.assignment()
            return self.semicolon()
        if t == "*":
            self.p += 1
            if self.eat("as"):
                self.module_name()
            return self.import_from()
        if self.types and t == "type" and self.k[self.p + 1] in ("{", "*"):
            self.p += 1
            if self.eat("*"):
                if self.eat("as"):
                    self.module_name()
                return self.import_from()
            t = "{"
        if t == "{":
            self.specifiers()
            return self.import_from() if self.peek() == "from" else self.semicolon()
        if self.types and self.eat("="):
            self.expression()
            return self.semicolon()
        if self.types and t == "as" and self.k[self.p + 1] == "namespace":
            self.p += 2
            self.name()
            return self.semicolon()
        if t in ("var", "const", "let"):
            return self.variables(False)
        if t == "function":
            return self.function(True, False)
        if t == "async" and self.k[self.p + 1] == "function":
            self.p += 1
            return self.function(True, True)
        if t == "class":
            return self.class_(True)
        if self.types and t == "import":
            return self.import_(True)
        if self.types and self.type_statement(top):
            return None
        raise Broken(f"unexpected {t} after export")

    def decorated(self, top: bool) -> None:
        self.decorators()
        if self.peek() == "export":
            return self.export_(top)
        if self.types and self.peek() == "abstract":
            self.p += 1
        self.class_(True)

    # -- statements of types

    def type_statement(self, top: bool) -> bool:
        t, after = self.peek(), self.k[self.p + 1]
        near = self.p + 1 < self.n and self.raw[self.p + 1][0] != "\n"
        if t == "type" and self.is_name(after) and near:
            self.p += 2
            if self.peek() == "<":
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif t == "interface" and self.is_name(after) and near:
            self.interface()
        elif t == "enum":
            self.enum_rest(self.next())
        elif t == "abstract" and after == "class":
            self.p += 1
            kept, self.flags = self.flags, self.flags
            self.class_(True)
            self.flags = kept
        elif t == "declare" and near and (after in RESERVED or after in CONTEXTUAL):
            self.p += 1
            if self.eat("global"):
                self.within({"ambient"}, self.module_block)
            else:
                self.within({"ambient"}, lambda: self.statement(True))
        elif t in ("namespace", "module") and near and (self.is_name(after) or after == '"'):
            self.p += 1
            if not self.eat('"'):
                self.name()
                while self.eat("."):
                    self.name()
            if self.peek() == "{":
                self.module_block()
            else:
                self.semicolon()
        else:
            return False
        return True

    def module_block(self) -> None:
        end = self.match.get(self.p)
        self.need("{")
        if end is None:
            raise Broken("block without end")
        self.statements(end, top=True)
        self.need("}")

    def interface(self) -> None:
        self.p += 1
        self.name()
        if self.peek() == "<":
            self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.type_members()

    def enum_rest(self, _: str = "") -> None:
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if self.peek() != "}":
                self.need(",")

    # -- types

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.peek() in ("const", "in", "out") and self.k[self.p + 1] not in (",", ">", "extends", "="):
                self.p += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.peek() == ">":
                break
        self.close_angle()

    def close_angle(self) -> None:
        t = self.peek()
        if not t.startswith(">"):
            raise Broken("> expected")
        if t == ">":
            self.p += 1
        else:  # a part of >> or >=
            self.k[self.p] = t[1:]

    def type_arguments(self) -> None:
        if self.peek() == "<<":
            self.k[self.p] = "<"
        else:
            self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def return_type(self) -> None:
        if self.peek() == "asserts" and (self.is_name(self.k[self.p + 1]) or self.k[self.p + 1] == "this") and self.raw[self.p + 1][0] != "\n":
            self.p += 2
            if self.eat("is"):
                self.type()
            return
        if (self.is_name(self.peek()) or self.peek() == "this") and self.k[self.p + 1] == "is":
            self.p += 2
        self.type()

    def type(self) -> None:
        if self.peek() == "new" or (self.peek() == "abstract" and self.k[self.p + 1] == "new"):
            self.eat("abstract")
            self.p += 1
            return self.function_type()
        if self.peek() == "<":
            return self.function_type()
        if self.peek() == "(":
            end = self.match.get(self.p)
            if end is not None and self.k[end + 1] == "=>":
                return self.function_type()
        self.union()
        if self.peek() == "extends" and not self.new_line() and "no_conditional" not in self.flags:
            self.p += 1
            self.within({"no_conditional"}, self.type)
            self.need("?")
            kept, self.flags = self.flags, self.flags - {"no_conditional"}
            self.type()
            self.need(":")
            self.type()
            self.flags = kept

    def function_type(self) -> None:
        if self.peek() == "<":
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        self.type_operator()
        while self.eat("|") or self.eat("&"):
            if self.peek() in ("(", "new", "<"):
                self.attempt(self.function_type) or self.type_operator()
            else:
                self.type_operator()

    def type_operator(self) -> None:
        if self.peek() in ("keyof", "unique", "readonly", "infer") and self.k[self.p + 1] not in (",", ")", ">", ";", "|", "&", "=", "}", "]", "[", "."):
            infer = self.next() == "infer"
            self.type_operator()
            if infer and self.peek() == "extends":
                self.attempt(lambda: (self.next(), self.union(), self.peek() == "?" and self.need("")))
            return
        self.array_type()

    def array_type(self) -> None:
        self.primary_type()
        while not self.new_line() and self.peek() == "[":
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def primary_type(self) -> None:
        t = self.next()
        if t == "(":
            kept, self.flags = self.flags, self.flags - {"no_conditional"}
            self.type()
            self.flags = kept
            self.need(")")
        elif t == "[":
            while not self.eat("]"):
                self.eat("...")
                if self.is_name(self.peek()) and (self.k[self.p + 1] == ":" or (self.k[self.p + 1] == "?" and self.k[self.p + 2] == ":")):
                    self.p += 1
                    self.eat("?")
                    self.p += 1
                self.type()
                self.eat("?")
                if self.peek() != "]":
                    self.need(",")
        elif t == "{":
            self.p -= 1
            self.attempt(self.mapped_type) or self.type_members()
        elif t in ('"', "0", "true", "false", "null", "void", "this", "``"):
            pass
        elif t == "-":
            self.need("0")
        elif t == "`{":
            self.type()
            while self.eat("}`{"):
                self.type()
            self.need("}`")
        elif t == "typeof":
            if self.eat("import"):
                self.p -= 1
                return self.primary_type()
            self.module_or_this()
            self.dotted()
        elif t == "import":
            self.need("(")
            self.need('"')
            self.need(")")
            self.dotted()
        elif self.is_name(t):
            self.dotted()
        else:
            raise Broken(f"type expected, found {t}")

    def module_or_this(self) -> None:
        if not self.eat("this"):
            self.name()

    def dotted(self) -> None:
        while self.eat("."):
            self.member_name()
        if self.peek() in ("<", "<<") and not self.new_line():
            self.type_arguments()

    def mapped_type(self) -> None:
        self.need("{")
        self.eat("+") or self.eat("-")
        self.eat("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        self.eat("+") or self.eat("-")
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.need("}")

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.eat("?")
        if self.eat(":"):
            self.type()

    def type_members(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.p >= self.n:
                raise Broken("type without end")
            if self.peek() in ("(", "<"):
                self.signature()
            elif self.peek() == "new" and self.k[self.p + 1] in ("(", "<"):
                self.p += 1
                self.signature()
            else:
                while self.peek() in ("readonly", "get", "set") and self.k[self.p + 1] not in (":", "?", "(", ";", ",", "}", "<"):
                    self.p += 1
                if self.peek() == "[" and self.is_name(self.k[self.p + 1]) and self.k[self.p + 2] == ":":
                    self.index_signature()
                else:
                    self.property_name()
                    self.eat("?")
                    if self.peek() in ("(", "<"):
                        self.signature()
                    elif self.eat(":"):
                        self.type()
            if not (self.eat(";") or self.eat(",") or self.peek() == "}" or self.new_line()):
                raise Broken("; expected in a type")

    # -- expressions

    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.eat(","):
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        t = self.peek()
        if t == "yield" and "generator" in self.flags:
            self.p += 1
            star = not self.new_line() and self.eat("*")
            if star or (not self.new_line() and self.peek() not in (")", "]", "}", ",", ";", ":", "")):
                self.assignment(no_in)
            return
        if self.arrow(no_in):
            return
        kind = self.conditional(no_in)
        t = self.peek()
        if t == "=":
            if not kind:
                raise Broken("this can't be assigned to")
            self.p += 1
            self.assignment(no_in)
        elif t in _ASSIGN:
            if kind != 1:
                raise Broken("this can't be assigned to")
            self.p += 1
            self.assignment(no_in)

    def arrow(self, no_in: bool) -> bool:
        """An arrow function, if one starts here."""
        p, k = self.p, self.k
        is_async = k[p] == "async" and self.raw[p + 1 : p + 2] != [] and self.raw[p + 1][0] != "\n" and (self.is_name(k[p + 1]) or k[p + 1] in ("(", "<"))
        at = p + 1 if is_async else p
        if self.is_name(k[at]) and k[at + 1] == "=>":
            self.p = at + 1
        elif k[at] == "(":
            end = self.match.get(at)
            if end is None:
                raise Broken("( without its end")
            after = k[end + 1]
            if after == "=>":
                self.p = at
                self.parameters()
            elif after == ":" and self.types:
                def typed() -> None:
                    self.p = at
                    self.signature()
                    if self.peek() != "=>":
                        raise Broken("no arrow")
                if not self.attempt(typed):
                    return False
            else:
                return False
        elif k[at] == "<" and self.types:
            def generic() -> None:
                self.p = at
                self.signature()
                if self.peek() != "=>":
                    raise Broken("no arrow")
            if not self.attempt(generic):
                return False
        else:
            return False
        if self.new_line():
            raise Broken("arrow on a new line")
        self.need("=>")
        outer = self.flags & {"own", "constructor"}
        if self.peek() == "{":
            self.function_body(is_async, False, outer)
        else:
            kept = self.flags
            self.flags = {"function"} | ({"async"} if is_async else set()) | outer
            self.assignment(no_in)
            self.flags = kept
        return True

    def conditional(self, no_in: bool) -> int:
        kind = self.binary(no_in)
        if self.eat("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)
            return 0
        return kind

    def binary(self, no_in: bool) -> int:
        """1: a name or member, 2: a literal that may be a pattern, 0: anything else."""
        kind = self.unary()
        mixed = None
        while True:
            t = self.peek()
            if t in _BINARY and not (no_in and t == "in"):
                if t in ("&&", "||", "??"):
                    group = "??" if t == "??" else "&|"
                    if mixed and mixed != group:
                        raise Broken("?? mixed with || or &&")
                    mixed = group
                self.p += 1
                if self.peek() == "#" and self.k[self.p + 1] == "in":
                    self.p += 1
                else:
                    self.unary()
                kind = 0
            elif self.types and t in ("as", "satisfies") and not self.new_line():
                self.p += 1
                if not self.eat("const"):
                    self.type()
            else:
                return kind

    def unary(self) -> int:
        t = self.peek()
        if t in _PREFIX:
            self.p += 1
            self.unary()
            if self.peek() == "**":
                raise Broken("** after a unary operator")
            return 0
        if t in ("++", "--"):
            self.p += 1
            if self.unary() != 1:
                raise Broken("this can't be counted")
            return 0
        if t == "await" and ("async" in self.flags or "function" not in self.flags):
            if self.k[self.p + 1] not in (")", "]", "}", ",", ";", ":", "", "=", ".", "=>"):
                self.p += 1
                self.unary()
                return 0
        if t == "<" and self.types and not self.jsx:
            self.type_arguments()
            self.unary()
            return 0
        kind = self.unary_target()
        if self.peek() in ("++", "--") and not self.new_line():
            if kind != 1:
                raise Broken("this can't be counted")
            self.p += 1
            return 0
        return kind

    def unary_target(self) -> int:
        if self.peek() == "new":
            self.new_()
            kind = 0
        else:
            kind = self.primary()
        return self.suffixes(kind, True)

    def new_(self) -> None:
        self.need("new")
        if self.eat("."):
            self.need("target")
            if "own" not in self.flags:
                raise Broken("new.target outside a function")
            return
        if self.peek() == "new":
            self.new_()
        else:
            self.primary()
        self.suffixes(0, False)
        if self.types and self.peek() == "<":
            self.attempt(self.type_arguments)
        if self.peek() == "(":
            self.arguments()

    def suffixes(self, kind: int, calls: bool) -> int:
        optional = False
        while True:
            t = self.peek()
            if t == ".":
                self.p += 1
                self.member_name()
                kind = 0 if optional else 1
            elif t == "?.":
                if not calls:
                    raise Broken("?. after new")
                self.p += 1
                optional, kind = True, 0
                if self.peek() == "(":
                    self.arguments()
                elif self.peek() == "[":
                    self.p += 1
                    self.expression()
                    self.need("]")
                else:
                    self.member_name()
            elif t == "[":
                self.p += 1
                self.expression()
                self.need("]")
                kind = 0 if optional else 1
            elif t == "(" and calls:
                self.arguments()
                kind = 0
            elif t in ("``", "`{"):
                self.primary()
                kind = 0
            elif t == "!" and self.types and not self.new_line():
                self.p += 1
            elif t in ("<", "<<") and self.types and calls:
                def call() -> None:
                    self.type_arguments()
                    if self.peek() not in ("(", "``", "`{"):
                        raise Broken("no call")
                kept = self.k[self.p]
                if not self.attempt(call):
                    self.k[self.p] = kept
                    return kind
            else:
                return kind

    def member_name(self) -> None:
        t = self.next()
        if not (t in ("i", "#") or t in CONTEXTUAL or t in RESERVED):
            raise Broken(f"member name expected, found {t}")

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.peek() != ")":
                self.need(",")

    def primary(self) -> int:
        t = self.next()
        if t == "i":
            return 1
        if t in ('"', "0", "/r/", "``", "J", "null", "true", "false"):
            return 0
        if t == "this":
            return 0
        if t == "(":
            kind = 0
            self.assignment_kind = 0
            start = self.p
            self.expression()
            if self.p - start == 1 and self.is_name(self.k[start]):
                kind = 1
            elif self.k[start] not in ("[", "{") and self.k[self.p - 1] in ("]",) or self.k[self.p - 2] == ".":
                kind = 1
            self.need(")")
            return kind
        if t == "[":
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.peek() != "]":
                    self.need(",")
            return 2
        if t == "{":
            self.object_rest()
            return 2
        if t == "`{":
            self.expression()
            while self.eat("}`{"):
                self.expression()
            self.need("}`")
            return 0
        if t == "function":
            self.p -= 1
            self.function(False, False)
            return 0
        if t == "async" and self.peek() == "function" and not self.new_line():
            self.function(False, True)
            return 0
        if t == "class" or t == "@":
            self.p -= 1
            self.decorators()
            self.class_(False)
            return 0
        if t == "super":
            if self.peek() not in ("(", ".", "[") or (self.peek() == "(" and "constructor" not in self.flags):
                raise Broken("super out of place")
            return 0
        if t == "import":
            if self.eat("."):
                self.need("meta")
            elif self.peek() != "(":
                raise Broken("import out of place")
            return 0
        if t == "#" and self.peek() == "in":
            return 0
        if t in CONTEXTUAL:
            return 1
        raise Broken(f"expression expected, found {t}")

    def object_rest(self) -> None:
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                is_async = False
                t, after = self.peek(), self.k[self.p + 1]
                if t in ("get", "set") and after not in (",", "}", ":", "(", "=", "<"):
                    self.p += 1
                    self.property_name()
                    self.signature()
                    self.function_body(False, False)
                else:
                    if t == "async" and after not in (",", "}", ":", "(", "=", "<"):
                        self.p += 1
                        is_async = True
                    generator = self.eat("*")
                    plain = self.is_name(self.peek())
                    self.property_name()
                    if self.peek() in ("(", "<"):
                        self.signature()
                        self.function_body(is_async, generator)
                    elif is_async or generator:
                        raise Broken("method expected")
                    elif self.eat(":"):
                        self.assignment()
                    elif plain:
                        if self.eat("="):  # only in patterns
                            self.assignment()
                    else:
                        raise Broken("value expected in an object")
            if self.peek() != "}":
                self.need(",")


def _empty(parser: Parser, top: bool) -> None:
    parser.p += 1


def _debugger(parser: Parser, top: bool) -> None:
    parser.p += 1
    parser.semicolon()


_STATEMENTS = {
    ";": _empty,
    "{": lambda p, top: p.block(),
    "var": lambda p, top: p.variables(False),
    "const": lambda p, top: p.variables(False),
    "function": lambda p, top: p.function(True, False),
    "class": lambda p, top: p.class_(True),
    "@": Parser.decorated,
    "if": Parser.if_,
    "for": Parser.for_,
    "while": Parser.while_,
    "do": Parser.do_,
    "switch": Parser.switch_,
    "try": Parser.try_,
    "break": Parser.jump,
    "continue": Parser.jump,
    "return": Parser.return_,
    "throw": Parser.throw_,
    "import": Parser.import_,
    "export": Parser.export_,
    "debugger": _debugger,
}
#: Classes that start a statement and never continue one.
_STARTS = frozenset(_STATEMENTS) - {"while", ";", "{"} | {"let", "async", "type", "interface", "declare", "abstract", "namespace", "enum"}


def parse(tokens: list[str], ending: str, whole: bool = False) -> str:
    """Why token classes that balance don't parse in the language of the file ending (js, ts or tsx), or ''.

    Balanced statements are judged by the local grammars, each distinct one once. With `whole` no kept verdict is used.
    Nesting beyond what can be followed raises RecursionError.
    """
    parser = Parser(tokens, ending in ("ts", "tsx"), ending == "tsx")
    if whole:
        parser.known = lambda *_: False
    try:
        parser.program()
    except Broken as e:
        return str(e)
    return ""


def check(text: str, ending: str, whole: bool = False) -> str | None:
    """Why a text, read as one piece, doesn't parse, or None if it does."""
    try:
        tokens, _ = lex(text, ending)
    except Broken as e:
        return str(e)
    return parse(tokens, ending, whole) or None
