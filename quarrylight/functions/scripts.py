"""Endpoints in scripts: one pass over the tokens, with a stack of open brackets that knows what each one belongs to.

Constants are put together: strings and templates without holes joined by ``+``, and names that ``const`` gave one. What stands
around a constant says by which rule it was found: as it is, as a template, joined, as the value of a key that holds
addresses, or as the first argument of a call that takes one. This is no parser: broken scripts give what can be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

from quarrylight.functions.arrow import arrow_function

# Keys whose values are addresses, and calls whose first argument is one.
URL_KEYS = frozenset(("path", "url", "route", "endpoint", "to", "href", "action", "src"))
URL_CALLS = frozenset(("fetch", "ajax", "get", "post", "put", "delete", "patch", "head", "options", "request", "send", "sendrequest", "navigate", "push", "replace", "redirect", "go", "open"))
# Fixed value: what an address looks like; {var} is a hole of a template.
SHAPE = re.compile(r"(?:/|\{var\})[A-Za-z0-9_\-./?#=&%~+:{},*]*|https?://[A-Za-z0-9._\-:]\S*|wss?://[A-Za-z0-9._\-:]\S*")
LENGTHS = (4, 1024)
#: Templates within templates are followed this far.
DEPTH = 8

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<tick>`)|(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\+\+|\+=|\?\.|\.\.\.|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ =>".split()) | {"return", "typeof", "case", "in", "of", "delete", "void", "else", "do"}
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


class Token(NamedTuple):
    kind: str  # string, template, name, number, sign
    text: str  # of strings and templates the value
    whole: bool = True  # a template has no holes


def _unescaped(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else ""
        return _SINGLE.get(m[4], m[4])

    return _ESCAPE.sub(one, text)


def _template(source: str, at: int) -> tuple[str, list[str], int]:
    """The template that begins behind ``at``: its text with ``{var}`` for holes, what is in the holes, and where it ends."""
    out, holes, i, n = [], [], at, len(source)
    begin = at
    while i < n and source[i] != "`":
        if source[i] == "\\":
            i += 2
        elif source.startswith("${", i):
            out.append(_unescaped(source[begin:i]) + "{var}")
            start, depth, i = i + 2, 1, i + 2
            while i < n and depth:
                c = source[i]
                if c in "\"'":
                    m = _TOKEN.match(source, i)
                    i = m.end()
                    continue
                if c == "`":  # a template within: to its end, holes and all
                    i, stack = i + 1, ["`"]
                    while i < n and stack:
                        c = source[i]
                        if c == "\\":
                            i += 1
                        elif stack[-1] == "`":
                            if c == "`":
                                stack.pop()
                            elif source.startswith("${", i):
                                stack.append("}")
                                i += 1
                        elif c == "}":
                            stack.pop()
                        elif c == "{":
                            stack.append("}")
                        elif c == "`":
                            stack.append("`")
                        i += 1
                    continue
                depth += {"{": 1, "}": -1}.get(c, 0)
                i += 1
            holes.append(source[start : i - 1])
            begin = i
        else:
            i += 1
    out.append(_unescaped(source[begin:i]))
    return "".join(out), holes, min(i + 1, n)


def tokens(source: str, holes: list[str]) -> Iterator[Token]:
    """Tokens without white space and comments; what stands in the holes of templates goes to ``holes``."""
    at, last = 0, ";"
    while at < len(source):
        if source[at] == "/" and last in _BEFORE_REGEX and not source.startswith(("//", "/*"), at) and (m := _REGEX.match(source, at)):
            at, last = m.end(), "0"
            yield Token("number", "0")
            continue
        m = _TOKEN.match(source, at)
        at, kind = m.end(), m.lastgroup
        if kind == "skip":
            continue
        if kind == "tick":
            text, inner, at = _template(source, at)
            holes += inner
            last = "0"
            yield Token("template", text, not inner)
        elif kind == "string":
            last = "0"
            yield Token("string", _unescaped(m[0][1:-1]))
        else:
            last = m[0]
            yield Token(kind, m[0])


class _Frame:
    """An open bracket: whose call it is, which argument is being read, which key has been named, whether names are given by ``const``."""

    __slots__ = ("sign", "call", "argument", "key", "declares")

    def __init__(self, sign: str, call: str = ""):
        self.sign, self.call, self.argument, self.key, self.declares = sign, call, 0, "", False


def endpoints_of(source: str) -> list[tuple[str, str]]:
    """Distinct (rule, address) in order; rules are string, template, concat, route and call."""
    found: dict[tuple[str, str], None] = {}

    def add(rule: str, value: str) -> None:
        value = value.strip()
        if LENGTHS[0] <= len(value) <= LENGTHS[1] and SHAPE.fullmatch(value):
            found[rule, value] = None

    constants: dict[str, str] = {}
    level = [source]
    for _ in range(DEPTH):
        deeper: list[str] = []
        for part in level:
            _scan(list(tokens(part, deeper)), add, constants)
        level = deeper
    return list(found)


_NONE = Token("sign", "")
_PLUS = Token("sign", "+")


def _scan(row: list[Token], add, constants: dict[str, str]) -> None:
    frames = [_Frame("")]
    n, i = len(row), 0
    at = lambda k: row[k] if 0 <= k < n else _NONE

    def value(k: int) -> str | None:
        """The constant that a token is."""
        t = at(k)
        if t.kind in ("string", "template"):
            return t.text if t.whole else None
        if t.kind == "name" and t.text in constants and at(k + 1).text not in ("(", ".", "[", "?.", "=", ":", "=>") and at(k - 1).text not in (".", "?."):
            return constants[t.text]
        return None

    while i < n:
        t, frame = row[i], frames[-1]
        if t.kind in ("string", "template") or value(i) is not None:
            begin, text, joined = i, value(i), 1
            free = at(begin - 1).text != "+"  # nothing unknown is joined before it
            if t.kind in ("string", "template"):
                add(t.kind, t.text)
            i += 1
            while text is not None and at(i) == _PLUS and value(i + 1) is not None:
                text, joined = text + value(i + 1), joined + 1
                if row[i + 1].kind in ("string", "template"):
                    add(row[i + 1].kind, row[i + 1].text)
                if free:
                    add("concat", text)
                i += 2
            shown = text if text is not None else row[begin].text
            after = at(i).text
            if free and frame.sign == "(" and frame.argument == 0 and at(begin - 1).text == "(" and frame.call.lower() in URL_CALLS and after in (",", ")"):
                add("call", shown)
            if free and frame.sign == "{" and at(begin - 1).text == ":" and frame.key.lower() in URL_KEYS and after in (",", "}", ""):
                add("route", shown)
            if free and text is not None and frame.declares and at(begin - 1).text == "=" and at(begin - 2).kind == "name" and at(begin - 3).text in ("const", ",") and after in (";", ",", "") + (_NEXT_STATEMENT if at(i).kind == "name" else ()):
                constants.setdefault(at(begin - 2).text, text)
            if frame.sign == "{" and after == ":" and joined == 1 and at(begin - 1).text in ("{", ","):
                frame.key = shown
            continue
        if t.kind == "sign":
            if t.text in "([{":
                call = at(i - 1).text if t.text == "(" and at(i - 1).kind == "name" and at(i - 2).text != "function" else ""
                frames.append(_Frame(t.text, call))
            elif t.text in ")]}":
                if len(frames) > 1:
                    frames.pop()
            elif t.text == ",":
                frame.argument += 1
                frame.key = ""
            elif t.text == ";":
                frame.declares = False
        elif t.text in ("const", "let", "var"):
            frame.declares = t.text == "const"
        elif t.kind == "name" and frame.sign == "{" and at(i + 1).text == ":" and at(i - 1).text in ("{", ","):
            frame.key = t.text
        i += 1


#: Words that begin a statement, so that one before them has ended without a semicolon.
_NEXT_STATEMENT = ("const", "let", "var", "function", "class", "if", "for", "while", "return", "export", "import", "async", "await", "try", "switch", "throw")


@arrow_function("array<struct<rule: string, value: string>>")
def script_endpoints(source: pa.Array) -> pa.Array:
    """Addresses in a script, each with the rule that found it."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("value", pa.string())]))
    return pa.array([[{"rule": r, "value": v} for r, v in endpoints_of(x or "")] for x in source.to_pylist()], kind)
