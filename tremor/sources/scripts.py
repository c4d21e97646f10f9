"""What scripts (JavaScript, TypeScript) say, read from their tokens: imports, exports, names, constants, HTTP calls.

One pass splits a source into words, quoted texts, comments and marks; all that is read here looks at that list and at
nothing else, so text in quotes or comments never passes for code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

# --- fixed values: verbs and heads of HTTP calls, and windows that bound a scan ---
HTTP_VERBS = ("get", "post", "put", "delete", "patch")
CLIENTS = ("$http", "HttpClient", "http", "axios")
BARE_CALLS = ("fetch", "axios")
CALL_WINDOW, LITERAL_CHARS, CONSTANT_CHARS, DECLARATION_CHARS = 300, 500, 300, 200

DECLARE = ("const", "let", "var")
LOADERS = ("import", "require")
_LEXEME = re.compile(
    r"""(?P<note>/\*(?:.*?\*/|.*\Z)|(?<!:)//[^\n]*)
      | (?P<tick>`(?:[^\\`]|\\.)*+`?)
      | (?P<text>"(?:[^\\"\n]|\\.)*+"?|'(?:[^\\'\n]|\\.)*+'?)
      | (?P<word>[\w$]+)
      | (?P<mark>\S)""",
    re.S | re.X,
)


class Token(NamedTuple):
    kind: str
    text: str
    at: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def value(self) -> str | None:
        """What stands between the quotes of a quoted text that is closed."""
        closed = self.kind in ("text", "tick") and len(self.text) > 1 and self.text[-1] == self.text[0]
        return self.text[1:-1] if closed else None


def lexemes(source: str) -> Iterator[Token]:
    for m in _LEXEME.finditer(source):
        yield Token(m.lastgroup, m.group(), m.start())


class Script:
    """Tokens of a source without its comments."""

    def __init__(self, source: str):
        self.tokens = [t for t in lexemes(source) if t.kind != "note"]
        self.breaks = [k for k, c in enumerate(source) if c == "\n"]

    def line(self, at: int) -> int:
        """Line of an offset, from 1."""
        return bisect_left(self.breaks, at) + 1

    def word(self, k: int) -> str:
        """Token k as it stands, empty for quoted text and beyond the ends."""
        return self.tokens[k].text if 0 <= k < len(self.tokens) and self.tokens[k].kind in ("word", "mark") else ""

    def first_of_line(self, k: int) -> bool:
        return k == 0 or self.line(self.tokens[k - 1].at) < self.line(self.tokens[k].at)

    def braces(self, k: int) -> tuple[list[list[Token]], int]:
        """(parts between commas of a list that opens at token k, index after it)."""
        parts, k = [[]], k + 1
        while k < len(self.tokens) and self.word(k) != "}":
            if self.word(k) == ",":
                parts.append([])
            else:
                parts[-1].append(self.tokens[k])
            k += 1
        return [p for p in parts if p], k + 1


def _plain(part: list[Token]) -> list[Token]:
    """A list's part without a leading type modifier."""
    return part[1:] if len(part) > 1 and part[0].text == "type" and part[1].text != "as" else part


def without_comments(source: str) -> str:
    """Comments gone; line numbers stay."""
    out, at = [], 0
    for t in lexemes(source):
        if t.kind == "note":
            out += [source[at : t.at], "\n" * t.text.count("\n")]
            at = t.end
    return "".join(out) + source[at:]


def _operand(before: list[str]) -> bool:
    """Whether quoted text after these two words or marks is what is imported."""
    last = before[-1]
    return last in ("from", *LOADERS) or (last == "(" and before[-2] in ("from", *LOADERS))


def blank_literals(source: str, keep_operands: bool = True, keep_exports: bool = False) -> str:
    """Quoted text becomes spaces (line feeds stay), but for what is imported, and with keep_exports for names in export lists."""
    out, at, before, listed = [], 0, ["", ""], False
    for t in lexemes(source):
        if t.kind in ("text", "tick"):
            if not (keep_operands and (_operand(before) or (keep_exports and listed))):
                out += [source[at : t.at], re.sub(r"[^\n]", " ", t.text)]
                at = t.end
            before = [before[-1], ""]
        elif t.kind != "note":
            listed = (t.text == "{" and before[-1] == "export") or (listed and t.text != "}")
            before = [before[-1], t.text]
    return "".join(out) + source[at:]


def specifiers(script: Script) -> list[str]:
    """What a script imports or exports from, and what it loads by calls, in order, each once."""
    found: dict[str, None] = {}
    statement = -1  # the import or export at the start of a line that quoted text may still belong to
    for k, t in enumerate(script.tokens):
        if t.kind in ("text", "tick"):
            called = script.word(k - 1) == "(" and script.word(k - 2) in LOADERS and script.word(k - 3) != "."
            stated = statement >= 0 and (script.word(k - 1) == "from" or (statement == k - 1 and script.word(k - 1) == "import"))
            if (called or stated) and t.kind == "text" and t.value:
                found[t.value] = None
            statement = -1
        elif t.text == ";":
            statement = -1
        elif t.text in ("import", "export") and script.first_of_line(k):
            statement = k
    return list(found)


def exports(script: Script) -> dict[str, int]:
    """Exported name to the line on which it first stands: declarations, default names and lists."""
    listed: dict[str, int] = {}
    named: dict[str, int] = {}
    for k, t in enumerate(script.tokens):
        if t.kind != "word" or t.text != "export":
            continue
        line, n = script.line(t.at), k + 1
        if script.word(n) == "{":
            for part in script.braces(n)[0]:
                name = _plain(part)[-1]
                listed.setdefault(name.value if name.value is not None else name.text, script.line(part[0].at))
            continue
        default = script.word(n) == "default"
        while script.word(n) in ("default", "async"):
            n += 1
        declared = script.word(n) in ("function", "class", *DECLARE)
        if declared:
            n += 1 + (script.word(n + 1) == "*")
        if (declared or default) and n < len(script.tokens) and script.tokens[n].kind == "word":
            named.setdefault(script.tokens[n].text, line)
    return named | {name: line for name, line in listed.items() if name and name not in named}


def bindings(script: Script) -> dict[str, int]:
    """Name that a script imports or requires, as its module calls it, to the line of the statement."""
    imported: dict[str, int] = {}
    required: dict[str, int] = {}
    for k, t in enumerate(script.tokens):
        if t.kind != "word" or t.text not in ("import", *DECLARE):
            continue
        n = k + 1
        if t.text == "import":
            if script.word(n) == "type":
                n += 1
            if script.word(n + 1) == ",":  # a default name before the list
                n += 2
            if script.word(n) == "{":
                for part in script.braces(n)[0]:
                    imported.setdefault(_plain(part)[0].text, script.line(t.at))
            continue
        names, after = script.braces(n) if script.word(n) == "{" else ([script.tokens[n : n + 1]], n + 1)
        loads = script.word(after) == "=" and script.word(after + 1) == "require" and script.word(after + 2) == "(" and after + 3 < len(script.tokens) and script.tokens[after + 3].value is not None
        for part in names if loads else ():
            if part and part[0].kind == "word":
                required.setdefault(_plain(part)[0].text, script.line(t.at))
    return imported | {name: line for name, line in required.items() if name not in imported}


def symbols(script: Script) -> Iterator[tuple[int, str, str]]:
    """(line, name, import or export) of every name that a script binds or exports; each name once."""
    bound = bindings(script)
    yield from ((line, name, "import") for name, line in bound.items())
    yield from ((line, name, "export") for name, line in exports(script).items() if name not in bound)


def constants(script: Script) -> dict[str, str]:
    """Names declared once as a literal, or as one such name and a literal."""
    found: dict[str, list[tuple[str | None, str]]] = {}
    for k, t in enumerate(script.tokens):
        name = k + 1
        if t.text not in (*DECLARE, "readonly") or t.kind != "word" or name >= len(script.tokens) or script.tokens[name].kind != "word":
            continue
        n = name + 1
        while n < len(script.tokens) and script.word(n) != "=" and script.tokens[n].end - script.tokens[name].end <= DECLARATION_CHARS:
            n += 1
        if script.word(n) != "=" or script.line(script.tokens[n].at) != script.line(script.tokens[name].at):
            continue
        lead = script.word(n + 1) if script.word(n + 2) == "+" and script.tokens[n + 1].kind == "word" else None
        at = n + 3 if lead else n + 1
        value = script.tokens[at].value if at < len(script.tokens) else None
        if value and len(value) <= CONSTANT_CHARS and "\n" not in value and script.word(at + 1) != "+":
            found.setdefault(script.tokens[name].text, []).append((lead, value))
    once = {name: v[0] for name, v in found.items() if len(v) == 1}
    plain = {name: v for name, (lead, v) in once.items() if lead is None}
    return plain | {name: plain[lead] + v for name, (lead, v) in once.items() if lead in plain}


def _address(script: Script, k: int, known: dict[str, str]) -> str | None:
    """The URL that opens an argument list at token k: quoted, after a leading operand and a plus, or a constant's name."""
    if k >= len(script.tokens):
        return None
    first = script.tokens[k]
    if first.kind in ("text", "tick"):
        value = first.value
    else:
        n = k
        while script.word(n) in (".", "[", "]") or (n < len(script.tokens) and script.tokens[n].kind in ("word", "text")):
            n += 1
        if script.word(n) == "+" and n + 1 < len(script.tokens) and script.tokens[n + 1].kind == "text":
            value = script.tokens[n + 1].value
        else:
            value = known.get(first.text) if script.word(k + 1) in (",", ")") else None
    return value if value and len(value) <= LITERAL_CHARS and "\n" not in value and "${" not in value else None


def http_calls(script: Script, known: dict[str, str] | None = None) -> Iterator[tuple[int, str, str]]:
    """(line, method, url) of calls whose argument list opens with a URL; the method is the verb, an option, or get."""
    for k, t in enumerate(script.tokens):
        if t.kind != "word":
            continue
        verb = script.word(k + 2)
        if t.text in CLIENTS and script.word(k + 1) == "." and verb in HTTP_VERBS and script.word(k + 3) == "(":
            method, first = verb, k + 4
        elif t.text in BARE_CALLS and script.word(k + 1) == "(" and script.word(k - 1) != ".":
            method, first = None, k + 2
        else:
            continue
        url = _address(script, first, known or {})
        if not url:
            continue
        depth, n, limit = 1, first, script.tokens[first - 1].end + CALL_WINDOW
        while depth and n < len(script.tokens) and script.tokens[n].at < limit:
            depth += {"(": 1, ")": -1}.get(script.word(n), 0)
            option = script.tokens[n + 2].value if method is None and script.word(n) == "method" and script.word(n + 1) == ":" and n + 2 < len(script.tokens) else None
            if option and option.lower() in HTTP_VERBS:
                method = option.lower()
            n += 1
        yield script.line(t.at), method or "get", url
