"""A small reader of script tokens: import and re-export statements, also over several lines.

Only statements that begin a line count. From there tokens are read until the
statement is complete or can no longer become one; an unfinished statement ends
where another begins, so it does not swallow what follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: White space and comments, quoted strings, words, and single characters for the rest.
_TOKEN = re.compile(r"""(?P<skip>\s+|//.*|/\*.*?\*/)|(?P<quoted>'[^']*'|"[^"]*")|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>.)""")
_STARTERS = frozenset("import export const let var module exports".split())
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    leads: bool  # first of its line


@dataclass(frozen=True)
class Statement:
    """Lines ``first`` to ``last`` (from 0), the module named, the names it gives, its edge kind and method."""

    first: int
    last: int
    module: str
    names: tuple[str, ...]
    edge_kind: str
    binds: bool
    method: str


def tokens(lines: list[str], at: int) -> Iterator[Token]:
    for n in range(at, len(lines)):
        leads = True
        for m in _TOKEN.finditer(lines[n]):
            if m.lastgroup != "skip":
                yield Token(m.lastgroup, m[0], n, leads)
                leads = False


def is_name(text: str) -> bool:
    return re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", text, re.A) is not None


def split_items(found: list[Token]) -> list[list[Token]]:
    """The parts of a token list between commas that stand in no bracket."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in found:
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "sign" else 0
        if t.text == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def braced(found: list[Token]) -> list[Token]:
    """What stands between the first opening and the last closing brace."""
    opens = [i for i, t in enumerate(found) if t.text == "{"]
    closes = [i for i, t in enumerate(found) if t.text == "}"]
    return found[opens[0] + 1 : closes[-1]] if opens and closes and opens[0] < closes[-1] else []


def item_name(item: list[Token], renames: str) -> str | None:
    """The local name of one item in braces: what follows the renaming word, without a default value."""
    texts = [t.text for t in item]
    if renames in texts:
        texts = texts[texts.index(renames) + 1 :]
    elif len(texts) > 1 and texts[0] in ("type", "typeof"):
        texts = texts[1:]
    if "=" in texts:
        texts = texts[: texts.index("=")]
    return texts[0] if len(texts) == 1 and is_name(texts[0]) else None


def clause_names(found: list[Token], renames: str = "as") -> tuple[str, ...]:
    """The local names of an import or export clause (as), or of a destructuring pattern (:)."""
    names: list[str | None] = []
    texts = [t.text for t in found]
    if renames == "as":
        if texts[:2] == ["*", "as"]:
            names.append(texts[2] if len(texts) == 3 else None)
        elif texts and is_name(texts[0]) and (len(texts) == 1 or texts[1] == ","):
            names.append(texts[0])
    elif len(texts) == 1:
        names.append(texts[0] if is_name(texts[0]) else None)
    names += [item_name(item, renames) for item in split_items(braced(found))]
    return tuple(dict.fromkeys(n for n in names if n))


def _until_module(stream: Iterator[Token], first: list[Token]) -> tuple[list[Token], Token] | None:
    """Tokens up to a ``from`` with the quoted module after it; None where that cannot come any more."""
    found, depth = list(first), 0
    for t in stream:
        if t.kind == "quoted" and found and found[-1].text == "from" and depth == 0:
            return found[:-1], t
        if t.text in (";", "=") and depth == 0 or t.leads and t.text in _STARTERS:
            return None
        if depth == 0 and found and found[-1].text == "}" and t.text not in ("from", ","):
            return None
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "sign" else 0
        found.append(t)
    return None


def _required(stream: Iterator[Token]) -> Token | None:
    """The quoted module of a require call that comes next."""
    said = [next(stream, None) for _ in range(4)]
    if None in said or [said[0].text, said[1].text, said[3].text] != ["require", "(", ")"] or said[2].kind != "quoted":
        return None
    return said[2]


def _module_statement(stream: Iterator[Token], verb: str, first: int) -> Statement | None:
    head = next(stream, None)
    if head is None:
        return None
    if verb == "import" and head.kind == "quoted":
        return Statement(first, head.line, head.text[1:-1], (), "imports", False, "lexical-side-effect-import")
    if verb == "export" and head.text not in ("{", "*", "type") or head.text in ("(", "."):
        return None
    typed, begin = "", [head]
    if head.text == "type":
        after = next(stream, None)
        if after is None or verb == "export" and after.text not in ("{", "*"):
            return None
        # "import type from" and "import type, { a } from" bind the name type
        begin, typed = ([after], "type-") if after.text not in ("from", ",") else ([head, after], "")
    depth_open = begin[-1].text == "{"
    whole = _until_module(_pushed(stream, begin[-1]), begin[:-1]) if depth_open else _until_module(stream, begin)
    if whole is None:
        return None
    clause, module = whole
    if verb == "import":
        return Statement(first, module.line, module.text[1:-1], clause_names(clause), "imports", not typed, f"lexical-{typed}import")
    return Statement(first, module.line, module.text[1:-1], clause_names(clause), "exports", False, f"lexical-{typed}re-export")


def _pushed(stream: Iterator[Token], first: Token) -> Iterator[Token]:
    yield first
    yield from stream


def _require_statement(stream: Iterator[Token], first: int) -> Statement | None:
    pattern, depth = [], 0
    for t in stream:
        if t.text == "=" and depth == 0:
            module = _required(stream)
            return module and Statement(first, module.line, module.text[1:-1], clause_names(pattern, ":"), "imports", True, "lexical-require")
        if t.text == ";" or t.leads and t.text in _STARTERS:
            return None
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "sign" else 0
        pattern.append(t)
    return None


def _exported_require(stream: Iterator[Token], verb: str, first: int) -> Statement | None:
    dot, member, equals = (next(stream, None) for _ in range(3))
    if equals is None or [dot.text, equals.text] != [".", "="] or (member.text != "exports" if verb == "module" else not is_name(member.text)):
        return None
    module = _required(stream)
    return module and Statement(first, module.line, module.text[1:-1], (), "exports", False, "lexical-commonjs-export-require")


def statements(lines: list[str]) -> Iterator[Statement]:
    """Every import and re-export that begins a line."""
    at = 0
    while at < len(lines):
        stream = tokens(lines, at)
        head = next(stream, None)
        if head is None:
            return
        at = head.line
        found = None
        if head.text in ("import", "export"):
            found = _module_statement(stream, head.text, at)
        elif head.text in ("const", "let", "var"):
            found = _require_statement(stream, at)
        elif head.text in ("module", "exports"):
            found = _exported_require(stream, head.text, at)
        if found:
            yield found
        at = (found.last if found else at) + 1
