"""Query strings of a full-text search, as an expression over phrases.

    red fish                both, in any order (an implicit AND, which binds most tightly)
    "red fish"  red + fish  one after the other
    fish*   "red fi"*       a word, or a phrase's last word, that begins so
    ^red                    at the very beginning
    NEAR(red fish, 5)       at most 5 words between the first and the last of them (10 if not said)
    a NOT b, a AND b, a OR b, ( )   NOT binds more tightly than AND, and AND than OR

What isn't a query is searched for word by word (``literal``): identifiers with hyphens, quotes
that aren't closed, operators without operands, signs. The functions are plain Python on one
query, which is small; documents are never touched here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex

WORDS = r"[\p{L}\p{N}]+"
_TOKEN = regex.compile(r'\s+|(?P<string>"(?:[^"]|"")*")|(?P<sign>[()*+^,])|(?P<word>[\p{L}\p{N}_\u0080-\U0010FFFF]+)')
_IDENTIFIER = regex.compile(r"[A-Za-z0-9]-[A-Za-z0-9]")
_OPERATORS = ("AND", "OR", "NOT")


class Malformed(ValueError):
    """Not a query."""


@dataclass(frozen=True)
class Phrase:
    """texts: what stands one after the other, as written; prefix: the last word may go on; first: only at the beginning."""

    texts: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int = 10


@dataclass(frozen=True)
class Both:
    """tight: written without AND; a phrase without words is then passed over."""

    parts: tuple
    tight: bool = False


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class But:
    keep: object
    without: object


def _pieces(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Malformed(f"unexpected {text[at]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = _pieces(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or (value is not None and text != value):
            raise Malformed(f"{value or 'more'} expected, not {text!r}")
        self.at += 1
        return text

    def _joined(self, word: str, below: Callable, make: Callable) -> object:
        parts = [below()]
        while self.peek() == ("word", word):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def either(self) -> object:
        return self._joined("OR", self.both, Either)

    def both(self) -> object:
        return self._joined("AND", self.but, Both)

    def but(self) -> object:
        out = self.row()
        while self.peek() == ("word", "NOT"):
            self.take()
            out = But(out, self.row())
        return out

    def row(self) -> object:
        parts = [self.item()]
        while self._begins():
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else Both(tuple(parts), tight=True)

    def _begins(self) -> bool:
        kind, text = self.peek()
        return kind == "string" or (kind == "word" and text not in _OPERATORS) or text in ("(", "^")

    def item(self) -> object:
        kind, text = self.peek()
        if text == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if (kind, text) == ("word", "NEAR") and self.peek(1)[1] == "(":
            return self.near()
        return self.phrase()

    def near(self) -> Near:
        self.take()
        self.take("(")
        phrases, within = [self.phrase()], 10
        while self._begins():
            phrases.append(self.phrase())
        if self.peek()[1] == ",":
            self.take()
            number = self.take()
            if not number.isascii() or not number.isdigit():
                raise Malformed("NEAR takes a number")
            within = int(number)
        self.take(")")
        return Near(tuple(phrases), within)

    def phrase(self) -> Phrase:
        first = self.peek()[1] == "^"
        if first:
            self.take()
        texts = [self._text()]
        while self.peek()[1] == "+":
            self.take()
            texts.append(self._text())
        prefix = self.peek()[1] == "*"
        if prefix:
            self.take()
        return Phrase(tuple(texts), prefix, first)

    def _text(self) -> str:
        kind, text = self.peek()
        if kind not in ("string", "word") or (kind == "word" and text in _OPERATORS):
            raise Malformed(f"a phrase expected, not {text!r}")
        self.take()
        return text[1:-1].replace('""', '"') if kind == "string" else text


def parse(text: str) -> object:
    """The expression of a query; raises ``Malformed``."""
    reader = _Reader(text)
    out = reader.either()
    if reader.peek()[0] != "end":
        raise Malformed(f"unexpected {reader.peek()[1]!r}")
    return out


def literal(text: str) -> object:
    """All words of a text, as written; numbers may go on. Raises ``Malformed`` if there is none."""
    parts = [p for p in regex.split(r"[\s\-]+", text) if p]
    if not parts:
        raise Malformed("no words")
    return Both(tuple(Phrase((p,), prefix=p.isascii() and p.isdigit()) for p in parts), tight=True)


def read(text: str) -> object:
    """The expression of whatever somebody typed: a query if it is one, else its words."""
    if _IDENTIFIER.search(text):
        return literal(text)
    try:
        return parse(text)
    except Malformed:
        return literal(text)


def words(text: str) -> list[str]:
    return regex.findall(WORDS, text.lower())


def phrases_of(node: object) -> list[Phrase]:
    """The phrases of an expression, in order."""
    if isinstance(node, Phrase):
        return [node]
    parts = node.phrases if isinstance(node, Near) else (node.keep, node.without) if isinstance(node, But) else node.parts
    return [p for part in parts for p in phrases_of(part)]
