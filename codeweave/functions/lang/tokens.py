"""Tokens of brace languages: comments dropped, strings whole, brackets paired."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"\d[\w.]*")
MARKS = ("...", "=>", "::", "?.", "==", "!=", "<=", ">=", "&&", "||", "??", "->", "++", "--")
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Token:
    text: str
    start: int
    end: int
    kind: str  # word, string, number, mark


class Source:
    def __init__(self, text: str, templates: bool = False):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        self._read(0, len(text), templates)
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in CLOSE:
                while stack:
                    j = stack.pop()
                    if OPEN.index(self.tokens[j].text) == CLOSE.index(t.text):
                        self.partner[i], self.partner[j] = j, i
                        break

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def slice(self, i: int, j: int) -> str:
        """The text from token i to token j, both in."""
        return self.text[self.tokens[i].start : self.tokens[j].end]

    def _read(self, i: int, stop: int, templates: bool) -> None:
        s = self.text
        while i < stop:
            c = s[i]
            if m := SPACE.match(s, i, stop):
                i = m.end()
            elif s.startswith("//", i):
                i = s.find("\n", i, stop)
                i = stop if i < 0 else i
            elif s.startswith("/*", i):
                i = s.find("*/", i + 2, stop)
                i = stop if i < 0 else i + 2
            elif c == '"' and s.startswith('"""', i) and not templates:
                end = s.find('"""', i + 3, stop)
                i = self._add(i, stop if end < 0 else end + 3, "string")
            elif c in "\"'":
                i = self._add(i, self._string(i, stop), "string")
            elif c == "`" and templates:
                i = self._template(i, stop)
            elif c == "/" and templates and self._regex_here():
                i = self._add(i, self._regex(i, stop), "string")
            elif m := WORD.match(s, i, stop):
                i = self._add(i, m.end(), "word")
            elif m := NUMBER.match(s, i, stop):
                i = self._add(i, m.end(), "number")
            else:
                mark = next((x for x in MARKS if s.startswith(x, i)), c)
                i = self._add(i, i + len(mark), "mark")

    def _add(self, i: int, j: int, kind: str) -> int:
        self.tokens.append(Token(self.text[i:j], i, j, kind))
        return j

    def _string(self, i: int, stop: int) -> int:
        q, k = self.text[i], i + 1
        while k < stop and self.text[k] != q and self.text[k] != "\n":
            k += 2 if self.text[k] == "\\" else 1
        return min(k + 1, stop)

    def _template(self, i: int, stop: int) -> int:
        """A template's text is a string; what stands in ${} is read as code."""
        s, k, start = self.text, i + 1, i
        while k < stop:
            if s[k] == "\\":
                k += 2
            elif s[k] == "`":
                return self._add(start, k + 1, "string")
            elif s.startswith("${", k):
                self._add(start, k + 2, "string")
                depth, j = 1, k + 2
                while j < stop and depth:
                    if s[j] in "\"'":
                        j = self._string(j, stop) - 1
                    depth += (s[j] == "{") - (s[j] == "}")
                    j += 1
                self._read(k + 2, j - 1, True)
                k = start = j
            else:
                k += 1
        return self._add(start, stop, "string") if start < stop else stop

    def _regex_here(self) -> bool:
        """A slash begins a regular expression where no value stands before it."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in ("return", "typeof", "case", "in", "of") if t.kind == "word" else t.kind == "mark" and t.text not in (")", "]", "}", "<")

    def _regex(self, i: int, stop: int) -> int:
        k, group = i + 1, False
        while k < stop and self.text[k] != "\n":
            c = self.text[k]
            if c == "\\":
                k += 1
            elif c == "[":
                group = True
            elif c == "]":
                group = False
            elif c == "/" and not group:
                k += 1
                while k < stop and self.text[k].isalpha():
                    k += 1
                return k
            k += 1
        return i + 1  # no end on the line: a division


def past_angles(src: Source, i: int) -> int:
    """The token after a type argument list that begins at i; i itself if none does."""
    if i >= len(src.tokens) or src.tokens[i].text != "<":
        return i
    depth = 0
    while i < len(src.tokens):
        t = src.tokens[i].text
        if t == "<":
            depth += 1
        elif t == ">":
            depth -= 1
            if not depth:
                return i + 1
        elif t in (";", "{") and t == ";":
            return i
        elif t in OPEN and i in src.partner:
            i = src.partner[i]
        i += 1
    return i
