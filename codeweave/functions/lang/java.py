"""Java: classes, their methods, superclasses, imports and calls, by a scan of declarations."""

from __future__ import annotations

from codeweave.functions.lang import MODULE
from codeweave.functions.lang.tokens import Source, past_angles

MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "strictfp", "default", "transient", "volatile", "sealed"}
TYPES = {"class", "interface", "enum", "record"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "super", "this", "try", "assert", "throw", "case", "instanceof", "else", "do", "yield"}


class Scan:
    def __init__(self, text: str):
        self.src = Source(text)
        self.t = self.src.tokens
        self.classes: list[tuple] = []
        self.methods: list[tuple] = []
        self.refs: list[tuple] = []

    def word(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def body(self, i: int, stop: int, owner: str | None) -> None:
        """Members between tokens i and stop of a type's body, or of the file."""
        start = i
        while i < stop:
            w = self.word(i)
            if w == "@" and self.word(i + 1) != "interface":
                i += 2
                while self.word(i) == ".":
                    i += 2
                if self.word(i) == "(":
                    i = self.src.partner.get(i, i) + 1
                continue
            if w == "import" and owner is None:
                end = i
                while end < stop and self.word(end) != ";":
                    end += 1
                self.refs.append((MODULE, self.src.slice(i, min(end, stop - 1)), "imports"))
                i = start = end + 1
            elif w in TYPES and i + 1 < stop and self.t[i + 1].kind == "word" and self.word(i - 1) != "." and (w != "record" or self.word(i + 2) in ("(", "<")):
                i = start = self.type(i, stop, owner, start)
            elif w == "(" and self.t[i - 1].kind == "word":
                i = start = self.method(i, stop, owner, start)
            elif w == "=":  # a field's value
                while i < stop and self.word(i) not in (";", ","):
                    if self.word(i) in ("(", "[", "{"):
                        self.calls(i, self.src.partner.get(i, i), owner, None)
                        i = self.src.partner.get(i, i)
                    i += 1
                start = i = i + 1
            elif w == "{":
                end = self.src.partner.get(i, stop)
                self.calls(i + 1, end, owner, None)
                i = start = end + 1
            elif w in (";", ",", "}"):
                i = start = i + 1
            else:
                i += 1

    def type(self, i: int, stop: int, owner: str | None, start: int) -> int:
        kind, name = self.word(i), self.word(i + 1)
        k = i + 2
        base = None
        while k < stop and self.word(k) not in ("{", ";"):
            if self.word(k) == "extends" and kind == "class" and base is None:
                end = k + 1
                while end < stop and self.word(end) not in ("{", "implements", "permits"):
                    end = past_angles(self.src, end) if self.word(end) == "<" else end + 1
                base = self.src.slice(k + 1, end - 1)
                k = end
                continue
            k = self.src.partner.get(k, k) + 1 if self.word(k) == "(" else past_angles(self.src, k) if self.word(k) == "<" else k + 1
        end = self.src.partner.get(k, stop - 1) if self.word(k) == "{" else k
        if kind == "class":
            first = start
            self.classes.append((name, name, "class", self.src.line(self.t[first].start), self.src.line(self.t[min(end, len(self.t) - 1)].start), f"class {name}"))
            if base:
                self.refs.append((name, base, "inherits"))
        if self.word(k) == "{":
            self.body(k + 1, end, name if kind == "class" else owner)
        return end + 1

    def method(self, i: int, stop: int, owner: str | None, start: int) -> int:
        """A member with parentheses: a method if a type stands before its name, else a constructor."""
        close = self.src.partner.get(i, i)
        k = start
        while k < i - 1 and (self.word(k) in MODIFIERS or self.word(k) == "@"):
            if self.word(k) == "@":
                k += 2
                while self.word(k) == ".":
                    k += 2
                k = self.src.partner.get(k, k) + 1 if self.word(k) == "(" else k
            else:
                k += 1
        k = past_angles(self.src, k)
        name, ret = self.word(i - 1), self.src.slice(k, i - 2) if k < i - 1 else ""
        end = close + 1
        while end < stop and self.word(end) not in ("{", ";", ",", "="):
            end += 1
        last = self.src.partner.get(end, stop - 1) if self.word(end) == "{" else end
        inside = None
        if ret:
            inside = f"{owner}.{name}" if owner else name
            self.methods.append((name, inside, "method", self.src.line(self.t[start].start), self.src.line(self.t[min(last, len(self.t) - 1)].start), f"{ret} {name}{self.src.slice(i, close)}"))
        if self.word(end) == "{":
            self.calls(end + 1, last, owner, inside)
        return last + 1

    def calls(self, i: int, stop: int, owner: str | None, inside: str | None) -> None:
        """Calls between two tokens of a body, and the types declared there."""
        while i < stop:
            w = self.word(i)
            if w in TYPES and self.t[i + 1].kind == "word" and self.word(i - 1) not in (".", "::") and (w == "class" or self.word(i + 2) in ("{", "(", "<", "implements", "extends")):
                i = self.type(i, stop, owner, i)
                continue
            if w == "new":
                k = i + 1
                while self.t[k].kind == "word" or self.word(k) == ".":
                    k += 1
                k = past_angles(self.src, k)
                if self.word(k) == "(":
                    close = self.src.partner.get(k, k)
                    self.calls(k + 1, close, owner, inside)
                    i = close + 1
                    if self.word(i) == "{":  # an anonymous class
                        end = self.src.partner.get(i, stop)
                        self.body(i + 1, end, owner)
                        i = end + 1
                    continue
            if self.t[i].kind == "word" and self.word(i + 1) == "(" and w not in NOT_CALLS and len(w) > 1 and inside:
                self.refs.append((inside, w, "calls"))
            i += 1


def extract(text: str) -> tuple[list[tuple], list[tuple]]:
    s = Scan(text)
    s.body(0, len(s.t), None)
    return s.classes + s.methods, s.refs
