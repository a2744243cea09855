"""TypeScript and TSX: classes, interfaces, functions, methods, named arrows, imports and calls, by a scan of declarations."""

from __future__ import annotations

from codeweave.functions.lang import MODULE
from codeweave.functions.lang.tokens import Source, past_angles

MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare", "*"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "super", "typeof", "await", "new", "import", "constructor", "else", "do", "throw", "void", "delete", "in", "of", "yield", "with"}


class Scan:
    def __init__(self, text: str):
        self.src = Source(text, templates=True)
        self.t = self.src.tokens
        self.classes: list[tuple] = []
        self.functions: list[tuple] = []
        self.refs: list[tuple] = []

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def lines(self, i: int, j: int) -> tuple[int, int]:
        j = min(max(i, j), len(self.t) - 1)
        return self.src.line(self.t[i].start), self.src.line(self.t[j].end - 1)

    def code(self, i: int, stop: int, owner: str | None, inside: str | None) -> None:
        """Statements and expressions between two tokens."""
        while i < stop:
            w, t = self.word(i), self.t[i]
            before = self.word(i - 1)
            if t.kind != "word":
                if w == "{" and before in ("(", ",", "=", ":", "return", "=>", "[", "?", "&&", "||", "??"):
                    end = self.src.partner.get(i, stop)
                    if before != "=>":
                        self.members(i + 1, end, owner, inside, False)
                        i = end + 1
                        continue
                i += 1
            elif w == "import" and before != "." and self.word(i + 1) not in ("(", "."):
                i = self.imports(i, stop)
            elif w in ("class", "interface") and self.t[i + 1].kind == "word" and before != "." and self.word(i + 1) not in ("extends", "implements"):
                i = self.type(i, stop, owner, inside)
            elif w == "function" and before != ".":
                i = self.function(i, stop, owner, inside)
            elif w in ("const", "let", "var") and self.t[i + 1].kind == "word":
                i = self.variable(i, stop, owner, inside)
            else:
                if self.call(i) and inside:
                    self.refs.append((inside, w, "calls"))
                i += 1

    def call(self, i: int) -> bool:
        w = self.word(i)
        if len(w) < 2 or w in NOT_CALLS or self.word(i - 1) in ("new", "function"):
            return False
        k = i + 1
        if self.word(k) == "?.":
            k += 1
        if self.word(k) == "<":
            after = past_angles(self.src, k)
            k = after if self.word(after) == "(" else k
        return self.word(k) == "("

    def imports(self, i: int, stop: int) -> int:
        """One reference for each name; `type` is no name, an alias counts by its original."""
        end = i
        while end < stop and self.t[end].kind != "string":
            if self.word(end) == ";":
                return end + 1
            end += 1
        if end >= stop:
            return end
        module = self.t[end].text[1:-1]
        names, k = [], i + 1
        if self.word(k) == "type" and self.word(k + 1) not in ("from", ","):
            k += 1
        while k < end:
            w = self.word(k)
            if w == "{":
                close = self.src.partner.get(k, end)
                k += 1
                fresh = True
                while k < close:
                    if self.word(k) == ",":
                        fresh = True
                    elif fresh and self.t[k].kind == "word":
                        if self.word(k) == "type" and self.t[k + 1].kind == "word" and self.word(k + 1) != "as":
                            k += 1
                        names.append(self.word(k))
                        fresh = False
                    k += 1
            elif w == "*" and self.word(k + 1) == "as":
                names.append(self.word(k + 2))
                k += 2
            elif w == "from":
                break
            elif self.t[k].kind == "word":
                names.append(w)
            k += 1
        self.refs += [(MODULE, f"{n}|{module}", "imports") for n in names]
        return end + 1

    def heritage(self, i: int, stop: int) -> tuple[list[str], int]:
        """The types after extends and implements, up to the body."""
        found, k, start = [], i, None
        while k < stop and self.word(k) != "{":
            if self.word(k) in ("extends", "implements", ","):
                if start is not None:
                    found.append(self.src.slice(start, k - 1))
                start = k + 1
                k += 1
            else:
                k = past_angles(self.src, k) if self.word(k) == "<" else self.src.partner.get(k, k) + 1 if self.word(k) == "(" else k + 1
        if start is not None and start < k:
            found.append(self.src.slice(start, k - 1))
        return [f.split("<")[0].strip() if "(" not in f else f for f in found], k

    def type(self, i: int, stop: int, owner: str | None, inside: str | None) -> int:
        kind, name = self.word(i), self.word(i + 1)
        bases, k = self.heritage(past_angles(self.src, i + 2), stop)
        end = self.src.partner.get(k, stop - 1)
        self.classes.append((name, name, "class", *self.lines(i, end), f"{kind} {name}"))
        self.refs += [(name, b, "inherits") for b in bases]
        if kind == "class":
            self.members(k + 1, end, name, inside, True)
        return end + 1

    def members(self, i: int, stop: int, owner: str | None, inside: str | None, of_class: bool) -> None:
        """Members of a class, or of an object literal: methods, and values."""
        start = i
        while i < stop:
            w = self.word(i)
            if w == "@":
                i += 2
                while self.word(i) == ".":
                    i += 2
                i = self.src.partner.get(i, i) + 1 if self.word(i) == "(" else i
                start = i
            elif w in (";", ",", "..."):
                i = start = i + 1
            elif w in (":", "=") and i > start:  # a value, up to the member's end
                k = i + 1
                while k < stop and self.word(k) != (";" if of_class else ","):
                    k = self.src.partner.get(k, k) + 1
                    if of_class and k < stop and self.src.line(self.t[k].start) > self.src.line(self.t[k - 1].end - 1) and self.word(k - 1) not in ("=", "=>", "(", ",", ":", "?", "+", "|", "&"):
                        break
                self.code(i + 1, k, owner, inside)
                i = start = k
            elif w == "(" or (w == "<" and self.word(past_angles(self.src, i)) == "("):
                at = past_angles(self.src, i)
                close = self.src.partner.get(at, at)
                name = self.word(i - 1) if i > start else ""
                k = close + 1
                ret_from = k
                while k < stop and self.word(k) not in ("{", ";", ","):
                    k = past_angles(self.src, k) if self.word(k) == "<" else k + 1
                if self.word(ret_from) == ":" and self.word(k) == "{" and k == ret_from + 1:  # a type in braces
                    k = self.src.partner.get(k, k) + 1
                if self.word(k) == "{" and name and (self.t[i - 1].kind in ("word", "string") or name == "]"):
                    end = self.src.partner.get(k, stop - 1)
                    ret = self.src.slice(ret_from, k - 1) if k > ret_from else ""
                    mine = f"{owner}.{name}" if owner else name
                    first = start
                    self.functions.append((name, mine, "method" if owner else "function", *self.lines(first, end), f"{name}{self.src.slice(at, close)}{ret}"))
                    self.code(at + 1, close, owner, mine)
                    self.code(k + 1, end, owner, mine)
                    i = start = end + 1
                else:  # a signature without a body, or a call
                    self.code(i, k, owner, inside)
                    i = start = k + 1
            elif w in ("{", "["):
                end = self.src.partner.get(i, stop)
                self.code(i + 1, end, owner, inside)
                i = end + 1
            else:
                i += 1

    def function(self, i: int, stop: int, owner: str | None, inside: str | None) -> int:
        k = i + 1
        if self.word(k) == "*":
            k += 1
        name = self.word(k) if k < stop and self.t[k].kind == "word" else ""
        at = past_angles(self.src, k + 1 if name else k)
        close = self.src.partner.get(at, at)
        k = close + 1
        ret_from = k
        while k < stop and self.word(k) not in ("{", ";"):
            k = past_angles(self.src, k) if self.word(k) == "<" else k + 1
        end = self.src.partner.get(k, stop - 1) if self.word(k) == "{" else k
        mine = inside
        if name and self.word(k) == "{" and self.word(i - 1) not in ("=", "(", ",", ":", "return"):
            ret = self.src.slice(ret_from, k - 1) if k > ret_from else ""
            mine = name
            self.functions.append((name, name, "function", *self.lines(i - 1 if self.word(i - 1) == "async" else i, end), f"function {name}{self.src.slice(at, close)}{ret}"))
        self.code(at + 1, close, owner, mine)
        if self.word(k) == "{":
            self.code(k + 1, end, owner, mine)
        return end + 1

    def variable(self, i: int, stop: int, owner: str | None, inside: str | None) -> int:
        """`const name[: type] = [async] (params)[: ret] => body` is a named arrow; anything else is read on."""
        name, k = self.word(i + 1), i + 2
        if self.word(k) == ":":
            while k < stop and self.word(k) not in ("=", ";"):
                k = past_angles(self.src, k) if self.word(k) == "<" else self.src.partner.get(k, k) + 1 if self.word(k) in ("(", "{", "[") else k + 1
        if self.word(k) != "=":
            return i + 2
        at = k + 1
        if self.word(at) == "async":
            at += 1
        p = past_angles(self.src, at)
        if self.word(p) == "(":
            close = self.src.partner.get(p, p)
            params, a = self.src.slice(p, close), close + 1
        elif p < stop and self.t[p].kind == "word" and self.word(p + 1) == "=>":
            close, params, a = p, self.word(p), p + 1
        else:
            return k + 1
        ret_from = a
        if self.word(a) == ":":
            while a < stop and self.word(a) not in ("=>", ";", ","):
                a = past_angles(self.src, a) if self.word(a) == "<" else self.src.partner.get(a, a) + 1 if self.word(a) in ("(", "{", "[") else a + 1
        if self.word(a) != "=>":
            return k + 1
        ret = self.src.slice(ret_from, a - 1) if a > ret_from else ""
        if self.word(a + 1) == "{":
            end = self.src.partner.get(a + 1, stop - 1)
        else:
            end = a + 1
            while end < stop and self.word(end) not in (";", ","):
                nxt = self.src.partner.get(end, end) + 1
                if nxt < stop and self.src.line(self.t[nxt].start) > self.src.line(self.t[nxt - 1].end - 1) and self.word(nxt) not in (".", "?.", "?", ":", "&&", "||", "+"):
                    end = nxt
                    break
                end = nxt
            end -= 1
        self.functions.append((name, name, "function", *self.lines(k + 1, end), f"const {name} = {params}{ret} => ..."))
        self.code(p + 1, close, owner, name)
        self.code(a + 1, min(end + 1, stop), owner, name)
        return end + 1


def extract(text: str) -> tuple[list[tuple], list[tuple]]:
    s = Scan(text)
    s.code(0, len(s.t), None, None)
    return s.classes + s.functions, s.refs
