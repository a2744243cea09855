"""Python, by the standard library's parser; files with syntax errors by their lines."""

from __future__ import annotations

import ast
import re

from codeweave.functions.lang import MODULE

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Text:
    """Slices of a source by line and UTF-8 column."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "surrogatepass")
        self.starts = [0]
        for m in re.finditer(rb"\r\n|\r|\n", self.data):
            self.starts.append(m.end())

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def of(self, node: ast.AST) -> str:
        return self.slice(self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset))

    def slice(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")


def _parameters(src: Text, node: ast.AST) -> str:
    """From the parenthesis after the name to its partner; strings and brackets inside are passed over."""
    head = src.slice(src.at(node.lineno, node.col_offset), src.at(node.body[0].lineno, node.body[0].col_offset))
    i = head.index("(", head.index(node.name))
    depth, k, quote = 0, i, ""
    while k < len(head):
        c = head[k]
        if quote:
            if c == "\\":
                k += 1
            elif head.startswith(quote, k):
                k += len(quote) - 1
                quote = ""
        elif c in "'\"":
            quote = c * 3 if head.startswith(c * 3, k) else c
            k += len(quote) - 1
        elif c == "#":
            k = head.find("\n", k)
            if k < 0:
                break
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return head[i : k + 1]
        k += 1
    return "()"


def extract(text: str) -> tuple[list[tuple], list[tuple]]:
    try:
        tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return by_lines(text)
    src = Text(text.removeprefix("﻿"))
    classes, functions, refs = [], [], []
    # (node, nearest class, innermost function's qualified name), without recursion
    todo: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while todo:
        node, owner, inside = todo.pop()
        parts: list[tuple[ast.AST, str | None, str | None]] = []
        if isinstance(node, ast.ClassDef):
            classes.append((node.name, node.name, "class", node.lineno, node.end_lineno, f"class {node.name}"))
            for base in node.bases:
                refs.append((node.name, src.of(base), "inherits"))
            for k in node.keywords:
                value = src.of(k.value)
                refs.append((node.name, f"{k.arg}={value}" if k.arg else f"**{value}", "inherits"))
            outer = set(map(id, node.decorator_list))
            parts = [(c, owner, inside) if id(c) in outer else (c, node.name, inside) for c in ast.iter_child_nodes(node)]
        elif isinstance(node, FUNCTIONS):
            name = f"{owner}.{node.name}" if owner else node.name
            returns = f" -> {src.of(node.returns)}" if node.returns else ""
            functions.append((node.name, name, "method" if owner else "function", node.lineno, node.end_lineno, f"def {node.name}{_parameters(src, node)}{returns}"))
            outer = set(map(id, node.decorator_list))
            parts = [(c, owner, inside) if id(c) in outer else (c, owner, name) for c in ast.iter_child_nodes(node)]
        else:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                refs.append((inside or MODULE, src.of(node), "imports"))
            elif isinstance(node, ast.Call) and inside:
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if len(name) > 1:
                    refs.append((inside, name, "calls"))
            parts = [(c, owner, inside) for c in ast.iter_child_nodes(node)]
        todo += reversed(parts)
    return classes + functions, refs


LINE = re.compile(r"^(\s*)(?:async\s+)?(class|def)\s+(\w+)\s*(\([^\n]*?\))?(?:\s*->\s*([^:\n]+))?\s*:", re.M)
CALL = re.compile(r"(?:\b|\.)(\w+)\s*\(")
KEYWORDS = {"if", "elif", "while", "for", "return", "not", "and", "or", "in", "is", "with", "print", "def", "class", "lambda", "assert", "yield", "await", "except", "del", "raise"} - {"print"}


def by_lines(text: str) -> tuple[list[tuple], list[tuple]]:
    """What the lines of a broken file still say: indentation gives the nesting."""
    classes, functions, refs = [], [], []
    stack: list[list] = []  # indent, kind, name, qualified name, start, signature
    lines = text.split("\n")

    def close(upto: int, line: int) -> None:
        while stack and stack[-1][0] >= upto:
            _, kind, name, qualified, start, signature = stack.pop()
            row = (name, qualified, "class" if kind == "class" else "method" if "." in qualified else "function", start, line, signature)
            (classes if kind == "class" else functions).append(row)

    for k, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        close(indent, k - 1)
        inside = next((s[3] for s in reversed(stack) if s[1] == "def"), None)
        m = LINE.match(line)
        if m:
            _, kind, name, params, returns = m.groups()
            owner = next((s[2] for s in reversed(stack) if s[1] == "class"), None)
            qualified = name if kind == "class" or not owner else f"{owner}.{name}"
            signature = f"class {name}" if kind == "class" else f"def {name}{params or '()'}" + (f" -> {returns.strip()}" if returns else "")
            if kind == "class" and params:
                refs += [(name, b.strip(), "inherits") for b in params[1:-1].split(",") if b.strip()]
            stack.append([indent, kind, name, qualified, k, signature])
        elif re.match(r"(import|from)\s", bare):
            refs.append((inside or MODULE, bare, "imports"))
        elif inside:
            refs += [(inside, c, "calls") for c in CALL.findall(line) if len(c) > 1 and c not in KEYWORDS]
    close(-1, len(lines))
    return classes + functions, refs
