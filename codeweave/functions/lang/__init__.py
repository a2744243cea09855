"""Source text → symbols and raw references, by language. Nothing here raises on any input.

A symbol is (name, qualified_name, kind, start_line, end_line, signature), a reference (source, ref_text, kind), where
source is the qualified name of the symbol that refers, or __module__. Symbols come classes first.
"""

from __future__ import annotations

MODULE = "__module__"


def extract(language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    from codeweave.functions.lang import java, python, typescript

    by = {"python": python.extract, "java": java.extract, "typescript": typescript.extract, "tsx": typescript.extract}
    if language not in by:
        return [], []
    try:
        return by[language](text)
    except Exception:  # a file that defeats the reader has no symbols, as documented
        return [], []
