"""Names that an import statement brings in, as array expressions.

`strict` drops what can't be a name (Java wildcards, parentheses and line breaks in Python imports); without it the
text is taken literally.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty() -> Column:
    return F.array().cast("array<string>")


def _trim(c: Column) -> Column:
    """Without white space of any kind (Unicode's too) at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _parts(c: Column) -> Column:
    """A comma list without aliases, trimmed, without empty entries."""
    items = F.transform(F.split(c, ","), lambda x: _trim(F.split_part(_trim(x), F.lit(" as "), F.lit(1))))
    return F.filter(items, lambda x: x != "")


def python_import(text: Column, strict: bool = True) -> Column:
    """`from M import a, b as c` → a, M.a, b, M.b (M without leading dots, absent if empty; `*` → M); `import a.b as x, c` → a.b, c."""
    t = _trim(text)
    if strict:
        t = _trim(F.regexp_replace(t, r"(?U)[()\s]+", " "))
    module = F.regexp_replace(F.regexp_extract(t, r"(?U)^from\s+([\w.]+)\s+import\s+(.+)", 1), r"^\.+", "")
    names = F.regexp_extract(t, r"(?U)^from\s+([\w.]+)\s+import\s+(.+)", 2)
    both = F.flatten(
        F.transform(
            _parts(names),
            lambda n: F.when(n == "*", F.when(module != "", F.array(module)).otherwise(_empty()))
            .when(module == "", F.array(n))
            .otherwise(F.array(n, F.concat(module, F.lit("."), n))),
        )
    )
    plain = _parts(F.regexp_extract(t, r"(?U)^import\s+(.+)", 1))
    return F.when(names != "", both).otherwise(plain)


def java_import(text: Column, strict: bool = True) -> Column:
    """`import [static] a.b.C;` → C, a.b.C."""
    name = F.regexp_extract(_trim(text), r"(?U)^import\s+(?:static\s+)?([\w.]+)", 1)
    wildcard = text.rlike(r"(?U)\.\*\s*;?\s*$") if strict else F.lit(False)
    return F.when((name == "") | wildcard, _empty()).otherwise(F.array(F.element_at(F.split(name, r"\."), -1), name))


def typescript_import(text: Column) -> Column:
    """`name|module` → name."""
    name = _trim(F.split_part(text, F.lit("|"), F.lit(1)))
    return F.when(name == "", _empty()).otherwise(F.array(name))


def candidates(text: Column, language: Column, strict: bool = True) -> Column:
    """By language; unknown ones count as Python."""
    return F.when(language == "java", java_import(text, strict)).when(language.isin("typescript", "tsx"), typescript_import(text)).otherwise(python_import(text, strict))
