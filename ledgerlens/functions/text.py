"""Accent-insensitive text as Column expressions, and the same in Python.

Folding means: decompose, drop combining marks, fold case.  The Column form
stays in the JVM: marks are removed, and single characters are translated by a
table that is made from the Unicode data of this Python.  Characters that fold
to several (ß, ligatures) are replaced one by one; what decomposes to several
characters beyond that list (such as Hangul) stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(text: str) -> str:
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c)).casefold()


def normalise_text(text: str) -> str:
    """Folded, with anything but word characters as single spaces."""
    return " ".join(re.sub(r"[^\w\s]+", " ", fold_text(text)).split())


def contains_term_text(haystack: str, term: str) -> bool:
    return bool(term) and re.search(rf"(?<!\w){re.escape(term)}(?!\w)", haystack) is not None


@cache
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters of one, two and more letters: (from, to, several)."""
    single, several = {}, []
    for code in range(0x41, 0x2000):
        c = chr(code)
        f = fold_text(c)
        if f != c and len(f) == 1:
            single[c] = f
    for c in ("ß", "ẞ", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "Ĳ", "ĳ", "ŉ", "Ǆ", "ǅ", "ǆ", "Ǉ", "ǈ", "ǉ", "Ǌ", "ǋ", "ǌ"):
        several.append((c, fold_text(c)))
    return "".join(single), "".join(single.values()), tuple(several)


def fold(c: Column) -> Column:
    source, target, several = _tables()
    out = F.translate(F.regexp_replace(c, r"\p{M}+", ""), source, target)
    replaced = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), several, out)
    # nothing to do for plain text, which is nearly all
    return F.when(c.rlike(r"[^\x00-\x7F]"), replaced).otherwise(F.lower(c))


def normalise(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(fold(c), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def any_term(terms) -> str:
    """A pattern for any of the (folded) terms, as whole words."""
    return r"(?U)(?<!\w)(" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?!\w)"


def strip(c: Column) -> Column:
    """Without white space at the ends; blank becomes null."""
    out = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(out != "", out)


def quoted(c: Column) -> Column:
    """A value in quotes: single ones, unless it has those and no double ones."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)
