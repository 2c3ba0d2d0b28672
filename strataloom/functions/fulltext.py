"""Boolean word search as Columns: required, excluded, prefix and phrase terms."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = re.compile(r'([+-]?)(?:"([^"]*)"|([^\s"+-]+))')
WORD = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class Term:
    sign: str
    words: tuple[str, ...]
    prefix: bool


def boolean_query(text: str | None) -> list[Term]:
    """The terms of a search text. Of a text that uses + - or *, the terms it marks (and quoted phrases); of any other every blank-delimited word, required. A blank text has none."""
    asked = (text or "").strip()
    marked = TERM.findall(asked) if any(c in asked for c in "+-*") else [("+", word, "") for word in asked.split()]
    found = []
    for sign, phrase, word in marked:
        words = tuple(w.lower() for w in re.split(r"[^\w]+", phrase or word) if w)
        if words:
            found.append(Term(sign, words, word.endswith("*")))
    return found


def tokens(*columns: Column) -> Column:
    """The lower-cased words of the columns in order; nulls are skipped."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), WORD), lambda w: w != "")


def holds(term: Term, words: Column) -> Column:
    if term.prefix:
        return F.exists(words, lambda w: w.startswith(term.words[0]))
    if len(term.words) == 1:
        return F.array_contains(words, term.words[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(term.words)} "))


def matches(query: list[Term], words: Column) -> Column:
    """Whether a row's words meet the query: every + term, no - term, and one of the plain terms where there is no + term. A query without terms matches nothing, and neither does one of excluded terms only."""
    must, never, may = ([t for t in query if t.sign == s] for s in ("+", "-", ""))
    if not must and not may:
        return F.lit(False)
    wanted = [holds(t, words) for t in must] or [reduce(lambda a, b: a | b, [holds(t, words) for t in may])]
    return reduce(lambda a, b: a & b, wanted + [~holds(t, words) for t in never])


def relevance(query: list[Term], words: Column) -> Column:
    """How many words of the row are words of the query's wanted terms."""
    wanted = sorted({w for t in query if t.sign != "-" for w in t.words})
    return F.size(F.filter(words, lambda w: w.isin(*wanted))).cast("long") if wanted else F.lit(0).cast("long")
