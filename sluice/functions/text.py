"""Text features as Spark columns; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx

BLANK_LINE = "\n\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_hit(text: Column | str, words: Sequence[str]) -> Column:
    """True when any word occurs as a substring, ignoring case."""
    low = F.lower(_col(text))
    return reduce(or_, [low.contains(w.lower()) for w in words])


def truncate(text: Column | str, chars: int) -> Column:
    return F.substring(_col(text), 1, chars)


def excerpt(text: Column | str, chars: int = 240) -> Column:
    return F.translate(truncate(text, chars), "\n", " ")


def prefix(text: Column | str) -> Column:
    """Text before the first blank line, or all of it."""
    return F.substring_index(_col(text), BLANK_LINE, 1)


def tail(text: Column | str) -> Column:
    """Text after the first blank line, or all of it."""
    t = _col(text)
    at = F.instr(t, BLANK_LINE)
    return F.when(at > 0, F.substr(t, at + len(BLANK_LINE))).otherwise(t)


def non_ascii_rate(text: Column | str) -> Column:
    """Share of characters above code point 127; 0 for empty text."""
    t = _col(text)
    outside = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(outside / F.length(t))


def error_category(text: Column | str, probe_source: Column | None = None) -> Column:
    """First matching category of a missed positive.

    ``probe_source`` marks rows from a source where the word *instruction* alone
    already means an instruction probe.
    """
    t = F.lower(_col(text))
    names, pats = lx.CATEGORY_NAMES, lx.CATEGORY_PATTERNS
    from_probe_source = F.lit(False) if probe_source is None else probe_source
    chain = F.when(from_probe_source & t.contains("instruction"), names["probe"])
    for key in ["extraction", "override", "probe", "format", "wrapper"]:
        chain = chain.when(t.rlike(pats[key]), names[key])
    foreign = (non_ascii_rate(text) > 0.05) | t.rlike(pats["foreign"])
    chain = chain.when(foreign, names["foreign"])
    return chain.when(t.rlike(pats["pressure"]), names["pressure"]).otherwise(names["default"])


def lexicon_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """How many lexicon terms occur in the lower-cased text.

    The text is lower-cased once: a one-element array binds it for all terms.
    """

    def hits(lowered: Column) -> Column:
        total = F.lit(0)
        for term in terms:
            total = total + lowered.contains(term).cast("int")
        return total

    bound = F.transform(F.array(F.lower(_col(text))), hits)
    return F.coalesce(F.get(bound, F.lit(0)), F.lit(0))


def lexicon_density(text: Column | str, terms: Sequence[str]) -> Column:
    """Share of the lexicon found in the part of the text before a blank line."""
    return lexicon_hits(prefix(text), terms) / F.lit(max(1, len(terms))).cast("double")
