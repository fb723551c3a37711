"""Text normalisation and term matching, as JVM-side expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, listed because Java's \s is ASCII-only.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# Inside of a character class: letters, digits, underscore.
WORD = r"\p{L}\p{N}_"


def normalize_text(text: Column) -> Column:
    """Lower case, white space collapsed to single blanks, NULL as the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


def join_text(*parts: Column) -> Column:
    """Normalised concatenation of several text columns."""
    return normalize_text(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def normalize_term(term: str) -> str:
    return " ".join(term.lower().split())


def word_terms(terms: Iterable[str]) -> list[str]:
    """The normalised terms that are one plain word each, without repeats."""
    plain = (normalize_term(t) for t in terms)
    return list(dict.fromkeys(t for t in plain if re.fullmatch(r"\w+", t)))


def present_words(text: Column, terms: Iterable[str]) -> Column:
    """Which one-word terms occur in a normalised text.

    The text is tokenised once and intersected with the whole vocabulary through a hash set, so
    the cost does not grow with the number of terms; everything later looks at this short array.
    """
    words = word_terms(terms)
    if not words:
        return F.array().cast("array<string>")
    return F.array_intersect(F.array(*map(F.lit, words)), F.split(text, f"[^{WORD}]+"))


def _edge(char: str, behind: bool) -> str:
    """Word boundary next to ``char``: the neighbour must be of the other kind."""
    sign = "!" if re.match(r"\w", char) else "="
    return f"(?{'<' if behind else ''}{sign}[{WORD}])"


def term_present(text: Column, words: Column, term: str) -> Column:
    """Does one term occur? Phrases match as substrings, everything else as whole words."""
    term = normalize_term(term)
    if " " in term:
        return text.contains(term)
    if re.fullmatch(r"\w+", term):
        return F.array_contains(words, term)
    if not term:
        return F.lit(False)
    escaped = re.sub(r"([^\w])", r"\\\1", term)
    return text.rlike(_edge(term[0], True) + escaped + _edge(term[-1], False))


def any_term(text: Column, words: Column, terms: Sequence[str]) -> Column:
    """Does at least one of the terms occur?"""
    plain = word_terms(terms)
    rest = [t for t in dict.fromkeys(map(normalize_term, terms)) if t not in plain]
    hit = F.lit(False)
    if plain:
        hit = F.arrays_overlap(words, F.array(*map(F.lit, plain)))
    for term in rest:
        hit = hit | term_present(text, words, term)
    return hit


def matched_terms(text: Column, words: Column, terms: Sequence[str]) -> Column:
    """Array of the terms that occur, spelled and ordered as in the lexicon."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(term_present(text, words, t), F.lit(t)) for t in terms])
    )


def search_query(*groups: Sequence[str]) -> str:
    """Boolean search text: OR inside a group, AND between groups, phrases quoted with plus signs."""
    def spell(term: str) -> str:
        return '"' + term.replace(" ", "+") + '"' if " " in term else term

    return " AND ".join("(" + " OR ".join(map(spell, g)) + ")" for g in groups if g)


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-256 over the parts joined with a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)
