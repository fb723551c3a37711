"""Keyword categories with overrides and exclusions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from newsgauge import fixed_values as fixed

DEFAULTS = {
    "climate": fixed.CLIMATE_TERMS,
    "policy": fixed.POLICY_TERMS,
    "uncertainty": fixed.UNCERTAINTY_TERMS,
    "reversal": fixed.REVERSAL_TERMS,
    "implementation": fixed.IMPLEMENTATION_TERMS,
    "upside": fixed.UPSIDE_TERMS,
    "regime_ira": fixed.REGIME_IRA_TERMS,
    "regime_obbba": fixed.REGIME_OBBBA_TERMS,
    "trade": fixed.TRADE_TERMS,
    "monetary": fixed.MONETARY_TERMS,
}

# Category -> flag column of a classified article.
FLAGS = {
    "uncertainty": "has_uncertainty",
    "reversal": "has_reversal_terms",
    "implementation": "has_implementation_terms",
    "upside": "has_upside_terms",
    "regime_ira": "has_ira_mention",
    "regime_obbba": "has_obbba_mention",
}


@dataclass(frozen=True)
class Lexicon:
    """Term lists by category; an empty override keeps the default list."""

    overrides: dict[str, Sequence[str]] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()

    def terms(self, category: str) -> list[str]:
        if category not in DEFAULTS:
            raise ValueError(f"unknown term category: {category}")
        base = self.overrides.get(category) or DEFAULTS[category]
        dropped = {term.lower() for term in self.excluded}
        return [term for term in base if term.lower() not in dropped]

    def without(self, *terms: str) -> Lexicon:
        return replace(self, excluded=(*self.excluded, *terms))

    def vocabulary(self, *categories: str) -> list[str]:
        return [t for c in categories for t in self.terms(c)]


DEFAULT_LEXICON = Lexicon()
