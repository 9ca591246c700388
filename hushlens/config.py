"""Configuration: YAML file or categories table -> frozen objects on the driver.

The lexicon is small by nature (categories, terms and hints of a rule set); MAX_CATEGORIES and MAX_TERMS bound it, so it can be
part of query plans as literals. It is normalised once here, not once per sentence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .functions import plain

MAX_CATEGORIES = 500
MAX_TERMS = 20_000

#: Order of methods; ties in score go to the later one.
METHODS = ("lexical", "fuzzy", "linguistic", "semantic", "presidio")
NORMALIZATION = ("lowercase", "strip_accents", "collapse_whitespace", "normalize_apostrophes", "normalize_dashes")


@dataclass(frozen=True)
class Term:
    """One lexical term of a category, normalised."""

    cat_ord: int
    term_ord: int
    term: str
    norm: str
    tokens: tuple[str, ...]
    roots: tuple[str, ...]


@dataclass(frozen=True)
class Category:
    cat_ord: int
    key: str
    label: str
    description: str = ""
    terms: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    context_terms: tuple[str, ...] = ()
    field_hints: tuple[str, ...] = ()
    semantic_anchors: tuple[str, ...] = ()
    thresholds: Mapping[str, float] = field(default_factory=dict)
    weights: Mapping[str, float] = field(default_factory=dict)

    @property
    def lexical_terms(self) -> tuple[str, ...]:
        """Terms, then synonyms, the first of equal strings kept."""
        return tuple(dict.fromkeys((*self.terms, *self.synonyms)))

    def lexicon(self) -> list[Term]:
        """Terms that do not normalise to nothing."""
        out = []
        for n, term in enumerate(self.lexical_terms):
            norm = plain.normalize(term)
            if norm:
                tokens = tuple(plain.tokens(norm))
                out.append(Term(self.cat_ord, n, term, norm, tokens, tuple(plain.root(t) for t in tokens)))
        return out


@dataclass(frozen=True)
class Config:
    categories: tuple[Category, ...]
    language: str = "fr"
    normalization: Mapping[str, bool] = field(default_factory=dict)
    fuzzy: Mapping[str, Any] = field(default_factory=dict)
    linguistics: Mapping[str, Any] = field(default_factory=dict)
    semantic: Mapping[str, Any] = field(default_factory=dict)
    scoring: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.categories) > MAX_CATEGORIES or sum(len(c.lexical_terms) for c in self.categories) > MAX_TERMS:
            raise ValueError(f"more than {MAX_CATEGORIES} categories or {MAX_TERMS} terms")

    def lexicon(self) -> list[Term]:
        return [t for c in self.categories for t in c.lexicon()]

    @property
    def fuzzy_threshold(self) -> int:
        return int(self.fuzzy.get("similarity_threshold", 88))

    @property
    def fuzzy_delta(self) -> int:
        return int(self.fuzzy.get("max_ngram_length_delta", 1))

    @property
    def semantic_threshold(self) -> float:
        return float(self.semantic.get("similarity_threshold", 0.62))

    def weight(self, category: Category, method: str) -> float:
        return float({**self.scoring.get("method_weights", {}), **category.weights}.get(method, 0.0))

    def threshold(self, category: Category, decision: str) -> float:
        default = {"alert": 0.75, "review": 0.45}[decision]
        return float(category.thresholds.get(decision, self.scoring.get(f"{decision}_threshold", default)))

    def with_(self, **changes: Any) -> Config:
        return replace(self, **changes)


# Weights and thresholds where a configuration names none, as in the published documentation of the scoring scheme.
DEFAULT_SCORING = {"alert_threshold": 0.75, "review_threshold": 0.45, "method_weights": {"lexical": 0.40, "fuzzy": 0.25, "linguistic": 0.20, "semantic": 0.30, "presidio": 0.15}}

_LISTS = ("terms", "synonyms", "context_terms", "field_hints", "semantic_anchors")


def category_of(raw: Mapping[str, Any], cat_ord: int) -> Category:
    """A category from a mapping; key and label must be there."""
    return Category(
        cat_ord, raw["key"], raw["label"], raw.get("description", ""),
        **{name: tuple(raw.get(name, ()) or ()) for name in _LISTS},
        thresholds=dict(raw.get("thresholds", {}) or {}), weights=dict(raw.get("weights", {}) or {}),
    )


def config_of(raw: Mapping[str, Any]) -> Config:
    sections = {name: raw.get(name, {}) or {} for name in ("normalization", "fuzzy", "linguistics", "semantic", "scoring")}
    return Config(tuple(category_of(c, n) for n, c in enumerate(raw.get("categories", ()))), raw.get("language", "fr"), **sections)


def load_config(path: str | Path) -> Config:
    """A YAML configuration file."""
    import yaml

    with open(path, encoding="utf-8") as lines:
        return config_of(yaml.safe_load(lines) or {})


def from_table(rows: Sequence[Any], scoring: Mapping[str, Any] = DEFAULT_SCORING, **sections: Any) -> Config:
    """Categories from collected rows of a categories table, in the order of cat_ord."""
    ordered = sorted((r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows), key=lambda r: r["cat_ord"])
    return Config(tuple(category_of(r, r["cat_ord"]) for r in ordered), scoring=scoring, **sections)
