"""Similarities, weights and scores as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the ranking.
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.85, "low": 0.7}
KIND_FACTOR = {"function": 1.15, "type": 1.15, "endpoint": 1.15, "config": 1.15, "module": 0.85, "service": 0.85, "concept": 0.85}
CATEGORY_FACTOR = {"behavior": 1.0, "pattern": 1.0, "convention": 1.0, "constraint": 0.95, "risk": 0.8, "debt": 0.7}
STRENGTH_FACTOR = {"strong": 1.0, "moderate": 0.7, "weak": 0.4}
NEIGHBOUR_FACTOR = {"strong": 0.35, "moderate": 0.25, "weak": 0.15}
GRAPH_WEIGHT = {"calls": 3.0, "implements": 2.5, "depends_on": 2.0, "owns": 1.5, "imports": 1.0}
RRF_K = 60
#: Confidence of an edge by its strength, within a repository and between two, and what strength adds to a stated one.
STRENGTH_CONFIDENCE = {"strong": 0.9, "moderate": 0.75, "weak": 0.55}
CROSS_REPO_CONFIDENCE = {"strong": 0.75, "moderate": 0.65, "weak": 0.5}
STRENGTH_STEP = {"strong": 0.05, "weak": -0.05}
#: Weights of the quality components, and dollars for a million tokens in and out.
QUALITY_WEIGHTS = {"entity_cov": 0.3, "fact_density": 0.2, "rel_connect": 0.2, "dim_coverage": 0.15, "parse_rate": 0.15}
TOKEN_PRICES = {"opus": (15.0, 75.0), "sonnet": (3.0, 15.0)}


def by_value(value: Column, factors: dict[str, float], other: float | None = 1.0) -> Column:
    out: Column | None = None
    for name, factor in factors.items():
        out = F.when(value == name, F.lit(factor)) if out is None else out.when(value == name, F.lit(factor))
    assert out is not None
    return out if other is None else out.otherwise(F.lit(other))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a name, with two blanks before and one after, in lower case."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def rrf(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.lit(weight) / (F.lit(float(k)) + rank)


def relation_confidence(base: Column, strength: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + by_value(strength, STRENGTH_STEP, 0.0)))


def strength_to_confidence(strength: Column, cross_repo: bool = False) -> Column:
    return by_value(strength, CROSS_REPO_CONFIDENCE if cross_repo else STRENGTH_CONFIDENCE, None)


def confidence_to_strength(confidence: Column) -> Column:
    return F.when(confidence == "high", "strong").when(confidence == "moderate", "moderate").otherwise("weak")


def quality_scores(total: Column, excluded: Column, with_facts: Column, with_rels: Column, facts: Column, dimensions: Column, ok_jobs: Column, jobs: Column) -> dict[str, Column]:
    """The five components in percent and their weighted mean; entities that cannot carry facts are ``excluded``."""
    real = F.greatest(F.lit(0), total - excluded)
    share = lambda part: F.when(real > 0, F.least(F.lit(1.0), part / real) * 100).otherwise(F.lit(0.0))
    per = facts / real
    density = F.when(per < 1.5, per / 1.5 * 100).when(per > 8, F.greatest(F.lit(50.0), 100 - (per - 8) * 6.25)).otherwise(F.lit(100.0))
    out = {
        "entity_cov": share(with_facts),
        "fact_density": F.when(real > 0, density).otherwise(F.lit(0.0)),
        "rel_connect": share(with_rels),
        "dim_coverage": dimensions / 4 * 100,
        "parse_rate": F.when(jobs > 0, ok_jobs / jobs * 100).otherwise(F.lit(100.0)),
    }
    overall = sum((out[name] * weight for name, weight in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return {**out, "overall": F.greatest(F.lit(0.0), F.least(F.lit(100.0), overall))}


def job_cost(tokens_in: Column, tokens_out: Column, model: str = "sonnet") -> Column:
    each = TOKEN_PRICES.get(model, TOKEN_PRICES["sonnet"])
    return (tokens_in / 1e6 * each[0] + tokens_out / 1e6 * each[1]).cast("decimal(10,6)")


def prompt_budget(context: Column, reserved: Column, static_chars: Column) -> Column:
    return F.greatest(F.lit(512), context - reserved - F.floor(static_chars / 4)) * 4


def output_budget(symbols: Column, context: Column) -> Column:
    return F.least(4096 + 300 * symbols, F.floor(context * 2 / 5))
