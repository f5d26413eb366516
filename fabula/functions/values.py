"""Scores, flags, vectors, sets and buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLY, MIDDLE, LATE = "early", "middle", "late"


def score_clamp(c: Column, least: int = 1, most: int = 5) -> Column:
    """A judge's score as an integer between the bounds; null and unreadable are the least; halves go to the even number."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.bround(c.try_cast("double"), 0).cast("int"), F.lit(least))))


def enum_clamp(c: Column, allowed: list[str], default: str) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(allowed), x).otherwise(default)


def parse_bool(c: Column) -> Column:
    """A judge's answer: true, yes, 1 or false, no, 0 alone, else whether it has true and no false."""
    x = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(x.isin("true", "yes", "1"), True).when(x.isin("false", "no", "0"), False).otherwise(F.contains(x, F.lit("true")) & ~F.contains(x, F.lit("false")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    """The vector at length one; a vector of hardly any length is divided by `least`."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def unit_or_zero(a: Column, least: float = 1e-12) -> Column:
    """The vector at length one; of hardly any length, all zeros."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > least, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of other sizes and vectors without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """part over whole, which counts as one at least."""
    return part / F.greatest(F.lit(1), whole)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def temporal_bucket(order: Column, most: Column) -> Column:
    """early, middle or late by place between first and last; middle where there is one place only."""
    place = (F.greatest(F.lit(1), order) - 1) / F.greatest(F.lit(1), most - 1)
    return F.when(most <= 1, MIDDLE).when(place < 0.34, EARLY).when(place < 0.67, MIDDLE).otherwise(LATE)


def phase_bucket(order: Column, most: Column) -> Column:
    """The other formula, for predicted nodes: by share of the last place, bounds included."""
    return F.when(most <= 0, MIDDLE).when(order / most <= 0.34, EARLY).when(order / most <= 0.67, MIDDLE).otherwise(LATE)


def coverage_width(most: Column) -> Column:
    return F.when(most >= 54, 3).when(most >= 24, 2).otherwise(1)


def node_budget(n: Column, medium: Column, high: Column, active: Column) -> Column:
    """Milestones of a role, 9 to 14: one more for each of 18 and 30 cards, 8 medium, 5 high and 12 active ones."""
    more = [n >= 18, n >= 30, medium >= 8, high >= 5, active >= 12]
    return F.least(F.lit(14), sum((F.when(c, 1).otherwise(0) for c in more), F.lit(9)))


def node_budget_wide(n: Column, medium: Column, high: Column, very_high: Column, active: Column) -> Column:
    """The wide variant, 20 to 24."""
    more = [n >= 18, n >= 28, n >= 40, medium >= 10, high >= 8, very_high >= 5, active >= 16]
    return F.least(F.lit(24), sum((F.when(c, 1).otherwise(0) for c in more), F.lit(20)))


# Points of a candidate's kind of change.
CHANGE_POINTS = {"status_win": 4, "injury_or_loss": 4, "career_move": 3, "legal_or_addiction_setback": 3, "explicit_decision": 3, "relationship_shift": 2, "family_conflict": 2, "reconciliation": 2, "other": 0}


def rank_score(score: Column, change_type: Column, n_quotes: Column, development: Column, goal: Column, result: Column) -> Column:
    """A candidate's rank: its score, its kind of change, and one each for quotes, a development of over 40 letters, a goal and a result."""
    points = F.coalesce(*(F.when(change_type == k, v) for k, v in CHANGE_POINTS.items()), F.lit(0))
    return score + points + F.when(n_quotes > 0, 1).otherwise(0) + F.when(F.length(development) > 40, 1).otherwise(0) + F.when(F.trim(goal) != "", 1).otherwise(0) + F.when(F.trim(result) != "", 1).otherwise(0)


def is_core(importance: Column) -> Column:
    return F.lower(F.trim(F.coalesce(importance, F.lit("")))) == "core"


def salience(importance: Column, goal: Column, result: Column, issue: Column, development: Column, n_quotes: Column) -> Column:
    """0 to 7: core 2; goal, result and open issue 1 each; a development of 80 letters or more 1; two quotes 1."""
    one = lambda c: F.when(c, 1).otherwise(0)
    filled = lambda c: one(F.trim(F.coalesce(c, F.lit(""))) != "")
    return 2 * one(is_core(importance)) + filled(goal) + filled(result) + filled(issue) + one(F.length(F.coalesce(development, F.lit(""))) >= 80) + one(n_quotes >= 2)
