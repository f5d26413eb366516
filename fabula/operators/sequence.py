"""Window operators over ordered nodes: buckets, pairs of neighbours, promotion, the best of a window, first of equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.values import coverage_width, is_core, phase_bucket, salience, temporal_bucket


def with_buckets(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    most = F.max(order).over(Window.partitionBy(*group))
    return rows.withColumns({"temporal": temporal_bucket(F.col(order), most), "phase": phase_bucket(F.col(order), most)})


def top_of_bucket(rows: DataFrame, group: list[str], bucket: str, order_by: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order_by))).where(F.col("rank") <= most)


def best_of_windows(cards: DataFrame, group: list[str], order: str, priority: str, score: str, role: str) -> DataFrame:
    """Of each fixed-width window of places the card to cover it: the best of score 2 or more, else of those that take part."""
    rows = cards.withColumn("_w", coverage_width(F.max(order).over(Window.partitionBy(*group))))
    rows = rows.withColumn("window", F.floor((F.col(order) - 1) / F.col("_w"))).where((F.col(score) >= 2) | (F.col(role) != "absent"))
    first = Window.partitionBy(*group, "window").orderBy(F.desc(F.col(score) >= 2), F.desc(priority), order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_w")


def first_of_equals(rows: DataFrame, keys: list, order_by: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where("_n = 1").drop("_n")


def promote_neighbours(cards: DataFrame, group: list[str], order: str, score: str, role: str) -> DataFrame:
    """A card below 2 next to one of 4 or more becomes 2, and absent becomes indirect. Promoted cards never reach 4, so the order of updates doesn't matter."""
    w = Window.partitionBy(*group).orderBy(order)
    beside = F.greatest(F.coalesce(F.lag(score).over(w), F.lit(0)), F.coalesce(F.lead(score).over(w), F.lit(0)))
    rows = cards.withColumn("_up", (F.col(score) < 2) & (beside >= 4))
    return rows.withColumns({score: F.when(F.col("_up"), 2).otherwise(F.col(score)), role: F.when(F.col("_up") & (F.col(role) == "absent"), "indirect").otherwise(F.col(role))}).drop("_up")


def transition_pairs(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Neighbouring nodes of a role in order with gap, phase label and pair score.

    nodes: node_id, scene_id, scene_order, beat_index, importance, goal_state, resulting_state, unresolved_issue,
    salient_development, n_quotes.
    """
    w = Window.partitionBy(*group).orderBy("scene_order", "beat_index", "node_id")
    most = F.max("scene_order").over(Window.partitionBy(*group))
    strength = salience(F.col("importance"), F.col("goal_state"), F.col("resulting_state"), F.col("unresolved_issue"), F.col("salient_development"), F.col("n_quotes"))
    rows = nodes.withColumns({"phase": phase_bucket(F.col("scene_order"), most), "salience": strength})
    fields = ["node_id", "scene_id", "scene_order", "importance", "goal_state", "resulting_state", "unresolved_issue", "salient_development", "phase", "salience"]
    node = F.struct(*fields)
    pairs = rows.select(*group, node.alias("a"), F.lead(node).over(w).alias("b")).where("b IS NOT NULL")
    one = lambda c: F.when(c, 1).otherwise(0)
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    core_a, core_b = is_core(F.col("a.importance")), is_core(F.col("b.importance"))
    gap = F.greatest(F.lit(0), F.col("b.scene_order") - F.col("a.scene_order"))
    change = F.col("a.phase") != F.col("b.phase")
    states = ("goal_state", "resulting_state", "unresolved_issue")
    development = lambda p: F.length(F.trim(F.coalesce(F.col(f"{p}.salient_development"), F.lit(""))))
    sparse = lambda p: ~is_core(F.col(f"{p}.importance")) & ~(has(f"{p}.{states[0]}") | has(f"{p}.{states[1]}") | has(f"{p}.{states[2]}")) & (development(p) < 70)
    anchored = has("a.resulting_state") | has("b.goal_state") | has("b.resulting_state") | has("b.unresolved_issue")
    score = (
        2 * one(core_a | core_b) + one(core_a & core_b) + F.greatest("a.salience", "b.salience") + one(has("a.resulting_state")) + one(has("b.goal_state"))
        + one(has("b.resulting_state")) + one(has("b.unresolved_issue")) + one(change) + one(gap.between(2, 12)) - one(~core_a & ~core_b) - one(gap > 12)
        - one((gap <= 1) & ~change) - one(sparse("a") & sparse("b"))
    )
    label = F.when(change, F.concat("a.phase", F.lit("->"), "b.phase")).otherwise(F.col("a.phase"))
    return pairs.select(
        *group, F.col("a.node_id").alias("prev_id"), F.col("b.node_id").alias("next_id"), F.col("a.scene_order").alias("prev_order"), F.col("b.scene_order").alias("next_order"), gap.alias("scene_gap"), label.alias("phase_label"),
        F.col("a.phase").alias("prev_phase"), F.col("b.phase").alias("next_phase"), score.alias("pair_score"), anchored.alias("anchored"), core_a.alias("prev_core"), core_b.alias("next_core"),
    )
