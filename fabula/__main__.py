"""Command lines: python -m fabula COMMAND. Every command works on all movies it is given at once and writes folders of JSON rows."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.plans import beat_story, evaluation, jobs, prompts, providers, repairs, roleplay, timeline
from fabula.sources import readers, sinks

COMMANDS: dict[str, Callable] = {}


def command(f: Callable) -> Callable:
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


def provider_of(name: str) -> Callable[[], providers.Provider]:
    """offline, or module:callable that makes a provider in each task."""
    if name == "offline":
        return providers.Offline
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _roles(spark: SparkSession, a) -> DataFrame:
    found = readers.focal_roles(spark, a.input, ["task_1_character_timelines.json", "roles.json"])
    return found.withColumn("aliases", F.array().cast("array<string>"))


@command
def build(spark: SparkSession, a) -> DataFrame:
    """Timelines by role cards and milestones (--narrow: the narrow selection; --beats: from beats; --retrieval: from retrieved scenes)."""
    scenes, roles, provider = readers.scenes(spark, f"{a.input}/*/script.json"), _roles(spark, a), provider_of(a.provider)
    if a.beats:
        parts = beat_story.build(scenes, roles, provider)
    elif a.retrieval:
        parts = timeline.build_by_retrieval(scenes, roles, provider)
    else:
        parts = timeline.build(scenes, roles, provider, wide=not a.narrow)
    sinks.write_artifacts(parts, a.output)
    return spark.read.json(f"{a.output}/nodes") if not parts["nodes"].isEmpty() else parts["nodes"]


def _side(spark: SparkSession, path: str, timelines: str, arcs: str) -> dict[str, DataFrame]:
    rows = readers.timeline_nodes(spark, f"{path}/*/{timelines}")
    roles = rows.select("movie_id", "language", F.col("character_name").alias("character"), "aliases", F.col("role_pos").alias("pos"), "timeline_summary").distinct()
    nodes = rows.where("node IS NOT NULL").select("movie_id", F.col("character_name").alias("character"), F.col("node_pos").alias("pos"), "node.*")
    return {"roles": roles, "nodes": nodes, "arcs": readers.arcs(spark, f"{path}/*/{arcs}").withColumnRenamed("character_name", "character")}


@command
def evaluate(spark: SparkSession, a) -> DataFrame:
    """Predicted timelines and arcs (--output) against the gold ones (--input)."""
    names = ("task_1_character_timelines.json", "task_1_cross_scene_arcs.json")
    out = evaluation.evaluate(_side(spark, a.input, *names), _side(spark, a.output, *(f"pred_{n}" for n in names)), readers.scenes(spark, f"{a.input}/*/script.json"), provider_of(a.provider))
    sinks.write_artifacts({f"eval_{k}": v for k, v in out.items()}, a.output)
    return out["summary"]


@command
def repair(spark: SparkSession, a) -> DataFrame:
    """Mend finished timelines: quotes, goals, summaries, arcs of roles without any."""
    side = _side(spark, a.input, "task_1_character_timelines.json", "task_1_cross_scene_arcs.json")
    roles = side["roles"].select("movie_id", "language", "character", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "timeline_summary")
    rows = side["nodes"].join(roles.drop("timeline_summary"), ["movie_id", "character"]).withColumn("title", F.col("scene_title"))
    parts = repairs.movie(rows, roles.drop("aliases"), side["arcs"], readers.scenes(spark, f"{a.input}/*/script.json"), provider_of(a.provider))
    sinks.write_artifacts(parts, a.output)
    return parts["changes"]


@command
def single_turn(spark: SparkSession, a) -> DataFrame:
    """One-turn role play in each mode, judged."""
    provider = provider_of(a.provider)
    samples, assets = readers.single_turn(spark, f"{a.input}/*/*single_turn.json"), readers.role_assets(spark, f"{a.input}/*/*role_assets.json")
    runs = None
    for mode in a.modes:
        part = roleplay.single_turn(samples, assets, mode, provider, a.top_k)
        runs = part if runs is None else runs.unionByName(part)
    keys = ["movie_id", "character", "language", "instance_id", "mode"]
    none = F.array().cast("array<string>")
    judged = roleplay.judge(runs.select(*keys, F.col("input.current_user_turn").alias("question"), "answer", F.coalesce("reference.supporting_facts", none).alias("facts"), F.coalesce("reference.contradicting_facts", none).alias("forbidden")), prompts.SINGLE_TURN_METRICS, keys, provider)
    out = runs.join(evaluation.judged(judged, keys), keys)
    sinks.write_results(out, a.output, ["mode", "language", "movie_id", "character"])
    return out.select(*keys, "core_score", "hit_at_k", "recall_at_k")


@command
def multi_turn(spark: SparkSession, a) -> DataFrame:
    """Episodes in each mode, judged as a whole and turn by turn."""
    provider = provider_of(a.provider)
    rows, assets = readers.episodes(spark, f"{a.input}/*/*multi_turn.json"), readers.role_assets(spark, f"{a.input}/*/*role_assets.json")
    turns = None
    for mode in a.modes:
        part = roleplay.episodes(rows, assets, mode, provider, a.top_k)
        turns = part if turns is None else turns.unionByName(part)
    sinks.write_artifacts({"turns": turns}, a.output)
    out = roleplay.episode_scores(spark.read.schema(turns.schema).json(f"{a.output}/turns"), provider)
    sinks.write_results(out, f"{a.output}/scores", ["language", "movie_id", "character", "mode"])
    return out


@command
def matrix(spark: SparkSession, a) -> DataFrame:
    """Means by mode, role, and role and mode of what multi-turn wrote."""
    rows = spark.read.json(f"{a.input}/scores").withColumn("status", F.lit("finished"))
    out = jobs.summary(rows, "core_score")
    sinks.write_status(rows, out, a.output)
    return out


@command
def rejudge(spark: SparkSession, a) -> DataFrame:
    """Judge written episodes again by one metric and bring the status rows up to date."""
    turns = spark.read.json(f"{a.input}/turns")
    fresh = roleplay.episode_scores(turns, provider_of(a.provider), [a.metric])
    keys = ["movie_id", "character", "language", "id", "mode"]
    rows = spark.read.json(f"{a.input}/scores").select(*keys, "core_score").withColumn("status", F.lit("finished"))
    out = sinks.refreshed(rows, fresh.select(*keys, "core_score"), keys, ["core_score"])
    sinks.write_status(out, jobs.summary(out, "core_score"), a.output)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fabula", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--provider", default="offline", help=provider_of.__doc__)
        if name == "build":
            for flag in ("narrow", "beats", "retrieval"):
                p.add_argument(f"--{flag}", action="store_true")
        if name in ("single-turn", "multi-turn"):
            p.add_argument("--modes", nargs="+", default=list(roleplay.MODES), choices=roleplay.MODES)
            p.add_argument("--top-k", type=int, default=4)
        if name == "rejudge":
            p.add_argument("--metric", default="cross_turn_consistency", choices=prompts.MULTI_TURN_METRICS)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    return COMMANDS[a.command](spark or SparkSession.builder.appName(f"fabula {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main().show(50, truncate=80)
