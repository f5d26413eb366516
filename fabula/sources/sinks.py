"""Writers: release forms, partitioned results, status snapshots, dead letters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text as T


def release_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes in their public form: internal fields gone, scene ids counted from one, document ids rebuilt where the beat is known."""
    public = T.public_scene_id("scene_id")
    document = F.when(F.col("beat_index").isNotNull() & F.col("scene_id").rlike("^[0-9]+$"), F.concat(F.lit("scene_"), public, F.lit("_beat_"), F.col("beat_index"))).otherwise(F.regexp_replace("document_id", r"^scene_\d+", F.concat(F.lit("scene_"), public)))
    return nodes.withColumns({"document_id": document, "scene_id": public}).drop("importance", "beat_index", "beat_heading")


def release_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.drop("linked_scene_ids")


def _in_order(rows: DataFrame, group: list[str], order: list[str], fields: list[str], out: str) -> DataFrame:
    """One row a group with its rows as an array of structs in order."""
    item = F.struct(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), F.struct(*fields).alias("x"))
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias(out))


def timeline_files(roles: DataFrame, nodes: DataFrame, version: str) -> DataFrame:
    """One row a movie, nested as the timeline files are. roles: movie_id, language, character, aliases, selection_reason, pos, timeline_summary; nodes in public or internal form."""
    fields = [c for c in nodes.columns if c not in ("movie_id", "character", "language", "pos", "ordinal")]
    listed = _in_order(nodes, ["movie_id", "character"], ["scene_order", "timeline_node_id"], fields, "timeline_nodes")
    told = roles.join(listed, ["movie_id", "character"], "left").withColumn("timeline_nodes", F.coalesce("timeline_nodes", F.array().cast(listed.schema["timeline_nodes"].dataType)))
    told = told.withColumn("character_name", F.col("character"))
    movies = _in_order(told, ["movie_id", "language"], ["pos", "character"], ["character_name", "aliases", "selection_reason", "timeline_nodes", "timeline_summary"], "focal_character_timelines")
    count = F.aggregate("focal_character_timelines", F.lit(0), lambda n, t: n + F.size(t["timeline_nodes"]))
    return movies.withColumns({"task_version": F.lit(version), "build_summary": F.struct(F.size("focal_character_timelines").alias("selected_focal_character_count"), count.alias("timeline_node_count"))})


def arc_files(arcs: DataFrame, languages: DataFrame, version: str) -> DataFrame:
    """One row a movie, nested as the arc files are. languages: movie_id, language of every movie, with arcs or not."""
    fields = ["arc_id", "character_name", "title", "arc_focus", "linked_timeline_node_ids", "arc_summary", "start_state", "end_state", "unresolved_issue"]
    listed = _in_order(arcs.withColumn("character_name", F.col("character")), ["movie_id"], ["character", "pos"], fields, "cross_scene_arcs")
    out = languages.join(listed, "movie_id", "left").withColumn("cross_scene_arcs", F.coalesce("cross_scene_arcs", F.array().cast(listed.schema["cross_scene_arcs"].dataType)))
    return out.withColumns({"task_version": F.lit(version), "build_summary": F.struct(F.size("cross_scene_arcs").alias("arc_count"))})


# The reasons that releases give for roles that come from a list.
LISTED = {"en": "provided externally via Task 3 role list", "zh": "由 Task 3 角色列表提供"}


def canonical_reason(reason: str, language: str):
    """The one wording of a release for reasons that speak of the role list; other reasons stay."""
    c = F.col(reason)
    own = F.when(F.lower(F.trim(F.col(language))) == "zh", LISTED["zh"]).otherwise(LISTED["en"])
    return F.when(F.contains(F.lower(c), F.lit("task3")), own).otherwise(c)


def release(roles: DataFrame, nodes: DataFrame, arcs: DataFrame, path: str, version: str = "v1") -> None:
    """The public files of all movies: a folder a movie, timelines and arcs apart, replaced as a whole."""
    roles = roles.withColumn("selection_reason", canonical_reason("selection_reason", "language"))
    languages = roles.select("movie_id", "language").distinct()
    write_results(timeline_files(roles, release_nodes(nodes), version), f"{path}/timelines", ["movie_id"])
    write_results(arc_files(release_arcs(arcs), languages, version), f"{path}/arcs", ["movie_id"])


def write_artifacts(parts: dict[str, DataFrame], path: str) -> None:
    """Every artifact of a build under its own name; what is written already is kept up to date by writing again."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def refreshed(rows: DataFrame, outputs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Job rows with the fields of finished ones as their outputs have them now; others, and those without an output, stay."""
    new = outputs.select(*keys, F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = rows.join(new, keys, "left")
    done = F.coalesce("_there", F.lit(False)) & F.trim("status").isin("finished", "skipped_finished")
    return both.withColumns({f: F.when(done, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_there", *(f"_{f}" for f in fields))


def write_results(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON rows in a folder for each value of the given columns; only the partitions that rows touch are replaced."""
    names = {c: T.safe_name(c) for c in by}
    rows.withColumns({f"{c}_dir": n for c, n in names.items()}).repartition(*(f"{c}_dir" for c in by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(f"{c}_dir" for c in by)).json(path)


def write_status(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A snapshot of job rows and their summary."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.withColumn("updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").json(f"{path}/summary")


def write_dead_letters(rows: DataFrame, path: str, status: str = "status") -> None:
    """Failed and timed out rows, appended."""
    rows.where(F.col(status).isin("failed", "timeout")).withColumn("logged", F.current_timestamp()).write.mode("append").json(path)


def report(summary: DataFrame, title: str) -> str:
    """A Markdown table of a summary (a few rows: one a group)."""
    names = summary.columns
    shown = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    body = [f"| {' | '.join(shown(r[c]) for c in names)} |" for r in summary.collect()]
    return "\n".join([f"# {title}", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *body, ""])


def write_report(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
