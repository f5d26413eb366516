"""Readers: one row for each element of a file, with the movie and language that its path says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.sources import schemas as S


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole JSON files (each fits in a task), with path, file name, folder and language."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    rows = rows.withColumns({"file": F.element_at(parts, -1), "movie_id": F.element_at(parts, -2)})
    return rows.withColumn("language", language_of(F.col("movie_id"))).withColumn("value", F.regexp_replace("value", "^﻿", ""))


def language_of(folder: Column) -> Column:
    """zh for folders that start with ch, else en."""
    return F.when(F.lower(folder).startswith("ch"), "zh").otherwise("en")


def scenes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Screenplays: movie_id, language, scene_order from 1, scene_id (the file's, else the place from 0), title, subtitle, content."""
    rows = _files(spark, paths).select("movie_id", "language", F.posexplode(F.from_json("value", S.SCRIPT)).alias("pos", "s"))
    order = F.col("pos") + 1
    ends = F.regexp_replace(F.coalesce("s.content", F.lit("")), r"(?U)^\s+|\s+$", "")
    return rows.select("movie_id", "language", order.alias("scene_order"), F.coalesce("s._id", F.col("pos").cast("string")).alias("scene_id"), F.coalesce(F.nullif("s.title", F.lit("")), F.concat(F.lit("scene_"), order)).alias("title"), F.coalesce("s.subtitle", F.lit("")).alias("subtitle"), ends.alias("content"))


def first_file(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Of files that stand in for each other, the rows of the first in `names` that gave any."""
    rank = F.coalesce(*(F.when(F.col("file") == n, i) for i, n in enumerate(names)))
    ranked = rows.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return ranked.join(ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank")), [*keys, "_rank"], "left_semi").drop("_rank")


def focal_roles(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    """Roles of each movie from the first file that names any (roles or focal_character_timelines); the first of equal names stays."""
    rows = _files(spark, paths).withColumn("j", F.from_json("value", S.TIMELINES))
    found = F.coalesce(F.nullif("j.roles.character_name", F.array().cast("array<string>")), F.col("j.focal_character_timelines.character_name"))
    rows = first_file(rows.select("movie_id", "language", "file", F.posexplode(found).alias("pos", "character")).where(T.name_key("character") != ""), names, ["movie_id"])
    w = Window.partitionBy("movie_id", T.name_key("character")).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "file")


def timeline_nodes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = _files(spark, paths).select("movie_id", "language", F.posexplode(F.from_json("value", S.TIMELINES)["focal_character_timelines"]).alias("role_pos", "t"))
    return rows.select("movie_id", "language", "role_pos", "t.character_name", "t.aliases", "t.timeline_summary", F.posexplode_outer("t.timeline_nodes").alias("node_pos", "node"))


def arcs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = _files(spark, paths).select("movie_id", "language", F.posexplode(F.from_json("value", S.ARCS)["cross_scene_arcs"]).alias("pos", "a"))
    return rows.select("movie_id", "language", "pos", "a.*")


def movies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(S.MOVIES).csv(paths, header=True, multiLine=True)


def questions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(S.QUESTIONS).csv(paths, header=True, multiLine=True, escape='"')


def single_turn(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _files(spark, paths).select("movie_id", "language", F.explode(F.from_json("value", S.SINGLE_TURN)["instances"]).alias("i")).select("movie_id", "language", "i.*")


def episodes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = _files(spark, paths).select("movie_id", "language", F.explode(F.from_json("value", S.MULTI_TURN)["episodes"]).alias("e")).select("movie_id", "language", "e.*")
    ids = [F.nullif(F.trim(c), F.lit("")) for c in ("episode_id", "episode_instance_id", "instance_id")]
    return rows.withColumn("id", F.coalesce(*ids))


def find_episode(rows: DataFrame, target: str) -> DataFrame:
    """The first episode that goes by the id under any of its three names; an error if there is none."""
    found = rows.where(F.array_contains(F.array(*(F.coalesce(c, F.lit("")) for c in ("episode_id", "episode_instance_id", "instance_id"))), target)).orderBy("movie_id", "id").limit(1)
    if found.isEmpty():
        raise KeyError(target)
    return found


def role_assets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _files(spark, paths).select("movie_id", "language", F.explode(F.from_json("value", S.ROLE_ASSETS)["roles"]).alias("r")).select("movie_id", "language", "r.*")


def roles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A manifest: a list of roles, or an object with the list under rows; an error if it is neither."""
    both = _files(spark, paths).select(F.coalesce(F.from_json("value", f"struct<rows: {S.ROLES}>")["rows"], F.from_json("value", S.ROLES)).alias("rows"), "path")
    both = both.withColumn("rows", F.when(F.col("rows").isNull(), F.raise_error(F.concat(F.lit("no list of roles in "), "path")).cast(S.ROLES)).otherwise(F.col("rows")))
    return both.select(F.inline("rows")).where("character IS NOT NULL")


def filter_roles(rows: DataFrame, languages: list[str] | None = None, movies: list[str] | None = None, characters: list[str] | None = None) -> DataFrame:
    """Roles in the lists that are given, blank ones dropped, distinct and in order."""
    for column, allowed in (("language", languages), ("movie_id", movies), ("character", characters)):
        rows = rows.where(F.trim(column) != "")
        if allowed:
            rows = rows.where(F.col(column).isin(allowed))
    return rows.select("language", "movie_id", "character").distinct().orderBy("language", "movie_id", "character")


def provenance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """movie_id, scene_order (text), name: what every Character entity goes by, its name and its description; unreadable files give nothing."""
    rows = _files(spark, paths).select("movie_id", F.explode(F.from_json("value", S.EXTRACTION)).alias("key", "d"))
    rows = rows.select("movie_id", T.clean_text("d.document_metadata.scene_id").alias("scene_order"), F.explode("d.entities").alias("e")).where("e.type = 'Character' AND scene_order <> ''")
    names = F.filter(F.array(T.clean_text("e.name"), T.clean_text("e.description")), lambda n: n != "")
    return rows.select("movie_id", "scene_order", F.explode(names).alias("name")).distinct()


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, needed: list[str] | None = None, movies: list[str] | None = None) -> DataFrame:
    """language, movie_id, folder of the movies below root that have all the needed files (script.json), sorted; below root come a folder for each language and one for each movie."""
    needed = needed or ["script.json"]
    names = {"en": "English", "zh": "Chinese"}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path")  # names only: contents aren't read
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("movie_id"), F.element_at(parts, -3).alias("kind"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where(F.col("file").isin(needed))
    language = F.coalesce(*(F.when(F.col("kind") == name, k) for k, name in names.items()))
    rows = rows.withColumn("language", language).where(F.col("language").isin(languages or list(names)))
    if movies:
        rows = rows.where(F.col("movie_id").isin(movies))
    whole = rows.groupBy("language", "movie_id", "folder").agg(F.countDistinct("file").alias("n")).where(F.col("n") == len(set(needed)))
    return whole.select("language", "movie_id", "folder").orderBy("language", "movie_id")


def results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All result files below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(root).withColumn("path", F.col("_metadata.file_path"))
