"""Model answers as Columns: JSON text of the shapes that models give, read into the fields that the plans use.

A payload is an object or a list; what has neither shape, or isn't JSON, gives nothing. Texts are collapsed; an empty
text in a field that may be missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabula.functions import text as T

CARD = "struct<scene_id: string, scene_role: string, role_in_scene: string, external_change: string, relation_shift: string, goal_shift: string, state_pressure: string, mission_relevance: string, milestone_score: string, milestone_reason: string, evidence_quotes: array<string>>"
ARC = "struct<title: string, arc_focus: string, linked_timeline_node_ids: array<string>, arc_summary: string, start_state: string, end_state: string, unresolved_issue: string>"
NODE = "struct<scene_id: string, beat_index: string, importance: string, role_in_context: string, salient_development: string, goal_state: string, resulting_state: string, unresolved_issue: string, evidence_quotes: array<string>>"
SEGMENT = "struct<segment_summary: string, dominant_aspect: string>"
UPDATE = "struct<character_name: string, importance: string, durable_change: string, change_type: string, role_in_context: string, salient_development: string, goal_state: string, resulting_state: string, unresolved_issue: string, evidence_quotes: array<string>>"
BEAT = f"struct<beat_summary: string, characters_present: array<string>, character_updates: array<{UPDATE}>>"
FACT = "struct<fact_id: string, fact_type: string, phase: string, fact_text: string, text: string, scene_refs: array<string>, scene_ids: array<string>>"

# Kinds and phases of facts.
FACT_TYPES = ["decision", "status", "relationship", "goal", "outcome", "pressure", "other"]
FACT_PHASES = ["early", "middle", "late", "multi"]


def _is_list(json: Column) -> Column:
    return F.substring(F.ltrim(json), 1, 1) == "["


def items(json: Column, field: str, schema: str) -> Column:
    """The objects of a list, or of the list under `field` of an object; none if there is neither."""
    listed = F.when(_is_list(json), F.from_json(json, f"array<{schema}>")).otherwise(F.from_json(json, f"struct<{field}: array<{schema}>>")[field])
    return F.filter(F.coalesce(listed, F.array().cast(f"array<{schema}>")), lambda x: x.isNotNull())


def first_object(json: Column, schema: str) -> Column:
    """An object, or the first object of a list; null if there is none."""
    found = F.filter(F.from_json(json, f"array<{schema}>"), lambda x: x.isNotNull())
    return F.when(_is_list(json), F.get(found, F.lit(0))).otherwise(F.from_json(json, schema))


def filled(c: Column) -> Column:
    """The collapsed text, null where it is empty."""
    return F.nullif(T.clean_text(c), F.lit(""))


def flag(c: Column) -> Column:
    """A JSON value's truth: false for null, false, zero and empty ones."""
    return F.coalesce(~F.lower(F.trim(c)).isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def whole(c: Column, least: int, most: int) -> Column:
    """A whole number between the bounds; anything else is the least."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(c.try_cast("int"), F.lit(least))))


def found_quotes(quotes: Column, text: Column, most: int) -> Column:
    """Collapsed quotes that stand in the text, distinct and in order, at most `most`."""
    return T.quotes(text, F.transform(F.coalesce(quotes, F.array().cast("array<string>")), T.clean_text), most)


def card(raw: Column, content: Column) -> Column:
    """A scene card from a raw one: score 0 to 5, a known role (absent otherwise), quotes that stand in the scene."""
    role = F.lower(T.clean_text(raw["scene_role"]))
    optional = ("external_change", "relation_shift", "goal_shift", "state_pressure", "mission_relevance")
    return F.struct(
        F.when(role.isin("foreground", "active", "indirect"), role).otherwise("absent").alias("scene_role"), T.clean_text(raw["role_in_scene"]).alias("role_in_scene"), *(filled(raw[f]).alias(f) for f in optional),
        whole(raw["milestone_score"], 0, 5).alias("milestone_score"), T.clean_text(raw["milestone_reason"]).alias("milestone_reason"), found_quotes(raw["evidence_quotes"], content, 4).alias("evidence_quotes"),
    )


def updates(raw: Column, text: Column) -> Column:
    """The character updates of a beat's summary, without those that name nobody."""

    def one(u: Column) -> Column:
        return F.struct(
            T.strip_speaker_variant(u["character_name"]).alias("character_name"), F.coalesce(filled(u["importance"]), F.lit("supporting")).alias("importance"), flag(u["durable_change"]).alias("durable_change"),
            F.coalesce(filled(u["change_type"]), F.lit("other")).alias("change_type"), T.clean_text(u["role_in_context"]).alias("role_in_context"), T.clean_text(u["salient_development"]).alias("salient_development"),
            *(filled(u[f]).alias(f) for f in ("goal_state", "resulting_state", "unresolved_issue")), found_quotes(u["evidence_quotes"], text, 3).alias("evidence_quotes"),
        )

    return F.filter(F.transform(raw["character_updates"], one), lambda u: u["character_name"] != "")


def present(raw: Column) -> Column:
    """Names of a beat's characters, as they are given."""
    return F.filter(F.transform(raw["characters_present"], T.strip_speaker_variant), lambda n: n != "")


def facts(json: Column, most: int = 8) -> Column:
    """Facts with known kinds and phases, at most six scene references each; the first of equal texts, at most `most`.

    A fact without an id is called F and its place in the payload.
    """

    def one(f: Column, i: Column) -> Column:
        pick = lambda c, allowed, default: F.when(F.lower(T.clean_text(c)).isin(allowed), F.lower(T.clean_text(c))).otherwise(default)
        refs = F.when(F.size(F.coalesce(f["scene_refs"], F.array().cast("array<string>"))) > 0, f["scene_refs"]).otherwise(F.coalesce(f["scene_ids"], F.array().cast("array<string>")))
        refs = F.array_distinct(F.filter(F.transform(refs, T.clean_text), lambda r: r != ""))
        text = F.coalesce(filled(f["fact_text"]), T.clean_text(f["text"]))
        return F.struct(F.coalesce(filled(f["fact_id"]), F.concat(F.lit("F"), i + 1)).alias("fact_id"), pick(f["fact_type"], FACT_TYPES, "other").alias("fact_type"), pick(f["phase"], FACT_PHASES, "multi").alias("phase"), text.alias("fact_text"), F.slice(refs, 1, 6).alias("scene_refs"))

    listed = F.coalesce(F.from_json(json, f"struct<facts: array<{FACT}>>")["facts"], F.array().cast(f"array<{FACT}>"))
    read = F.filter(F.transform(listed, one), lambda f: T.name_key(f["fact_text"]) != "")
    keys = F.transform(read, lambda f: T.name_key(f["fact_text"]))
    return F.slice(F.filter(read, lambda f, i: F.array_position(keys, T.name_key(f["fact_text"])) == i + 1), 1, most)


def supported_ids(json: Column, facts: Column) -> Column:
    """The ids under supported_fact_ids that facts have, distinct and in order."""
    given = F.transform(F.coalesce(F.from_json(json, "struct<supported_fact_ids: array<string>>")["supported_fact_ids"], F.array().cast("array<string>")), T.clean_text)
    known = F.transform(facts, lambda f: f["fact_id"])
    return F.array_distinct(F.filter(given, lambda i: (i != "") & F.array_contains(known, i)))
