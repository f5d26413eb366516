"""Prompts as columns: an instruction in the row's language, then named sections; and messages for chat models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabula.functions import text as T

# Our own wording: what each call asks for, in English and Chinese.
INSTRUCTIONS: dict[str, tuple[str, str]] = {
    "propose_nodes": ("Propose the moments that change the character, from these scenes alone. Return JSON {\"proposed_nodes\": [..]}.", "仅根据这些场景提出改变人物的时刻。返回 JSON {\"proposed_nodes\": [..]}。"),
    "select_roles": ("Choose the characters whose story carries the film. Return JSON {\"characters\": [..]}.", "选出承载影片故事的人物。返回 JSON {\"characters\": [..]}。"),
    "beat": ("Summarise this beat and what changes for each character. Return JSON.", "概括这一情节点以及每个人物的变化。返回 JSON。"),
    "scene_role": ("Say what part the character plays in this scene and what shifts. Return JSON.", "说明人物在此场景中的作用和变化。返回 JSON。"),
    "scene_roles": ("For each scene, say what part the character plays and what shifts. Return JSON {\"scene_cards\": [..]}.", "对每个场景说明人物的作用和变化。返回 JSON {\"scene_cards\": [..]}。"),
    "segment": ("Summarise this part of the character's story in two sentences.", "用两句话概括人物故事的这一部分。"),
    "compare": ("Which scene matters more for the character's story, a, b or both?", "哪个场景对人物故事更重要：a、b 还是 both？"),
    "render_node": ("Write the timeline node for this scene, grounded in its text. Return JSON.", "根据场景文本写出时间线节点。返回 JSON。"),
    "ground_node": ("Quote the lines that support this node. Return JSON {\"evidence_quotes\": [..]}.", "引用支持该节点的原文。返回 JSON {\"evidence_quotes\": [..]}。"),
    "refine": ("Merge, drop or sharpen these nodes. Return JSON.", "合并、删除或改进这些节点。返回 JSON。"),
    "timeline_summary": ("Summarise the character's whole timeline.", "概括人物的完整时间线。"),
    "arcs": ("Link nodes across scenes into arcs. Return JSON {\"arcs\": [..]}.", "把跨场景的节点连成弧线。返回 JSON {\"arcs\": [..]}。"),
    "same_development": ("Do both texts tell the same development? Answer true or false.", "两段文字是否讲述同一发展？回答 true 或 false。"),
    "same_state": ("Do both texts end in the same state? Answer true or false.", "两段文字的结果状态是否相同？回答 true 或 false。"),
    "coherent": ("Does the second node follow from the first? Answer true or false.", "第二个节点是否承接第一个？回答 true 或 false。"),
    "arc_links": ("Are the arc's nodes rightly linked? Answer true or false.", "弧线的节点连接是否正确？回答 true 或 false。"),
    "arc_focus": ("Is the arc's focus the same in both? Answer true or false.", "两者的弧线重点是否相同？回答 true 或 false。"),
    "arc_progress": ("Does the arc progress in the same way in both? Answer true or false.", "两者的弧线进展是否一致？回答 true 或 false。"),
    "facts": ("List up to eight checkable facts of this timeline. Return JSON {\"facts\": [..]}.", "列出至多八条可核查的事实。返回 JSON {\"facts\": [..]}。"),
    "facts_supported": ("Which facts does this timeline support? Return JSON {\"supported_fact_ids\": [..]}.", "该时间线支持哪些事实？返回 JSON {\"supported_fact_ids\": [..]}。"),
    "repair_nodes": ("Fill in what these nodes lack, from the scenes. Return JSON.", "根据场景补全这些节点。返回 JSON。"),
    "actor": ("Stay in character and answer the last line only.", "保持角色，只回答最后一句。"),
    "judge_turn": ("Score the answer from 1 to 5 on each metric, with a reason. Return JSON.", "按每项指标给回答打 1 至 5 分并说明理由。返回 JSON。"),
    "judge_path": ("Score each turn's fit with the episode from 1 to 5. Return JSON.", "按 1 至 5 分评价每轮与情节的契合度。返回 JSON。"),
    "mend_json": ("Return only the valid JSON of this text.", "只返回该文本中有效的 JSON。"),
}
SINGLE_TURN_METRICS = ("memory_use", "fact_consistency", "persona_consistency", "knowledge_boundary")
MULTI_TURN_METRICS = (*SINGLE_TURN_METRICS, "cross_turn_consistency")


def prompt(kind: str, language: Column, **sections: Column) -> Column:
    """The instruction and each section under its name; empty sections are left out."""
    english, chinese = INSTRUCTIONS[kind]
    parts = [F.when(T.clean_text(c) != "", F.concat(F.lit(f"[{name}]\n"), c)) for name, c in sections.items()]
    return F.concat_ws("\n\n", F.when(language == "zh", chinese).otherwise(english), *parts)


def messages(user: Column, system: Column | None = None) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([one("system", system)] if system is not None else []), one("user", user))


def _json(c: Column) -> Column:
    return F.to_json(c)


def select_roles(language: Column, candidates: Column, most: int) -> Column:
    """candidates: JSON of the speakers, or of the merged list."""
    return messages(prompt("select_roles", language, most=F.lit(str(most)), candidates=candidates))


def propose_nodes(language: Column, name: Column, aliases: Column, cards: Column, least: int = 4, most: int = 10) -> Column:
    """cards: JSON of scene cards, whose excerpts are 700 letters at most."""
    return messages(prompt("propose_nodes", language, character=name, aliases=F.array_join(aliases, ", "), number=F.lit(f"{least}-{most}"), scenes=cards))


def refine(name: Column, candidates: Column, language: Column | None = None, least: int = 7, most: int = 9) -> Column:
    return messages(prompt("refine", F.lit("en") if language is None else language, character=name, number=F.lit(f"{least}-{most}"), nodes=candidates))


def beat(language: Column, title: Column, heading: Column, index: Column, text: Column, most: int = 7000) -> Column:
    return messages(prompt("beat", language, scene=title, heading=F.coalesce(heading, F.lit("")), beat=index.cast("string"), text=T.excerpt(text, most)))


def ground(language: Column, name: Column, node: Column, text: Column, most: int = 5000) -> Column:
    """node: JSON of the draft; text: the beat or the scene that must bear it out."""
    return messages(prompt("ground_node", language, character=name, node=node, text=T.excerpt(text, most)))


def arcs(language: Column, name: Column, nodes: Column) -> Column:
    """nodes: array of structs in story order."""
    return messages(prompt("arcs", language, character=name, nodes=_json(nodes)))


def same_development(name: Column, gold: Column, predicted: Column) -> Column:
    return prompt("same_development", F.lit("en"), character=name, gold=_json(gold), predicted=_json(predicted))


def same_state(name: Column, gold: Column, predicted: Column) -> Column:
    return prompt("same_state", F.lit("en"), character=name, gold=_json(gold), predicted=_json(predicted))


def arc_links(name: Column, gold: Column, predicted: Column) -> Column:
    return prompt("arc_links", F.lit("en"), character=name, gold=_json(gold), predicted=_json(predicted))


def arc_focus(language: Column, name: Column, gold: Column, predicted: Column) -> Column:
    return prompt("arc_focus", language, character=name, gold=_json(gold), predicted=_json(predicted))


def arc_progress(language: Column, name: Column, gold: Column, predicted: Column) -> Column:
    return prompt("arc_progress", language, character=name, gold=_json(gold), predicted=_json(predicted))


def coherent(language: Column, name: Column, before: Column, after: Column, scene_before: Column, scene_after: Column, most: int = 900) -> Column:
    """before and after: nodes; scenes: their texts, of which collapsed excerpts are shown."""
    shown = lambda c: T.excerpt(T.clean_text(c), most)
    return prompt("coherent", language, character=name, earlier_node=_json(before), later_node=_json(after), earlier_scene=shown(scene_before), later_scene=shown(scene_after))


def timeline_facts(language: Column, name: Column, timeline: Column, most: int = 8) -> Column:
    return messages(prompt("facts", language, character=name, most=F.lit(str(most)), timeline=timeline))


def facts_supported(language: Column, name: Column, facts: Column, timeline: Column) -> Column:
    return messages(prompt("facts_supported", language, character=name, facts=_json(facts), timeline=timeline))


def scene_role(language: Column, name: Column, title: Column, content: Column, most: int = 7000, order: Column | None = None) -> Column:
    place = {} if order is None else {"order": order.cast("string")}
    return prompt("scene_role", language, character=name, scene=title, **place, text=T.excerpt(content, most))


def scene_roles(language: Column, name: Column, scenes: Column, most: int = 1200) -> Column:
    """scenes: array of (scene_id, scene_order, title, content); their texts are cut."""
    cut = F.transform(scenes, lambda s: F.struct(s["scene_id"].alias("scene_id"), s["scene_order"].alias("scene_order"), s["title"].alias("scene_title"), T.excerpt(s["content"], most).alias("scene_text")))
    return messages(prompt("scene_roles", language, character=name, scenes=_json(cut)))


def segment(language: Column, name: Column, bucket: Column, cards: Column, most: int = 10) -> Column:
    return messages(prompt("segment", language, character=name, part=bucket, cards=_json(F.slice(cards, 1, most))))


def compare(language: Column, name: Column, a: Column, b: Column) -> Column:
    return messages(prompt("compare", language, character=name, a=_json(a), b=_json(b)))


def render_node(language: Column, name: Column, card: Column, content: Column, most: int = 6000) -> Column:
    return messages(prompt("render_node", language, character=name, card=_json(card), text=T.excerpt(content, most)))


def timeline_summary(language: Column, name: Column, nodes: Column, most: int = 24) -> Column:
    """nodes: array of structs in story order, the first `most` of which are shown."""
    return messages(prompt("timeline_summary", language, character=name, nodes=_json(F.slice(nodes, 1, most))))


def repair_nodes(language: Column, name: Column, aliases: Column, nodes: Column, most: int = 5000) -> Column:
    """nodes: array of structs with scene_text, which is cut."""
    cut = F.transform(nodes, lambda n: n.withField("scene_text", T.excerpt(n["scene_text"], most)))
    return messages(prompt("repair_nodes", language, character=name, aliases=F.array_join(aliases, ", "), nodes=_json(cut)))


def mend_json(text: Column) -> Column:
    return messages(prompt("mend_json", F.lit("en"), text=text))


def actor(language: Column, persona: Column, memories: Column, relations: Column, history: Column, turn: Column) -> Column:
    system = prompt("actor", language, persona=persona, memories=T.bullets(memories), relations=T.bullets(relations))
    return messages(F.concat_ws("\n", history, F.concat(F.lit("user: "), turn)), system)


def judge_turn(language: Column, metric: str, question: Column, answer: Column, facts: Column, forbidden: Column, history: Column | None = None, constraints: Column | None = None) -> Column:
    """history and constraints: what an episode adds, the dialogue so far and what earlier turns bind."""
    if metric not in MULTI_TURN_METRICS:
        raise ValueError(metric)
    more = ({} if history is None else {"dialogue": history}) | ({} if constraints is None else {"constraints": T.bullets(constraints)})
    return messages(prompt("judge_turn", language, metric=F.lit(metric), **more, question=question, answer=answer, facts=T.bullets(facts), forbidden=T.bullets(forbidden)))


def judge_path(language: Column, name: Column, turns: Column, episode: Column) -> Column:
    """turns: array of (turn_index, user, answer); episode: what the story says of it."""
    return messages(prompt("judge_path", language, character=name, episode=episode, turns=_json(turns)))
