"""Role-play runs: samples of one turn and episodes of several, with the memories a mode lets the actor see, and their judging.

One-turn samples are columns all the way. In an episode a turn's memories depend on the answers before, so an episode
is folded in order, with its role's memories (whose number the data model bounds) beside it; episodes run in parallel.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fabula.functions import text as T
from fabula.operators import retrieval, summaries
from fabula.plans import prompts
from fabula.plans.providers import Offline, Provider, complete_column, embed_column, kept
from fabula.streaming.dialogue import history_text, render_history

MODES = ("persona_only", "full_memory_all_in", "bm25_topk", "embedding_topk")
ROLE = ["movie_id", "character"]


def roles(assets: DataFrame) -> DataFrame:
    """movie_id, character, language, persona, relations and memories (memory_id, scene_order, document) of role assets."""
    card = F.col("persona_card")
    memory = F.transform("memories", lambda m: F.struct(m["memory_id"].alias("memory_id"), m["scene_order"].alias("scene_order"), retrieval.memory_document(m["memory_text"], m["grounded_facts"], m["tags"]).alias("document")))
    persona = retrieval.persona_summary(card["traits"], card["speaking_style"], card["constraints"])
    relations = F.transform(retrieval.relation_context(F.col("relations")), lambda r: F.concat(r["target_character"], F.lit(": "), r["relation"]))
    none = F.array().cast("array<string>")
    return assets.select("movie_id", F.col("character_name").alias("character"), "language", persona.alias("persona"), F.coalesce(relations, none).alias("relations"), F.coalesce(memory, F.array().cast("array<struct<memory_id:string,scene_order:int,document:string>>")).alias("memories"))


def single_turn(samples: DataFrame, assets: DataFrame, mode: str, provider: Callable[[], Provider] = Offline, k: int = 4) -> DataFrame:
    """Samples (movie_id, character, instance_id, input, reference) with the memories seen, the answer, its scores and what retrieval hit."""
    both = samples.join(roles(assets).drop("language"), ROLE)
    history = F.transform("input.dialogue_history", lambda h: F.struct(h["speaker"].alias("speaker"), h["text"].alias("text")))
    both = both.withColumn("query", retrieval.memory_query(F.col("persona"), history, F.col("input.current_user_turn")))
    own = [*ROLE, "instance_id"]
    memories = both.select(*own, "language", F.explode("memories").alias("m")).select(*own, "language", "m.*")
    lang = F.when(F.col("language") == "zh", "chinese").otherwise("english")
    if mode == "bm25_topk":
        docs = memories.withColumn("tokens", retrieval.memory_tokens(F.col("document"), lang))
        asked = both.withColumn("tokens", retrieval.memory_tokens(F.col("query"), lang)).withColumn("q", F.lit(0))
        scores = retrieval.bm25_scores(docs, asked, own, "memory_id", "q").drop("q")
    elif mode == "embedding_topk":
        d, q = embed_column(memories, "document", "vector", provider), embed_column(both.select(*own, "query"), "query", "vector", provider).withColumn("q", F.lit(0))
        scores = retrieval.vector_scores(d, q, own, "memory_id", "q", "vector").drop("q")
    else:
        scores = memories.select(*own, "memory_id", F.lit(0.0).alias("score")).where("false")
    seen = retrieval.select_memories(memories, scores, own, "memory_id", "scene_order", mode, k)
    listed = seen.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("rank", "memory_id", "document", "score"))).alias("s"))
    out = both.join(listed, own, "left").withColumns({"selected": F.coalesce(F.transform("s", lambda x: x["memory_id"]), F.array().cast("array<string>")), "shown": F.coalesce(F.transform("s", lambda x: x["document"]), F.array().cast("array<string>"))})
    hit, recall = summaries.support_at_k(F.col("selected"), F.coalesce("reference.source_memory_ids", F.array().cast("array<string>")))
    said = F.array_join(F.transform("input.dialogue_history", lambda h: F.concat(T.clean_text(h["speaker"]), F.lit(": "), T.clean_text(h["text"]))), "\n")
    out = out.withColumn("messages", prompts.actor(F.col("language"), F.col("persona"), F.col("shown"), F.col("relations"), F.coalesce(said, F.lit("")), T.clean_text("input.current_user_turn")))
    out = complete_column(out.drop("s", "memories"), "messages", "answer", provider)
    return out.select(*own, "language", "input", "reference", F.lit(mode).alias("mode"), "selected", "answer", hit.alias("hit_at_k"), recall.alias("recall_at_k"))


def judge(rows: DataFrame, metrics: Sequence[str], keys: list[str], provider: Callable[[], Provider] = Offline) -> DataFrame:
    """keys, metric, score and reason: each answer against its reference, a call for each metric; what can't be read scores least. rows: keys, language, question, answer, facts, forbidden."""
    schema = "struct<score: string, reason: string>"
    out = None
    for metric in metrics:
        asked = rows.withColumn("messages", prompts.judge_turn(F.col("language"), metric, F.col("question"), F.col("answer"), F.col("facts"), F.col("forbidden"))).select(*keys, "messages")
        found = complete_column(asked, "messages", "verdict", provider, as_json=True).withColumn("v", F.from_json(F.coalesce("verdict", F.lit("{}")), schema))
        part = found.select(*keys, F.lit(metric).alias("metric"), F.col("v.score").alias("score"), T.clean_text("v.reason").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def bm25(documents: Sequence[Sequence[str]], query: Sequence[str], k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> list[float]:
    """Scores of tokenised documents, as retrieval.bm25_scores gives them, for use inside a fold."""
    n = len(documents)
    mean = sum(map(len, documents)) / n if n else 0.0
    held = Counter(t for d in documents for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in held.items()}
    usual = floor * sum(raw.values()) / len(raw) if raw else 0.0
    weight = {t: usual if w < 0 else w for t, w in raw.items()}
    out = []
    for d in documents:
        count, size = Counter(d), k1 * (1 - b + b * len(d) / mean) if mean else 0.0
        out.append(sum(weight[t] * count[t] * (k1 + 1) / (count[t] + size) for t in query if count[t]))
    return out


_CHINESE, _PLAIN = re.compile(rf"[a-z0-9_]+|[{T.CJK}]"), re.compile(r"[a-z0-9']+")


def _tokens(text: str, language: str) -> list[str]:
    return (_CHINESE if language == "zh" else _PLAIN).findall(" ".join(text.split()).lower())


def choose(memories: Sequence[dict], query: str, language: str, mode: str, k: int, model: Provider) -> list[tuple[dict, float]]:
    """The memories a turn sees and their scores; equal scores go by scene order (none counts as 0), then by place; a whole list by scene order, none last."""
    if mode == "persona_only":
        return []
    last = 1_000_000_000
    if mode == "full_memory_all_in":
        return [(m, 0.0) for m in sorted(memories, key=lambda m: (last if m["scene_order"] is None else m["scene_order"], m["memory_id"] or ""))]
    if mode == "bm25_topk":
        scores = bm25([_tokens(m["document"], language) for m in memories], _tokens(query, language))
    elif mode == "embedding_topk":
        vectors = model.embed([m["document"] for m in memories] + [query]) if memories else [[]]
        scores = [sum(x * y for x, y in zip(v, vectors[-1], strict=True)) for v in vectors[:-1]]
    else:
        raise NotImplementedError(mode)
    order = sorted(range(len(memories)), key=lambda i: (-round(scores[i], 9), memories[i]["scene_order"] or 0, memories[i]["memory_id"] or ""))
    return [(memories[i], round(scores[i], 6)) for i in order[:k]]


def episodes(rows: DataFrame, assets: DataFrame, mode: str, provider: Callable[[], Provider] = Offline, k: int = 4) -> DataFrame:
    """A row for each turn: what the actor saw and said. rows: movie_id, character, language, id, turns (as the episode reader gives them)."""
    both = rows.select(*ROLE, "language", "id", "turns").join(roles(assets).drop("language"), ROLE)
    more = "turn_index int, question_id string, user_turn string, history string, answer string, selected array<string>, scores array<double>, source_memory_ids array<string>, mode string"
    schema = StructType([*(both.schema[c] for c in (*ROLE, "language", "id")), *StructType.fromDDL(more).fields])
    kinds = to_arrow_schema(schema)

    def play(batches):
        model = provider()
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                answers: dict[int, str] = {}
                for t in e["turns"] or []:
                    given = t["input"] or {}
                    lines = render_history(given.get("dialogue_history_template"), answers)
                    turn = " ".join((given.get("current_user_turn") or "").split())
                    said = "\n".join(f"{x['speaker']}: {x['text']}" for x in lines if x["text"])
                    query = "\n\n".join([e["persona"], *([f"Dialogue history:\n{said}"] if said else []), f"Current user turn:\n{turn}"])
                    seen = choose(e["memories"] or [], query, e["language"], mode, k, model)
                    memory = "\n".join(f"- {m['document']}" for m, _ in seen) or "- none"
                    relations = "\n".join(f"- {r}" for r in e["relations"]) or "- none"
                    system = f"[character]\n{e['character']}\n\n[persona]\n{e['persona']}\n\n[memories]\n{memory}\n\n[relations]\n{relations}"
                    answer = model.complete([{"role": "system", "content": system}, {"role": "user", "content": f"{history_text(lines)}\nuser: {turn}"}], 220, 0.7)
                    answers[int(t["turn_index"])] = " ".join(answer.split())
                    own = {c: e[c] for c in (*ROLE, "language", "id")}
                    out.append({**own, "turn_index": t["turn_index"], "question_id": t["question_id"], "user_turn": turn, "history": history_text(lines), "answer": answers[int(t["turn_index"])], "selected": [m["memory_id"] for m, _ in seen], "scores": [s for _, s in seen], "source_memory_ids": (t["reference"] or {}).get("source_memory_ids") or [], "mode": mode})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return kept(both.mapInArrow(play, schema))


def episode_scores(turns: DataFrame, provider: Callable[[], Provider] = Offline, metrics: Sequence[str] = prompts.MULTI_TURN_METRICS) -> DataFrame:
    """One row for each episode and mode: its core score, its path score, how many turns and what retrieval hit."""
    from fabula.plans import evaluation

    keys = [*ROLE, "language", "id", "mode"]
    talk = F.array_sort(F.collect_list(F.struct("turn_index", F.col("user_turn").alias("user"), "answer")))
    whole = turns.groupBy(*keys).agg(talk.alias("talk"))
    text = F.array_join(F.transform("talk", lambda t: F.concat(F.lit("user: "), t["user"], F.lit("\n"), F.lit("answer: "), t["answer"])), "\n")
    none = F.array().cast("array<string>")
    asked = whole.withColumns({"question": text, "answer": F.element_at("talk", -1)["answer"], "facts": none, "forbidden": none})
    core = evaluation.judged(judge(asked, metrics, keys, provider), keys)
    path = complete_column(whole.withColumn("messages", prompts.judge_path(F.col("language"), F.col("character"), F.col("talk"), F.col("id"))), "messages", "verdict", provider, as_json=True)
    steps = path.select(*keys, F.explode_outer(F.from_json(F.coalesce("verdict", F.lit("{}")), "struct<turns: array<struct<turn_index: string, score: string>>>")["turns"]).alias("s")).select(*keys, F.col("s.turn_index").alias("turn_index"), F.col("s.score").alias("score"))
    found = summaries.retrieval_summary(turns, keys, "selected", "source_memory_ids", F.size("selected").cast("double"))
    return core.join(evaluation.path_score(steps, keys), keys).join(found, keys)
