"""Dialogue episodes as a fold over turns: what a turn's history shows can be an earlier answer of the same episode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.plans.providers import Offline, Provider

ANSWER = "previous_model_response"


def _collapsed(x) -> str:
    return " ".join(str(x or "").split())


def render_history(template: Sequence[dict] | None, answers: dict[int, str]) -> list[dict]:
    """The history with places for earlier answers filled in; a place whose answer isn't there stays empty."""
    out = []
    for line in template or []:
        turn = int(line.get("source_turn_index") or 0)
        said = answers.get(turn, "") if _collapsed(line.get("fill_with")) == ANSWER else _collapsed(line.get("text"))
        out.append({"speaker": _collapsed(line.get("speaker")) or "unknown", "text": said, "source_turn_index": turn or None})
    return out


def history_text(lines: Sequence[dict]) -> str:
    return "\n".join(f"- {x['speaker']}: {_collapsed(x['text'])}" for x in lines) or "- none"


def play_episodes(turns: DataFrame, keys: list[str], turn: str = "turn_index", text: str = "text", history: str | None = None, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """keys, turn, prompt, answer: each turn is answered in order, after its own history, in which earlier answers of the episode can stand.

    history: a column of lines (speaker, text, fill_with, source_turn_index) or None for turns without one. An episode
    is one group; its turns are bounded by the data model. Episodes run in parallel.
    """
    kinds = dict(turns.dtypes)

    def fold(rows: pa.Table) -> pa.Table:
        model, answers, out = provider(), {}, []
        for r in sorted(rows.to_pylist(), key=lambda r: r[turn]):
            prompt = f"{history_text(render_history(r[history] if history else None, answers))}\nuser: {_collapsed(r[text])}"
            answers[int(r[turn])] = answer = _collapsed(model.complete([{"role": "user", "content": prompt}]))
            out.append({**{k: r[k] for k in keys}, turn: r[turn], "prompt": prompt, "answer": answer})
        return pa.Table.from_pylist(out, pa.schema([*(rows.schema.field(k) for k in (*keys, turn)), pa.field("prompt", pa.string()), pa.field("answer", pa.string())]))

    columns = [*keys, turn, text, *([history] if history else [])]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*keys, turn)), "prompt string", "answer string"])
    return turns.where(F.col(turn).isNotNull()).select(*columns).groupBy(*keys).applyInArrow(fold, schema)


def transcript(turns: DataFrame, keys: list[str], turn: str, role: str, text: str) -> DataFrame:
    """Each episode's turns as one text, in order."""
    line = F.struct(F.col(turn), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))
    return turns.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n_turns"))
