"""Scenes to beats: a table function that splits at scene headings, merges small pieces and cuts long ones."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from fabula.functions.text import HEADING

# Sizes in letters and lines.
FLUSH_LETTERS, BLANK_LINES, SMALL, MOST_LINES, MOST_LETTERS, CHUNK, OVERLAP = 160, 80, 180, 120, 8000, 72, 10
_HEADING = re.compile(HEADING)


def is_slug(line: str) -> bool:
    """As functions.text.is_slug_line."""
    bare = line.strip().strip(" .:-")
    letters = [c for c in bare if c.isalpha()]
    return len(bare) >= 6 and sum(map(str.isupper, letters)) > 0.7 * len(letters) and bool(_HEADING.match(bare))


def _chunks(lines: list[str]) -> list[list[str]]:
    out, start = [], 0
    while start < len(lines):
        end = min(len(lines), start + CHUNK)
        if end < len(lines):
            blank = next((i for i in range(end, max(end - 12, start + 40), -1) if not lines[i - 1].strip()), end)
            end = blank
        out.append(lines[start:end])
        if end >= len(lines):
            break
        start = max(start + 1, end - OVERLAP)
    return out


def split_beats(content: str | None, title: str = "") -> list[tuple[int, str, str]]:
    """(beat_index, heading, text) of a scene; an empty scene is one beat."""
    beats: list[tuple[str, list[str]]] = []
    heading: str = title
    held: list[str] = []

    def flush() -> None:
        if text := "\n".join(held).strip():
            beats.append((heading, text.splitlines()))
        held.clear()

    for line in (x.rstrip() for x in (content or "").splitlines()):
        if is_slug(line):
            if len("\n".join(held).strip()) >= FLUSH_LETTERS:
                flush()
            heading = " ".join(line.split())
            held.append(line)
        else:
            held.append(line)
            if len(held) >= BLANK_LINES and not line.strip():
                flush()
    flush()
    merged: list[tuple[str, list[str]]] = []
    for head, lines in beats:
        if merged and len("\n".join(lines).strip()) < SMALL:
            before = merged[-1]
            merged[-1] = (before[0], [" ".join(" ".join([*before[1], *lines]).split())])
        else:
            merged.append((head, lines))
    out = []
    for head, lines in merged:
        long = len(lines) > MOST_LINES or len("\n".join(lines)) > MOST_LETTERS
        for part in _chunks(lines) if long else [lines]:
            if text := "\n".join(part).strip():
                out.append((len(out), head, text))
    return out or [(0, title, "")]


def beats(scenes: DataFrame, scene_id: str = "scene_id", title: str = "title", content: str = "content") -> DataFrame:
    """scene_id, beat_index, heading, beat_text."""

    def run(batches):
        for batch in batches:
            rows = [(i, b) for i, (t, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) for b in split_beats(c, t or "")]
            yield pa.record_batch([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([b[0] for _, b in rows], pa.int32()), pa.array([b[1] for _, b in rows], pa.string()), pa.array([b[2] for _, b in rows], pa.string())], ["scene_id", "beat_index", "heading", "beat_text"])

    return scenes.select(scene_id, title, content).mapInArrow(run, f"scene_id {dict(scenes.dtypes)[scene_id]}, beat_index int, heading string, beat_text string")
