"""Joins: names to entities, links to nodes, neighbours, quotes, and one-to-one matching by score.

Each join is an equi join where one exists; conditions that aren't equalities sit on top of an equality (the movie, the
scene, a position bucket), so that nothing becomes a product of whole tables.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.values import cosine, jaccard
from fabula.operators.folds import fold_groups


def match_entities(predicted: DataFrame, gold: DataFrame, keys: list[str], pred_key: str, pred_pos: str, gold_keys: str, gold_id: str, gold_pos: str) -> DataFrame:
    """Predicted names to gold entities, one to one: of a key the last gold entity owns it, of an entity the first prediction gets it.

    gold_keys is an array of a gold entity's normalised names. Returns keys, predicted columns and gold_id; predictions
    without a match are absent.
    """
    owned = gold.select(*keys, gold_id, gold_pos, F.explode(gold_keys).alias("_key")).where("_key <> ''")
    owned = owned.groupBy(*keys, "_key").agg(F.max_by(gold_id, F.struct(gold_pos, gold_id)).alias(gold_id))
    met = predicted.join(owned.withColumnRenamed("_key", pred_key), [*keys, pred_key])
    first = Window.partitionBy(*keys, gold_id).orderBy(pred_pos, pred_key)
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def valid_links(owners: DataFrame, links: str, known: DataFrame, keys: list[str], node: str, least: int = 2) -> DataFrame:
    """Owners with only the links that exist, distinct and in order; owners with fewer than `least` of them go."""
    places = owners.select(*owners.columns, F.posexplode(links).alias("_pos", node))
    there = places.join(known.select(*keys, node).distinct(), [*keys, node], "left_semi")
    firsts = there.groupBy(*[c for c in owners.columns if c != links], node).agg(F.min("_pos").alias("_pos"))
    kept = firsts.groupBy(*[c for c in owners.columns if c != links]).agg(F.array_sort(F.collect_list(F.struct("_pos", node))).alias("_l"))
    return kept.where(F.size("_l") >= least).select(*[c for c in owners.columns if c != links], F.transform("_l", lambda x: x[node]).alias(links))


def bridge_links(owners: DataFrame, owner: str, links: str, nodes: DataFrame, node: str, target: str) -> DataFrame:
    """(owner, targets): the targets behind an owner's links, in the links' order, missing ones left out, distinct."""
    places = owners.select(owner, F.posexplode_outer(links).alias("_pos", node))
    found = places.join(nodes.select(node, target), node, "left").where(F.col(target).isNotNull()).groupBy(owner, target).agg(F.min("_pos").alias("_pos"))
    listed = found.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", target))), lambda x: x[target]).alias(target + "s"))
    return owners.select(owner).join(listed, owner, "left").withColumn(target + "s", F.coalesce(target + "s", F.array().cast(listed.schema[target + "s"].dataType)))


def band_neighbours(hits: DataFrame, rows: DataFrame, keys: list[str], order: str, reach: int = 2) -> DataFrame:
    """Rows within `reach` places of a hit of the same keys, hits too, once each. Hits become the places they reach, so the join is an equality."""
    near = hits.select(*keys, F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias(order)).distinct()
    return rows.join(near.withColumn(order, F.col(order).cast(rows.schema[order].dataType)), [*keys, order], "left_semi")


def substring_quotes(texts: DataFrame, text: str, quotes: DataFrame, quote: str, keys: list[str]) -> DataFrame:
    """Pairs of texts and quotes, of the same keys if there are any, in which the quote is part of the text.

    A quote's words but the first and the last stand in such a text as words too, so a quote of three words or more
    meets the texts that have the longest of these; the few shorter ones are held against all texts of their keys.
    """
    words = lambda c: F.split(F.col(c), r"\s+")
    inner = F.slice(words(quote), 2, F.greatest(F.size(words(quote)) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(F.array_distinct(inner), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    asked = quotes.where(F.col(quote) != "").withColumn("_word", F.when(F.size(inner) > 0, longest))
    wordy = asked.where("_word <> ''")
    places = texts.select("*", F.explode(F.array_distinct(words(text))).alias("_word"))
    met = places.join(wordy, [*keys, "_word"]).where(F.contains(F.col(text), F.col(quote)))
    short = asked.where("_word IS NULL OR _word = ''")
    rest = texts.join(short, keys or F.lit(True)).where(F.contains(F.col(text), F.col(quote)))
    return met.drop("_word").unionByName(rest.drop("_word"))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when a left row has no partner."""
    found = left.join(right.withColumn("_there", F.lit(True)), keys, "left")
    bad = F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys)))
    return found.withColumn("_there", F.when(F.col("_there"), True).otherwise(F.raise_error(bad).cast("boolean"))).where("_there").drop("_there")


def merge_updates(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with fields replaced by those of the update of the same key that aren't empty, and whether anything changed."""
    new = updates.dropDuplicates([key]).select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    both = rows.join(new, key, "left")
    value = {f: F.coalesce(F.when(F.trim(F.col(f"_new_{f}").cast("string")) != "", F.col(f"_new_{f}")), F.col(f)) for f in fields}
    changed = F.to_json(F.struct(*(v.alias(f) for f, v in value.items()))) != F.to_json(F.struct(*fields))
    return both.withColumn("changed", changed).withColumns(value).drop(*(f"_new_{f}" for f in fields))


def best_arc_match(gold: DataFrame, predicted: DataFrame, key: str, cosine_weight: float = 0.85) -> DataFrame:
    """To each gold arc the predicted arc of the same role with the best mix of cosine and scene Jaccard; ties go to the first.

    Both have key, arc_id, pos, vector and scenes. Returns key, arc_id, predicted_id, score. Arcs of the same vector and
    scenes score alike, so one of each kind is scored: of predicted ones the first.
    """
    kind = [F.col(key), F.col("vector"), F.array_sort(F.array_distinct("scenes")).alias("scenes")]
    p = predicted.select(*kind, "pos", "arc_id").groupBy(key, F.col("vector").alias("_v"), F.col("scenes").alias("_s"))
    p = p.agg(F.max(F.struct((-F.col("pos")).alias("order"), "arc_id")).alias("_first"))
    score = cosine_weight * cosine(F.col("vector"), F.col("_v")) + (1 - cosine_weight) * jaccard(F.col("scenes"), F.col("_s"))
    best = gold.select(*kind).distinct().join(p, key).withColumn("score", score).where("score > -1")
    best = best.groupBy(key, "vector", "scenes").agg(F.max(F.struct("score", "_first")).alias("best"))
    own, of_kind = gold.select(*kind, "arc_id").alias("g"), best.alias("b")
    same = (F.col(f"g.{key}") == F.col(f"b.{key}")) & F.col("g.vector").eqNullSafe(F.col("b.vector")) & F.col("g.scenes").eqNullSafe(F.col("b.scenes"))
    found = own.join(of_kind, same).groupBy(f"g.{key}", "g.arc_id").agg(F.max("b.best").alias("best"))
    return found.select(key, "arc_id", F.col("best._first.arc_id").alias("predicted_id"), F.col("best.score").alias("score"))


def greedy_pairs(scores: DataFrame, group: list[str], least: float = 0.35) -> DataFrame:
    """One-to-one pairs of gi and pi within a group, best score first (ties: the larger gi, then pi), each score at least `least`.

    A group is one role's scene, whose size the data model bounds; groups run in parallel.
    """

    def fold(rows: list[dict]) -> list[dict]:
        used_g, used_p, keep = set(), set(), []
        for r in sorted((r for r in rows if r["score"] >= least), key=lambda r: (r["score"], r["gi"], r["pi"]), reverse=True):
            if r["gi"] not in used_g and r["pi"] not in used_p:
                used_g.add(r["gi"])
                used_p.add(r["pi"])
                keep.append(r)
        return keep

    return fold_groups(scores, group, fold, scores.schema)


def names_alike(a: str, b: str, least: float = 0.86) -> bool:
    """Equal keys, one inside the other, or a sequence ratio of `least` where both have five letters."""
    if not a or not b:
        return False
    return a in b or b in a or min(len(a), len(b)) >= 5 and SequenceMatcher(None, a, b).ratio() >= least


#: Names of more letters are held against each other one by one; pairs that are held against each other at a time.
LONG, AT_ONCE = 120, 4096


def _letters(names: pa.Array, ascii_only: bool, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of names, a row for each place in a name, padded; and the names' lengths."""
    if ascii_only:
        offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
        n = np.diff(offsets)
        place = np.arange(n.max())[:, None]
        data = np.frombuffer(names.buffers()[2], np.uint8)
        return np.where(place < n, data[np.minimum(offsets[:-1] + place, len(data) - 1)], np.uint8(pad & 255)), n
    texts = names.to_pylist()
    n = np.array([len(t) for t in texts])
    codes = np.array(texts, dtype=f"U{n.max()}").view(np.uint32).reshape(len(texts), -1).T
    return np.where(np.arange(n.max())[:, None] < n, codes, np.uint32(pad)), n


def _longest_match(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of columns the longest common block, the first in x and then in y of equal ones: where it begins in both, its size."""
    run, best = np.zeros((len(y) + 1, x.shape[1]), np.uint8), np.zeros(x.shape[1], np.int32)
    place = (255 - np.arange(len(y), dtype=np.uint16))[:, None]
    for i, letter in enumerate(x):
        after = np.zeros_like(run)
        np.multiply(run[:-1] + np.uint8(1), letter == y, out=after[1:])
        run = after
        top = ((run[1:].astype(np.uint16) << np.uint16(8)) | place).max(axis=0).astype(np.int32)
        best = np.maximum(best, (top >> 8 << 16) | (255 - i << 8) | (top & 255))
    size = best >> 16
    return 256 - (best >> 8 & 255) - size, 256 - (best & 255) - size, size


def ratios_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether SequenceMatcher's ratio of each pair of columns is at least `least`: its blocks, for all pairs at a time, as long as they matter."""
    found, open_ = np.zeros(len(nx), np.int64), np.minimum(nx, ny)
    pair, (xa, xb, ya, yb) = np.arange(len(nx)), (np.zeros_like(nx), nx, np.zeros_like(ny), ny)
    while True:
        reached = 2.0 * found / (nx + ny) >= least
        on = (~reached & (2.0 * (found + open_) / (nx + ny) >= least))[pair]
        pair, xa, xb, ya, yb = (v[on] for v in (pair, xa, xb, ya, yb))
        if not len(pair):
            return reached
        cuts = []
        for codes, lo, hi, pad in ((x, xa, xb, -1), (y, ya, yb, -2)):
            at = lo + np.arange((hi - lo).max())[:, None]
            cuts.append(np.where(at < hi, codes[np.minimum(at, len(codes) - 1), pair], codes.dtype.type(pad & np.iinfo(codes.dtype).max)))
        i, j, size = _longest_match(*cuts)
        np.add.at(found, pair, size)
        np.subtract.at(open_, pair, np.minimum(xb - xa, yb - ya))
        left, right = (pair, xa, xa + i, ya, ya + j), (pair, xa + i + size, xb, ya + j + size, yb)
        pair, xa, xb, ya, yb = (np.concatenate(v) for v in zip(left, right, strict=True))
        more = np.tile(size > 0, 2) & (xa < xb) & (ya < yb)
        pair, xa, xb, ya, yb = (v[more] for v in (pair, xa, xb, ya, yb))
        np.add.at(open_, pair, np.minimum(xb - xa, yb - ya))


def _ratios(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """ratios_reach for names; those of more than LONG letters, which SequenceMatcher treats otherwise, one by one."""
    out = np.zeros(len(a), bool)
    long = np.maximum(pc.utf8_length(a).to_numpy(zero_copy_only=False), pc.utf8_length(b).to_numpy(zero_copy_only=False)) > LONG
    for k in np.flatnonzero(long):
        out[k] = names_alike(a[int(k)].as_py(), b[int(k)].as_py(), least)
    rest = np.flatnonzero(~long)
    if len(rest):
        x, y = (v.filter(pa.array(~long)) if long.any() else v for v in (a, b))
        plain = all(pc.all(pc.string_is_ascii(v)).as_py() for v in (x, y))
        out[rest] = ratios_reach(*(v for pair in zip(_letters(x, plain, 0xFFFFFFFF), _letters(y, plain, 0xFFFFFFFE), strict=True) for v in pair), least)
    return out


def fuzzy_names(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: float = 0.86) -> DataFrame:
    """Pairs of names of the same block that are alike (see names_alike; a is the alias, b the name sought).

    The ratio is twice the letters in common over all letters, so lengths that can't reach it are dropped before it is
    taken; it is taken of thousands of pairs at a time. Every pair that is alike is a row, so the result grows with the
    square of a block.
    """

    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = x.cast(pa.string()), y.cast(pa.string())
        return pa.array(np.concatenate([np.zeros(0, bool), *(_ratios(x[k : k + AT_ONCE], y[k : k + AT_ONCE], least) for k in range(0, len(x), AT_ONCE))]))

    x, y = F.col(a), F.col(b)
    inside = F.contains(x, y) | F.contains(y, x)
    fits = (F.least(F.length(x), F.length(y)) >= 5) & (2 * F.least(F.length(x), F.length(y)) >= least * (F.length(x) + F.length(y)))
    # Names are few bytes and their pairs many: dealt out, they aren't left to the one task that reads a small file.
    names = right.where((y.isNotNull()) & (y != "")).repartition(int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = left.where((x.isNotNull()) & (x != "")).join(names, block).where(inside | fits)
    return pairs.where(inside | F.arrow_udf(check, "boolean")(x, y))


def skip_finished(jobs: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished result."""
    return jobs.join(finished.select(*keys), keys, "left_anti")


def job_matrix(samples: DataFrame, modes: list[str]) -> DataFrame:
    """Every sample in every mode; the modes are a short list, so this explodes and joins nothing."""
    return samples.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def episode_jobs(roles: DataFrame, episodes: DataFrame, keys: list[str], episode: str, modes: list[str]) -> DataFrame:
    """A job for each episode and mode of a role; a role without episodes has one row that says no_episodes."""
    found = roles.join(episodes.select(*keys, episode), keys, "left")
    jobs = job_matrix(found.where(F.col(episode).isNotNull()), modes).withColumn("status", F.lit("planned"))
    none = found.where(F.col(episode).isNull()).withColumn("mode", F.lit(None).cast("string")).withColumn("status", F.lit("no_episodes"))
    return jobs.unionByName(none)
