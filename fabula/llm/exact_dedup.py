"""Exact deduplication by a streaming query with disk-backed keyed state (operator 6); DataFrame functions only.

Each row's digest, stable identifier and content locator (its file) go to a log in the shared folder; a streaming
aggregation over the log keeps, in RocksDB state without expiry, of each digest the smallest identifier, that row's
locator and the count. The texts of digests that were hit again are then compared byte for byte: the least and the
greatest text of a digest are found by partial aggregates, so that a hot digest moves two texts a task, and if they
differ, the digest's rows are grouped by the whole text instead.

Defined cases: null text counts as empty; texts are equal when identical after each run of ASCII white space became one
space; repeated rows are copies like any other; of rows that share the smallest id, each says kept, and first_of_each
keeps one; null ids stay only in groups that have no other; an empty table gives an empty result; other columns are
ignored, or passed through by first_of_each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, own_path, scratch, small

#: Disk-backed state; without space set aside ahead, which is megabytes for each of the many small stores, with one
#: bound on the memory of all stores of an executor, and each store closed when its task has committed: else all
#: partitions' stores stay open until Spark's next round of maintenance, a minute into the stages that follow.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
}
_KEY = ["digest", "n_bytes"]


def normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    return body.select("id", F.unhex(F.sha2(F.encode("body", "UTF-8"), 256)).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"), "body", F.input_file_name().alias("locator"))


def stream_state(log: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """(digest, n_bytes, keep, locator, size) of the digests that were hit again in a log table written by cut(): the state of a streaming aggregation when the log has ended."""
    spark = log.sparkSession
    home = own_path(spark, "exact")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(log.schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        kept = [F.min("id").alias("keep"), F.min_by("locator", "id").alias("locator"), F.count("*").alias("size")]
        state = source.parquet(log._fabula_path).groupBy(*_KEY).agg(*kept)
        # A batch gives the keys it changed; writing a batch again replaces it, so a restarted one counts once.
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.where("size > 1").write.mode("overwrite").parquet(f"{home}/out/batch={batch}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = log.select(*_KEY, F.col("id").alias("keep"), "locator", F.lit(0).cast("long").alias("size")).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/out")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).parquet(f"{home}/out/batch=*")
    # Counts only grow and smallest ids only fall, so these are the state after the last batch.
    hits = cut(out.groupBy(*_KEY).agg(F.min("keep").alias("keep"), F.min_by("locator", "keep").alias("locator"), F.max("size").alias("size")), "hits")
    delete(spark, home)
    return hits


def _clashes(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit digests that stand for several texts: full bytes are compared."""
    texts = keyed.select(*_KEY, "body").join(small(hits).select(*_KEY), _KEY)
    ends = texts.groupBy(*_KEY).agg(F.min("body").alias("first"), F.max("body").alias("last"))
    return cut(ends.where("first <> last").select(*_KEY), "clash")


def _apart(keyed: DataFrame, clash: DataFrame) -> DataFrame:
    """Rows of clashing digests with what stays of their own text, which none but such rows need."""
    texts = keyed.join(clash, _KEY, "left_semi")
    kept = texts.groupBy(*_KEY, "body").agg(F.min("id").alias("keep"), F.min_by("locator", "id").alias("of"), F.count("*").alias("size"))
    return texts.join(kept, [*_KEY, "body"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text), keep_locator (file of the row that stays)."""
    with scratch():
        keyed = _keyed(docs, id_col, text_col)
        log = cut(keyed.drop("body"), "log", outer=True)
        hits = stream_state(log, files_per_batch)
        clash = _clashes(keyed, hits)
        sure = cut(hits.join(clash, _KEY, "left_anti").withColumnRenamed("locator", "of"), "sure", outer=True)
        size = F.coalesce("size", F.lit(1).cast("long"))
        alone = F.col("size").isNull()
        rows = log
        other = None
        if not clash.isEmpty():
            other = cut(_apart(keyed, clash).select("id", *_KEY, "keep", "of", "size"), "apart", outer=True)
            rows = log.join(cut(clash, "clash", outer=True), _KEY, "left_anti")
        groups = rows.join(small(sure), _KEY, "left").select("id", "digest", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"), F.when(alone, F.col("locator")).otherwise(F.col("of")).alias("of"), size.alias("size"))
    if other is not None:
        groups = groups.unionByName(other.drop("n_bytes"))
    return groups.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("of").alias("keep_locator"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """The rows of docs, all columns, of which no equal text with a smaller id is there; of repeated rows one."""
    digest = F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256))
    with scratch():
        keyed = _keyed(docs, id_col, text_col)
        log = cut(keyed.drop("body"), "log")
        hits = stream_state(log, files_per_batch)
        clash = _clashes(keyed, hits)
        firsts = log.join(small(hits).select(*_KEY, "keep"), _KEY).where(F.col("id").eqNullSafe(F.col("keep"))).groupBy(*_KEY).agg((F.count("*") > 1).alias("again"))
        known = hits.join(clash, _KEY, "left_anti").join(firsts, _KEY).select(F.col("digest").alias("_fabula_digest"), F.col("keep").alias("_fabula_keep"), F.col("again").alias("_fabula_again"))
        known = cut(known, "known", outer=True)
        several = not clash.isEmpty()
        if several:
            clash = cut(clash.select(F.col("digest").alias("_fabula_digest")), "clash", outer=True)
    rows = docs.withColumn("_fabula_own", digest)
    met = rows.join(small(known), F.col("_fabula_own") == F.col("_fabula_digest"), "left")
    out = met.where(F.col("_fabula_digest").isNull() | (F.col(id_col).eqNullSafe(F.col("_fabula_keep")) & ~F.col("_fabula_again"))).select(*docs.columns)
    again = known.where("_fabula_again")
    if not again.isEmpty():
        rest = rows.join(again, (F.col("_fabula_own") == F.col("_fabula_digest")) & F.col(id_col).eqNullSafe(F.col("_fabula_keep")))
        out = out.unionByName(rest.dropDuplicates(["_fabula_own"]).select(*docs.columns))
    if several:
        rest = rows.join(clash, F.col("_fabula_own") == F.col("_fabula_digest"), "left_semi").withColumn("_fabula_body", normalised(text_col))
        least = rest.groupBy("_fabula_own", "_fabula_body").agg(F.min(id_col).alias("_fabula_keep"))
        rest = rest.join(least, ["_fabula_own", "_fabula_body"]).where(F.col(id_col).eqNullSafe(F.col("_fabula_keep"))).dropDuplicates(["_fabula_own", "_fabula_body"])
        out = out.join(clash, digest == F.col("_fabula_digest"), "left_anti").unionByName(rest.select(*docs.columns))
    return out


def op6(spark, sf_dir) -> DataFrame:
    from .common import table

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("keep_locator")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""
