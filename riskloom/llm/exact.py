"""Exact de-duplication by a stream with disk-backed state: one entry per text, never expired.

Equal means identical once the characters tab to carriage return and space are gone. Null counts as empty,
and empty texts are equal to each other. The row with the longest original text stays, then the one with the smallest id (null
ids last), then the first stored. Repeated rows are members like any other. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import new_folder, settle

SPACE = r"[\x20\x09-\x0D]"
# State on disk; files grow as they fill, for a store of few entries would else reserve megabytes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def stored_rows(docs: DataFrame, text: str, key: str, digest, path: str, whole: bool) -> DataFrame:
    """All rows stored in ``path``, those of ``docs`` added: id, length and digest of the text, state key, and the text or the ``whole`` row."""
    norm = normalised(F.col(text))
    content = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.col(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("chars"),
        sha(norm).alias("text_sha256"),
        digest(norm).alias("digest"),
        content.alias("content"),
    )
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def located(frame: DataFrame) -> DataFrame:
    """With each row's content locator: the stored file and the row in it."""
    return frame.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})


def best() -> Column:
    """Orders rows of one text; the greatest stays."""
    return F.struct("chars", (-F.col("doc_id")).alias("order"), "file", "row", "doc_id")


def state_of(rows: DataFrame, folder: str) -> DataFrame:
    """(digest, keep, n): the stream's last state of each digest.

    A streaming aggregation without watermark keeps its state for good, in RocksDB on disk with
    changelog and snapshots in the shared folder; batches replace their own output, so one may be repeated.
    A second run over the same ``folder`` goes on from the first one's state and reads only new files.
    """
    spark = rows.sparkSession
    out, before = f"{folder}/state", {name: spark.conf.get(name, None) for name in STORE}
    stream = located(spark.readStream.schema(rows.schema).parquet(f"{folder}/rows"))
    state = stream.groupBy("digest").agg(F.max(best()).alias("keep"), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True)
        query.foreachBatch(put).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    kept = "keep struct<chars:int,order:bigint,file:string,row:bigint,doc_id:bigint>"
    states = spark.read.schema(f"digest string, {kept}, n bigint, batch int").parquet(out)
    last = states.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("s"))
    return last.select("digest", "s.keep", "s.n")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", digest=sha, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, file and row of its content.

    ``digest`` makes the state key. Every hit's whole text is compared with that of its entry; texts that
    only share a key are grouped by their whole bytes instead. ``folder`` holds the texts, the state and the
    stream's checkpoint; a later call with the same folder adds its documents to those and returns all of them,
    so a batch should be given once. Without it each call starts anew.
    """
    folder = folder or new_folder(docs.sparkSession, "exact")
    rows = stored_rows(docs, text, key, digest, f"{folder}/rows", False)
    return decided(rows, normalised(F.col("content")), folder)


def distinct(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, whole, chosen by the place of their content: exactly one of each group."""
    folder = new_folder(docs.sparkSession, "exact")
    rows = stored_rows(docs, text, key, sha, f"{folder}/rows", True)
    kept = decided(rows, normalised(F.col("content")[text]), folder).where("kept").select("file", "row")
    return located(rows).join(kept, ["file", "row"], "left_semi").select("content.*")


def decided(rows: DataFrame, norm: Column, folder: str) -> DataFrame:
    total = rows.count()
    if not total:
        empty = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, file string, row long"
        return rows.sparkSession.createDataFrame([], empty)
    state = settle(state_of(rows, folder))
    # Entries with over a thousandth of the rows are fewer than a thousand, whatever the table's size.
    hot = state.where(F.col("n") > total / 1000)
    salts = F.ceil(F.col("n") * 1000 / total).cast("int")
    narrow = located(rows).select("doc_id", "digest", "text_sha256", "file", "row")
    members = narrow.join(F.broadcast(hot), "digest").unionByName(
        narrow.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(state.where(F.col("n") <= total / 1000), "digest")
    )
    own = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    members = members.select("*", own.alias("kept"))

    # Whole texts of groups meet once, salted by group size so that no cell has more than about a thousandth of the rows. All of a
    # cell, the entry among them, are equal if its least and greatest text are; cells of one group are held together likewise.
    salted = state.where("n > 1").select("digest", salts.alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    texts = located(rows).select("digest", norm.alias("norm"), "file", "row").join(F.broadcast(hot.select("digest", "n")), "digest", "left")
    spread = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("file", "row"), salts)).cast("int")
    # One way of joining at any size: a broadcast on small tables would hide what the large ones move.
    texts = texts.select("digest", "norm", spread.alias("salt")).join(salted.hint("merge"), ["digest", "salt"])
    cells = texts.groupBy("digest", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.max("salts").alias("salts"))
    checked = cells.where("low <> high OR salts > 1").groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    checked = checked.where("low <> high")
    wrong = settle(checked.select("digest").distinct())
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row"]
    right = members.select(
        "digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256", "file", "row"
    )
    if not wrong.limit(1).count():
        return right.select(*columns)
    shared = located(rows).withColumn("norm", norm).join(wrong, "digest", "left_semi")
    exact = shared.groupBy("norm").agg(F.max(best()).alias("keep"), F.count(F.lit(1)).alias("n"))
    split = shared.join(exact, "norm").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "text_sha256", "file", "row"
    )
    return right.join(wrong, "digest", "left_anti").select(*columns).unionByName(split)
