"""One query per operator on the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat, exact, language, licenses, near, negatives, packing, quality, secrets, sentencepiece, simhash, topk, trie
from riskloom.session import settle

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key):
    """Every fifth document by the checksum of its id is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    with open(vocabulary(PIECES), "rb") as file:
        model = file.read()
    rows = sentencepiece.encode(read(spark, folder, "documents"), model)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "parity"
    )


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.quantised(read(spark, folder, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op4_near(spark: SparkSession, folder: str) -> DataFrame:
    return near.classes(read(spark, folder, "documents"))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_trees(chat.chain(rows)))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = quality.learn(docs.where(~held_out(docs["doc_id"])), read(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = language.predict(docs, language.learn(docs.where(~held_out(docs["doc_id"]))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), vocabulary(WORDS), with_ids=False)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(read(spark, folder, "documents")).drop("redacted")


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.deduplicate(read(spark, folder, "documents")).drop("file", "row")


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, folder, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(rows, lambda vec_id: vec_id % 100 == 0)


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(read(spark, folder, "documents"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.branched(settle(trie.numbered(read(spark, folder, "conversations")))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_licenses,
        op3_topk,
        op4_near,
        op5_chat,
        op6_quality,
        op7_language,
        op8_packing,
        op9_secrets,
        op10_exact,
        op11_negatives,
        op12_simhash,
        op13_trie,
    )
}

ORACLE = {
    "op10_exact": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op5_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\s') AS esc FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(esc) + 7 ELSE length(esc) + length(role) + 14 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op3_topk": r"""
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)])::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)])::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_trie": r"""
        WITH byte AS (SELECT list(crc ORDER BY i) AS t FROM (SELECT i,
            list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) r(i))),
        n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS size
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
            xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM n), byte),
        r AS (SELECT c.conv_id, 0 AS own, pos, turn, size FROM c JOIN n ON n.conv_id = base AND pos <= h
            UNION ALL SELECT c.conv_id, 1, pos, turn, size FROM c JOIN n ON n.conv_id = c.conv_id AND pos > h),
        q AS (SELECT c.conv_id, coalesce(list(turn ORDER BY own, pos) FILTER (turn IS NOT NULL), []) AS turns, list(size ORDER BY own, pos) FILTER (turn IS NOT NULL) AS sizes
            FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
        p AS (SELECT conv_id, d, len(turns) AS length, array_to_string(turns[1:d], '') AS k, coalesce(sizes[d], 0) AS size FROM q, range(0, 1000) g(d) WHERE d <= len(turns)),
        node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d) AS ends
            FROM p GROUP BY k, d),
        child AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
        sub AS (SELECT left(node.k, 32 * g.d) AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved
            FROM node LEFT JOIN child ON node.k = child.k, range(0, 1000) g(d) WHERE g.d <= node.d GROUP BY 1)
        SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
            saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM node a JOIN sub ON sub.k = a.k LEFT JOIN child ON child.k = a.k LEFT JOIN node b ON a.d > 0 AND b.k = left(a.k, 32 * (a.d - 1))""",
}
