"""Near-duplicates by SimHash: 64-bit fingerprints, joined where blocks of bits agree, verified by Hamming distance.

A fingerprint's bit is set if it is set in more than half of the XXH64 values of the text's runs of three words,
repeats included. Null counts as empty; a text without words has fingerprint zero, linked like any other; a text of fewer words has one
run of them all. Whole texts are read, however long. Repeated rows are rows like any other. Ids may repeat with other
texts: rows link by their fingerprints, and a component takes its least non-null id, null if it has none. Columns but the named
ones are not read. An empty table gives no rows.

Two fingerprints that differ in at most three bits differ in at most three of six blocks of bits, so they agree in three
whole blocks: each fingerprint is keyed by every choice of three. Buckets of one key hold distinct fingerprints; of each
bucket only a spanning forest of its links leaves the task. Buckets beyond ``TILE`` fingerprints are cut into tiles, and every
pair of tiles meets in a cell of its own.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.near import components
from riskloom.session import settle

WORDS, DISTANCE, BLOCKS, TILE, SEED = 3, 3, 6, 2048, 42
RUNS = 1 << 16
SHORT = 8
#: For byte place p and byte value b, row 256 p + b adds b's bits to the eight counts of place p.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = (text or b"").lower().split()  # bytes: A-Z alone change, and \x20 \x09-\x0D part words
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < WORDS:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - WORDS + 1], ends[WORDS - 1 :]
    counts, digest = np.zeros((8, 8)), xxhash.xxh64_intdigest
    for at in range(0, len(starts), RUNS):
        runs = zip(starts[at : at + RUNS].tolist(), ends[at : at + RUNS].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in runs], ">u8")
        places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(places.reshape(-1), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits((2 * counts > len(starts)).reshape(-1)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    # As bytes, so that texts of broken encoding are read as they are.
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Every choice of blocks that fingerprints within ``distance`` may agree in, as signed 64-bit masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    chosen = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in chosen]


def cells(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(fp, part, shared, cell): each distinct fingerprint in the cells of the buckets it falls into."""
    keys = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared")) for i, mask in enumerate(masks(distance, blocks))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.part", "k.shared")
    large = keyed.groupBy("part", "shared").count().where(F.col("count") > tile)
    large = large.select("part", "shared", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    joined = keyed.join(large, ["part", "shared"], "left").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: other != F.col("tile"))
    pair = F.transform(others, lambda other: F.least(other, F.col("tile")) * F.col("tiles") + F.greatest(other, F.col("tile")))
    return joined.select("fp", "part", "shared", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("cell"))


def forest(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that links within ``distance`` connect: every fingerprint is compared with those not yet reached."""
    out, rest = [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            close = np.bitwise_count(rest ^ here) <= distance
            if close.any():
                reached = rest[close]
                out.append((np.full(len(reached), here), reached))
                queue += list(reached)
                rest = rest[~close]
    return out


def linked(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within whole cells, given as runs of equal ``keys``: all of a short run's, a spanning forest of a long one's."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, int)
    ends = np.append(starts[1:], len(keys))
    run = np.repeat(np.arange(len(starts)), ends - starts)
    short = np.repeat(ends - starts <= SHORT, ends - starts)
    found = []
    for step in range(1, SHORT):
        at = np.flatnonzero((run[step:] == run[:-step]) & short[step:])
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= distance]
        found.append((prints[at], prints[at + step]))
    for i in np.flatnonzero(ends - starts > SHORT):
        found += forest(prints[starts[i] : ends[i]], distance)
    return tuple(np.concatenate([pair[i] for pair in found]) for i in (0, 1))


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), enough of them to connect all that are connected."""
    key = ["part", "shared", "cell"]

    def run(batches):
        keys, values = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in chain(batches, [None]):
            upto = len(keys)
            if batch is not None:
                fresh = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key], axis=1)
                keys = np.concatenate([keys, fresh])
                values = np.concatenate([values, batch.column("fp").to_numpy().view(np.uint64)])
                if not len(keys):
                    continue
                same = (keys == keys[-1]).all(axis=1)
                upto = len(keys) - int(same.sum())  # rows are sorted: the last cell may go on in the next batch
            a, b = linked(keys[:upto], values[:upto], distance)
            keys, values = keys[upto:], values[upto:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = cells(prints, distance, blocks, tile).repartition(*key).sortWithinPartitions(*key, "fp")
    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component's id is the least id reachable by links."""
    rows = settle(fingerprints(docs, text, key))
    least = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(least.select("fp"), distance, blocks))
    named = least.join(roots, least["fp"] == roots["rep"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = named.join(first, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(known, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")
