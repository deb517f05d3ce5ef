"""Hard negatives by score windows over Hilbert-ordered blocks with zone maps.

Rows are sorted along a Hilbert curve through all their components and cut into blocks of a few hundred, stored as
Parquet in one folder per chunk of blocks. Every (block, label) has a zone map: the least and greatest value of each
dimension. Interval arithmetic on it bounds an anchor's inner products with all rows of the zone, from both sides, so an
anchor reads only blocks whose bounds meet one of its score windows; a first look at a few promising blocks narrows the
windows to what can still be among the best.

Null ids, labels and vectors, and vectors with null or non-finite components, take no part. Vectors of different
lengths never meet; those without components all score zero. Rows that repeat id, label and quantised vector count
once; rows that share only an id all count, but never meet one another. Ties go to the smaller id, then to the row first
on the curve. Scores are exact; one beyond a long counts as the
long nearest to it. An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import new_folder, settle

CHUNK, BLOCK, ANCHORS, BITS = 8192, 256, 1024, 3
LONG = 2**63 - 1
ROW = "vec_id long, label int, v array<double>"
STORED = f"row long, block long, {ROW}, d int, chunk int"
ZONE = "chunk int, block long, label int, d int, n long, low array<double>, high array<double>"


def hilbert(levels: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place on the Hilbert curve of each row of whole numbers below 2^bits, as bytes that sort like it (Skilling 2004)."""
    rows, dims = levels.shape
    if not dims:
        return [b""] * rows
    x = levels.T.astype(np.uint32).copy()
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(rows, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * dims, rows).T.astype(np.uint8), axis=1)
    return [line.tobytes() for line in packed]


def _vectors(column) -> np.ndarray:
    """Equally long lists as a matrix."""
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else [list(v) for v in column], float).reshape(len(column), -1)


def placed(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v, place): floor(256 x) of every component and the place on the curve, for the rows that take part."""
    source = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    n, mean, square = source.agg(F.sum(F.size("x")), F.sum(total), F.sum(squares)).first()
    mean = mean / n if n else 0.0
    spread = np.sqrt(max(square / n - mean * mean, 0.0)) if n else 1.0
    if not np.isfinite([mean, spread]).all() or not spread:
        mean, spread = 0.0, 1.0
    steps = 1 << BITS

    def run(batches):
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("x").to_pylist()], int)
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = _vectors(part.column("x"))
                # Steps of half a standard deviation; where a value falls matters for speed alone.
                levels = np.clip(np.floor((x - mean) / spread * (steps / 4)) + steps / 2, 0, steps - 1)
                with np.errstate(over="ignore"):
                    v = np.floor(256 * x)
                fits = np.isfinite(v).all(axis=1)
                out = pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(hilbert(levels), pa.binary())],
                    names=["vec_id", "label", "v", "place"],
                )
                yield out.filter(pa.array(fits))

    return source.mapInArrow(run, f"{ROW}, place binary")


def stored(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows, zones): the table of blocks in the shared folder, a folder per chunk, and its zone maps."""
    spark = rows.sparkSession
    points = settle(placed(rows, key, vector, label))
    chunks = max(1, -(-points.count() // CHUNK))
    order = [F.size("v"), "place", "vec_id", "label", "v"]

    def cut(batches):
        chunk, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            fresh = []
            for i, line in enumerate(zip(*[batch.column(c).to_pylist() for c in ("vec_id", "label", "v")])):
                if line != last:
                    fresh.append(i)
                last = line
            part = batch.select(["vec_id", "label", "v"]).take(pa.array(fresh, pa.int64()))
            number = np.arange(at, at + len(fresh)) + (chunk << 32)
            at += len(fresh)
            lengths = pa.array([len(v) for v in part.column("v").to_pylist()], pa.int32())
            columns = [pa.array(number), pa.array(number // BLOCK), *part.columns, lengths, pa.array([chunk] * len(fresh), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "block", "vec_id", "label", "v", "d", "chunk"])

    path = new_folder(spark, "blocks")
    blocks = points.repartitionByRange(chunks, *order).sortWithinPartitions(*order).mapInArrow(cut, STORED)
    blocks.write.partitionBy("chunk").parquet(path)
    table = spark.read.schema(STORED).parquet(path)

    def zone_maps(batches):
        for batch in batches:  # a block cut by a batch's end gets two zones
            frame = batch.to_pandas()
            out = []
            for (block, label_, d), part in frame.groupby(["block", "label", "d"]):
                v = _vectors(part["v"])
                out.append((part["chunk"].iloc[0], block, label_, d, len(part), v.min(axis=0).tolist(), v.max(axis=0).tolist()))
            names = ["chunk", "block", "label", "d", "n", "low", "high"]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return table, settle(table.select("block", "label", "v", "d", "chunk").mapInArrow(zone_maps, ZONE))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``, widened by what floats may lose."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    size = np.abs(anchors).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(anchors.shape[1], 1)
    lost = 0.0 if size < 2**53 else size * 1e-12
    return up @ low.T + down @ high.T - lost, up @ high.T + down @ low.T + lost


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where every sum is a whole number they can hold, else by Python's integers."""
    size = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(anchors.shape[1], 1)
    if size < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in line] for line in side], object).reshape(side.shape) for side in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by id, then row."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:k]]


def _spread(frame: DataFrame, name: str, count: int) -> DataFrame:
    return frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _zones_met(zones: DataFrame, anchors: DataFrame, grid: tuple[int, int], same: bool, k: int, seeds: bool) -> DataFrame:
    """(a, w, upper, chunk, block, n): zones whose bounds meet an anchor's windows.

    With ``seeds`` only the highest-reaching zones of each chunk that together hold more than k rows, for every window;
    without, all of them, each once per anchor as window 0.
    """

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            least, most = bounds(_vectors(right["v"]), _vectors(left["low"]), _vectors(left["high"]))
            label, n, block = left["label"].to_numpy(), left["n"].to_numpy(), left["block"].to_numpy()
            for i, (a, own, lows, highs) in enumerate(zip(right["a"], right["label"], right["lo"], right["hi"])):
                fits = (label == own) if same else (label != own)
                met = np.zeros(len(left), bool)
                for w, (lo, hi) in enumerate(zip(lows, highs)):
                    here = fits & (most[i] >= lo) & (least[i] <= hi)
                    met |= here
                    if seeds:
                        at = np.flatnonzero(here)
                        at = at[np.argsort(-most[i][at], kind="stable")]
                        at = at[np.cumsum(n[at]) - n[at] <= k]
                        out += [(a, w, most[i][z], key[0], block[z], n[z]) for z in at]
                if not seeds:
                    out += [(a, 0, 0.0, key[0], b, 0) for b in np.unique(block[met])]
        return pd.DataFrame(out, columns=["a", "w", "upper", "chunk", "block", "n"])

    chunks, parts = grid
    left, right = (frame.groupBy("chunk", "part", "d") for frame in (_spread(zones, "part", parts), _spread(anchors, "chunk", chunks)))
    return left.cogroup(right).applyInPandas(meet, "a long, w int, upper double, chunk int, block long, n long")


def _scan(table: DataFrame, anchors: DataFrame, needed: DataFrame, grid: tuple[int, int], same: bool, k: int) -> DataFrame:
    """(a, w, vec_id, row, score): of the blocks ``needed`` (a, chunk, block) by each anchor, the k best rows in each of its windows."""
    wanted = needed.groupBy("a", "chunk").agg(F.collect_set("block").alias("blocks"))
    asked = anchors.join(wanted, "a")
    # Only chunks that someone needs are opened, and only rows of needed blocks move on.
    read = needed.select("chunk", "block").distinct()
    rows = table.join(read, ["chunk", "block"], "left_semi")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            scores = products(_vectors(right["v"]), _vectors(left["v"]))
            ids, number, label, block = (left[c].to_numpy() for c in ("vec_id", "row", "label", "block"))
            for i, line in enumerate(right.itertuples(index=False)):
                fits = ((label == line.label) if same else (label != line.label)) & (ids != line.id) & np.isin(block, line.blocks)
                for w, (lo, hi) in enumerate(zip(line.lo, line.hi)):
                    at = np.flatnonzero(fits & (scores[i] >= lo) & (scores[i] <= hi))
                    at = at[best(scores[i][at], ids[at], number[at], k)]
                    out += [(line.a, w, ids[j], number[j], scores[i][j]) for j in at]
        return pd.DataFrame(out, columns=["a", "w", "vec_id", "row", "score"])

    left, right = (frame.groupBy("chunk", "part", "d") for frame in (_spread(rows, "part", grid[1]), asked))
    found = left.cogroup(right).applyInPandas(search, "a long, w int, vec_id long, row long, score long")
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(table: DataFrame, zones: DataFrame, anchors: DataFrame, grid: tuple[int, int], same: bool, k: int) -> DataFrame:
    """(a, w, rank, vec_id, row, score): the k best rows in every window of every anchor, of its label or of all others.

    ``anchors`` are (a, id, label, d, v, part, lo, hi) with windows lo[w] <= score <= hi[w], ``grid`` the numbers of
    chunks and of anchors' parts.
    """
    met = _zones_met(zones, anchors, grid, same, k, seeds=True)
    by = Window.partitionBy("a", "w").orderBy(F.desc("upper"), "chunk", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = met.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).where(F.col("before") <= k)
    first = settle(first.select("a", "chunk", "block").distinct())
    # The k-th best score seen so far: nothing below it can be among the k best.
    seen = _scan(table, anchors, first, grid, same, k).groupBy("a", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = seen.where(F.col("n") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floor"))
    narrowed = anchors.join(floors, "a", "left").withColumn("lo", F.transform("lo", lambda low, w: F.coalesce(F.col("floor")[w.cast("int")], low)))
    narrowed = settle(narrowed.drop("floor"))
    needed = settle(_zones_met(zones, narrowed, grid, same, k, seeds=False).select("a", "chunk", "block"))
    return _scan(table, narrowed, needed, grid, same, k)


def hard_negatives(
    rows: DataFrame,
    anchors,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the id. A row's score is its inner product with the anchor. Positives are the anchor's
    best rows of its label; for each come the best rows of other labels whose score is ``low`` to ``high`` per cent of its own.
    """
    table, zones = stored(rows, key, vector, label)
    chosen = table.where(anchors(F.col("vec_id"))).select(F.col("row").alias("a"), F.col("vec_id").alias("id"), "label", "d", "v")
    chosen = settle(chosen)
    parts = max(1, -(-chosen.count() // ANCHORS))
    chunks = (zones.agg(F.max("chunk")).first()[0] or 0) + 1
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))
    whole = chosen.withColumns({"lo": F.array(F.lit(-LONG)), "hi": F.array(F.lit(LONG))})
    near = settle(search(table, zones, whole, (chunks, parts), True, positives).select("a", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Decimals, so that a hundredfold long still fits; an empty window has lo above hi.
    share = F.col("positive_score").cast("decimal(20,0)")
    windows = near.select("a", "rank", F.ceil(share * low / 100).cast("long").alias("lo"), F.floor(share * high / 100).cast("long").alias("hi"))
    windows = windows.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    ranged = settle(chosen.join(windows, "a").select(*chosen.columns, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    far = search(table, zones, ranged, (chunks, parts), False, negatives)
    far = far.select("a", (F.col("w") + 1).alias("of"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = far.join(near.withColumnRenamed("rank", "of"), ["a", "of"]).join(chosen.select("a", "id"), "a")
    return pairs.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
