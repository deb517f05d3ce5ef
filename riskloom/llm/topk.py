"""Exact top-k inner products over integer vectors by an impact-ordered index, score at a time.

Rows lie in blocks of bounded size, each with postings by (component, level); every block of queries meets
every block of rows. Null ids, null and empty vectors and vectors with null or non-finite components take no part. Vectors of
different lengths never meet. Rows that repeat id and vector count once; ties go to the smaller id. Components so large that
sums are no longer exact as doubles are scored as whole numbers from the start, a score beyond a long as the long nearest to it;
a component beyond a long counts as that long. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES, ROUNDS, LEVEL = 4096, 2048, 8, 16
TOGETHER, SEGMENTS, IMPACTS = 64, 512, 1 << 22  # queries that pass over the postings at once, segments added at once, impacts held at once


class Block:
    """Postings of one block: for each component the rows by level, a level being a run of 16 quantised values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.doubles = ids, vectors, vectors.astype(float)
        self.most = float(np.abs(self.doubles).max(initial=0))
        levels = np.floor_divide(vectors, LEVEL)
        parts, dims, values, ends = [], [], [], []
        size = 0
        for dim in range(vectors.shape[1]):
            order = np.argsort(levels[:, dim], kind="stable")
            seen, starts = np.unique(levels[order, dim], return_index=True)
            parts.append(order)
            dims += [dim] * len(seen)
            values += seen.tolist()
            ends += (size + np.append(starts[1:], len(order))).tolist()
            size += len(order)
        self.rows = np.concatenate(parts) if parts else np.zeros(0, int)
        self.dims, self.levels = np.array(dims, int), np.array(values, np.int64)
        self.ends = np.array(ends, int)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(int)

    def fits(self, query: np.ndarray, bits: int = 53) -> bool:
        """Whether no sum of products with this query can leave the whole numbers of ``bits`` bits, 53 being those that doubles hold."""
        sides = [float(np.abs(query.astype(float)).max(initial=0)) + LEVEL, self.most + LEVEL]
        return sides[0] * sides[1] * max(len(query), 1) < 2**bits

    def whole(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``top`` by Python's integers."""
        at = np.flatnonzero(self.ids != query_id)
        exact = [sum(int(a) * int(b) for a, b in zip(query, self.vectors[i])) for i in at]
        best = sorted(range(len(at)), key=lambda j: (-exact[j], self.ids[at[j]]))[:k]
        bound = 2**63 - 1
        return self.ids[at[best]] if best else self.ids[:0], np.array([max(-bound, min(bound, exact[j])) for j in best], np.int64)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best rows but the query's own, for each of several queries.

        Segments are added by descending impact, the greatest of any of these queries; a segment's rows are read once for
        all of them. What is left of a component lies between the least and greatest of its open segments (or 0, for rows
        already past them); once that proves all but a few rows out of a query's answer, or every segment is in, the rest
        are scored exactly and the query leaves.
        """
        # The product below runs twice as fast in single precision, where no sum leaves its whole numbers.
        kind = np.float32 if all(self.fits(query, 24) for query in queries) else np.float64
        impact = queries[:, self.dims].astype(kind) * (self.levels * LEVEL).astype(kind)
        slack = queries.astype(float) * (LEVEL - 1)  # bounds are summed in doubles, which hold them exactly
        high, low = np.maximum(slack, 0).sum(axis=1), np.minimum(slack, 0).sum(axis=1)
        order = np.argsort(-np.abs(impact).max(axis=0, initial=0), kind="stable")
        reach = np.cumsum((self.ends - self.starts)[order])
        total = np.zeros((len(queries), len(self.ids)), kind)
        alive = [np.flatnonzero(self.ids != query_id) for query_id in query_ids]
        out: list = [None] * len(queries)
        left, done = np.arange(len(queries)), 0
        for step in range(1, ROUNDS + 1):
            upto = int(np.searchsorted(reach, reach[-1] * step / ROUNDS)) + 1 if step < ROUNDS else len(order)
            for at in range(done, upto, SEGMENTS):
                self.add(total, order[at : min(at + SEGMENTS, upto)], impact, left)
            done = max(done, upto)
            up, down = self.still_open(impact[left], order[done:])
            ready = np.zeros(len(left), bool)
            for j, i in enumerate(left):
                if len(alive[i]) > k:
                    sums = total[j, alive[i]]
                    least = np.partition(sums, len(sums) - k)[len(sums) - k] + down[j] + low[i]
                    alive[i] = alive[i][sums + (up[j] + high[i]) >= least]
                ready[j] = step == ROUNDS or len(alive[i]) <= 8 * k
                if ready[j]:
                    out[i] = self.scored(alive[i], queries[i], k)
            if ready.all():
                break
            left, total = left[~ready], total[~ready]
        return out

    def add(self, total: np.ndarray, segments: np.ndarray, impact: np.ndarray, left: np.ndarray) -> None:
        """Adds to ``total`` (queries by rows) what these segments give their rows; every sum is of whole numbers, so order is free."""
        sizes = (self.ends - self.starts)[segments]
        if sizes.sum() < len(segments) * len(self.ids) // 256:  # segments of few rows
            for segment in segments:
                total[:, self.rows[self.starts[segment] : self.ends[segment]]] += impact[left, segment, None]
        else:  # their rows as a matrix of ones, so that one product serves all queries
            at = np.repeat(self.starts[segments] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            ones = np.zeros((len(segments), len(self.ids)), impact.dtype)
            ones[np.repeat(np.arange(len(segments)), sizes), self.rows[at]] = 1
            total += impact[np.ix_(left, segments)] @ ones

    def still_open(self, impact: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the most and the least that these segments can add to a row, one of each component at most."""
        if not len(segments):
            return np.zeros(len(impact)), np.zeros(len(impact))
        segments = np.sort(segments)  # by component
        first = np.flatnonzero(np.diff(self.dims[segments], prepend=-1))
        up = np.maximum.reduceat(impact[:, segments], first, axis=1)
        down = np.minimum.reduceat(impact[:, segments], first, axis=1)
        return np.maximum(up, 0).sum(axis=1, dtype=float), np.minimum(down, 0).sum(axis=1, dtype=float)

    def scored(self, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best of the rows ``at``; doubles hold them, see ``fits``."""
        scores = (self.doubles[at] @ query.astype(float)).astype(np.int64)
        if len(at) > k:
            at, scores = (x[scores >= np.partition(scores, len(at) - k)[len(at) - k]] for x in (at, scores))
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, for vectors of finite numbers only."""
    source = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = source.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    return source.select("vec_id", F.transform("x", lambda x: F.floor(x * 256)).alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``queries`` against all ``rows`` but its own id; both (vec_id, v).

    Rows that repeat both id and vector count once.
    """
    rows, queries = rows.distinct(), queries.distinct()
    blocks, parts = max(1, -(-rows.count() // ROWS)), max(1, -(-queries.count() // QUERIES))

    def prepared(frame, name, count):
        return frame.withColumns({"d": F.size("v"), name: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")})

    # A task holds one block of each side, so its memory does not grow with the table.
    left = prepared(rows, "block", blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = prepared(queries, "part", parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.int64))
            ids, queries = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(np.int64)
            fit = np.array([block.fits(query) for query in queries])
            for i in np.flatnonzero(~fit):
                out += [(ids[i], int(a), int(s)) for a, s in zip(*block.whole(ids[i], queries[i], k))]
            fit = np.flatnonzero(fit)
            many = max(1, min(TOGETHER, IMPACTS // max(1, len(block.dims))))
            for some in (fit[at : at + many] for at in range(0, len(fit), many)):
                for i, found in zip(some, block.top(ids[some], queries[some], k)):
                    out += [(ids[i], int(a), int(s)) for a, s in zip(*found)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "part", "d").cogroup(right.groupBy("block", "part", "d")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
