"""What keeps the work of operators on pairs in bounds, and that it loses nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import near, topk


def family(draw, size):
    """Texts that differ from one text in a few words each, a third of them too much to resemble any other."""
    base = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    out = []
    for i in range(size):
        words = list(base)
        for at in draw.sample(range(150), draw.randrange(5, 8) if i % 3 == 0 else draw.randrange(3)):
            words[at] = f"w{draw.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_a_large_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    texts = family(random.Random(5), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = []

    def counted(pairs, *rest, verified=near.verified):
        read.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near, "verified", counted)
    monkeypatch.setattr(near, "LARGE", 8, raising=False)
    found = {r["doc_id"]: r["class_id"] for r in near.classes(docs, bands=8, depth=2).collect()}
    bags = [near.bag(text) for text in texts]
    least = list(range(len(texts)))
    for _ in texts:  # the least text that similar ones lead to
        least = [min(least[j] for j in range(len(texts)) if near.overlap(bags[i], bags[j]) >= near.SIMILARITY) for i in range(len(texts))]
    assert found == dict(enumerate(least))
    assert len(set(least)) > 15 and sum(read) < 400


def test_maps_leave_out_no_similar_pair(spark):
    """Counts above one, texts with more runs than a map has bits, and families of edits: every pair above the limit is in reach."""
    draw = random.Random(6)
    texts = family(draw, 40) + ["la " * n for n in (5, 6, 300, 320)]
    long = [f"v{draw.randrange(10**6)}" for _ in range(5000)]
    texts += [" ".join(long), " ".join(long[:4700]), " ".join(long[:2000])]
    bags = [near.bag(text) for text in texts]
    rows = spark.createDataFrame([(i, text, int(bags[i][1].sum())) for i, text in enumerate(texts)], "rep long, text string, total long")
    rows = rows.select("rep", "total").join(near.maps_of(rows), "rep")
    other = rows.select(*[F.col(name).alias(f"pivot_{name}") for name in rows.columns])
    reach = {(r["rep"], r["pivot_rep"]) for r in rows.crossJoin(other).where(near.in_reach(0.8)).collect()}
    similar = {(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags) if near.overlap(a, b) >= 0.8}
    assert similar <= reach and len(reach) < len(texts) ** 2 / 2


@pytest.mark.parametrize("size", [3, 100, 10**5])
def test_queries_together_find_what_each_finds_alone(size):
    """Components of either precision, segments of many and of few rows, ties, fewer rows than asked for."""
    draw = np.random.default_rng(size)
    vectors = draw.integers(-size, size + 1, (500, 8))
    ids = draw.permutation(500)
    for rows in (500, 4, 1):
        block = topk.Block(ids[:rows], vectors[:rows])
        found = block.top(ids[:70], vectors[:70], 5)
        for i, (got, scores) in enumerate(found):
            want = sorted((-int(vectors[j] @ vectors[i]), int(ids[j])) for j in range(rows) if j != i)[:5]
            assert [(-int(s), int(g)) for g, s in zip(got, scores)] == want


def test_blocks_in_arrays_find_what_rows_find(spark, monkeypatch):
    """Buckets compared block by block give the pairs of the join, in few rounds, whatever the blocks' size."""
    draw = random.Random(9)
    texts = family(draw, 40) + ["no word of the others is in here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds = []

    def counted(rows, low, high, *rest, candidates=near.candidates):
        pairs = candidates(rows, low, high, *rest)
        rounds.append((low, high, {tuple(r) for r in pairs.select("a", "b").collect()}))
        return pairs

    monkeypatch.setattr(near, "candidates", counted)
    monkeypatch.setattr(near, "LARGE", 8)
    found = []
    for blocked, side in ((1000, 2048), (1, 16)):
        monkeypatch.setattr(near, "BLOCKED", blocked, raising=False)
        monkeypatch.setattr(near, "PIVOTS", side)
        monkeypatch.setattr(near, "MEMBERS", side)
        rounds.clear()
        found.append((near.classes(docs, bands=6, depth=2).collect(), list(rounds)))
        assert len(rounds) <= 4
    assert all(rounds == found[0][1] and sorted(rows) == sorted(found[0][0]) for rows, rounds in found)
    assert any(pairs for *_, pairs in found[0][1][1:])
