"""Licence wording, sketches of signatures, state that goes on, bounds by rows, and clashing names in the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import exact, licenses, near, quality

SCHEMA = "doc_id long, text string"


def labels_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r["labels"] for r in licenses.scan(docs, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_license_wording(spark, k):
    long = next(t for t in licenses.NOTICES if len(t.split()) > 50)
    cut = long.split()
    texts = [
        "Apache License, Version 2.0",
        "// SPDX-License-Identifier: MIT",
        "Released under what is called the MIT License.",  # three words put in: not within the drift
        "released under the quite free MIT license",  # a run of three words is broken
        " ".join(cut[:20] + cut[25:]),
        " ".join(cut[:16]),  # the short notice alone
        "licensed under cc by 4.0",
        "license apache the 0 2 version",
        "",
        None,
    ]
    found = labels_of(spark, texts, k=k)
    assert found == ["apache-2.0", "mit", "", "" if k == 3 else "mit", "mit", "mit", "cc-by", "", "", ""], found


@pytest.mark.parametrize("k", [2, 3])
def test_license_spans_against_alignment(spark, k):
    """Random texts over few words: the labels are those that a plain count by diagonals gives."""
    draw = random.Random(k)
    notices = {"a b c d e f g h i j": "ten", "a b a b": "four"}
    texts = [" ".join(draw.choice("abcdefghij") if draw.random() < 0.2 else "abcdefghij"[i % 10] for i in range(draw.randrange(14))) for _ in range(300)]
    want = []
    for text in texts:
        w, got = text.split(), set()
        for notice, label in notices.items():
            t = notice.split()
            votes = [(i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
            for start in {d for d, _, _ in votes}:
                mine = [(i, j) for d, i, j in votes if start <= d <= start + licenses.DRIFT]
                covered = {j + x for _, j in mine for x in range(k)}
                length = max(i for i, _ in mine) + k - min(i for i, _ in mine)
                if len(covered) >= (len(t) if len(t) < 10 else 8) and length <= len(t) + licenses.DRIFT:
                    got.add(label)
        want.append(",".join(sorted(got)))
    assert labels_of(spark, texts, base={}, notices=notices, k=k) == want and len(set(want)) > 1


def test_sketches_count_differing_bytes(spark):
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 4, 32).astype(np.uint8) * np.uint8(85) for _ in range(2))
    row = [(a.view(np.int64).tolist(), b.view(np.int64).tolist())]
    frame = spark.createDataFrame(row, "a array<long>, b array<long>")
    assert frame.select(near.differing(F.col("a"), F.col("b"), 4)).first()[0] == int((a != b).sum())


def test_the_sketch_bound_keeps_similar_pairs():
    bound = near.most_differing(125, 0.8)
    assert (np.random.default_rng(2).binomial(125, 0.2, 200_000) > bound).sum() == 0
    assert near.most_differing(10, 0.01) == 10 and near.most_differing(125, 1.0) == 0


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_by_similarity(spark, similarity):
    """Pairs whose similarity lies just above a level: all are found, among texts that share half of their words with all others."""
    draw, texts, close = random.Random(7), [], 0
    common = [f"c{i}" for i in range(150)]
    for _ in range(60):
        own = [f"w{draw.randrange(10**6)}" for _ in range(150)]
        text = common + own
        other = list(text)
        while near.overlap(near.bag(" ".join(text)), near.bag(" ".join(other))) > similarity + 0.04:
            other[draw.randrange(len(other))] = f"x{draw.randrange(10**6)}"
        if near.overlap(near.bag(" ".join(text)), near.bag(" ".join(other))) >= 0.8:
            close += 1
        texts += [" ".join(text), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = near.classes(docs).where("class_id <> doc_id").collect()
    assert all(r["class_id"] == r["doc_id"] - 1 and r["doc_id"] % 2 for r in found)
    assert len(found) == close and close > 30


def test_exact_state_goes_on(spark, tmp_path):
    draw = random.Random(3)
    parts = [[(i, draw.choice(["a", "a b", "c", "longer text", f"t{i}"])) for i in range(n, n + 60)] for n in (0, 60, 120)]
    folder = str(tmp_path)
    for i, part in enumerate(parts):
        got = exact.deduplicate(spark.createDataFrame(part, SCHEMA), folder=folder).drop("file", "row").collect()
        fresh = exact.deduplicate(spark.createDataFrame(sum(parts[: i + 1], []), SCHEMA)).drop("file", "row").collect()
        assert sorted(got) == sorted(fresh)
    again = spark.read.parquet(f"{folder}/state").groupBy("batch").count().count()
    assert again == 3  # a batch a call: earlier files are not read into the state again


def test_quality_learns_one_text_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, marks: seen.append(len(bags)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "other") for i in range(2, 9)], SCHEMA)
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    quality.learn(docs, marks, sample=4)
    assert seen == [4]


ROWS = [(1, "one two three"), (1, "one two  three"), (2, None), (3, ""), (None, "one two three"), (None, None), (4, "x y z " * 3000), (4, "x y z " * 3000)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_of_odd_rows_and_clashing_names(spark, name, stage):
    schema = "doc_id long, text string, lang string, n_chars long, _id long, _sha string, _d string, digest string, n long, file string, content map<string,int>"
    rows = [(i, t, "en", 1, 7, "s", "d", "e", 5, "f", {"a": 1}) for i, t in ROWS]
    for these in (rows, []):
        docs = spark.createDataFrame(these, schema)
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        ids = sorted((r["doc_id"] or 0, r["_sha"], r["content"]["a"]) for r in kept.collect())
        if not these:
            assert ids == []
        elif name == "exact_copies":
            assert [i for i, *_ in ids] == [1, 2, 4]  # the longer spelling of id 1, an empty text, one long text
        elif name == "near_copies":
            assert [i for i, *_ in ids].count(4) >= 1 and {2, 3} <= {i for i, *_ in ids}
        elif name == "secrets":
            assert len(ids) == len(rows)


def test_rounds_of_near_copies_take_the_driver_few_broadcasts(spark, monkeypatch):
    """Roots of several rounds, met step by step, are those of brute force; tables that the rounds join are sorted, not broadcast one by one."""
    draw, texts = random.Random(5), []
    for _ in range(6):  # chains, so that roots meet in later rounds too
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            texts.append(" ".join(words))
            words[draw.randrange(120)] = f"v{draw.randrange(10**6)}"
    bags, root = [near.bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near.overlap(bags[i], bags[j]) >= near.SIMILARITY:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    plans, settled = [], near.Scratch.settle

    def kept(self, frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return settled(self, frame)

    monkeypatch.setattr(near.Scratch, "settle", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    assert got == dict(enumerate(root))
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(joins) > 20 and sum("strategy=merge" in line for line in joins) > len(joins) / 2


def test_components_of_links_given_in_any_order(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(45)] + [(7, 7), (300, 299)]
    root = {x: x for link in links for x in link}
    for a, b in links:
        root = {x: min(root[a], root[b]) if r in (root[a], root[b]) else r for x, r in root.items()}
    frame = spark.createDataFrame(draw.sample(links, len(links)), "a long, b long")
    assert {r["rep"]: r["root"] for r in near.components(frame).collect()} == root
    met = near.joined(near.components(frame), spark.createDataFrame([(0, 0), (299, 0), (500, 500), (501, 500)], "rep long, root long"))
    want = {**{x: 0 if r == 299 else r for x, r in root.items()}, 500: 500, 501: 500}
    assert {r["rep"]: r["root"] for r in met.collect()} == want
