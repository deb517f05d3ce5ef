"""Operators for training data: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat, exact, language, licenses, near, packing, quality, secrets, sentencepiece, topk
from riskloom.llm.queries import PIECES, QUERIES, WORDS, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, uid long"
LONG = "lorem ipsum dolor " * 8000


def table(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, 1, "d", 2, 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b c d e f"), (4, LONG), (5, " a\tb ")])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def documents(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def piece_model():
    with open(vocabulary(PIECES), "rb") as file:
        return file.read()


def test_odd_rows_and_empty_tables(odd, none, piece_model):
    words = vocabulary(WORDS)
    runs = [
        lambda d: sentencepiece.encode(d, piece_model),
        licenses.scan,
        exact.deduplicate,
        secrets.scan,
        lambda d: language.predict(d, language.learn(d)),
        lambda d: quality.score(d, quality.train([], np.zeros(0))),
    ]
    for run in runs:
        assert run(odd).count() == 7
        assert run(none).count() == 0
    assert near.classes(odd).count() == 6 and near.classes(none).count() == 0
    assert packing.pack(none, words).count() == 0
    assert packing.pack(odd, words).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_sentencepiece_round_trip(spark, folder, piece_model):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sentencepiece.encode(docs, piece_model)
    assert rows.where("NOT parity").count() == 0
    assert rows.join(docs, "doc_id").where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert sentencepiece.decode(rows, piece_model).join(rows, "doc_id").where("text <> decoded").count() == 0


def test_licenses_against_a_scan(spark, folder, documents):
    for row in QUERIES["op2_licenses"](spark, folder).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), documents[row["doc_id"]])
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(found)) if found[i : i + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(found), len(places), ",".join(sorted(labels)))
        assert (row["first_word"], row["last_word"]) == ((min(places), max(places)) if places else (None, None))


def test_license_with_a_word_put_in(spark):
    docs = table(spark, [(1, "this is licensed under the new apache license, version 2.0 here"), (2, "under the apache tree")])
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()} == {1: "apache-2.0", 2: ""}


def test_top_k_against_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-60, 60, (300, 12))
    vectors[17] = vectors[18]
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, v array<int>")
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(rows, rows.where("vec_id % 50 = 0")).collect()}
    for q in range(0, 300, 50):
        best = sorted(((-int(vectors[q] @ vectors[i]), i) for i in range(300) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_quantised_leaves_out_broken_vectors(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.001]), (2, [None, 1.0]), (3, None), (4, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.quantised(rows).collect()] == [(1, [128, -1])]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    a, b = (keys, rng.integers(1, 9, 60)), (keys[5:], rng.integers(1, 9, 55))
    marks = near.signatures([a, b], 4000)
    assert abs((marks[0] == marks[1]).mean() - near.overlap(a, b)) < 0.035


def test_near_classes_against_all_pairs(spark, folder, documents):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_near"](spark, folder).collect()}
    bags, root = {i: near.bag(t) for i, t in documents.items()}, {i: i for i in documents}
    for i in sorted(bags):
        for j in sorted(bags):
            if i < j and root[i] != root[j] and near.overlap(bags[i], bags[j]) >= near.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == root


def test_near_classes_of_a_large_drifting_group_against_all_pairs(spark):
    """Copies of copies: most lie far from any pivot, and the one link of a text may be to a text placed long ago."""
    rng = random.Random(3)
    group = [[f"w{rng.randrange(3000)}" for _ in range(120)]]
    for _ in range(599):
        words = list(group[rng.randrange(len(group))])
        for _ in range(rng.choice((1, 2, 2, 3))):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        group.append(words)
    texts = [" ".join(words) for words in group]
    bags, root = [near.bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near.overlap(bags[i], bags[j]) >= near.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = [low if v == high else v for v in root]
    got = {r["doc_id"]: r["class_id"] for r in near.classes(table(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(root))


def test_near_copies_of_texts_that_share_an_id(spark, folder):
    import corpus_pipeline

    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    docs = table(spark, [(7, words[0]), (7, words[1]), (7, words[2]), (8, words[0] + " x"), (9, words[1] + " x"), (3, words[2] + " x")])
    links = sorted((r["doc_id"], r["n_links"]) for r in near.classes(docs).collect())
    assert links == [(3, 1), (7, 1), (7, 1), (7, 1), (8, 1), (9, 1)]
    kept = corpus_pipeline.near_copies(spark, docs, folder)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, words[2] + " x"), (7, words[0]), (7, words[1])]


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a<[\\b", 0.2), ("t", 3, 1, "assistant", None, 0.9), ("t", 4, 3, "user", "[INST]\n", 1.0), ("t", 8, 9, None, "x", 0.0)]
    rows += [("c", 1, 2, "user", "round", 1.0), ("c", 2, 1, "user", "round", 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    paths = chat.paths(nodes).collect()
    assert sorted((r["leaf"], r["depth"], r["node"]) for r in paths) == [(2, 0, 1), (2, 1, 2), (4, 0, 1), (4, 1, 3), (4, 2, 4), (8, 0, 8)]
    best = chat.format_trees(nodes, branches=1)
    assert [r["leaf"] for r in best.collect()] == [4]
    read = best.select(F.explode(chat.parsed(F.col("formatted"))).alias("t")).select("t.role", "t.text").collect()
    assert [tuple(r) for r in read] == [("user", "q"), ("assistant", ""), ("user", "[INST]\n")]


@pytest.mark.parametrize("name", ["op6_quality", "op7_language"])
def test_held_out_accuracy(spark, name):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, folder).where("held_out")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    right = F.col("predicted") == F.col("quality") if name == "op6_quality" else F.col("lang_pred") == F.col("lang")
    joined = rows.join(labels if name == "op6_quality" else docs, "doc_id")
    assert joined.agg(F.avg(right.cast("int"))).first()[0] >= 0.93


def test_language_without_letters_and_ties():
    assert language.judged("123 !", (("en", b"x"),)) == ("und", 0.0, True)
    assert language.judged(None, ()) == ("und", 0.0, True)
    assert language.judged("same", (("a", b"words of one"), ("b", b"words of one")))[2]


def test_packing_keeps_every_id(spark, folder, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(WORDS))
    rows = sorted(QUERIES["op8_packing"](spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"]))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in documents.items()}
    at = dict.fromkeys(ids, 0)
    for r in rows:
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : at[r["doc_id"]]], "<u4").tobytes()) == r["ids_crc32"]
    assert at == {i: len(v) for i, v in ids.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and sum(v < 4096 for v in ends.values()) <= 1


def test_secrets(spark):
    body = "x" * 30  # no run of hex digits
    good, bad = f"ghp_{body}{secrets.base62_crc(body)}", f"npm_{body}000000"
    text = f'İ PassWord = "hunter22" {good} {bad} api-key: no token:short AKIA{"A" * 16}B {"0f" * 12}'
    spans = secrets.secrets_of(text)
    assert [k for _, k, _ in spans] == ["assign", "checked", "access", "hex"]
    assert text[spans[1][0] : spans[1][2]] == good
    row = secrets.scan(table(spark, [(1, text)])).first()
    base = [s for s in spans if s[1] != "checked"]
    assert row["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert good not in row["redacted"] and bad in row["redacted"]
    assert secrets.redact(table(spark, [(1, None), (2, "plain")])).orderBy("doc_id").select("text").collect() == [(None,), ("plain",)]


def test_exact_copies_when_digests_collide(spark):
    texts = [(1, "a b"), (2, "ab"), (3, "  a b"), (4, "cd"), (5, None), (6, " "), (7, "cd")]
    want = {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (4, 2), 5: (6, 2), 6: (6, 2), 7: (4, 2)}
    for digest in (exact.sha, lambda norm: F.lit("one")):
        rows = exact.deduplicate(table(spark, texts), digest=digest).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == want
        assert sorted(r["doc_id"] for r in rows if r["kept"]) == [3, 4, 6]


def test_native_plans(spark, folder):
    for name in ("op5_chat", "op10_exact"):
        text = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(node in text for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))


def test_queries_with_sql(spark, folder):
    from check import compare, connect

    for name in ("op3_topk", "op5_chat", "op10_exact"):
        agrees, text = compare(spark, connect(folder), folder, name)
        assert agrees, text


def test_pipeline_against_its_stages(spark, folder, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = corpus_pipeline.languages(spark, docs, folder)
    unique = corpus_pipeline.exact_copies(spark, told, folder)
    assert unique.columns == docs.columns
    norms = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in told.collect()}
    assert unique.count() == len(norms)
    apart = corpus_pipeline.near_copies(spark, unique, folder)
    assert apart.count() == near.classes(unique).select("class_id").distinct().count()
    clean = corpus_pipeline.without_secrets(spark, apart, folder)
    assert clean.count() == apart.count() and not any(secrets.secrets_of(r["text"]) for r in clean.collect())
    packed = corpus_pipeline.sequences(spark, clean, folder)
    assert packed.select("doc_id").distinct().count() == clean.count()
