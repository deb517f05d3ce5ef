"""Operators mended this round: words encoded once, snippets from anywhere, vectors of several lengths and large components, bags and signatures."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language, near, packing, sentencepiece, topk
from riskloom.llm.queries import PIECES, WORDS, vocabulary


def test_words_encoded_once_equal_whole_texts(folder):
    """All documents of two folders, and texts of every kind of character, as the tokenizer itself encodes them."""
    encoder = packing.Encoder(vocabulary(WORDS))
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' UNION ALL SELECT text FROM '{folder.replace('0.001', '0.01')}/documents.parquet'").fetchall()]
    draw = random.Random(1)
    kinds = ["a", "B", "É", "ß", "İ", "'", "'s", "'RE", "1", "²", "½", " ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "-", "--", "_", "ж", "Ж", "Σ", "ς", "é", "你", "😀", "<|endoftext|>", "<|", "ǅ", "ª", "\xad", "​"]
    texts += ["".join(draw.choice(kinds) for _ in range(draw.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(draw.choice([*range(32, 127), *range(0xA1, 0x250), *range(0x400, 0x460)])) for _ in range(60)) for _ in range(2000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert sum(encoder.words(t) is not None for t in texts) > len(texts) / 3


def test_a_full_word_table_starts_anew(folder, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 5)
    encoder = packing.Encoder(vocabulary(WORDS))
    for text in ("one two three four", "five six seven eight", "one two five six nine ten"):
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [400_000, 3])
def test_pieces_of_words_equal_those_of_whole_texts(folder, most):
    """Ids and decoded texts of words, encoded and decoded once and forgotten now and then, as the tokenizer has them for whole texts."""
    with open(vocabulary(PIECES), "rb") as file:
        encoder = sentencepiece.Encoder(sentencepiece.parse_model(file.read()))
    encoder.units.most = most
    draw = random.Random(2)
    kinds = ["a", "é", "你", "😀", " ", "  ", "\n", "▁", "<0x41>", "<s>", "\x00", "\ufffd", "\u200b", "the", "-"]
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall()]
    texts += ["".join(draw.choice(kinds) for _ in range(draw.randrange(30))) for _ in range(2000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 500):
        ids, back = encoder.run(texts[at : at + 500])
        assert [x.tolist() for x in ids] == want[at : at + 500]
        assert back == encoder.tokenizer.decode_batch(want[at : at + 500], skip_special_tokens=False)
    assert sum(map(encoder.plain, texts)) > len(texts) / 5
    if most > 1000:  # a word met before is neither encoded nor decoded again
        encoder.bare = None if not encoder.bare else type("Spent", (), {})()
        plain = [t for t in texts if encoder.plain(t)]
        assert len(encoder.run(plain)[0]) == len(plain)


def test_language_does_not_learn_a_shared_head(spark):
    """Texts of two languages that all begin alike, for longer than a snippet, are told apart all the same."""
    draw, head = random.Random(2), "notice to all readers of this page " * 40
    words = {"aa": ["kato", "miro", "velu", "sanko", "rimato"], "bb": ["thwyx", "gralch", "prunth", "skwer", "blorg"]}
    rows = [(i, head + " ".join(draw.choice(words[lang]) for _ in range(400)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    books = language.learn(docs)
    assert all(len(book) <= 110_000 for book in books.values())
    asked = spark.createDataFrame([(1, "velu kato sanko rimato miro miro", ""), (2, "blorg skwer gralch thwyx prunth", ""), (3, "² ½ 7", ""), (4, None, "")], docs.schema)
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, books).collect()}
    assert found == {1: "aa", 2: "bb", 3: "und", 4: "und"}


@pytest.mark.parametrize("large", [1.0, 1e8])
def test_topk_of_lengths_and_large_components(spark, large):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.25, -0.5, draw.gauss(0, 1)]) * draw.choice([1.0, large]) / (1.0 if large == 1.0 else 300.0) for _ in range(3 if i % 4 else 2)]) for i in range(120)]
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan"), 1.0]), (None, [1.0, 1.0]), (3, rows[3][1])]
    table = spark.createDataFrame([(*r, 1, "d") for r in rows], "vec_id long, embedding array<double>, v int, d string")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows[:120]}
    want = set()
    for i in range(0, 120, 10):
        scored = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in whole if j != i and len(whole[j]) == len(whole[i]))
        want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:5], 1)}
    values = topk.quantised(table)
    found = topk.top_k(values, values.where(F.col("vec_id") % 10 == 0))
    assert {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()} == want
    none = topk.quantised(table.limit(0))
    assert topk.top_k(none, none).count() == 0


def test_bags_count_the_runs_of_plain_words():
    texts = ["", None, "a", "A b", "É_x ß İstanbul ΣΑΣ 日本 語 x² a-b", "a " * 30_000, "b" * 300_000 + " c", "\ud800 á b", "one two three four five six one two three four five"]
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        size = min(len(words), 5)
        runs = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else {}
        hashes, counts = near.bag(text)
        assert sorted(counts.tolist()) == sorted(runs.values()) and len(set(hashes.tolist())) == len(runs)
    left, right = near.bag("Zwei  Wörter und, noch drei"), near.bag("zwei wörter\nund noch DREI")
    assert left[0].tolist() == right[0].tolist()
    longer = near.bag("w " * near.PIECE + "v u")
    assert longer[1].sum() == near.PIECE + 2 - 4


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    bags = [(np.unique(rng.integers(1, 2**63, n).astype(np.uint64)), None) for n in (1, 3, 40, 900, 9000)]
    bags = [(hashes, rng.integers(1, 6, len(hashes))) for hashes, _ in bags] + [near.bag("")]
    together = near.signatures(bags, 125)
    for i, one in enumerate(bags):
        assert (near.signatures([one], 125)[0] == together[i]).all()


def test_parts_of_a_batch_hold_every_row_once():
    texts = ["x" * n for n in (5, near.BATCH, 7, near.BATCH * 2, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [part.column("text").to_pylist() for part in near.in_parts(batch)]
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= near.BATCH for part in parts)


def test_parts_of_a_given_size_hold_every_row_once():
    texts = ["ab", None, "c" * 9, "", "d", "ef", "g"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [part.column("text").to_pylist() for part in near.in_parts(batch, 4)]
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 4 for part in parts) and len(parts) > 2
