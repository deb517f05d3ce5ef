"""Hard negatives, SimHash and the prefix trie against brute force, with odd rows, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import negatives, simhash, trie
from riskloom.llm.queries import QUERIES


# -- hard negatives ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, row long, chunk string, d string, a int"


def vectors(spark, rows):
    """Rows (id, vector, label) with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "c", "d", 2) for r in rows], VECTORS)


def mined(rows, divisor):
    """The contract, row by row."""
    whole = {(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in whole:
        if i % divisor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        for s, j, _ in [t for t in scored if t[2] == label][:5]:
            fit = [(t, k) for t, k, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("CHUNK", 40), ("BLOCK", 8), ("ANCHORS", 5)):
        monkeypatch.setattr(negatives, name, value)


def as_rows(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_against_brute_force(spark, small_blocks):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.25, draw.gauss(0, 1)]) for _ in range(4)], draw.choice([0, 0, 1, 2])) for i in range(150)]
    rows += [(i, [1.0, 1.0, 0.5, 0.0], draw.choice([0, 1])) for i in range(150, 200)]  # one vector, many ids: ties
    rows += [(i, [draw.gauss(0, 1), 1.0], i % 2) for i in range(200, 230)]  # another length
    rows += [(7, [0.1] * 4, 1), (7, [0.1] * 4, 1), (8, None, 1), (9, [None, 1.0, 1.0, 1.0], 1), (10, [float("nan")] * 4, 0), (11, [float("inf")] * 4, 0)]
    rows += [(None, [1.0] * 4, 0), (12, [1.0] * 4, None), (13, [], 0), (14, [], 0), (15, [], 1), (20, [], 0)]
    found = negatives.hard_negatives(vectors(spark, rows), lambda i: i % 10 == 0)
    want = mined(rows, 10)
    assert len(want) > 200 and as_rows(found) == want


def test_hard_negatives_of_large_components(spark, small_blocks):
    draw = random.Random(4)
    rows = [(i, [draw.choice([1e6, 3e5]), draw.gauss(0, 1), draw.gauss(0, 1) * 1e4], i % 2) for i in range(60)]
    want = mined(rows, 10)  # sums beyond 2^53
    assert max(r[4] for r in want) > 2**53 and as_rows(negatives.hard_negatives(vectors(spark, rows), lambda i: i % 10 == 0)) == want


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors(spark, []), lambda i: i % 10 == 0).count() == 0


def test_blocks_follow_the_curve():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = negatives.hilbert(points, 3)
    assert len(set(keys)) == len(points)
    walk = points[sorted(range(len(points)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_leave_blocks_unread(spark, small_blocks):
    """Bounds hold for every row, and with rows in clusters most blocks are never needed."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 6)) * 4
    rows = [(i, (centres[i % 8] + draw.normal(size=6) * 0.05).tolist(), i % 8) for i in range(320)]
    table, zones = negatives.stored(vectors(spark, rows))
    lines = {}
    for r in table.collect():
        lines.setdefault((r["block"], r["label"]), []).append(r["v"])
    anchor = np.floor(256 * np.array([rows[0][1]]))
    kept = zones.collect()
    assert sum(z["n"] for z in kept) == 320
    for z in kept:
        least, most = negatives.bounds(anchor, np.array([z["low"]]), np.array([z["high"]]))
        scores = np.array(lines[z["block"], z["label"]]) @ anchor[0]
        assert most[0, 0] >= scores.max() or z["n"] < len(scores)
        assert least[0, 0] <= scores.min() or z["n"] < len(scores)
    chosen = table.where("vec_id = 0").select(F.col("row").alias("a"), F.col("vec_id").alias("id"), "label", "d", "v", F.lit(0).alias("part"))
    best = sorted((-int(np.floor(256 * np.array(v)) @ anchor[0]) for i, v, label in rows if label == 0 and i), reverse=False)[4]
    asked = chosen.withColumns({"lo": F.array(F.lit(-best)), "hi": F.array(F.lit(negatives.LONG))})
    chunks = max(z["chunk"] for z in kept) + 1
    needed = negatives._zones_met(zones, asked, (chunks, 1), True, 5, seeds=False).select("block").distinct().count()
    assert 0 < needed < len({z["block"] for z in kept}) / 2


# -- SimHash ------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, fp long, part int, root long, rep long, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in rows], DOCS)


def bits_of(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts_of(prints, distance=3):
    """Components by comparing all pairs."""
    values = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance):
            root[find(i)] = find(i + 1 + int(j))
    return {int(v): find(i) for i, v in enumerate(values)}


def expected(rows):
    prints = [(i, bits_of(t)) for i, t in rows]
    part = parts_of([p for _, p in prints])
    least = defaultdict(list)
    for i, p in prints:
        least[part[p]] += [i] if i is not None else []
    return sorted(((i, f"{p:016x}", min(least[part[p]], default=None)) for i, p in prints), key=repr)


def found_classes(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_simhash_query_against_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found_classes(QUERIES["op12_simhash"](spark, folder)) == expected(rows)


def test_simhash_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one two"), (5, "One\x0btwo"), (None, "a b c"), (6, "A b  c"), (6, "A b  c"), (None, "é è x y"), (7, "lorem ipsum dolor " * 70000)]
    assert found_classes(simhash.classes(docs(spark, rows))) == expected(rows)
    assert simhash.classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [8, 10**6])
def test_links_of_a_large_drifting_group(spark, tile):
    """Prints that drift by a bit or two at a time, unrelated ones, and two clouds: components as by all pairs, and few links."""
    draw = random.Random(7)
    prints, here = [], draw.getrandbits(64)
    for _ in range(150):
        here ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
        prints.append(here)
    for centre in (0, draw.getrandbits(64)):
        prints += [centre ^ (1 << draw.randrange(24)) ^ (1 << draw.randrange(24)) for _ in range(200)]
    prints = sorted({*prints, *[draw.getrandbits(64) for _ in range(300)], 2**64 - 1})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    pairs = simhash.links(frame, tile=tile).collect()
    linked = defaultdict(set)
    for a, b in pairs:
        a, b = a % 2**64, b % 2**64
        assert bin(a ^ b).count("1") <= 3
        linked[a].add(b)
        linked[b].add(a)
    seen, groups = set(), 0
    part = parts_of(prints)
    for p in prints:
        if p not in seen:
            groups, stack, member = groups + 1, [p], set()
            while stack:
                q = stack.pop()
                if q not in member:
                    member.add(q)
                    stack += linked[q]
            seen |= member
            assert member == {q for q in prints if part[q] == part[p]}
    assert groups == len(set(part.values()))


def test_masks_keep_every_close_pair():
    chosen = [m % 2**64 for m in simhash.masks()]
    draw = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(not flips & m for m in chosen)


# -- prefix trie --------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos long, size string, key int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], TURNS)


def tree(rows):
    """The contract's nodes by walking every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[n] for n in below)
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(frame):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def trie_of(spark, rows, shard):
    return nodes_of(trie.prefix_trie(trie.branched(trie.numbered(conversations(spark, rows))), shard))


@pytest.mark.parametrize("shard", [3, 2048])
def test_trie_against_every_prefix(spark, shard, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 4)
    draw = random.Random(11)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "ccc"])) for c in range(60) for t in range(draw.randrange(1, 14))]
    rows += [(100 + c, t, "user", "same") for c in range(40) for t in range(3)]  # one conversation many times
    assert trie_of(spark, rows, shard) == tree(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (3, 1, "user", "tie"), (3, 1, "a", "tie"), (5, 2, "user", ""), (-3, 0, "user", "b"), (-5, 0, "user", "b"), (0, 0, "user", "b")]
    rows += [(8, t, "user", "long " * 20000) for t in range(30)] + [(9, 0, "user", "absent base")]
    assert trie_of(spark, rows, 2) == tree(rows)
    assert trie.prefix_trie(trie.branched(trie.numbered(conversations(spark, [])))).count() == 0
