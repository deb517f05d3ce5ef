"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of bags of word runs, banded and verified.

A text's bag holds its runs of five words with their counts (texts of fewer words: one run of them all).
Texts without words are no one's duplicate, each a class of its own. Null counts as empty. Repeated rows
fall in one class. Only the named columns are read; rows without an id take no part.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import Scratch, settle

WORDS, SIMILARITY, BANDS, DEPTH = 5, 0.8, 25, 5
PIVOTS, MEMBERS = 2048, 2048
MISSED = 1e-6
GAP, PIECE = re.compile(r"\W"), 1 << 18
BATCH, POINTS, AT_ONCE = 1 << 18, 4096, 16
STEP = np.uint64(0x9FB21C651E98DF25)  # odd, so that words or runs that differ in one place differ
HOT = 1000
LARGE, MAPS, SIDES = 64, 16, 512  # rows of a bucket above which its texts get a map of their runs, longs of a map, pairs read at once
BLOCKED, CELLS = 256, 1 << 18  # rows of a bucket above which it is compared block by block, pairs compared at once
MAP = [f"map{i}" for i in range(MAPS)]
FEW = 1_000_000  # numbers of texts that may be broadcast, eight bytes each


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point a 64-bit value, and whether it belongs to a word."""
    return mixed(np.arange(0x110000, dtype=np.uint64)), np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(0x110000)), bool, 0x110000)


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, in order: the values of its letters times powers of STEP, added up at 64 bits."""
    values, in_word = letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = in_word[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(lengths.max(), STEP, np.uint64))
    offset = np.arange(starts[-1] + lengths[-1]) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(values[points[inside]] * powers[offset], starts))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's word runs, sorted, and their counts."""
    text, pieces, start = (text or "").lower(), [], 0
    while start < len(text):  # pieces end between words, so that a long text needs little memory at once
        cut = GAP.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        pieces.append(word_hashes(text[start:end]))
        start = end
    words = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    if not len(words):
        return words, np.zeros(0, np.int64)
    length = min(len(words), WORDS)
    runs = np.full(len(words) - length + 1, length, np.uint64)
    for j in range(length):
        runs = runs * STEP + words[j : j + len(runs)]
    return np.unique(mixed(runs), return_counts=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """One signature of ``size`` 64-bit values per bag; two agree in a slot with probability weighted Jaccard.

    The weights 1, 2, 3, … of an element are cut into the dyadic ranges (0,1], (1,2], (2,4], (4,8], …; each
    has a Poisson process of its own with rate ``size`` times its width, every point of which falls on a
    random slot and a random weight of the range. A bag takes the points up to its weight, in each
    slot the earliest. Points come in order of time, so a range is left once it is past the bag's latest slot.
    """
    times, marks = np.full((len(bags), size), np.inf), np.zeros((len(bags), size), np.uint64)
    owner, seed, low, width, weight = [], [], [], [], []
    for i, (hashes, counts) in enumerate(bags):
        level, bottom = 0, 0
        left = np.arange(len(hashes))
        while len(left):
            top = 1 << level
            owner.append(np.full(len(left), i))
            with np.errstate(over="ignore"):
                seed.append(mixed(hashes[left] ^ mixed(np.full(len(left), level, np.uint64))))
            low.append(np.full(len(left), bottom))
            width.append(np.full(len(left), top - bottom))
            weight.append(counts[left])
            left, bottom, level = left[counts[left] > top], top, level + 1
    if not owner:
        return marks
    owner, seed, low, width, weight = map(np.concatenate, (owner, seed, low, width, weight))
    at, rate = np.zeros(len(owner)), size * width.astype(float)
    flat_times, flat_marks = times.reshape(-1), marks.reshape(-1)
    step = 0
    while len(owner):
        # Few processes draw several points at once; which points there are does not depend on that.
        count = 1 if len(owner) > POINTS else AT_ONCE
        draw = mixed(seed[:, None] ^ mixed(np.arange(step, step + count, dtype=np.uint64)))
        step += count
        gaps = np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[:, None]
        whens = at[:, None] - (gaps if count == 1 else np.cumsum(gaps, axis=1))
        at = whens[:, -1]
        second = mixed(draw)
        slot = (owner * size)[:, None] + ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        hit = whens < flat_times[slot]
        wide, point = np.nonzero(hit & (width > 1)[:, None])
        place = low[wide] + 1 + ((second[wide, point] & np.uint64(0xFFFFFFFF)) % width[wide].astype(np.uint64)).astype(np.int64)
        hit[wide, point] = place <= weight[wide]
        slots, when, value = slot[hit], whens[hit], second[hit]
        np.minimum.at(flat_times, slots, when)
        first = when == flat_times[slots]
        flat_marks[slots[first]] = value[first]
        live = at < times.max(axis=1)[owner]
        if not live.all():
            owner, seed, low, width, weight, rate, at = (x[live] for x in (owner, seed, low, width, weight, rate, at))
    return marks


def overlap(a, b) -> float:
    """Weighted Jaccard similarity of two bags."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][left], b[1][right]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def in_parts(batch: pa.RecordBatch, most: int | None = None):
    """Consecutive slices of at most ``most`` (BATCH, if not given) characters of text, a longer text alone."""
    most = most or BATCH
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def signed(texts: DataFrame, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """(rep, total, bands, sketch): per text with words the size of its bag, the hash of every band, and a byte of every slot, eight to a long."""

    def run(batches):
        for batch in batches:
            for part in in_parts(batch):
                bags = [bag(t) for t in part.column("text").to_pylist()]
                marks = signatures(bags, bands * depth)
                sketch = np.zeros((len(bags), -(-bands * depth // 8) * 8), np.uint8)
                sketch[:, : bands * depth] = marks >> np.uint64(56)
                marks, sketch = marks.reshape(len(bags), bands, depth), sketch.view(np.int64)
                keys = np.zeros((len(bags), bands), np.uint64)
                for j in range(depth):
                    keys = mixed(keys ^ marks[:, :, j])
                keys = mixed(keys ^ np.arange(bands, dtype=np.uint64))
                full = [i for i, b in enumerate(bags) if len(b[0])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep").take(pa.array(full, pa.int64())),
                        pa.array([int(bags[i][1].sum()) for i in full], pa.int64()),
                        pa.array([keys[i].view(np.int64).tolist() for i in full], pa.list_(pa.int64())),
                        pa.array([sketch[i].tolist() for i in full], pa.list_(pa.int64())),
                    ],
                    names=["rep", "total", "bands", "sketch"],
                )

    return texts.select("rep", "text").mapInArrow(run, "rep long, total long, bands array<long>, sketch array<long>")


def most_differing(size: int, similarity: float) -> int:
    """Slots of ``size`` in which texts of ``similarity`` differ: more with a chance of at most MISSED, by Chernoff's bound."""
    if similarity >= 1:
        return 0
    agree = math.floor(size * similarity)
    while agree > 0:
        p = agree / size
        gain = p * math.log(p / similarity) + ((1 - p) * math.log((1 - p) / (1 - similarity)) if p < 1 else 0.0)
        if size * gain >= -math.log(MISSED):
            break
        agree -= 1
    return size - agree


def differing(a: Column, b: Column, longs: int) -> Column:
    """Bytes in which two sketches differ."""
    total, every_other = F.lit(0), F.lit(0x00FF00FF00FF00FF)
    for i in range(longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for lane in (x, F.shiftrightunsigned(x, 8)):  # a byte that is not 0 carries into the empty one above it
            total = total + F.bit_count((lane.bitwiseAND(every_other) + every_other).bitwiseAND(F.lit(0x0100010001000100)))
    return total


def of_reps(texts: DataFrame, named: DataFrame) -> DataFrame:
    """``texts`` of the distinct ``named`` reps, or all, if more than FEW are named: what is broadcast is bounded."""
    if named.limit(FEW + 1).count() > FEW:
        return texts
    return texts.join(F.broadcast(named), "rep", "left_semi")


def maps_of(texts: DataFrame) -> DataFrame:
    """(rep, map0, map1, ...): per text the bits, of 64 a long, on which its different runs fall by their hash."""

    def run(batches):
        for batch in batches:
            for part in in_parts(batch):
                bits = np.zeros((part.num_rows, MAPS * 64), np.uint8)
                for i, text in enumerate(part.column("text").to_pylist()):
                    bits[i, (bag(text)[0] % np.uint64(MAPS * 64)).astype(np.int64)] = 1
                longs = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("rep"), *[pa.array(longs[:, i]) for i in range(MAPS)]], names=["rep", *MAP])

    return texts.select("rep", "text").mapInArrow(run, "rep long, " + ", ".join(f"{name} long" for name in MAP))


def with_maps(rows: DataFrame, maps: DataFrame | None) -> DataFrame:
    """``rows`` with the maps of their texts where their bucket is large, and empty ones elsewhere, which tell nothing."""
    if maps is None:
        return rows.select("*", *[F.lit(0).cast("long").alias(name) for name in MAP])
    mapped = rows.where(F.col("n") > LARGE).join(merged(maps), "rep")
    return mapped.unionByName(with_maps(rows.where(F.col("n") <= LARGE), None))


def in_reach(similarity: float) -> Column:
    """Whether two texts can be so similar by their maps: each bit of one alone stands for a run that the other has not.

    Common runs number at most a text's total less its bits alone, so no similar pair is left out. Maps of texts with
    several times more runs than bits are full and leave out none.
    """

    def alone(one: str, other: str) -> Column:
        return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(one + name).bitwiseAND(F.bitwise_not(F.col(other + name)))) for name in MAP])

    common = F.least(F.col("total") - alone("", "pivot_"), F.col("pivot_total") - alone("pivot_", ""))
    return common >= F.lit(similarity) * (F.col("total") + F.col("pivot_total") - common) - 1e-6


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose bags overlap by ``similarity`` or more, read from the whole texts.

    If at most FEW texts are in pairs, which is counted, only theirs are shuffled; beyond that, all are.
    """
    named = pairs.select(F.col("a").alias("rep")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = of_reps(texts, named)
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("right"))

    def run(batches):
        seen: dict[int, tuple] = {}  # pairs of one pivot mostly lie together
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, SIDES):
                some = batch.slice(start, SIDES)
                rows = zip(some.column("a").to_pylist(), some.column("left").to_pylist(), some.column("right").to_pylist())
                for i, (a, x, y) in enumerate(rows, start):
                    if a not in seen:
                        seen = {a: bag(x)}
                    if overlap(seen[a], bag(y)) >= similarity:
                        keep.append(i)
            yield batch.select(kept).take(pa.array(keep, pa.int64()))

    kept, schema = pairs.columns, pairs.schema
    return pairs.join(merged(right), "b").join(merged(left), "a").select(*kept, "left", "right").mapInArrow(run, schema)


def merged(frame: DataFrame) -> DataFrame:
    """``frame`` to be joined by sorting, of whatever size: every small table that Spark would broadcast instead takes the
    driver a thread and at least a megabyte, kept until its garbage is collected, and the rounds have dozens of joins."""
    return frame.hint("merge")


def components(links: DataFrame, settle=settle) -> DataFrame:
    """(rep, root): the least rep joined to each by ``links`` (a, b); label hopping with a table per round."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = settle(links.select(ends.alias("end")).select("end.a", "end.b").distinct())  # each is its own neighbour, too
    labels = settle(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("root")))
    while True:
        near = both.join(merged(labels), both["b"] == labels["rep"]).groupBy("a")
        near = near.agg(F.min("root").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("own"))
        hop = labels.select(F.col("rep").alias("low"), F.col("root").alias("far"))
        moved = settle(near.join(merged(hop), "low").select(F.col("a").alias("rep"), F.col("far").alias("root"), (F.col("far") < F.col("own")).alias("moved")))
        labels = moved.select("rep", "root")
        if moved.where("moved").isEmpty():
            return labels


def joined(roots: DataFrame | None, met: DataFrame) -> DataFrame:
    """(rep, root) after the roots named by ``met`` (rep, root) have met: only links between roots are followed in a round."""
    if roots is None:
        return met
    further = met.select(F.col("rep").alias("root"), F.col("root").alias("far"))
    return roots.join(merged(further), "root", "left").select("rep", F.coalesce("far", "root").alias("root")).union(met).distinct()


def in_buckets(rows: DataFrame, buckets: DataFrame, limit: float) -> DataFrame:
    """``rows`` with what ``buckets`` (band, n, ...) says of their band; those of over ``limit`` rows, fewer than HOT, are broadcast."""
    hot = buckets.where(F.col("n") > limit)
    cold = rows.join(F.broadcast(hot.select("band")), "band", "left_anti").join(merged(buckets.where(F.col("n") <= limit)), "band")
    return rows.join(F.broadcast(hot), "band").unionByName(cold)


def unsettled(rows: DataFrame, roots: DataFrame | None, limit: float) -> DataFrame:
    """``rows`` of the buckets that still hold several roots, with each row's root and whether it is the bucket's commonest."""
    if roots is None:  # every text is its own root, and the last counts as the commonest
        return rows.withColumn("root", F.col("rep")).withColumn("common", F.col("rep") == F.col("last")).drop("last")
    named = rows.join(merged(roots), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    per = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("n")).groupBy("band")
    mixed_ = per.agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("n_roots"), F.max("n").alias("n"))
    found = in_buckets(named.drop("n"), mixed_.where("n_roots > 1"), limit)
    return found.select("band", "rep", "n", "turn", "root", (F.col("root") == F.col("main")).alias("common"))


def in_blocks(members: DataFrame, pivots: DataFrame, key: list[str], similarity: float, size: int) -> DataFrame:
    """(a, b, low_root, high_root): what ``candidates`` asks of a pair, for whole blocks of members and pivots at once, CELLS pairs at a time."""
    most = most_differing(size, similarity)

    def of(table: pa.Table, before: str = ""):
        reps, totals, roots = (table[before + c].to_numpy() for c in ("rep", "total", "root"))
        sketches = np.array(table[before + "sketch"].to_pylist(), np.int64).view(np.uint8)
        return reps, totals, roots, sketches, np.stack([table[before + name].to_numpy() for name in MAP], axis=1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (reps, totals, roots, sketches, maps), (p_reps, p_totals, p_roots, p_sketches, p_maps) = of(left), of(right, "pivot_")
            slots = np.ascontiguousarray(sketches.T[:size])
            step = max(1, CELLS // len(reps))
            for at in range(0, len(p_reps), step):
                some = slice(at, at + step)
                total = p_totals[some, None]
                apart = np.zeros((len(total), len(reps)), np.int16)
                for slot, mine in zip(slots, p_sketches[some].T):
                    apart += slot != mine[:, None]
                open_ = (p_roots[some, None] != roots) & (np.minimum(total, totals) >= similarity * np.maximum(total, totals)) & (apart <= most)
                i, j = np.nonzero(open_)
                i += at
                for cut in range(0, len(i), CELLS // MAPS):
                    x, y = i[cut : cut + CELLS // MAPS], j[cut : cut + CELLS // MAPS]
                    alone, other = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in bits_alone(maps[y], p_maps[x]))
                    common = np.minimum(totals[y] - alone, p_totals[x] - other)
                    reach = common >= similarity * (totals[y] + p_totals[x] - common) - 1e-6
                    x, y = x[reach], y[reach]
                    ends = [f(u[y], v[x]) for u, v in ((reps, p_reps), (roots, p_roots)) for f in (np.minimum, np.maximum)]
                    found.append(np.stack(ends))
        flat = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table(list(map(pa.array, flat)), names=["a", "b", "low_root", "high_root"])

    keys = [F.col(c).alias(f"pivot_{c}") for c in key]  # both sides come from the same rows, and names must tell them apart
    pivots = pivots.select(*keys, *[c for c in pivots.columns if c not in key])
    blocks = pivots.groupBy(*[f"pivot_{c}" for c in key])
    return members.groupBy(*key).cogroup(blocks).applyInArrow(run, "a long, b long, low_root long, high_root long")


def bits_alone(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each row of ``a`` that ``b`` has not, and the other way round, as unsigned longs."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return a & ~b, b & ~a


def candidates(rows: DataFrame, low: int, high: int, similarity: float, size: int) -> DataFrame:
    """(a, b, low_root, high_root), a < b: pairs of a bucket's pivots of this round, by turn, with all its texts of another root, if their sizes, sketches and maps allow ``similarity``.

    Two texts of the bucket's commonest root are never put side by side. A bucket of over BLOCKED rows is compared in
    arrays, each side cut into blocks, so that it goes to many tasks.
    """

    def block(count):
        return F.pmod(F.xxhash64("rep"), count).cast("int")

    def each(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    # Texts of the commonest root lie apart from the others, and only pivots of another root go there, too.
    sides = F.when(F.col("common"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    own = [F.col(c).alias(f"pivot_{c}") for c in ("rep", "total", "root", "sketch", *MAP)]
    turn = (F.col("turn") >= low) & (F.col("turn") < high)
    # Comparing rows costs more than their bytes tell: tasks are not merged by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    few, key = rows.where(F.col("n") <= BLOCKED), ["band", "common"]
    pivots = few.where(turn).select("band", *own, F.explode(sides).alias("common")).repartition(tasks, *key)
    members = few.drop("n", "turn").repartition(tasks, *key)
    close = F.least("total", "pivot_total") >= F.lit(similarity) * F.greatest("total", "pivot_total")
    alike = differing(F.col("sketch"), F.col("pivot_sketch"), -(-size // 8)) <= most_differing(size, similarity)
    differ = (F.col("root") != F.col("pivot_root")) & close & in_reach(similarity) & alike
    met = members.join(pivots, key).where(differ)
    met = met.select(*[f(x, f"pivot_{x}").alias(name) for x, f, name in (("rep", F.least, "a"), ("rep", F.greatest, "b"), ("root", F.least, "low_root"), ("root", F.greatest, "high_root"))])

    many, key = rows.where(F.col("n") > BLOCKED), ["band", "part", "slice", "common"]
    parts = F.ceil(F.least(F.lit(high + 1), F.col("n")) / PIVOTS).cast("int")
    slices = F.ceil(F.col("n") / MEMBERS).cast("int")
    pivots = many.where(turn).withColumn("part", block(parts)).withColumn("slice", each(slices))
    pivots = pivots.select("band", "part", "slice", *own, F.explode(sides).alias("common")).repartition(tasks, *key)
    members = many.withColumn("slice", block(slices)).withColumn("part", each(parts)).drop("n", "turn").repartition(tasks, *key)
    met = met.union(in_blocks(members, pivots, key, similarity, size))
    return met.groupBy("a", "b").agg(F.first("low_root").alias("low_root"), F.first("high_root").alias("high_root"))


def classes(
    docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, depth: int = DEPTH
) -> DataFrame:
    """(doc_id, class_id, n_links): class_id is the least id of the class, n_links the links verified at the row's text."""
    return assigned(docs, text, key, similarity, bands, depth).select("doc_id", "class_id", "n_links")


def assigned(
    docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, depth: int = DEPTH
) -> DataFrame:
    """(doc_id, digest, class_id, class_digest, n_links): the class of every row as its least id, and that id's least digest.

    Equal texts (by their words in order) are one text, with a number of its own as ``rep``, so that texts which share
    an id stay apart. In a bucket of a band every text is compared with the bucket's least rep, then with four, 64,
    ... more of its texts, placed or not. A pair is left out only once both texts have the same root, or if more bytes of
    their signatures differ than those of similar texts do but for one pair in 1 / MISSED, or if the
    maps of their runs prove them too far apart; a bucket is done when all have one root or every pair has had its turn. n_links counts the links so found, not all pairs of a class.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    keyed = source.select("doc_id", F.sha2("text", 256).alias("digest"))
    with Scratch(docs.sparkSession) as scratch:
        known = settle(grouped(source, keyed, similarity, bands, depth, scratch.settle))
    return attach(keyed, known, F.sha2(F.lit(""), 256))


def grouped(source: DataFrame, keyed: DataFrame, similarity: float, bands: int, depth: int, settle) -> DataFrame:
    """(digest, class_id, class_digest, n_links) per different text; ``settle`` keeps what this reads more than once."""
    # Partial aggregation leaves one narrow row per text and task, also for a text that a third of the rows share.
    least = settle(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    reps = settle(least.withColumn("rep", F.monotonically_increasing_id()))
    texts = source.withColumn("digest", F.sha2("text", 256)).join(reps, ["doc_id", "digest"])
    # By the keys of the join, so that whole texts are shuffled once.
    texts = settle(texts.dropDuplicates(["doc_id", "digest"]).select("rep", "text"))
    marks = settle(signed(texts, bands, depth))
    rows = marks.select("rep", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.max("rep").alias("last")).where("n > 1")
    limit = marks.count() * bands / HOT  # fewer than HOT buckets are larger
    # The least rep of a bucket is its first pivot, the others take their turn by a draw between 0 and the bucket's size.
    turn = F.when(F.col("rep") == F.col("least"), -1.0).otherwise(F.pmod(F.xxhash64("rep"), F.lit(1 << 31)) / float(1 << 31) * F.col("n"))
    rows = settle(in_buckets(rows, settle(shared), limit).select("band", "rep", "n", turn.alias("turn"), "last"))
    links = roots = tried = maps = None
    low, high = -1, 0
    while True:
        open_rows = settle(unsettled(rows, roots, limit).join(merged(marks.select("rep", "total", "sketch")), "rep"))
        if open_rows.isEmpty():
            break
        if low >= 0 and maps is None:  # later rounds have no other texts
            large = open_rows.where(F.col("n") > LARGE).select("rep").distinct()
            maps = settle(maps_of(of_reps(texts, large)))
        open_rows = with_maps(open_rows, maps)
        pairs = candidates(open_rows, low, high, similarity, bands * depth)
        pairs = settle(pairs if tried is None else pairs.join(merged(tried), ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        if not pairs.isEmpty():
            found = settle(verified(pairs, texts, similarity))
            links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
            if not found.isEmpty():
                met = components(found.select(F.col("low_root").alias("a"), F.col("high_root").alias("b")), settle)
                roots = met if roots is None else settle(joined(roots, met))
        # A bucket all of whose texts have been pivots is done; rows of one root alone are never compared.
        rows = open_rows.where(F.col("n") > high).select("band", "rep", "n", "turn")
        low, high = high, 4 * max(1, high) ** 2  # few rounds, as each costs dozens of stages whatever it reads
    if roots is None:
        links = rows.sparkSession.createDataFrame([], "a long, b long")
        roots = rows.sparkSession.createDataFrame([], "rep long, root long")
    links = links.distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    known = reps.join(merged(roots), "rep", "left").join(merged(degree), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    return known.join(merged(first), "root").select(
        "digest",
        F.col("first.doc_id").alias("class_id"),
        F.col("first.digest").alias("class_digest"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def attach(keyed: DataFrame, known: DataFrame, empty) -> DataFrame:
    """Each row with its digest's class; an empty text is its own class. Frequent digests meet a broadcast of at most 1000 rows."""
    n = keyed.count()
    hot = settle(keyed.groupBy("digest").count().where(F.col("count") > n / 1000).select("digest"))
    hot_known = F.broadcast(known.join(hot, "digest", "left_semi"))
    rest = keyed.join(F.broadcast(hot), "digest", "left_anti").join(known, "digest")
    all_rows = keyed.join(hot_known, "digest").unionByName(rest)
    own = F.col("digest") == empty
    class_id = F.when(own, F.col("doc_id")).otherwise(F.col("class_id"))
    return all_rows.select("doc_id", "digest", class_id.alias("class_id"), "class_digest", "n_links")
