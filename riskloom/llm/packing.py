"""Cost-balanced packing: documents as token ids in sequences of bounded length with even attention cost.

Null texts count as empty: their end id alone. Repeated rows are packed each on its own. An empty table
gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.near import in_parts
from riskloom.llm.sentencepiece import hold_threads
from riskloom.session import settle

CAPACITY, SHARD, LINEAR, QUADRATIC = 4096, 512, 1.0, 1 / 4096


#: Characters on which the tokenizer's rules and Python's agree; texts with others are encoded whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f\u0400-\u045f]*")
KNOWN, RUN, PART = 300_000, 4096, 1 << 20  # words whose ids are kept, words encoded as one text, characters of text taken at a time


def plain_class(kind: str, top: int) -> str:
    """The characters of plain texts below ``top`` in lower case whose category begins with ``kind``, for a character class."""
    plain = [chr(c) for c in range(top) if PLAIN.fullmatch(chr(c))]
    return "".join(re.escape(c) for c in sorted({c for x in plain for c in x.lower()}) if unicodedata.category(c)[0] == kind)


class Encoder:
    """A tokenizer file; where it cuts texts into words by a pattern, each distinct word is encoded once.

    That holds for files that lower the text, put it in NFC, and encode the matches of one pattern byte by byte, apart from
    each other. For any other file, and for texts beyond ``PLAIN`` or with control strings, whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        hold_threads()
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.pattern, self.added = None, [token["content"] for token in spec["added_tokens"]]
        steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}:
            if [part["type"] for part in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not (parts[1]["use_regex"] or parts[1]["add_prefix_space"]):
                classes = parts[0]["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
                before, letters, _ = classes.partition(r"|\p{L}+|")
                if letters and all(other.startswith("'") for other in before.split("|")):
                    classes = r"\p{L}+|" + classes  # no earlier part begins with a letter: the commonest is tried first
                self.pattern, self.ascii = (re.compile(self._spelt(classes, top)) for top in (0x460, 0x80))
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix:
            self.pattern = None
        else:  # every word's last token, and no other, carries the suffix
            vocabulary = spec["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def _spelt(pattern: str, top: int) -> str:
        """The pattern with its letters and numbers spelt out, as far as plain texts below ``top`` have them."""
        letters, numbers = plain_class("L", top), plain_class("N", top)
        within = re.sub(r"\[\^[^]]*\]", lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
        return within.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers, from runs of words that spaces keep apart."""
        out = []
        for at in range(0, len(words), RUN):
            run = words[at : at + RUN]
            (ids,) = self._whole([" ".join(run)])
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) == len(run):
                flat, begins = ids.tobytes(), [0, *ends.tolist()]
                out += [flat[a:b] for a, b in zip(begins, begins[1:])]
            else:
                out += [ids.tobytes() for ids in self._whole(run)]
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def words(self, text: str) -> list[str] | None:
        """The words to encode, or None for a text to be encoded whole."""
        if self.pattern is None or not PLAIN.fullmatch(text) or any(token in text for token in self.added):
            return None
        return (self.ascii if text.isascii() else self.pattern).findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.words(text) for text in texts]
        distinct = set().union(*[words for words in cut if words])
        fresh = [word for word in distinct if word not in self.known]
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
            fresh = list(distinct)
        self.known.update(zip(fresh, self._words(fresh)))
        whole = iter(self._whole([text for text, words in zip(texts, cut) if words is None]))
        return [next(whole) if words is None else np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in cut]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_rows(docs: DataFrame, path: str, end: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(uid, doc_id, ids, n) in the shared folder; ``uid`` numbers the stored rows."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        encoder, last = _encoder(path), np.array([end], "<u4")
        for part in (part for batch in batches for part in in_parts(batch, PART)):
            found = encoder.encode(part.column("text").to_pylist())
            n = np.array([len(ids) + 1 for ids in found], np.int64)
            flat = np.concatenate([x for ids in found for x in (ids, last)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(n)], names=["doc_id", "ids", "n"])

    return settle(source.mapInArrow(run, "doc_id long, ids array<int>, n long").withColumn("uid", F.monotonically_increasing_id()))


def cost(length: int) -> float:
    """Estimated cost of a document of ``length`` tokens in a sequence: linear, plus attention within it."""
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Longest documents first, each to the sequence of least cost that has room; one that does not fit there is
    cut and goes on in the next, so all sequences but a last one are full.
    """
    count = -(-sum(lengths) // capacity)
    heap = [(0.0, i, capacity) for i in range(count)]
    last = sum(lengths) - (count - 1) * capacity if count else 0
    if count:
        heap[-1] = (0.0, count - 1, last)
    full, out = {i: room for _, i, room in heap}, []
    heapq.heapify(heap)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[i]:
            spent, sequence, room = heapq.heappop(heap)
            take = min(room, lengths[i] - start)
            out.append((i, start, take, sequence, full[sequence] - room))
            start += take
            if take < room:
                heapq.heappush(heap, (spent + cost(take), sequence, room - take))
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, shard: int = SHARD, text: str = "text", key: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece, and its ids if asked for.

    Whole sequences are cut off long documents first. The ends are dealt by hash to shards of about
    ``shard`` sequences, packed each by one task from lengths alone; a shard leaves one sequence unfilled.
    """
    rows = token_rows(docs, path, text=text, key=key)
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(total / (capacity * shard)))
    ends = rows.select("uid", (F.floor(F.col("n") / capacity) * capacity).alias("base"), "n").where("n > base")
    ends = ends.select("uid", "base", (F.col("n") - F.col("base")).cast("int").alias("left"), F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    # Whole sequences are numbered by stored partition, the upper bits of uid, and running number there.
    before = Window.partitionBy(F.shiftright("uid", 33)).orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.select("uid", F.floor(F.col("n") / capacity).alias("w")).where("w > 0")
    running = F.coalesce(F.sum("w").over(before), F.lit(0))
    whole = whole.select("uid", (F.shiftleft(F.shiftright("uid", 33), 33) + running).alias("whole"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)
        made = pd.DataFrame(assign(frame["left"].tolist(), capacity), columns=["i", "start", "length", "sequence", "offset"])
        part = frame.loc[made["i"]].reset_index(drop=True)
        # Odd ids for shards, even ones for whole sequences of one document.
        ident = (part["shard"].astype("int64") * 2**32 + made["sequence"]) * 2 + 1
        return pd.DataFrame({"uid": part["uid"], "start": part["base"] + made["start"], "length": made["length"], "sequence_id": ident, "offset": made["offset"]})

    schema = "uid long, start long, length long, sequence_id long, offset long"
    packed = settle(ends.groupBy("shard").applyInPandas(fill, schema))
    plan = packed.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("tail"))
    # A document has at most capacity - 1 tokens in its tail, so the list is bounded.
    joined = rows.join(plan, "uid", "left").join(whole, "uid", "left").select("doc_id", "ids", "n", "tail", "whole")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out += ", ids array<int>" if with_ids else ""

    names = [c.split()[0] for c in out.split(", ")]

    def cut(batches):
        for batch in batches:
            lines, parts, held = [], [], 0
            for doc, values, n, tail, first in zip(*[batch.column(c) for c in ("doc_id", "ids", "n", "tail", "whole")]):
                doc, n, first = doc.as_py(), n.as_py(), first.as_py()
                ids = values.values.to_numpy(zero_copy_only=False).astype("<u4")
                for s in range(0, n - n % capacity, capacity):
                    lines.append((doc, s, capacity, zlib.crc32(ids[s : s + capacity].tobytes()), n, (first + s // capacity) * 2, 0))
                    parts.append(ids[s : s + capacity])
                for p in tail.as_py() or []:
                    s, size = p["start"], p["length"]
                    lines.append((doc, s, size, zlib.crc32(ids[s : s + size].tobytes()), n, p["sequence_id"], p["offset"]))
                    parts.append(ids[s : s + size])
                held += n
                if held > 1 << 20:  # about a million ids at a time
                    yield pieces(lines, parts)
                    lines, parts, held = [], [], 0
            yield pieces(lines, parts)

    def pieces(lines, parts):
        columns = [pa.array(c, pa.int64()) for c in (zip(*lines) if lines else [()] * 7)]
        if with_ids:
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
            flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(ends, pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, out)
