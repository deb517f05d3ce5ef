"""SentencePiece models run by the tokenizers library: encoding and decoding of whole texts.

Null texts count as empty and give no ids; repeated rows give repeated results; an empty table gives an
empty result. Only the columns named by the caller are read, so others may have any name.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.units import Units

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
#: No merge crosses from a word with the marker before it to the next unless a piece has a marker behind another character.
ACROSS = re.compile(f"[^{MARK}]{MARK}")
KNOWN, RUN = 400_000, 64  # words whose ids are kept, words encoded as one text


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of one protobuf message: ints for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type), and the settings of trainer and normaliser that encoding needs."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return {
        "pieces": pieces,
        "unigram": trainer.get(3, 1) == 1,
        "byte_fallback": bool(trainer.get(35, 0)),
        "charsmap": normal.get(2, b""),
        "prefix": bool(normal.get(3, 1)),
        "squeeze": bool(normal.get(4, 1)),
    }


def _merges(pieces) -> list[tuple[str, str]]:
    """Merges of a BPE model, best score first: every split of a piece into two pieces."""
    score = {text: value for text, value, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    place = {text: i for i, (text, _, _) in enumerate(pieces)}
    found = []
    for text, value in score.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in score and right in score:
                found.append((-value, place[left], place[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: dict):
    """The model as a tokenizers.Tokenizer: normaliser, space marker, scores (or merges) and byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next(i for i, piece in enumerate(pieces) if piece[2] == UNKNOWN)
    if model["unigram"]:
        # Control pieces are never read from a text.
        scored = [(t, s if k in (NORMAL, USER, BYTE) else -1e9) for t, s, k in pieces]
        core = models.Unigram(scored, unk_id=unknown, byte_fallback=model["byte_fallback"])
    else:
        vocabulary = {t: i for i, (t, _, _) in enumerate(pieces)}
        core = models.BPE(
            vocab=vocabulary, merges=_merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"]
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model["prefix"] else []
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model["prefix"] else []))
    own = [AddedToken(t, normalized=False) for t, _, k in pieces if k == USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def hold_threads() -> None:
    """As many threads for batches as the task has cores: more only get in each other's way. To be called before the first batch."""
    task = TaskContext.get()
    if task is not None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(task.cpus()))


class Encoder:
    """A model as a tokenizer that encodes and decodes each distinct word once.

    That holds for BPE models that only mark spaces, with one before the text, and have neither pieces across words nor
    pieces of the user's own. For others, and for texts that are not ``plain``, whole texts are encoded and decoded.
    """

    def __init__(self, model: dict):
        from tokenizers import decoders, normalizers

        hold_threads()
        self.tokenizer, self.bare = build_tokenizer(model), None
        pieces = model["pieces"]
        apart = not any(ACROSS.search(text) or kind == USER for text, _, kind in pieces)
        marked = any(text == MARK and kind == NORMAL for text, _, kind in pieces)
        if apart and marked and model["prefix"] and not (model["unigram"] or model["squeeze"] or model["charsmap"]):
            self.bare = build_tokenizer(model)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse()])
            self.first = np.array([text.startswith(MARK) for text, _, _ in pieces])
            self.units = Units(self._words, KNOWN, lambda ids: self.bare.decode_batch(ids, skip_special_tokens=False))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; a word's first piece, and no other, has the marker."""
        marked = [MARK + word for word in words]
        runs = [marked[at : at + RUN] for at in range(0, len(marked), RUN)]
        ids, counts = [], []
        for run, found in zip(runs, self.bare.encode_batch_fast(["".join(run) for run in runs], add_special_tokens=False)):
            flat = np.array(found.ids, np.int64)
            starts = np.flatnonzero(self.first[flat])
            if len(starts) == len(run) and starts[0] == 0:
                ids.append(flat)
                counts.append(np.diff(starts, append=len(flat)))
            else:
                each = [np.array(e.ids, np.int64) for e in self.bare.encode_batch_fast(run, add_special_tokens=False)]
                ids += each
                counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def plain(self, text: str) -> bool:
        """Whether every marker stands alone before a word: markers side by side merge with each other."""
        return self.bare is not None and text != "" and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "

    def run(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """The ids of each text, and the text decoded from them."""
        plain = [self.plain(text) for text in texts]
        ids, back = [], []
        if any(plain):
            ids, back = self.units.gather(pc.split_pattern(pa.array([t for t, is_plain in zip(texts, plain) if is_plain], pa.string()), " "))
        some = zip(ids, [text.removeprefix(" ") for text in back])
        rest = [t for t, is_plain in zip(texts, plain) if not is_plain]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        whole = zip([np.array(x, "<i4") for x in found], self.tokenizer.decode_batch(found, skip_special_tokens=False) if rest else [])
        pairs = [next(some if is_plain else whole) for is_plain in plain]
        return [x for x, _ in pairs], [text for _, text in pairs]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.run(texts)[0]


@functools.lru_cache(maxsize=4)
def _loaded(data: bytes) -> Encoder:
    return Encoder(parse_model(data))


@functools.lru_cache(maxsize=4)
def _peer(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _batches(texts: list[str], limit: int = 1 << 20):
    """Runs of texts of about ``limit`` characters, so that memory is bounded whatever the batch holds."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def encode(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id", check: bool = True) -> DataFrame:
    """One row per document: its ids, the text decoded from them and, with ``check``, parity with the model's own library."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        encoder = _loaded(model)
        for batch in batches:
            texts, keys, at = batch.column("text").to_pylist(), batch.column("doc_id"), 0
            for part in _batches(texts):
                found, decoded = encoder.run(part)
                same = [a.tolist() == b for a, b in zip(found, _peer(model).encode(part, num_threads=1))] if check else [None] * len(part)
                columns = [keys.slice(at, len(part)), _lists(found), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "parity"])

    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded string, parity boolean")


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row of ``tokens``: the text of its ids; null or empty ids give the empty text."""
    source = tokens.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        for batch in batches:
            lists = [[i for i in x or [] if i is not None] for x in batch.column("ids").to_pylist()]
            texts = pa.array(_loaded(model).tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return source.mapInArrow(run, "doc_id long, text string")


def digest_of(ids) -> int:
    """crc32 over little-endian unsigned 32-bit ids."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
