"""Language by compression: the language whose zstandard dictionary makes a text smallest.

A null text or one without letters is `und`; narrow margins are rejected. Whole texts are read, however long. Learning needs at least one text
with a language, else everything is `und`. Repeated rows repeat their result. Only named columns are read.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
SAMPLE, SNIPPET, PIECE, MARGIN = 200, 550, 1024, 0.002  # zstandard uses up to 110 000 bytes of a dictionary


def learn(docs: DataFrame, sample: int = SAMPLE, snippet: int = SNIPPET, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A raw dictionary per language from at most ``sample`` texts of each, ``snippet`` bytes from a place in each.

    The texts are those of the least hashes, and a text's hash chooses the place, anywhere in the whole text: the choice does
    not depend on the order of rows, repeats do not matter, and what all texts begin with is no more likely than the rest.
    """
    h = F.xxhash64(F.col(text))
    spare = F.greatest(F.char_length(F.col(text)) - snippet, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(h, F.lit(1)), spare).cast("int") + 1
    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    source = source.select(F.col(lang).alias("lang"), F.lower(F.substr(F.col(text), place, F.lit(snippet))).alias("text"), h.alias("h"))
    # The partial aggregate of min_by keeps `sample` rows of a language per task, so none is gathered whole.
    buckets = source.groupBy("lang", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for row in buckets.collect():
        found.setdefault(row["lang"], []).append((row["bucket"], row["text"]))
    return {k: b" ".join(OTHER.sub(" ", t).encode()[:snippet] for _, t in sorted(v)) for k, v in sorted(found.items())}


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    out = []
    for name, data in dictionaries:
        book = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=3)
        out.append((name, z.ZstdCompressor(level=3, dict_data=book, write_content_size=False)))
    return out


def sizes(text: str, dictionaries) -> list[tuple[int, str]]:
    """(bytes, language) by size. Pieces are compressed apart, so that a long text does not become its own dictionary."""
    data = OTHER.sub(" ", text.lower()).encode()  # letters alone tell the language
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in _compressors(dictionaries))


def judged(text: str | None, dictionaries, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected): the score grows from a half with the gap to the second smallest."""
    if not text or not dictionaries or not LETTER.search(text):
        return "und", 0.0, True
    ranked = sizes(text, dictionaries)
    if len(ranked) == 1:
        return ranked[0][1], 1.0, False
    gap = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
    return ranked[0][1], 1 / (1 + math.exp(-40 * gap)), gap < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per document."""
    model = tuple(sorted(dictionaries.items()))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = [judged(t, model, margin) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found)) or [()] * 3
            types = (pa.string(), pa.float64(), pa.bool_())
            arrays = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    model = tuple(sorted(dictionaries.items()))
    keep = F.udf(lambda t: not judged(t, model, margin)[2], "boolean", useArrow=True)
    return docs.where(keep(F.col(text)))
