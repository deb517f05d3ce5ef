"""Secret scan: keywords by Aho-Corasick, anchored patterns at the hits, checksums where a token carries one.

Null counts as empty; repeated rows repeat their result; an empty table gives an empty one. Only the
named columns are read. Places are code points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}
# Tokens whose last six characters are the base-62 CRC-32 of the thirty before them, and private-key blocks.
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KEY_BLOCK = "-----begin "
KINDS = ("assign", "access", "hex", "checked", "key")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

PATTERNS = {
    "assign": re.compile(ASSIGN.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.A),
    "access": re.compile(ACCESS),
    "hex": re.compile(HEX),
    "checked": re.compile(r"(gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "key": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
ASCII_LOWER = {code: code + 32 for code in range(65, 91)}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = {word: kind for kind, values in KEYWORDS.items() for word in values}
    words |= {word: "checked" for word in CHECKED} | {KEY_BLOCK: "key"}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def base62_crc(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def valid(kind: str, match: re.Match) -> bool:
    """What a matching text must meet besides: lengths, and the token's own checksum."""
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    if kind == "checked":
        return base62_crc(match[0][4:34]) == match[0][34:]
    return True


def secrets_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret by start, then kind; leftmost and without overlap within a kind.

    Runs of hex digits have no keyword to look for; their pattern reads the text itself.
    """
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = text.translate(ASCII_LOWER)
    spans = [(m.start(), "hex", m.end()) for m in PATTERNS["hex"].finditer(text)]
    last = dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(lowered))
    for start, kind in hits:
        if start >= last[kind] and (match := PATTERNS[kind].match(text, start)):
            last[kind] = match.end()
            if valid(kind, match):
                spans.append((start, kind, match.end()))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with every secret replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts and digest of the base kinds, all spans, and the text with secrets replaced."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column("text").to_pylist():
                spans = secrets_of(value)
                base = [s for s in spans if s[1] in KINDS[:3]]
                counts = [sum(s[1] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(value, spans)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 3
            arrays = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, all columns kept; texts without one stay as they are, null too.

    ``length`` names a column of text lengths to renew where the text changed.
    """
    clean = F.udf(lambda v: None if v is None else redacted(v, secrets_of(v)), "string", useArrow=True)
    out = docs.withColumn(text, clean(F.col(text)))
    if length:
        out = out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return out
