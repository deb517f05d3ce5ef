"""Quality by attention over passages: a gated attention network weighs a text's passages and scores their mean.

Each passage of 512 bytes is encoded by its character shares and a learned layer; attention and score are learned from
document labels alone. Null and empty texts are one empty passage. Repeated rows repeat their score. Only
the named columns are read. Without both labels to learn from every score is the share of label 1, or a half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, PASSAGE, HIDDEN, GATE, EPOCHS, BATCH, RATE = 4000, 512, 24, 12, 25, 64, 0.01


def _classes() -> np.ndarray:
    """Class of each byte: letters without case, a class for capitals, digits, each sign, spaces, line ends, others."""
    table = np.full(256, 40, int)
    for i in range(26):
        table[97 + i] = table[65 + i] = i
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, c in enumerate(signs):
        table[c] = 41 + i
    table[48:58], table[32], table[10] = 26, 27, 28
    return table


CLASS = _classes()
WIDTH = 41 + 32 + 4


def passages(text: str | None) -> np.ndarray:
    """One row per passage of the whole text: roots of byte-class shares, capitals, repeats, word length, fill."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    which = np.arange(len(data)) // PASSAGE
    count = np.bincount(which * WIDTH + CLASS[data], minlength=n * WIDTH).reshape(n, WIDTH).astype(float)
    size = np.maximum(1, np.bincount(which, minlength=n)[:n])
    capital = np.bincount(which[(data >= 65) & (data <= 90)], minlength=n)[:n] / size
    same = np.bincount(which[1:][data[1:] == data[:-1]], minlength=n)[:n] / size if len(data) else np.zeros(n)
    out = np.sqrt(count / size[:, None])
    out[:, -4], out[:, -3] = capital, same
    out[:, -2], out[:, -1] = 1 / (1 + count[:, 27] + count[:, 28]), np.log1p(size) / np.log1p(PASSAGE)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict, rows: np.ndarray, starts: np.ndarray):
    """Scores of bags: rows of bag i begin at ``starts[i]``; with what the gradient needs."""
    x = (rows - model["mean"]) / model["scale"]
    hidden = np.maximum(0, x @ model["W"] + model["b"])
    tanh, gate = np.tanh(hidden @ model["V"]), _sigmoid(hidden @ model["U"])
    energy = (tanh * gate) @ model["w"]
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    share = np.exp(energy - np.maximum.reduceat(energy, starts)[owner])
    share /= np.add.reduceat(share, starts)[owner]
    bag = np.add.reduceat(share[:, None] * hidden, starts)
    return _sigmoid(bag @ model["c"] + model["d"]), (x, hidden, tanh, gate, owner, share, bag)


def gradients(model: dict, starts: np.ndarray, error: np.ndarray, kept) -> dict:
    """Gradients of the log loss, given each bag's score minus its label."""
    x, hidden, tanh, gate, owner, share, bag = kept
    error = error / len(starts)
    d_bag = error[:, None] * model["c"]
    along = (hidden * d_bag[owner]).sum(1)
    d_energy = share * (along - np.add.reduceat(share * along, starts)[owner])
    d_gated = d_energy[:, None] * model["w"]
    d_tanh, d_gate = d_gated * gate * (1 - tanh**2), d_gated * tanh * gate * (1 - gate)
    d_hidden = (share[:, None] * d_bag[owner] + d_tanh @ model["V"].T + d_gate @ model["U"].T) * (hidden > 0)
    return {
        "c": bag.T @ error,
        "d": error.sum(),
        "w": (tanh * gate).T @ d_energy,
        "V": hidden.T @ d_tanh,
        "U": hidden.T @ d_gate,
        "W": x.T @ d_hidden,
        "b": d_hidden.sum(0),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """The network fitted by Adam to whole bags."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    share = float(np.mean(labels)) if len(labels) else 0.5
    model = {"mean": everything.mean(0), "scale": everything.std(0) + 0.01}
    model |= {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "c": np.zeros(HIDDEN)}
    model |= {"V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE)}
    model["d"] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if not 0 < share < 1:
        return model
    names = ("W", "b", "V", "U", "w", "c", "d")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            rows = np.concatenate([bags[j] for j in chosen])
            starts = np.cumsum([0] + [len(bags[j]) for j in chosen[:-1]])
            score, kept = forward(model, rows, starts)
            step += 1
            for name, g in gradients(model, starts, score - labels[chosen], kept).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                model[name] = model[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "quality") -> dict:
    """The network of at most ``sample`` labelled documents, those whose ids have the least hashes.

    Of rows that share an id the text with the least digest is learned, so that the bound holds for rows.
    """
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ids = source.select("doc_id").join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = source.join(F.broadcast(ids), "doc_id")  # at most `sample` ids
    # Partial aggregation leaves one text per id and task.
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), "text")).alias("text"))

    def run(batches):
        for batch in batches:
            bags = [passages(t) for t in batch.column("text").to_pylist()]
            data = pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), data], names=["doc_id", "label", "bag"])

    found = sorted(rows.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(run, "doc_id long, label int, bag binary").collect())
    bags = [np.frombuffer(bytes(r["bag"]), "<f4").reshape(-1, WIDTH).astype(float) for r in found]
    return train(bags, np.array([float(r["label"] > 0) for r in found]))


def score(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) per document, from its whole text."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            values = []
            for start in range(0, batch.num_rows, 32):
                bags = [passages(t) for t in batch.column("text").slice(start, 32).to_pylist()]
                starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
                values += forward(model, np.concatenate(bags), starts)[0].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, "doc_id long, score double")
