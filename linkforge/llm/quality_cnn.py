"""Byte-level convolutional quality classifier in numpy (operator 1).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each
chunk's embedded bytes and rectified responses are max-pooled per chunk. Mean, maximum and minimum over the
chunks, and how far the text fills a chunk, feed a small hidden layer and one logistic unit: a chunk that
repeats a few words leaves most filters without a strong response, which the minimum shows. Pooling makes
gradients sparse, so training needs little beyond forward passes. Weights are fitted on the driver from a
bounded, deterministic sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words
from linkforge.runtime import ship

#: Bytes of a chunk and from one chunk's start to the next's; width and step of a filter.
CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
DIMS, FILTERS, HIDDEN = 8, 32, 16
#: Bounds of the training sample: labelled rows, and bytes of their texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
EPOCHS, BATCH, RATE = 10, 32, 4e-3
#: Chunks that a forward pass holds at once.
BLOCK = 384


def chunks(text: bytes) -> np.ndarray:
    """All of a text as overlapping rows of bytes. The last row ends with the text; texts under one chunk are
    one row padded with zeros."""
    raw = np.zeros(max(len(text), CHUNK), np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    n = 1 + -(-(len(raw) - CHUNK) // STEP)
    starts = np.minimum(np.arange(n) * STEP, len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


@dataclass
class Model:
    """Weights; ``predict`` gives the probability of label 1 for each text."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    base: np.ndarray
    state: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, rate: float, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
            rng.normal(0, (2 / (WIDTH * DIMS)) ** 0.5, (WIDTH * DIMS, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, (3 * FILTERS + 1) ** -0.5, (3 * FILTERS + 1, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, 0.1, HIDDEN).astype(np.float32),
            np.asarray([np.log(rate / (1 - rate))], np.float32),
        )

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses per chunk and filter, and where each was found."""
        values, where = np.empty((len(rows), FILTERS), self.filters.dtype), np.empty((len(rows), FILTERS), np.int64)
        for at in range(0, len(rows), BLOCK):
            some = self.embed[rows[at : at + BLOCK]].reshape(-1, CHUNK * DIMS)
            seen = np.lib.stride_tricks.sliding_window_view(some, WIDTH * DIMS, axis=1)[:, :: STRIDE * DIMS]
            z = seen @ self.filters
            where[at : at + BLOCK] = z.argmax(axis=1)
            values[at : at + BLOCK] = z.max(axis=1)
        return np.maximum(values + self.bias, 0), where

    def _combined(self, texts: list[bytes]):
        parts = [chunks(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(counts) - counts
        rows = np.concatenate(parts)
        p, where = self.pooled(rows)
        fill = np.minimum(1, np.fromiter(map(len, texts), np.float32, len(texts)) / CHUNK)[:, None]
        all_ = np.concatenate([np.add.reduceat(p, starts) / counts[:, None], np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts), fill], axis=1)
        units = np.tanh(all_ @ self.hidden + self.offset)
        logit = units.astype(np.float64) @ self.out.astype(np.float64) + float(self.base[0])
        return rows, counts, p, where, all_, units, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        return self._combined(texts)[-1] if texts else np.empty(0)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of a batch, by weight."""
        rows, counts, p, where, all_, units, prob = self._combined(texts)
        d = ((prob - labels) / len(texts)).astype(self.out.dtype)
        of, starts = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
        d_units = d[:, None] * self.out * (1 - units**2)
        d_all = d_units @ self.hidden.T
        d_p = (d_all[:, :FILTERS] / counts[:, None])[of]
        for part in (1, 2):  # maximum, minimum; ties share the gradient
            at = slice(part * FILTERS, (part + 1) * FILTERS)
            hit = (p == all_[of, at]).astype(p.dtype)
            d_p += d_all[of, at] * hit / np.add.reduceat(hit, starts)[of]
        d_p *= p > 0
        at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
        seen = rows[np.arange(len(rows))[:, None, None], at]
        inputs = self.embed[seen].reshape(len(rows), FILTERS, WIDTH * DIMS)
        d_filters = np.einsum("cf,cfk->kf", d_p, inputs)
        d_inputs = (d_p[:, :, None] * self.filters.T[None]).reshape(-1, DIMS)
        flat = seen.reshape(-1)
        d_embed = np.stack([np.bincount(flat, weights=d_inputs[:, j], minlength=256) for j in range(DIMS)], axis=1)
        return {"embed": d_embed, "filters": d_filters, "bias": d_p.sum(axis=0), "hidden": all_.T @ d_units, "offset": d_units.sum(axis=0), "out": units.T @ d, "base": np.asarray([d.sum()])}

    def learn(self, texts: list[bytes], labels: np.ndarray, rate: float) -> None:
        """One Adam step on a batch."""
        self.state["t"] = t = self.state.get("t", 0) + 1
        for name, grad in self.gradients(texts, labels).items():
            m, v = self.state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            self.state[name] = (m, v)
            weight = getattr(self, name)
            weight -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Weights from labelled texts; without rows, or with one label only, the score is the smoothed base rate."""
    base = (labels.sum() + 1.0) / (len(labels) + 2.0)
    model = Model.fresh(float(base), seed)
    if not len(labels) or labels.min() == labels.max():
        model.out[:] = 0
        return model
    rng = np.random.default_rng(seed)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    steps, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), BATCH):
            some = order[at : at + BATCH]
            model.learn([texts[i] for i in some], labels[some], RATE * (1 - 0.95 * steps / total))
            steps += 1
    model.state = {}
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole labelled texts for fitting: the rows not held out, in the order of a hash of doc_id, as many as
    ``rows`` and ``most_bytes`` of text in all allow, one at least. No text is passed over for its size.
    Conflicting labels of one document take the larger; of several texts of one doc_id the shortest counts."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null and pmod(crc32(cast(doc_id as string)), 5) != 0")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    data = F.encode("text", "UTF-8")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"size": F.octet_length(data), "crc": F.crc32(data)})
    shortest = texts.select("doc_id", "size", "crc").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("size", "crc")).alias("t"), F.max("quality").alias("quality"))
    known = shortest.select("doc_id", "t.size", "t.crc", "quality", F.xxhash64("doc_id").alias("place")).collect()  # `rows` rows at most
    known.sort(key=lambda r: (r.place, r.doc_id))
    total, taken = 0, []
    for r in known:
        total += r.size
        if taken and total > most_bytes:
            break
        taken.append((r.doc_id, r.size, r.crc, r.quality))
    if not taken:
        return [], np.empty(0)
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, size int, crc long, quality int")
    got = {r.doc_id: (r.text.encode(), float(r.quality > 0)) for r in texts.join(F.broadcast(wanted), ["doc_id", "size", "crc"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "quality").collect()}
    ordered = [got[i] for i in sorted(got)]
    return [t for t, _ in ordered], np.asarray([q for _, q in ordered])


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.predict(words.raw_texts(part)))], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    held_out: crc32 of doc_id as text is divisible by 5; such rows are never learnt from. score is the
    probability of quality label 1 from the whole text's bytes alone; null texts score as empty ones.
    predicted is 1 from ``threshold`` on. Rows are scored one by one, so repeated rows get equal scores; a
    null doc_id is not held out. Other columns are ignored; an empty table gives an empty result; without
    usable labels the score is 0.5. Weights are fitted on at most ``sample_rows`` labelled rows, fewer if
    their texts hold more than ``sample_bytes``.
    """
    ship(docs.sparkSession)
    model = fit(*sample(docs, labels, sample_rows, sample_bytes))
    docs = words.id_and_text(docs)
    return docs.mapInArrow(_scorer(model), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
