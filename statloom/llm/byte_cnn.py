"""A quality classifier: a byte-level convolutional network, trained and applied with numpy.

Input are the UTF-8 bytes of the whole text, each with a learned embedding and a mark: whether
its word repeats the word before, which filters of a fixed width cannot see.  Filters of eight
bytes slide by four over the text; their largest responses over overlapping chunks (512 bytes,
every 256) are pooled once more over the document by maximum and combined into one probability.

It is trained on the driver on a bounded sample of labelled rows (``SAMPLE`` ids of each class,
by a hash of the id, texts up to ``SAMPLE_BYTES``; where ids repeat, the first 4 * ``SAMPLE`` rows
in the order of id and text); scoring takes every row and every byte, long texts in pieces.

Defined results: null and empty texts are scored as texts of padding; without labels of
both classes every score is the share of good labels (0.5 without any); rows that repeat
get equal scores; other columns play no part, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces_of

SAMPLE = 1500
SAMPLE_BYTES = 1 << 15
UNIT, HALF, EMBED, FILTERS = 4, 256, 6, 16
CHANNELS = EMBED + 1
EPOCHS, BATCH, RATE = 6, 32, 0.01
HELD_OUT = 2
GOOD_FROM = 0.7
#: Bytes scored at once; a multiple of ``HALF``.
PIECE = 1 << 18


def repeats(text: bytes) -> np.ndarray:
    """For each byte whether its word is the same as the word before it; whole words are compared."""
    out = np.zeros(len(text), bool)
    words = text.split()
    same = [i for i in range(1, len(words)) if words[i] == words[i - 1]]
    if same:
        data = np.frombuffer(text, np.uint8)
        space = np.r_[True, (data == 32) | ((data >= 9) & (data <= 13)), True]
        edges = np.flatnonzero(space[1:] != space[:-1])
        step = np.zeros(len(text) + 1, np.int8)
        step[edges[0::2][same]] = 1
        np.add.at(step, edges[1::2][same], -1)
        out[:] = np.cumsum(step[:-1], dtype=np.int8) > 0
    return out


def repeats_of(text: bytes) -> np.ndarray:
    """``repeats`` of a text of any length, piece by piece: each takes the last word of the one before along."""
    out, last, at = np.zeros(len(text), bool), b"", 0
    for piece in pieces_of(text):
        out[at : at + len(piece)] = repeats(last + b" " + piece)[len(last) + 1 :]
        at += len(piece)
        last = (piece.split() or [last])[-1]
    return out


def padded(text: bytes) -> int:
    """Length of a text padded to whole halves, with at least a unit of padding."""
    return max(1, -(-(len(text) + UNIT) // HALF)) * HALF


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes, padded to whole halves, and their mark."""
    data, mark = np.zeros(padded(text), np.uint8), np.zeros(padded(text), bool)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    mark[: len(text)] = repeats_of(text)
    return data, mark


class Network:
    """Weights, and what the halves of a text respond."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "first": rng.normal(0, 0.2, (UNIT * CHANNELS, FILTERS)).astype(np.float32),
            "second": rng.normal(0, 0.2, (UNIT * CHANNELS, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(FILTERS, np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.log_odds = 0.0  # of the classes beyond those trained on

    def units(self, data: np.ndarray, mark: np.ndarray) -> np.ndarray:
        x = np.empty((len(data), CHANNELS), np.float32)
        x[:, :EMBED] = self.w["embed"][data]
        x[:, EMBED] = mark
        return x.reshape(-1, UNIT * CHANNELS)

    def responses(self, units: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Filter responses at each unit with its next one; none reaches over into another text."""
        z = units @ self.w["first"] + self.w["bias"]
        nxt = (units @ self.w["second"])[1:]
        inner = doc_starts[doc_starts > 0] - 1
        nxt[inner] = 0
        z[:-1] += nxt
        return z

    def half_peaks(self, text: bytes) -> np.ndarray:
        """The largest response of each filter in each half of a text, long texts in pieces."""
        data, mark = marks(text)
        peaks = []
        for at in range(0, len(data), PIECE):
            upto = min(len(data), at + PIECE)
            more = min(len(data), upto + UNIT)  # the next piece's first unit
            z = self.responses(self.units(data[at:more], mark[at:more]), np.zeros(1, np.int64))
            peaks.append(z[: (upto - at) // UNIT].reshape(-1, HALF // UNIT, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(peaks), 0)

    def score(self, text: bytes | None) -> float:
        halves = self.half_peaks(text or b"")
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        logit = float(chunks.max(axis=0) @ self.w["out"]) + float(self.w["shift"][0]) + self.log_odds
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    def gradients(self, texts: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over a few texts given as bytes and marks."""
        w, lengths = self.w, np.array([len(d) for d, _ in texts])
        data, mark = np.concatenate([d for d, _ in texts]), np.concatenate([m for _, m in texts])
        first_half = np.r_[0, np.cumsum(lengths)[:-1]] // HALF
        units = self.units(data, mark)
        z = self.responses(units, first_half * (HALF // UNIT)).reshape(-1, HALF // UNIT, FILTERS)
        where = z.argmax(axis=1)
        peak = np.take_along_axis(z, where[:, None], 1)[:, 0]
        halves = np.maximum(peak, 0)
        n_halves = lengths // HALF
        d_halves = np.zeros_like(halves)
        pooled = np.zeros((len(texts), FILTERS), np.float32)
        picks = []
        columns = np.arange(FILTERS)
        for i, (a, n) in enumerate(zip(first_half, n_halves, strict=True)):
            h = halves[a : a + n]
            later = h[1:] > h[:-1]
            chunk = np.where(later, h[1:], h[:-1]) if n > 1 else h
            source = (np.arange(n - 1)[:, None] + later if n > 1 else np.zeros((1, FILTERS), np.int64)) + a
            best = chunk.argmax(axis=0)
            pooled[i] = chunk[best, columns]
            picks.append((source, best))
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["shift"][0], -50, 50)))
        d_logit = ((p - goal) / len(texts)).astype(np.float32)
        for i, (source, best) in enumerate(picks):
            np.add.at(d_halves, (source[best, columns], columns), d_logit[i] * w["out"])
        d_halves *= peak > 0
        half, column = np.nonzero(d_halves)
        g = d_halves[half, column][:, None]
        at = half * (HALF // UNIT) + where[half, column]
        nxt = at + 1
        inside = (nxt < len(units)) & ~np.isin(nxt, first_half * (HALF // UNIT))
        out = {k: np.zeros_like(v) for k, v in w.items()}
        x1, x2 = units[at], units[np.minimum(nxt, len(units) - 1)] * inside[:, None]
        for f in range(FILTERS):
            own = column == f
            out["first"][:, f] = (x1[own] * g[own]).sum(axis=0)
            out["second"][:, f] = (x2[own] * g[own]).sum(axis=0)
            out["bias"][f] = g[own].sum()
        for matrix, places, there in (("first", at, np.ones(len(at), bool)), ("second", nxt, inside)):
            back = (w[matrix][:, column].T * g)[there].reshape(-1, UNIT, CHANNELS)[:, :, :EMBED]
            read = data[places[there][:, None] * UNIT + np.arange(UNIT)]
            np.add.at(out["embed"], read.ravel(), back.reshape(-1, EMBED))
        out["out"] = pooled.T @ d_logit
        out["shift"][0] = d_logit.sum()
        return out

    def train(self, texts: list[bytes], goal: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled small batches; as reproducible as the arithmetic."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.gradients([marks(texts[j]) for j in part], goal[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network trained on the sample, or the share of good labels where one class is missing."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 0.5
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = short.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(4 * SAMPLE).collect()
    goal = np.array([r["quality"] for r in rows], np.float32)
    if len(set(goal.tolist())) < 2:
        return counts.get(1, 0) / total
    network = Network()
    network.train([bytes(r["text"]) for r in rows], goal)
    network.log_odds = float(np.log(counts[1] / counts[0]) - np.log(goal.sum() / (1 - goal).sum()))
    return network


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    network = fitted(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network if isinstance(network, float) else network.score(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
