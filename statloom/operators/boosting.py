"""Gradient-boosted trees for several classes, grown from histograms that Spark adds up.

Features are cut at quantiles into at most ``bins`` bins, once, and staged.  Each round grows
one tree for every class at the same time, level by level: a pass over the staged rows adds up
gradients and Hessians of the softmax loss by class, node, feature and bin, first within each
task, then by one aggregation; the driver sees these sums (at most classes x nodes x features x
bins) and chooses the splits.  Margins of finished trees are staged every ``REFRESH`` rounds, so a
row is never walked through more trees than that.

Sums are taken over integers (units of 2^-32), so that trees depend neither on how rows are
dealt to tasks nor on their order.  A missing value has a bin of its own and goes to the side
where the gain is larger.

Defined results: rows without a label take no part in a fit; rows that repeat count as often;
of equal gains the first feature, then the lowest cut, then missing values to the left win; a
table without labels gives a model without trees, whose classes are equally likely.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import staged

UNIT = float(1 << 32)
REFRESH = 10


@dataclass
class Tree:
    """Nodes as arrays, the root first; a leaf has no feature (-1).  Bin 0 holds missing values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])  # bins up to this go left
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])  # the right child is the next
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> None:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node], self.left[node] = feature, cut, missing_left, gain, len(self.feature)
        for value in values:
            for line, first in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.left, -1), (self.value, value), (self.gain, 0.0)):
                line.append(first)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (of bins by feature) ends in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, to_left = (np.array(x) for x in (self.feature, self.cut, self.left, self.missing_left))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            own = bins[inner, feature[node]]
            goes_left = np.where(own == 0, to_left[node], own <= cut[node])
            at[inner] = left[node] + ~goes_left


@dataclass
class Boosted:
    """A fitted model: where features are cut, and a tree for each round and class."""

    features: list[str]
    edges: list[list[float]]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.leaves(bins)]
        return out

    def importances(self) -> list[tuple[str, float]]:
        """Features by their mean gain in a split, as shares, largest first."""
        total, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in (t for trees in self.rounds for t in trees):
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[f] += gain
                    times[f] += 1
        mean = total / np.maximum(times, 1)
        share = mean / mean.sum() if mean.sum() else mean
        return sorted(zip(self.features, map(float, share), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Written as JSON lines, by Spark, so that any store will do."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        held = json.loads(spark.read.text(path).first()["value"])
        return Boosted(**held | {"rounds": [[Tree(**t) for t in trees] for trees in held["rounds"]]})


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the distinct values at ``bins - 1`` quantiles: a value up to the i-th edge is in bin i + 1."""
    shares = [i / bins for i in range(1, bins)]
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    found = rows.agg(*[F.percentile_approx(value(c), shares, 100_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]


def _binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> Column:
    """The bins of a row's features as an array of bytes: 0 missing, then 1 up to the number of edges + 1."""
    each = []
    for name, own in zip(features, edges, strict=True):
        value = F.col(name).cast("double")
        above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in own]).cast("array<double>"), lambda e: e < value)) if own else F.lit(0)
        each.append(F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(above + 1).cast("smallint"))
    return F.array(*each)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sampled(ids: np.ndarray, round_no: int, share: float) -> np.ndarray:
    """Which rows a round looks at: by a mix of the row's hash and the round, the same in every pass."""
    if share >= 1:
        return np.ones(len(ids), bool)
    x = ids.view(np.uint64) + np.uint64((round_no + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < share


def _columns(batch: pa.RecordBatch, features: int, classes: int) -> tuple[np.ndarray, ...]:
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
    margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
    return batch.column("id").to_numpy(), batch.column("label").to_numpy(), bins, margins


def best_split(g: np.ndarray, h: np.ndarray, allowed: list[int], lam: float, least: float) -> tuple | None:
    """(gain, feature, cut, missing to the left, sums of the left side) of the best split of a node, from its sums by (feature, bin)."""
    best, total_g, total_h = None, g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + lam)
    for f in allowed:
        for to_left in (True, False):
            left_g, left_h = g[f, 1:].cumsum() + to_left * g[f, 0], h[f, 1:].cumsum() + to_left * h[f, 0]
            for cut in range(len(left_g) - 1):
                a, b = left_h[cut], total_h - left_h[cut]
                if a < least or b < least:
                    continue
                gain = score(left_g[cut], a) + score(total_g - left_g[cut], b) - score(total_g, total_h)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut + 1, to_left, left_g[cut], a)
    return best


def fit(
    rows: DataFrame, features: list[str], label: str = "label", classes: int = 3, rounds: int = 200, depth: int = 4, rate: float = 0.05,
    subsample: float = 0.8, colsample: float = 0.8, bins: int = 32, lam: float = 1.0, least: float = 1.0, seed: int = 42,
) -> Boosted:
    """Trees over the features for labels 0 to ``classes - 1``."""
    known = rows.where(F.col(label).isNotNull())
    model = Boosted(list(features), quantile_edges(known, features, bins), classes)
    columns = known.select(
        F.xxhash64(F.lit(seed), *[F.col(c).cast("double") for c in features], F.col(label).cast("int")).alias("id"), F.col(label).cast("int").alias("label"),
        _binned(known, features, model.edges).alias("bins"), F.array_repeat(F.lit(0.0), classes).alias("margins"),
    )
    table, staged_rounds, width = staged(columns, "binned"), 0, max(len(e) for e in model.edges) + 2
    for round_no in range(rounds):
        rng = np.random.default_rng([seed, round_no])
        trees = [Tree() for _ in range(classes)]
        count = max(1, round(colsample * len(features)))
        allowed = [sorted(rng.permutation(len(features))[:count].tolist()) for _ in range(classes)]
        open_nodes = [[0] for _ in range(classes)]
        model.rounds.append(trees)
        for level in range(depth):
            sums = _histograms(table, model, trees, staged_rounds, open_nodes, round_no, subsample, width)
            following = [[] for _ in range(classes)]
            for k, tree in enumerate(trees):
                for node in open_nodes[k]:
                    g, h = sums.get((k, node), np.zeros((2, len(features), width)))
                    if level == 0 and node == 0:
                        tree.value[0] = -rate * g[0].sum() / (h[0].sum() + lam)
                    found = best_split(g, h, allowed[k], lam, least)
                    if found is None:
                        continue
                    gain, f, cut, to_left, left_g, left_h = found
                    sides = ((left_g, left_h), (g[0].sum() - left_g, h[0].sum() - left_h))
                    tree.split(node, f, cut, to_left, float(gain), tuple(float(-rate * a / (b + lam)) for a, b in sides))
                    following[k] += [tree.left[node], tree.left[node] + 1]
            open_nodes = following
            if not any(open_nodes):
                break
        if len(model.rounds) - staged_rounds >= REFRESH and len(model.rounds) < rounds:
            table, staged_rounds = staged(_moved(table, model, staged_rounds), "margins"), len(model.rounds)
    return model


def _histograms(table: DataFrame, model: Boosted, trees: list[Tree], done: int, open_nodes: list[list[int]], round_no: int, share: float, width: int) -> dict:
    """(class, node) to the sums of gradients and Hessians by feature and bin, of the nodes that may be split."""
    features, classes = len(model.features), model.classes
    finished = Boosted(model.features, [], classes, model.rounds[done:-1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            ids, label, bins, margins = _columns(batch, features, classes)
            chosen = _sampled(ids, round_no, share)
            label, bins, margins = label[chosen], bins[chosen], margins[chosen]
            p = softmax(margins + finished.margins(bins))
            for k, tree in enumerate(trees):
                g = np.rint((p[:, k] - (label == k)) * UNIT).astype(np.int64)
                h = np.rint(2 * p[:, k] * (1 - p[:, k]) * UNIT).astype(np.int64)
                at = tree.leaves(bins)
                for node in open_nodes[k]:
                    own = at == node
                    place = (np.arange(features) * width + bins[own]).ravel()
                    held = total.setdefault((k, node), np.zeros((2, features * width), np.int64))
                    np.add.at(held[0], place, np.repeat(g[own], features))
                    np.add.at(held[1], place, np.repeat(h[own], features))
        lines = [(k, node, int(i), int(held[0][i]), int(held[1][i])) for (k, node), held in total.items() for i in np.flatnonzero(held.any(axis=0))]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*lines, strict=True) if lines else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["class", "node", "place", "g", "h"])

    parts = table.mapInArrow(add, "class int, node int, place int, g long, h long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict = {}
    for r in parts.groupBy("class", "node", "place").agg(big("g"), big("h")).collect():  # bounded by the parameters, not the rows
        held = out.setdefault((r["class"], r["node"]), np.zeros((2, features * width)))
        held[0, r["place"]], held[1, r["place"]] = int(r["g"]) / UNIT, int(r["h"]) / UNIT
    return {key: held.reshape(2, features, width) for key, held in out.items()}


def _moved(table: DataFrame, model: Boosted, done: int) -> DataFrame:
    """The rows with the margins of all trees so far."""
    features, classes = len(model.features), model.classes
    new = Boosted(model.features, [], classes, model.rounds[done:])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, bins, margins = _columns(batch, features, classes)
            after = (margins + new.margins(bins)).ravel()
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * classes), pa.array(after))
            yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("bins"), held], names=["id", "label", "bins", "margins"])

    return table.mapInArrow(move, "id long, label int, bins array<smallint>, margins array<double>")


def scored(model: Boosted, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept, predicted (ties to the smaller class) and the probability of each class, p0 and on."""
    classes, width = model.classes, len(model.features)
    names = [F.col(c) for c in keep]
    binned = rows.select(F.struct(*names).alias("row"), _binned(rows, model.features, model.edges).alias("bins"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            p = softmax(model.margins(bins)) if len(bins) else np.empty((0, classes))
            yield pa.record_batch([batch.column("row"), pa.array(p.argmax(axis=1).astype(np.int32)), *(pa.array(p[:, k]) for k in range(classes))], names=["row", "predicted", *(f"p{k}" for k in range(classes))])

    kind = binned.schema["row"].dataType.simpleString()
    out = binned.mapInArrow(score, f"row {kind}, predicted int, " + ", ".join(f"p{k} double" for k in range(classes)))
    return out.select("row.*", "predicted", *(f"p{k}" for k in range(classes)))
