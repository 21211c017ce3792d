"""Importance resampling against plain counting: collapse, weights, noise, ranks, nulls, long texts, ties."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from statloom.llm import target_resampling as tr
from tests.llm.test_small_cases import documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text) -> tuple[int, list[int]]:
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs: list[tuple], target: list, percent: int = 5, least: int = 20) -> list[tuple]:
    corpus, wanted = [0] * 10000, [0] * 10000
    cut = [plain_features(t) for _, t in docs]
    for _, buckets in cut:
        for b in buckets:
            corpus[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            wanted[b] += 1
    s_all, t_all = sum(corpus), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(corpus, wanted, strict=True)]
    out = []
    for (doc_id, _), (n_words, buckets) in zip(docs, cut, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def found_of(df, target, **how) -> list[tuple]:
    return sorted(map(tuple, tr.resampled(df, target, **how).collect()), key=repr)


def targets(spark, rows: list):
    return spark.createDataFrame([(t, 1) for t in rows], "text string, copies int")


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_equals_plain_counting(spark, percent):
    df = documents(spark, extra=True).withColumnRenamed("own", "digest")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    wanted = [texts()[5], None, "", "w1 w2 w3 É x́y", texts()[5]]
    assert found_of(df, targets(spark, wanted), percent=percent) == plain(rows, wanted, percent)


def test_many_copies_and_many_ties(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i % 150, text) for i in range(300)] + [(None, text)] * 40 + [(i, f"{text} {i % 7}") for i in range(1000, 1200)]
    found = found_of(spark.createDataFrame(rows, "doc_id long, text string"), targets(spark, [text]), percent=50)
    assert found == plain(rows, [text], 50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert found_of(none, targets(spark, ["a"])) == []
    assert found_of(some, targets(spark, [])) == plain([(1, "a b"), (2, None)], [])


def test_texts_are_cut_in_pieces_without_losing_runs():
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["A", "b1", "çé", "漢", "--", "Zz.q", "\x00"], 3000))
    n_words, buckets = plain_features(text)
    for piece in (1, 7, 100, 1 << 20):
        n, features, some, counts = tr.features_of(text.encode(), piece)
        assert (n, features) == (n_words, len(buckets)) and np.repeat(some, counts).tolist() == sorted(buckets)


def test_a_very_long_text_keeps_a_bounded_row():
    text = " ".join(f"w{i % 50_000}" for i in range(600_000))
    n, features, some, counts = tr.features_of(text.encode())
    _, buckets = plain_features(text)
    assert (n, features, len(some)) == (600_000, 1_799_997, len(set(buckets))) and counts.tolist() == np.bincount(buckets, minlength=10000)[some].tolist()


def test_the_drawn_resemble_the_target(spark):
    rng = np.random.default_rng(6)
    near, far = [f"n{i}" for i in range(60)], [f"f{i}" for i in range(600)]
    rows = [(i, " ".join(rng.choice(near if i % 10 == 0 else far, 40))) for i in range(1000)]
    target = [" ".join(rng.choice(near, 200)) for _ in range(20)]
    drawn = [r[0] for r in found_of(spark.createDataFrame(rows, "doc_id long, text string"), targets(spark, target)) if r[4] is not None]
    assert len(drawn) == 50 and all(i % 10 == 0 for i in drawn)


def test_query_equals_plain_counting(spark):
    from statloom.llm import queries

    at = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op12_collapsed_resampling(spark, at).collect()), key=repr) == plain(docs, target)
