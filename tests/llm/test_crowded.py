"""Rows that repeat are no hot group: they are dealt out, and results stay what they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statloom.llm import _shared, hypergeometric_sharding, slack_packing, substring_dedup, systematic_mixing

KINDS = "doc_id long, text string, source string"


@pytest.fixture
def crowd(spark, monkeypatch):
    """4000 equal rows without id, 1500 equal ones with one, and some others."""
    monkeypatch.setattr(_shared, "GROUP_ROWS", 200)
    rows = [(None, "a b c", "s")] * 4000 + [(7, "x " * 40, "s")] * 1500 + [(i, f"w{i} " * (i % 30), ("s", "t", None)[i % 3]) for i in range(100, 400)]
    return spark.createDataFrame(rows, KINDS).repartition(4).cache()


def test_spread_splits_crowded_keys_alone(spark, crowd):
    rows = _shared.stage(crowd.select("doc_id", F.monotonically_increasing_id().alias("place")), "rows")
    found = _shared.spread(rows, ["doc_id"])
    assert found.columns == ["doc_id", "place", "sub"] and found.count() == crowd.count()
    sizes = {(r["doc_id"], r["sub"]): r["count"] for r in found.groupBy("doc_id", "sub").count().collect()}
    assert max(sizes.values()) < 280 and {s for d, s in sizes if d not in (None, 7)} == {0}
    assert len([1 for d, _ in sizes if d is None]) == 20 and len([1 for d, _ in sizes if d == 7]) == 8


def test_packing(crowd):
    packed = slack_packing.pack_documents(crowd).collect()
    assert len(packed) == crowd.count()
    by_sequence: dict = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert "place" not in packed[0].asDict()


def test_mixing(spark, crowd, monkeypatch):
    once = systematic_mixing.mixture(crowd).collect()
    docs = systematic_mixing.mixed_documents(crowd)
    assert docs.columns == crowd.columns
    taken = {}
    for r in once:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    again = {}
    for r in docs.select("doc_id", F.size(_shared.words_of(_shared.whole_text())).alias("n")).collect():
        again[r["doc_id"]] = again.get(r["doc_id"], 0) + r["n"]
    monkeypatch.setattr(_shared, "GROUP_ROWS", 1 << 18)
    whole = {}
    for r in systematic_mixing.mixture(crowd).collect():
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["taken"]
    assert taken == whole
    assert {k: v for k, v in again.items() if v} == {k: v for k, v in whole.items() if v}


def test_sharding(spark, crowd, monkeypatch):
    monkeypatch.setattr(hypergeometric_sharding, "LEAST_CELLS", 8)
    found = hypergeometric_sharding.shard_documents(crowd, 24).collect()
    slots: dict = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == crowd.count() and sorted(slots) == list(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows = hypergeometric_sharding._apart(crowd.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key")))
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 200
    plan = hypergeometric_sharding.shard_documents(crowd.select("doc_id", "text"), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_text_ids_in_substring_dedup(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [("b", passage), ("a", passage), ("7", passage), (None, passage + " end")]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digest(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {"7": (30, 0), "a": (30, 30), "b": (30, 30), None: (31, 30)}


def test_a_broken_manifest_is_no_new_index(spark, tmp_path):
    (tmp_path / "index" / "manifest").mkdir(parents=True)
    (tmp_path / "index" / "manifest" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017  whatever the reader says, but no empty history
        substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    assert substring_dedup.FingerprintIndex(spark, str(tmp_path / "other")).runs == []
