"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from statloom.llm import queries
from tests.helpers import duck, same
from tests.llm.test_similar_documents import plain_classes
from tests.llm.test_small_cases import plain_counts, plain_removals, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table, key = ("embeddings", "query_id") if name.startswith("op5") else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    ids = {r[0] for r in rows.select("vec_id" if key == "query_id" else "doc_id").collect()}
    assert {r[0] for r in out.select(key).collect()} == ({i for i in ids if i % 50 == 0} if key == "query_id" else ids)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        done[name] = (docs.collect(), stage(spark, docs, SF).cache())
        assert name == "packing" or done[name][1].columns == docs.columns
        docs = done[name][1]

    before, after = done["quality"]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before:
        n, _, symbols, _, repeated = plain_counts(r["text"])
        if n < 20 or 100 * repeated > 30 * n:
            assert r["doc_id"] not in kept
        elif symbols == 0 and "!" not in r["text"] and r["text"].count("\n") == 0:
            assert r["doc_id"] in kept or r["text"].isupper()

    before, after = done["near_duplicates"]
    least: dict = {}  # of each class of texts with a similarity of 0.8 or more
    for r, group in zip(before, plain_classes([r["text"] for r in before]), strict=True):
        least[group] = min(least.get(group, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least.values())

    before, after = done["repeated_passages"]
    expected = {(d, s) for d, _, _, s in plain_removals([(r["doc_id"], r["text"]) for r in before])}
    assert {(str(r["doc_id"]), hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in after.collect()} == expected

    before, after = done["mixing"]
    times: dict = {}
    for r in after.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 3

    _, after = done["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(times)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
