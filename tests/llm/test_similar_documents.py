"""Near copies of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.test_small_cases import documents, words


def plain_shingles(text) -> frozenset:
    found = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)])


def plain_classes(texts: list) -> list[int]:
    sets, group = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_one_of_each_class_of_similar_texts_stays(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (6, 25, 60, 200, 700):
        for _ in range(6):  # near copies: ever more words of a base changed
            base = rng.choice(vocabulary, size).tolist()
            for changed in (0, 1, 2, 3, 5, 8, 12):
                copy = list(base)
                for at in rng.choice(size, min(changed, size), replace=False):
                    copy[at] = f"new{rng.integers(10**9)}"
                texts.append(" ".join(copy))
    chain = rng.choice(vocabulary, 300).tolist()
    for step in range(25):  # each near the last, the ends far apart
        chain[12 * step : 12 * step + 4] = [f"c{step}x{i}" for i in range(4)]
        texts.append(" ".join(chain))
    passage = " ".join(rng.choice(vocabulary, 40))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, 60)) for _ in range(40)] + [texts[9].upper(), "short one", "Short  one", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_classes(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_similar_texts_keep_columns_and_rows_without_id(spark):
    docs = documents(spark, extra=True)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    rows = docs.collect()
    groups = plain_classes([r["text"] for r in rows])
    expected = {min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i, g in enumerate(groups) if g == name) for name in set(groups)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(expected)


def test_crowded_buckets_are_dealt_anew_by_rare_shingles(spark, monkeypatch):
    """A template in many texts that differ elsewhere, near copies among them, and a text of the template alone."""
    from pyspark.sql import functions as F

    from statloom.llm import similar_documents

    rng = np.random.default_rng(23)
    template = [f"t{i}" for i in range(150)]
    texts = [" ".join(template)]
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(int(rng.integers(20, 70)))]
        texts.append(" ".join(template + own))
        if i % 6 == 0:  # near copies: a few words more, fewer, or changed
            texts.append(" ".join(template + own[:-2] + [f"z{i}"]))
            texts.append(" ".join(template[4:] + own))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = sorted(set(plain_classes(texts)))
    seen = []
    plain = similar_documents.rare_meetings

    def watched(crowded, sets):
        out = plain(crowded, sets).cache()
        seen.append((crowded.count(), out.groupBy("bucket").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(similar_documents, "rare_meetings", watched)
    monkeypatch.setattr(similar_documents, "CROWD", 8)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and 40 < len(expected) < len(texts) - 10
    assert seen and seen[0][0] > 40 and (seen[0][1] or 0) < seen[0][0]
