"""Quality rules in languages of many and of few labels."""

from __future__ import annotations

import numpy as np

from statloom.llm import queries, risk_thresholds
from tests.helpers import duck, same


def text(i: int, end: str = "") -> str:
    return " ".join(f"word{i}x{j}{end}" for j in range(30))


def test_languages_of_few_labels_share_their_rules(spark):
    sizes = {"en": 900, "de": 300, "fr": 250, "es": 100}  # 527 are needed in two groups
    good, junk = [], []
    for lang, n in sizes.items():
        good += [(len(good) + i, text(i), lang) for i in range(n)]
        junk += [(10_000 + len(junk) + i, text(i, "###"), lang) for i in range(5)]
    docs = spark.createDataFrame(good + junk + [(20_000, text(0, "###"), "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], 1) for d in good] + [(d[0], 0) for d in junk], "doc_id long, quality int")
    kept = {r["doc_id"] for r in risk_thresholds.kept_documents(docs, labels).collect()}
    assert kept == {d[0] for d in good} | {20_000}  # no rule is on in a stratum without labels


def test_no_cutoff_beyond_one_that_fails(spark):
    # 3 % of the good texts have a share of symbols over 100 thousandths, so no stricter cutoff passes.
    docs = [(i, text(i, "#" if i < 30 else ""), "en") for i in range(1000)]
    labels = spark.createDataFrame([(d[0], 1) for d in docs], "doc_id long, quality int")
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    (row,) = risk_thresholds.cutoffs(docs, labels).collect()
    assert row["stratum"] == "en" and row["symbols"] == 200 and row["shouts"] == 5
    assert risk_thresholds.cutoffs(docs, labels.where("false")).count() == 0


def test_bound_holds_on_other_good_documents(spark):
    """Rules on in one language and off in the other; good documents not used in choosing are rarely rejected."""
    rng = np.random.default_rng(3)
    shares = rng.beta(0.6, 40, 4000)  # of words with a sign, mostly few
    docs = []
    for i, share in enumerate(shares.tolist()):
        signs = rng.random(40) < share
        docs.append((i, " ".join(f"word{i}x{j}" + "#" * 3 * int(s) for j, s in enumerate(signs)), "aa" if i % 2 else "bb"))
    docs += [(10_000 + i, text(i, "###"), "aa") for i in range(20)] + [(20_000 + i, text(i, "###"), "bb") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    noisy = [(d, 1) for d, _, lang in docs if d < 2000] + [(20_000 + i, 1) for i in range(20)]  # bb: labels that call junk good
    labels = spark.createDataFrame(noisy, "doc_id long, quality int")
    chosen = {r["stratum"]: r.asDict() for r in risk_thresholds.cutoffs(df, labels).collect()}
    assert chosen["aa"]["symbols"] is not None and chosen["bb"]["symbols"] is None and chosen["bb"]["shouts"] == 5
    kept = {r["doc_id"] for r in risk_thresholds.quality_verdicts(df, labels).where("kept").collect()}
    others = [d for d, _, lang in docs if 2000 <= d < 4000 and lang == "aa"]
    assert np.mean([d not in kept for d in others]) <= 2 * risk_thresholds.RISK
    assert not any(d in kept for d in range(10_000, 10_020)) and all(d in kept for d in range(20_000, 20_020))


def test_sql_agrees_where_rules_are_on_and_off(spark, tmp_path):
    sizes = {"en": 700, "de": 200, "fr": 400}  # two groups, both with rules
    docs = [(f"{lang}{i}", text(i, "#" if i % 40 == 0 and lang != "en" else ""), lang) for lang, n in sizes.items() for i in range(n)]
    docs = [(i, t, lang) for i, (_, t, lang) in enumerate(docs)] + [(9000, text(1, "###"), "en"), (9001, text(2, "!!"), None), (9002, None, "de")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1300)] + [(9000, 0), (None, 1)], "doc_id long, quality int")
    for name, table in (("documents", docs), ("labels", labels)):
        table.toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    chosen = {r["stratum"]: r["symbols"] for r in risk_thresholds.cutoffs(docs, labels).collect()}
    assert chosen["en"] == 5 and chosen["de"] == chosen["fr"] == 200
    same(risk_thresholds.quality_verdicts(docs, labels), duck(tmp_path), queries.ORACLE_SQL["op7_risk_controlled_rules"])
