"""Quality rules whose cutoffs are chosen under a bound on false rejections.

A rule rejects a document when a share counted in its text exceeds a cutoff.  On labelled
documents the good ones that a cutoff would reject are counted, for every rule, cutoff and
stratum (language).  A cutoff passes when the exact binomial test rules out a false rejection
rate of ``RISK`` or more.  A rule's cutoffs are nested, so they are tested in a fixed order, from
the laxest to the strictest and no further than the first that fails; only rules and strata then
share the level (Bonferroni).  The strictest cutoff reached is used, and a rule without one is
off in that stratum.  So with probability 1 - ``LEVEL`` no rule in use falsely rejects more than
``RISK`` of the good documents of its stratum.  Languages with too few labels to have rules alone
form one stratum: its bound holds for their good documents taken together.

All of it is column expressions.  Shares are compared in whole thousandths.  The counts for
choosing cutoffs need only cheap counts of characters; repeated windows are found by sorting
window hashes within the document, at n log n for any length.

Defined results: a null text is empty; null languages are a stratum; a document with
several labels is good if all are 1; null labels and ids are no labels; without labels only
the base rules reject; rows that repeat each get a row; columns with other names are kept or
play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, SPACE, WORD_CHAR, let, stage, whole_text, words_of

RISK = 0.01
LEVEL = 0.05
LEAST_WORDS = 20
WINDOW = 8  # a power of two
MOST_REPEATED = 30  # percent of the words
#: Ids of labelled documents that are broadcast at most.
LABEL_ROWS = 1 << 20
#: Terms of the binomial tail summed one by one; the rest is bounded by a geometric series.
TERMS = 5000

_STUTTER = rf"(?<!{WORD_CHAR})({WORD_CHAR}++){SPACE}\1(?!{WORD_CHAR})"
#: Rule to (what is counted, out of what, cutoffs in thousandths, strictest first).
RULES = {
    "symbols": ("n_symbols", "word_chars", (5, 10, 20, 50, 100, 200)),
    "shouts": ("n_shouts", "word_chars", (5, 10, 20, 50, 100, 200)),
    "capitals": ("n_capitals", "word_chars", (100, 150, 200, 300, 500)),
    "stutters": ("n_stutters", "word_chars", (10, 20, 40, 80)),
    "same_lines": ("n_dup_lines", "n_lines", (100, 200, 350, 500, 700)),
}


def _only(text: Column, kept: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def cheap_counts(text: Column) -> Column:
    """A struct of the counts that the rules use."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_CHAR)))
    return let(
        F.struct(lines.alias("lines")),
        lambda x: F.struct(
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            _only(text, "#*$%&|<>").alias("n_symbols"),
            _only(text, "!").alias("n_shouts"),
            _only(text, r"\p{Lu}").alias("n_capitals"),
            F.regexp_count(text, F.lit(_STUTTER)).cast("long").alias("n_stutters"),
            F.size(x["lines"]).cast("long").alias("n_lines"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
        ),
    )


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text has twice or more.

    A window's hash is made of those of its halves: words, then pairs, then runs of four, of eight.
    """

    def window_hashes(parts: Column, width: int, body) -> Column:
        if width == WINDOW:
            return body(parts)
        n = F.size(parts) - width
        both = F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(1 + width), n), lambda a, b: F.xxhash64(a, b))
        return let(both, lambda x: window_hashes(x, 2 * width, body))

    def spread(sorted_pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(
            sorted_pairs, lambda x, i: same(x, F.get(sorted_pairs, i - 1)) | same(x, F.get(sorted_pairs, i + 1))
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        reach = lambda p: F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        return let(places, lambda p: F.aggregate(reach(p), F.lit(0).cast("long"), lambda a, b: a + b))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, spread))

    of_words = lambda h: window_hashes(h, 1, count)
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def all_counts(text: Column) -> Column:
    """The counts of ``cheap_counts`` with n_words and n_repeat_words."""
    both = let(words_of(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    return let(
        F.struct(cheap_counts(text).alias("a"), both.alias("b")),
        lambda x: F.struct(x["b"]["n_words"].alias("n_words"), x["b"]["n_repeat_words"].alias("n_repeat_words"),
                           *[x["a"][c].alias(c) for c in ("word_chars", "n_symbols", "n_shouts", "n_capitals", "n_stutters", "n_lines", "n_dup_lines")]),
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _log_factorial(n: Column) -> Column:
    """log n!: looked up for small n, by Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(32)])
    index, n = F.least(n, F.lit(31)).cast("int"), n.cast("double")
    series = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n)
    return F.when(n < 32, F.get(small, index)).otherwise(series)


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k), X binomial (n, p), for k < n p: exact up to rounding, never too low."""
    at_k = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TERMS)) - 1))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ran = F.aggregate(
        steps,
        start,
        lambda a, j: let(
            a["term"] * (k - j) * odds / (n - k + j + 1), lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total"))
        ),
    )
    beyond = F.when(k > TERMS, let((k - TERMS) * odds / (n - k + TERMS + 1), lambda r: r / (1 - r))).otherwise(F.lit(0.0))
    return at_k + let(ran, lambda x: F.log(x["total"] + x["term"] * beyond))


def _exceeds(counts: Column, rule: str, cutoff: Column | int) -> Column:
    part, whole, _ = RULES[rule]
    return 1000 * counts[part] > cutoff * counts[whole]


TESTS = [(rule, cut) for rule, (_, _, cuts) in RULES.items() for cut in cuts]


def _false_rejections(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, n (good documents) and how many of them each cutoff would reject."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = good.where("quality = 1").select("doc_id")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    counts = cheap_counts(whole_text()).alias("c")
    if good.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS:  # then only labelled texts are counted
        counted = rows.join(F.broadcast(good), "doc_id").select("stratum", counts)
    else:  # the counts travel, not the texts
        counted = rows.select("doc_id", "stratum", counts).join(good, "doc_id").select("stratum", "c")
    sums = [F.sum(_exceeds(F.col("c"), rule, cut).cast("long")).alias(f"{rule}_{cut}") for rule, cut in TESTS]
    return counted.groupBy("stratum").agg(F.count("*").alias("n"), *sums)


def _passes(n: Column, k: Column, tests: Column) -> Column:
    """Whether k of n rule out a rate of ``RISK``, at the level shared among so many tests."""
    tail = log_binomial_tail(k, n, RISK)
    return F.when(k < RISK * n, tail <= F.log(F.lit(LEVEL) / tests)).otherwise(F.lit(False))


def labels_needed(groups: Column) -> Column:
    """Good labels from which a group that rejects none of them has rules, among so many groups."""
    return F.ceil(F.log(groups * len(RULES) / LEVEL) / -math.log1p(-RISK))


def cutoffs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and the cutoff of each rule, null where it is off; strata with labels only.

    Which strata are pooled depends on how many good labels they have, not on what is rejected.
    """
    per_stratum = stage(_false_rejections(docs, labels), "rejections")
    most = Window.orderBy(F.desc("n"), "stratum")  # one row for each stratum
    ranked = per_stratum.select("*", F.row_number().over(most).alias("rank"))
    last = F.coalesce(F.max(F.when(F.col("n") >= labels_needed(F.col("rank") + 1), F.col("rank"))).over(Window.partitionBy()), F.lit(0))
    ranked = ranked.withColumn("last", last).withColumn("group", F.when(F.col("rank") <= F.col("last"), F.col("rank")).otherwise(0))
    whole = Window.partitionBy()
    ranked = ranked.withColumn("groups", F.col("last") + F.max((F.col("group") == 0).cast("int")).over(whole))
    ranked = stage(ranked, "ranked")
    names = ["n", *[f"{rule}_{cut}" for rule, cut in TESTS]]
    sums = ranked.groupBy("group", "groups").agg(*[F.sum(c).alias(c) for c in names])

    def strictest(rule: str) -> Column:
        chosen, going = F.lit(None).cast("int"), F.lit(True)
        for cut in reversed(RULES[rule][2]):
            going = going & F.col(f"{rule}_{cut}_passes")
            chosen = F.when(going, F.lit(cut)).otherwise(chosen)
        return chosen.alias(rule)

    passes = [_passes(F.col("n"), F.col(f"{r}_{c}"), F.col("groups") * len(RULES)).alias(f"{r}_{c}_passes") for r, c in TESTS]
    chosen = stage(sums.select("group", *passes), "passes").select("group", *[strictest(r) for r in RULES])
    return ranked.select("stratum", "group").join(chosen, "group").drop("group")


def _with_cutoffs(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` has a column stratum; gets the column cutoffs (a struct, null without labels)."""
    chosen = chosen.select("stratum", F.struct(*RULES).alias("cutoffs"))
    chosen = stage(chosen, "cutoffs")
    small = chosen.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(chosen) if small else chosen, "stratum", "left")


def rejected(counts: Column, chosen: Column) -> Column:
    """Whether a rule in use rejects."""
    return reduce(lambda a, b: a | b, [F.coalesce(_exceeds(counts, r, chosen[r]), F.lit(False)) for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    rows = _with_cutoffs(rows, cutoffs(docs, labels)).select("doc_id", "cutoffs", all_counts(whole_text()).alias("c"))
    return rows.select(
        "doc_id",
        *[F.col("c")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(F.col("c")).alias("base_failed"),
        (~base_failed(F.col("c")) & ~rejected(F.col("c"), F.col("cutoffs"))).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects; all columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    rows = _with_cutoffs(rows, cutoffs(docs, labels))
    stays = let(all_counts(whole_text()), lambda c: ~base_failed(c) & ~rejected(c, F.col("cutoffs")))
    return rows.where(stays).select("row.*")


def _oracle() -> str:
    tests = [(rule, cut) for rule, (_, _, cuts) in RULES.items() for cut in cuts]
    exceeds = lambda r, cut: f"1000 * {RULES[r][0]} > {cut} * {RULES[r][1]}"
    ws = r"[\x20\x09-\x0D]"
    each = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c} AS cut, count(*) AS n, count(*) FILTER (WHERE {exceeds(r, c)}) AS k FROM good GROUP BY stratum" for r, c in tests
    )
    reject = " OR ".join(f"coalesce({exceeds(r, 'x.' + r)}, false)" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{ws}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM c WHERE len(ws) >= {WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY rid),
m AS (
  SELECT rid, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{ws}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
    CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals,
    ws,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words
  FROM c LEFT JOIN covered v USING (rid)),
steps AS (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run
  FROM (SELECT rid, ws, unnest(range(2, len(ws) + 1)) AS i FROM c WHERE len(ws) >= 2) WHERE ws[i] = ws[i - 1]),
stutters AS (SELECT rid, CAST(sum((k + 1) // 2) AS BIGINT) AS n_stutters FROM (SELECT rid, run, count(*) AS k FROM steps GROUP BY rid, run) GROUP BY rid),
f AS (SELECT m.*, coalesce(n_stutters, 0) AS n_stutters FROM m LEFT JOIN stutters USING (rid)),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
tests AS ({each}),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n DESC, stratum) AS place FROM (SELECT DISTINCT stratum, n FROM tests)),
alone AS (SELECT coalesce(max(place) FILTER (WHERE n >= ceil(ln((place + 1) * {len(RULES)} / {LEVEL}) / -ln(1 - {RISK}))), 0) AS last FROM ranked),
grouped AS (SELECT stratum, CASE WHEN place <= last THEN place ELSE 0 END AS grp FROM ranked, alone),
pooled AS (SELECT grp, rule, cut, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM tests JOIN grouped USING (stratum) GROUP BY ALL),
tails AS (
  SELECT grp, rule, cut, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM pooled WHERE k < {RISK} * n) GROUP BY ALL),
tested AS (
  SELECT grp, rule, cut, coalesce(tail <= {LEVEL} / ((SELECT count(DISTINCT grp) FROM pooled) * {len(RULES)}), false) AS ok
  FROM pooled LEFT JOIN tails USING (grp, rule, cut)),
reached AS (
  SELECT grp, rule, cut FROM tested t
  WHERE ok AND NOT EXISTS (SELECT 1 FROM tested l WHERE l.grp = t.grp AND l.rule = t.rule AND l.cut > t.cut AND NOT l.ok)),
chosen AS (
  SELECT stratum, {', '.join(f"min(cut) FILTER (WHERE rule = '{r}') AS {r}" for r in RULES)}
  FROM grouped LEFT JOIN reached USING (grp) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND NOT ({reject}) AS kept
FROM f LEFT JOIN chosen x USING (stratum)
"""


ORACLE_SQL = _oracle()
