"""Mixing sources to target weights by systematic sampling.

Every source has a target size; its documents' expected copies are target over size.  In
each source these expected copies are prefix-summed along the documents ordered by size
class, one random offset is added, and a document is emitted once for each whole number its
stretch crosses.  Ordering by size spreads the copies evenly over short and long documents,
so the words taken come near the target.

The prefix sum is computed in steps: documents are counted by source, size class and a slice of
4096 by a digest of doc_id; class counts are summed along each source, counts by the slice's first
digit along each class of a source, slice counts along each of these, and only within a slice are
documents numbered.  A hot source is thereby spread over its classes and slices; a slice that
rows without doc_id, or of equal ones, crowd is dealt out once more by where its rows lie.  Sources, which may be very many, are numbered and
summed up in ranges.

Defined results: null texts have size 0, null sources form the last source; a source of
size 0 has target 0 and its documents are not taken; rows that repeat are documents of
their own; other columns are kept or play no part, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._shared import spread, stage, whole_text, words_of

LARGEST_RATE = 3
SEED = "mix"


def running(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """The rows with ``place`` (from 0) in the order and, for each of ``sums``, ``<name>_before``: its sum over earlier rows.

    The rows are dealt to ranges of the order, ranges are summed up, then rows within each.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    total = ranged.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    zero = F.lit(0)
    bases = total.select("part", *[F.coalesce(F.sum(c).over(upto), zero).alias(f"{c}_base") for c in ("n", *sums)])
    within = Window.partitionBy("part").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(bases, "part").select(
        *df.columns,
        (F.col("n_base") + F.row_number().over(within) - 1).alias("place"),
        *[(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(earlier), zero)).alias(f"{c}_before") for c in sums],
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size and target of each source, from rows (source_key, source, size).

    Sources by code point, null last, weigh 1, 2, 3 and so on again.  The whole is shared by
    weight; what a source would get above three times its size is shared among the others.
    That level is found in one pass: with sources ordered by size over weight, those before
    the level keep their largest target and the rest share what is left.
    """
    totals = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    named = running(totals, [F.asc_nulls_last("source")])
    weighed = stage(named.select("*", (F.col("place") % 3 + 1).alias("weight"), (LARGEST_RATE * F.col("source_size")).alias("most")).drop("place"), "weights")
    whole, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    key = F.col("most").cast("double") / F.col("weight")
    summed = running(weighed.withColumn("level", key), [F.asc("level"), F.asc_nulls_last("source")], "most", "weight")
    shared = summed.select("*", (F.lit(whole or 0) - F.col("most_before")).alias("left"), (F.lit(weights or 0) - F.col("weight_before")).alias("weights"))
    full = F.col("most").cast("double") * F.col("weights") <= F.col("left").cast("double") * F.col("weight")
    flagged = stage(shared.select("*", full.alias("full")), "shares")
    # Of the sources below their largest target, the first in the order holds the level.
    holder = flagged.where("not full").agg(F.min(F.struct("place", "left", "weights")).alias("first")).first()["first"]
    share = F.lit(float(holder["left"])) * F.col("weight") / F.lit(float(holder["weights"])) if holder else F.lit(None).cast("double")
    return flagged.select("source_key", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


#: What tells rows of a source apart before they are numbered.
GROUP = ["source_key", "class", "slice"]


def size_class(size: Column) -> Column:
    """Eight classes for each power of two; a class's sizes differ by at most an eighth."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7))


def with_copies(df: DataFrame, targets: DataFrame, groups: DataFrame, ties: list[str]) -> DataFrame:
    """The rows with source_size, target and copies; ``df`` has source_key, size, class, slice, sub, doc_id and place."""
    zero = F.lit(0)
    along = Window.partitionBy("source_key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # some hundred classes
    bases = groups.groupBy("source_key", "class").agg(F.sum("held").alias("held"))
    bases = bases.select("source_key", "class", F.coalesce(F.sum("held").over(along), zero).alias("base")).join(targets, "source_key")
    first_digit = F.substring("slice", 1, 1).alias("digit")
    digits = groups.groupBy("source_key", "class", first_digit).agg(F.sum("held").alias("held"))
    by_digit = Window.partitionBy("source_key", "class").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # 17 digits
    digits = digits.withColumn("before", F.coalesce(F.sum("held").over(by_digit), zero)).drop("held").join(bases, ["source_key", "class"])
    slices = Window.partitionBy("source_key", "class", "digit").orderBy("slice", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("digit", first_digit).withColumn("first", F.coalesce(F.sum("held").over(slices), zero)).join(digits, ["source_key", "class", "digit"])
    starts = starts.withColumn("first", F.col("first") + F.col("base") + F.col("before"))
    within = Window.partitionBy("source_key", "class", "slice", "sub").orderBy("size", "doc_id", F.xxhash64(*ties))
    numbered = df.withColumn("nth", F.row_number().over(within) - 1).join(
        starts.select("source_key", "class", "slice", "sub", "first", "source_size", "target"), ["source_key", "class", "slice", "sub"]
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "source_key")), 1, 8), 16, 10).cast("double") / 4294967296
    place = F.col("first") + F.col("nth")
    crossed = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    return numbered.withColumn("copies", crossed.cast("int")).drop("nth", "first")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with source_key, size, class and slice."""
    return (
        docs.withColumn("size", F.size(words_of(whole_text())).cast("long"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .withColumn("slice", F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 3), F.lit("")))
    )


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every document."""
    small = keyed(docs).select("doc_id", "source", "source_key", "size", "slice", F.monotonically_increasing_id().alias("place"))
    small = spread(stage(small, "sizes").withColumn("class", size_class(F.col("size"))), GROUP)
    targets = source_targets(small)
    groups = small.groupBy(*GROUP, "sub").agg(F.count("*").alias("held"))
    mixed = with_copies(small, targets, groups, ["doc_id", "size"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as it is taken; all columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    rows = keyed(rows).withColumn("text_hash", F.xxhash64(whole_text())).drop("text")
    small = stage(rows.select("source_key", "source", "size", "slice"), "sizes").withColumn("class", size_class(F.col("size")))
    rows = rows.withColumn("class", size_class(F.col("size")))
    if small.groupBy(*GROUP).count().where(F.col("count") > _shared.GROUP_ROWS).isEmpty():
        rows, groups = rows.withColumn("sub", F.lit(0).cast("long")), small.withColumn("sub", F.lit(0).cast("long"))
    else:  # rows that crowd a group need numbers that last
        rows = groups = spread(stage(rows.withColumn("place", F.monotonically_increasing_id()), "crowded"), GROUP)
    rows, groups = rows.drop("source", "place"), groups.groupBy(*GROUP, "sub").agg(F.count("*").alias("held"))
    mixed = with_copies(rows, source_targets(small), groups, ["text_hash"])
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


ORACLE_SQL = r"""
WITH small AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), '') AS slice
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class FROM small),
totals AS (SELECT source_key, source, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY ALL),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight,
         sum(source_size) OVER () AS whole, 3 * source_size AS most FROM totals),
shared AS (
  SELECT *,
    whole - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighed),
flagged AS (SELECT *, CAST(most AS DOUBLE) * weights <= CAST(rest AS DOUBLE) * weight AS is_full FROM shared),
level AS (SELECT rest, weights FROM flagged WHERE NOT is_full
          ORDER BY CAST(most AS DOUBLE) / weight, source ASC NULLS LAST LIMIT 1),
targets AS (
  SELECT source_key, source_size,
    CASE WHEN is_full THEN CAST(most AS DOUBLE)
         ELSE CAST((SELECT rest FROM level) AS DOUBLE) * weight / CAST((SELECT weights FROM level) AS DOUBLE) END AS target
  FROM flagged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY class, slice, size, doc_id) - 1 AS place FROM classed),
rated AS (
  SELECT p.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix' || p.source_key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS offs
  FROM placed p JOIN targets t USING (source_key))
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * (place + 1) + offs) - floor(rate * place + offs) AS BIGINT) * size AS taken
FROM rated
"""
