"""Items that appear together: counts, lift and pointwise mutual information.

Items are deduplicated per basket, ordered pairs (a < b) are emitted and counted
with map-side combine, and lift and PMI follow from the marginals. Two exact
devices keep hot baskets from exploding:

* *Prefixes.* Order all baskets from small to large and set the last ``k`` (the
  largest) of every item aside. Of the ``t`` baskets that two items share, those
  set aside by either are the last ones, ``k`` at most, so ``t - k`` or more lie
  in what both have left: pairs are emitted from there only and dropped below
  that; then the counts in the baskets set aside are added for the pairs that
  remain, by equi-joins on (item, basket), whose keys are unique. Items in fewer
  than ``t`` baskets are left out before that.
* *Blocks.* A basket with more than ``block`` items is cut into blocks by hash,
  and every pair of blocks is a join key of its own.

Defined results: rows with a null item or basket are ignored, repeated rows count
once, ties need no order, an empty table gives no pairs; columns other than the
two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribuna.session import cut

BLOCK = 256


def pairs(df: DataFrame, item: str, basket: str, least: int = 6, block: int = BLOCK, aside: int | None = None) -> DataFrame:
    """Pairs a < b in at least ``least`` common baskets: a, b, n_ab, n_a, n_b, baskets, lift, pmi.

    Counts are exact over all rows; ``baskets`` counts every basket, also those without a pair. ``aside``: how many of
    its largest baskets each item sets aside (by default half of ``least``, at most ``least - 1``); any number gives the
    same result: more make fewer rows from large baskets, fewer make a sharper bound.
    """
    aside_ = min(least - 1, least // 2 if aside is None else aside)
    rows = df.select(F.col(item).alias("item"), F.col(basket).alias("basket")).where("item is not null and basket is not null")
    # Baskets by a 128-bit key: their texts would otherwise pass through every shuffle below.
    key = F.struct(F.xxhash64("basket").alias("h"), F.xxhash64("basket", F.lit(1)).alias("l"))
    rows = cut(rows.select("item", key.alias("basket")).distinct())
    sizes = rows.groupBy("basket").agg(F.count("*").alias("size"))
    n_baskets = sizes.count()  # one number
    items = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = cut(rows.join(items, "item").join(sizes, "basket"))
    # The largest baskets of each item. The bound on the rank is applied before the shuffle, so an item
    # in a third of all baskets sends a few rows from each task, not all of them to one.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("size"), F.desc("basket")))
    aside = cut(kept.withColumn("rank", rank).where(F.col("rank") <= aside_).select("item", "basket"))
    prefix = kept.select("item", "basket", "n").join(aside, ["item", "basket"], "left_anti")

    # Emit pairs from the prefixes, blockwise.
    own = prefix.groupBy("basket").agg(F.count("*").alias("m")).where("m > 1")
    parted = prefix.join(own, "basket").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("at", F.pmod(F.hash("item"), F.col("blocks")))
    left = parted.select(F.col("item").alias("a"), F.col("n").alias("n_a"), "basket", F.col("at").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = parted.select(F.col("item").alias("b"), F.col("n").alias("n_b"), "basket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("at").alias("j"))
    emitted = left.join(right, ["basket", "i", "j"]).where("a < b")
    counted = emitted.groupBy("a", "b").agg(F.count("*").alias("seen"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    candidates = cut(counted.where(F.col("seen") >= least - aside_))

    # Add what the pairs share in the baskets that either has set aside.
    from_a = candidates.select("a", "b").join(aside.withColumnRenamed("item", "a"), "a").join(kept.select(F.col("item").alias("b"), "basket"), ["b", "basket"])
    from_b = candidates.select("a", "b").join(aside.withColumnRenamed("item", "b"), "b").join(prefix.select(F.col("item").alias("a"), "basket"), ["a", "basket"])
    extra = from_a.select("a", "b").unionByName(from_b.select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("more"))
    whole = candidates.join(extra, ["a", "b"], "left").withColumn("n_ab", F.col("seen") + F.coalesce("more", F.lit(0))).where(F.col("n_ab") >= least).withColumn("baskets", F.lit(n_baskets).cast("bigint"))
    lift = F.col("n_ab") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
    return whole.select("a", "b", "n_ab", "n_a", "n_b", "baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))
