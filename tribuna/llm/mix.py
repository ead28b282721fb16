"""A mix of sources at target shares, counted in tokens.

Capped water-filling: with a total in mind, every source wants ``weight * total``
tokens; a source that would need more than its maximum of repetitions is clamped
there and what it leaves is shared among the others in proportion to their
weights, until all fit. A source's repetitions are a whole part, used by all its
documents, and a fraction, taken by documents in a seeded random order until its
tokens are reached.

Sizes are checkpointed once, so texts are encoded once. Only sums over all sources
reach the driver, a few rounds of them. The
seeded order is a hash split into buckets: bucket sums say which bucket holds the
end of the fraction, and only that bucket is ordered, so a source with a third of
all documents is never sorted in one task.

Defined results: a document counts once however often its row comes; null and
empty texts have no tokens and follow the whole repetitions; a null source, and
one without a positive weight, has no target and is reported; repeated weight rows
keep the largest weight; a null or negative maximum allows none; empty tables give
an empty mix and a report of the other side; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribuna.llm.encode import FOLDER, encode
from tribuna.session import cut

BUCKETS = 4096
#: Sources up to which their table is broadcast.
FEW = 100_000


def sizes(df: DataFrame, key: str, text: str, source: str, folder: str = FOLDER) -> DataFrame:
    """(doc, fonte, tokens), each document once."""
    rows = df.select(F.col(key).alias("doc"), F.col(source).alias("fonte"), F.col(text).alias("text")).where("doc is not null")
    counted = encode(rows, "doc", "text", folder, lengths=True).groupBy(F.col("key").alias("doc")).agg(F.min("tokens").alias("tokens"))
    return rows.groupBy("doc").agg(F.min("fonte").alias("fonte")).join(counted, "doc").select("doc", "fonte", "tokens")


def level(sources: DataFrame, total: float) -> float:
    """The level of the water: sources (peso, limite) get ``peso * level`` or their limit, whichever is less, and together ``total``, or all their limits if that is not enough.

    Every round clamps the sources that reach their limit and shares what they leave among the others; only sums reach the driver, so the number of sources has no bound.
    """
    at, clamped = 0.0, -1
    while True:
        full = F.col("peso") * at >= F.col("limite")
        row = sources.agg(F.sum(F.when(full, F.col("limite"))).alias("used"), F.sum(F.when(~full, F.col("peso"))).alias("open"), F.count_if(full).alias("n")).first()
        if not row["open"] or row["n"] == clamped:
            return at
        at, clamped = max(0.0, total - (row["used"] or 0.0)) / row["open"], row["n"]


def mix(sized: DataFrame, targets: DataFrame, source: str, weight: str, most: str, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (doc, fonte, tokens, copias >= 1) and the report of all sources.

    ``total``: tokens wanted; by default those of all documents of targeted sources.
    """
    sized = cut(sized)
    want = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("fonte")).agg(F.max(F.struct(F.coalesce(weight, F.lit(0.0)).cast("double").alias("w"), F.greatest(F.coalesce(most, F.lit(0)), F.lit(0)).cast("bigint").alias("m"))).alias("x"))
    want = want.select("fonte", F.col("x.w").alias("peso"), F.col("x.m").alias("maximo"))
    have = sized.groupBy("fonte").agg(F.sum("tokens").alias("tem"), F.count("*").alias("documentos"))
    sources = cut(want.join(have, "fonte").where("peso > 0 and tem > 0").select("fonte", "peso", "tem", (F.col("tem") * F.col("maximo")).cast("double").alias("limite")))
    whole = sources.agg(F.sum("tem").alias("tem"), F.sum("peso").alias("peso"), F.count("*").alias("n")).first()
    # Without a total in mind: as much as there is of the targeted sources.
    total = float(whole["tem"] or 0) if total is None else float(total)
    at = level(sources, total)
    given = F.least(F.col("peso") * at, F.col("limite"))
    times = F.floor(given / F.col("tem"))
    short = (given >= F.col("limite")) & (given < F.col("peso") / (whole["peso"] or 1.0) * total)
    # One row a source: broadcast while there are few, joined by sorting beyond.
    small = F.broadcast if whole["n"] <= FEW else (lambda x: x)
    plan = cut(sources.select("fonte", times.cast("bigint").alias("inteiras"), (given - times * F.col("tem")).alias("resto"), short.alias("falta")))

    bucket = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(BUCKETS))
    docs = sized.join(small(plan.drop("falta")), "fonte").withColumn("bucket", bucket)
    sums = docs.groupBy("fonte", "bucket", "resto").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("fonte").orderBy("bucket"))
    edges = sums.withColumn("antes", upto - F.col("t")).select("fonte", "bucket", "antes", (upto <= F.col("resto")).alias("inside"), (upto > F.col("resto")) & (F.col("antes") < F.col("resto")))
    edges = edges.toDF("fonte", "bucket", "antes", "inside", "edge")
    docs = docs.join(edges, ["fonte", "bucket"])
    order = Window.partitionBy("fonte", "bucket").orderBy(F.xxhash64("doc", F.lit(seed + 1)), "doc").rowsBetween(Window.unboundedPreceding, -1)
    border = docs.where("edge").withColumn("ate", F.col("antes") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    # A document belongs to the fraction if its middle does.
    border = border.withColumn("mais", (F.col("ate") + F.col("tokens") / 2 <= F.col("resto")).cast("int"))
    rest = docs.where("not edge").withColumn("mais", F.col("inside").cast("int"))
    # An empty document adds nothing to a fraction and takes no part in it.
    more = F.when(F.col("tokens") > 0, F.col("mais")).otherwise(0)
    columns = ["doc", "fonte", "tokens", (F.col("inteiras") + more).cast("bigint").alias("copias")]
    mixed = border.select(*columns).unionByName(rest.select(*columns)).where("copias > 0")

    reached = mixed.groupBy("fonte").agg(F.sum(F.col("tokens") * F.col("copias")).alias("usados"))
    all_ = want.join(have, want.fonte.eqNullSafe(have.fonte), "full").select(F.coalesce(want.fonte, have.fonte).alias("fonte"), "peso", "maximo", F.coalesce("tem", F.lit(0)).alias("tem"), F.coalesce("documentos", F.lit(0)).alias("documentos"))
    report = all_.join(reached, "fonte", "left").join(plan.select("fonte", "falta"), "fonte", "left").withColumn("usados", F.coalesce("usados", F.lit(0)))
    # One row a source, so the total over all of them is a window of that size.
    report = report.withColumn("todos", F.sum("usados").over(Window.partitionBy(F.lit(0))))
    share = F.coalesce(F.col("usados") / F.nullif(F.col("todos"), F.lit(0)), F.lit(0.0))
    state = F.when(F.coalesce("peso", F.lit(0.0)) <= 0, "sem alvo").when(F.col("documentos") == 0, "sem documentos").when(F.coalesce("falta", F.lit(True)), "falta").otherwise("ok")
    report = report.select("fonte", "documentos", F.col("tem").alias("tokens_fonte"), F.coalesce("peso", F.lit(0.0)).alias("peso_alvo"), F.coalesce("maximo", F.lit(0)).alias("max_repeticoes"), F.col("usados").alias("tokens_mistura"), F.coalesce(F.col("usados") / F.nullif(F.col("tem"), F.lit(0)), F.lit(0.0)).alias("repeticoes"), share.alias("parte_real"), state.alias("estado"))
    return mixed, report
