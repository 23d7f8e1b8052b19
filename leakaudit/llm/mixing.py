"""Mixing sources to target weights: capped water-filling, DataFrame operations only.

Every source gets a share of the whole budget by weight. Sources that would be repeated
more than ``max_epochs`` times are clamped there and their excess is shared again among
the others by weight, until none is above. A source's target over its size is then its
number of epochs: every document is repeated the whole number of times, and a seeded
choice of documents once more for the fraction.

The seeded choice takes documents in the order of a hash until the fraction is used up
and then the one document nearest to what is still open. What a document gets follows from its
own hash and one small row per source, so texts are never shuffled. The rows that have to
be ordered are those of one hash range per source, of about ``BUCKET_ROWS`` rows.

Defined results: a null text has size 0; a null source is a source of its own, ranked
last; rows equal in id and text share one decision; sources without words get target 0;
an empty table gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.llm.common import fresh, materialise, n_words

BUCKET_ROWS = 2048
KEY_DIGITS = 32


def _key(key: str, text: str, seed: int) -> F.Column:
    own = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), own, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))


def _sources(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source: rows, size, weight, cap and target."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    facts = materialise(
        sized.groupBy("source")
        .agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        .withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("total") * max_epochs),
        "sources",
    )
    wide = lambda c: F.col(c).cast("decimal(25,0)").cast("decimal(38,0)")
    row = facts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("budget"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    budget, free, weight = row["budget"], row["budget"], row["weight"]
    while weight:
        # a source is clamped when its share of what is free would exceed its cap
        clamped = wide("weight") * F.lit(free).cast("decimal(20,0)") > wide("cap") * F.lit(weight).cast("decimal(12,0)")
        now = facts.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if (budget - now["used"], now["weight"]) == (free, weight):
            break
        free, weight = budget - now["used"], now["weight"]
    share = (F.col("weight") * F.lit(free)).cast("double") / F.lit(float(weight or 1))
    level = F.col("cap").cast("double")
    return facts.withColumn("target", F.least(level, share) if weight else level)


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source: whole epochs, the last hash of the fraction, one hash beyond it."""
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    digits = sum(F.when(F.col("n") > BUCKET_ROWS * 16**j, 1).otherwise(0) for j in range(12))
    facts = sources.withColumn("epochs", epochs).withColumn("open", F.col("target") - F.col("epochs") * F.col("total")).withColumn("digits", digits)
    keyed = sized.join(facts.select(F.col("source").alias("own"), "open", "digits"), F.col("source").eqNullSafe(F.col("own")))
    keyed = keyed.where("open > 0").withColumn("range", F.substring("key", F.lit(1), F.col("digits")))
    sums = keyed.groupBy("own", "open", "range").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("own").orderBy("range")) - F.col("size")
    cut = sums.withColumn("before", before).where("before <= open and open < before + size")
    cut = cut.select(F.col("own").alias("cut_of"), F.col("range").alias("cut"), (F.col("open") - F.col("before")).alias("left"))
    inside = keyed.join(cut, F.col("own").eqNullSafe(F.col("cut_of")) & (F.col("range") == F.col("cut")))
    same = inside.groupBy("own", "cut", "left", "key").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("own").orderBy("key"))
    fits = same.withColumn("upto", upto).withColumn("fits", F.col("upto") <= F.col("left"))
    last = Window.partitionBy("own")
    gap = F.col("left") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(last), F.lit(0))
    away = F.when(~F.col("fits") & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")), F.struct(F.abs(F.col("size") - F.col("gap")), "key"))
    chosen = fits.withColumn("gap", gap).groupBy("own", "cut").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("last"), F.min(away)["key"].alias("extra"))
    bound = chosen.select(F.col("own").alias("bound_of"), F.coalesce("last", "cut").alias("upto_key"), "extra")
    return facts.join(bound, F.col("source").eqNullSafe(F.col("bound_of")), "left").select(
        F.col("source").alias("mix_source"),
        F.col("total").alias("source_size"),
        "target",
        "epochs",
        F.coalesce("upto_key", F.lit("")).alias("upto_key"),
        F.coalesce("extra", F.lit("")).alias("extra"),
    )


def plan(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """The rows (source, size, key, ...) with their source's facts and ``times``, the
    number of repetitions."""
    cuts = materialise(_cuts(sized, _sources(sized, weights, max_epochs)), "cuts")
    more = (F.col("key") <= F.col("upto_key")) | (F.col("key") == F.col("extra"))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("times", (F.col("epochs") + more.cast("int")).cast("int"))


def sizes(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _key(key, text, seed).alias("key"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns unchanged."""
    sized = materialise(sizes(docs, key, text, source, seed), "sizes")
    cuts = materialise(_cuts(sized, _sources(sized, weights, max_epochs)), "cuts")
    row = fresh(docs.columns, "row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(source).alias("own"), _key(key, text, seed).alias("key"))
    more = (F.col("key") <= F.col("upto_key")) | (F.col("key") == F.col("extra"))
    times = (F.col("epochs") + more.cast("int")).cast("int")
    taken = whole.join(cuts, F.col("own").eqNullSafe(F.col("mix_source"))).withColumn("times", times).where("times > 0")
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col("times")))).select(f"{row}.*")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per document: id, size, source_size, target, times, and taken = size x times."""
    planned = plan(materialise(sizes(docs, key, text, source, seed), "sizes"), weights, max_epochs)
    return planned.select("id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
