"""Mixing sources to target weights. DataFrame operations only.

Rows get hash-random keys. Because the keys are uniform, buckets of equal key ranges are equal
shares of a source: (source, bucket) range-partitions each source by key, however hot it is,
without sampling. Sorted within their buckets, the rows take running sums of their sizes; the
buckets' totals take running sums over each source; both added are the prefix sums of the whole
source. A source's budget is cut exactly: it repeats whole epochs as often as they fit, then
takes rows by key until the budget is spent, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, text_of

#: Rows of a bucket: what one task sorts at once.
BUCKET_ROWS = 2_000
#: The table of sources is broadcast up to this many bytes.
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*+", "w")  # white space, then a letter a word
    return F.octet_length(F.regexp_replace(runs, r"^[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Targets of sources (source, weight, source_size): shares of the total by weight.

    No target exceeds ``cap`` times its source; what is above is shared again by weight among
    the others until none is above. That is the water level L with target = min(cap * size, L *
    weight): sources reach their cap in the order of cap * size / weight, so one ordered pass
    finds the level. One row a source: a mixture names each of its sources.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = sources.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        (F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("capped"),
        F.sum("weight").over(after).alias("open"),
    )
    # the first source, in that order, that the level does not fill; all before it are capped
    fits = (F.col("total") - F.col("capped")) * F.col("weight") <= F.lit(cap) * F.col("source_size") * F.col("open")
    level = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), (F.col("total") - F.col("capped")).alias("left"), F.col("open").alias("share")))).over(whole)
    step = step.withColumn("level", level)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.share").cast("double")
    return step.select("source", "rank", "weight", "source_size", F.least(share, (F.lit(cap) * F.col("source_size")).cast("double")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", cycle: int = 3, cap: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Size is the number of words. Sources in code point order, null last, weigh 1, 2, ...,
    ``cycle``, repeating, and share the total of all sizes (see :func:`source_targets`). ``taken``
    is how many words the mix takes of the row, epochs counted; a source's sum is its target
    rounded down, and no row gives over ``cap`` times its size.

    - Null texts have size 0 and give nothing; a null source is a source.
    - Keys hash the id, so reruns agree; rows with equal or null ids follow by size.
    - Repeated rows count as often as they occur; an empty table gives an empty result.
    - Other columns, whatever their names, are ignored.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    rows = materialize(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text_of(docs[text_col])).alias("size"), key.alias("key")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(cycle)) + 1).cast("long"))
    counts = ranked.select(F.col("rank").alias("at"), "rows")
    plan = source_targets(ranked.select("source", "rank", "weight", "source_size"), cap)
    plan = materialize(plan.join(counts, plan["rank"] == counts["at"]).select("source", "rank", "source_size", "target", F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets")))
    named = plan.select(F.col("source").alias("name"), "rank", "buckets")
    weight = plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    small = weight <= BROADCAST_BYTES  # beyond that the joins shuffle, and Spark splits hot sources
    hint = F.broadcast if small else lambda df: df
    spread = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("buckets")).cast("long")
    keyed = rows.join(hint(named), rows["source"].eqNullSafe(named["name"])).select("doc_id", "size", "key", "rank", spread.alias("bucket"))
    within = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("upto", F.sum("size").over(within))
    bases = keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(F.col("rank").alias("rank_"), F.col("bucket").alias("bucket_"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    placed = summed.join(bases, (summed["rank"] == bases["rank_"]) & (summed["bucket"] == bases["bucket_"]))
    goal = plan.select("source", F.col("rank").alias("of"), "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - full * F.col("source_size")
    start = F.col("base") + F.col("upto") - F.col("size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.join(hint(goal), F.col("rank") == F.col("of")).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
