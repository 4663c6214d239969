"""Candidates from postings (gram, doc_id, block): boolean gram queries, block neighbourhoods, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.functions.grams import BLOCK, pack
from delve.plans.gramplan import Query

from .index import Index

PLACE = ("doc_id", "block")


def any_of(column: Column, values: list, most: int = 10) -> Column:
    """``isin`` in parts that file statistics can prune by; Spark turns longer lists into one range."""
    parts = [column.isin(values[k : k + most]) for k in range(0, len(values), most)]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def most_places(query: Query, counts: dict[bytes, int], space: int) -> int:
    """The most places that a query can admit, from the counts of its grams."""
    if query.kind == "gram":
        return counts.get(query.gram, 0)
    if query.kind == "and":
        return min(most_places(p, counts, space) for p in query.parts)
    if query.kind == "or":
        return min(space, sum(most_places(p, counts, space) for p in query.parts))
    return space if query.kind == "all" else 0


def gram_counts(postings: DataFrame, grams: set[bytes]) -> dict[bytes, int]:
    """How many places each gram of a query has; as many rows as the query has grams."""
    codes = {pack(g): g for g in grams}
    if not codes:
        return {}
    rows = postings.where(any_of(F.col("gram"), sorted(codes))).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {codes[r["gram"]]: r["n"] for r in rows}


def stored_counts(index: Index, grams: set[bytes], prefix: str | None = None) -> dict[bytes, int]:
    """The same from the postings that segments keep."""
    codes = {pack(g): g for g in grams}
    return {codes[r["gram"]]: r["n"] for r in index.gram_counts(sorted(codes), prefix).collect()} if codes else {}


def holds(query: Query, grams: Column) -> Column:
    """Whether a set of gram codes satisfies the query."""
    if query.kind in ("all", "none"):
        return F.lit(query.kind == "all")
    if query.kind == "gram":
        return F.array_contains(grams, F.lit(pack(query.gram)).cast("long"))
    parts = [holds(p, grams) for p in query.parts]
    return reduce(lambda a, b: a & b if query.kind == "and" else a | b, parts)


def candidate_blocks(postings: DataFrame, places: DataFrame, queries: list[Query]) -> DataFrame:
    """(doc_id, block, patterns) for places that any query admits; the grams of all queries are read in one scan.

    ``places`` lists all live places, for queries that admit everything.
    """
    if any(q.kind == "all" for q in queries):
        own = [F.lit(k) for k, q in enumerate(queries) if q.kind == "all"]
        every = places.select(*PLACE, F.array(*own).alias("patterns"))
        rest = [(k, q) for k, q in enumerate(queries) if q.kind not in ("all", "none")]
        if not rest:
            return every
        found = _found(postings, rest)
        both = every.unionByName(found)
        return both.groupBy(*PLACE).agg(F.array_sort(F.flatten(F.collect_list("patterns"))).alias("patterns"))
    return _found(postings, [(k, q) for k, q in enumerate(queries) if q.kind != "none"])


def _found(postings: DataFrame, queries: list[tuple[int, Query]]) -> DataFrame:
    codes = sorted({pack(g) for _, q in queries for g in q.grams()})
    sets = postings.where(any_of(F.col("gram"), codes)).groupBy(*PLACE).agg(F.collect_set("gram").alias("grams"))
    which = F.array_compact(F.array(*(F.when(holds(q, F.col("grams")), F.lit(k)) for k, q in queries))) if queries else F.array().cast("array<int>")
    return sets.select(*PLACE, which.alias("patterns")).where(F.size("patterns") > 0)


def slack_blocks(extent: tuple[str, int | None], max_line_len: Column, size: int = BLOCK) -> Column:
    """Blocks on either side that a match through a block can reach; null for the whole document."""
    kind, span = extent
    if kind == "bytes":
        return F.lit(1 + (int(span) - 1) // size)
    if kind == "lines":
        return (1 + F.floor(max_line_len / size)).cast("int")
    return F.lit(None).cast("int")


def expand_blocks(blocks: DataFrame, slack: Column, last: Column) -> DataFrame:
    """Every block within ``slack`` of a block of (doc_id, block), clamped to the document; null slack is all of it."""
    low = F.when(slack.isNull(), F.lit(0)).otherwise(F.greatest(F.col("block") - slack, F.lit(0)))
    high = F.when(slack.isNull(), last).otherwise(F.least(F.col("block") + slack, last))
    return blocks.select("doc_id", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("block")).distinct()


def block_ranges(blocks: DataFrame) -> DataFrame:
    """Runs of adjacent blocks: (doc_id, start, end), the end exclusive."""
    order = Window.partitionBy("doc_id").orderBy("block")
    run = blocks.distinct().withColumn("run", F.col("block") - F.row_number().over(order))
    return run.groupBy("doc_id", "run").agg(F.min("block").cast("long").alias("start"), (F.max("block") + 1).cast("long").alias("end")).drop("run")


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Union of half-open ranges (key, start, end, extent): overlapping or touching ones join, the broader extent wins."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key).orderBy("start", "end")
    new = ranges.withColumn("reach", F.max("end").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int"))
    run = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("extent").alias("extent")).drop("run")
