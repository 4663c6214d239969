"""Exact deduplication by skew-safe combining. DataFrame operations only.

1. *Locally.* The salt of a row is the number of the task that read it, modulo SALTS; the
   partial aggregate by (digest, text, salt) leaves one winner for each text of a task.
2. *Salted groups.* The winners merge by (digest, text, salt): a text that a third of all rows
   hold meets in SALTS reducers, each with one row from every SALTS-th task.
3. *Globally.* The at most SALTS winners of a text merge by (digest, text).

Every stage groups by the whole text beside its digest. Rows then look up their group by digest
in a join whose hot keys Spark splits; a digest that several texts share (none with SHA-256) is
looked up by the text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, temp_name, text_of

SALTS = 32


def normalized(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _groups(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, text, keep_id, group_size) of each distinct text of docs (doc_id, text)."""
    rows = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    salted = rows.groupBy("digest", "text", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.repartition("digest")  # at most SALTS rows a text; no row is worth combining before it is sent
    return winners.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 of each row's group of equal texts.

    Texts are equal when identical after :func:`normalized`. The row with the smallest id stays.

    - Null counts as empty; all empty texts are one group.
    - Null ids lose against any other; a group of only null ids keeps its rows, keep_id null.
    - Repeated rows (same id and text) each get a row and share the decision.
    - An empty table gives an empty result. Columns of ``docs`` stay as they are; should it have
      columns named like the new ones (in any case), the new ones replace them.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = {c: temp_name(docs, f"{c}_new") for c in ("digest", "text", "keep", "size")}
    text = normalized(text_of(docs[text_col]))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    groups = _groups(base, digest)
    # how many texts share the digest; the window needs no shuffle, and a digest has a row for each of its texts
    from pyspark.sql import Window

    groups = groups.withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
    table = materialize(groups.select("digest", "keep_id", "group_size", "texts", F.when(F.col("texts") > 1, F.col("text")).alias("text")))
    found = table.select(*(F.col(c).alias(names[n]) for c, n in (("digest", "digest"), ("keep_id", "keep"), ("group_size", "size"), ("text", "text"))))
    key = temp_name(docs, "digest_key")
    keyed = docs.withColumn(key, digest(text))
    if table.where("texts > 1").isEmpty():
        joined = keyed.join(found.drop(names["text"]), keyed[key] == found[names["digest"]])
    else:
        joined = keyed.join(found, (keyed[key] == found[names["digest"]]) & (found[names["text"]].isNull() | (found[names["text"]] == text)))
    stays = [c for c in docs.columns if c.lower() not in added]
    sha = joined[key] if digest is sha256_hex else F.sha2(normalized(text_of(joined[text_col])), 256)
    return joined.select(
        *(joined[c] for c in stays),
        joined[names["keep"]].alias("keep_id"),
        joined[names["size"]].cast("long").alias("group_size"),
        joined[id_col].cast("long").eqNullSafe(joined[names["keep"]]).alias("kept"),
        sha.alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``; repeated rows leave one."""
    marked = exact_groups(docs, id_col, text_col).where("kept")
    columns = [c for c in docs.columns]
    single = marked.where("group_size = 1").select(columns)
    return single.unionByName(marked.where("group_size > 1").dropDuplicates(["text_sha256"]).select(columns))
