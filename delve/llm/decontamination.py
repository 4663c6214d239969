"""Benchmark decontamination by winnowing. DataFrame operations only.

The fingerprint of a window of WINDOW words is the minimum hash of its K-word grams; equal
windows have equal fingerprints, so every shared span of at least WINDOW words has windows whose
fingerprints join. Each joined window is then extended to all of its words and compared in
full, which leaves real occurrences only. Items of fewer words are one window each, whose
fingerprint is the hash of all of its words.

Documents are read once. Fingerprints are made, probed and dropped inside one generated loop per
document; only windows whose fingerprint the benchmark has leave it. The fingerprints and the
windows of the benchmark are broadcast when they are small (BROADCAST_BYTES, measured); beyond
that they join by shuffles, the documents' distinct fingerprints first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, temp_name, text_of

WINDOW, K = 13, 6
BROADCAST_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All but digits, letters and code points from 0x80.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def raw_words(text: Column) -> Column:
    """Words as they stand, letters in either case."""
    trimmed = F.regexp_replace(text, rf"^{_GAP}", "")
    parts = F.split(trimmed, _GAP)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _hashes(words: Column) -> Column:
    """A hash of each word, letters lowered."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.rlike("[A-Z]"), lower_ascii(w)).otherwise(w)))


def _gram(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def _fingerprint(hashes: Column, at: Column, length: int) -> Column:
    if length < WINDOW:
        return F.xxhash64(F.lit(length), _gram(hashes, at, length))
    return F.least(*(_gram(hashes, at + k, K) for k in range(WINDOW - K + 1)))


def _windows(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep..., words, at, len, fp) of every window of rows with ``words`` and ``hashes``; a row with at = -1 for each input row."""
    placed = rows.select(*keep, "words", "hashes", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    n = F.size("words")
    if len(lengths) == 1:
        length = F.lit(lengths[0])
        fits = (F.col("at") >= 0) & (F.col("at") + length <= n)
        made = placed.select(*keep, "words", "at", length.alias("len"), F.when(fits, _fingerprint(F.col("hashes"), F.col("at"), lengths[0])).alias("fp"))
    else:
        each = [F.struct(F.lit(m).alias("len"), F.when((F.col("at") >= 0) & (F.col("at") + m <= n), _fingerprint(F.col("hashes"), F.col("at"), m)).alias("fp")) for m in lengths]
        made = placed.select(*keep, "words", "at", F.explode(F.array(*each)).alias("x")).select(*keep, "words", "at", F.col("x.len").alias("len"), F.col("x.fp").alias("fp"))
        made = made.where((F.col("at") >= 0) | (F.col("len") == WINDOW))
    return made.where(F.col("fp").isNotNull() | (F.col("at") < 0))


def _content() -> Column:
    return lower_ascii(F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " "))


def _bytes(df: DataFrame, size: Column) -> int:
    return df.agg(F.sum(size)).first()[0] or 0


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, item_ids) for every row of ``docs``; ``key`` hashes the text.

    ``spans`` lists the occurrences (word position, words) of the benchmark's windows, n_hit
    counts the words inside any, ``item_ids`` the items whose windows occur, sorted as strings.

    - Null, empty and wordless texts have no words; so have such items, which never occur.
    - An item with a null id marks words, but is not listed. Repeated items count once.
    - Repeated rows each get a row, as do rows that share an id.
    - Other columns, whatever their names, are ignored; empty tables are allowed on both sides.
    """
    item_words = raw_words(text_of(benchmark[item_text_col]))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), item_words.alias("words")).where(F.size("words") > 0)
    items = items.withColumn("hashes", _hashes(F.col("words")))
    long = _windows(items.where(F.size("words") >= WINDOW), [WINDOW], ["item"])
    short = items.where(F.size("words") < WINDOW)
    found = long.where("at >= 0").select("item", "len", "fp", _content().alias("content"))
    lengths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())  # at most WINDOW - 1 values
    for m in lengths:
        one = short.where(F.size("words") == m).select("item", F.lit(m).alias("len"), _fingerprint(F.col("hashes"), F.lit(0), m).alias("fp"), lower_ascii(F.array_join("words", " ")).alias("content"))
        found = found.unionByName(one)
    windows = materialize(found.groupBy("len", "content").agg(F.min("fp").alias("fp"), F.array_sort(F.collect_set("item")).alias("items")))
    prints = windows.select(F.col("fp").alias("known")).distinct()
    lengths = [*lengths, WINDOW]

    text = text_of(docs[text_col])
    words = raw_words(text)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), words.alias("words"))
    rows = base.select("doc_id", "key", "words", _hashes(F.col("words")).alias("hashes"))
    keep = ["doc_id", "key"]
    if _bytes(prints, F.lit(16)) <= broadcast_bytes:
        made = _windows(rows, lengths, keep).join(F.broadcast(prints), F.col("fp") == F.col("known"), "left")
        candidates = made.where(F.col("known").isNotNull() | (F.col("at") < 0))
    else:
        some = _windows(rows, lengths, keep).where("at >= 0").select("doc_id", "key", "fp").distinct()
        hit = some.join(prints, F.col("fp") == F.col("known")).select(F.col("doc_id").alias("id_"), F.col("key").alias("key_")).distinct()
        near = rows.join(hit, rows["doc_id"].eqNullSafe(hit["id_"]) & (rows["key"] == hit["key_"]), "left_semi")
        made = _windows(near, lengths, keep).where("at >= 0").join(prints, F.col("fp") == F.col("known"))
        all_rows = rows.select(*keep, "words", F.lit(-1).alias("at"), F.lit(WINDOW).alias("len"))
        candidates = made.select(*keep, "words", "at", "len").unionByName(all_rows)
    picked = candidates.select(*keep, F.when(F.col("at") < 0, F.size("words")).alias("n"), "at", F.col("len"), F.when(F.col("at") >= 0, _content()).alias("content"))
    picked = materialize(picked)
    table = windows.select(F.col("len").alias("len_"), F.col("content").alias("content_"), "items")
    weight = _bytes(windows, F.octet_length("content") + 32 + 24 * F.size("items"))
    hint = F.broadcast if weight <= broadcast_bytes else lambda df: df
    true = picked.where("at >= 0").join(hint(table), (F.col("content") == F.col("content_")) & (F.col("len") == F.col("len_")))
    both = picked.where("at < 0").select(*keep, "n", F.lit(None).cast("struct<at:int,len:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    both = both.unionByName(true.select(*keep, F.lit(None).cast("int").alias("n"), F.struct("at", "len").alias("span"), "items"))
    spans = F.array_sort(F.collect_set("span")).alias("spans")
    grouped = both.groupBy(*keep).agg(F.max("n").alias("n"), F.count("n").alias("copies"), spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(acc: Column, span: Column) -> Column:
        end = span["at"] + span["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], span["at"]))).alias("total"))

    n_hit = F.aggregate("spans", zero, add, lambda acc: acc["total"])
    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*keep, F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", "item_ids")


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (a word in 20 or more is hit), columns as they are."""
    bad = benchmark_hits(docs, benchmark, id_col, text_col, **options).where(contaminated(F.col("n_hit"), F.col("n_words")))
    id_name, key_name = temp_name(docs, "bad_id"), temp_name(docs, "bad_key")
    bad = bad.select(F.col("doc_id").alias(id_name), F.col("key").alias(key_name)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(bad[id_name]) & (F.xxhash64(text_of(docs[text_col])) == bad[key_name])
    return docs.join(bad, same, "left_anti")
