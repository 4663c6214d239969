"""Regions of documents against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from delve.functions.patterns import compile_patterns
from delve.operators.regions import chunked_hits, coalesce_ranges, fetch_documents, line_of_offset, whole_lines
from delve.sources.corpus import decode_corpus, memory_corpus


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {}
    for k in range(25):
        lines = ["".join(rng.choices("ab é", k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(rng.randint(0, 30))]
        out[f"k{k}"] = "\n".join(lines) + rng.choice(["", "\n"])
    return {k: t for k, t in out.items() if t}


def blocks_of(spark, texts, size=64):
    rows = decode_corpus(memory_corpus(spark, {k: t.encode() for k, t in texts.items()}), block=size).where("display_key is not null")
    return rows.select(F.col("display_key").alias("key"), "first_line", "start", "newlines", "bytes")


def test_chunks_find_what_whole_texts_have(spark, texts):
    docs = spark.createDataFrame(list(texts.items()) + [("none", None), ("empty", "")], "key string, text string")
    for pattern in ("aé[ab ]b", "a{3}", "[^a]b{2}", "(?i)B A{1,2}B"):
        want = {k for k, t in texts.items() if any(re.search(pattern, line) for line in t.split("\n"))}
        for size in (1, 7, 1000):
            assert {r["key"] for r in chunked_hits(docs, compile_patterns([pattern]), size=size).collect()} == want
    for pattern in ("a.*b", "^a", r"a\b"):
        with pytest.raises(ValueError):
            chunked_hits(docs, compile_patterns([pattern]))


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 2), (50, 50)])
def test_ranges_grow_to_whole_lines(spark, texts, before, after):
    rng = random.Random(4)
    asked, want, spots = [], {}, {}
    for k, t in texts.items():
        raw = t.encode()
        ends = [0, *(m.end() for m in re.finditer(b"\n", raw))]
        if ends[-1] != len(raw):
            ends.append(len(raw))
        for _ in range(4):
            a = rng.randrange(len(raw))
            b = min(len(raw), a + rng.choice([0, 1, 10, 100]))
            low = max(j for j, e in enumerate(ends[:-1]) if e <= a)
            high = max(j for j, e in enumerate(ends[:-1]) if e <= max(b - 1, a))
            lo, hi = max(0, low - before), min(len(ends) - 2, high + after)
            asked.append((k, a, b))
            want[k, a, b] = (ends[lo], ends[hi + 1], lo + 1, hi + 1)
            spots[k, a] = low + 1
    ranges = spark.createDataFrame(asked, "key string, start long, end long")
    got = {(r["key"], r["start"], r["end"]): (r["from_byte"], r["to_byte"], r["from_line"], r["to_line"]) for r in whole_lines(blocks_of(spark, texts), ranges, before, after).collect()}
    assert got == want
    lines = line_of_offset(blocks_of(spark, texts), ranges.select("key", F.col("start").alias("offset")).distinct())
    assert {(r["key"], r["offset"]): r["line"] for r in lines.collect()} == spots


def test_ranges_that_are_read_together(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 1000), ("d", 10)], "doc_id string, size long")
    rows = [("a", 0, 10), ("a", 12, 20), ("a", 5, 8), ("a", 40, 50), ("b", 0, 30), ("b", 60, 90), *(("c", 100 * k, 100 * k + 1) for k in range(8))]
    ranges = spark.createDataFrame(rows, "doc_id string, start long, end long")
    got = sorted(tuple(r) for r in coalesce_ranges(ranges, sizes, gap=5, most=6).collect())
    assert got == [("a", 0, 20), ("a", 40, 50), ("b", 0, 100), ("c", 0, 1000)]
    assert coalesce_ranges(ranges.limit(0), sizes).count() == 0


def test_documents_are_fetched_by_object(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for k in range(4):
            z.writestr(f"m{k}", f"text {k}")
    corpus = memory_corpus(spark, {"a.zip": buffer.getvalue(), "b.txt": b"plain", "c.txt": b"other"})
    versions = {r["key"]: r["version"] for r in corpus.collect()}
    wanted = [("a.zip", versions["a.zip"], "a.zip!/m1"), ("a.zip", versions["a.zip"], "a.zip!/m3"), ("a.zip", versions["a.zip"], "a.zip!/m3"), ("b.txt", "an old version", "b.txt"), ("c.txt", versions["c.txt"], "c.txt")]
    got = {r["key"]: bytes(r["bytes"]) for r in fetch_documents(corpus, spark.createDataFrame(wanted, "source_key string, version string, key string")).collect()}
    assert got == {"a.zip!/m1": b"text 1", "a.zip!/m3": b"text 3", "c.txt": b"other"}
