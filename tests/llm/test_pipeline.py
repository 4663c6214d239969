"""The pipeline against a composition of brute-force stages."""

import collections
import re

import corpus_pipeline
from delve.llm.quality import keep_quality

from .test_documents import brute_hits, components


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "benchmark_passages", "mixture"]
    good = keep_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert good.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    first = {}
    for k, t, _ in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), k)
    rows = [r for r in rows if r[0] in set(first.values())]
    rows = [r for r in rows if components(rows)[r[0]][1] == r[0]] if len(rows) < 2 else (lambda c: [r for r in rows if c[r[0]][1] == r[0]])(components(rows))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits(rows, items)
    rows = [r for r in rows if not (hits[r[0]][1] > 0 and 20 * hits[r[0]][1] >= hits[r[0]][0])]
    result = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in result} == {r[0] for r in rows}
    taken = collections.Counter()
    for r in result:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) < 1 for r in result)
