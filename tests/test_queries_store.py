import json
import os
import random
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from delve.functions import grams
from delve.functions.grams import BLOCK, covering_grams, found_counts, found_postings, pack, sparse_codes, sparse_grams, stored_postings, trigrams_of
from delve.operators.index import update_index
from delve.queries_store import planted_corpus
from delve.sources.corpus import document_keys, table_corpus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("data", [b"", b"a", b"ab", b"abc", b"aaaaaaaa", bytes(range(256)) * 3, b"the quick brown fox jumps " * 20])
def test_sparse_codes_equal_the_packed_grams(data):
    assert sparse_codes(data).tolist() == sorted({pack(g) for g in sparse_grams(data)})


def test_sparse_codes_of_random_bytes():
    rng = random.Random(5)
    for n in (2, 3, 63, 64, 65, 1000):
        data = bytes(rng.choice(b"abcdef \n") for _ in range(n))
        assert sparse_codes(data).tolist() == sorted({pack(g) for g in sparse_grams(data)})


def test_planted_corpus(spark):
    rows = planted_corpus(spark, 12, 320).collect()
    assert [("needle" in r["text"].split("\n")[0]) for r in rows] == [k % 2 == 0 for k in range(12)]
    assert all(max(map(len, r["text"].split("\n"))) <= 80 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["fmt03_zstd", "fmt06_snappy", "fmt12_avro", "fmt15_orc", "fmt18_nested", "fmt21_limits", "mat17_line_of_offset", "e2e_search_sparse", "upd07_merged_segments", "pat09_plan_kinds"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


def test_gram_queries_cover_all_documents(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "naïve", "quick", "日本", "x", "brown\n", "\0\0", "a" * 70]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 4, 40, 400)] + [None, "", "a", "ab", "abc", "same text", "same text"]
    texts += [("0123456789abcdef" * 8192)[: BLOCK + n] for n in (0, 1, 2, 3)] + ["ab" * BLOCK + "zqx"]
    rows = list(enumerate(texts))
    spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    data = [(k, (t or "").encode()) for k, t in rows]
    hexed = lambda grams: [g.hex().upper() for g in grams]
    assert sorted(run("idx01_document_trigrams")) == sorted((k, g) for k, t in data for g in hexed(trigrams_of(t)))
    blocks = sorted({(k, i // BLOCK, t[i : i + 3].hex().upper()) for k, t in data for i in range(len(t) - 2)})
    assert sorted(run("idx02_document_block_trigrams")) == blocks and {b for _, b, _ in blocks} == {0, 1, 2}
    assert run("upd09_document_postings") == sorted((g, k, b) for k, b, g in blocks)
    assert run("idx22_document_stats") == [(len({g for *_, g in blocks}), len(blocks))]
    assert sorted(run("idx03_sparse_grams")) == sorted((k, g) for k, t in data for g in hexed(sparse_grams(t)))
    assert sorted(run("idx04_covering_grams")) == sorted((k, g) for k, t in data for g in hexed(covering_grams(t)))


def test_every_occurrence_counts(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Licensed", "none", None, "LicensedLicensed é Licensed\nx", "naïve\n" * 300 + "Licensed\n" + "日本 " * 2000 + "a Licensed b\n" + "z" * 1015 + "Licensed"]
    texts += ["".join(rng.choices(["word\n", "ö" * 40, "Licensed ", "x" * 700], [5, 5, 1, 3], k=60)) for _ in range(20)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    slack, ranges, merged, places = [], [], [], []
    for k, text in enumerate(texts):
        data = (text or "").encode()
        at = [m.start() for m in re.finditer(b"Licensed", data)]
        own = {a // 1024 for a in at}
        near = {b for a in own for b in (a - 1, a, a + 1) if 0 <= b <= (len(data) - 1) // 1024}
        slack += [(k, b) for b in near]
        runs = [(k, b, next(e for e in range(b + 1, b + 999) if e not in near)) for b in near if b - 1 not in near]
        ranges += runs
        merged += [(*r, "lines") for r in runs]  # the broader of the two extents, as every run has a hit
        places += [(f"docs/s/en/{k:08d}.txt", a, data[:a].count(b"\n") + 1) for a in at]
    assert run("idx15_block_slack") == sorted(slack)
    assert run("idx17_ranges") == sorted(ranges) and max(sum(r[0] == k for r in ranges) for k in range(len(texts))) > 1
    assert run("idx18_merge_ranges") == sorted(merged)
    assert run("mat17_line_of_offset") == sorted(places)


def test_rows_as_json_come_from_the_decoder(spark, tmp_path):
    rows = [(1, 'quote " and \\ é'), (2, None), (None, "x")]
    spark.createDataFrame(rows, "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    found = entry.queries()["fmt11_rows_as_json"](spark, str(tmp_path))
    assert sorted(r["line"] for r in found.collect()) == sorted(json.dumps({"r_regionkey": k, "r_name": n}, ensure_ascii=False, separators=(",", ":")) for k, n in rows)
    assert "Arrow" in found._jdf.queryExecution().toString()  # no SQL function makes the lines


@pytest.mark.parametrize("strategy", ["sparse", "trigram"])
def test_stored_postings_equal_brute_force(spark, monkeypatch, strategy):
    for name, value in (("RUN_BYTES", 4000), ("RUN_STEP", 1000), ("RUN_PLACES", 40)):
        monkeypatch.setattr(grams, name, value)
    rng = random.Random(10)
    words = ["the", "naïve", "quick", "日本", "x", "brown\n", "\0\0", "a" * 70, "e"]
    texts = [b"", b"a", b"ab", b"abc", b"same text", b"same text"] + [" ".join(rng.choices(words, k=rng.choice([1, 4, 40, 900]))).encode() for _ in range(120)]
    rows = [(k * (1 << 40) - (1 << 46), k % 3, bytearray(t)) for k, t in enumerate(texts)]
    stored = stored_postings(spark.createDataFrame(rows, "doc_id long, block int, bytes binary").repartition(3), strategy).localCheckpoint()
    of = sparse_grams if strategy == "sparse" else trigrams_of
    want = sorted({(pack(g), doc, block) for doc, block, t in rows for g in of(bytes(t))})
    codes = sorted({g for g, *_ in want})
    assert stored.where("low = -1").count() > 6 and sum(len(r["doc_ids"]) for r in stored.where("low = -1").collect()) == len(rows)
    for chosen in (codes, codes[::50], codes[:1], [5, 1 << 33], []):
        own = set(chosen)
        assert sorted(tuple(r) for r in found_postings(stored, chosen).collect()) == [w for w in want if w[0] in own]
        n = found_counts(stored, chosen).groupBy("gram").sum("n").collect()
        assert {r[0]: r[1] for r in n} == {c: sum(w[0] == c for w in want) for c in own & set(codes)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_sparse_index_is_small(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = d.selectExpr("sum(octet_length(text))").first()[0]
    report = update_index(spark, str(tmp_path / "index"), table_corpus(d, document_keys(d), d["text"]), strategy="sparse")
    assert report["total_docs"] == d.count()
    size = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*") if f.is_file())
    assert size < 3 * text, size / text
