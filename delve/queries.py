"""The engine's operators as queries over the test tables, and their SQL.

Keys: documents are ``docs/<source>/<lang>/<id>.txt``, events ``events/dt=<day>/<id>.json``, conversations
archives ``conv/<id>.zip`` with a member a turn.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.functions.grams import block_grams, block_trigram_hex, document_grams, is_prose, pack, pick_strategy, prose_ratios, trigram_blocks, trigram_hex
from delve.functions.patterns import compile_patterns
from delve.operators import lines as L
from delve.operators.candidates import block_ranges, candidate_blocks, expand_blocks, gram_counts, merge_ranges, slack_blocks
from delve.operators.index import diff_listing, duplicate_keys, newest_wins, should_repack
from delve.operators.render import binary_notices, json_events, standard_column
from delve.operators.scope import Scope, globs_admit, key_time_range, target_admits
from delve.plans.gramplan import plan, simplify
from delve.sources.corpus import decode_corpus, document_keys, scan_documents, table_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_DOCS = """docs AS (
  SELECT doc_id, source, 'docs/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS key, coalesce(text, '') AS text FROM documents)"""
_LINES = f"""{_DOCS},
parts AS (SELECT key, string_split(text, chr(10)) AS p FROM docs),
cut AS (SELECT key, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT key, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text FROM cut)"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select("doc_id", "source", document_keys(d).alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _plain(query_name: str, where: str, patterns: list[str], **flags) -> None:
    """A query of matching lines (key, line, text)."""
    program = compile_patterns(patterns, **flags)
    QUERIES[query_name] = lambda spark, sf: L.matching_lines(_docs(spark, sf), program)
    SQL[query_name] = f"WITH {_LINES} SELECT key, line, text FROM lines WHERE {where}"


# ---------------------------------------------------------------- scans and lines


@query("src11_files", f"WITH {_DOCS} SELECT key FROM docs")
def src11(spark, sf):
    return _docs(spark, sf).select("key").orderBy("key")


@query("src12_scan_lines", f"WITH {_LINES} SELECT key, line, text FROM lines")
def src12(spark, sf):
    d = _t(spark, sf, "documents")
    scanned = scan_documents(table_corpus(d, document_keys(d), d["text"]))
    return L.plain_lines(scanned.withColumn("text", F.col("bytes").cast("string")))


_plain("mat02_matching_lines", "regexp_matches(text, 'ion[a-z]{3} [a-z]+ed')", ["ion[a-z]{3} [a-z]+ed"])
_plain("pat01_fixed_string", "contains(text, 'the.')", ["the."], fixed=True)
_plain("pat02_ignore_case", "regexp_matches(text, '(?i)licensed|akia')", ["LicensEd", "aKia"], ignore_case=True)
_plain("pat03_smart_case", "regexp_matches(text, '(?i)license')", ["license"], smart_case=True)
_plain("pat04_word_regexp", r"regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}])the($|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}])')", ["the"], word=True)
_plain("pat05_line_anchor", "regexp_matches(text, '^The .*ed[.]$')", ["^The .*ed[.]$"])
_plain("pat06_no_line_feed", "regexp_matches(text, 'ing[^a-z]*$')", ["ing[^a-z]*$"])


@query("pat07_multi_pattern", f"WITH {_LINES} SELECT key, line, pattern FROM (SELECT key, line, 0 AS pattern, text FROM lines WHERE contains(text, 'Licensed') UNION ALL SELECT key, line, 1, text FROM lines WHERE regexp_matches(text, 'AKIA[A-Z]') UNION ALL SELECT key, line, 2, text FROM lines WHERE regexp_matches(text, '[0-9]{{6}}')) s")
def pat07(spark, sf):
    program = compile_patterns(["Licensed", "AKIA[A-Z]", "[0-9]{6}"])
    return L.pattern_ids(L.matching_lines(_docs(spark, sf), program), program).select("key", "line", "pattern")


_SPAN_SQL = f"""WITH {_LINES},
hit AS (SELECT key, line, regexp_extract_all(text, 'th[a-z]+|[0-9]+') AS m, regexp_split_to_array(text, 'th[a-z]+|[0-9]+') AS g FROM lines WHERE regexp_matches(text, 'th[a-z]+|[0-9]+')),
each AS (SELECT key, line, m, g, unnest(range(1, len(m) + 1)) AS k FROM hit),
pos AS (SELECT key, line, k, m, (list_sum(list_transform(g[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: strlen(x))), 0))::BIGINT AS s FROM each)
"""


@query("mat03_submatch_offsets", _SPAN_SQL + 'SELECT key, line, s AS start, (s + strlen(m[k]))::BIGINT AS "end" FROM pos')
def mat03(spark, sf):
    program = compile_patterns(["th[a-z]+", "[0-9]+"])
    found = L.matching_lines(_docs(spark, sf), program, spans=True)
    return found.select("key", "line", F.explode("submatches").alias("s")).select("key", "line", "s.start", "s.end")


@query("mat04_line_offsets", f'WITH {_LINES} SELECT key, line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lines')
def mat04(spark, sf):
    return L.explode_lines(_docs(spark, sf)).select("key", "line", "offset")


_CONTEXT = """WITH {lines}, hits AS (SELECT *, {hit} AS hit FROM lines),
capped AS (SELECT *, hit AND sum(hit::INT) OVER (PARTITION BY key ORDER BY line) <= {cap} AS c FROM hits),
near AS (SELECT *, max(c::INT) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS near FROM capped)
SELECT key, line, CASE WHEN c THEN 'match' ELSE 'context' END AS kind, text FROM near WHERE near = 1"""


@query("mat05_context", _CONTEXT.format(lines=_LINES, hit="contains(text, 'Licensed')", cap=1 << 40, after=2, before=1))
def mat05(spark, sf):
    program = compile_patterns(["Licensed"])
    docs = L.document_hits(_docs(spark, sf), program)
    return L.with_context(L.plain_lines(docs), F.col("text").rlike(program.java), 1, 2)


@query("mat06_max_count", _CONTEXT.format(lines=_LINES, hit="regexp_matches(text, '[0-9]')", cap=1, after=1, before=0))
def mat06(spark, sf):
    program = compile_patterns(["[0-9]"])
    docs = L.document_hits(_docs(spark, sf), program)
    return L.with_context(L.plain_lines(docs), F.col("text").rlike(program.java), 0, 1, max_count=1)


@query("mat07_files_with_matches", f"WITH {_DOCS} SELECT key FROM docs WHERE regexp_matches(text, '(secret|token|password)[^a-z]')")
def mat07(spark, sf):
    return L.document_hits(_docs(spark, sf), compile_patterns(["(secret|token|password)[^a-z]"])).select("key")


@query("mat08_count_lines", f"WITH {_LINES} SELECT key, count(*) AS n FROM lines WHERE contains(text, 'tion') GROUP BY key")
def mat08(spark, sf):
    return L.count_lines(_docs(spark, sf), compile_patterns(["tion"]))


@query("mat09_count_matches", f"WITH {_LINES} SELECT key, sum(len(regexp_extract_all(text, 'er[a-z]*')))::BIGINT AS n FROM lines WHERE regexp_matches(text, 'er[a-z]*') GROUP BY key")
def mat09(spark, sf):
    return L.count_matches(_docs(spark, sf), compile_patterns(["er[a-z]*"]))


@query("mat10_match_window", f"""WITH {_LINES},
hit AS (SELECT key, line, text, strlen(text)::BIGINT AS n, strlen(string_split(text, 'Licensed')[1])::BIGINT AS s FROM lines WHERE contains(text, 'Licensed')),
w AS (SELECT *, least(40, n)::BIGINT AS len, least(8, least(40, n))::BIGINT AS width FROM hit),
c AS (SELECT *, greatest(0, least(s - (len - width) // 2, n - len))::BIGINT AS a FROM w)
SELECT key, line, a AS clip_start, a + len AS clip_end, a > 0 AS clipped_left, a + len < n AS clipped_right, substr(hex(encode(text)), (2 * a + 1)::BIGINT, (2 * len)::BIGINT) AS excerpt FROM c""")
def mat10(spark, sf):
    found = L.matching_lines(_docs(spark, sf), compile_patterns(["Licensed"]), spans=True)
    return L.match_windows(found, 40).select("key", "line", "clip_start", "clip_end", "clipped_left", "clipped_right", F.hex("excerpt").alias("excerpt"))


@query("mat11_block_verify", f"WITH {_LINES} SELECT key, count(*) AS n FROM lines WHERE regexp_matches(text, 'secret|token') GROUP BY key")
def mat11(spark, sf):
    d = _t(spark, sf, "documents")
    program = compile_patterns(["secret", "token"])
    blocks = decode_corpus(table_corpus(d, document_keys(d), d["text"]), block=2048).where("display_key is not null")
    blocks = blocks.select(F.col("display_key").alias("key"), F.col("bytes").cast("string").alias("text"))
    return L.matching_lines(blocks, program).groupBy("key").agg(F.count("*").alias("n"))


@query("mat13_merge_events", f"WITH {_LINES} SELECT key, line, 'match' AS kind FROM lines WHERE contains(text, 'Licensed') OR contains(text, 'AKIA')")
def mat13(spark, sf):
    docs = _docs(spark, sf)
    parts = [L.matching_lines(docs, compile_patterns([p]), spans=True).withColumn("kind", F.lit("match")) for p in ("Licensed", "AKIA")]
    return L.merge_events(parts[0].unionByName(parts[1])).select("key", "line", "kind")


# ---------------------------------------------------------------- grams and candidates


def _postings(docs: DataFrame) -> DataFrame:
    return block_grams(docs.select("doc_id", F.lit(0).alias("block"), F.col("text").cast("binary").alias("bytes")))


def _candidates(docs: DataFrame, program, postings: DataFrame | None = None) -> DataFrame:
    return candidate_blocks(postings or _postings(docs), docs.select("doc_id", F.lit(0).alias("block")), plan(program))


def indexed_lines(docs: DataFrame, patterns: list[str], **flags) -> DataFrame:
    """Matching lines by way of grams: plan, candidates, join, verify."""
    program = compile_patterns(patterns, **flags)
    chosen = _candidates(docs, program)
    return L.matching_lines(docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"), program)


_BYTES = "SELECT item_id, hex(encode(coalesce(text, ''))) AS h FROM benchmark"


@query("idx01_trigrams", f"SELECT DISTINCT item_id, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT item_id, h, unnest(range(0, len(h) // 2 - 2)) AS i FROM ({_BYTES}))")
def idx01(spark, sf):
    b = _t(spark, sf, "benchmark")
    return b.select("item_id", F.explode(trigram_hex(F.coalesce("text", F.lit("")).cast("binary"))).alias("gram"))


@query("idx02_block_trigrams", f"SELECT DISTINCT item_id, (i // 64)::INT AS block, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT item_id, h, unnest(range(0, len(h) // 2 - 2)) AS i FROM ({_BYTES}))")
def idx02(spark, sf):
    b = _t(spark, sf, "benchmark")
    return b.select("item_id", F.explode(block_trigram_hex(F.coalesce("text", F.lit("")).cast("binary"), 64)).alias("x")).select("item_id", "x.block", "x.gram")


def _gram_hex() -> Column:
    return F.lpad(F.hex("gram"), 6, "0").alias("gram")


def _document_postings(spark, sf) -> DataFrame:
    """(gram, doc_id, block) of every document, in blocks of the production size."""
    return block_grams(trigram_blocks(_docs(spark, sf)))


@query("idx01_document_trigrams")
def idx01_documents(spark, sf):
    return _postings(_docs(spark, sf)).select("doc_id", _gram_hex())


@query("idx02_document_block_trigrams")
def idx02_documents(spark, sf):
    return _document_postings(spark, sf).select("doc_id", "block", _gram_hex())


@query("idx03_sparse_grams")
def idx03(spark, sf):
    return document_grams(_docs(spark, sf)).select("doc_id", F.hex("gram").alias("gram"))


_PROSE = r"""SELECT doc_id, n, sum_text, sum_signs, sum_digits FROM (SELECT doc_id, strlen(t)::BIGINT AS n,
 (strlen(t) - strlen(regexp_replace(t, '[A-Za-z \t\r\n]', '', 'g')))::BIGINT AS sum_text, (strlen(t) - strlen(regexp_replace(t, '[{}\[\]":,=<>();_/\\]', '', 'g')))::BIGINT AS sum_signs,
 (strlen(t) - strlen(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS sum_digits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query("idx07_prose_ratio", f"SELECT doc_id, CASE WHEN n < 256 THEN 'short' WHEN sum_text / n >= 0.85 AND sum_signs / n <= 0.04 AND sum_digits / n <= 0.03 THEN 'prose' ELSE 'other' END AS prose, n, sum_text, sum_signs, sum_digits FROM ({_PROSE})")
def idx07(spark, sf):
    n = prose_ratios(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.when(is_prose(F.col("text")), "prose").when(~is_prose(F.col("text")), "other").otherwise("short").alias("prose"), n["total"].alias("n"), n["text"].alias("sum_text"), n["signs"].alias("sum_signs"), n["digits"].alias("sum_digits"))


@query("idx08_strategy_pick", f"""WITH {_DOCS}, r AS (SELECT text, row_number() OVER (ORDER BY key) - 1 AS nth, greatest(1, count(*) OVER () // 16) AS stride FROM docs),
t AS (SELECT substr(text, 1, 262144) AS t FROM r WHERE nth % stride = 0 AND nth < 16 * stride),
n AS (SELECT strlen(t)::BIGINT AS n, (strlen(t) - strlen(regexp_replace(t, '[A-Za-z \\t\\r\\n]', '', 'g'))) AS a, (strlen(t) - strlen(regexp_replace(t, '[{{}}\\[\\]":,=<>();_/\\\\]', '', 'g'))) AS s, (strlen(t) - strlen(regexp_replace(t, '[0-9]', '', 'g'))) AS d FROM t),
p AS (SELECT n, a / n >= 0.85 AND s / n <= 0.04 AND d / n <= 0.03 AS prose FROM n WHERE n >= 256),
c AS (SELECT coalesce(sum(n) FILTER (WHERE prose), 0)::BIGINT AS prose_bytes, coalesce(sum(n), 0)::BIGINT AS sampled_bytes FROM p)
SELECT CASE WHEN sampled_bytes > 0 AND 3 * prose_bytes >= 2 * sampled_bytes THEN 'sparse' ELSE 'trigram' END AS strategy, prose_bytes, sampled_bytes FROM c""")
def idx08(spark, sf):
    return pick_strategy(_docs(spark, sf), "key", "text")


@query("idx09_planned_candidates", f"WITH {_LINES} SELECT key, line, text FROM lines WHERE regexp_matches(text, '(Licensed|token)[^a-z]+[0-9a-f]{{4}}')")
def idx09(spark, sf):
    return indexed_lines(_docs(spark, sf), ["(Licensed|token)[^a-z]+[0-9a-f]{4}"])


@query("idx10_gram_lookup", f"WITH {_DOCS} SELECT gram, (SELECT count(*) FROM docs WHERE contains(text, gram)) AS n FROM (VALUES ('Lic'), ('ice'), ('the')) v(gram)")
def idx10(spark, sf):
    grams = [b"Lic", b"ice", b"the"]
    names = F.create_map(*(x for g in grams for x in (F.lit(pack(g)).cast("long"), F.lit(g.decode()))))
    found = _postings(_docs(spark, sf)).where(F.col("gram").isin([pack(g) for g in grams]))
    return found.groupBy("gram").agg(F.count("*").alias("n")).select(names[F.col("gram")].alias("gram"), "n")


@query("idx11_simplified_plan", f"WITH {_DOCS} SELECT key FROM docs WHERE contains(text, 'Licensed') AND contains(text, 'the')")
def idx11(spark, sf):
    docs = _docs(spark, sf)
    postings = _postings(docs)
    programs = [compile_patterns([p]) for p in ("Licensed", "the")]
    queries = [plan(p)[0] for p in programs]
    counts = gram_counts(postings, set().union(*(q.grams() for q in queries)))
    done = [simplify(q, counts, docs.count()) for q in queries]
    for q, p in zip(done, programs, strict=True):
        chosen = candidate_blocks(postings, docs.select("doc_id", F.lit(0).alias("block")), [q])
        docs = L.document_hits(docs.join(chosen, "doc_id", "left_semi"), p)
    return docs.select("key")


def _grams_query(patterns: list[str], literal: str) -> Query:
    def run(spark, sf):
        docs = _docs(spark, sf)
        return _candidates(docs, compile_patterns(patterns)).select("doc_id").distinct()

    return run


QUERIES["idx13_posting_and"] = _grams_query(["toke"], "toke")
SQL["idx13_posting_and"] = f"WITH {_DOCS} SELECT doc_id FROM docs WHERE contains(text, 'tok') AND contains(text, 'oke')"
QUERIES["idx14_posting_or"] = _grams_query(["AKI|tok"], "")
SQL["idx14_posting_or"] = f"WITH {_DOCS} SELECT doc_id FROM docs WHERE contains(text, 'AKI') OR contains(text, 'tok')"


@query("idx21_many_patterns", f"WITH {_DOCS} SELECT doc_id, pattern FROM (SELECT doc_id, 0 AS pattern FROM docs WHERE contains(text, 'AKI') UNION ALL SELECT doc_id, 1 FROM docs WHERE contains(text, 'tok') AND contains(text, 'oke') UNION ALL SELECT doc_id, 2 FROM docs) s")
def idx21(spark, sf):
    docs = _docs(spark, sf)
    return _candidates(docs, compile_patterns(["AKI", "toke", ".*"])).select("doc_id", F.explode("patterns").alias("pattern"))


def _hit_offsets(docs: DataFrame, word: str) -> DataFrame:
    """The byte offset of every occurrence, non-overlapping, in documents (..., text)."""
    parts = F.split("text", re.escape(word), -1)
    lengths = F.transform(parts, lambda p: F.octet_length(p).cast("long"))
    step = lambda at, n: F.concat(at, F.array(F.coalesce(F.get(at, F.size(at) - 1) + len(word.encode()), F.lit(0).cast("long")) + n))
    offsets = F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), F.array().cast("array<long>"), step)
    return docs.where(F.contains("text", F.lit(word))).withColumn("offset", F.explode(offsets))


def _hit_blocks(spark, sf) -> DataFrame:
    """The blocks of all occurrences."""
    hits = _hit_offsets(_docs(spark, sf), "Licensed")
    last = F.floor((F.octet_length("text") - 1) / 1024).cast("int")
    return hits.select("doc_id", F.floor(F.col("offset") / 1024).cast("int").alias("block"), last.alias("last")).distinct()


_BLOCKS = "SELECT doc_id, strlen(string_split(text, 'Licensed')[1]) // 1024 AS b, (strlen(text) - 1) // 1024 AS l FROM documents WHERE contains(text, 'Licensed')"


@query("idx15_block_slack", f"SELECT DISTINCT doc_id, unnest(range(greatest(b - 1, 0), least(b + 1, l) + 1))::INT AS block FROM ({_BLOCKS})")
def idx15(spark, sf):
    return expand_blocks(_hit_blocks(spark, sf), slack_blocks(("bytes", 8), F.lit(0), 1024), F.col("last"))


@query("idx17_ranges", f'SELECT doc_id, greatest(b - 1, 0)::BIGINT AS start, (least(b + 1, l) + 1)::BIGINT AS "end" FROM ({_BLOCKS})')
def idx17(spark, sf):
    return block_ranges(expand_blocks(_hit_blocks(spark, sf), F.lit(1), F.col("last")))


@query("idx18_merge_ranges", f"""SELECT doc_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", max(x) AS extent FROM (
  SELECT doc_id, greatest(b - 1, 0) AS s, least(b + 1, l) + 1 AS e, 'bytes' AS x FROM ({_BLOCKS}) UNION ALL SELECT doc_id, b, b + 1, 'lines' FROM ({_BLOCKS})) GROUP BY doc_id""")
def idx18(spark, sf):
    hits = _hit_blocks(spark, sf)
    one = block_ranges(expand_blocks(hits, F.lit(1), F.col("last"))).withColumn("extent", F.lit("bytes"))
    two = block_ranges(hits.select("doc_id", "block")).withColumn("extent", F.lit("lines"))
    return merge_ranges(one.unionByName(two))


_ALL_GRAMS = f"SELECT DISTINCT item_id, substr(h, 2 * i + 1, 6) AS gram FROM (SELECT item_id, h, unnest(range(0, len(h) // 2 - 2)) AS i FROM ({_BYTES}))"


def _item_postings(spark, sf) -> DataFrame:
    b = _t(spark, sf, "benchmark")
    return block_grams(b.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("block"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes")))


@query("idx22_index_stats", f"SELECT count(DISTINCT gram) AS grams, count(*) AS postings FROM ({_ALL_GRAMS})")
def idx22(spark, sf):
    return _item_postings(spark, sf).agg(F.countDistinct("gram").alias("grams"), F.count("*").alias("postings"))


@query("upd09_postings_build", f"SELECT gram, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM ({_ALL_GRAMS}) GROUP BY gram")
def upd09(spark, sf):
    gram = F.lpad(F.hex("gram"), 6, "0")
    return _item_postings(spark, sf).groupBy(gram.alias("gram")).agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("ids"))


@query("idx22_document_stats")
def idx22_documents(spark, sf):
    return _document_postings(spark, sf).agg(F.countDistinct("gram").alias("grams"), F.count("*").alias("postings"))


@query("upd09_document_postings")
def upd09_documents(spark, sf):
    """The postings in the order a segment has them: a row a place, so a gram that most documents hold is no longer row."""
    return _document_postings(spark, sf).orderBy("gram", "doc_id", "block").select(_gram_hex(), "doc_id", "block")


# ---------------------------------------------------------------- scope


@query("flt01_key_prefix", f"WITH {_DOCS} SELECT key FROM docs WHERE starts_with(key, 'docs/src1/en/')")
def flt01(spark, sf):
    return _docs(spark, sf).where(Scope(key_prefix="docs/src1/en/").admits(F.col("key"))).select("key")


@query("flt02_target_admits", f"WITH {_DOCS} SELECT key FROM docs WHERE key = 'docs/src1' OR starts_with(key, 'docs/src1/') OR starts_with(key, 'docs/src1!/')")
def flt02(spark, sf):
    return _docs(spark, sf).where(target_admits(F.col("key"), "docs/src1")).select("key")


@query("flt04_key_regex", f"WITH {_DOCS} SELECT key FROM docs WHERE regexp_matches(key, '/(en|fr)/0+[0-9]*7[.]txt$')")
def flt04(spark, sf):
    return _docs(spark, sf).where(Scope(key_regex="/(en|fr)/0+[0-9]*7[.]txt$").admits(F.col("key"))).select("key")


@query("flt05_globs", f"WITH {_DOCS} SELECT key FROM docs WHERE CASE WHEN regexp_matches(key, '^docs/src1/en/[^/]*$') THEN true WHEN regexp_matches(key, '^docs/.*/en/.*$') THEN false WHEN regexp_matches(regexp_extract(key, '[^/]*$'), '^[^/]*5[.]txt$') THEN true ELSE false END")
def flt05(spark, sf):
    return _docs(spark, sf).where(globs_admit(F.col("key"), ["*5.txt", "!/docs/**/en/**", "docs/src1/en/*"])).select("key")


def _events(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select("event_id", F.concat(F.lit("events/dt="), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")).alias("key"), F.col("ts"))


@query("flt06_key_time", "SELECT event_id, strftime(date_trunc('day', ts) - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M') AS start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS \"end\" FROM events")
def flt06(spark, sf):
    t = key_time_range(F.col("key"))
    return _events(spark, sf).select("event_id", F.date_format(t["start"], "yyyy-MM-dd HH:mm").alias("start"), F.date_format(t["end"], "yyyy-MM-dd HH:mm").alias("end"))


_SHAPES = ("'events/dt=' || strftime(ts, '%Y-%m-%d') || '/x'", "'logs/' || strftime(ts, '%Y/%-m/%-d') || '/b.log'", "'lb/' || strftime(ts, '%Y%m%dT%H%MZ') || '_x.log'", "'y/year=' || strftime(ts, '%Y/month=%m/day=%d/hour=%H') || '/c'", "'d/' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '-z'")


@query("flt06_key_shapes", "SELECT event_id, key, strftime(low - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, strftime(high, '%Y-%m-%d %H:%M:%S') AS \"end\" FROM (SELECT event_id, CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_SHAPES)) + """ END AS key,
  CASE event_id % 5 WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('hour', ts) WHEN 4 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS low,
  CASE event_id % 5 WHEN 2 THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE WHEN 3 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 4 THEN date_trunc('second', ts) + INTERVAL 1 SECOND ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS high FROM events)""")
def flt06_shapes(spark, sf):
    """The times in keys of each known shape, from days to seconds."""
    ts = F.col("ts").cast("timestamp")
    part = lambda pattern: F.date_format(ts, pattern)
    shapes = [F.concat(F.lit("events/dt="), part("yyyy-MM-dd"), F.lit("/x")), F.concat(F.lit("logs/"), part("yyyy/M/d"), F.lit("/b.log")), F.concat(F.lit("lb/"), part("yyyyMMdd'T'HHmm'Z'"), F.lit("_x.log")), F.concat(F.lit("y/year="), part("yyyy'/month='MM'/day='dd'/hour='HH"), F.lit("/c")), F.concat(F.lit("d/"), part("yyyy-MM-dd-HH-mm-ss"), F.lit("-z"))]
    key = F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))
    t = key_time_range(F.col("key"))
    return _t(spark, sf, "events").select("event_id", key.alias("key")).select("event_id", "key", F.date_format(t["start"], "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(t["end"], "yyyy-MM-dd HH:mm:ss").alias("end"))


@query("flt07_time_scope", "SELECT count(*) AS n FROM events, (SELECT date_trunc('day', min(ts)) AS d FROM events) WHERE date_trunc('day', ts) + INTERVAL 1 DAY > d + INTERVAL 2 DAY AND date_trunc('day', ts) - INTERVAL 15 MINUTE < d + INTERVAL 5 DAY")
def flt07(spark, sf):
    events = _events(spark, sf)
    first = events.agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp"))).cast("double")).first()[0]
    at = lambda days: datetime.fromtimestamp(first + 86400 * days, timezone.utc)
    return events.where(Scope(since=at(2), until=at(5)).admits(F.col("key"))).agg(F.count("*").alias("n"))


@query("flt10_excluded", "SELECT count(*) AS excluded FROM documents WHERE doc_id % 7 = 3")
def flt10(spark, sf):
    d = _t(spark, sf, "documents").withColumn("lead", F.when(F.col("doc_id") % 7 == 3, F.lit(bytes.fromhex("1f8b08"))).otherwise(F.lit(b"")))
    corpus = table_corpus(d, document_keys(d), F.concat("lead", F.coalesce("text", F.lit("")).cast("binary")))
    return decode_corpus(corpus).where("display_key is null and failed").agg(F.count("*").alias("excluded"))


# ---------------------------------------------------------------- maintenance


@query("upd01_listing_diff", "SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'add' WHEN doc_id % 10 = 1 THEN 'remove' WHEN doc_id % 10 IN (2, 3) THEN 'replace' END AS action FROM documents WHERE doc_id % 10 < 4")
def upd01(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.sha2("text", 256).alias("version"))
    kind = F.col("doc_id") % 10
    live = d.where(kind != 0).select("key", F.when(kind == 2, "old").otherwise(F.col("version")).alias("version"), (kind == 3).alias("retry"))
    return diff_listing(d.where(kind != 1), live)


@query("upd02_newest_wins", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def upd02(spark, sf):
    return newest_wins(_t(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("upd05_repack_choice", """SELECT source, dead_docs > 0 AND (dead_docs >= 0.25 * docs OR dead_bytes >= 0.25 * bytes) AS repack FROM (
  SELECT source, count(*) AS docs, sum(n_chars) AS bytes, sum((l.doc_id IS NOT NULL)::INT) AS dead_docs, coalesce(sum(n_chars) FILTER (WHERE l.doc_id IS NOT NULL), 0) AS dead_bytes
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 OR toxic = 1) l ON d.doc_id = l.doc_id GROUP BY source)""")
def upd05(spark, sf):
    dead = _t(spark, sf, "labels").where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("gone")).distinct()
    d = _t(spark, sf, "documents").join(dead, F.col("doc_id") == F.col("gone"), "left")
    sums = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("bytes"), F.count("gone").alias("dead_docs"), F.coalesce(F.sum(F.when(F.col("gone").isNotNull(), F.col("n_chars"))), F.lit(0)).alias("dead_bytes"))
    return sums.select("source", should_repack(F.col("dead_docs"), F.col("docs"), F.col("dead_bytes"), F.col("bytes")).alias("repack"))


@query("upd15_duplicate_keys", "SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def upd15(spark, sf):
    return duplicate_keys(_t(spark, sf, "documents").select(F.md5("text").alias("key")))


@query("upd18_report", "SELECT sum((doc_id % 10 IN (0, 2, 3))::INT)::BIGINT AS added, sum((doc_id % 10 IN (1, 2, 3))::INT)::BIGINT AS removed FROM documents")
def upd18(spark, sf):
    n = upd01(spark, sf)
    return n.agg(F.count(F.when(F.col("action").isin("add", "replace"), 1)).alias("added"), F.count(F.when(F.col("action").isin("remove", "replace"), 1)).alias("removed"))


# ---------------------------------------------------------------- sinks and formats


@query("snk01_standard", f"WITH {_LINES} SELECT key || ':' || line || ':' || text AS value FROM lines WHERE contains(text, 'Licensed')")
def snk01(spark, sf):
    found = L.matching_lines(_docs(spark, sf), compile_patterns(["Licensed"])).withColumn("kind", F.lit("match"))
    return found.select(standard_column().alias("value"))


@query("snk03_binary_notice", f'WITH {_DOCS} SELECT key, strlen(string_split(text, \'Licensed\')[1])::BIGINT AS "offset" FROM docs WHERE contains(text, \'Licensed\')')
def snk03(spark, sf):
    docs = _docs(spark, sf).withColumn("text", F.replace("text", F.lit("Licensed"), F.lit("\0icensed")))
    found = L.matching_lines(docs, compile_patterns(["\\x00icensed"]), offsets=True)
    return binary_notices(found)


@query("snk05_counts", f"WITH {_LINES} SELECT key || ':' || count(*) AS value FROM lines WHERE contains(text, 'Licensed') GROUP BY key")
def snk05(spark, sf):
    return L.count_lines(_docs(spark, sf), compile_patterns(["Licensed"])).select(F.concat_ws(":", "key", F.col("n").cast("string")).alias("value"))


@query("snk07_json_lines", f"""WITH {_LINES}, o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM lines),
h AS (SELECT *, string_split(text, 'Licensed') AS p FROM o WHERE contains(text, 'Licensed')),
s AS (SELECT *, list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: strlen(x))) + 8 * (k - 1)) AS spots FROM h)
SELECT '{{{{"type":"match","data":{{{{"path":{{{{"text":' || CAST(to_json(key) AS VARCHAR) || '}}}},"lines":{{{{"text":' || CAST(to_json(text || chr(10)) AS VARCHAR) || '}}}},"line_number":' || line || ',"absolute_offset":' || place || ',"submatches":[' ||
  array_to_string(list_transform(spots, lambda x: '{{{{"start":' || x::BIGINT || ',"end":' || (x + 8)::BIGINT || '}}}}'), ',') || ']}}}}}}}}' AS message FROM s""".replace("{{", "{").replace("}}", "}"))
def snk07(spark, sf):
    found = L.matching_lines(_docs(spark, sf), compile_patterns(["Licensed"]), spans=True, offsets=True).withColumn("kind", F.lit("match"))
    return json_events(found).select("message")


@query("fmt11_rows_as_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def fmt11(spark, sf):
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            buffer = io.BytesIO()
            pq.write_table(pa.Table.from_batches([batch]), buffer)
            yield pa.RecordBatch.from_pydict({"key": [f"region/{part}-{k}.parquet"], "content": [buffer.getvalue()]})

    rows = _t(spark, sf, "region").select("r_regionkey", "r_name").mapInArrow(pack_rows, "key string, content binary")
    corpus = rows.select("key", F.sha2("content", 256).alias("version"), F.octet_length("content").cast("long").alias("encoded_size"), "content")
    return L.plain_lines(scan_documents(corpus).withColumn("text", F.col("bytes").cast("string"))).select(F.col("text").alias("line"))


def _packed(spark, sf, pack_one, table: str, key, columns: list[str]) -> DataFrame:
    made = F.pandas_udf(pack_one, "binary")
    d = _t(spark, sf, table)
    rows = d.select(key(d).alias("key"), made(*columns).alias("content"))
    corpus = rows.select("key", F.sha2("content", 256).alias("version"), F.octet_length("content").cast("long").alias("encoded_size"), "content")
    return scan_documents(corpus).select("key", F.octet_length("bytes").cast("long").alias("n"), F.sha2("bytes", 256).alias("sha"))


def _gzip_series(texts: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress((t or "")[: len(t or "") // 2].encode(), 1) + gzip.compress((t or "")[len(t or "") // 2 :].encode(), 1) for t in texts])


def _zip_series(turns: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for turn, role, text in zip(turns, roles, texts, strict=True):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{turn}-{role}.txt", text or "")
        out.append(buffer.getvalue())
    return pd.Series(out)


@query("fmt02_gzip", f"WITH {_DOCS} SELECT key, strlen(text)::BIGINT AS n, sha256(text) AS sha FROM docs")
def fmt02(spark, sf):
    return _packed(spark, sf, _gzip_series, "documents", document_keys, ["text"])


@query("fmt16_zip_members", "SELECT 'conv/' || conv_id || '.zip!/' || turn || '-' || role || '.txt' AS key, strlen(coalesce(text, ''))::BIGINT AS n, sha256(coalesce(text, '')) AS sha FROM conversations")
def fmt16(spark, sf):
    return _packed(spark, sf, _zip_series, "conversations", lambda d: F.concat(F.lit("conv/"), d["conv_id"].cast("string"), F.lit(".zip")), ["turn", "role", "text"])


@query("aux01_longest_line", f"WITH {_LINES} SELECT key, max(strlen(text))::BIGINT AS longest FROM lines GROUP BY key")
def aux01(spark, sf):
    d = _t(spark, sf, "documents")
    rows = decode_corpus(table_corpus(d, document_keys(d), d["text"])).where("display_key is not null and decoded_size > 0")
    return rows.groupBy(F.col("display_key").alias("key")).agg(F.max("max_line_len").alias("longest"))


@query("aux02_block_newlines", f"WITH {_DOCS} SELECT key, (strlen(text) - strlen(replace(text, chr(10), '')))::BIGINT AS newlines FROM docs")
def aux02(spark, sf):
    d = _t(spark, sf, "documents")
    rows = decode_corpus(table_corpus(d, document_keys(d), d["text"]), block=1024).where("display_key is not null")
    return rows.groupBy(F.col("display_key").alias("key")).agg(F.sum("newlines").alias("newlines"))


# ---------------------------------------------------------------- searches for benchmarking

#: The searches of the benchmark, over words that the test documents have.
SCENARIOS = {
    "short_literal": "thing",
    "long_literal": "Licensed under CC",
    "alternation": "Licensed|AKIA",
    "anchored": "^The ",
    "no_match": "UNMATCHABLE_TOKEN",
    "all": ".*",
    "gap": "Licensed.*CC",
}


def _scenario(name: str, pattern: str) -> None:
    program = compile_patterns([pattern])
    QUERIES[f"scan_{name}"] = lambda spark, sf: L.document_hits(_docs(spark, sf), program).select("key")
    where = "text <> ''" if name == "all" else f"EXISTS (SELECT 1 FROM lines l WHERE l.key = docs.key AND regexp_matches(l.text, '{pattern}'))"
    SQL[f"scan_{name}"] = f"WITH {_LINES} SELECT key FROM docs WHERE {where}"


for _name, _pattern in SCENARIOS.items():
    _scenario(_name, _pattern)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """An indexed search: a literal through grams to matching lines."""
    return indexed_lines(_docs(spark, sf), ["Licensed"])


QUERIES["idx_search_lines"] = flagship
SQL["idx_search_lines"] = f"WITH {_LINES} SELECT key, line, text FROM lines WHERE contains(text, 'Licensed')"
