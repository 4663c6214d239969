"""Indexed search equals the full scan, over encodings, patterns, details and the life of an index."""

import gzip
import json
import re
from datetime import datetime, timezone

import pytest
import regex
from pyspark.sql import functions as F

from delve import cli
from delve.functions.patterns import compile_patterns, find_iter, plain_texts, required_texts
from delve.operators.index import Index, IndexChanged, IndexConflict, IndexMismatch, load_manifest, pick_merge, update_index
from delve.operators.lines import with_context
from delve.operators.render import exit_code, json_lines, standard_lines
from delve.operators.scope import Scope, glob_regex, globs_admit, key_time_range, parse_instant
from delve.operators.search import list_files, search, search_collect, search_null, search_stats
from delve.sources.corpus import memory_corpus, scan_documents
from delve.streaming.watch import watch

OBJECTS = {
    "a/code.js": b"function handleClick() {}\n",
    "a/fox.txt": b"the quick brown fox\njumps over\n",
    "b/two.txt": b"hello world\nagain world world\nlast",
    "b/none.txt": b"nothing here\n",
    "mail.txt": b"bob@example.com and eve@example.org",
    "empty": b"",
    "utf16": "﻿wide world\n".encode("utf-16-le"),
    "z/log.gz": gzip.compress(b"zipped world\n" + b"x" * 300 + b"\nend\n"),
    "bad.gz": b"\x1f\x8b\x08broken",
}
PATTERNS = ["world", ".*", "ab", r"\w+@\w+", "quick.*fox", "(hello|again) w", "o{2,}", "(?:wor)?ld", "ABSENT", "^the", "last$", "fox$|^jumps", "WORLD", r"\Athe", r"fox\Z|end$", "(?i)WORLD", "(?i:hello) (?-i:World|world)", "a(?i)GAIN|JUMPS", r"\p{L}+\s\p{Ll}{5}$", "[[:alpha:]]+ [[:alpha:]]+$", r"\x{77}orld", "(?i)kick|quick", r"\<over", "[[:^lower:]]world"]


def scan(objects, pattern, **flags):
    """Matching lines by the standard library over decoded documents."""
    program = compile_patterns([pattern], **flags)
    out = set()
    for key, text in objects:
        lines = text.split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        for k, line in enumerate(lines, 1):
            if regex.search(program.python, line.decode()):
                out.add((key, k, line.decode(), tuple(find_iter(program, line))))
    return out


@pytest.fixture(scope="module", params=["trigram", "sparse"])
def index(spark, request, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("idx") / "i")
    corpus = memory_corpus(spark, OBJECTS)
    report = update_index(spark, root, corpus, "mem", request.param)
    assert report["added"] == len(OBJECTS) and report["total_docs"] == len(OBJECTS) - 1
    return Index(spark, root), [(r["key"], bytes(r["bytes"])) for r in scan_documents(corpus).collect()]


def test_index_equals_scan(index):
    reader, objects = index
    for pattern in PATTERNS:
        program = compile_patterns([pattern])
        rows = search(reader, program).collect()
        got = {(r["key"], r["line"], r["text"], tuple((s["start"], s["end"]) for s in r["submatches"])) for r in rows}
        assert got == scan(objects, pattern), pattern
    assert {r["key"] for r in search(reader, compile_patterns(["WORLD"], ignore_case=True), detail="documents").collect()} == {"b/two.txt", "utf16", "z/log.gz"}


def test_details(index):
    reader, _ = index
    world = compile_patterns(["world"])
    assert {(r["key"], r["n"]) for r in search(reader, world, detail="count_matches").collect()} == {("b/two.txt", 3), ("utf16", 1), ("z/log.gz", 1)}
    assert {(r["key"], r["n"]) for r in search(reader, world, detail="count_lines").collect()} == {("b/two.txt", 2), ("utf16", 1), ("z/log.gz", 1)}
    rows = search(reader, world, Scope("b/two.txt"), after=1, max_count=1).orderBy("line").collect()
    assert [(r["line"], r["kind"], r["offset"], len(r["submatches"])) for r in rows] == [(1, "match", 0, 1), (2, "context", 12, 2)]
    assert search(reader, world, max_count=0).count() == 0
    w = search(reader, world, Scope("b/two.txt"), detail="windows", window=7).orderBy("line").first()
    assert (bytes(w["excerpt"]), w["clipped_left"], w["clipped_right"]) == (b"o world", True, False)
    stats = search_stats(reader, world)
    assert stats["hits"] == 3 and stats["candidates"] >= 3 and stats["excluded"] == 1 and stats["exact"] == 1
    assert [r["key"] for r in list_files(reader, Scope("a")).collect()] == ["a/code.js", "a/fox.txt"]
    out = list(json_lines(search(reader, world).orderBy("key", "line").collect()))
    assert [json.loads(x)["type"] for x in out][:4] == ["begin", "match", "match", "end"] and json.loads(out[-1])["data"]["matched_lines"] == 4
    lines = list(standard_lines(search(reader, world, Scope("b/"), before=0, after=0).orderBy("key", "line").collect(), column=True))
    assert lines == ["b/two.txt:1:7:hello world", "b/two.txt:2:7:again world world"]
    assert (exit_code(True, False), exit_code(False, False), exit_code(True, True)) == (0, 1, 2)


def test_life_of_an_index(spark, tmp_path):
    root = str(tmp_path / "i")
    state = {f"k{n}": f"text {n} common\n".encode() for n in range(8)}

    def step(**more):
        report = update_index(spark, root, memory_corpus(spark, state), "src", "trigram", **more)
        got = {(r["key"], r["text"]) for r in search(Index(spark, root), compile_patterns(["text"])).collect()}
        assert got == {(k, v.decode().rstrip("\n")) for k, v in state.items() if b"text" in v}
        return report

    assert step()["added"] == 8
    assert step()["up_to_date"]
    state["k0"] = b"new text\n"
    assert (r := step())["added"] == 1 and r["removed"] == 1 and r["segments"] == 2
    old = Index(spark, root)
    del state["k1"], state["k2"]
    assert (r := step())["removed"] == 2 and r["compacted"]  # over a quarter of the first segment is dead
    assert old.changed()
    state["k1"] = b"text 1 common\n"
    step()
    state["k9"] = b"text 9\n"
    assert step(max_segments=2)["compacted"]
    assert step(purge=True)["total_docs"] == len(state)
    names = {p.name for p in (tmp_path / "i").iterdir()}
    assert Index(spark, root).manifest.dirs() <= names and not any(n.startswith("tmp-") for n in names)
    with pytest.raises(IndexMismatch):
        update_index(spark, root, memory_corpus(spark, state), "other")
    with pytest.raises(ValueError, match="twice"):
        update_index(spark, root, memory_corpus(spark, state).unionByName(memory_corpus(spark, {"k9": b"x"})), "src")
    manifest = load_manifest(Index(spark, root).store)
    assert not Index(spark, root).store.create(f"gen-{manifest.generation:09d}.json", "{}")
    assert IndexConflict.__mro__[1] is RuntimeError


def test_only_the_folders_of_candidates_are_read(spark, tmp_path, monkeypatch):
    from delve.operators import index as I
    from delve.operators import search as S

    monkeypatch.setattr(I, "BUCKET_BYTES", 1 << 12)
    texts = {f"k{n:03d}": f"{'rare word' if n == 77 else 'common'} number {n}\n".encode() + b"x" * 600 + b"\n" for n in range(200)}
    root = str(tmp_path / "i")
    update_index(spark, root, memory_corpus(spark, texts), "m", "trigram")
    reader, program = Index(spark, root), compile_patterns(["rare"])
    assert reader.table("content").select("bucket").distinct().count() > 20
    found = S.candidates(reader, program, Scope())
    files = found.blocks.inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 or "PartitionFilters" in found.blocks._jdf.queryExecution().executedPlan().toString()
    assert [r["key"] for r in search(reader, program).collect()] == ["k077"]
    for few, broadcast in ((0, 1 << 20), (0, 0)):  # candidates are broadcast; all content is verified
        monkeypatch.setattr(S, "FEW", few)
        monkeypatch.setattr(S, "SHARE", 2.0)
        monkeypatch.setattr(S, "BROADCAST_BYTES", broadcast)
        assert [r["key"] for r in search(reader, program).collect()] == ["k077"]
        assert search(reader, compile_patterns(["common number 1.$"]), detail="documents").count() == 10
        assert search_stats(reader, program)["candidates"] == 1


def test_an_addition_over_the_cap_becomes_several_segments(spark, tmp_path):
    state = {f"k{n:02d}": f"text {n}\n".encode() for n in range(20)}
    events = []
    report = update_index(spark, str(tmp_path / "i"), memory_corpus(spark, state), "m", "trigram", doc_cap=6, progress=events.append)
    assert report["segments"] >= 4 and report["total_docs"] == 20
    assert {r["key"] for r in search(Index(spark, str(tmp_path / "i")), compile_patterns(["text"])).collect()} == set(state)
    assert [e["event"] for e in events][:1] == ["listed"] and events[-1]["event"] == "published"
    import io
    import tarfile

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as t:
        for k in range(4):
            info = tarfile.TarInfo(f"m{k}")
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
    with pytest.raises(ValueError, match="more than 3 documents"):
        update_index(spark, str(tmp_path / "j"), memory_corpus(spark, {"a.tar": buffer.getvalue()}), "m", "trigram", doc_cap=3)
    assert [p.name for p in (tmp_path / "j").iterdir()] == []


def test_a_losing_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    update_index(spark, root, memory_corpus(spark, {"a": b"one\n", "b": b"two\n"}), "m", "trigram")
    reader = Index(spark, root)
    reader.check()
    before = {p.name for p in (tmp_path / "i").iterdir()}
    monkeypatch.setattr(type(reader.store), "create", lambda self, name, text: False)
    with pytest.raises(IndexConflict):
        update_index(spark, root, memory_corpus(spark, {"a": b"three\n"}), "m")
    assert {p.name for p in (tmp_path / "i").iterdir()} == before
    monkeypatch.undo()
    update_index(spark, root, memory_corpus(spark, {"a": b"three\n"}), "m")
    with pytest.raises(IndexChanged):
        reader.check()


def test_updates_by_listing_read_what_changed(spark, tmp_path, monkeypatch):
    from delve.sources import corpus as C

    folder = tmp_path / "d"
    folder.mkdir()
    for n in range(6):
        (folder / f"f{n}.txt").write_text(f"file {n}\n")
    asked = []

    def update():
        fetch = lambda wanted: asked.append(sorted(r["key"] for r in wanted.collect())) or C.read_objects(spark, str(folder), wanted)
        return update_index(spark, str(tmp_path / "i"), None, "m", "trigram", listing=C.list_objects(spark, str(folder)), fetch=fetch)

    assert update()["added"] == 6 and update()["up_to_date"] and len(asked) == 1
    (folder / "f3.txt").write_text("file three\n")
    (folder / "f5.txt").unlink()
    report = update()
    assert (report["added"], report["removed"]) == (1, 2) and asked[1:] == [["f3.txt"]]
    got = {(r["key"], r["text"]) for r in search(Index(spark, str(tmp_path / "i")), compile_patterns(["file"])).collect()}
    assert got == {("f0.txt", "file 0"), ("f1.txt", "file 1"), ("f2.txt", "file 2"), ("f3.txt", "file three"), ("f4.txt", "file 4")}
    listing = C.list_objects(spark, str(folder)).select("key", "version").where("key < 'f2'")
    rows = [tuple(r) for r in listing.collect()] + [("nope.txt", "1-1"), ("f2.txt", "an older version")]
    wanted = spark.createDataFrame(rows, "key string, version string")
    assert sorted(r["key"] for r in C.read_objects(spark, str(folder), wanted).collect()) == ["f0.txt", "f1.txt"]
    monkeypatch.setattr(C, "NAMED", 1)
    assert sorted(r["key"] for r in C.read_objects(spark, str(folder), wanted).collect()) == ["f0.txt", "f1.txt"]
    (tmp_path / "out").mkdir()
    (tmp_path / "out/secret.txt").write_text("x")
    (folder / "link.txt").symlink_to(folder / "f0.txt")
    (folder / "linked").symlink_to(tmp_path / "out")
    for keys in (C.list_objects(spark, str(folder)), C.list_objects(spark, f"file://{folder}"), C.read_corpus(spark, str(folder))):
        assert sorted(r["key"] for r in keys.select("key").collect()) == ["f0.txt", "f1.txt", "f2.txt", "f3.txt", "f4.txt"]


def test_a_search_starts_again_when_its_generation_goes_and_no_line_is_out():
    class Fake:
        def __init__(self, changed):
            self.manifest, self.changed = type("M", (), {"generation": 1}), lambda: changed

    def broken_at(at):
        def produce(index):
            for k in range(3):
                if k == at and index.changed():
                    raise OSError("a file is gone")
                yield str(k)

        return produce

    opened = iter([Fake(True), Fake(False)])
    assert list(cli.consistent(lambda: next(opened), broken_at(0))) == ["0", "1", "2"]
    with pytest.raises(IndexChanged):
        list(cli.consistent(lambda: Fake(True), broken_at(1)))
    with pytest.raises(IndexChanged):
        list(cli.consistent(lambda: Fake(True), broken_at(0)))


def test_sinks_and_shortcuts(index, spark):
    reader, objects = index
    rows, stats = search_collect(reader, compile_patterns(["world"]))
    assert len(rows) == 4 and stats["hits"] == 3 and search_null(reader, compile_patterns(["world"])) == 3
    hits = lambda p: {r["key"] for r in search(reader, compile_patterns([p]), detail="documents").collect()}
    for pattern in ("x*", "^$", "^", r"\bx*", "x*$", "(?i)", "quick|again|zipped", "q(ui|x)ck"):
        assert hits(pattern) == {k for k, _, _, _ in scan(objects, pattern)}, pattern
    assert plain_texts(compile_patterns(["a(b|c)d", "e"])) == ["abd", "acd", "e"] and plain_texts(compile_patterns(["a(?i)b"])) is None
    assert required_texts(compile_patterns(["ab.*cde?"])) == ["ab"] and required_texts(compile_patterns(["(?i)abc"])) is None


def test_an_index_of_nothing(spark, tmp_path):
    for name, objects in (("none", {}), ("broken", {"bad.gz": b"\x1f\x8b\x08broken"}), ("blank", {"empty": b""})):
        root = str(tmp_path / name)
        report = update_index(spark, root, memory_corpus(spark, objects) if objects else memory_corpus(spark, {"x": b""}).limit(0), "m")
        assert report["total_docs"] == (name == "blank")
        for pattern in ("world", ".*"):
            assert search(Index(spark, root), compile_patterns([pattern])).count() == 0
            assert search(Index(spark, root), compile_patterns([pattern]), detail="documents").count() == 0
        assert search_stats(Index(spark, root), compile_patterns(["world"]))["hits"] == 0


def test_lines_that_are_no_utf8(spark, tmp_path):
    texts = {"latin": b"caf\xe9 world\xff w\xf6rld world\n", "fine": "é world\n".encode(), "cut": b"\xe2\x82 world\n\xff"}
    root = str(tmp_path / "i")
    update_index(spark, root, memory_corpus(spark, texts), "m", "trigram")
    got = {r["key"]: [(s["start"], s["end"]) for s in r["submatches"]] for r in search(Index(spark, root), compile_patterns(["world"])).collect()}
    want = {k: [m.span() for m in re.finditer(b"world", t.split(b"\n")[0])] for k, t in texts.items()}
    assert got == want


def test_a_large_object_leaves_a_worker_in_parts(spark, monkeypatch):
    from delve.sources import corpus as C

    content = b"".join(b"line %d\n" % n * (n % 7) for n in range(20_000)) + b"x" * 300_000
    monkeypatch.setattr(C, "SENT", 1 << 16)
    rows = C.decode_corpus(memory_corpus(spark, {"big": content, "none": b""}), block=1 << 12).where("display_key is not null").orderBy("display_key", "block").collect()
    assert b"".join(bytes(r["bytes"]) for r in rows if r["display_key"] == "big") == content and rows[0]["max_line_len"] == 300_000
    assert [(r["decoded_size"], r["max_line_len"], bytes(r["bytes"])) for r in rows if r["display_key"] == "none"] == [(0, 0, b"")]
    assert [C.longest_line(x) for x in (b"", b"\n", b"ab", b"a\nbcd\n", b"\n\nxyz")] == [0, 0, 2, 3, 3]


def test_pick_merge():
    seg = lambda b: {"bytes": b, "docs": 1}
    assert pick_merge([seg(1)] * 3) is None
    assert pick_merge([seg(9), seg(1), seg(2), seg(9)], 3) == (1, 2)
    assert pick_merge([seg(200 << 20)] * 4, 3) is None


def test_scope(spark):
    keys = ["logs/dt=2024-03-05/a.log", "logs/2024/3/5/b.log", "lb/20240305T1015Z_x.log", "y/year=2024/month=03/day=05/hour=07/c", "d/2024-03-05-09-30-15-z", "dt=2024-03-05/20240305T1015Z", "nodate", "dt=2024-13-05/x"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["t"] for r in df.select("key", key_time_range(F.col("key")).alias("t")).collect()}
    show = {k: t and (t["start"].strftime("%d %H:%M"), t["end"].strftime("%d %H:%M:%S")) for k, t in got.items()}
    day = ("04 23:45", "06 00:00:00")
    assert show[keys[0]] == day and show[keys[1]] == day
    assert show[keys[2]] == ("05 10:00", "05 10:16:00") and show[keys[5]] == show[keys[2]]
    assert show[keys[3]] == ("05 06:45", "05 08:00:00") and show[keys[4]] == ("05 09:15", "05 09:30:16")
    assert show[keys[6]] is None and show[keys[7]] is None
    now = datetime(2024, 3, 6, tzinfo=timezone.utc)
    scope = Scope(since=parse_instant("2024-03-05 10:10", now), until=parse_instant("2024-03-05 10:20", now, True))
    assert {r["key"] for r in df.where(scope.admits(F.col("key"))).collect()} == {keys[0], keys[1], keys[2], keys[5], keys[6], keys[7]}
    assert scope.undated(df).first()[0] == 2
    assert parse_instant("2d", now).day == 4 and parse_instant("2024-03-05", now, True) == now
    for bad in ("soon", "2024-02-30"):
        with pytest.raises(ValueError):
            parse_instant(bad, now)
    with pytest.raises(ValueError):
        Scope(since=now, until=now)
    names = spark.createDataFrame([(k,) for k in ["a/x.log", "a/b/x.log", "x.txt", "a/y.log"]], "key string")
    pick = lambda *g: {r["key"] for r in names.where(globs_admit(F.col("key"), list(g))).collect()}
    assert pick("*.log") == {"a/x.log", "a/b/x.log", "a/y.log"}
    assert pick("*.log", "!/a/b/**") == {"a/x.log", "a/y.log"}
    assert pick("!x.*") == {"a/y.log"}
    assert pick("a/*.log") == {"a/x.log", "a/y.log"}
    assert re.match(glob_regex("{a,b}[!c]?"), "bdx")


def test_context_and_caps(spark):
    rows = [("k", n, "hit" if n in (2, 3, 9) else "-") for n in range(1, 11)]
    lines = spark.createDataFrame(rows, "key string, line long, text string")
    got = with_context(lines, F.col("text") == "hit", 1, 2, 1).orderBy("line").collect()
    assert [(r["line"], r["kind"]) for r in got] == [(1, "context"), (2, "match"), (3, "context"), (4, "context")]


def test_cli_and_watch(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("one\nerror here\nthree\n")
    (tmp_path / "logs/b.log").write_text("fine\n")
    run = lambda *argv: list(cli.run(spark, list(argv)))
    out = json.loads(run("index", str(tmp_path), "--strategy", "trigram")[0])
    assert out["added"] == 2
    assert run("search", "error", f"{tmp_path}/logs") == ["logs/a.log:2:error here"] and cli.run.code == 0
    assert run("search", "-C", "1", "error", str(tmp_path)) == ["logs/a.log-1-one", "logs/a.log:2:error here", "logs/a.log-3-three"]
    assert run("search", "--files", str(tmp_path)) == ["logs/a.log", "logs/b.log"]
    assert run("search", "-q", "nope", str(tmp_path)) == [] and cli.run.code == 1
    assert run("search", "(", str(tmp_path))[0].startswith("error: invalid pattern") and cli.run.code == 2
    places = str(tmp_path / "places.json")
    lines = run("--locations", places, "index", f"{tmp_path}/logs", "--index", f"{tmp_path}/elsewhere", "--strategy", "trigram", "--progress")
    assert [json.loads(x)["event"] for x in lines] == ["listed", "segment", "published", "indexed"]
    (tmp_path / ".delve").rename(tmp_path / "away")
    assert run("--locations", places, "search", "error", f"{tmp_path}/logs") == ["a.log:2:error here"]
    assert cli.recall(places, f"{tmp_path}/other") is None and cli.recalled(str(tmp_path / "none.json")) == {}
    calls = []

    def update(rebuild):
        calls.append(rebuild)
        if len(calls) == 2:
            raise OSError("gone")
        return {"added": 0}

    events = [json.loads(x)["event"] for x in watch(update, 0, rebuild=True, cycles=3)]
    assert events == ["indexed", "error", "indexed", "stopped"] and calls == [True, False, False]
