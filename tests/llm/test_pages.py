"""Page operators: round trips, held-out accuracy, rules."""

import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from delve.llm import html_extraction as H
from delve.llm import warc as W
from delve.llm.url_filter import build_trie, judge_urls, lookup, split_rule


def test_warc_round_trip(spark, tmp_path):
    html = {1: "<p>a</p>", 2: "<p>é</p>", 3: "<p>a</p>", 4: None, 5: "", 9: "<p>a</p>", None: "<p>a</p>", 7: "x" * 5000}
    pages = spark.createDataFrame([(k, f"http://h/{k}\n", h, "e") for k, h in html.items()], "page_id long, url string, html string, last string").repartition(3)
    bundles, index = W.write_archives(pages, frame_bytes=700, bundle_bytes=300)
    rows = {r["page_id"]: r for r in W.read_archives(bundles).collect()}
    assert set(rows) == set(html)
    last = collections.defaultdict(list)
    for k, h in html.items():
        last[h or ""].append(k if k is not None else -1)
    for k, h in html.items():
        r, raw = rows[k], (h or "").encode()
        top = max(last[h or ""])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if k == top else ("revisit", top))
    data = {r["bundle"]: bytes(r["data"]) for r in bundles.collect()}
    for r in index.collect():
        record = W.read_record(data[r["bundle"]], r["frame"], r["offset"])
        assert (record["record_id"], record["page_id"]) == (r["record_id"], r["page_id"])
        if record["record_type"] == "response":
            assert record["payload"] == (html[r["page_id"]] or "").encode()
    names = W.export_bundles(bundles, str(tmp_path))
    assert len(names) == len(data) > 1
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(open(tmp_path / names[0], "rb"), read_across_frames=True) as f:
        assert f.read().startswith(b"WARC/1.1\r\n")  # any Zstandard reader can read a bundle
    with pytest.raises(ValueError):
        W.seek_table(data[names[0]][:-1])
    b, i = W.write_archives(pages, min_bytes=10**6)
    assert W.read_archives(b).where("record_type = 'revisit'").count() == 0 and i.count() == len(html)
    assert W.read_archives(W.write_archives(pages.limit(0))[0]).count() == 0
    twice = spark.createDataFrame([(9, "u", "same"), (9, "u", "same"), (3, "v", "same"), (3, None, "same"), (None, "w", "alone"), (None, "w", "alone")], "page_id long, url string, html string")
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in W.read_archives(W.write_archives(twice)[0]).collect())
    assert got == {(9, "response", None): 2, (3, "revisit", 9): 2, (None, "response", None): 2}


def test_extraction_accuracy():
    field = H.trained_field()
    right = total = 0
    for features, labels in H.labelled_pages(200, 4242):
        got = field.viterbi(features)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


#: Pages written by hand, unlike the composed ones; lines of main text start with "+ ", others with "- ", markup with nothing.
WRITTEN = (
    """<html><head><title>
- Ferry returns to the northern route | The Harbour Post
</title></head><body><div id="masthead"><a href="/">
- The Harbour Post
</a><div class="menu"><a href="/news">
- News
</a></div></div><main><article><header>
</header><h1>
+ Ferry returns to the northern route
</h1><p>
+ After eleven months in dry dock the ferry sailed again on Tuesday, carrying forty passengers and a van of bread.
</p><figure><img src="f.jpg"></figure><p>
+ The captain said the engine had never sounded better.
</p><ul><li>
+ First sailing: 06:10
</li><li>
+ Last sailing: 21:40
</li></ul></article></main><aside class="related"><h3>
- More stories
</h3><ul><li><a href="/a">
- Bridge closed for repairs
</a></li><li><a href="/b">
- Market moves indoors
</a></li></ul></aside><div class="cookie-notice">
- We use cookies to make this site work.
<button>
- Accept
</button></div><footer><p>
- Copyright The Harbour Post. All rights reserved.
</p></footer></body></html>""",
    """<!doctype html><body><nav class="breadcrumbs"><span><a href="/">
- Home
</a></span><p><a href="/recipes">
- Recipes
</a></p></nav><div class="post"><h2>
+ Lentil soup for cold evenings
</h2><p>
+ Rinse two cups of red lentils &amp; leave them to drain.
</p><blockquote>
+ My grandmother never measured anything.
</blockquote><pre>
+ 2 onions, 1 carrot
</pre><table><tr><td>
+ Time
</td><td>
+ 40 minutes
</td></tr></table></div><section id="comments"><h3>
- 2 comments
</h3><div class="comment"><p>
- Made this yesterday and it was wonderful, thank you so much for sharing it with us all.
</p></div><div class="comment"><p>
- Too salty for me.
</p></div><form action="/c"><label>
- Your name
</label><button>
- Send
</button></form></section></body>""",
    """<body><header><h1>
- Mountain Hut Association
</h1><nav><ul><li><a href="/huts">
- Huts
</a></li><li><a href="/join">
- Join us
</a></li></ul></nav></header><div class="advert"><p>
- Boots at half price, this week only!
</p></div><article class="entry"><h1>
+ Opening of the upper hut is delayed
</h1><p class="lead">
+ Snow on the pass was deeper than expected.
</p><h2>
+ What to expect
</h2><p>
+ The path is marked, but crampons are needed above the second lake until the end of the month.
</p><div class="newsletter"><p>
- Get our letter once a month.
</p></div><p>
+ Bookings already made remain valid.
</p></article><div class="sidebar"><h4>
- Weather
</h4><p>
- Sunny, 4 degrees
</p></div><footer>
- &copy; Mountain Hut Association
</footer></body>""",
)


def test_extraction_of_written_pages():
    field, counts = H.trained_field(), collections.Counter()
    for page in WRITTEN:
        lines = page.split("\n")
        blocks = H.leaf_blocks("".join(x[2:] if x[:2] in ("+ ", "- ") else x for x in lines))
        truth = [(H.html.unescape(x[2:]), int(x[0] == "+")) for x in lines if x[:2] in ("+ ", "- ")]
        assert [b[0] for b in blocks] == [t for t, _ in truth]
        for (_, want), got in zip(truth, field.viterbi(H.block_features(blocks)), strict=True):
            counts[want, got] += 1
    assert counts[1, 1] / (counts[1, 1] + counts[0, 1]) >= 0.95  # precision
    assert counts[1, 1] / (counts[1, 1] + counts[1, 0]) >= 0.95  # recall


def test_viterbi_and_marginals_against_enumeration():
    import itertools
    import math

    rng = random.Random(1)
    field = H.ChainField()
    field.weights = {f"f{k}": rng.uniform(-2, 2) for k in range(6)}
    field.moves = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    for n in range(1, 7):
        features = [tuple(rng.sample(list(field.weights), 2)) for _ in range(n)]
        scores = field.scores(features)
        value = lambda y, s=scores: sum(v for v, l in zip(s, y, strict=True) if l) + sum(field.moves[a][b] for a, b in zip(y, y[1:], strict=False))
        paths = list(itertools.product((0, 1), repeat=n))
        assert value(field.viterbi(features)) == pytest.approx(max(map(value, paths)))
        total = sum(math.exp(value(y)) for y in paths)
        ones, _ = field.marginals(features)
        for k in range(n):
            assert ones[k] == pytest.approx(sum(math.exp(value(y)) for y in paths if y[k]) / total)


def test_extraction_edges(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=1>Menu</a></nav><div class=cookie-notice>We use cookies</div><article><h1>Head &amp; more</h1><p>One\n  two<br>three<p>a < b &eacute;<script>x</p></script><aside class='related'><p>Other story</p></aside><p>Last one.</article><section id=comments><p>Nice!</p></section><footer>&copy; me</footer>"
    rows = [(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "<article><p>" + "word " * 20_000 + "</p>", "u"), (5, "<script>only()</script><!-- no -->", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(pages).collect()}
    assert got[1] == "Head & more\nOne two three\na < b é\nLast one."
    assert got[2] == got[3] == got[5] == ""
    assert got[4] == " ".join(["word"] * 20_000)
    assert H.extract_main_text(pages.limit(0)).count() == 0


RULES = [split_rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def brute(url):
    _, mark, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if mark else ""
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("size", [1 << 20, 60, 0])
def test_urls(spark, size):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x#y", "http://example.org", "http://example.org/en/2", "http://example.org/es", "http://example.org/es/", "https://x.com/de/1", "http://com/fr/", "http://xcom/de/", "ftp://h?q/de/", "http://b.org#f", "http://notexample.org/es/1", "a://b://c/de/", "http://É.com/de/", "http://a.com/de/" + "x/" * 50_000, "http://b.org#f"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, HOST string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES, trie_bytes=size).collect()}
    assert got == {k: brute(u) for k, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, [], default="block").collect()} == {"block"}
    trie = build_trie([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/x/long")])
    assert lookup(trie, "a.b", "/x/long")[0] == "block" and lookup(trie, "c.b", "/x/longer") == ("allow", "b/x/long") and lookup(trie, "c.b", "/y") is None
    assert pages.select(F.count("*")).first()[0] == len(urls)
