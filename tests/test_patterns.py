import random
import re

import pytest
import regex

import __spark_entry__ as entry
from delve.functions.grams import covering_grams, pack, sparse_grams, trigrams_of
from delve.functions.patterns import PatternError, compile_patterns, find_iter, plan_kinds, search_extent, witnesses
from delve.functions.witness import find_witness
from delve.plans.gramplan import ALL, NONE, plan, simplify


def spans(pattern, text, **flags):
    return find_iter(compile_patterns([pattern] if isinstance(pattern, str) else pattern, **flags), text)


def test_empty_matches_skip_the_end_of_the_last_match():
    assert spans("a|", b"xa") == [(0, 0), (1, 2)]
    assert spans("", "é".encode()) == [(0, 0), (2, 2)]


def test_patterns_match_jointly_leftmost_then_first():
    assert spans(["ab", "abc", "c"], b"abcc") == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("bad", ["(", "a(?=b)", r"(a)\1", "a\nb", "a++"])
def test_bad_patterns_are_named(bad):
    with pytest.raises(PatternError, match="invalid pattern 1"):
        compile_patterns(["fine", bad])


def test_smart_case():
    assert compile_patterns(["abc"], smart_case=True).insensitive
    assert not compile_patterns(["abc", "D"], smart_case=True).insensitive
    assert not compile_patterns(["[ab]"], smart_case=True).insensitive
    assert compile_patterns(["A"], ignore_case=True).insensitive


def test_extents():
    tree = lambda p: compile_patterns([p]).trees[0]
    assert search_extent(tree("abc")) == ("bytes", 3)
    assert search_extent(tree("a.*")) == ("lines", None)
    assert search_extent(tree(r"\Aab")) == ("document", None)
    assert search_extent(tree(r"^ab")) == search_extent(tree(r"\bab")) == ("lines", None)
    assert [search_extent(tree(p))[1] for p in ("é{2}|x", r"\p{L}b", "[a-z]?", "a.", "(?i)ok", "[[:alpha:]]{3}")] == [4, 5, 1, 5, 4, 3]
    assert compile_patterns(["abc"], word=True).word and plan_kinds(compile_patterns(["abc"], word=True))["lines"] == 1


def test_dialect():
    hit = lambda p, t, **f: bool(regex.search(compile_patterns([p], **f).python, t))
    assert hit(r"^\p{L}+$", "éa") and not hit(r"^\pL+$", "a1") and hit(r"\P{L}", "1") and hit(r"\p{Lowercase_Letter}", "a")
    assert hit(r"^\x{41}\u{e9}\x41$", "AéA") and hit(r"[[:digit:]]+", "12") and not hit("[[:digit:]]", "٣:]") and hit("[[:^alpha:]]", "٣")
    assert hit("a(?i)b|c", "C") and not hit("a(?i)b|c", "AB") and hit("((?i)a)b", "Ab") and not hit("((?i)a)b", "aB") and not hit("(?-i:A)b", "aB", ignore_case=True)
    assert hit("(?x) a b # note", "ab") and hit(r"\b{start}ab\b{end-half}", "x ab.") and not hit(r"\<ab", "xab") and hit(r"]a}", "]a}") and hit("(?P<n>a)(?<m>b)", "ab")
    assert not hit("(?-m)^b", "a\nb") and hit("^b", "a\nb")


@pytest.mark.parametrize("bad", ["[a&&b]", "[a[b]]", "[a--b]", "(?U)a", "(?R)a", "(?-u)a", r"\Qa", r"\p{Nope}", "[[:foo:]]", r"\x{110000}", r"\b{middle}", "[a", "a)", "\\", r"\p{L"])
def test_what_engines_read_differently_is_refused(bad):
    with pytest.raises(PatternError, match="invalid pattern 0"):
        compile_patterns([bad])


def test_plans_know_the_flags_of_groups():
    assert plan(compile_patterns(["(?i)urge"]))[0].grams() >= {b"urg", b"URG", b"Urg"} and plan(compile_patterns(["(?i)urge"]))[0].kind == "and"
    assert plan(compile_patterns(["abc(?i:urg)xyz"]))[0].grams() >= {b"abc", b"xyz", b"uRg"}
    assert plan(compile_patterns(["(?-i:abc)"], ignore_case=True))[0].grams() == {b"abc"}
    assert plan(compile_patterns(["(?i)licensed"], ), "sparse")[0] == ALL


def test_plans_are_necessary_conditions():
    q = plan(compile_patterns(["hello"]))[0]
    assert q.grams() == {b"hel", b"ell", b"llo"} and q.kind == "and"
    assert plan(compile_patterns([".*"]))[0] == ALL
    assert plan(compile_patterns(["abc|x"]))[0] == ALL
    assert plan(compile_patterns(["abc|xyz"]))[0].kind == "or"
    assert plan(compile_patterns(["(abc)?d"]))[0] == ALL
    assert plan(compile_patterns(["(?:abc)+"]))[0].grams() == {b"abc"}
    assert plan(compile_patterns(["ab(cd)e"]))[0].grams() == {b"abc", b"bcd", b"cde"}


def test_simplify_uses_counts():
    q = plan(compile_patterns(["hello"]))[0]
    assert simplify(q, {b"hel": 3, b"ell": 0, b"llo": 2}, 10) == NONE
    assert simplify(q, {b"hel": 10, b"ell": 10, b"llo": 10}, 10) == ALL
    assert simplify(q, {b"hel": 5, b"ell": 1, b"llo": 10}, 10).gram == b"ell"
    assert simplify(q, {b"hel": 5, b"ell": 2, b"llo": 3}, 10, keep=1).gram == b"ell"


def test_grams():
    assert trigrams_of(b"ab") == [] and trigrams_of(b"abab") == [b"aba", b"bab"]
    assert pack(b"abc") == 0x616263 and pack(b"ab") >> 40 == 1
    text = b"the quick brown fox jumps over the lazy dog, then naps" * 2
    for a in range(0, 60, 7):
        for b in range(a + 2, a + 40, 5):
            assert set(covering_grams(text[a:b])) <= set(sparse_grams(text))


def test_word_regexp_keeps_every_matching_line(spark, tmp_path):
    lines = ["the plain", "tab\tthe\tend", "é the ß", "über-the-top", "«the»", "theé", "éthe", "the_", "7the", "the٣", "the\u0301", "日the本", "other", "“the”…", "THE", "a theme, the end"]
    rows = [(k, "\n".join(lines[k:] + ["x"] * k), "en", "s") for k in range(3)] + [(9, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["key"], r["line"], r["text"]) for r in entry.queries()["pat04_word_regexp"](spark, str(tmp_path)).collect())
    word = re.compile(r"(?<![\w\u0301])the(?![\w\u0301])")  # marks are word characters to the engine, not to Python
    want = sorted((f"docs/s/en/{d:08d}.txt", n, x) for d, t, *_ in rows for n, x in enumerate((t or "").split("\n"), 1) if word.search(x))
    assert got == want and {x for *_, x in got} == {lines[k] for k in (0, 1, 2, 3, 4, 13, 15)}


def test_witnesses():
    found = lambda p, **f: witnesses(compile_patterns([p], **f))[0]
    assert [(w and (w.bytes, w.forward)) for w in map(found, ["foo.*", ".*token", "foo.*bar", "(?i)k.*", "[a-c]*z", r"\p{L}a.*", "^a.*", "x*"])] == [(3, True), (5, False), None, (3, True), (1, False), None, None, None]
    assert found("ab.*", word=True) is None and plan_kinds(compile_patterns(["abc", "foo.*", "a.*b"])) == {"exact": 1, "lines": 2, "documents": 0, "proven": 1}
    assert find_witness(found("é+.*"), "ééx") == (0, 2) and find_witness(found(".*é"), "aé") == (1, 3) and find_witness(None, "é") == (0, 2)
    rng = random.Random(1)

    def pattern(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return rng.choice("ab.c")
        if kind < 0.6:
            return pattern(depth - 1) + pattern(depth - 1)
        return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})" if kind < 0.75 else f"(?:{pattern(depth - 1)}){rng.choice(['*', '+', '?', '{1,2}'])}"

    seen = 0
    for _ in range(300):
        p = pattern(3)
        witness = found(p)
        for _ in range(20):
            text = "".join(rng.choices("abcd", k=rng.randint(0, 8)))
            if witness and re.fullmatch(p, text):
                a, b = find_witness(witness, text)
                assert re.fullmatch(p, text[a:b]) and b - a <= witness.bytes and (a == 0 or b == len(text))
                seen += 1
    assert seen > 200
