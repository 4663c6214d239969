"""Patterns: composition, checking, and what the planner needs to know of them. Driver-side only.

The dialect (see :mod:`.dialect`) has no lookaround, no backreferences and no possessive quantifiers; ``^`` and ``$`` hold
at every line, and a pattern never matches a line feed. Spark runs the patterns in Java's engine line by
line, with flags that make ``.``, ``$``, ``\\w`` and case behave so (``d``, ``U``, ``iu``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C  # the parse tree of the standard library's regular expressions
from re import _parser as P

import regex

from .dialect import DialectError, translate
from .witness import Witness, prove

_HALF = ("(?<!\\w)(?:", ")(?!\\w)")


class PatternError(ValueError):
    pass


def _translated(raw: str, number: int) -> tuple[str, str, str]:
    try:
        return translate(raw)
    except DialectError as e:
        raise PatternError(f'invalid pattern {number} "{raw}": {e}') from e


def _parse(raw: str, form: str, number: int, insensitive: bool = False) -> P.SubPattern:
    try:
        tree = P.parse(form, re.MULTILINE | (re.IGNORECASE if insensitive else 0))
    except (re.error, OverflowError, RecursionError) as e:
        raise PatternError(f'invalid pattern {number} "{raw}": {e}') from e
    _check(tree, raw, number)
    return tree


def _check(tree: P.SubPattern, raw: str, number: int) -> None:
    for op, arg in tree:
        if op in (C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS, C.ATOMIC_GROUP, C.POSSESSIVE_REPEAT):
            raise PatternError(f'invalid pattern {number} "{raw}": look-around, backreferences and possessive quantifiers are not supported')
        if op is C.LITERAL and arg == 10:
            raise PatternError(f'invalid pattern {number} "{raw}": a pattern cannot match a line feed')
        for sub in _children(op, arg):
            _check(sub, raw, number)


def _children(op, arg) -> list[P.SubPattern]:
    if op is C.SUBPATTERN:
        return [arg[3]]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return [arg[2]]
    if op is C.BRANCH:
        return list(arg[1])
    return []


def _literals(tree: P.SubPattern) -> list[str]:
    out = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(chr(arg))
        for sub in _children(op, arg):
            out += _literals(sub)
    return out


def escape(text: str) -> str:
    """The text as a pattern that matches just it (white space needs no escape)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def smart_case_insensitive(trees: list[P.SubPattern]) -> bool:
    """Insensitive if the patterns have a literal character and no upper-case one; classes do not count."""
    chars = [c for t in trees for c in _literals(t)]
    return bool(chars) and not any(c.isupper() for c in chars)


@dataclass(frozen=True)
class Program:
    """Compiled patterns: one joint Java regex, one for each pattern, and the parse trees."""

    raw: tuple[str, ...]
    trees: tuple[P.SubPattern, ...]
    insensitive: bool
    java: str
    java_each: tuple[str, ...]
    python: str
    word: bool = False

    @property
    def can_be_empty(self) -> bool:
        return any(t.getwidth()[0] == 0 for t in self.trees)

    @property
    def crosses_lines(self) -> bool:
        """Run on a whole text, the patterns could match a line feed; run line by line they can't."""
        return any(map(_crosses_lines, self.trees))

    @property
    def whole_document(self) -> bool:
        """Some pattern has an anchor of the whole text."""
        return any(_has_text_anchor(t) for t in self.trees)


def literal_runs(tree: P.SubPattern) -> list[str]:
    """Texts that every match holds: runs of literals on the pattern's top level."""
    runs = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            runs[-1] += chr(arg)
        else:
            runs.append("")
    return [r for r in runs if r]


def required_texts(program: Program) -> list[str] | None:
    """One text for each pattern, of which every match holds its own; none if some pattern has no such text."""
    if program.insensitive:
        return None
    longest = [max(literal_runs(t), key=len, default="") for t in program.trees]
    return longest if all(longest) else None


def _alternatives(tree: P.SubPattern, most: int = 64) -> list[str] | None:
    """All texts that the tree matches, if it has no class, repetition, anchor or change of case."""
    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            more = [chr(arg)]
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            more = [chr(value) for _, value in arg]
        elif op is C.SUBPATTERN and not arg[1] | arg[2]:
            more = _alternatives(arg[3], most)
        elif op is C.BRANCH:
            parts = [_alternatives(t, most) for t in arg[1]]
            more = None if None in parts else [x for p in parts for x in p]
        else:
            return None
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def plain_texts(program: Program) -> list[str] | None:
    """The patterns as a few texts, if they are nothing else."""
    if program.insensitive or program.word:
        return None
    parts = [_alternatives(t) for t in program.trees]
    texts = None if None in parts else [x for p in parts for x in p]
    return texts if texts and all(texts) else None


def _has_text_anchor(tree: P.SubPattern) -> bool:
    return any((op is C.AT and arg in (C.AT_BEGINNING_STRING, C.AT_END_STRING)) or any(map(_has_text_anchor, _children(op, arg))) for op, arg in tree)


def _crosses_lines(tree: P.SubPattern) -> bool:
    """A class of the pattern holds the line feed (only lines keep it from matching one)."""
    for op, arg in tree:
        if op is C.NOT_LITERAL or any(map(_crosses_lines, _children(op, arg))):
            return True
        if op is C.IN:
            for kind, value in arg:
                if kind is C.NEGATE or (kind is C.RANGE and value[0] <= 10 <= value[1]) or (kind is C.LITERAL and value == 10):
                    return True
                if kind is C.CATEGORY and value in (C.CATEGORY_SPACE, C.CATEGORY_NOT_DIGIT, C.CATEGORY_NOT_WORD):
                    return True
    return False


def compile_patterns(patterns: list[str], fixed: bool = False, word: bool = False, ignore_case: bool = False, smart_case: bool = False) -> Program:
    """Compose the patterns of a search. They match jointly: leftmost first, the earlier pattern on ties."""
    if not patterns:
        raise PatternError("no pattern")
    forms = [_translated(escape(p) if fixed else p, k) for k, p in enumerate(patterns)]
    trees = [_parse(p, f[2], k) for k, (p, f) in enumerate(zip(patterns, forms, strict=True))]
    insensitive = ignore_case or (smart_case and smart_case_insensitive(trees))
    if insensitive:
        trees = [_parse(p, f[2], k, True) for k, (p, f) in enumerate(zip(patterns, forms, strict=True))]
    java, python = ([f"{_HALF[0]}{f[k]}{_HALF[1]}" if word else f[k] for f in forms] for k in (0, 1))
    flags = "(?dUiu)" if insensitive else "(?dU)"
    joint = lambda parts: "|".join(f"(?:{p})" for p in parts)
    return Program(tuple(patterns), tuple(trees), insensitive, flags + joint(java), tuple(flags + p for p in java), ("(?im)" if insensitive else "(?m)") + joint(python), word)


#: Letters with a longer case partner, and what the longest takes in UTF-8.
_LONGER = {"k": 3, "s": 2, "i": 2}


def looks(tree: P.SubPattern) -> bool:
    """The pattern has an anchor or a boundary."""
    return any(op is C.AT or any(map(looks, _children(op, arg))) for op, arg in tree)


def _longest(tree: P.SubPattern, insensitive: bool) -> int | None:
    """Most bytes that a match of the tree can have, none if there is no bound."""
    total = 0
    for op, arg in tree:
        if op is C.LITERAL:
            c = chr(arg)
            size = max(len(x.encode("utf-8", "surrogatepass")) for x in ({c, c.lower(), c.upper(), c.swapcase()} if insensitive else {c}))
            size = max(size, _LONGER.get(c.lower(), 1)) if insensitive else size
        elif op is C.IN:
            negated = any(kind is C.NEGATE for kind, _ in arg)
            tops = [4 if negated or kind is C.CATEGORY else len(chr(value[1] if kind is C.RANGE else value).encode("utf-8", "surrogatepass")) for kind, value in arg if kind is not C.NEGATE]
            size = 4 if insensitive and max(tops) > 1 else 3 if insensitive else max(tops)
        elif op in (C.ANY, C.NOT_LITERAL, C.CATEGORY):
            size = 4
        elif op is C.SUBPATTERN:
            size = _longest(arg[3], (insensitive or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
        elif op is C.BRANCH:
            sizes = [_longest(t, insensitive) for t in arg[1]]
            size = None if None in sizes else max(sizes)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            once = _longest(arg[2], insensitive)
            size = 0 if once == 0 else None if once is None or arg[1] is C.MAXREPEAT else once * int(arg[1])
        else:
            size = None
        if size is None or (total := total + size) > 1 << 30:
            return None
    return total


def max_length(tree: P.SubPattern, insensitive: bool = False) -> int | None:
    """Longest match in bytes, where the pattern looks at nothing around it and the length is bounded and above 0."""
    return None if looks(tree) else _longest(tree, insensitive) or None


def search_extent(tree: P.SubPattern, insensitive: bool = False) -> tuple[str, int | None]:
    """What a match needs of its document: ("bytes", n), ("lines", None) or ("document", None).

    Matches never hold a line feed, so only an anchor of the whole text needs the document.
    """
    bound = max_length(tree, insensitive)
    return ("bytes", bound) if bound else ("document" if _has_text_anchor(tree) else "lines", None)


def witnesses(program: Program) -> list[Witness | None]:
    """For each pattern, the few bytes at an end of its matches that match by themselves, if that can be proved."""
    sure = [not program.word and not re.search(r"\\[pP]", raw) for raw in program.raw]  # the parser knows properties by approximation
    return [prove(t, program.insensitive) if ok else None for t, ok in zip(program.trees, sure, strict=True)]


def plan_kinds(program: Program) -> dict[str, int]:
    """How many patterns have an exact bound, how many fall back to lines or whole documents, and how many of these have a proven witness."""
    kinds = ["lines" if program.word and not _has_text_anchor(t) else search_extent(t, program.insensitive)[0] for t in program.trees]
    proven = sum(k != "bytes" and w is not None for k, w in zip(kinds, witnesses(program), strict=True))
    return {"exact": kinds.count("bytes"), "lines": kinds.count("lines"), "documents": kinds.count("document"), "proven": proven}


def find_iter(program: Program, text: bytes) -> list[tuple[int, int]]:
    return find_spans(program.python, text)


def find_spans(pattern: str, text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of all matches. An empty match that touches the match before it is skipped."""
    decoded = text.decode("utf-8", "surrogateescape")
    out: list[tuple[int, int]] = []
    last_char = last_byte = 0
    end_before = -1
    for m in regex.finditer(pattern, decoded):
        if m.start() == m.end() and m.start() == end_before:
            continue
        end_before = m.end()
        last_byte += len(decoded[last_char : m.start()].encode("utf-8", "surrogateescape"))
        last_char = m.start()
        width = len(m.group().encode("utf-8", "surrogateescape"))
        out.append((last_byte, last_byte + width))
    return out
