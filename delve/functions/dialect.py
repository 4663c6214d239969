"""The pattern dialect, rewritten for the two engines that run it and for the parser that plans it. Driver-side only.

Beyond what the engines share, the dialect has ``\\p{..}``, ``\\x{..}`` and ``\\u{..}``, ASCII classes such as
``[[:digit:]]``, flags that hold to the end of their group (``(?i)``, ``(?-i)``) or for a group (``(?i:..)``),
verbose patterns (``x``) and half word boundaries. Refused, as the engines would read them
differently: nested classes and set operations, byte patterns, the flags ``U`` and ``R``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex

_TOP = 0x10FFFF
#: ASCII classes as ranges of code points.
ASCII_CLASSES = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)),
    "cntrl": ((0, 31), (127, 127)), "digit": ((48, 57),), "graph": ((33, 126),), "lower": ((97, 122),), "print": ((32, 126),),
    "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ((9, 13), (32, 32)), "upper": ((65, 90),), "word": ((48, 57), (65, 90), (95, 95), (97, 122)),
    "xdigit": ((48, 57), (65, 70), (97, 102)),
}
#: General categories by their long names.
CATEGORIES = {
    "letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo", "mark": "M",
    "nonspacing_mark": "Mn", "spacing_mark": "Mc", "enclosing_mark": "Me", "number": "N", "decimal_number": "Nd", "letter_number": "Nl", "other_number": "No",
    "punctuation": "P", "connector_punctuation": "Pc", "dash_punctuation": "Pd", "open_punctuation": "Ps", "close_punctuation": "Pe", "initial_punctuation": "Pi",
    "final_punctuation": "Pf", "other_punctuation": "Po", "symbol": "S", "math_symbol": "Sm", "currency_symbol": "Sc", "modifier_symbol": "Sk", "other_symbol": "So",
    "separator": "Z", "space_separator": "Zs", "line_separator": "Zl", "paragraph_separator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "private_use": "Co",
}
_SHORT = {v.lower(): v for v in CATEGORIES.values()}
#: Word boundaries with a side: for Java, for Python.
_SIDES = {"start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}


class DialectError(ValueError):
    pass


@dataclass
class Translated:
    """One pattern for Java, for Python's ``regex``, and as the standard library parses it (classes of names are approximate there)."""

    java: list[str] = field(default_factory=list)
    python: list[str] = field(default_factory=list)
    parse: list[str] = field(default_factory=list)

    def add(self, java: str, python: str | None = None, parse: str | None = None) -> None:
        python = java if python is None else python
        self.java.append(java)
        self.python.append(python)
        self.parse.append(python if parse is None else parse)

    def strings(self) -> tuple[str, str, str]:
        return "".join(self.java), "".join(self.python), "".join(self.parse)


def _code(c: int) -> tuple[str, str]:
    """A code point for Java and for Python, escaped."""
    return f"\\x{{{c:X}}}", f"\\U{c:08X}" if c > 255 else f"\\x{c:02x}"


def _ranges(ranges) -> tuple[str, str]:
    parts = [[_code(a)] if a == b else [_code(a), _code(b)] for a, b in ranges]
    return tuple("".join("-".join(x[k] for x in part) for part in parts) for k in (0, 1))


def _outside(ranges) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in ranges:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, _TOP)]


def _property(raw: str, at: int) -> tuple[int, str, str, str]:
    r"""``\p{..}`` at ``at``: (end, Java, Python, the parser's approximation)."""
    negated = raw[at + 1] == "P"
    if raw[at + 2 : at + 3] == "{":
        end = raw.find("}", at) + 1
        name = raw[at + 3 : end - 1]
        if not end:
            raise DialectError("a property has no end")
    else:
        end, name = at + 3, raw[at + 2 : at + 3]
    if name.startswith("^"):
        negated, name = not negated, name[1:]
    kind, _, value = name.rpartition("=") if "=" in name else ("", "", name)
    flat = value.strip().lower().replace(" ", "_").replace("-", "_")
    category = CATEGORIES.get(flat) or _SHORT.get(flat)
    if category and kind.lower() in ("", "gc", "general_category"):
        java = python = category
    elif kind.lower() in ("sc", "script"):
        java, python = f"IsScript={value}".replace("IsScript", "script"), f"Script={value}"
    elif not kind and flat == "any":
        java, python = "", ""
    elif not kind:
        java, python = f"Is{value}", value
    else:
        raise DialectError(f"unknown property {name!r}")
    if not java:
        return (end, r"\x{0}-\x{10FFFF}", "\\x00-\\U0010FFFF", "\\x00-\\U0010FFFF") if not negated else _fail("an empty class")
    sign = "P" if negated else "p"
    try:
        regex.compile(f"\\{sign}{{{python}}}")
    except regex.error as e:
        raise DialectError(f"unknown property {name!r}") from e
    return end, f"\\{sign}{{{java}}}", f"\\{sign}{{{python}}}", r"\W" if negated else r"\w"


def _fail(what: str):
    raise DialectError(f"{what} is not supported")


def _escape(raw: str, at: int, inside: bool) -> tuple[int, str, str, str]:
    """An escape at ``at``: (end, Java, Python, parser)."""
    c = raw[at + 1 : at + 2]
    if not c:
        raise DialectError("a pattern ends in a backslash")
    if c in "pP":
        end, java, python, parse = _property(raw, at)
        return (end, java, python, parse) if inside or not java.startswith("\\x") else (end, f"[{java}]", f"[{python}]", f"[{parse}]")
    if c in "xuU":
        if raw[at + 2 : at + 3] == "{":
            end = raw.find("}", at) + 1
            digits = raw[at + 3 : end - 1]
        else:
            end = at + 2 + {"x": 2, "u": 4, "U": 8}[c]
            digits = raw[at + 2 : end]
        if not end or not re.fullmatch("[0-9A-Fa-f]{1,8}", digits) or int(digits, 16) > _TOP or (raw[at + 2 : at + 3] != "{" and len(digits) < end - at - 2):
            raise DialectError(f"bad code point {raw[at : max(end, at + 2)]!r}")
        java, python = _code(int(digits, 16))
        return end, java, python, python
    if c == "v":
        return at + 2, r"\x0B", r"\x0b", r"\x0b"
    if c in "zZ" and not inside:
        return at + 2, r"\z", r"\Z", r"\Z"
    if c == "b" and not inside and raw[at + 2 : at + 3] == "{":
        end = raw.find("}", at) + 1
        side = _SIDES.get(raw[at + 3 : end - 1])
        return (end, side, side, r"\b") if side else _fail(f"the boundary {raw[at:end]!r}")
    if c in "<>" and not inside:
        side = _SIDES["start" if c == "<" else "end"]
        return at + 2, side, side, r"\b"
    if c.isalpha() and c not in "afnrtdDsSwWAbB":
        _fail(f"the escape \\{c}")
    if not c.isalnum() and c != "_":
        return at + 2, f"\\{c}" if ord(c) < 128 else c, re.escape(c), re.escape(c)
    return at + 2, f"\\{c}", f"\\{c}", f"\\{c}"


def _class(raw: str, at: int, out: Translated, verbose: bool) -> int:
    """A bracketed class that starts at ``at``; returns its end."""
    java, python, parse = ["["], ["["], ["["]

    def add(j: str, p: str | None = None, q: str | None = None) -> None:
        java.append(j)
        python.append(j if p is None else p)
        parse.append(python[-1] if q is None else q)

    at += 1
    if raw[at : at + 1] == "^":
        add("^")
        at += 1
    first = True
    while True:
        c = raw[at : at + 1]
        if not c:
            raise DialectError("unclosed character class")
        if c == "]" and not first:
            break
        if raw.startswith("[:", at) and (end := raw.find(":]", at)) >= 0:
            name = raw[at + 2 : end]
            ranges = ASCII_CLASSES.get(name.removeprefix("^"))
            if ranges is None:
                raise DialectError(f"unknown class [:{name}:]")
            add(*_ranges(_outside(ranges) if name.startswith("^") else ranges))
            at = end + 2
        elif c == "[":
            _fail("a class in a class")
        elif raw[at : at + 2] in ("&&", "--", "~~") and not (first and c == "-"):
            _fail("a set operation")
        elif c == "\\":
            at, j, p, q = _escape(raw, at, True)
            add(j, p, q)
        elif verbose and c.isspace():
            at += 1
            continue
        else:
            add(f"\\{c}" if c in "]&~^[" or (c == "-" and (first or raw[at + 1 : at + 2] == "]")) else c)
            at += 1
        first = False
    for parts in (java, python, parse):
        parts.append("]")
    out.add("".join(java), "".join(python), "".join(parse))
    return at + 1


def translate(raw: str) -> tuple[str, str, str]:
    """(Java, Python, parser) forms of a pattern, without capturing groups; raises DialectError."""
    out = Translated()
    #: of each open group: the scoped flags opened in it, and the state to return to
    groups: list[tuple[list[str], bool, bool]] = [([], False, True)]
    verbose, lines = False, True
    at = 0
    while at < len(raw):
        c = raw[at]
        if c == "\\":
            at, java, python, parse = _escape(raw, at, False)
            out.add(java, python, parse)
        elif c == "[":
            at = _class(raw, at, out, verbose)
        elif verbose and c.isspace():
            at += 1
        elif verbose and c == "#":
            at = raw.find("\n", at) + 1 or len(raw)
        elif c == "(":
            named = re.compile(r"\(\?P?<[A-Za-z_][\w.\[\]]*>").match(raw, at)
            flags = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])").match(raw, at)
            if named or raw[at + 1 : at + 2] != "?":
                out.add("(?:")
                groups.append(([], verbose, lines))
                at = named.end() if named else at + 1
            elif flags:
                on, off = flags[1], flags[2] or ""
                if any(f not in "imsxu" for f in on + off) or "u" in off:
                    _fail(f"the flag group {flags[0]!r}")
                if flags[3] == ":":
                    groups.append(([], verbose, lines))
                verbose = "x" in on or (verbose and "x" not in off)
                lines = "m" in on or (lines and "m" not in off)
                case = "(?i:" if "i" in on else "(?-i:" if "i" in off else None
                if flags[3] == ":":
                    out.add(case or "(?:")
                elif case:  # holds to the end of the group, on both sides of its bars
                    out.add(case)
                    groups[-1][0].append(case)
                at = flags.end()
            else:
                out.add("(")  # look-around and the like: the parser names them
                groups.append(([], verbose, lines))
                at += 1
        elif c == ")":
            if len(groups) < 2:
                raise DialectError("unbalanced parenthesis")
            scoped, verbose, lines = groups.pop()
            out.add(")" * (len(scoped) + 1))
            at += 1
        elif c == "|":
            scoped = groups[-1][0]
            out.add(")" * len(scoped) + "|" + "".join(scoped))
            at += 1
        elif c in "^$" and not lines:
            out.add(*((r"\A",) if c == "^" else (r"\z", r"\Z")))
            at += 1
        else:
            out.add("\\]" if c == "]" else "\\}" if c == "}" and not _repeats(raw, at) else c)
            at += 1
    if len(groups) > 1:
        raise DialectError("unclosed group")
    out.add(")" * len(groups[0][0]))
    return out.strings()


def _repeats(raw: str, at: int) -> bool:
    """Whether the brace at ``at`` ends a repetition."""
    return re.search(r"\{\d*,?\d*$", raw[:at]) is not None
