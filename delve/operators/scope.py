"""Which keys a search admits: prefixes, targets, regular expressions, globs and times in keys."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_admits(key: Column, target: str) -> Column:
    """A target ending in ``/`` is a prefix; any other is a key, a folder or an archive."""
    if not target or target.endswith("/"):
        return key.startswith(target)
    return (key == target) | key.startswith(f"{target}/") | key.startswith(f"{target}!/")


def prefix_range(key: Column, prefix: str) -> Column:
    """``startswith`` as a range, which file statistics prune."""
    return key.startswith(prefix) if prefix else F.lit(True)


def candidate_prefix(target: str, key_prefix: str | None) -> str | None:
    """The prefix that prunes: the given one if it extends the target, else the target."""
    if key_prefix and key_prefix.startswith(target):
        return key_prefix
    return target or None


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression; ``*`` and ``?`` stop at ``/``, ``**`` does not."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        elif c == "*":
            out.append("[^/]*")
            at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]")
            at = end + 1
        elif c == "{" and "}" in glob[at:]:
            end = glob.index("}", at)
            out.append("(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[at + 1 : end].split(",")) + ")")
            at = end + 1
        elif c == "\\" and at + 1 < len(glob):
            out.append(re.escape(glob[at + 1]))
            at += 2
        else:
            out.append(re.escape(c))
            at += 1
    return f"^{''.join(out)}$"


def globs_admit(key: Column, globs: list[str]) -> Column:
    """The last glob that matches decides, ``!`` excluding; none matching admits only if none includes."""
    base = F.substring_index(key, "/", -1)
    verdict = F.lit(not any(not g.startswith("!") for g in globs))
    for glob in globs:
        wants = not glob.startswith("!")
        body = glob.removeprefix("!")
        subject = key if "/" in body else base
        verdict = F.when(subject.rlike("(?s)" + glob_regex(body.removeprefix("/"))), F.lit(wants)).otherwise(verdict)
    return verdict


# ---------------------------------------------------------------- times in keys

#: Delivery may lag by so much; years that count as dates.
LAG = "INTERVAL 15 MINUTES"
_YEAR, _TWO = "(?:199[0-9]|20[0-9]{2})", "[0-9]{2}"
#: Shapes of times in keys, as (expression, seconds covered; None: by what the match has).
SHAPES = (
    ("minute", rf"(?<![0-9])({_YEAR})({_TWO})({_TWO})T({_TWO})({_TWO})()Z"),
    ("dashed", rf"(?<![0-9])({_YEAR})-({_TWO})-({_TWO})-({_TWO})(?:-({_TWO})-({_TWO}))?(?![0-9])"),
    ("hive", rf"year=({_YEAR})/month=([0-9]{{1,2}})/day=([0-9]{{1,2}})(?:/hour=([0-9]{{1,2}}))?()()(?![0-9])"),
    ("day", rf"(?:dt|date)=({_YEAR})-({_TWO})-({_TWO})()()()(?![0-9])"),
    ("folders", rf"(?:^|/)({_YEAR})/([0-9]{{1,2}})/([0-9]{{1,2}})()()()/"),
)


def key_times(key: Column) -> Column:
    """All times found in a key: array of (start, end, day) with ``day`` for whole days."""
    out = []
    for _, shape in SHAPES:
        groups = [F.regexp_extract_all(key, F.lit(shape), F.lit(k)) for k in range(1, 7)]
        out.append(F.filter(_ranges(groups), lambda r: r["start"].isNotNull()))
    return F.concat(*out)


def _ranges(groups: list[Column]) -> Column:
    rows = F.arrays_zip(*groups)  # each expression runs once a key, not once a use
    return F.transform(rows, lambda g: _range([g[str(k)] for k in range(len(groups))]))


def _range(part: list[Column]) -> Column:
    def number(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))

    start = F.try_make_timestamp(part[0].cast("int"), part[1].cast("int"), part[2].cast("int"), number(part[3]), number(part[4]), number(part[5]).cast("decimal(8,6)"))
    given = [F.coalesce(F.nullif(p, F.lit("")), F.lit("")) != "" for p in part]
    end = F.when(given[5], start + F.expr("INTERVAL 1 SECOND")).when(given[4], start + F.expr("INTERVAL 1 MINUTE")).when(given[3], start + F.expr("INTERVAL 1 HOUR")).otherwise(start + F.expr("INTERVAL 1 DAY"))
    return F.struct(start.alias("start"), end.alias("end"), (~given[3]).alias("day"))


def key_time_range(key: Column) -> Column:
    """(start, end) of a key, null if it has no time. Finer times inside a day win over the day; otherwise
    the hull of all counts. The start is widened back by LAG."""
    return F.element_at(F.transform(F.array(key_times(key)), _best_range), 1)


def _best_range(times: Column) -> Column:
    hull = lambda xs: F.struct(F.array_min(F.transform(xs, lambda r: r["start"])).alias("start"), F.array_max(F.transform(xs, lambda r: r["end"])).alias("end"))
    inner, outer, whole = hull(F.filter(times, lambda r: ~r["day"])), hull(F.filter(times, lambda r: r["day"])), hull(times)
    inside = inner["start"].isNotNull() & (outer["start"].isNull() | ((inner["start"] >= outer["start"]) & (inner["end"] <= outer["end"])))
    best = F.when(inside, inner).otherwise(whole)
    return F.when(F.size(times) > 0, F.struct((best["start"] - F.expr(LAG)).alias("start"), best["end"].alias("end")))


_INSTANT = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?Z?")
_AGO = re.compile(r"(\d+)([smhdw])")
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_instant(text: str, now: datetime, until: bool = False) -> datetime:
    """An absolute date, minute or second in UTC, or a time ago; an ``until`` includes its day, minute or second."""
    if m := _AGO.fullmatch(text.strip()):
        return now - timedelta(**{_UNITS[m[2]]: int(m[1])})
    m = _INSTANT.fullmatch(text.strip())
    if not m:
        raise ValueError(f"cannot read the time {text!r}")
    try:
        at = datetime(*(int(x or 0) for x in m.groups()), tzinfo=timezone.utc)
    except ValueError as e:
        raise ValueError(f"cannot read the time {text!r}: {e}") from e
    if until:
        at += timedelta(seconds=1) if m[6] else timedelta(minutes=1) if m[4] else timedelta(days=1)
    return at


@dataclass(frozen=True)
class Scope:
    """What a search admits by key. Keys without a time are kept and counted."""

    target: str = ""
    key_prefix: str | None = None
    key_regex: str | None = None
    globs: tuple[str, ...] = field(default=())
    since: datetime | None = None
    until: datetime | None = None

    def __post_init__(self) -> None:
        if self.since and self.until and self.since >= self.until:
            raise ValueError("since must be before until")

    def admits(self, key: Column) -> Column:
        fits = target_admits(key, self.target)
        if self.key_prefix:
            fits &= key.startswith(self.key_prefix)
        if self.key_regex:
            fits &= key.rlike(self.key_regex)
        if self.globs:
            fits &= globs_admit(key, list(self.globs))
        if self.since or self.until:
            fits &= in_time(key_time_range(key), self.since, self.until)
        return fits

    def undated(self, docs: DataFrame, key: str = "key") -> DataFrame:
        """One row: how many admitted keys have no time."""
        return docs.where(self.admits(F.col(key)) & key_time_range(F.col(key)).isNull()).agg(F.count("*").alias("undated"))


def in_time(times: Column, since: datetime | None, until: datetime | None) -> Column:
    """Drops a range that ends by ``since`` or starts from ``until`` on; null ranges stay."""
    drop = F.lit(False)
    if since:
        drop |= times["end"] <= F.lit(since)
    if until:
        drop |= times["start"] >= F.lit(until)
    return F.coalesce(~drop, F.lit(True))
