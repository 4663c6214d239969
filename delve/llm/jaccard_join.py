"""Exact near-duplicate classes: a Jaccard metric-space join over word shingles.

Jaccard distance d = 1 - |A n B| / |A u B| obeys the triangle inequality, so a document can be
kept apart from others by its distance to a pivot alone. The join runs in three steps; each only
drops pairs that cannot link.

1. *Far documents.* A document of n shingles links only to sets that hold all but
   ``slack(n) = n - ceil(percent * n / 100)`` of its shingles. Of a consistent sample of the
   shingles (those whose hash falls in one residue class) at least ``m - slack(n)`` must so occur
   in some other set. Documents that fail are at a distance over r from every other document.
   Equal sets are one class from here on.
2. *Blocks.* The rest order their shingles by frequency; two linked sets share one of their
   first ``slack(n) + 1``. Sets connected through such shingles form a block; sets of different
   blocks are further apart than r.
3. *Regions.* In a block, pivots create Voronoi regions: a set belongs to its nearest pivot, and
   also to each pivot q with d(x, q) <= d(x, home) + 2r, the triangle-inequality window that
   replicates boundary documents. Pivots are compared with the whole block exactly and leave
   it; so do sets for which all sets within r of their distance to some pivot are of their own
   class. Regions join recursively: those too large for a task are split by jobs, smaller ones
   in memory, down to exact comparisons. Where the windows are too wide to part a region, it
   goes on as one with new pivots in memory; one too large for that is dealt into parts, and
   tasks join each pair of parts that are not both of the region's largest class.

Shingles are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks, set_sums, shingles
from ._components import connected_components
from ._exchange import find_shared
from ._shared import bounded_batches, materialize, release, shuffle_partitions, text_of, trimmed

_META = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "n", "m", "hi", "lo")])
_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Shingles of a block that one task joins in memory (8 bytes each).
REGION_SHINGLES = 2_000_000
#: Pivots of a region that jobs split, regions split by one job, and shingles of their pivots (if it is not one region): bound what is broadcast.
PIVOTS, REGIONS_AT_ONCE, PIVOT_SHINGLES = 8, 64, 4_000_000
#: Pairs of parts that one job joins, each at most about a region of a task: bounds what is copied at once.
PAIRS_AT_ONCE = 256


def slack(n: Column, percent: int) -> Column:
    """Shingles of a set of n that a linked set may lack."""
    return F.floor(n * F.lit(100 - percent) / F.lit(100)).cast("long")


# ---------------------------------------------------------------- sets of shingles


def _extract(size: int, modulus: int):
    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in chunks(batch.column(2)):
            row, value = shingles(data, offs, size)
            rows = hi - lo
            sums = [set_sums(row, value, rows, salt) for salt in _SALTS]
            taken = value % np.uint64(modulus) == 0
            n, m = np.bincount(row, minlength=rows), np.bincount(row[taken], minlength=rows)
            meta = pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, rows) for c in (0, 1)), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums)], schema=_META
            )
            own = sums[0][row[taken]]
            yield meta, value[taken], own, np.zeros(len(own), np.uint64)

    return run


def _sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, want_hi, want_lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "hi", "lo"))
            for lo, hi, data, offs in chunks(batch.column("text")):
                row, value = shingles(data, offs, size)
                rows = hi - lo
                right = np.ones(rows, dtype=bool)
                for salt, want in zip(_SALTS, (want_hi, want_lo), strict=True):
                    right &= set_sums(row, value, rows, salt).view(np.int64) == want[lo:hi]
                keep = right[row]
                n = np.bincount(row[keep], minlength=rows)[right]
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(value[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][right]), pa.array(n.astype(np.int64)), tokens], schema=schema)

    return run, "node long, n long, tokens array<long>"


# ---------------------------------------------------------------- joining a region in memory


def solve(sizes: np.ndarray, offsets: np.ndarray, values: np.ndarray, tags: np.ndarray, percent: int, leaf: int = 12) -> np.ndarray:
    """Class of each set (the smallest index in it); sets with equal tags (>= 0) are known to link."""
    count = len(sizes)
    parent = np.arange(count)

    def union(members: np.ndarray) -> None:
        roots = np.unique(parent[members])
        if len(roots) > 1:
            parent[np.isin(parent, roots)] = roots[0]

    for tag in np.unique(tags[tags >= 0]):
        union(np.flatnonzero(tags == tag))
    names, local = np.unique(values, return_inverse=True)
    freq = np.bincount(local, minlength=len(names))
    r, eps = (100 - percent) / 100, 1e-9
    mark = np.zeros(len(names), dtype=bool)

    def gathered(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = offsets[members + 1] - offsets[members]
        bounds = np.r_[0, np.cumsum(lengths)]
        at = np.arange(bounds[-1]) + np.repeat(offsets[members] - bounds[:-1], lengths)
        return local[at], bounds

    def against(pivot: int, members: np.ndarray, cat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = local[offsets[pivot] : offsets[pivot + 1]]
        mark[own] = True
        sums = np.r_[0, np.cumsum(mark[cat])]
        mark[own] = False
        inter = sums[bounds[1:]] - sums[bounds[:-1]]
        joint = sizes[members] + sizes[pivot] - inter
        linked = 100 * inter >= percent * joint
        if linked.any():
            union(np.r_[pivot, members[linked]])
        return 1 - inter / np.maximum(joint, 1), linked

    waiting = [np.arange(count)]
    while waiting:
        members = waiting.pop()
        if len(members) < 2 or (parent[members] == parent[members[0]]).all():
            continue
        cat, bounds = gathered(members)
        if len(members) <= leaf:
            for k in range(len(members) - 1):
                rest = members[k + 1 :]
                if (parent[rest] != parent[members[k]]).any():
                    against(members[k], rest, cat[bounds[k + 1] :], bounds[k + 1 :] - bounds[k + 1])
            continue
        # pivots: the set of most shared shingles among those outside the largest class, then the farthest ones
        names_, size_ = np.unique(parent[members], return_counts=True)
        outside = parent[members] != names_[np.argmax(size_)] if size_.max() > 1 else np.ones(len(members), dtype=bool)
        score = np.r_[0, np.cumsum(freq[cat])]
        score = np.where(outside, (score[bounds[1:]] - score[bounds[:-1]]) / np.maximum(sizes[members], 1), -1)
        pivots = [int(np.argmax(score))]
        dist = []
        for _ in range(min(PIVOTS, int(outside.sum()))):
            d, _linked = against(members[pivots[-1]], members, cat, bounds)
            dist.append(d)
            nearest = np.where(outside, np.min(dist, axis=0), -1)
            nearest[pivots] = -1
            pivots.append(int(np.argmax(nearest)))
        pivots.pop()
        d = np.array(dist)
        stays = np.ones(len(members), dtype=bool)
        stays[pivots] = False
        for row in d:  # a set whose window of distances holds only its own class has no link left to find
            order = np.flatnonzero(stays)
            order = order[np.argsort(row[order], kind="stable")]
            at, own = row[order], parent[members[order]]
            change = np.r_[0, np.cumsum(own[1:] != own[:-1])]
            low = np.searchsorted(at, at - r - eps, side="left")
            high = np.searchsorted(at, at + r + eps, side="right") - 1
            stays[order[change[low] == change[high]]] = False
        home = d.min(axis=0)
        cells = [stays & (row <= home + 2 * r + eps) for row in d]
        if sum(int(c.sum()) for c in cells) > 1.25 * stays.sum():  # windows too wide to part this region; its pivots are done with
            waiting.append(members[stays])
        else:
            waiting += [members[c] for c in cells]
    _, first, back = np.unique(parent, return_index=True, return_inverse=True)
    return first[back]


def _solver(percent: int):
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        node, n, tag = (table.column(c).to_numpy() for c in ("node", "n", "tag"))
        tokens = table.column("tokens").chunk(0)
        offs = tokens.offsets.to_numpy().astype(np.int64)
        root = solve(n, offs - offs[0], tokens.flatten().to_numpy().view(np.uint64), tag, percent)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            region = batch.column("region").to_numpy()
            edges = np.r_[0, np.flatnonzero(region[1:] != region[:-1]) + 1, len(region)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    if held and region[lo] != last:
                        yield finish(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = region[lo]
        if held:
            yield finish(held)

    return run, "node long, root long"


# ---------------------------------------------------------------- splitting regions by jobs


def _assigner(pivots, percent: int):
    """Distances to the pivots of each region: rows (region, pivot, node, n, tag, d, linked, same)."""
    schema = pa.schema([(c, pa.int64()) for c in ("region", "pivot", "node", "n", "tag")] + [("d", pa.float64()), ("linked", pa.bool_()), ("inside", pa.bool_()), ("same", pa.bool_())])
    r, eps = (100 - percent) / 100, 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            region, node, n, tag = (batch.column(c).to_numpy() for c in ("region", "node", "n", "tag"))
            tokens = batch.column("tokens")
            for k in range(len(region)):
                mine = tokens[k].values.to_numpy()
                known = [x for x in pivots.value[int(region[k])] if x[0] != node[k]]
                pivot = len(known) < len(pivots.value[int(region[k])])  # leaves the region, with its links to other pivots
                d, linked = [], []
                for _, _, theirs in known:
                    inter = len(np.intersect1d(mine, theirs, assume_unique=True))
                    joint = len(mine) + len(theirs) - inter
                    d.append(1 - inter / max(joint, 1))
                    linked.append(100 * inter >= percent * joint)
                for (p, p_tag, _), x, near in zip(known, d, linked, strict=True):
                    inside = not pivot and x <= min(d) + 2 * r + eps
                    if inside or near:
                        out.append((region[k], p, node[k], n[k], tag[k], x, near, inside, near or (tag[k] >= 0 and tag[k] == p_tag)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run, "region long, pivot long, node long, n long, tag long, d double, linked boolean, inside boolean, same boolean"


def _pivots(members: DataFrame, sets: DataFrame, turn: int):
    """A few pivots of each region: the set nearest to the shingles that half of it shares, and hashed ones."""
    full = members.join(sets.select("node", "tokens"), "node")
    size = members.groupBy("region").agg(F.count("*").alias("docs"))
    tok = full.select("region", "node", F.explode("tokens").alias("t"))
    core = tok.groupBy("region", "t").agg(F.count("*").alias("c")).join(size, "region").where("2 * c > docs").select("region", "t")
    near = tok.join(core, ["region", "t"]).groupBy("region", "node").agg(F.count("*").alias("common"))
    whole = core.groupBy("region").agg(F.count("*").alias("half"))
    scored = members.join(near, ["region", "node"]).join(whole, "region").withColumn("sim", F.col("common") / (F.col("n") + F.col("half") - F.col("common")))
    medoid = scored.groupBy("region").agg(F.max_by("node", F.struct("sim", F.xxhash64("node"))).alias("node"))
    hashed = members.withColumn("h", F.xxhash64(F.lit(turn), "node")).groupBy("region", F.pmod("h", F.lit(PIVOTS - 1))).agg(F.min_by("node", "h").alias("node")).select("region", "node")
    chosen = medoid.unionByName(hashed).distinct()
    rows = chosen.join(members.select("region", "node", "tag"), ["region", "node"]).join(sets.select("node", "tokens"), "node").collect()  # REGIONS_AT_ONCE * PIVOTS at most
    out: dict[int, list] = {}
    for row in rows:
        out.setdefault(row["region"], []).append((row["node"], row["tag"], np.array(row["tokens"], dtype=np.int64)))
    return out


def _solved(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of regions that fit a task each."""
    run, schema = _solver(percent)
    dealt = members.join(sets.select("node", "tokens"), "node").select("region", "node", "n", "tag", "tokens")
    return dealt.repartition(shuffle_partitions(members.sparkSession), "region").sortWithinPartitions("region").mapInArrow(trimmed(run), schema)


def _tagged(rows: DataFrame, found: dict[int, list]) -> DataFrame:
    """Regions without their pivots, from rows of :func:`_assigner`: (region, node, n, tag), the tag one for all pivots known to link."""
    pivots = F.array_sort(F.collect_set(F.when(F.col("linked"), F.col("pivot"))))
    each = materialize(rows.groupBy("region", "node").agg(F.first("n").alias("n"), F.first("tag").alias("tag"), F.max("inside").alias("stays"), pivots.alias("pivots")))
    known = each.select("region", F.when(~F.col("stays"), F.col("node")).alias("own"), "pivots").distinct().collect()  # 2^PIVOTS a region at most
    name = {(region, p): p for region, of in found.items() for p, _, _ in of}

    def union(region: int, keys: list[int]) -> None:
        old = {name.setdefault((region, k), k) for k in keys}
        for at, own in name.items():
            if at[0] == region and own in old:
                name[at] = min(old)

    for row in known:
        union(row["region"], [*row["pivots"], *([] if row["own"] is None else [row["own"]])])
    for region, of in found.items():
        for p, tag, _ in of:
            if tag >= 0:
                union(region, [p, tag])
    names = each.sparkSession.createDataFrame([(region, key, own) for (region, key), own in name.items()], "of long, key long, own long")
    key = F.coalesce(F.get("pivots", F.lit(0)), F.col("tag"))
    rest = each.where("stays").withColumn("link", key).join(F.broadcast(names), (F.col("region") == F.col("of")) & (F.col("link") == F.col("key")), "left")
    return rest.select("region", "node", "n", F.coalesce("own", "link").alias("tag"))


def _in_pairs(members: DataFrame, sets: DataFrame, percent: int, limit: int) -> list[DataFrame]:
    """Edges of regions that windows do not part: hashed parts of half a task's shingles, joined pair by pair.

    Rows of a region's largest class are only joined with the rest. A job joins about PAIRS_AT_ONCE pairs.
    """
    classes = members.where("tag >= 0").groupBy("region", "tag").agg(F.sum("n").alias("w")).groupBy("region").agg(F.max_by("tag", F.struct("w", "tag")).alias("main"))
    marked = members.join(classes, "region", "left").withColumn("main", F.coalesce(F.col("tag") == F.col("main"), F.lit(False)))
    parts = lambda is_main: F.ceil(2 * F.coalesce(F.sum(F.when(F.col("main") == is_main, F.col("n"))), F.lit(0)) / limit).cast("int")
    counts = marked.groupBy("region").agg(parts(False).alias("others"), parts(True).alias("mains")).collect()  # REGIONS_AT_ONCE at most
    counts = [(r["region"], r["others"], r["others"] + r["mains"]) for r in counts if r["others"]]
    if not counts:
        return []
    table = members.sparkSession.createDataFrame(counts, "region long, others int, k int")
    h = F.xxhash64("region", "node")
    part = F.when(F.col("main"), F.col("others") + F.pmod(h, F.col("k") - F.col("others"))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    dealt = materialize(marked.join(F.broadcast(table), "region").withColumn("part", part))
    step = max(1, PAIRS_AT_ONCE // sum(k for *_, k in counts))
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    out = []
    for lo in range(0, max(others for _, others, _ in counts), step):
        own, k, end = F.col("part"), F.col("k"), F.least(F.lit(lo + step), F.col("others"))
        later = F.when((own >= lo) & (own < end), F.when(k == 1, F.array(F.lit(0))).otherwise(span(own + 1, k - 1))).otherwise(none)
        pairs = F.concat(F.transform(later, lambda j: F.struct(own.alias("i"), j.alias("j"))), F.transform(span(F.lit(lo), F.least(end, own) - 1), lambda i: F.struct(i.alias("i"), own.alias("j"))))
        copies = dealt.select("region", "node", "n", "tag", F.explode(pairs).alias("x")).withColumn("region", F.xxhash64("region", "x.i", "x.j")).drop("x")
        out.append(materialize(_solved(copies, sets, percent).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return out


def _split(members: DataFrame, sets: DataFrame, percent: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Split regions of over ``limit`` shingles until none is left: (regions for tasks, edges found on the way).

    A region whose cells hold over 1.25 times its rows, or one of them over 0.75 times, is joined in pairs instead.
    """
    spark = members.sparkSession
    leaves, edges, turn = [], [], 0
    while True:
        sizes = members.groupBy("region").agg(F.sum("n").alias("weight"), F.max("n").alias("longest"))
        rows = sizes.where(F.col("weight") > limit).orderBy(F.desc("weight"), "region").limit(REGIONS_AT_ONCE).collect()
        upto = np.cumsum([PIVOTS * r["longest"] for r in rows])
        large = [r["region"] for k, r in enumerate(rows) if k == 0 or upto[k] <= PIVOT_SHINGLES]
        if not large:
            return [*leaves, members], edges
        small = sizes.where(F.col("weight") <= limit).select("region")
        leaves.append(materialize(members.join(small, "region", "left_semi").select(*members.columns)))
        waiting = members.join(small, "region", "left_anti").where(~F.col("region").isin(large))
        now = materialize(members.where(F.col("region").isin(large)))
        found = _pivots(now, sets, turn)
        shared = spark.sparkContext.broadcast(found)
        run, schema = _assigner(shared, percent)
        rows = materialize(now.join(sets.select("node", "tokens"), "node").select("region", "node", "n", "tag", "tokens").mapInArrow(run, schema))
        edges.append(rows.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        cell = rows.where("inside").withColumn("of", F.col("region")).withColumn("region", F.xxhash64("region", "pivot", F.lit(turn)))
        rim = cell.where("not same").groupBy("region").agg(F.min("d").alias("rim"))
        r = (100 - percent) / 100
        kept = cell.join(rim, "region").where(F.expr("not same") | (F.col("d") >= F.col("rim") - F.lit(r + 1e-9)))
        new = materialize(kept.select("of", "region", "node", "n", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("tag")).alias("tag")))
        cells = new.groupBy("of", "region").agg(F.count("*").alias("c")).groupBy("of").agg(F.sum("c").alias("total"), F.max("c").alias("most"))
        rest = rows.where("inside").groupBy(F.col("region").alias("of")).agg(F.countDistinct("node").alias("rest"))
        whole = [r["of"] for r in cells.join(rest, "of").where("total > 1.25 * rest or most > 0.75 * rest").collect()]  # REGIONS_AT_ONCE at most
        if whole:
            edges += _in_pairs(materialize(_tagged(rows.where(F.col("region").isin(whole)), {k: found[k] for k in whole})), sets, percent, limit)
        new = new.where(~F.col("of").isin(whole)) if whole else new
        members = materialize(new.select("region", "node", "n", "tag").unionByName(waiting.select("region", "node", "n", "tag")))
        turn += 1


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Classes of documents linked by ``100 * |A n B| >= percent * |A u B|`` over ``size``-word shingles.

    Returns one row per row of ``docs``: (doc_id long, n_shingles long, component_id long), the
    last being the smallest id reachable by links, the row's own included.

    - Words are runs without white space, A-Z lowered; texts of fewer than ``size`` words have
      their whole sequence as one shingle.
    - Null and empty texts, and texts of white space, have no shingles and link with nothing:
      component_id is their own id.
    - Rows with a null id take part; a class of only such rows has a null component_id.
    - Repeated rows each get a row. Rows that share an id count as one document: their classes
      are one class.
    - Only ``id_col`` and ``text_col`` are read; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = text_of(docs[text_col])
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = materialize(find_shared(source, _extract(size, max(1, 60 // (100 - percent) if percent < 100 else 60)), _META, extras=False))
    rows = found.where("owner is null").select("doc_id", "key", "n", "m", "hi", "lo")
    hits = found.where("owner is not null").groupBy("owner").agg(F.sum("hits").alias("hits"))
    one = F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("rep_key")  # of a row that stands for the class: those without an id share nothing else
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), one, F.max("n").alias("n"), F.max("m").alias("m"))
    firsts = classes.where("rep is not null").groupBy("rep").agg(F.min(F.struct("hi", "lo")).alias("first"))
    node = F.when(F.struct("hi", "lo") == F.col("first"), F.col("rep")).otherwise(F.xxhash64("hi", "lo"))
    classes = materialize(classes.join(firsts, "rep", "left").select("hi", "lo", "rep", "rep_key", "n", "m", node.alias("node")))
    near = classes.join(hits, F.col("hi") == F.col("owner"), "left").where(F.coalesce("hits", F.lit(0)) >= F.col("m") - slack(F.col("n"), percent))
    run, schema = _sets(size)
    texts = near.select("rep", "rep_key", "node", "hi", "lo").join(source, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("rep_key") == F.col("key"))).select("node", "hi", "lo", "text")
    sets = materialize(texts.mapInArrow(trimmed(run), schema))
    again = materialize(sets.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"))  # repeated rows
    if not again.isEmpty():
        sets = materialize(sets.join(again, "node", "left_anti").unionByName(sets.join(again, "node", "left_semi").dropDuplicates(["node"])))

    tok = sets.select("node", "n", F.explode("tokens").alias("t"))
    freq = materialize(tok.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"))  # tables, so that Spark splits the hot shingles of the joins with them
    ordered = tok.join(freq, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("by"))
    first = F.size("by") - (F.col("n") - slack(F.col("n"), percent)) + 1
    prefix = ordered.withColumn("k", first).where("k > 0").select("node", F.explode(F.slice("by", F.lit(1), F.col("k"))).alias("x")).select("node", F.col("x.t").alias("t"))
    prefix = materialize(prefix)
    release(freq)
    least = materialize(prefix.groupBy("t").agg(F.min("node").alias("b")))
    blocks = connected_components(prefix.join(least, "t").select(F.col("node").alias("a"), "b"))

    members = blocks.join(sets.select("node", "n"), "node").select(F.col("root").alias("region"), "node", "n", F.lit(-1).cast("long").alias("tag"))
    leaves, edges = _split(materialize(members), sets, percent, region_shingles)
    work = leaves[0]
    for leaf in leaves[1:]:
        work = work.unionByName(leaf)
    roots = _solved(work, sets, percent)
    ids = rows.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("hi", "lo")).alias("first")
    shared = ids.groupBy("doc_id").agg(first, F.max(F.struct("hi", "lo")).alias("last")).where("first <> last").select("doc_id", "first")
    shared = materialize(ids.join(shared, "doc_id").select("hi", "lo", F.col("first.hi").alias("hi2"), F.col("first.lo").alias("lo2")).distinct())
    if not shared.isEmpty():  # ids of several sets
        names = classes.select("hi", "lo", "node")
        others = names.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("node").alias("b"))
        edges.append(shared.join(names, ["hi", "lo"]).join(others, ["hi2", "lo2"]).select(F.col("node").alias("a"), "b"))
    if edges:
        for more in edges:
            roots = roots.unionByName(more.select(F.col("a").alias("node"), F.col("b").alias("root")))
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = classes.join(materialize(roots).withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    linked = materialize(linked.select("hi", "lo", "rep", F.coalesce("root", "node").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = materialize(linked.join(smallest, "root").select("hi", "lo", "component_id"))
    joined = rows.where("n > 0").join(answer, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest; all columns stay as they are."""
    from ._shared import temp_name

    name = temp_name(docs, "kept_id")
    result = jaccard_components(docs, id_col, text_col, **options)
    ids = result.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids[name]), "left_semi")
