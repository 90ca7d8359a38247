"""Exact Jaccard self-join of documents on word shingles, as a metric-space join.

Jaccard distance ``d = 1 - J`` and, for sets, the size of the symmetric difference are metrics.
Two documents link when ``100 * |A n B| >= percent * |A u B|``, that is ``d <= eps``.

1. *Sets.* Every document becomes its set of shingle hashes; equal sets form one class, so copies
   are joined by a grouped minimum and never paired.
2. *Pivots and regions.* With documents alone as pivots nearly all distances are 1 (texts share
   next to nothing), every pivot lies inside every triangle-inequality window and each document
   would be replicated to each region. So the first level splits the shingle universe into ``K``
   hash parts and takes as pivots the *projections* of documents on a part: in each part a
   document lies in the Voronoi region of the pivot at distance 0. The symmetric difference adds
   up over the parts, and a linked pair differs in at most ``H = floor((|A|+|B|)(1-t)/(1+t))``
   shingles, so of K > H parts the pair is at distance 0 in K - H at least and shares their regions: a
   document is replicated to one region per part, its window. Parts that are empty in both give no
   region, so K exceeds H by more than the empty parts that a document usually has; if either of a
   pair has fewer than K - H empty parts, they share a region. Documents with more are also
   replicated by single shingles, the ``|A| - ceil(t|A|) + 1`` smallest hashes, of which a linked
   pair shares one. K follows a ladder of sizes; documents whose partners may stand on the next step
   are replicated there too.
3. *Islands.* Regions that hold different sets connect them; what is connected forms an island.
   Sets of different islands cannot link. Tasks connect the sets they see themselves and send one
   row per region, so no region grows beyond the number of tasks. An island above ``REFINED``
   sets is connected again in Spark, with single shingles as pivots, the rarest of each set first by exact counts:
   passages that many share then tie only what consists of them. Islands up to ``REFINED`` are
   taken apart by the sizes and outlines of their sets (distances to 64 fixed pivots; the
   triangle inequality rules pairs out, exactly). Each set is then sent to its island once.
4. *Recursive join in an island.* A document is taken as pivot, its distance to all others is
   computed through an inverted list, those within eps join its component; the next pivot is
   taken outside the largest component, until every document outside it has been a pivot: no
   pair of different components is then left unseen. An island above ``island_docs`` is first cut
   by Spark: ``PIVOTS`` pivots, the distances of every member to them, the components that links
   to pivots make, blocks in the order of component and distance to the first pivot, and only
   pairs of blocks whose distances differ by eps at most (triangle inequality) and that are not
   of one component throughout. Each pair of blocks is then joined as above.

Results are exact up to equal 64-bit hashes of different shingles *within one pair*.

Missing and odd input: a null or wordless text has an empty set (size 0), links with nothing and
is its own component; a text with fewer than k words has one shingle, its whole sequence; rows
with the same doc_id are separate documents; a row with a null doc_id takes part, but never names
a component unless all ids of it are null. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm import text as tx
from bandwise.llm.door import numbered
from bandwise.llm.graph import Tables, connected_components, measured, release
from bandwise.operators.ranking import group_rank
from bandwise.session import cut_lineage

_MAX_SIZE = 1 << 40
_HELD = 1 << 20  # region rows that a task holds before it sends them
PIVOTS = 8
CLASSES = 64
REFINED = 4096


def ladder(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size steps, and of each step the parts K and the differences H of a pair."""
    bounds = [1]
    while bounds[-1] < _MAX_SIZE:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2, 10 if bounds[-1] == 1 and percent >= 90 else 0))
    b = np.array(bounds, np.int64)
    differ = 2 * (b[1:] - 1) * (100 - percent) // (100 + percent)
    empty = (differ + 1) * np.exp(-b[:-1] / (differ + 1))  # expected empty parts of a document
    return b, differ + 1 + np.ceil(np.where(differ > 0, empty + 2 * np.sqrt(empty), 0)).astype(np.int64), differ


def _profiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            u, so = tx.shingle_sets(data, off, k)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("th"), pa.array(np.diff(so)), *_prints(u, so), _outline(u, so)],
                ["doc_id", "th", "n", "f1", "f2", "outline"])


def _outline(u: np.ndarray, so: np.ndarray) -> pa.Array:
    """How many shingles each set has in each of ``CLASSES`` hash classes (at most 65535).

    The counts are the set's distances to fixed pivots, the classes themselves; by the triangle
    inequality two sets differ in at least as many shingles as their counts differ in sum.
    """
    doc = np.repeat(np.arange(len(so) - 1), np.diff(so))
    slot = doc * CLASSES + (tx.mix(u ^ tx.seed(9)) % np.uint64(CLASSES)).astype(np.int64)
    counts = np.bincount(slot, minlength=(len(so) - 1) * CLASSES).clip(max=65535).astype(np.uint16)
    return pa.array([row.tobytes() for row in counts.reshape(-1, CLASSES)], pa.binary())


def _refine(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by island: (cid, part) of the parts whose outlines allow links; singles are left out.

    One island is in memory at a time, with 128 bytes a member; the caller sends none above ``REFINED``.
    """
    def parts(cids, n, outlines):
        n, x = np.array(n, np.int64), np.frombuffer(b"".join(outlines), np.uint16).reshape(len(n), -1).astype(np.int32)
        comp, done = np.arange(len(n)), np.zeros(len(n), bool)
        while True:
            rest = np.flatnonzero(~done & (comp != np.bincount(comp, minlength=len(n)).argmax()))
            if not len(rest):
                break
            p = rest[0]
            done[p] = True
            near = (np.minimum(n, n[p]) * 100 >= percent * np.maximum(n, n[p])) & (
                np.abs(x - x[p]).sum(1) * (100 + percent) <= (n + n[p]) * (100 - percent))
            comp[np.isin(comp, comp[near])] = comp[p]
        keep = np.flatnonzero(np.bincount(comp, minlength=len(n))[comp] > 1)
        return pa.RecordBatch.from_arrays([pa.array([cids[i] for i in keep], pa.int64()), pa.array([cids[comp[i]] for i in keep], pa.int64())], ["cid", "part"])

    now, rows = None, ([], [], [])
    for b in batches:
        for island, *row in zip(*(b.column(c).to_pylist() for c in ("island", "cid", "n", "outline"))):
            if island != now and rows[0]:
                yield parts(*rows)
                rows = ([], [], [])
            now = island
            for held, v in zip(rows, row):
                held.append(v)
    if rows[0]:
        yield parts(*rows)


def _prints(u: np.ndarray, so: np.ndarray) -> list[pa.Array]:
    return [tx.as_long(tx.segment_sum(tx.mix(u ^ tx.seed(s)), so)) for s in (1, 2)]


def _regions(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (region, f1): the least set of each region among those seen here, and the sets tied to it.

    Sets that share a region within a task are tied to the least one by a region of their own.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for _, data, off in tx.slices(batch):
            u, so = tx.shingle_sets(data, off, k)
            f1 = tx.segment_sum(tx.mix(u ^ tx.seed(1)), so)
            pair = np.stack([f1, tx.segment_sum(tx.mix(u ^ tx.seed(2)), so)], 1)
            keep = np.sort(np.unique(pair, axis=0, return_index=True)[1]) if len(f1) else np.zeros(0, int)
            keep = keep[np.diff(so)[keep] > 0]
            for docs, step in _steps(np.diff(so), keep, percent):
                regions, owner = _windows(u, so, docs, step, percent)
                held.append((regions, f1[docs][owner]))
                size += len(regions)
            if size >= _HELD:
                yield _combined(held)
                held, size = [], 0
    if held:
        yield _combined(held)


def _combined(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    regions, sets = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((sets, regions))
    regions, sets = regions[order], sets[order]
    head = np.ones(len(regions), bool)
    head[1:] = regions[1:] != regions[:-1]
    least = sets[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sets) else sets
    a, b = sets[sets != least], least[sets != least]
    ties = np.unique(np.stack([a, b], 1), axis=0)
    own = tx.mix(tx.mix(ties[:, 0] + tx.seed(8)) + ties[:, 1])
    return pa.RecordBatch.from_arrays([
        tx.as_long(np.concatenate([regions[head], own, own])),
        tx.as_long(np.concatenate([sets[head], ties[:, 0], ties[:, 1]]))], ["region", "f1"])


def _steps(n: np.ndarray, docs: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents with their own step, and those whose partners may stand on the next one."""
    bounds = ladder(percent)[0]
    own = np.searchsorted(bounds, n[docs], "right") - 1
    up = (n[docs] * 100) // percent >= bounds[own + 1]
    return [(docs, own), (docs[up], own[up] + 1)]


def _windows(u, so, docs, step, percent) -> tuple[np.ndarray, np.ndarray]:
    """Region hashes of ``docs`` on their ``step``, and the position in ``docs`` each belongs to."""
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lens = np.diff(so)[docs]
    parts, differ = (x[step] for x in ladder(percent)[1:])
    flat = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(so[docs], lens)
    s = u[flat]
    base = np.cumsum(parts) - parts
    part = tx.mix(s ^ tx.seed(3)) % np.repeat(parts, lens).astype(np.uint64)
    slot = np.repeat(base, lens) + part.astype(np.int64)
    sums = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(sums, slot, tx.mix(s ^ tx.seed(4)))
    filled = np.bincount(slot, minlength=len(sums)) > 0
    owner = np.repeat(np.arange(len(docs)), parts)
    number = (np.arange(len(sums)) - np.repeat(base, parts)).astype(np.uint64)
    place = tx.mix(number + tx.mix(step.astype(np.uint64) + tx.seed(5))[owner])
    regions, owners = [tx.mix(sums + place)[filled]], [owner[filled]]
    vacant = np.bincount(owner[~filled], minlength=len(docs))
    for i in np.flatnonzero(vacant >= parts - differ):  # too many empty parts: single shingles as pivots
        m = int(lens[i]) - -(-int(lens[i]) * percent // 100) + 1
        low = np.sort(tx.mix(u[so[docs[i]]: so[docs[i] + 1]] ^ tx.seed(6)))[:m]
        regions.append(tx.mix(low + tx.seed(7, int(step[i]))))
        owners.append(np.full(m, i))
    return np.concatenate(regions), np.concatenate(owners)


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, cid) for every shingle of a set; islands keep their shingles apart."""
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            u, so = tx.shingle_sets(data, off, k)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(so))
            island = tx.mix(np.asarray(rows.column("island")).astype(np.uint64))[owner]
            yield pa.RecordBatch.from_arrays([tx.as_long(tx.mix(u ^ tx.seed(11)) + island), rows.column("cid").take(pa.array(owner))], ["h", "cid"])


def _rarest(texts: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (region, f1), with cid for f1: a region for each of a set's rarest shingles.

    In any one order of all shingles two linked sets share one of their first ``n - ceil(t n) + 1``;
    the order is by the number of sets of the island that hold the shingle, then by hash. The counts
    are exact and grow with the data: every (shingle, set) is a row of one shuffle. A shingle of one set has
    no partner but keeps its place, so only the shared ones come back to their sets.
    """
    rows = texts.select("cid", "island", "text").mapInArrow(partial(_shingles, k=k), "h long, cid long")
    often = F.count(F.lit(1)).over(Window.partitionBy("h"))
    shared = rows.withColumn("c", often).filter("c > 1").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    n = F.col("n").cast("long")
    first = n - F.ceil(n * F.lit(percent) / F.lit(100)) + 1 - (n - F.size("s"))  # places that the unshared ones leave
    first = F.greatest(F.lit(0), first).cast("int")
    return shared.join(sizes.select("cid", "n"), "cid").select(F.explode(F.slice("s", F.lit(1), first)).alias("r"), "cid").select(
        F.col("r.h").alias("region"), F.col("cid").alias("f1"))


def _connected(rows: DataFrame) -> DataFrame:
    """Islands ``(node, component)`` of the sets that regions ``(region, f1)`` connect."""
    hub = F.first("f1").over(Window.partitionBy("region").orderBy("f1").rowsBetween(Window.unboundedPreceding, 0))
    return connected_components(rows.select(F.col("f1").alias("a"), hub.alias("b")).filter("a != b"))


def _oversized(sets: DataFrame) -> DataFrame:
    """Islands of ``sets`` with more than ``REFINED`` members."""
    return measured(cut_lineage(sets.groupBy("island").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > REFINED).select("island")), 32)


def _take_apart(keyed: DataFrame, inside: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``inside`` with the islands above ``REFINED`` replaced by smaller ones, and those still above.

    Such an island is connected again by the rarest shingles of its sets, counted within the
    island; what stays above is counted and connected again by itself, where shingles are rarer, until a
    round leaves more than nine tenths of it. The texts concerned are written once.
    """
    above = _oversized(inside)
    if above.isEmpty():
        return inside, above
    spark = inside.sparkSession
    tables = Tables(spark)
    whole, large = inside.join(above, "island", "left_anti"), cut_lineage(inside.join(above, "island"))
    ids = measured(large.select("_id", "_th", "cid"), 96)
    texts = tables.write(keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["_id"]) & (keyed["th"] == ids["_th"])).select("cid", "text"))
    while True:
        count = large.count()
        now = texts.join(measured(large.select("cid", "island"), 48), "cid")
        found = _connected(_rarest(now, large, k, percent))
        release(spark)
        large = cut_lineage(large.drop("island").join(found.select(F.col("node").alias("cid"), F.col("component").alias("island")), "cid"))
        above = _oversized(large)
        whole = whole.unionByName(large.join(above, "island", "left_anti").select(whole.columns))
        large = cut_lineage(large.join(above, "island").select(whole.columns))
        left = large.count()
        if left == 0 or left > 0.9 * count:
            whole = cut_lineage(whole.unionByName(large))
            tables.forget()
            return whole, above


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            u, so = tx.shingle_sets(data, off, k)
            p1, p2 = _prints(u, so)
            same = np.flatnonzero((np.asarray(p1) == np.asarray(rows.column("f1"))) & (np.asarray(p2) == np.asarray(rows.column("f2"))))
            if len(same):
                yield pa.RecordBatch.from_arrays([
                    rows.column("island").take(pa.array(same)), rows.column("cid").take(pa.array(same)),
                    pa.array([u[so[i]: so[i + 1]].tobytes() for i in same], pa.binary())], ["island", "cid", "members"])


def _linked(shared, n1, n2, percent):
    return 100 * shared >= percent * (n1 + n2 - shared)


def link_forest(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that span the exact link components of ``sets`` (distinct, ascending arrays).

    Sets with equal numbers in ``known`` are in one component already. See step 4 above.
    """
    r = len(sets)
    n = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(r), n)
    order = np.argsort(ids, kind="stable")
    lists = owner[order]
    begin = np.searchsorted(ids[order], np.arange(len(values) + 1))
    own = np.concatenate([[0], np.cumsum(n)])
    comp = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(r)
    done = np.zeros(r, bool)
    edges = []
    while True:
        largest = np.bincount(comp, minlength=r).argmax()
        rest = np.flatnonzero(~done & (comp != largest))
        if not len(rest):
            return edges
        p = rest[0]
        done[p] = True
        t = ids[own[p]: own[p + 1]]
        lens = begin[t + 1] - begin[t]
        at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(begin[t], lens)
        shared = np.bincount(lists[at], minlength=r)
        for x in np.flatnonzero(_linked(shared, n[p], n, percent) & (comp != comp[p])):
            if comp[x] != comp[p]:
                edges.append((int(p), int(x)))
                comp[comp == comp[x]] = comp[p]


def _join_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grp: the spanning links of each group, one group in memory at a time."""
    def rows():
        for b in batches:
            yield from zip(b.column("grp").to_pylist(), b.column("cid").to_pylist(), b.column("members"), b.column("known").to_pylist())

    def found(group: dict) -> pa.RecordBatch:
        cids = list(group)
        links = link_forest([group[c][0] for c in cids], percent, [group[c][1] for c in cids])
        return pa.RecordBatch.from_arrays([pa.array([cids[i] for i, _ in links], pa.int64()), pa.array([cids[j] for _, j in links], pa.int64())], ["a", "b"])

    now, group = None, {}
    for g, cid, members, known in rows():
        if g != now and group:
            yield found(group)
            group = {}
        now = g
        group[cid] = (np.frombuffer(members.as_buffer(), np.uint64), known)
    if group:
        yield found(group)


def _to_pivots(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Distance of each member to the first pivot of its island, and the pivots it links to."""
    for b in batches:
        dist, links = [], []
        for m, pivots in zip(b.column("members"), b.column("pivots")):
            x = np.frombuffer(m.as_buffer(), np.uint64)
            near, first = [], None
            for p in pivots:
                y = np.frombuffer(p["members"].as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                first = 1 - shared / (len(x) + len(y) - shared) if first is None else first
                if _linked(shared, len(x), len(y), percent):
                    near.append(p["cid"].as_py())
            dist.append(first)
            links.append(near)
        yield pa.RecordBatch.from_arrays([b.column("island"), b.column("cid"), b.column("per"), pa.array(dist, pa.float64()), pa.array(links, pa.list_(pa.int64()))], ["island", "cid", "per", "dist", "links"])


def _cut_islands(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of large islands, and (cid, grp, known): which blocks meet where."""
    order = F.struct(F.xxhash64("cid").alias("h"), "cid", "members")
    pivots = large.withColumn("slot", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(PIVOTS))).groupBy("island", "slot").agg(F.min(order).alias("p"))
    pivots = cut_lineage(pivots.groupBy("island").agg(F.sort_array(F.collect_list("p")).alias("pivots")))  # PIVOTS at most
    dist = cut_lineage(large.join(pivots, "island").mapInArrow(
        partial(_to_pivots, percent=percent), "island long, cid long, per long, dist double, links array<long>"))
    links = dist.select(F.col("cid").alias("a"), F.explode("links").alias("b")).filter("a != b")
    comp = connected_components(links).select(F.col("node").alias("cid"), "component")
    known = dist.select("island", "cid", "per", "dist").join(comp, "cid", "left").withColumn("known", F.coalesce("component", "cid"))
    ranked = group_rank(known.select("island", "cid", "per", "dist", "known"), ["island"], "known", ["dist", "cid"], rank_col="rk", size_col="of")
    ranked = ranked.withColumn("block", F.floor((F.col("rk") - 1) / F.col("per")))
    blocks = cut_lineage(ranked.groupBy("island", "block").agg(
        F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.min("known").alias("k0"), F.max("known").alias("k1")))
    eps = 1 - percent / 100 + 1e-9
    i, j = blocks.alias("i"), blocks.alias("j")
    one = (F.col("i.k0") == F.col("i.k1")) & (F.col("j.k0") == F.col("j.k1")) & (F.col("i.k0") == F.col("j.k0"))
    pairs = i.join(j, (F.col("i.island") == F.col("j.island")) & (F.col("i.block") <= F.col("j.block"))
                   & (F.col("j.lo") - F.col("i.hi") <= eps) & (F.col("i.lo") - F.col("j.hi") <= eps) & ~one).select(
        F.col("i.island").alias("island"), F.xxhash64("i.island", "i.block", "j.block").alias("grp"),
        F.explode(F.array_distinct(F.array("i.block", "j.block"))).alias("block"))
    return links, ranked.join(pairs, ["island", "block"]).select("cid", "grp", "known")


def jaccard_classes(docs: DataFrame, k: int, percent: int, island_docs: int = 4096) -> DataFrame:
    """``(doc_id, th, n, component, component_id)`` for every row of ``docs(doc_id, text)``.

    ``th`` hashes the text, ``n`` is the size of its set, ``component`` a number that the linked
    documents share (null for an empty set), ``component_id`` the smallest doc_id among them.

    ``k``: words of a shingle. ``percent``: least Jaccard similarity of a link, in hundredths (75 to
    100). ``island_docs``: islands with more distinct sets than this, or more than 512 times as
    many shingles, are cut before they are joined; it changes the work of a task, never the result.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")  # a partner is at most one step away
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    profiles = cut_lineage(keyed.mapInArrow(partial(_profiles, k=k), "doc_id long, th long, n long, f1 long, f2 long, outline binary"))
    same = cut_lineage(profiles.filter("n > 0").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    if not same.isEmpty():  # of fully repeated rows one stands for all from here on
        at = keyed["doc_id"].eqNullSafe(same["_id"]) & (keyed["th"] == same["_th"])
        same = measured(same, 48)
        keyed = keyed.join(same, at, "left_anti").unionByName(keyed.join(same, at, "left_semi").dropDuplicates(["doc_id", "text"]))
    classes = cut_lineage(profiles.filter("n > 0").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("n").alias("n"), F.first("outline").alias("outline"))
        .select("*", F.monotonically_increasing_id().alias("cid")))

    rows = keyed.select("text").mapInArrow(partial(_regions, k=k, percent=percent), "region long, f1 long")
    islands = _connected(rows)
    release(keyed.sparkSession)
    clash = classes.groupBy("f1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("f1").alias("node"), F.col("f1").alias("component"))
    islands = islands.unionByName(clash.join(islands, "node", "left_anti"))

    inside = cut_lineage(classes.join(islands, classes["f1"] == islands["node"]).select(
        F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"), "cid", "f1", "f2", "n", "outline", F.col("component").alias("island")))
    inside, above = _take_apart(keyed, inside, k, percent)
    refined = inside.select("island", "cid", "n", "outline").join(above, "island", "left_anti").repartition("island").sortWithinPartitions(
        "island", "cid").mapInArrow(partial(_refine, percent=percent), "cid long, part long")
    refined = refined.unionByName(inside.join(above, "island", "left_semi").select("cid", F.col("island").alias("part")))
    inside = cut_lineage(inside.drop("outline", "island").join(refined, "cid").withColumnRenamed("part", "island"))
    small = measured(inside, 96)
    members = keyed.join(small, keyed["doc_id"].eqNullSafe(small["_id"]) & (keyed["th"] == small["_th"])).select(
        "text", "cid", "f1", "f2", "island").mapInArrow(partial(_sets, k=k), "island long, cid long, members binary")
    members = cut_lineage(members)
    big = cut_lineage(inside.groupBy("island").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
                      .filter((F.col("c") > island_docs) | ((F.col("s") > 512 * island_docs) & (F.col("c") > 4)))
                      .select("island", F.greatest(F.lit(2), F.least(F.lit(island_docs // 2), F.floor(F.col("c") * (256 * island_docs) / F.col("s")))).alias("per")))
    big = measured(big, 48)
    plain = members.join(big, "island", "left_anti").select(F.col("island").alias("grp"), "cid", "members", F.col("cid").alias("known"))
    large = members.join(big, "island")
    links, blocks = _cut_islands(large, percent)
    cut = blocks.join(large.select("cid", "members"), "cid").select("grp", "cid", "members", "known")
    spanning = plain.unionByName(cut).repartition("grp").sortWithinPartitions("grp", "cid").mapInArrow(
        partial(_join_groups, percent=percent), "a long, b long")
    comp = connected_components(spanning.unionByName(links))

    named = classes.select("f1", "f2", "cid", "rep").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("f1", "f2", "component", "component_id")
    return profiles.join(named, ["f1", "f2"], "left").select(
        "doc_id", "th", "n", "component", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, island_docs: int = 4096) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    return jaccard_classes(docs, k, percent, island_docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns.

    Of each group of linked documents the one with the smallest doc_id stays (null ids come last,
    equal ids by the hash of the text); of fully equal rows one stays; documents without words stay.
    Only ids and text hashes of the rows to drop are joined to the texts.
    """
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("th").alias("t"))
    rows = cut_lineage(jaccard_classes(docs, k, percent).filter("n > 0").select("doc_id", "th", "component", place.alias("place")))
    kept = rows.groupBy("component").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first != last")
    drop = cut_lineage(rows.join(kept, "component").filter("place != first").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    same = cut_lineage(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))

    docs, back = numbered(docs)

    def at(d: DataFrame):
        return docs["doc_id"].eqNullSafe(d["_id"]) & (F.xxhash64(docs["text"]) == d["_th"])

    out = docs.join(measured(drop, 48), at(drop), "left_anti")
    if same.isEmpty():
        return back(out)
    twice = out.join(measured(same, 48), at(same), "left_semi").withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"]).drop("_th")
    return back(out.join(measured(same, 48), at(same), "left_anti").unionByName(twice))
