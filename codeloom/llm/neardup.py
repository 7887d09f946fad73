"""Near duplicates by an LSH forest over MinHash signatures.

Each document's set of word shingles gets TREES signatures of DEPTH lanes. For each tree, all signatures
are sorted, across the cluster, and a document's first candidates are the neighbours within REACH places
that share LEAST lanes or more as a prefix. Where a region (the rows of a tree with the same first LEAST lanes)
is sparse, that is everyone in it; where it is dense, it is those with the longest common prefixes, so the
depth follows the region. Candidates must also agree in enough short lanes, and are then confirmed on
the full sets of 64-bit shingle hashes.

A dense region whose rows are one component needs no more. In one that holds several, rows outside its largest
component then meet every row of the region, with their full sets, in blocks of bounded size (so do regions that lie on the edge of two partitions, whose
neighbours were parted). A pair meets in the first tree where it shares a region, and a block gives only links that join
components, not all its pairs. So a pair of linked documents is missed only if they share no region of the later trees, or
agree in too few lanes: at similarity 0.8 about one in ten million, and fewer above it.

Equal sets are first folded into one row by a partial aggregate. A few trees come first; of their
candidates, each document's most alike are confirmed, and their components found: these trees only make groups of
copies one early. The later trees, which alone see every pair, take neighbours in sparse regions and blocks in dense ones, and
pass over pairs that are already connected, so a large group of copies yields few more pairs. Links
and components stay in tables, which are deleted once nothing reads them.

Null, empty and blank texts have no shingles, and link with nothing. Rows with a null doc_id take no
part and have a null component. Rows that repeat a doc_id have the component of their own text, and if their texts differ,
links of that doc_id are confirmed on the set that sorts first. Other columns are not carried. A text
of any length is a set of its own, held whole by one worker. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._components import components
from ._text import NOT_SPACE, Words, mix, pieces

TREES, DEPTH, LEAST, REACH = 32, 8, 3, 8
#: Short lanes, and how many must agree: 24 of 48 is over five standard deviations below similarity 0.8.
SHORT, AGREE = 48, 24
#: Candidates of a document that are confirmed first, and trees that propose them.
FIRST, EARLY = 3, 8
#: Of all lanes, how many must agree in a dense region: over five standard deviations below similarity 0.8. Rows, and bytes of sets, of a block there.
FULL, BLOCK, BYTES = 170, 1024, 8 << 20

_rng = np.random.default_rng(7919)
_FLIP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_STEP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row bounds, hashes) of pieces: the distinct shingles of each row, sorted. A text of fewer words is one shingle of all of them."""
    for a, b, data, offsets in pieces(texts):
        w = Words(data, offsets, NOT_SPACE, lower=True)
        n, row_of = w.counts(), w.row_of()
        first, h = w.windows(size)
        rows = row_of[first]
        for short in range(1, size):
            if (n == short).any():
                f, x = w.windows(short)
                fits = n[row_of[f]] == short
                rows, h = np.concatenate((rows, row_of[f][fits])), np.concatenate((h, mix(x[fits], short)))
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
        yield a, np.searchsorted(rows, np.arange(b - a + 1)), h


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers whose high bits depend on all bits. Minima of large sets are small numbers, with high bits of 0."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _sign(size: int):
    """doc_id, n, key (equal for equal sets) and sig: the lanes of all trees (high 16 bits of each spread minimum), then the short lanes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for _, bounds, h in sets_of(batch.column(1), size):
                n = np.diff(bounds)
                has = np.flatnonzero(n)
                lanes = np.zeros((len(n), TREES * DEPTH), np.uint32)
                key = np.zeros((len(n), 2), np.uint64)
                if len(has):
                    starts = bounds[:-1][has]
                    x = (h >> np.uint64(32)).astype(np.uint32)
                    for k in range(TREES * DEPTH):
                        lanes[has, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _STEP[k], starts)
                    key[has, 0] = np.add.reduceat(h, starts)
                    key[has, 1] = np.add.reduceat(mix(h, 5), starts)
                counts.append(n)
                keys += [r.tobytes() for r in key]
                every = np.arange(SHORT) * (TREES * DEPTH // SHORT)
                body = np.concatenate(((_spread(lanes) >> np.uint32(16)).astype(">u2").view(np.uint8).reshape(len(n), -1), (lanes[:, every] & np.uint32(0xFF)).astype(np.uint8)), axis=1)
                sigs += [r.tobytes() for r in body]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return sign


#: An entry sorts by tree, then lanes; after them come short lanes, size, root and id.
_HEAD = 1 + 2 * DEPTH
_ENTRY = _HEAD + SHORT + 24


def _plant(trees: range):
    """An entry for each tree, of rows (rep, n, sig, root)."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(rows, -1)
                entry = np.zeros((rows, _ENTRY), np.uint8)
                entry[:, _HEAD : _HEAD + SHORT] = sig[:, 2 * TREES * DEPTH :]
                for at, c in ((-24, 1), (-16, 3), (-8, 0)):
                    entry[:, at : (at + 8) or None] = batch.column(c).to_numpy().astype(">i8").view(np.uint8).reshape(rows, 8)
                for t in trees:
                    entry[:, 0] = t
                    entry[:, 1:_HEAD] = sig[:, 2 * t * DEPTH : 2 * (t + 1) * DEPTH]
                    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_ENTRY), rows, [None, pa.py_buffer(entry.tobytes())])
                    yield pa.RecordBatch.from_arrays([body.cast(pa.binary())], ["entry"])

    return plant


def _number(e: np.ndarray, at: int) -> np.ndarray:
    return e[:, at : (at + 8) or None].copy().view(">i8").ravel().astype(np.int64)


class _Regions:
    """Rows by region and root, of sorted entries that come batch by batch. Regions that end inside a batch and hold REACH + 1 rows at most are passed over, as their rows are all neighbours."""

    def __init__(self, reach: int):
        self.reach, self.first = reach, True
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, e: np.ndarray, roots: np.ndarray, sizes_of: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """(region, root, rows, shingles, edge) so far, and which rows are in a region of over REACH + 1. The last region of a batch waits, as it may be the last of the partition."""
        done = self.held
        region = np.zeros((len(e), 8), np.uint8)
        region[:, 1:] = e[:, : 1 + 2 * LEAST]
        region = region.view(">i8").ravel().astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        sizes = np.diff(np.append(starts, len(e)))
        told = sizes > self.reach + 1
        dense = np.repeat(told, sizes)
        told[[0, -1]] = True
        rows = np.repeat(told, sizes)
        pairs, which, n = np.unique(np.stack([region[rows], roots[rows]]), axis=1, return_inverse=True, return_counts=True)
        shingles = np.bincount(which.ravel(), sizes_of[rows], len(n)).astype(np.int64)
        last = pairs[0] == region[-1]
        edge = (pairs[0] == region[0]) if self.first else np.zeros(len(n), bool)
        self.first = False
        done.append((pairs[0][~last], pairs[1][~last], n[~last], shingles[~last], edge[~last]))
        self.held = [(pairs[0][last], pairs[1][last], n[last], shingles[last], edge[last])]
        return done, dense

    def end(self) -> list[tuple[np.ndarray, ...]]:
        return [(*x, np.ones(len(x[0]), bool)) for *x, _ in self.held]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("region", pa.int64()), ("root", pa.int64()), ("rows", pa.int64()), ("shingles", pa.int64()), ("edge", pa.bool_())])


def _neighbours(reach: int, sparse: bool):
    """Pairs of ids (a < b) of different roots with the number of short lanes that agree, of sorted entries, and with a null a the regions that neighbours don't cover. With `sparse`, pairs in regions that are dense are left to those who take the regions. The last `reach` rows of a batch are looked at again with the next."""

    def batch_of(pairs: list, regions: list) -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        g, r, m, k, edge = (np.concatenate(x) for x in zip(*regions, strict=True)) if regions else (np.zeros(0, np.int64),) * 5
        none = lambda k, t: pa.nulls(k, t)
        columns = [
            pa.concat_arrays([pa.array(x.astype(d), t), none(len(g), t)])
            for x, d, t in ((a, np.int64, pa.int64()), (b, np.int64, pa.int64()), (n, np.int32, pa.int32()))
        ] + [
            pa.concat_arrays([none(len(a), t), pa.array(x.astype(d), t)])
            for x, d, t in ((g, np.int64, pa.int64()), (r, np.int64, pa.int64()), (m, np.int64, pa.int64()), (k, np.int64, pa.int64()), (edge, bool, pa.bool_()))
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, _ENTRY), np.uint8)
        regions = _Regions(reach)
        for batch in batches:
            if not batch.num_rows:
                continue
            e = np.concatenate((tail, np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _ENTRY)))
            fresh = len(tail)
            sizes, roots, ids = (_number(e, at) for at in (-24, -16, -8))
            short = e[:, _HEAD : _HEAD + SHORT]
            told, dense = regions.add(e[fresh:], roots[fresh:], sizes[fresh:])
            dense = np.concatenate((np.zeros(fresh, bool), dense & sparse))
            found = []
            for s in range(1, reach + 1):
                if len(e) <= s:
                    break
                i = np.flatnonzero((e[s:, : 1 + 2 * LEAST] == e[:-s, : 1 + 2 * LEAST]).all(axis=1))
                i = i[(i + s >= fresh) & (roots[i] != roots[i + s]) & ~dense[i + s]]
                small, large = np.minimum(sizes[i], sizes[i + s]), np.maximum(sizes[i], sizes[i + s])
                i = i[100 * small >= 80 * large]
                agree = (short[i] == short[i + s]).sum(axis=1)
                i, agree = i[agree >= AGREE], agree[agree >= AGREE]
                found.append((np.minimum(ids[i], ids[i + s]), np.maximum(ids[i], ids[i + s]), agree))
            tail = e[-reach:]
            yield batch_of(found, told)
        yield batch_of([], regions.end())

    return neighbours


def _proposed(reps: DataFrame, trees: range, reach: int, sparse: bool, name: str) -> DataFrame:
    """What the trees give for reps (rep, n, sig, root): pairs and regions, as _neighbours says."""
    entries = reps.select("rep", "n", "sig", "root").mapInArrow(_plant(trees), "entry binary")
    return _store.cut(entries.repartitionByRange("entry").sortWithinPartitions("entry").mapInArrow(_neighbours(reach, sparse), "a long, b long, agree int, region long, root long, rows long, shingles long, edge boolean"), name)


def _pairs(proposed: DataFrame) -> DataFrame:
    return proposed.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _regions_of(trees: range):
    """(rep, root, regions): the region of each tree that a row lies in."""

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            out = np.zeros((batch.num_rows, len(trees), 8), np.uint8)
            for i, t in enumerate(trees):
                out[:, i, 1] = t
                out[:, i, 2:] = sig[:, 2 * t * DEPTH : 2 * t * DEPTH + 2 * LEAST]
            flat = pa.array(out.view(">i8").ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(trees)), flat)], ["rep", "root", "regions"])

    return regions


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _meet(percent: int, first: int):
    """Rows of one block against rows of another: links (u, v) of roots, at most one fewer than there are roots.

    A pair is looked at in its first shared tree, from `first` on: in an earlier one its rows were neighbours, or met there, or had one root.
    """

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("left")
        left, right = table.filter(side), table.filter(pc.invert(side))
        links: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            number = lambda t, c: t.column(c).to_numpy()
            lanes = lambda t: np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)[:, : 2 * TREES * DEPTH]
            (x, y), tree = (lanes(left), lanes(right)), int(table.column("region")[0].as_py() >> 48)
            heads = [z.reshape(len(z), TREES, 2 * DEPTH)[:, first:tree, : 2 * LEAST] for z in (x, y)]
            low = [np.ascontiguousarray(z[:, 1::2]) for z in (x, y)]
            sizes, own_sizes = number(left, "n"), number(right, "n").tolist()
            flat = left.column("set").combine_chunks()
            flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
            values, bounds = flat.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(flat).to_numpy())))
            names, classes = np.unique(np.concatenate((number(left, "root"), number(right, "root"))), return_inverse=True)
            now, own = classes[: len(x)].copy(), classes[len(x) :].copy()
            sets = right.column("set")
            for i, n in enumerate(own_sizes):
                near = np.flatnonzero((now != own[i]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                near = near[(low[0][near] == low[1][i]).sum(axis=1) >= FULL]
                if len(near) and tree > first:
                    near = near[~(heads[0][near] == heads[1][i]).all(axis=2).any(axis=1)]
                mine = np.sort(sets[i].values.to_numpy()) if len(near) else None
                for part in np.array_split(near, -(-len(near) // 256)) if len(near) else ():
                    every = np.concatenate([values[bounds[j] : bounds[j + 1]] for j in part])
                    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                    both = np.add.reduceat(mine[at] == every, np.concatenate(([0], np.cumsum(np.diff(bounds)[part])[:-1])), dtype=np.int64)
                    for j in part[100 * both >= percent * (sizes[part] + n - both)].tolist():
                        if now[j] != own[i]:
                            u, v = int(names[now[j]]), int(names[own[i]])
                            links.append((max(u, v), min(u, v)))
                            old, new = now[j], own[i]
                            now[now == old] = new
                            own[own == old] = new
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())}, schema=_LINKS)

    return meet


def _dense(plain: DataFrame, reps: DataFrame, regions: DataFrame, roots: DataFrame, trees: range, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """roots (rep, root) after the links in regions that neighbours don't cover.

    regions has (region, root, rows, shingles, edge) with the roots of the trees' time, reps (rep, n, sig). Rows outside a region's largest root
    meet all its rows: these lie in `every` blocks, those in `few`, and a block of each kind meets in one task.
    """
    now = roots.select(F.col("rep").alias("root"), F.col("root").alias("top"))
    by_root = regions.join(now, "root").groupBy("region", "top").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max("edge").alias("edge"))
    by_region = by_root.groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max("edge").alias("edge"), F.count("*").alias("roots"), F.max(F.struct("rows", "shingles", "top")).alias("most"))
    open_regions = by_region.where((F.col("roots") > 1) & (F.col("edge") | (F.col("rows") > REACH + 1)))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / block, shingles * 8 / BYTES)).cast("long")
    every, few = blocks(F.col("rows"), F.col("shingles")), blocks(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles"))
    open_regions = _store.cut(open_regions.select("region", F.col("most.top").alias("largest"), every.alias("every"), few.alias("few")), "regions")
    if open_regions.isEmpty():
        _store.drop(open_regions)
        return roots
    placed = reps.join(roots, "rep").select("rep", "root", "sig").mapInArrow(_regions_of(trees), "rep long, root long, regions array<long>")
    members = _store.cut(placed.select("rep", "root", F.explode("regions").alias("region")).join(open_regions, "region"), "members")
    sets = _gathered(plain, members.select(F.col("rep").alias("id")).distinct(), shingle)
    i, j = F.pmod(F.xxhash64("rep"), "every"), F.pmod(F.xxhash64("rep", F.lit(1)), "few")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    left = F.transform(upto("few"), lambda b: F.struct(i.alias("i"), b.alias("j"), F.lit(True).alias("left")))
    right = F.when(F.col("root") != F.col("largest"), F.transform(upto("every"), lambda b: F.struct(b.alias("i"), j.alias("j"), F.lit(False).alias("left")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean>>"))
    whole = reps.select("rep", "n", "sig").join(sets.select(F.col("id").alias("rep"), F.col("shingles").alias("set")), "rep")
    dealt = members.select("rep", "root", "region", F.explode(F.concat(left, right)).alias("to")).join(whole, "rep")
    met = dealt.select("region", "to.i", "to.j", "to.left", "root", "n", "sig", "set").groupBy("region", "i", "j").applyInArrow(_meet(percent, trees.start), "u long, v long")
    links = _store.cut(met, "dense-links")
    _store.drop(open_regions, members, sets)
    return _united(roots, links)


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, values = [np.zeros(1, np.int64)], []
            for _, own, h in sets_of(batch.column(1), size):
                bounds.append(own[1:] + bounds[-1][-1])
                values.append(h)
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select(pairs.columns)


def _gathered(plain: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the documents named in ids (id), as a table. Their texts cross the network once, without a sort: the list of ids is the side that is hashed."""
    needed = plain.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi")
    return _store.cut(needed.mapInArrow(_sets(shingle), "id long, shingles array<long>").groupBy("id").agg(F.min("shingles").alias("shingles")), "shingles")


def _best(pairs: DataFrame) -> DataFrame:
    """Of (a, b, agree), the FIRST most alike of each document."""
    either = pairs.select(F.col("a").alias("me"), "a", "b", "agree").union(pairs.select(F.col("b").alias("me"), "a", "b", "agree"))
    best = either.withColumn("place", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("agree"), "a", "b"))).where(F.col("place") <= FIRST)
    return best.select("a", "b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, agree, a_root, b_root) of pairs whose roots (rep, root) differ."""
    of = lambda side: roots.select(F.col("rep").alias(side), F.col("root").alias(f"{side}_root"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("a_root") != F.col("b_root"))


def _joined(plain: DataFrame, pairs: DataFrame, roots: DataFrame, shingle: int, percent: int) -> DataFrame:
    """roots after the links among pairs (a, b) of different roots; a table."""
    asked = _store.cut(_apart(pairs.select("a", "b"), roots), "asked")
    if asked.isEmpty():
        _store.drop(asked)
        return roots
    sets = _gathered(plain, asked.select(F.col("a").alias("id")).union(asked.select(F.col("b").alias("id"))).distinct(), shingle)
    links = _store.cut(_confirmed(asked, sets, percent).select(F.col("a_root").alias("u"), F.col("b_root").alias("v")), "links")
    _store.drop(sets)
    _store.drop(asked)
    return _united(roots, links)


def _united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (rep, root) after links (u, v) between roots; a table. Both are deleted."""
    met = components(links)
    found = met.select(F.col("node").alias("root"), F.col("component").alias("top"))
    out = _store.cut(roots.join(found, "root", "left").select("rep", F.coalesce("top", "root").alias("root")), "roots")
    _store.drop(links, met, roots)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of docs (doc_id long, text). Two documents are linked if their sets of `shingle`-word shingles have a Jaccard similarity of `percent` or more (80 or more, which LEAST, AGREE and FULL are made for)."""
    if percent < 80:
        raise ValueError("the forest is tuned for similarities of 0.8 or more")
    spark = docs.sparkSession
    _store.arrow(spark)
    early, late = range(EARLY), range(EARLY, TREES)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = _store.cut(plain.mapInArrow(_sign(shingle), "doc_id long, n long, key binary, sig binary"), "signatures")
    base = _store.cut(signed.select("doc_id", "n", "key"), "keys")
    reps = _store.cut(signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("key", "n", "sig").agg(F.min("doc_id").alias("rep")), "sets")
    _store.drop(signed)
    roots = _store.cut(reps.select("rep", F.col("rep").alias("root")).distinct(), "roots")
    proposed = _proposed(reps.withColumn("root", F.col("rep")), early, REACH, False, "early")
    roots = _joined(plain, _best(_pairs(proposed)), roots, shingle, percent)
    _store.drop(proposed)
    proposed = _proposed(reps.join(roots, "rep"), late, REACH, True, "late")
    roots = _joined(plain, _pairs(proposed), roots, shingle, percent)
    roots = _dense(plain, reps, proposed.where(F.col("a").isNull()).select("region", "root", "rows", "shingles", "edge"), roots, late, shingle, percent)
    _store.drop(proposed)
    by_set = reps.select("key", "rep").join(roots, "rep").select("key", F.col("root").alias("component_id"))
    # A set that a third of all documents have makes this join's left side uneven; AQE splits it.
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_set, "key", "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
