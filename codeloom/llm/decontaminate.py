"""Benchmark decontamination by a broadcast set of normalised n-grams.

Benchmark items are cut into windows of 8 normalised words (an item of fewer words is one window). The
set of their hashes is broadcast to the executors, which slide over the windows of every document; each
hit is verified word by word, so no hash collision counts. Hit spans, or whole documents, are removed.

The set is broadcast only up to BLOCK bytes of benchmark text: sorted arrays of 20 bytes a window, and the items' words once. For a
larger benchmark only a sieve of 2 to the SIEVE bits goes out; windows that pass it are joined, with their words, to a table of the benchmark's windows. Either way the
documents are scanned for windows once.

Null and empty texts have no words and no hits. A null benchmark text has no windows, an empty benchmark hits nothing, and items with a null item_id are left out. Repeated items
count once for each item id. A text of any length is scanned whole. Columns of the documents pass through; those with the names of added
columns are replaced. Repeated rows each get their hits.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import ALNUM, Words, covered, mix, pieces

WINDOW = 8
#: Most bytes of benchmark text in a broadcast set, and the bits of the sieve beyond that, as a power of two.
BLOCK, SIEVE = 16 << 20, 27
_ADDED = "n_words long, hits array<struct<first:int,last:int>>, items array<string>"
_ARROW = {"n_words": pa.int64(), "hits": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), "items": pa.list_(pa.string())}


def _normal(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a piece with one space between (bytes), and where each word begins and ends in that."""
    kept = np.zeros(len(w.data) + 1, bool)
    kept[:-1] = ALNUM[w.data]
    apart = w.ends[~kept[w.ends]]
    kept[apart] = True
    body = np.append(w.data, np.uint8(0x20))
    body[apart] = 0x20
    place = np.concatenate(([0], np.cumsum(kept)))
    return body[kept], place[w.starts], place[w.starts] + (w.ends - w.starts)


def _own_windows(w: Words, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first words, hashes, rows) of the windows of benchmark items: of `window` words, or of all words where there are fewer."""
    counts = w.counts()
    for length in sorted({min(window, int(c)) for c in counts if c}):
        first, h = w.windows(length)
        row = w.row_of()[first]
        whole = counts[row] >= window if length == window else counts[row] == length
        yield length, first[whole], h[whole], row[whole]


class Grams:
    """Windows of benchmark items by length: sorted hashes, the words of each hash, and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        bodies, found, at = [], defaultdict(list), 0
        for a, _, data, offsets in pieces(pa.array([t for _, t in items], pa.string())):
            w = Words(data, offsets, ALNUM, lower=True)
            body, starts, ends = _normal(w)
            for length, first, h, row in _own_windows(w, window):
                found[length].append((h, (at + starts[first]).astype(np.int64), (at + ends[first + length - 1]).astype(np.int64), (a + row).astype(np.int32)))
            bodies.append(body)
            at += len(body)
        self.body = np.concatenate(bodies).tobytes() if bodies else b""
        self.by = {length: self._grouped(*(np.concatenate(x) for x in zip(*parts, strict=True))) for length, parts in found.items()}

    def _grouped(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes, starts, ends, first places, items) of distinct windows: those of one hash lie side by side, and are one only if their words are equal."""
        order = np.lexsort((item, h))
        h, start, end, item = h[order], start[order], end[order], item[order]
        fresh = np.ones(len(h), bool)
        moved: list[tuple[int, int]] = []  # windows whose hash, but not whose words, equal an earlier one's
        head = 0
        for i in (np.flatnonzero(h[1:] == h[:-1]) + 1).tolist():
            if h[head] != h[i]:
                head = i - 1
            if self.body[start[i] : end[i]] == self.body[start[head] : end[head]]:
                fresh[i] = False
            else:
                moved.append((head, i))
        if moved:  # so rare that each such window may stand for itself
            last = np.array([i for _, i in moved])
            rest = np.setdiff1d(np.arange(len(h)), last)
            parts = [(x[rest], x[last]) for x in (h, start, end, item, fresh)]
            order = np.argsort(np.concatenate(parts[0]), kind="stable")
            h, start, end, item, fresh = (np.concatenate(x)[order] for x in parts)
        heads = np.flatnonzero(fresh)
        return h[heads], start[heads].astype(np.uint32), end[heads].astype(np.uint32), np.append(heads, len(h)).astype(np.uint32), item

    def _sieve(self, length: int) -> np.ndarray:
        """Made anew in each process: it is quicker to build than to send."""
        made = self.__dict__.setdefault("_sieves", {})
        if length not in made:
            sieve = np.zeros(1 << 20, bool)
            sieve[self.by[length][0] >> np.uint64(44)] = True
            made[length] = sieve
        return made[length]

    def hits(self, w: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, number of words, item ids) of every verified occurrence."""
        out = []
        for length, (keys, start, end, places, item) in self.by.items():
            first, h = w.windows(length)
            near = self._sieve(length)[h >> np.uint64(44)]
            first, h = first[near], h[near]
            at = np.searchsorted(keys, h)
            same = keys[np.minimum(at, len(keys) - 1)] == h
            for i, k in zip(first[same].tolist(), at[same].tolist(), strict=True):
                words, x = w.text(i, i + length), keys[k]
                while k < len(keys) and keys[k] == x:
                    if self.body[start[k] : end[k]] == words:
                        out.append((i, length, [self.ids[j] for j in item[places[k] : places[k + 1]].tolist()]))
                        break
                    k += 1
        return out


def _scan(sent, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            counts: list[np.ndarray] = []
            hits: list[list] = [[] for _ in range(len(texts))]
            items: list[list] = [[] for _ in range(len(texts))]
            for a, _, data, offsets in pieces(texts):
                w = Words(data, offsets, ALNUM, lower=True)
                counts.append(w.counts())
                by_row = defaultdict(list)
                found = grams.hits(w)
                rows = np.searchsorted(w.rows, [i for i, _, _ in found], "right") - 1
                for r, hit in zip(rows.tolist(), found, strict=True):
                    by_row[r].append(hit)
                for r, own in by_row.items():
                    base, n = int(w.rows[r]), int(w.rows[r + 1] - w.rows[r])
                    mask = np.zeros(n, bool)
                    for length in {x[1] for x in own}:
                        mask |= covered(np.array([i - base for i, k, _ in own if k == length]), length, n)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    hits[a + r] = [{"first": int(x), "last": int(y) - 1} for x, y in edge.reshape(-1, 2)]
                    items[a + r] = sorted({s for _, _, found_items in own for s in found_items})
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in _ARROW]
            added = {"n_words": np.concatenate(counts) if counts else [], "hits": hits, "items": items}
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(added[k], t) for k, t in _ARROW.items()], [n for n, _ in kept] + [*_ARROW])

    return scan


def _windows_of_items(window: int):
    """(size, h, words, item) of every window of items (item, text)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, ALNUM, lower=True)
                for length, first, h, row in _own_windows(w, window):
                    yield _rows([length] * len(first), h, [w.text(i, i + length) for i in first.tolist()], pa.array([ids[a + r] for r in row.tolist()], pa.string()), "item")

    return windows


def _rows(sizes: list, h: np.ndarray, words: list[bytes], last: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(h.view(np.int64)), pa.array(words, pa.binary()), last], ["size", "h", "words", name])


def _bit(h: np.ndarray, length: int) -> np.ndarray:
    return (mix(h, length) >> np.uint64(64 - SIEVE)).astype(np.int64)


def _sieves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A compressed sieve of all windows (size, h) of a task, and their sizes."""
    sieve, sizes = np.zeros(1 << SIEVE, bool), set()
    for batch in batches:
        size, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for length in np.unique(size).tolist():
            sizes.add(length)
            sieve[_bit(h[size == length], length)] = True
    if sizes:
        yield pa.RecordBatch.from_arrays([pa.array([sorted(sizes)], pa.list_(pa.int32())), pa.array([zlib.compress(np.packbits(sieve).tobytes(), 1)], pa.binary())], ["sizes", "sieve"])


def _windows_of_docs(sent):
    """(size, h, words, key, first) of the windows of texts (key, text) that pass the sieve."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, packed = sent.value
        sieve = np.frombuffer(packed, np.uint8)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, _, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, ALNUM, lower=True)
                row_of = w.row_of()
                for length in sizes:
                    first, h = w.windows(length)
                    bit = _bit(h, length)
                    near = (sieve[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                    first, h = first[near], h[near]
                    row = row_of[first]
                    got = _rows([length] * len(first), h, [w.text(i, i + length) for i in first.tolist()], pa.array([keys[a + r] for r in row.tolist()], pa.string()), "key")
                    yield got.append_column("first", pa.array((first - w.rows[row]).astype(np.int32)))

    return windows


def _joined(docs: DataFrame, items: DataFrame, text: str, window: int) -> DataFrame:
    """scan() for a benchmark of any size: equal texts count as one until the end."""
    spark = docs.sparkSession
    grams = _store.cut(items.mapInArrow(_windows_of_items(window), "size int, h long, words binary, item string").distinct(), "benchmark-windows")
    sizes, sieve = set(), np.zeros((1 << SIEVE) // 8, np.uint8)
    for r in grams.select("size", "h").mapInArrow(_sieves, "sizes array<int>, sieve binary").toLocalIterator():  # one task's at a time
        sizes |= set(r["sizes"])
        sieve |= np.frombuffer(zlib.decompress(r["sieve"]), np.uint8)
    sent = spark.sparkContext.broadcast((sorted(sizes), sieve.tobytes()))
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    near = _store.cut(keyed.select("__key", text).mapInArrow(_windows_of_docs(sent), "size int, h long, words binary, key string, first int").distinct(), "near-windows")
    on = ["size", "h", "words"]
    hit = near.join(grams.select(on).distinct(), on, "left_semi").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("size") - 1).alias("last")))).alias("spans"))
    named = near.select("key", *on).distinct().join(grams, on).select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    runs = hit.join(named, "key").select(F.col("key").alias("__key"), _united(F.col("spans")).alias("hits"), "items")
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.size(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return keyed.join(runs, "__key", "left").select(*docs.columns, n_words.alias("n_words"), none("hits", "array<struct<first:int,last:int>>"), none("items", "array<string>"))


def _united(spans: F.Column) -> F.Column:
    """Sorted spans with those that touch as one."""
    kind = "array<struct<first:int,last:int>>"

    def step(acc: F.Column, s: F.Column) -> F.Column:
        touches = (F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1)
        longer = F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["last"], s["last"]).alias("last"))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s))).cast(kind)

    return F.aggregate(spans.cast(kind), F.array().cast(kind), step)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, hits (runs of hit words, by index) and items (ids of the items with windows in the text, as sorted strings). benchmark has item_id and text."""
    spark = docs.sparkSession
    _store.arrow(spark)
    docs = docs.drop(*_ARROW)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("item").isNotNull())
    if items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] > block:
        return _joined(docs, items, text, window)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), _ADDED])
    grams = Grams([(r["item"], r["text"]) for r in items.orderBy("item", "text").collect()], window)
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(grams), text), schema)


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", items: int = 2, spans: bool = True) -> DataFrame:
    """docs without those that hold windows of `items` or more benchmark items; from the others' texts, hit words and what stands between them are removed if `spans`."""
    names = docs.columns
    docs, clash = _store.aside(docs, list(_ARROW))
    seen = scan(docs, benchmark, text).where(F.size("items") < items)
    if not spans:
        return _store.back(seen, clash, names)
    whole = seen.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, hits = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("hits")).to_pylist()
            for i, (t, runs) in enumerate(zip(texts, hits, strict=True)):
                if runs:
                    data = t.encode()
                    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM, lower=True)
                    kept, done = [], 0
                    for s in runs:
                        kept.append(data[done : w.starts[s["first"]]])
                        done = int(w.ends[s["last"]])
                    texts[i] = b"".join([*kept, data[done:]]).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return _store.back(seen.mapInArrow(strip, whole), clash, names)
