"""Substring dedup over a log-structured index of window fingerprints.

Every run of 13 words gets a 64-bit fingerprint (48 bits of one hash and 16 of an independent one, which
verifies the first). The index is a folder of sorted immutable runs and of manifests, of which the newest says which
runs count. A batch of documents is dealt into groups of bounded bytes. Each group
sorts its fingerprints, split by their first bits; a merge step for each split meets the fingerprints
of all groups and the runs of earlier batches, and tells each group which of its fingerprints were in an earlier batch,
or begin in a smaller document of this one. The group, which has its texts at hand, then removes the covered words.
Fingerprints that are new become a run; once FAN runs of a tier are there, they are compacted into one of the next tier.

A window that a third of all documents share costs one entry for each group, not for each document,
so no task gets all its occurrences. Splits and groups grow in number with the batch and the index.

Earlier batches come before later ones, whatever their ids: what was given out can't be taken back. Within a batch
the smaller doc_id comes first. A batch with a name that the index knows is not added again: its result is
made from what the index told it the first time, so a job that fails can be run once more.

Null texts have no words; texts of fewer than 13 words lose none. Rows that repeat a doc_id count as one
document for each other, and equal rows are folded before they are dealt. A null doc_id comes before all others. Other columns are not carried. A text
of any length is held whole by one worker. An empty batch gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._text import Words, covered, pieces

WINDOW = 13
#: Bytes of text in a group, about, and for batches of over SMALL bytes; two or three groups' words are in a worker's memory at once.
GROUP, LARGE, SMALL = 8 << 20, 32 << 20, 1 << 40
#: Bits of a fingerprint that choose its split, at least, and bytes of text that a split is meant for, about; more text gets more splits.
BITS, SPLIT = 8, 16 << 20
#: Runs of a tier that are compacted into one.
FAN = 4
_NULL = -(2**63)
_GROUPED = "split int, grp long, ids binary, prints binary, owners binary"
_RUN = "split int, prints binary"


def _prints(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    first, h = w.windows(window)
    _, check = w.windows(window, 2)
    return first, (h & np.uint64(0xFFFFFFFFFFFF0000)) | (check >> np.uint64(48))


def _planes(prints: np.ndarray) -> bytes:
    """Sorted fingerprints of one split without their first byte, one byte plane after another: the high planes then compress well."""
    return np.ascontiguousarray(prints.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T).tobytes()


def _from_planes(body: bytes, split: int, bits: int) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(7, -1)
    full = np.empty((planes.shape[1], 8), np.uint8)
    full[:, 0] = split >> (bits - 8)
    full[:, 1:] = planes.T
    return full.view(">u8").ravel().astype(np.uint64)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_NULL).to_numpy()


def _grouped(table: pa.Table, window: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, window starts, fingerprints, row of each window) of pieces of a table."""
    column = table.column("text").combine_chunks()
    for a, _, data, offsets in pieces(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)):
        w = Words(data, offsets)
        first, prints = _prints(w, window)
        yield a, w, first, prints, a + w.row_of()[first]


def _emit(window: int, bits: int):
    """A group's runs: for each split, its distinct fingerprints in order, and which document of the group is the smallest with each."""

    def emit(table: pa.Table) -> pa.Table:
        ids = _ids(table)
        distinct = np.unique(ids)
        place = np.searchsorted(distinct, ids).astype(np.uint32)
        found = [(p, place[r]) for _, _, _, p, r in _grouped(table, window)]
        prints = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        docs = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint32)
        by_doc = np.argsort(docs, kind="stable")
        prints, docs = prints[by_doc], docs[by_doc]
        order = np.argsort(prints, kind="stable")
        prints, docs = prints[order], docs[order]
        new = np.ones(len(prints), bool)
        new[1:] = prints[1:] != prints[:-1]
        prints, docs = prints[new], docs[new]
        splits, starts = np.unique(prints >> np.uint64(64 - bits), return_index=True)
        ends = np.append(starts, len(prints))[1:].tolist()
        kind = np.uint16 if len(distinct) <= 0x10000 else np.uint32
        rows = {"split": [], "grp": [], "ids": [], "prints": [], "owners": []}
        grp = table.column("grp")[0].as_py() if len(table) else 0
        for s, a, b in zip(splits.tolist(), starts.tolist(), ends, strict=True):
            own, local = np.unique(docs[a:b], return_inverse=True)
            rows["split"].append(s)
            rows["grp"].append(grp)
            rows["ids"].append(distinct[own].astype("<i8").tobytes())
            rows["prints"].append(_planes(prints[a:b]))
            rows["owners"].append(local.astype(kind).tobytes())
        return pa.table(rows, schema=pa.schema([("split", pa.int32()), ("grp", pa.int64()), ("ids", pa.binary()), ("prints", pa.binary()), ("owners", pa.binary())]))

    return emit


def _open(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and smallest documents of a run's row."""
    prints = _from_planes(row["prints"], row["split"], bits)
    if not len(prints):
        return prints, np.zeros(0, np.int64)
    kind = np.uint16 if len(row["owners"]) == 2 * len(prints) else np.uint32
    return prints, np.frombuffer(row["ids"], "<i8")[np.frombuffer(row["owners"], kind)]


#: Rows of the merge. kind 0: what a group is told, the fingerprints that are not its own; kind 1: the fingerprints that are new.
_MERGED = "kind int, split int, grp long, prints binary"
_MERGED_ARROW = pa.schema([("kind", pa.int32()), ("split", pa.int32()), ("grp", pa.int64()), ("prints", pa.binary())])
#: Stands for the runs of the index among the groups.
_INDEX = -1


def _merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in _MERGED_ARROW.names}

        def add(kind: int, grp: int, prints: np.ndarray) -> None:
            for k, v in zip(out, (kind, split, grp, _planes(prints)), strict=True):
                out[k].append(v)

        rows = table.to_pylist()
        split = rows[0]["split"] if rows else 0
        runs = [(r["grp"], *_open(r, bits)) for r in rows if r["grp"] != _INDEX]
        if runs:
            history = [_from_planes(r["prints"], split, bits) for r in rows if r["grp"] == _INDEX]
            history = np.sort(np.concatenate(history)) if history else np.zeros(0, np.uint64)
            prints = np.concatenate([x for _, x, _ in runs])
            owners = np.concatenate([x for _, _, x in runs])
            source = np.repeat(np.arange(len(runs)), [len(x) for _, x, _ in runs])
            order = np.argsort(prints, kind="stable")
            prints, owners, source = prints[order], owners[order], source[order]
            starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
            sizes = np.diff([*starts.tolist(), len(prints)])
            distinct, known = prints[starts], np.zeros(len(starts), bool)
            if len(history):
                known = history[np.minimum(np.searchsorted(history, distinct), len(history) - 1)] == distinct
            beaten = (owners > np.repeat(np.minimum.reduceat(owners, starts), sizes)) | np.repeat(known, sizes)
            lost, where = prints[beaten], source[beaten]
            by = np.argsort(where, kind="stable")
            lost, where = lost[by], where[by]
            which, first = np.unique(where, return_index=True)
            for s, a, b in zip(which.tolist(), first.tolist(), np.append(first, len(lost))[1:].tolist(), strict=True):
                add(0, runs[s][0], lost[a:b])
            if not known.all():
                add(1, _INDEX, distinct[~known])
        return pa.table(out, schema=_MERGED_ARROW)

    return merge


def _resplit(old: int, new: int):
    """Rows of a run with `old` bits as rows with `new` ones, of which there are as many or more."""

    def resplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits, planes = [], []
            for r in batch.to_pylist():
                prints = _from_planes(r["prints"], r["split"], old)
                own, starts = np.unique(prints >> np.uint64(64 - new), return_index=True)
                for s, a, b in zip(own.tolist(), starts.tolist(), np.append(starts, len(prints))[1:].tolist(), strict=True):
                    splits.append(s)
                    planes.append(_planes(prints[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(splits, pa.int32()), pa.array(planes, pa.binary())], ["split", "prints"])

    return resplit


def _compact(bits: int):
    """The rows of one split of several runs, which have no fingerprint in common, as one."""

    def compact(table: pa.Table) -> pa.Table:
        split = table.column("split")[0].as_py()
        prints = np.sort(np.concatenate([_from_planes(p, split, bits) for p in table.column("prints").to_pylist()]))
        return pa.table({"split": pa.array([split], pa.int32()), "prints": pa.array([_planes(prints)], pa.binary())})

    return compact


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows (doc_id, text) of a batch as one, with their number."""
    for batch in batches:
        seen: dict[tuple, int] = {}
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[row] = seen.get(row, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in seen], pa.int64()), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["doc_id", "text", "copies"])


_RESULT = {
    True: ("doc_id long, n_words long, n_removed long, kept_sha256 string, copies long", pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("copies", pa.int64())])),
    False: ("doc_id long, n_words long, n_removed long, text string, copies long", pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("copies", pa.int64())])),
}


def _remove(window: int, digests: bool, bits: int):
    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        lost = [_from_planes(r["prints"], r["split"], bits) for r in told.to_pylist()]
        lost = np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.uint64)
        ids = _ids(docs)
        copies = docs.column("copies").to_pylist()
        parts = list(_grouped(docs, window))
        every = np.concatenate([p for _, _, _, p, _ in parts]) if parts else np.zeros(0, np.uint64)
        owner = ids[np.concatenate([r for _, _, _, _, r in parts])] if parts else np.zeros(0, np.int64)
        # Within the group: a window goes if the group has a smaller document with it.
        order = np.lexsort((owner, every))
        p, o = every[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
        gone = np.zeros(len(every), bool)
        if len(p):
            gone[order] = o > np.repeat(o[starts], np.diff([*starts.tolist(), len(p)]))
        if len(lost):
            at = np.minimum(np.searchsorted(lost, every), len(lost) - 1)
            gone |= lost[at] == every
        rows: dict[str, list] = {n: [] for n in _RESULT[digests][1].names}
        done = 0
        for a, w, first, prints, _ in parts:
            hit = covered(first[gone[done : done + len(prints)]], window, len(w.starts))
            done += len(prints)
            for i in range(len(w.rows) - 1):
                x, y = int(w.rows[i]), int(w.rows[i + 1])
                keep = x + np.flatnonzero(~hit[x:y])
                body = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True))
                rows["doc_id"].append(None if ids[a + i] == _NULL else int(ids[a + i]))
                rows["copies"].append(copies[a + i])
                rows["n_words"].append(y - x)
                rows["n_removed"].append(y - x - len(keep))
                rows["kept_sha256" if digests else "text"].append(hashlib.sha256(body).hexdigest() if digests else body.decode())
        return pa.table(rows, schema=_RESULT[digests][1])

    return remove


class FingerprintIndex:
    """The fingerprints of all batches so far, in the folder `at`: run-* are the runs, told-* what each batch was told, manifest-* the states.

    A state lists runs (name, tier, bits, bytes of text) and batches. A batch is in the index once the manifest that names it is there, which one of two
    writers can make; runs and answers that no manifest names are left over from jobs that failed, and are not read.
    """

    def __init__(self, spark: SparkSession, at: str, window: int = WINDOW, group: int | None = None, bits: int = BITS, fan: int = FAN):
        self.spark, self.at, self.window, self.group, self.bits, self.fan = spark, at.rstrip("/"), window, group, bits, fan
        if self.state()["window"] != window:
            raise ValueError("the index has windows of another length")

    def state(self) -> dict:
        """The newest manifest; that of an empty index, if there's none."""
        found = [n for n in _store.names(self.spark, self.at) if n.startswith("manifest-")]
        if found:
            return json.loads(_store.read_text(self.spark, f"{self.at}/{found[-1]}"))
        return {"version": 0, "window": self.window, "runs": [], "batches": {}}

    def _commit(self, state: dict) -> None:
        state["version"] += 1
        _store.write_text(self.spark, f"{self.at}/manifest-{state['version']:09d}", json.dumps(state))

    def _history(self, runs: list[dict], bits: int) -> DataFrame | None:
        """(split, prints) of runs, with splits of `bits` bits."""
        out = None
        for r in runs:
            rows = self.spark.read.schema(_RUN).parquet(f"{self.at}/{r['name']}")
            if r["bits"] != bits:
                rows = rows.mapInArrow(_resplit(r["bits"], bits), _RUN)
            out = rows if out is None else out.union(rows)
        return out

    def add(self, docs: DataFrame, digests: bool = False, batch: str | None = None, compact: bool = True) -> DataFrame:
        """doc_id, n_words, n_removed and the kept words (text, or with `digests` their SHA-256) of each row of docs (doc_id, text); what is new goes into the index, as the batch of that name."""
        _store.arrow(self.spark)
        self.spark._jvm.System.gc()  # nothing refers to the shuffle files of the batch before any more, so Spark's cleaner deletes them
        state, batch = self.state(), batch or uuid.uuid4().hex
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        own = state["batches"].get(batch)
        if own is None:
            size, rows, ids = plain.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0)), F.count("*"), F.approx_count_distinct("doc_id")).first()
            total = size + sum(r["bytes"] for r in state["runs"])
            bits = max(self.bits, (total // SPLIT).bit_length(), *(r["bits"] for r in state["runs"]))
            group = self.group or (GROUP if size <= SMALL else LARGE)
            # approx_count_distinct errs by a few hundredths; tables with that many repeated ids are folded.
            own = {"bits": bits, "groups": max(1, -(-size // group)), "fold": ids < 0.8 * rows, "told": f"told-{uuid.uuid4().hex}"}
        grouped = self._dealt(plain, own)
        if batch not in state["batches"]:
            bits = own["bits"]
            rows = grouped.groupBy("grp").applyInArrow(_emit(self.window, bits), _GROUPED)
            history = self._history(state["runs"], bits)
            if history is not None:
                none = F.lit(None).cast("binary")
                rows = rows.union(history.select("split", F.lit(_INDEX).cast("long").alias("grp"), none.alias("ids"), "prints", none.alias("owners")))
            # Written once, as both what groups are told and the new run come from it.
            rows.groupBy("split").applyInArrow(_merge(bits), _MERGED).write.partitionBy("kind").parquet(f"{self.at}/{own['told']}")
            state["batches"][batch] = own
            state["runs"].append({"name": f"{own['told']}/kind=1", "tier": 0, "bits": bits, "bytes": size})
            if "kind=1" not in _store.names(self.spark, f"{self.at}/{own['told']}"):  # nothing was new
                state["runs"].pop()
            self._commit(state)
            if compact:
                self.compact()
        told = self.spark.read.schema("split int, grp long, prints binary").parquet(f"{self.at}/{own['told']}/kind=0") if "kind=0" in _store.names(self.spark, f"{self.at}/{own['told']}") else self.spark.createDataFrame([], "split int, grp long, prints binary")
        out = self._dealt(plain, own).groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_remove(self.window, digests, own["bits"]), _RESULT[digests][0])
        if own["fold"]:
            out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy")
        return out.drop("copies")

    @staticmethod
    def _dealt(plain: DataFrame, own: dict) -> DataFrame:
        """plain with copies and grp, by what a batch's entry says; by id and text, so that rows of one id spread, and each time alike."""
        rows = plain.mapInArrow(_fold, "doc_id long, text string, copies long") if own["fold"] else plain.withColumn("copies", F.lit(1).cast("long"))
        return rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(own["groups"]).cast("long")))

    def compact(self) -> None:
        """Merges the runs of each tier that has FAN of them into one of the next tier."""
        while True:
            state = self.state()
            tiers = [r["tier"] for r in state["runs"]]
            tier = next((t for t in sorted(set(tiers)) if tiers.count(t) >= self.fan), None)
            if tier is None:
                return
            old = [r for r in state["runs"] if r["tier"] == tier]
            bits = max(r["bits"] for r in old)
            name = f"run-{uuid.uuid4().hex}"
            self._history(old, bits).groupBy("split").applyInArrow(_compact(bits), _RUN).write.parquet(f"{self.at}/{name}")
            state["runs"] = [r for r in state["runs"] if r["tier"] != tier] + [{"name": name, "tier": tier + 1, "bits": bits, "bytes": sum(r["bytes"] for r in old)}]
            self._commit(state)
            for r in old:
                _store.remove(self.spark, f"{self.at}/{r['name']}")


#: Batches that a table is taken in.
BATCHES = 4


def dedup(docs: DataFrame, window: int = WINDOW, digests: bool = False, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text) against themselves: ranges of doc_id, in order, go through an index of their own as batches, so that only one batch's shuffles are on disk at once."""
    spark = docs.sparkSession
    at = _store.folder(spark, "window-index")
    index = FingerprintIndex(spark, at, window, fan=2)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Any bounds are right; these make batches about equal.
    bounds = sorted(set(plain.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    bounds = [int(b) for b in bounds]
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = plain
        if low is not None:
            part = part.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where((F.col("doc_id") < high) if low is not None else (F.col("doc_id") < high) | F.col("doc_id").isNull())
        own = index.add(part, digests, compact=high is not None)  # nothing reads the index after the last
        out = own if out is None else out.union(own)
    for r in index.state()["runs"]:  # nothing else will ask this index
        _store.remove(spark, f"{at}/{r['name']}")
    spark._jvm.System.gc()
    return out
