"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string, BPE's encoding of that prefix is unique, and so is its last token. The
encoder stores just that token for each prefix: the last token of a prefix is the one vocabulary
entry t that ends there and whose pairing with the last token of the prefix before it is one that BPE
leaves alone. Appending bytes extends the table exactly, and after an edit only the prefixes from the
edit on change, until the table agrees with the old one again.

Texts are first cut by the split pattern; each match is encoded by itself. A null or empty text has no
tokens. Every string of Unicode text can be encoded, since all single bytes are in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _store

#: Distinct matches whose encodings a worker keeps, in each of two generations; pairs of tokens known to be compatible or not.
CACHE, PAIRS = 200_000, 500_000
_LOCAL: dict[tuple, BPE] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file. A vocabulary has a fixed size (tens of thousands of entries)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class BPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The two tokens whose merge made each token (itself, for single bytes).
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._width = max(ranks.values()) + 1
        self._valid: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: Every end of a token, with its id, or -1 if it isn't one itself.
        self._ends: dict[bytes, int] = {}
        for token in ranks:
            for i in range(len(token) - 1, 0, -1):
                self._ends.setdefault(token[i:], -1)
        self._ends |= ranks
        self._pair: dict[int, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[i] = self._split(token, i)
        # Every pair of tokens that joins to one, by the ids' product code, for the ways to cut each token in two.
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self._pair[a * self._width + b] = i

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of a token: BPE over its bytes, with only lower ranks, leaves two parts."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"token {rank} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE, over the bytes of both, gives just these two tokens: no merge across their border comes before the merges that made them."""
        limit, a, b, fine = 1 << 62, left, right, True
        pair, parts, width = self._pair.get, self.parts, self._width
        while True:
            r = pair(a * width + b)
            if r is not None and r < limit:
                fine = False
                break
            # Undo the later of the two merges next to the border; of equals, the right one came later.
            if a > b:
                limit, part = a, parts[a]
                if part is None:
                    limit, part = b, parts[b]
                    if part is None:
                        break
                    b = part[0]
                    limit += 1
                    continue
                a = part[1]
            else:
                limit, part = b, parts[b]
                if part is None:
                    limit, part = a, parts[a]
                    if part is None:
                        break
                    a = part[1]
                    continue
                b = part[0]
                limit += 1
        if len(self._valid) > PAIRS:
            self._valid.clear()
        self._valid[left * width + right] = fine
        return fine

    def extend(self, data: bytes, last: list[int], old: list[int] | None = None, shift: int = 0) -> list[int]:
        """Adds to `last` the last token of each longer prefix of data, from len(last) bytes on. `old` may be a table of an earlier text with the same bytes from some place on, `shift` bytes later there: once `longest` entries in a row agree with it, the rest is copied."""
        agree, ends, valid, width = 0, self._ends.get, self._valid, self._width
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                t = ends(data[start:end])
                if t is None:  # no token ends in this
                    raise ValueError("no valid token ends here")
                if t >= 0:
                    if start:
                        fine = valid.get(last[start - 1] * width + t)
                        if fine is None:
                            fine = self.compatible(last[start - 1], t)
                        if not fine:
                            continue
                    last.append(t)
                    break
            else:
                raise ValueError("no valid token ends here")
            if old is not None:
                at = end - 1 + shift
                agree = agree + 1 if 0 <= at < len(old) and old[at] == last[-1] else 0
                if agree >= self.longest:
                    last.extend(old[at + 1 :])
                    break
        return last

    def prefixes(self, data: bytes) -> list[int]:
        """The last token of each nonempty prefix."""
        return self.extend(data, [])

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def edited(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The text and table after old[start:end] became new: prefixes up to start stay, those after are found anew only until they agree with the old ones."""
        data = old[:start] + new + old[end:]
        shift = end - start - len(new)
        head = self.extend(data[: start + len(new)], last[:start])
        return data, self.extend(data, head, last, shift)

    def packed(self, piece: str) -> bytes:
        """The ids of one match, as little-endian 32-bit integers."""
        got = self._older.get(piece)
        if got is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else self.tokens(self.prefixes(data))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self._cache) >= CACHE:
                self._older, self._cache = self._cache, {}
            self._cache[piece] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        packed = self.packed
        out, found = [], self.pattern.findall(text)
        for i in range(0, len(found), 5000):  # the cache may be another one after some matches
            cache = self._cache.get
            out.append(b"".join([cache(p) or packed(p) for p in found[i : i + 5000]]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _worker(ranks: dict[bytes, int], pattern: str) -> BPE:
    key = (len(ranks), hash(frozenset(list(ranks.items())[-50:])), pattern)
    if key not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[key] = BPE(ranks, pattern)
    return _LOCAL[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with n_tokens and ids (array<int>); with `digests`, in place of ids the SHA-256 of the packed ids and of the bytes that they decode to, and no text. `vocabulary` is the path of a rank file that the driver reads; its size is fixed, so it is broadcast."""
    spark = docs.sparkSession
    _store.arrow(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    added = {"n_tokens": pa.int64()} | ({"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {"ids": pa.list_(pa.int32())})
    types = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}
    keep = [c for c in docs.columns if c not in added and not (digests and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared.value, pattern)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in added}
            for value in batch.column(batch.schema.get_field_index(text)):
                packed = bpe.encode_packed(value.as_py() or "")
                ids = np.frombuffer(packed, "<u4")
                out["n_tokens"].append(len(ids))
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
                else:
                    out["ids"].append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(out[k], t) for k, t in added.items()], [*keep, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), *(f"{k} {types[k]}" for k in added)])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text that its ids stand for; null ids give an empty text."""
    spark = encoded.sparkSession
    _store.arrow(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    keep = [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in shared.value.items()}
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [b"".join(table[i] for i in r or ()).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], [*keep, text])

    return encoded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep), f"`{text}` string"]))
