"""String helpers as columns."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a query that are not searched for.
STOPWORDS = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare and or but if then else when where why how what which who whom "
    "this that these those i you he she it we they me him her us them my your his its our their for to from with at by on in of about into through during before after above below find get search look all any each every".split()
)


def like_literal(text: str) -> str:
    """text with LIKE's wildcards escaped by a backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_like(pattern: str) -> str:
    """A glob as a LIKE pattern: * and ** match anything, ? one character."""
    out = re.sub(r"([\\%_])", r"\\\1", pattern)
    return out.replace("**/", "%").replace("**", "%").replace("*", "%").replace("?", "_")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole paths: * and ? stop at a slash, ** doesn't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits any pattern: globs as such, other patterns as the path or a folder above it. No pattern, or '.', takes all."""
    if not patterns or "." in patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | (path.rlike(glob_regex(p)) if re.search(r"[*?\[]", p) else (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/"))
    return out


def lexical_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct lower-case tokens of an identifier or a phrase: cut at case changes and non-alphanumerics; short ones and stopwords go."""
    cased = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(cased), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords)))


def query_terms(text: str) -> list[str]:
    """Terms of a search: lower-case runs of letters, digits and underscores, without short ones and stopwords."""
    return [t for t in re.split(r"[^\w]+", text.lower()) if len(t.encode()) > 1 and t not in STOPWORDS]


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def first_sentence(doc: Column) -> Column:
    line = F.trim(F.split(doc, "\n")[0])
    return F.coalesce(F.nullif(F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1), F.lit("")), line)


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of `size` tokens; none, if there are fewer."""
    # The tokens are bound to a lambda's name, so that Spark doesn't split the text again for each run.
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, size), " ")))
    one = lambda t: F.when(F.size(t) >= size, F.array_distinct(runs(t))).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(tokens), one), F.lit(0))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for the strings data[start:end], all at once."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    at, length, first = starts.astype(np.int64), (ends - starts).astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        mixed = lambda v, k: _turned(v + k * _P2, 31) * _P1
        h = np.full(len(at), first + _P5)
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (first + _P1 + _P2, first + _P2, first, first - _P1)]
            for n in range(int(length[long].max()) // 32):
                # Strings that are through drop out of the rest.
                on = slice(None) if n == 0 else np.flatnonzero(length[long] >= 32 * (n + 1))
                here = at[long][on] + 32 * n
                for i, v in enumerate(lanes):
                    v[on] = mixed(v[on], words[here + 8 * i])
            g = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for v in lanes:
                g = (g ^ (_turned(v * _P2, 31) * _P1)) * _P1 + _P4
            h[long] = g
        h += length.astype(np.uint64)
        at, left = at + length // 32 * 32, length % 32
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            h[on] = _turned(h[on] ^ (_turned(words[at[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turned(h[on] ^ ((words[at[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            h[on] = _turned(h[on] ^ (raw[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def shingle_hashes(text: bytes, size: int = 5) -> tuple[int, np.ndarray]:
    """The number of white-space tokens, and the sorted distinct hashes that shingles() has for them."""
    tokens = text.split()  # of bytes: at space, \t, \n, \v, \f and \r, as Java's \s
    if len(tokens) < size:
        return len(tokens), np.zeros(0, np.int64)
    bounds = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts, ends = np.concatenate(([0], bounds[:-1])), bounds - 1
    return len(tokens), np.unique(xxhashes(b" ".join(tokens), starts[: len(tokens) - size + 1], ends[size - 1 :]))


def normalise_path(path: str) -> str:
    """path without '.' and '..' steps."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)
