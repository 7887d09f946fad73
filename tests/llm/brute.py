"""Plain Python versions of the contracts, one text at a time."""

import hashlib
import re

BASE_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
BASE_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    t = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    return 14 <= len(d) <= 19 and t % 10 == 0


def keep(kind, m):
    s = m.group(0)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        return 10 <= sum(c.isdigit() for c in s) <= 15
    if kind == "assign":
        return len(m.group(2)) >= 6
    if kind == "access":
        return len(s) >= 20
    if kind == "hex":
        return len(s) >= 24
    return True


def spans(text, base):
    out = []
    for rank, (kind, pattern) in enumerate(base):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if keep(kind, m)]
    return sorted(out)


def digest(text, base):
    got = spans(text, base)
    s = ",".join(f"{k}:{a}:{b}" for a, _, b, k in got)
    return {**{f"n_{k}": sum(x[3] == k for x in got) for k, _ in base}, "base_sha256": hashlib.sha256(s.encode()).hexdigest(), "spans": s}


def contaminated(text, items, window=8):
    """(n_words, n_hit, sorted item ids) of a text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hit, ids = [False] * len(words), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body or ""))
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i : i + size]) in grams:
                ids.add(str(item))
                hit[i : i + size] = [True] * size
    return len(words), sum(hit), sorted(ids)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def repeats(docs, window=13, before=()):
    """doc_id -> (n_words, n_removed, kept words), of {doc_id: text}; texts in `before` come earlier than all."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    words = {d: split(t) for d, t in docs.items()}
    first = {}
    for own in map(split, before):
        for i in range(len(own) - window + 1):
            first[tuple(own[i : i + window])] = -1
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, own in words.items():
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = len(own), sum(gone), " ".join(w for w, g in zip(own, gone, strict=True) if not g)
    return out


def shingles(text, size=2):
    own = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def near(docs, size=2):
    """doc_id -> (n_shingles, component_id), by comparing all pairs."""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    up = {d: d for d in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def near_fast(docs, size=2):
    """doc_id -> component_id as near(), by counting shared shingles with a matrix product."""
    import numpy as np

    ids = sorted(docs)
    sets = [shingles(docs[d], size) for d in ids]
    place = {x: i for i, x in enumerate({x for s in sets for x in s})}
    m = np.zeros((len(ids), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    both = np.rint(m @ m.T)
    n = m.sum(axis=1)
    linked = (100 * both >= 80 * (n[:, None] + n[None] - both)) & (n > 0)[:, None] & (n > 0)[None]
    top = np.arange(len(ids))
    while True:
        new = np.where(linked, top[None, :], len(ids)).min(axis=1)
        new = np.minimum(top, new)
        if (new == top).all():
            return {d: ids[t] for d, t in zip(ids, top, strict=True)}
        top = new
