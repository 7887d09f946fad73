"""Quality classifier from weak labels.

Overlapping heuristics each vote junk (1) or not (0). A kind of junk sets off only the labellers that
look for it, so silence says little, and how little is for the model to learn: expectation
maximisation over the counts of vote patterns estimates how often each labeller fires on junk and on
fine documents, and so the posterior of every pattern. Posterior labels of a bounded sample (SAMPLE documents,
by hash of the id) then train a linear scorer over hashed features: words, their shapes, and whether a
word repeats the one before. The scorer, which can weigh what no heuristic names, judges every document.

Abuse is a class of its own, as it says nothing about shape: a document with ABUSIVE or more words of a
list of insults (English, German, French, Spanish) is toxic. It was written after reading a few labelled documents; what it lacks is not found.

No gold label is used to fit the models. Null, empty and blank texts have no words and are rejected, with score 1. Repeated
rows are judged alike; other columns pass through, and those with the names of added ones are replaced.
If no document, or every one, looks like junk to the labellers, the scorer follows the posterior of few
or no examples and keeps what it can't tell from fine ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._text import NOT_SPACE, Words, mix, pieces, powers

#: Documents that train the scorer, about; hashed features.
SAMPLE, BITS = 5000, 15
FEATURES = 1 << BITS
LABELLERS = ("capitals", "shouting", "symbols", "bars", "repeats", "variety", "symbol words", "bar characters")

#: Words of abuse that make a document toxic, at least; one alone may be quoted or meant otherwise.
ABUSIVE = 2
INSULTS = (
    r"(?i)\b(?:idiots?|idiotic|morons?|moronic|imbeciles?|cretins?|dumbass(?:es)?|dimwits?|halfwits?|losers?|scum|scumbags?|trash|garbage|vermin|filth|pathetic|worthless"
    r"|disgusting|stupid|clowns?|fools?|jerks?|bastards?|assholes?|bitch(?:es)?|fuck\w*|shit\w*|retards?|retarded|freaks?|subhumans?|degenerates?"
    r"|idioten|idiotin|idiotisch\w*|dummkopf|dumm|dumme[nrs]?|arschloch|abschaum|versager|widerlich\w*|trottel|schwachkopf|vollidiot\w*|drecks?\w*|m[üu]ll|erb[äa]rmlich\w*|wertlos\w*|l[äa]cherlich\w*|schei(?:ß|ss)\w*"
    r"|idiote?s?|cr[ée]tine?s?|connards?|connasses?|salauds?|ordures?|pourritures?|minables?|imb[ée]ciles?|abrutie?s?|d[ée]biles?|stupides?|path[ée]tiques?|d[ée]chets?|nuls?|merde"
    r"|idiotas?|imb[ée]cil\w*|est[úu]pid[oa]s?|tont[oa]s?|basura|mierda|escoria|payas[oa]s?|pat[ée]tic[oa]s?|in[úu]til(?:es)?|perdedor(?:es|as?)?|asqueros[oa]s?)\b"
)

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[0x41:0x5B] = 1
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_CLASS[0x30:0x3A] = 3
_LETTER_OR_DIGIT = np.isin(_CLASS, (1, 2, 3))


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of values; bounds has the place where each run begins, and the end."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def signals(w: Words) -> dict[str, np.ndarray]:
    """Shares that the labellers look at, for each row of a piece."""
    n = np.maximum(w.counts(), 1)
    kind = _CLASS[w.data]
    upper, letters = _sum(kind == 1, w.offsets), np.maximum(_sum((kind == 1) | (kind == 2), w.offsets), 1)
    dense = np.maximum(_sum(NOT_SPACE[w.data], w.offsets), 1)
    plain = _sum(_LETTER_OR_DIGIT[w.data], w.offsets)
    inside = np.concatenate(([0], np.cumsum(_LETTER_OR_DIGIT[w.data])))
    alnum = inside[w.ends] - inside[w.starts]
    same = np.zeros(len(w.starts), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.rows[:-1][w.counts() > 0]] = False
    odd = (w.ends - w.starts) - alnum
    rows = w.row_of()
    order = np.lexsort((w.hashes, rows))
    h, r = w.hashes[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return {
        "words": w.counts(),
        "upper": upper / letters,
        "shout": _sum(w.data == 0x21, w.offsets) / n,
        "symbols": 1 - plain / dense,
        "bare": _sum(alnum == 0, w.rows) / n,
        "same": _sum(same, w.rows) / n,
        "distinct": np.bincount(r[fresh], minlength=len(n)) / n,
        "odd": _sum(odd >= 2, w.rows) / n,
        "bars": _sum(np.isin(w.data, (0x7C, 0x3E, 0x5E, 0x7E)), w.offsets) / dense,
    }


def votes(w: Words) -> np.ndarray:
    """(rows, labellers): 1 for junk."""
    s = signals(w)
    long = s["words"] >= 20
    expected = np.minimum(1, 6 / np.sqrt(np.maximum(s["words"], 1)))  # distinct words grow with the root of a text's length, about
    return np.stack(
        [
            s["upper"] > 0.3,
            s["shout"] > 0.15,
            s["symbols"] > 0.15,
            s["bare"] > 0.12,
            s["same"] > 0.1,
            long & (s["distinct"] < 0.35 * expected),
            s["odd"] > 0.15,
            long & (s["bars"] > 0.05),
        ],
        axis=1,
    ).astype(np.int8)


def _pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (2 ** np.arange(v.shape[1]))


def _each(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, Words]]:
    for a, _, data, offsets in pieces(batch.column(batch.schema.get_field_index(text))):
        yield a, Words(data, offsets)


class LabelModel:
    """How each labeller votes on fine (0) and junk (1) documents, (labellers, 2, 2), and the share of junk."""

    def __init__(self, table: np.ndarray, junk: float):
        self.table, self.junk = table, junk

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = (patterns[:, None] // 2 ** np.arange(len(self.table))[None]) % 2
        logs = np.log([1 - self.junk, self.junk])[None, :] + sum(np.log(self.table[j][:, v[:, j]]).T for j in range(len(self.table)))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        k = len(LABELLERS)
        v = (patterns[:, None] // 2 ** np.arange(k)[None]) % 2
        # A start that only says which class is junk.
        p = np.where(v.any(axis=1), 0.9, 0.02)
        model = cls(np.full((k, 2, 2), 1 / 2), 0.5)
        for _ in range(rounds):
            weight = np.stack([(1 - p) * counts, p * counts])
            table = np.empty((k, 2, 2))
            for j in range(k):
                for x in range(2):
                    table[j, :, x] = weight[:, v[:, j] == x].sum(axis=1) + 0.5
            model = cls(table / table.sum(axis=2, keepdims=True), float((weight[1].sum() + 1) / (weight.sum() + 2)))
            new = model.posterior(patterns)
            if np.abs(new - p).max(initial=0) < 1e-6:
                break
            p = new
        return model


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, its three hashed features, one column each)."""
    kind = _CLASS[w.data]
    n = len(w.data)
    head = np.ones(n, bool)
    head[1:] = kind[1:] != kind[:-1]
    head[w.starts] = True
    run = np.cumsum(head)
    p, inverse = powers(0, n + 2)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(head, mix(kind.astype(np.uint64)) * p[run], np.uint64(0)), dtype=np.uint64)))
    shape = mix((sums[w.ends] - sums[w.starts]) * inverse[run[w.starts]], 11)
    same = np.zeros(len(w.starts), np.uint64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.rows[:-1][w.counts() > 0]] = 0
    cut = np.uint64(64 - BITS)
    return w.row_of(), np.stack([shape >> cut, mix(w.hashes, 13) >> cut, mix(same, 17) >> cut], axis=1).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, counts = np.unique(np.concatenate([_pattern(votes(w))[w.counts() > 0] for _, w in _each(batch, "text")] or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote pattern, and the hashed features as shares of a document's words."""
    for batch in batches:
        patterns, indices, values = [], [], []
        for _, w in _each(batch, "text"):
            v = _pattern(votes(w))
            row, f = features(w)
            for i in np.flatnonzero(w.counts()):
                a, b = int(w.rows[i]), int(w.rows[i + 1])
                ids, n = np.unique(f[a:b], return_counts=True)
                patterns.append(int(v[i]))
                indices.append(ids.astype(np.int32))
                values.append((n / (b - a)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int64()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["pattern", "ids", "shares"])


def train(ids: np.ndarray, shares: np.ndarray, bounds: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, both classes weighing alike, by Adagrad. Row i has the features ids and shares from bounds[i] to bounds[i + 1]."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not len(target):
        return weights, bias
    junk = max(target.sum(), 1.0)
    fine = max((1 - target).sum(), 1.0)
    balance = target * (fine / junk) + (1 - target)
    row = np.repeat(np.arange(len(target)), np.diff(bounds))
    seen, seen_bias = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.add.reduceat(weights[ids] * shares, bounds[:-1]) + bias
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(target)
        g = np.bincount(ids, slope[row] * shares, FEATURES) + decay * weights
        seen += g * g
        weights -= rate * g / np.sqrt(seen)
        total = slope.sum()
        seen_bias += total * total
        bias -= rate * 0.1 * total / np.sqrt(seen_bias)
    return weights, float(bias)


class Quality:
    """A label model and a scorer, fitted on a table of documents."""

    def __init__(self, labels: LabelModel, weights: np.ndarray, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias

    @classmethod
    def fit(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Quality:
        """Vote patterns are counted over all documents (at most 2 to the number of labellers of them); the scorer sees about `sample` documents."""
        spark: SparkSession = docs.sparkSession
        _store.arrow(spark)
        plain = docs.select(F.col(text).alias("text"))
        counted = plain.mapInArrow(_count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
        patterns, counts = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], np.float64)
        model = LabelModel.fit(patterns, counts)
        share = min(1.0, sample / max(1.0, counts.sum()))
        place = F.pmod(F.xxhash64(F.col(key), F.lit("quality")), F.lit(1 << 40))
        taken = docs.where(place < int(share * (1 << 40))).select(F.col(text).alias("text")).mapInArrow(_sampled, "pattern long, ids array<int>, shares array<float>")
        table = taken.toArrow().combine_chunks()
        drawn = table.column("pattern").to_numpy()
        sizes = np.array([len(x) for x in table.column("ids")], np.int64)
        ids = table.column("ids").combine_chunks().flatten().to_numpy().astype(np.int64) if len(drawn) else np.zeros(0, np.int64)
        shares = table.column("shares").combine_chunks().flatten().to_numpy().astype(np.float64) if len(drawn) else np.zeros(0)
        weights, bias = train(ids, shares, np.concatenate(([0], np.cumsum(sizes))), model.posterior(drawn))
        return cls(model, weights, bias)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with p_weak (the label model's posterior of junk), score (the scorer's probability of junk) and n_abusive (its words of abuse)."""
        _store.arrow(docs.sparkSession)
        added = ("p_weak", "score", "n_abusive")
        docs = docs.drop(*added)
        labels, weights, bias = self.labels, self.weights, self.bias
        names = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                weak, scores = np.ones(batch.num_rows), np.ones(batch.num_rows)
                for a, w in _each(batch, text):
                    n = w.counts()
                    _, f = features(w)
                    z = _sum(weights[f].sum(axis=1), w.rows) / np.maximum(n, 1) + bias
                    here = slice(a, a + len(n))
                    scores[here] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1.0)
                    weak[here] = np.where(n > 0, labels.posterior(_pattern(votes(w))), 1.0)
                abusive = pc.fill_null(pc.count_substring_regex(batch.column(batch.schema.get_field_index(text)), pattern=INSULTS), 0).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weak), pa.array(scores), abusive], [*names, *added])

        return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "p_weak double", "score double", "n_abusive int"]))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with p_weak, score, n_abusive, kept (score below the threshold) and toxic, by a model fitted on docs. kept judges quality alone."""
    return Quality.fit(docs, key, text).score(docs, text).withColumn("kept", F.col("score") < threshold).withColumn("toxic", F.col("n_abusive") >= ABUSIVE)
