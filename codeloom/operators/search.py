"""Finding symbols by name, by words and by vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions import vectors as vec
from codeloom.ship import ship


def find_symbols(symbols: DataFrame, pattern: str, limit: int = 20, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols whose name or qualified name contains the pattern, case ignored; exact names first, then prefixes, then by name."""
    like = F.lit(f"%{tx.like_literal(pattern)}%")
    out = symbols.where(F.ilike("name", like) | F.ilike("qualified_name", like))
    if file:
        out = out.where(F.col("file_path").like(tx.glob_like(file)))
    if kind:
        out = out.where(F.col("kind") == kind)
    place = F.when(F.col("name") == pattern, 0).when(F.col("name").ilike(f"{tx.like_literal(pattern)}%"), 1).otherwise(2)
    return out.withColumn("match_rank", place).orderBy("match_rank", "name", "id").limit(limit)


_APART = r"[^\p{L}\p{N}]+"


def terms_of(*columns: Column) -> Column:
    """The lower-case runs of letters and digits of all columns, one array."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), _APART), lambda t: t != "")


def postings(docs: DataFrame, key: str, *columns: Column) -> DataFrame:
    """(key, term, tf, length) of texts."""
    rows = docs.select(F.col(key).alias("key"), terms_of(*columns).alias("terms")).select("key", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, columns: list[Column], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows that hold a term of the query, or a longer word that begins with one, in any of the columns.

    A row's length is that of all its columns. The idf is ln((N - n + 0.5) / (n + 0.5)), and a millionth where that isn't positive. A term with
    underscores is its parts one after another. N, the mean length and each term's n come from one aggregate of one row; a second pass scores.
    """
    words = sorted({tuple(p for p in w.split("_") if p) for w in tx.query_terms(query)} - {()})
    if not words:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)

    def tf(parts: tuple[str, ...]) -> Column:
        if len(parts) == 1:
            return F.size(F.filter("terms", lambda t: t.startswith(parts[0])))
        at = F.sequence(F.lit(0), F.size("terms") - len(parts))
        here = lambda i: F.get("terms", i + len(parts) - 1).startswith(parts[-1])
        for n, p in enumerate(parts[:-1]):
            here = lambda i, f=here, n=n, p=p: f(i) & (F.get("terms", i + n) == p)
        return F.when(F.size("terms") >= len(parts), F.size(F.filter(at, here))).otherwise(0)

    found = docs.select(F.col(key).alias("key"), terms_of(*columns).alias("terms")).select("key", F.size("terms").alias("length"), *[tf(w).alias(f"tf{i}") for i, w in enumerate(words)])
    totals = found.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    some, score = F.lit(False), F.lit(0.0)
    for i in range(len(words)):
        n, t = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        some = some | (t > 0)
        score = score + F.when(idf > 0, idf).otherwise(1e-6) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return found.where(some).crossJoin(F.broadcast(totals)).select("key", score.alias("score"))  # totals is one row


def hybrid(exact: DataFrame, full_text: DataFrame, limit: int = 20) -> DataFrame:
    """Two ranked lists (id, score) as one: half the limit from each, the higher score of either, ties by id."""
    half = max(1, limit // 2)
    top = lambda df: df.orderBy(F.desc("score"), "id").limit(half)
    both = top(exact).unionByName(top(full_text)).groupBy("id").agg(F.max("score").alias("score"))
    return both.orderBy(F.desc("score"), "id").limit(limit)


def name_scores(symbols: DataFrame, pattern: str) -> DataFrame:
    """(id, score): 1 for the name itself, 0.9 for a prefix, 0.7 for a part."""
    low = F.lower("name")
    p = pattern.lower()
    return symbols.where(F.contains(low, F.lit(p))).select("id", F.when(low == p, 1.0).when(low.startswith(p), 0.9).otherwise(0.7).alias("score"))


#: Queries and vectors in a cell of a search, about, and queries that are measured at once.
ASKED, STRIPE, STEP = 2048, 8192, 256


def _exact(measure: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The score of each row of x with that of y, added up component by component as the column expressions do."""
    dot = lambda a, b: sum((a[:, i] * b[:, i] for i in range(a.shape[1])), np.zeros(len(a)))
    if measure == "l2":
        return np.sqrt(dot(x - y, x - y))
    if measure == "dot":
        return dot(x, y)
    size = np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))
    return np.where(size > 0, dot(x, y) / np.where(size > 0, size, 1.0), 0.0)


def _best(measure: str, k: int, q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) by their places: the k best of v for each of q. One product of matrices gives nearness up to an error that is bounded; all within it of the k-th are scored exactly. v_ids are in the order of the ids."""
    error = 8 * (v.shape[1] + 8) * np.finfo(float).eps
    nv, nq = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out = []
    for at in range(0, len(q), STEP):
        x, n = q[at : at + STEP], nq[at : at + STEP, None]
        near = x @ v.T
        if measure == "cosine":
            size = n * nv
            near, slack = np.where(size > 0, near / np.where(size > 0, size, 1.0), 0.0), np.full_like(n, error)
        elif measure == "l2":
            near, slack = 2 * near - n * n - nv * nv, error * (n + nv.max()) ** 2
        else:
            slack = error * n * nv.max()
        near[q_ids[at : at + STEP, None] == v_ids] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else np.full_like(n, -np.inf)
        i, j = np.nonzero((near >= least - 2 * slack) & (near > -np.inf))
        score = _exact(measure, x[i], v[j])
        order = np.lexsort((v_ids[j], score if measure == "l2" else -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
        out.append((i[keep] + at, j[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(lists: pa.ChunkedArray, rows: int) -> np.ndarray:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _sound(v: Column) -> Column:
    """Whether products of v's components neither overflow nor vanish: no nulls, all finite, no norm near the limits of doubles."""
    wide = vec.doubles(v)
    square = vec.dot(wide, wide)
    return F.coalesce((F.size(v) > 0) & (square <= 1e200) & ((square >= 1e-200) | ~F.exists(wide, lambda x: x != 0)), F.lit(False))


def _by_size(rows: DataFrame, column: str) -> dict[tuple[int, bool], int]:
    return {(r["size"], r["sound"]): r["n"] for r in rows.groupBy(F.size(column).alias("size"), _sound(F.col(column)).alias("sound")).agg(F.count("*").alias("n")).collect()}


def top_k(vectors: DataFrame, queries: DataFrame, measure: str = "cosine", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of `vectors` (vec_id, vector) for each of `queries` (query_id, vector), itself left out.

    Queries and vectors are dealt to cells of bounded size, each pair of which meets in one cell; ranks come from the cells' lists. Of equal
    vectors the k + 1 smallest ids can be among the best, and only these go on. Vectors of other sizes than most, or with nulls or
    components that aren't finite, are met row by row.
    """
    ship(vectors.sparkSession)
    sizes, asked = _by_size(vectors, "vector"), _by_size(queries, "vector")
    size = max((key for key in sizes if key[1]), key=lambda key: (sizes[key], key[0]), default=(-1, True))
    sound = lambda c: (F.size(c) == size[0]) & _sound(F.col(c))
    n, m = sizes.get(size, 0), asked.get(size, 0)
    wide, high = max(1, -(-m // ASKED)), max(1, -(-n // STRIPE))
    ids = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {ids}, score double"
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.where(sound("vector")).withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "vector")
    side = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.where(sound("vector")).select((side("query_id", wide) * high).alias("row"), "query_id", "vector", every(high).alias("column")).select((F.col("row") + F.col("column")).alias("cell"), "query_id", "vector")
    v = few.select(side("vec_id", high).alias("column"), "vec_id", "vector", every(wide).alias("row")).select((F.col("row") * high + F.col("column")).alias("cell"), "vec_id", "vector")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            i = j = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            a, b = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "vec_id")))
            order = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
            i, j, score = _best(measure, k, _matrix(left.column("vector"), len(a)), order[: len(a)], _matrix(right.column("vector"), len(b)), order[len(a) :])
        return pa.table({"query_id": left.column("query_id").take(pa.array(i)), "vec_id": right.column("vec_id").take(pa.array(j)), "score": score})

    out = q.groupBy("cell").cogroup(v.groupBy("cell")).applyInArrow(meet, schema)
    value = {"cosine": vec.cosine, "dot": vec.dot, "l2": vec.l2}[measure](vec.doubles(F.col("q")), vec.doubles(F.col("v")))
    rows = lambda q, v: q.select("query_id", F.col("vector").alias("q")).crossJoin(v.select("vec_id", F.col("vector").alias("v"))).where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", value.alias("score"))
    odd = ~F.coalesce(sound("vector"), F.lit(False))
    if sum(asked.values()) > m:
        out = out.unionByName(rows(queries.where(odd), vectors))
    if sum(sizes.values()) > n:
        out = out.unionByName(rows(queries.where(~odd), vectors.where(odd)))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("score") if measure == "l2" else F.desc_nulls_last("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def similarity_score(distance: Column) -> Column:
    """An L2 distance as a score from 0 to 1."""
    return 1 / (1 + distance)
