"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are split by dimension into ``lists``; a list knows only its own partial
scores. The phases, for every query:

1. each list gathers its best ``k`` partial scores from every group of vector blocks, block
   by block; the candidates' whole scores are worked out, and the k-th best of them is a safe
   cutoff ``c``;
2. the cutoff is handed to every block of every list, which reports all entries whose partial
   score is at least ``c / lists``: what no list reports scores less than ``c``;
3. entries reported by some lists only get an upper bound; those it doesn't rule out against
   the scores known by then are worked out exactly, and the best ``k`` are the result.

Equal vectors are searched once. Each stands for its ``k + 1`` smallest ids, which are
all that ties to the smaller id can let into a result, so a vector that a third of the
rows share is one entry. Vectors and queries meet in groups of blocks, every group of queries
with every group of vectors, each in one task through a shuffle (never a broadcast); entries travel packed, by pair
of blocks. Groups have up to ``MOST_BYTES``, so their number follows the rows.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as if zeros followed; rows with the
query's id are its own and are no candidates; repeated rows are one query; fewer than
``k`` candidates are all returned; an empty table gives an empty result. Scores are exact
below 2**53.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import lean, stored

SCALE = 256
BLOCK = 2048           # vectors of a block
QUERY_BLOCK = 512
SPREAD = 64            # groups of vectors, as long as each has between GROUP_BYTES and MOST_BYTES
GROUP_BYTES = 1 << 23  # of vectors, as doubles, that meet a group of queries in one task
MOST_BYTES = 1 << 26   # of vectors or queries there
ENTRIES = 1 << 16      # entries of a packed row, at most
SALTS = 64


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part, components scaled and
    floored."""
    v = F.col(vector_col)
    return (df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(finite_of("v"))
            .withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))))


def finite_of(name: str) -> Column:
    return F.forall(name, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def _trimmed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(values, start, end, digest) of vectors without the zeros at their ends; zeros have no sign."""
    values = np.asarray(column.flatten(), np.float64) + 0.0
    stops = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    filled = np.flatnonzero(values)
    last = np.concatenate([[-1], filled])[np.searchsorted(filled, stops)]
    ends = np.maximum(last + 1, starts)
    data = memoryview(values.tobytes())
    return values, starts, ends, [hashlib.blake2b(data[8 * a:8 * b], digest_size=16).digest()
                                  for a, b in zip(starts.tolist(), ends.tolist())]


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``(key, v, ids)``: each different vector with its ``most`` smallest ids. Ids meet
    in two steps over ``SALTS``, so no group holds all ids of a common vector."""
    def digest(batches):
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            best: dict[bytes, tuple[list[int], int]] = {}
            values, starts, ends, digests = _trimmed(batch.column(1))
            for r, (i, key) in enumerate(zip(batch.column(0).to_pylist(), digests)):
                best.setdefault(key, ([], r))[0].append(i)
            rows = [r for _, r in best.values()]
            at = np.concatenate([[0], np.cumsum((ends - starts)[rows])]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([values[starts[r]:ends[r]] for r in rows])))
            yield pa.record_batch([
                pa.array(list(best), pa.binary()), own,
                pa.array([sorted(set(ids))[:most] for ids, _ in best.values()], pa.list_(pa.int64())),
                pa.array([(part + n) % SALTS] * len(best), pa.int32())], ["key", "v", "ids", "salt"])
    found = rows.mapInArrow(digest, "key binary, v array<double>, ids array<bigint>, salt int")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    for keys in (["key", "salt"], ["key"]):
        found = found.groupBy(*keys).agg(F.first("v").alias("v"), least.alias("ids"))
    return found


def narrow(m: np.ndarray) -> np.ndarray:
    """The whole numbers of ``m`` in as few bytes as hold them."""
    low, high = m.min(initial=0.0), m.max(initial=0.0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return m.astype(kind)
    return m


def widened(data: bytes, rows: int, width: int) -> np.ndarray:
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    return np.frombuffer(data, kinds[len(data) // (rows * width)]).reshape(rows, width)


def blocks(vectors: DataFrame, lists: int, dims: int, size: int, extra: list[str]) -> DataFrame:
    """Vectors packed into blocks per list: ``(list, block, n, keys, matrix, ..)``; columns of
    ``extra`` have 8 bytes a value."""
    edges = _edges(lists, dims)

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                whole = np.zeros((some.num_rows, dims))
                for r, v in enumerate(some.column("v").to_numpy(zero_copy_only=False)):
                    whole[r, :len(v)] = v
                keys = b"".join(some.column("key").to_pylist())
                more = [some.column(c).to_numpy(zero_copy_only=False).tobytes() for c in extra]
                for j in range(lists):
                    own = narrow(np.ascontiguousarray(whole[:, edges[j]:edges[j + 1]]))
                    yield pa.record_batch([pa.array([j], pa.int32()), pa.array([part * 1_000_003 + n], pa.int64()),
                                           pa.array([some.num_rows], pa.int32()), pa.array([keys]), pa.array([own.tobytes()]),
                                           *(pa.array([m]) for m in more)],
                                          ["list", "block", "n", "keys", "matrix", *extra])
                n += 1
    return vectors.select("key", "v", *extra).mapInArrow(
        pack, "list int, block bigint, n int, keys binary, matrix binary" + "".join(f", {c} binary" for c in extra))


def _edges(lists: int, dims: int) -> list[int]:
    return [dims * i // lists for i in range(lists + 1)]


QUERIES, VECTORS, PAIRS = 0, 1, 2     # kinds of rows that meet, in the order they come


class Grid:
    """Groups of vector blocks (``at``) and of query blocks (``q_at``), as many as their rows need."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, dims: int, size: int, most: int):
        all_v, all_q = (df.count() * dims * 8 for df in (vectors, queries))
        self.at = max(1, -(-all_v // min(most, max(size, all_v // SPREAD))))
        self.q_at = max(1, -(-all_q // most))

    def vectors(self, df: DataFrame) -> DataFrame:
        return self._spread(df.withColumn("at", self._of("block", self.at)), "q_at", self.q_at).withColumn("kind", F.lit(VECTORS))

    def queries(self, df: DataFrame) -> DataFrame:
        df = df.withColumnRenamed("block", "q_block")
        return self._spread(df.withColumn("q_at", self._of("q_block", self.q_at)), "at", self.at).withColumn("kind", F.lit(QUERIES))

    def pairs(self, df: DataFrame) -> DataFrame:
        return (df.withColumn("at", self._of("block", self.at)).withColumn("q_at", self._of("q_block", self.q_at))
                .withColumn("kind", F.lit(PAIRS)))

    @staticmethod
    def _of(block: str, groups: int) -> Column:
        return F.pmod(block, F.lit(groups)).cast("int")

    @staticmethod
    def _spread(df: DataFrame, name: str, groups: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


ONCE = ["keys", "first", "cutoff"]     # columns of a block that are the same in all its lists


def meet(keys: list[str], *kinds: DataFrame) -> DataFrame:
    """All rows of the same ``keys`` in one task, one after another in the order of their kinds and blocks."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "block", "q_block", "list")


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _met(batches, keys: list[str]):
    return groupby(_each(batches), lambda row: tuple(row[c] for c in keys))


def _matrix(row: dict, edges: list[int]) -> np.ndarray:
    return widened(row["matrix"], row["n"], edges[row["list"] + 1] - edges[row["list"]])


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Partial scores of all pairs; in single precision where that is exact."""
    most = [max(float(m.max()), -float(m.min())) for m in (q, v)]
    kind = np.float32 if most[0] * most[1] * q.shape[1] < 1 << 24 else np.float64
    return q.astype(kind) @ v.astype(kind).T


def _share(cutoff: np.ndarray, lists: int) -> np.ndarray:
    """A list's part of the cutoff, up to the next whole number as partial scores are."""
    return np.ceil(cutoff / lists)


PACKED = "list int, block bigint, q_block bigint, n int, qi binary, vi binary, partial binary"


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, which compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(data: bytes, n: int) -> np.ndarray:
    """The values of ``_planes``: positions or single and double precision by their bytes."""
    bytes_each = len(data) // n
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(bytes_each, n).T).view(
        {2: np.uint16, 4: np.float32, 8: np.float64}[bytes_each]).ravel()


def _packed(at_list: int, block: int, q_block: int, qi: np.ndarray, vi: np.ndarray, partial: np.ndarray | None = None) -> Iterator[tuple]:
    for i in range(0, len(qi), ENTRIES):
        own = slice(i, i + ENTRIES)
        yield (at_list, block, q_block, len(qi[own]), _planes(qi[own].astype(np.uint16)), _planes(vi[own].astype(np.uint16)),
               None if partial is None else _planes(partial[own]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                           ["list", "block", "q_block", "n", "qi", "vi", "partial"])


class Best:
    """The best ``k`` entries of each of ``n`` queries so far: by score, then by the lesser ``first``."""

    def __init__(self, n: int, k: int, cutoff: np.ndarray | None = None):
        self.n, self.k = n, k
        self.qi, self.block, self.vi, self.first = (np.zeros(0, np.int64) for _ in range(4))
        self.score = np.zeros(0)
        self.least = np.full(n, -np.inf) if cutoff is None else cutoff.copy()     # what a new entry must reach

    def add(self, qi: np.ndarray, block: int, vi: np.ndarray, score: np.ndarray, first: np.ndarray) -> None:
        if not len(qi):
            return
        new = qi, np.full(len(qi), block), vi, first, score
        qi, block, vi, first, score = (np.concatenate(x) for x in zip((self.qi, self.block, self.vi, self.first, self.score), new))
        order = np.lexsort((first, -score, qi))
        starts = np.searchsorted(qi[order], np.arange(self.n + 1))
        order = order[np.arange(len(order)) - starts[qi[order]] < self.k]
        self.qi, self.block, self.vi, self.first, self.score = (x[order] for x in (qi, block, vi, first, score))
        ends = np.searchsorted(self.qi, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(ends) == self.k)
        self.least[full] = self.score[ends[full + 1] - 1]


def local_best(k: int, edges: list[int]):
    """Where the ``k`` best partial scores of each query in a list's group are, packed. Which of equal ones is all the same."""
    def run(batches):
        for (at_list, *_), rows in _met(batches, ["list", "at", "q_at"]):
            queries: dict[int, tuple[np.ndarray, Best]] = {}
            for row in rows:
                m = _matrix(row, edges)
                if row["kind"] == QUERIES:
                    queries[row["q_block"]] = m, Best(len(m), k)
                    continue
                for q, best in queries.values():
                    scores = _scores(q, m)
                    hits = np.flatnonzero(scores > best.least[:, None].astype(scores.dtype))
                    if len(hits) > 8 * k * best.n:
                        own = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
                        hits = np.flatnonzero((scores >= own[:, None]) & (scores > best.least[:, None]))
                    qi, vi = np.divmod(hits, scores.shape[1])
                    best.add(qi, row["block"], vi, scores.ravel()[hits].astype(np.float64), vi)
            found = [x for name, (_, best) in queries.items() for block in np.unique(best.block)
                     for own in [best.block == block]
                     for x in _packed(at_list, int(block), name, best.qi[own], best.vi[own])]
            if found:
                yield _batch(found)
    return lean(run)


def above_cutoff(lists: int, edges: list[int]):
    """Every entry of a list that reaches its part of the cutoff, packed."""
    def run(batches):
        for (at_list, *_), rows in _met(batches, ["list", "at", "q_at"]):
            queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for row in rows:
                m = _matrix(row, edges)
                if row["kind"] == QUERIES:
                    queries[row["q_block"]] = m, _share(np.frombuffer(row["cutoff"]), lists)[:, None]
                    continue
                for name, (q, cutoff) in queries.items():
                    scores = _scores(q, m)
                    hits = np.flatnonzero(scores >= cutoff.astype(scores.dtype))
                    found = list(_packed(at_list, row["block"], name, *np.divmod(hits, scores.shape[1]), scores.ravel()[hits]))
                    if found:
                        yield _batch(found)
    return lean(run)


def resolved(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, grid: Grid, lists: int, edges: list[int], k: int) -> DataFrame:
    """``(q_key, key, score)``: whole scores of packed ``pairs``, of each query the ``k`` best of each group. Where query
    blocks have a ``cutoff``, pairs are those of the second phase: what all lists report is summed, the rest is bounded,
    and worked out if the bound reaches the cutoff and the scores known so far."""
    def run(batches):
        for _, rows in _met(batches, ["at", "q_at"]):
            queries: dict[int, dict] = {}
            vectors: dict[int, dict] = {}
            wholes: tuple[int | None, np.ndarray] = None, np.zeros((0, 0))
            for (kind, block, q_block), own in groupby(rows, lambda row: (row["kind"], row["block"], row["q_block"])):
                parts = list(own)
                if kind == PAIRS:
                    q, v = queries[q_block], vectors[block]
                    if wholes[0] != block:
                        wholes = block, np.hstack(v["matrices"])
                    entries = _joined(parts, len(wholes[1]))
                    _work_out(q, v, block, wholes[1], *entries, lists)
                    continue
                x = {"keys": np.frombuffer(parts[0]["keys"], "V16"), "matrices": [_matrix(row, edges) for row in parts]}
                if kind == QUERIES:
                    n = len(x["keys"])
                    cutoff = np.frombuffer(parts[0]["cutoff"]) if parts[0].get("cutoff") is not None else None
                    queries[q_block] = x | {"whole": np.hstack(x["matrices"]), "cutoff": cutoff, "best": Best(n, k, cutoff)}
                else:
                    vectors[block] = x | {"first": np.frombuffer(parts[0]["first"], np.int64)}
            for q in queries.values():
                best = q["best"]
                keys = np.zeros(len(best.qi), "V16")
                for block in np.unique(best.block):
                    keys[best.block == block] = vectors[int(block)]["keys"][best.vi[best.block == block]]
                if len(keys):
                    yield pa.record_batch([pa.array(q["keys"][best.qi].tolist(), pa.binary()), pa.array(keys.tolist(), pa.binary()),
                                           pa.array(best.score)], ["q_key", "key", "score"])
    once = lambda df: df.withColumns({c: F.when(F.col("list") == 0, F.col(c)) for c in df.columns if c in ONCE})
    met = meet(["at", "q_at"], grid.queries(once(queries)), grid.vectors(once(vectors)), grid.pairs(pairs))
    return met.mapInArrow(lean(run), "q_key binary, key binary, score double")


def _joined(parts: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, sum of the partial scores, lists that report it) of each different entry."""
    qi, vi = (np.concatenate([_whole(row[c], row["n"]) for row in parts]).astype(np.int64) for c in ("qi", "vi"))
    partial = np.concatenate([np.zeros(row["n"]) if row["partial"] is None else _whole(row["partial"], row["n"]).astype(np.float64)
                              for row in parts])
    flat, where, n = np.unique(qi * width + vi, return_inverse=True, return_counts=True)
    return *np.divmod(flat, width), np.bincount(where, partial, len(flat)), n


def _work_out(q: dict, v: dict, block: int, whole: np.ndarray, qi, vi, part, n, lists: int, at_once: int = 1 << 13) -> None:
    """Adds the whole scores of a pair of blocks to the best of its queries."""
    best, cutoff = q["best"], q["cutoff"]

    def add(own, scores):
        fits = scores >= best.least[qi[own]]
        best.add(qi[own][fits], block, vi[own][fits], scores[fits], v["first"][vi[own][fits]])

    open_ = np.arange(len(qi))
    if cutoff is not None:
        known = n == lists
        add(np.flatnonzero(known), part[known])
        unseen = np.where(known, 0, _share(cutoff, lists)[qi] - 1)     # at most, in a list that doesn't report it
        bound = part + np.where(known, 0, lists - n) * unseen
        open_ = np.flatnonzero(~known & (bound >= best.least[qi]))
    for i in range(0, len(open_), at_once):
        own = open_[i:i + at_once]
        add(own, np.einsum("ij,ij->i", q["whole"][qi[own]].astype(np.float64), whole[vi[own]].astype(np.float64)))


def best_of(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .where(F.col("rank") <= k))


def search(df: DataFrame, is_query: Column, k: int = 5, lists: int = 2, id_col: str = "vec_id",
           vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK,
           group: int = GROUP_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of each row where ``is_query``, a
    condition on ``vec_id``, holds. ``block`` and ``query_block`` (65,536 at most), ``group`` and ``most`` change no result."""
    rows = stored(whole_vectors(df, id_col, vector_col), "topk-rows")
    vectors = stored(distinct_vectors(rows, k + 1), "topk-vectors")
    asked = stored(distinct_vectors(rows.where(is_query), 1).select("key", "v"), "topk-queries")
    dims = max(1, rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1)
    lists = min(lists, dims)
    edges, grid, by_list = _edges(lists, dims), Grid(vectors, asked, dims, group, most), ["list", "at", "q_at"]
    k_vectors = k + 1     # the query's own vector may stand for the query alone

    tables = stored(blocks(vectors.withColumn("first", F.element_at("ids", 1)), lists, dims, block, ["first"]), "topk-blocks")
    questions = stored(blocks(asked, lists, dims, query_block, []), "topk-query-blocks")
    first = meet(by_list, grid.queries(questions.drop("keys")), grid.vectors(tables.drop("keys", "first"))).mapInArrow(
        local_best(k_vectors, edges), PACKED)
    known = resolved(first, questions, tables, grid, lists, edges, k_vectors)
    kth = (best_of(known, ["q_key"], [F.col("score").desc()], k_vectors).groupBy("q_key")
           .agg(F.when(F.count("*") == k_vectors, F.min("score")).otherwise(F.lit(float("-inf"))).alias("cutoff")))
    cut = asked.join(kth.withColumnRenamed("q_key", "key"), "key")

    questions = stored(blocks(cut, lists, dims, query_block, ["cutoff"]), "topk-query-blocks")
    second = meet(by_list, grid.queries(questions.drop("keys")), grid.vectors(tables.drop("keys", "first"))).mapInArrow(
        above_cutoff(lists, edges), PACKED)
    exact = resolved(second, questions, tables, grid, lists, edges, k_vectors)
    # ties at the last place: of equal vectors' scores those with the smallest ids count
    ranked = (exact.join(vectors.select("key", "ids"), "key")
              .withColumn("rank", F.row_number().over(Window.partitionBy("q_key").orderBy(
                  F.col("score").desc(), F.element_at("ids", 1))))
              .where(F.col("rank") <= k_vectors))
    answers = ranked.select("q_key", "score", F.explode("ids").alias("vec_id"))
    answers = best_of(answers, ["q_key"], [F.col("score").desc(), F.col("vec_id")], k + 1).drop("rank")
    return _for_rows(rows.where(is_query), asked, answers, k)


def _for_rows(rows: DataFrame, asked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """The answers of each query's vector without the query itself."""
    def digest(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(_trimmed(batch.column(1))[3], pa.binary())], ["query_id", "q_key"])
    own = rows.mapInArrow(digest, "query_id bigint, q_key binary").distinct()
    found = own.join(answers, "q_key").where("query_id <> vec_id")
    return (best_of(found, ["query_id", "q_key"], [F.col("score").desc(), F.col("vec_id")], k)
            .select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score")))


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
