"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct word shingles, and two documents are linked if the Jaccard
similarity of their sets is at least ``least`` percent. Signatures take two permutations of
the 2^32 places a shingle can have: the first scatters the shingles, the second is shifted by
one place for each coordinate, and a coordinate is the least place in the set. So ``COORDINATES``
coordinates need no more than two permutations, each a few whole-number operations.

Coordinates are cut into bands of ``ROWS``. Sets of similarity 0.8 agree in all rows of a
band with chance 0.41, so all ``COORDINATES / ROWS`` bands miss such a pair with chance 5e-8.

Work is done on different sets: copies, however many, are one node. Sets that share a
band are verified on their full sets, but never all pairs of a bucket:

1. the first set of each bucket is compared with every other one (stars), and the linked ones
   form components;
2. in large buckets (over ``PAIRS_UP_TO`` sets) with several components the sets outside the largest
   one are compared with ``CENTERS`` sets of it, which joins nearly all of a family of near copies;
3. buckets that still hold several components have the pairs left that could join two of
   them. Small ones give these pairs directly. In large ones two sets are only compared if
   they share one of their rarest shingles: two sets of similarity J share one of the
   ``size - ceil(J size) + 1`` rarest of each, whatever the order, and behind the first one both sets must be
   long enough for that similarity, so nothing is lost.

Pairs whose sizes rule the similarity out are dropped before their texts are fetched.

Defined cases: null and empty texts and texts without words have an empty set, are linked with
nothing and are kept; a text of fewer words than a shingle is one shingle; equal rows stay separate rows
of one component; a null id names a component only if no other id is in it, and all rows of such
a component are kept; texts of any length are taken whole; an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import joined_words, lean, pieces, span_hashes, stored, words
from corpusql.llm.simhash import components

WIDTH, LEAST = 2, 80
COORDINATES, ROWS = 128, 4
PAIRS_UP_TO = 48
CENTERS = 16


# --- sets and signatures ------------------------------------------------------------------

def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document offsets): the distinct shingles of every document of a piece, in the order of
    their hashes."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    text, at = joined_words(lower, starts, ends)
    of = np.repeat(np.arange(len(n)), shingles)
    begin = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    hashes = span_hashes(np.frombuffer(text, np.uint8), at[begin], at[begin + np.minimum(width, n[of])] - 1)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(n) + 1))


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """Of the 2^32 places, as every step can be undone."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _second_permutation(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The same for the shifted places; in place."""
    x *= np.uint32(0x9E3779B1)
    np.right_shift(x, np.uint32(15), out=spare)
    x ^= spare
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=spare)
    x ^= spare
    x *= np.uint32(0xC2B2AE35)
    return x


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` per set; the sets must not be empty."""
    places = _first_permutation((hashes >> np.uint64(32)).astype(np.uint32))
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    shifted, spare = np.empty_like(places), np.empty_like(places)
    for k in range(coordinates):
        np.add(places, np.uint32(k), out=shifted)      # the second permutation, k places on
        out[:, k] = np.minimum.reduceat(_second_permutation(shifted, spare), offsets[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, the band's number within."""
    bands = signature.shape[1] // rows
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signature), 1))
    for r in range(rows):
        keys = (keys ^ signature[:, r::rows][:, :bands]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def set_table(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, key, part, bands, text)`` per row; key is a digest of the set, null if it is empty. Bands and
    the compressed text are there for the first row of a set in a task, ``part`` tells which."""
    def run(batches):
        seen: set[bytes] = set()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                hashes, of = shingle_sets(data, at, width)
                n = np.diff(of)
                keys = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
                        for a, b in zip(of[:-1].tolist(), of[1:].tolist())]
                new = [k for k, key in enumerate(keys) if key is not None and key not in seen and not seen.add(key)]
                bands: list = [None] * len(keys)
                blobs: list = [None] * len(keys)
                if new:
                    own = n[new]
                    index = np.repeat(of[new] - np.cumsum(own) + own, own) + np.arange(own.sum())
                    found = band_keys(signatures(hashes[index], np.append(0, np.cumsum(own)))).view(np.int64)
                    for k, row in zip(new, found):
                        bands[k], blobs[k] = row, zstd.compress(data[at[k]:at[k + 1]].tobytes(), 1)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                       pa.array([part] * len(keys), pa.int32()), pa.array(bands, pa.list_(pa.int64())),
                                       pa.array(blobs, pa.binary())], ["doc_id", "n", "key", "part", "bands", "text"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, n bigint, key binary, part int, bands array<bigint>, text binary")


def node_table(table: DataFrame) -> DataFrame:
    """``(node, key, part, n, doc, bands)`` per different set: a number, where its text is, and its least id."""
    sets = table.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), F.min("part").alias("part"))
    first = table.where("bands IS NOT NULL").select("key", "part", "n", "bands")
    return first.join(sets, ["key", "part"]).select(
        F.monotonically_increasing_id().alias("node"), "key", "part", "n", "doc", "bands")


# --- verification ---------------------------------------------------------------------

def _jaccard(width: int, least: int):
    """``(a, b)`` of the rows ``(a, b, text_a, text_b)`` whose sets are as similar as asked."""
    def sets_of(texts: list[bytes]) -> list[np.ndarray]:
        plain = [zstd.decompress(t) for t in texts]
        at = np.append(0, np.cumsum([len(t) for t in plain]))
        hashes, of = shingle_sets(np.frombuffer(b"".join(plain), np.uint8), at.astype(np.int64), width)
        return [hashes[x:y] for x, y in zip(of[:-1], of[1:])]

    def run(batches):
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            keep = np.zeros(batch.num_rows, bool)
            size = 0
            todo: list[int] = []
            for r in range(batch.num_rows):
                todo.append(r)
                size += len(batch.column(3)[r].as_buffer())
                if size < 1 << 20 and r + 1 < batch.num_rows:
                    continue
                for r, other in zip(todo, sets_of([batch.column(3)[r].as_py() for r in todo])):
                    if a[r] != last:
                        last, (own,) = a[r], sets_of([batch.column(2)[r].as_py()])
                    few, many = (own, other) if len(own) < len(other) else (other, own)
                    at = np.searchsorted(many, few)
                    at[at == len(many)] = 0
                    both = int((many[at] == few).sum())
                    keep[r] = 100 * both >= least * (len(own) + len(other) - both)
                todo, size = [], 0
            if keep.any():
                yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])
    return lean(run)


def _texts(table: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, text)`` of the ``wanted`` nodes."""
    places = nodes.select("node", "key", "part").join(wanted, "node", "left_semi")
    return table.where("text IS NOT NULL").select("key", "part", "text").join(places, ["key", "part"]).select("node", "text")


def verified(pairs: DataFrame, table: DataFrame, nodes: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The ``pairs(a, b)`` of nodes that are linked, on their full sets."""
    sizes = nodes.select("node", "n")
    open_ = (pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
             .where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")).select("a", "b"))
    open_ = stored(open_, "minhash-pairs")
    wanted = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
    texts = stored(_texts(table, nodes, wanted), "minhash-texts")
    met = (open_.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
           .select("a", "b", "text_a", "text_b"))
    return met.mapInArrow(_jaccard(width, least), "a bigint, b bigint")


# --- candidates ------------------------------------------------------------------------

def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, node, first, members)`` of the buckets with several nodes."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1")
    return rows.join(sizes, "bucket").select("bucket", "node", "first", "members")


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, node, members, label)`` of the buckets with several components, without their first nodes: those are
    compared with all others."""
    named = (shared.join(labels, "node", "left")
             .select("bucket", "node", "first", "members", F.coalesce("label", "node").alias("label")))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return named.join(mixed, "bucket", "left_semi").where("node != first").select("bucket", "node", "members", "label")


def center_pairs(crowd: DataFrame) -> DataFrame:
    """``(a, b)``: every node of a crowded bucket against ``CENTERS`` nodes of the component that is largest
    there, if it is in another. The nodes that are in most crowded buckets are nearest to what a family has in
    common, so they are the ones that its outer members link with."""
    sizes = crowd.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    aside = (crowd.join(largest, "bucket").where(F.col("label") != F.col("main"))
             .select("node", F.col("main").alias("label")).distinct())
    order = Window.partitionBy("label").orderBy(F.desc("places"), F.xxhash64("node"), "node")
    centers = (crowd.groupBy("label", "node").agg(F.count("*").alias("places")).join(largest.select(F.col("main").alias("label")).distinct(), "label")
               .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= CENTERS).select("label", F.col("node").alias("center")))
    return aside.join(centers, "label").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _rare_shingles(crowd: DataFrame, table: DataFrame, nodes: DataFrame, width: int, least: int) -> DataFrame:
    """``(node, label, buckets, n, shingle, pos)``: the rarest shingles, in number as many as two linked sets must
    share one of, of every node of a crowded bucket, and their places in that order."""
    def shingles(batches):
        for batch in batches:
            names = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                text = zstd.decompress(batch.column(1)[k].as_py())
                hashes, _ = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)
                for i in range(0, len(hashes), 1 << 16):
                    some = hashes[i:i + (1 << 16)].view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(some), names[k])), pa.array(some)], ["node", "shingle"])
    own = crowd.groupBy("node", "label").agg(F.collect_set("bucket").alias("buckets")).join(nodes.select("node", "n"), "node")
    own = stored(own, "minhash-crowd")
    each = stored(_texts(table, nodes, own.select("node")).mapInArrow(lean(shingles), "node bigint, shingle bigint"), "minhash-shingles")
    ranked = each.join(each.groupBy("shingle").agg(F.count("*").alias("seen")).where("seen > 1"), "shingle")
    # a shingle of one set only is the rarest and joins nothing, so only the number of those counts
    shared = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("seen", "shingle"))).alias("all"))
    alone = F.col("n") - F.size("all")
    take = F.col("n") - F.ceil(F.col("n") * least / 100) + 1 - alone
    return (own.join(shared, "node").withColumn("alone", alone).withColumn("take", take).where("take > 0")
            .select("node", "label", "buckets", "n", "alone", F.posexplode(F.expr("slice(all, 1, int(take))")).alias("i", "x"))
            .select("node", "label", "buckets", "n", "x.shingle", (F.col("alone") + F.col("i")).alias("pos")))


def remaining_pairs(left: DataFrame, table: DataFrame, nodes: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """``(a, b)``: the pairs of open buckets whose components differ."""
    few = left.where(F.col("members") <= PAIRS_UP_TO).groupBy("bucket").agg(F.collect_list(F.struct("label", "node")).alias("them"))
    pairs = (few.select("them", F.explode("them").alias("a")).select("a", F.explode("them").alias("b"))
             .where((F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    crowd = left.where(F.col("members") > PAIRS_UP_TO)
    if crowd.limit(1).count():
        rare = stored(_rare_shingles(crowd, table, nodes, width, least), "minhash-rare")
        one, other = (rare.select("shingle", F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("label", "buckets", "n", "pos")))
                      for c in "ab")
        size = F.col("a_n") + F.col("b_n")
        # what two sets can share from their first common shingle on; a linked pair passes there
        most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
        met = one.join(other, (one["shingle"] == other["shingle"]) & (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label"))
                       & ((100 + least) * most >= least * size)
                       & (100 * F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n")) & F.arrays_overlap("a_buckets", "b_buckets"))
        pairs = pairs.unionByName(met.select("a", "b"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``."""
    table = stored(set_table(docs, width, id_col, text_col), "minhash-sets")
    nodes = stored(node_table(table), "minhash-nodes")
    names = nodes.select(F.col("node").alias("fp"), "doc")
    shared = stored(shared_buckets(nodes), "minhash-buckets")
    stars = shared.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(stars, table, nodes, width, least), "minhash-links")
    found = components(names, links)

    def opened() -> DataFrame:
        return stored(_open_buckets(shared, found.select(F.col("fp").alias("node"), F.col("at").alias("label"))), "minhash-open")

    def linked(pairs: DataFrame) -> bool:
        nonlocal links, found
        more = stored(verified(pairs, table, nodes, width, least), "minhash-links")
        if not more.limit(1).count():
            return False
        links = links.unionByName(more)
        found = components(names, links)
        return True
    left = opened()
    crowd = left.where(F.col("members") > PAIRS_UP_TO)
    if crowd.limit(1).count() and linked(center_pairs(crowd)):
        left = opened()
    linked(remaining_pairs(left, table, nodes, width, least))
    named = nodes.join(found.select(F.col("fp").alias("node"), "least", F.lit(True).alias("linked")), "node", "left").select(
        "key", F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc")).alias("component_id"))
    rows = table.select("doc_id", F.col("n").alias("n_shingles"), "key")
    some = rows.where("key IS NOT NULL").join(named, "key").select("doc_id", "n_shingles", "component_id")
    none = rows.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of sets that share a shingle, and the closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met
           FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
           GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * met >= 80 * (na + nb - met)
         UNION ALL SELECT b, a FROM common WHERE 100 * met >= 80 * (na + nb - met)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN lowest ON lowest.doc_id = s.doc_id
"""
