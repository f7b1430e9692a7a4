"""SimHash near-duplicates by a generalised pigeonhole index.

A document's fingerprint has a bit set where over half of its word shingles' hashes
have it. Documents whose fingerprints differ in at most ``most`` bits are linked, and
groups are the connected components.

The index works on distinct fingerprints only, so exact copies, however many, are one
row. Correlated bits are grouped into partitions (a random-looking partition splits
candidates best where its bits say different things). Two fingerprints within ``most``
bits differ in at most ``t_i`` bits in some partition ``i`` whenever the thresholds sum
to ``most - partitions + 1``; dynamic programming gives each partition its own
threshold (-1: not probed) with the least estimated number of candidates. The
estimate takes exact collision counts of all fingerprints at threshold 0 and scales
them by the bits' agreement rates beyond.

A partition of threshold ``t`` is probed by its bits with every ``t`` of them masked:
fingerprints within ``t`` bits share such a key. Candidates that share a key are
verified in pairs while the key holds at most ``PAIRS_UP_TO`` fingerprints. In larger
buckets pairs would grow with the square, so their members meet at hubs instead: a
hub is a fingerprint at most ``most / 2`` bits away, and members of a hub, at most
65 for ``most = 2``, are within ``most`` bits of each other. No link is lost, since two
fingerprints within 2 bits always share a hub.

Defined cases: null text has no words; a text without words has fingerprint 0, one
with fewer than ``width`` words is one shingle; equal rows stay separate rows of one
component; a null doc_id is returned with its fingerprint, and never is a component's
name unless it is alone; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, joined_words, pieces, stored, words

BITS = 64
SEED = 42
PAIRS_UP_TO = 48


# --- fingerprints ------------------------------------------------------------------

def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every document of a piece."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text, at = joined_words(_lower(data), starts, ends)
    of = np.repeat(np.arange(len(n)), shingles)
    begin = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = begin + np.minimum(width, n[of])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[last] - 1).tolist())),
                         np.uint64, len(of))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    if not len(some):
        return out
    edges = (np.cumsum(shingles) - shingles)[some]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    over = 2 * counts > shingles[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_table(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text",
                      with_tid: bool = False) -> DataFrame:
    """``(doc_id, fp)`` per row; fp is the fingerprint's 64 bits as a long. ``with_tid`` adds a
    hash of the text, ``tid``."""
    extra = ["tid"] if with_tid else []

    def make(batch):
        found = [fingerprints(data, at, width) for _, _, data, at in pieces(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found).view(np.int64)),
                               *(batch.column(2) for _ in extra)], ["doc_id", "fp", *extra])
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        *(F.xxhash64(F.col(text_col)).alias(c) for c in extra))
            .mapInArrow(by_batch(make), f"doc_id {kind}, fp bigint" + "".join(f", {c} bigint" for c in extra)))


# --- the index ----------------------------------------------------------------------

def _co_occurrence(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all fingerprints."""
    def count(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8)
            bits = np.unpackbits(fp.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 1 << 16):
                part = bits[i:i + (1 << 16)]
                both += (part.T @ part).astype(np.int64)
            n += len(bits)
        cells = np.append(both.ravel(), n)
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])
    rows = distinct.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of even size, each grown from a seed by the bits most
    correlated with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    free, groups = list(range(BITS)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        group = [max(free, key=lambda b: (link[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (link[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _keys_of(group: list[int], threshold: int) -> list[int]:
    """Bit masks of a partition that leave out every choice of ``threshold`` bits."""
    whole = sum(1 << b for b in group)
    return [whole & ~sum(1 << b for b in out) for out in combinations(group, threshold)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def allocate(groups: list[list[int]], collisions: list[int], n: int, both: np.ndarray, most: int) -> list[int]:
    """Thresholds of the partitions: the least estimated candidates and probe rows among
    all that sum to ``most - len(groups) + 1``."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        chance = np.zeros(t + 2)
        chance[0] = 1.0
        for b in groups[i]:      # chances that a random pair differs in 0, 1, .. t bits
            chance[1:] = chance[1:] * agree[b] + chance[:-1] * (1 - agree[b])
            chance[0] *= agree[b]
        scale = chance[:t + 1].sum() / max(chance[0], 1e-300)
        return collisions[i] * scale + n * len(_keys_of(groups[i], t))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(groups)):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (paid, chosen) in best.items():
            for t in range(-1, most + 1):
                if t > len(groups[i]):
                    continue
                new = (paid + cost(i, t), [*chosen, t])
                if total + t not in step or new[0] < step[total + t][0]:
                    step[total + t] = new
        best = step
    return best[most - len(groups) + 1][1]


def plan_index(distinct: DataFrame, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition."""
    n, both = _co_occurrence(distinct)
    groups = correlated_groups(n, both, most + 1)
    masks = [_signed(_keys_of(g, 0)[0]) for g in groups]
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("i", "key"))
    sums = (keyed.groupBy("i", "key").agg(F.count("*").alias("c"))
            .groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect())
    pairs = {r["i"]: r["pairs"] for r in sums}
    thresholds = allocate(groups, [pairs.get(i, 0) for i in range(len(groups))], n, both, most)
    return list(zip(groups, thresholds))


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], most: int) -> DataFrame:
    """``(a, b)``: pairs of different fingerprints within ``most`` bits that connect all
    such pairs."""
    masks = [(i, _signed(m)) for i, (group, t) in enumerate(plan) if t >= 0 for m in _keys_of(group, t)]
    probes = F.array(*[F.struct(F.lit(k).alias("probe"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for k, (_, m) in enumerate(masks)])
    rows = distinct.select("fp", F.explode(probes).alias("x")).select("fp", "x.probe", "x.key")
    sizes = rows.groupBy("probe", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, ["probe", "key"])
    small = shared.where(F.col("n") <= PAIRS_UP_TO)
    members = small.groupBy("probe", "key").agg(F.collect_list("fp").alias("fps"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    pairs = (members.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b"))
             .where((F.col("a") < F.col("b")) & near))
    crowd = shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    reach = [sum(1 << b for b in flips) for k in range(most // 2 + 1) for flips in combinations(range(BITS), k)]
    hubs = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m))) for m in reach])).alias("hub"))
    at_hub = hubs.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = (at_hub.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
             .where(F.col("a") < F.col("b")))
    if most % 2:      # hubs reach most - 1 bits; an odd last bit is a probe of its own
        extra = crowd.select("fp", F.explode(F.array(*[
            F.col("fp").bitwiseXOR(F.lit(_signed(sum(1 << b for b in flips))))
            for flips in combinations(range(BITS), most // 2 + 1)])).alias("hub"))
        stars = stars.unionByName(extra.join(hubs.withColumnRenamed("fp", "other"), "hub")
                                  .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
                                  .where((F.col("a") < F.col("b")) & near))
    return pairs.unionByName(stars).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, least, at)``: the least ``doc`` of each fingerprint's component and its
    fingerprint, which tells components without an id apart.

    Labels flow along links and jump to their own label's label, so rounds grow with
    the logarithm of a component's diameter. Every round is a stored table.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-links")
    linked = nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi")
    label = F.struct(F.col("doc").isNull().alias("none"), "doc", F.col("fp").alias("at"))
    state = stored(linked.select("fp", label.alias("label")), "simhash-labels")
    while True:
        flow = (both.join(state.select(F.col("fp").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("seen")))
        moved = (state.join(flow, state["fp"] == flow["a"])
                 .select("fp", F.col("label").alias("before"), F.least("label", "seen").alias("label")))
        ahead = state.select(F.col("fp").alias("at"), F.col("label").alias("further"))
        state = stored(moved.join(ahead, F.col("label.at") == F.col("at"))
                       .select("fp", F.least("label", "further").alias("label"),
                               (F.least("label", "further") != F.col("before")).alias("changed")), "simhash-labels")
        if state.where("changed").limit(1).count() == 0:
            return state.select("fp", F.col("label.doc").alias("least"), F.col("label.at").alias("at"))


def _named(docs: DataFrame, width: int, most: int, id_col: str, text_col: str, with_tid: bool) -> DataFrame:
    """The fingerprint table with ``component_id`` and ``component``, a fingerprint."""
    table = stored(fingerprint_table(docs, width, id_col, text_col, with_tid), "simhash-fingerprints")
    nodes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    plan = plan_index(nodes.select("fp"), most)
    found = components(nodes, links(nodes.select("fp"), plan, most))
    names = nodes.join(found, "fp", "left").select("fp", F.coalesce("least", "doc").alias("component_id"),
                                                   F.coalesce("at", "fp").alias("component"))
    return table.join(names, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``."""
    return _named(docs, width, most, id_col, text_col, False).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """One document of each component, the one with the least id, of several texts with
    that id or of texts without an id one of the least fingerprint; its repeated rows are one row."""
    found = _named(docs, width, most, "doc_id", "text", True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "tid")).alias("first")
    keep = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.tid").alias("_tid"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_tid"))
    return docs.join(keep.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"])


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
