"""Source divergence audit over collapsed texts.

How far does each source's use of words stray from that of the other sources of its language,
and by which words? Texts that several documents of a language share are collapsed: one row
per text with the number of its copies in every source, so a text is tokenized once, and its
terms are added with the copies as weights, to the counts of occurrences and of documents.

A term's share in a source is smoothed, ``p = 1 + floor(10^9 (count + 1) / (N + V))``, so every one
of the V kept terms has a share everywhere, and a pair of sources is compared over all of
them: ``f(p, q) = floor((p - q)^2 / q)``. The sums are sparse all the same. With ``s0`` and ``t0`` for the shares of a
term that is absent, the pair (s, t) is

    sum over terms of s of f(p, t0) + sum over terms of t of f(s0, q)
    + (V - terms of s - terms of t) f(s0, t0)
    + sum over common terms of f(p, q) - f(p, t0) - f(s0, q) + f(s0, t0).

The first two sums need a histogram of each source's shares only (a source has few different
counts), the last one a row per common term. Everything is whole numbers.

Defined cases: null text, lang and source are empty; a text without terms has none but its source
still is a group; repeated rows are documents of their own; equal values rank by item in UTF-8 order; texts of
any length are read whole; sums beyond a long raise; an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import lean, pieces, stored

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Rows of counts that a task gathers before it adds up equal ones and sends them on.
GATHER = 400_000


# --- collapsed texts and their terms -------------------------------------------------------

def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def collapsed(docs: DataFrame) -> DataFrame:
    """``(lang, text, sources)`` per different text of a language; sources are ``(source, n)`` with
    the number of documents. Texts move once, by language and digest, copies of a task as one."""
    keyed = _plain(docs).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    times = (keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
             .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources")))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(times, ["lang", "digest"]).select("lang", "text", "sources")


def tokenized(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a piece and the document of each: runs of letters A-Z (lower-cased) and a-z and of
    bytes from 0x80 up."""
    upper = (data - np.uint8(0x41)) <= 25
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = upper | ((data - np.uint8(0x61)) <= 25) | (data >= 0x80)
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    letters = np.where(upper, data | 0x20, data)[inside[1:-1]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms, np.searchsorted(at, starts, "right") - 1


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], [np.add.reduceat(v[order], starts) for v in values]


def _term_counts(batches):
    """``(lang, term, source, c, d)``: occurrences and documents of the terms that a task reads."""
    names = ["lang", "term", "source", "c", "d"]
    held: list[pa.Table] = []

    def gathered():
        table = pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("c", "sum"), ("d", "sum")])
        held.clear()
        return table.select([*names[:3], "c_sum", "d_sum"]).rename_columns(names)
    for batch in batches:
        langs, sources = batch.column("lang"), batch.column("sources")
        first = np.append(0, np.cumsum(pc.list_value_length(sources).to_numpy()))
        flat = sources.flatten()
        source = flat.field("source").dictionary_encode()
        source_of, times = source.indices.to_numpy(), flat.field("n").to_numpy()
        lang = langs.dictionary_encode()
        lang_of = lang.indices.to_numpy()
        for i, j, data, at in pieces(batch.column("text"), 4 << 20):
            terms, of = tokenized(data, at)
            if not len(terms):
                continue
            term = terms.dictionary_encode()
            pairs, tf = np.unique(of.astype(np.int64) * len(term.dictionary) + term.indices.to_numpy(), return_counts=True)
            doc, code = i + pairs // len(term.dictionary), pairs % len(term.dictionary)
            copies = first[doc + 1] - first[doc]          # one row per term, text and source
            row = np.repeat(np.arange(len(doc)), copies)
            at_source = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) + first[doc[row]]
            key = (code[row] * len(source.dictionary) + source_of[at_source]) * len(lang.dictionary) + lang_of[doc[row]]
            key, (c, d) = _summed(key, tf[row] * times[at_source], times[at_source])
            rest = key // len(lang.dictionary)
            held.append(pa.table([lang.dictionary.take(pa.array(key % len(lang.dictionary))),
                                  term.dictionary.take(pa.array(rest // len(source.dictionary))).cast(pa.string()),
                                  source.dictionary.take(pa.array(rest % len(source.dictionary))),
                                  pa.array(c), pa.array(d)], names))
            if sum(len(t) for t in held) > GATHER:
                held.append(gathered())
                if len(held[0]) > GATHER // 2:
                    yield from held.pop().to_batches(1 << 16)
    if held:
        yield from gathered().to_batches(1 << 16)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, term, total, entries)`` of the terms in at least ``least`` documents of a language;
    entries are ``(source, c)`` in the order of sources."""
    rows = collapsed(docs).mapInArrow(lean(_term_counts), "lang string, term string, source string, c bigint, d bigint")
    # one shuffle serves both sums: by term within a language, then by source within that
    by_source = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    return (by_source.groupBy("lang", "term").agg(
        F.sum("c").alias("total"), F.sum("d").alias("df"), F.array_sort(F.collect_list(F.struct("source", "c"))).alias("entries"))
        .where(F.col("df") >= least).select("lang", "term", "total", "entries"))


# --- shares ---------------------------------------------------------------------------

def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (n + v))``; beyond a long the product is a decimal."""
    count = count.cast("bigint")
    whole = F.call_function("div", (count + 1) * F.lit(SCALE), n + v)
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE), (n + v).cast("decimal(20,0)"))
    return 1 + F.when(count < 9_000_000_000, whole).otherwise(wide).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, n, k, v, lang_n, p0)`` per occurring group: occurrences and number of its
    kept terms, those of its language, and the share of a term that it hasn't."""
    groups = _plain(docs).select("lang", "source").distinct()
    own = (terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source"))
           .agg(F.sum("e.c").alias("n"), F.count("*").alias("k")))
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    zero = F.lit(0).cast("bigint")
    found = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "k", "v", "lang_n")))
    return found.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v"))))


def term_values(terms: DataFrame, groups: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """The ``ranks`` terms of each group that most exceed their share in the language."""
    each = (terms.select("lang", "term", "total", F.explode("entries").alias("e"))
            .select("lang", "term", "total", F.col("e.source").alias("source"), F.col("e.c").alias("c"))
            .join(groups, ["lang", "source"])
            .withColumn("p", share(F.col("c"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))))
    over = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                      distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(over).where(F.col("rank") <= ranks)


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of each group's language with the sum over all kept terms."""
    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "k", "p0")), "v")
    one, other = side("s"), side("t").drop("v")
    ends = one.join(other, "lang").where(F.col("s") != F.col("t"))
    absent = ends.select("lang", "s", "t", F.when(F.col("v") > 0, (F.col("v") - F.col("s_k") - F.col("t_k"))
                                                  * distance(F.col("s_p0"), F.col("t_p0"))).otherwise(0).cast("bigint").alias("value"))

    own = (terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("s"), F.col("e.c").alias("c"))
           .agg(F.count("*").alias("terms")).join(one, ["lang", "s"]).withColumn("p", share(F.col("c"), F.col("s_n"), F.col("v"))))
    alone = (own.join(other, "lang").where(F.col("s") != F.col("t")).groupBy("lang", "s", "t").agg(
        F.sum(F.col("terms") * distance(F.col("p"), F.col("t_p0"))).alias("here"),
        F.sum(F.col("terms") * distance(F.col("t_p0"), F.col("p"))).alias("there")))

    # of a term's sources each pair is met once, for both directions
    first = (terms.select("lang", "entries", F.posexplode("entries").alias("at", "e"))
             .select("lang", F.expr("slice(entries, at + 2, size(entries))").alias("rest"), F.col("e.source").alias("s"), F.col("e.c").alias("c"))
             .where(F.size("rest") > 0).join(one, ["lang", "s"])
             .select("lang", "s", "s_p0", "v", share(F.col("c"), F.col("s_n"), F.col("v")).alias("p"), F.explode("rest").alias("e")))
    both = (first.select("lang", "s", "s_p0", "v", "p", F.col("e.source").alias("t"), F.col("e.c").alias("c")).join(other, ["lang", "t"])
            .withColumn("q", share(F.col("c"), F.col("t_n"), F.col("v"))))

    def common(p, q, p0, q0):
        p, q, p0, q0 = (F.col(c) for c in (p, q, p0, q0))
        return F.sum(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0))
    shared = both.groupBy("lang", "s", "t").agg(common("p", "q", "s_p0", "t_p0").alias("here"), common("q", "p", "t_p0", "s_p0").alias("there"))
    swap = ["lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("there").alias("value")]
    keep = ["lang", "s", "t", F.col("here").alias("value")]
    parts = absent
    for part in (alone, shared):
        parts = parts.unionByName(part.select(*keep)).unionByName(part.select(*swap))
    return _ranked(parts.groupBy("lang", F.col("s").alias("source"), F.lit("pair").alias("part"), F.col("t").alias("item"))
                   .agg(F.sum("value").alias("value")))


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` and ``term``."""
    terms = stored(kept_terms(docs, least), "divergence-terms")
    groups = stored(group_table(docs, terms), "divergence-groups")
    return pair_values(terms, groups).unionByName(term_values(terms, groups, ranks))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of sources over every kept term.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(total) AS n, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (n.n + ln.v) AS p,
        1 + 1000000000 * (kept.total + 1) // (ln.n + ln.v) AS q
      FROM n JOIN ln ON ln.lang = n.lang JOIN kept ON kept.lang = n.lang
      LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                       WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
