"""Filter interaction audit by truth-table survival words.

Five filters drop documents. A document's *survival word* has 32 bits, one per subset of the
filters: bit ``s`` is set if the document survives when exactly the filters of ``s`` are
applied, that is if it fails none of them. Counting every bit's ones over a group of
documents (a positional popcount) gives the survivors of all 32 subsets at once, and
each figure of the audit follows from those 32 counts: what a filter removes at any place of
any order is the difference of two of them.

The popcount is carry-save: words are bit columns, a full adder turns three words of weight
2^k into one of weight 2^k and one of weight 2^(k+1), so 32 counters are advanced by five bitwise
operations. Each task adds up its own words per part and label and sends 32 numbers for
each of them, however many documents there are.

"Identical to a smaller doc_id's text" is the only filter that looks at other rows. Rows are
counted per id, text digest, part and labels, and copies of a text by the same part and labels
become one row with its least id, so a text that a third of all rows share is a few rows
when the digest's least id is sought.

Defined cases: null text is the empty text, null source the empty part; a null id is larger than any other,
and several rows without an id don't make each other fail; rows equal in id and text don't either; labels that
repeat for an id count if any row has 1; a null label is not 1; texts of any length are read whole; an empty
table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import lean

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORDS = r"[^\x20\x09-\x0D]+"
#: Groups that a task adds up before it sends them on.
MOST_GROUPS = 4096


# --- filters -------------------------------------------------------------------------

def failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails; E needs the other rows."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def bits(found: Column) -> Column:
        n, distinct = F.size(found), F.size(F.array_distinct(found))
        conditions = (n < 200, 100 * distinct.cast("bigint") < 50 * n.cast("bigint"),
                      100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 2 * F.length(text).cast("bigint"),
                      text.rlike("[#$%&*|]"))
        return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    return F.element_at(F.transform(F.array(words), bits), 1)      # the words are cut once


def survival_word(failed: Column) -> Column:
    """The 32-bit word of the subsets that meet none of the ``failed`` bits, as a long."""
    table = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
    return F.element_at(F.lit(np.array(table, np.int64)), failed + 1)


# --- positional popcount ----------------------------------------------------------------

def carry_save(words: np.ndarray) -> np.ndarray:
    """How many of the ``words`` have each of the 32 bits set."""
    counts = np.zeros(SUBSETS, np.int64)
    places, weight, level = np.arange(SUBSETS, dtype=np.uint32), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            half = a ^ b
            carries.append(a & b | c & half)
            level = np.concatenate([half ^ c, level[3 * n:]])
        for word in level:
            counts += weight * ((word >> places) & np.uint32(1)).astype(np.int64)
        weight *= 2
        level = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
    return counts


def _popcounts(batches):
    """``(part, good, toxic, c0 .. c31)`` of the words that a task reads."""
    sums: dict[tuple, np.ndarray] = {}

    def emit():
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
        counts = np.array([sums[k] for k in keys], np.int64).reshape(len(keys), SUBSETS)
        sums.clear()
        return pa.record_batch([*columns, *(pa.array(counts[:, s]) for s in range(SUBSETS))],
                               ["part", "good", "toxic", *(f"c{s}" for s in range(SUBSETS))])
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + good * 2 + toxic
        times = batch.column(4).to_numpy(zero_copy_only=False)
        words = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint32)
        if (times > 1).any():       # rows equal in all that counts are as many words
            words, group = np.repeat(words, times), np.repeat(group, times)
        order = np.argsort(group, kind="stable")
        words, group = words[order], group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(group)]):
            key = (names[group[a] >> 2], bool(group[a] & 2), bool(group[a] & 1))
            sums[key] = sums.get(key, 0) + carry_save(words[a:b])
        if len(sums) > MOST_GROUPS:
            yield emit()
    if sums:
        yield emit()


# --- the audit -------------------------------------------------------------------------

def document_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, good, toxic, word, n)``: survival words and how many documents of a part and
    label have them for one text."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("failed"))
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                                         F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    # rows without an id have no label and would all meet in one task of the join
    known = facts.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select(
        *facts.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    marked = known.unionByName(facts.where("doc_id IS NULL").withColumns({"good": no, "toxic": no}))
    group = ["digest", "failed", "part", "good", "toxic"]
    by_id = marked.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("place"), "n")).alias("first"))
    least = F.min("first.place").over(Window.partitionBy("digest"))
    copy = 1 << FILTERS.index("E")
    kept = F.when(F.col("first.place") == F.col("least"), F.col("first.n")).otherwise(0)
    cases = F.array(F.struct(F.col("failed"), kept.cast("bigint").alias("n")),
                    F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - kept).cast("bigint").alias("n")))
    split = texts.withColumn("least", least).select("part", "good", "toxic", F.explode(cases).alias("case"))
    return split.where("case.n > 0").select("part", "good", "toxic", survival_word(F.col("case.failed")).alias("word"), "case.n")


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, alive, alive_good, alive_toxic)``: per part the survivors of all 32 subsets, as arrays
    of longs; of all documents and of those with either label."""
    columns = [f"c{s}" for s in range(SUBSETS)]
    counted = document_words(docs, labels).mapInArrow(
        lean(_popcounts), "part string, good boolean, toxic boolean, " + ", ".join(f"{c} bigint" for c in columns))
    zero = F.lit(0).cast("bigint")
    by_part = counted.groupBy("part").agg(*(
        F.sum(c if of is None else F.when(F.col(of), F.col(c)).otherwise(zero)).alias(f"{of}_{c}")
        for of in (None, "good", "toxic") for c in columns))
    return by_part.select("part", *(F.array(*(F.col(f"{of}_{c}") for c in columns)).alias(name)
                                    for of, name in ((None, "alive"), ("good", "alive_good"), ("toxic", "alive_toxic"))))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    steps = len(FILTERS)
    at = subset_survivors(docs, labels).select(
        "*", F.explode(F.lit(ORDERS)).alias("filter_order")).select(
        "*", F.explode(F.lit(list(range(1, steps + 1)))).alias("step"))

    def subset(letters: Column) -> Column:
        return sum((F.when(letters.contains(f), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))

    def alive(s: Column, of: str = "alive") -> Column:
        return F.element_at(of, s + 1)
    whole = SUBSETS - 1
    at = (at.withColumn("before", subset(F.expr("left(filter_order, step - 1)")))
          .withColumn("after", subset(F.expr("left(filter_order, step)"))))
    at = at.withColumn("own", F.col("after") - F.col("before"))
    removed = alive(F.col("before")) - alive(F.col("after"))
    factorial = (1, 1, 2, 6, 24)
    # of all orders, as many have just the filters of s before the own one as s and the others can be ordered
    ways = F.lit([factorial[s.bit_count()] * factorial[steps - 1 - s.bit_count()] if s != whole else 0 for s in range(SUBSETS)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(whole)), F.lit(0).cast("bigint"), lambda total, s: total + F.when(
        s.bitwiseAND(F.col("own")) == 0, F.element_at(ways, s + 1) * (
            alive(s) - alive(s.bitwiseOR(F.col("own"))))).otherwise(0))
    return at.select(
        "part", "filter_order", "step", alive(F.col("after")).alias("kept"), removed.alias("removed"),
        (alive(F.lit(0)) - alive(F.col("own")) - removed).alias("redundant"),
        (alive(F.lit(whole) - F.col("own")) - alive(F.lit(whole))).alias("unique_fails"),
        *((alive(F.col("before"), f"alive_{of}") - alive(F.col("after"), f"alive_{of}")).alias(name)
          for of, name in (("good", "good_lost"), ("toxic", "toxic_lost"))),
        shapley.alias("shapley"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Every document is taken through every order one filter after the other.
ORACLE_SQL = r"""
WITH marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d0 AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
d1 AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text) < coalesce(doc_id, 9223372036854775807) AS copy FROM d0),
d2 AS (SELECT doc_id, part,
         (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN copy THEN 'E' ELSE '' END) AS fails FROM d1),
d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM d2 LEFT JOIN marks ON marks.doc_id = d2.doc_id GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o),
x AS (SELECT part, fails, n, good, toxic, filter_order, step, substr(filter_order, step, 1) AS own,
        list_min(list_filter([1, 2, 3, 4, 5], lambda k: contains(fails, substr(filter_order, k, 1)))) AS gone FROM d, s),
y AS (SELECT part, filter_order, step, any_value(own) AS own,
        CAST(sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN contains(fails, own) AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
