"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: lines and sentences, long ones cut at white
space after at most 80 characters. Every paragraph is hashed to a wide vector, and the
fingerprint is the sum of those vectors:

* 8 lanes of 32 bits, summed modulo 2**32, tell multisets apart;
* 60 counters of the set bits of one more hash, two to a number with 32 bits each: a row's text has under
  2**31 bytes, so no counter of a text ever reaches its neighbour. ``2 * count - paragraphs`` are sums of
  random signs, so their cosine estimates the cosine of two multisets (standard error about 0.13);
* the number of paragraphs.

Sums make the fingerprint independent of order and let ``insert`` and ``delete`` update
it without the text. Everything is built-in functions; a fingerprint needs no shuffle.

Defined cases: null text is the empty text, whose fingerprint is zero; two empty texts
have likeness 1, an empty and another 0; rows equal in id and text are one document,
repeated in the result; null ids come last; the only document is its own next one; texts of any length
that a row can hold are counted exactly; an empty table gives an empty result; other columns may have any name.
``insert`` of texts with 2**32 paragraphs or more in all is beyond the counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import stored
from corpusql.operators.positions import dense_positions

PARAGRAPH = r"(?s)[^\n]{0,80}?(?:[.!?;]\s|\n)|[^\n]{0,80}\s|.{1,80}"
WIDE, SIGNS = 4, 30
LOW32 = 0xFFFFFFFF
TWO = 1 | 1 << 32


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_lanes(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of ``text`` as an array of longs."""
    hashes = [f"_{name}_h{j}" for j in range(WIDE + 1)]
    found = df.withColumn(f"_{name}_p", F.regexp_extract_all(_text(text), F.lit(PARAGRAPH), F.lit(0)))

    def hashed(j):
        return F.transform(f"_{name}_p", lambda p: F.xxhash64(F.lit(j), p))
    found = found.withColumns({h: hashed(j) for j, h in enumerate(hashes)})

    def total(h, part):
        return F.aggregate(h, F.lit(0).cast("bigint"), lambda s, x: s + part(x))
    lanes = []
    for h in hashes[:WIDE]:
        lanes.append(total(h, lambda x: x.bitwiseAND(F.lit(LOW32))).bitwiseAND(F.lit(LOW32)))
        lanes.append(total(h, lambda x: F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(LOW32)))
    lanes += [total(hashes[-1], bit_pair(b)) for b in range(SIGNS)]
    lanes.append(F.size(f"_{name}_p").cast("bigint"))
    return found.withColumn(name, F.array(*lanes)).drop(f"_{name}_p", *hashes)


def bit_pair(first: int):
    return lambda x: F.shiftrightunsigned(x, first).bitwiseAND(F.lit(TWO))


def insert(one: Column, other: Column) -> Column:
    """Fingerprint of two texts' paragraphs together."""
    return _combined(one, other, 1)


def delete(one: Column, other: Column) -> Column:
    """Fingerprint without the paragraphs of ``other``, which ``one`` contains."""
    return _combined(one, other, -1)


def _combined(one: Column, other: Column, sign: int) -> Column:
    both = F.zip_with(one, other, lambda a, b: a + F.lit(sign) * b)
    return F.transform(both, lambda x, i: F.when(i < 2 * WIDE, x.bitwiseAND(F.lit(LOW32))).otherwise(x))


def as_text(lanes: Column) -> Column:
    """Fixed-width hexadecimal of all lanes."""
    return F.lower(F.array_join(F.transform(
        lanes, lambda x, i: F.lpad(F.hex(x), F.when(i < 2 * WIDE, 8).otherwise(16), F.lit("0"))), ""))


def signs(lanes: Column) -> Column:
    """The 60 sums of random signs."""
    n = F.element_at(lanes, -1)
    packed = F.slice(lanes, 2 * WIDE + 1, SIGNS)

    def half(k):
        return lambda x: (2 * F.shiftrightunsigned(x, 32 * k).bitwiseAND(F.lit(LOW32)) - n).cast("double")
    return F.concat(*[F.transform(packed, half(k)) for k in range(2)])


def likeness(one: Column, other: Column) -> Column:
    """Estimated cosine of two multisets, 0 to 1; from columns made by ``signs``."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(one, one)) * F.sqrt(dot(other, other))
    return (F.when(one == other, F.lit(1.0)).when(size == 0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(one, other) / size))))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lanes)`` per row, in one pass and without a shuffle."""
    df = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("text"))
    return with_lanes(df, "text", "lanes").select("doc_id", "lanes")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of the texts with their last quarter replaced by the
    next document's beginning, and their likeness.

    The order of documents comes from a narrow table of ids. Texts are shuffled once
    by key; the beginnings that the edits need travel by themselves.
    """
    key = F.sha2(F.concat_ws("\u0000", F.col("doc_id").cast("string"), F.col("text")).cast("binary"), 256)
    df = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("text")).withColumn("key", key)
    ids = stored(df.select("doc_id", "key", F.length("text").alias("n"))
                 .groupBy("doc_id", "key").agg(F.first("n").alias("n")), "fingerprint-ids")
    order = dense_positions(ids, [F.col("doc_id").asc_nulls_last(), F.col("key")], name="nth")
    order = stored(order.select("nth", "key", "n"), "fingerprint-order")
    after = order.select(F.when(F.col("nth") == 0, order.agg(F.max("nth")).scalar())
                         .otherwise(F.col("nth") - 1).alias("nth"), F.col("key").alias("next"))
    edits = order.join(after, "nth").select(F.col("key").alias("of"), "next", F.floor(F.col("n") / 4).cast("int").alias("q"))

    laned = with_lanes(df, "text", "lanes")   # both joins read one shuffle of it
    heads = (laned.join(edits, F.col("key") == F.col("next"))
             .groupBy("of").agg(F.first("doc_id").alias("next_id"), F.first("q").alias("q"),
                                F.first(F.expr("substring(text, 1, q)")).alias("head"),
                                F.first("lanes").alias("next_lanes")))
    both = laned.join(heads, F.col("key") == F.col("of")).withColumn("n_chars", F.length("text").cast("bigint"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars) - q), head)"))
    both = with_lanes(both, "edited", "edited_lanes")
    both = both.withColumns({f"{c}_signs": signs(F.col(c)) for c in ("lanes", "edited_lanes", "next_lanes")})
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes_signs"), F.col("edited_lanes_signs")).alias("near_edited"),
        likeness(F.col("lanes_signs"), F.col("next_lanes_signs")).alias("near_next"), "next_id")


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
