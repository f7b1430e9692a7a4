"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is trained on all texts labelled trusted. Its symbols are code points, its order is 4. An n-gram is a
row ``(ctx, w)``: the up to three code points before, 21 bits each, and the last one. The model stays sharded by n-gram:
counts, continuation counts, context totals, discounts and interpolated probabilities are aggregates and joins,
and only the counts of counts that the discounts need come to the driver.

Texts are scored by joins too. The different n-grams of each block of texts (``BLOCK_BYTES``) are gathered, each
n-gram with its blocks; every different one gets its probability by joins with the sharded counts of all orders;
probabilities go back to the blocks, where they meet the texts. Texts travel as compressed Arrow
tables of one block, once to meet the ids of trusted documents and once to meet the probabilities.

A document is scored as if ``PRIOR`` symbols of average trusted text came with it, so a
few rare letters in a short text weigh little. It is rejected where the perplexity is above its language's threshold: the
``QUANTILE`` of that language's trusted documents, times ``MARGIN``. Languages without trusted documents
use the quantile of all trusted ones. A code point that no trusted text has shares the mass of one unknown symbol.

Defined cases: null or empty text has no perplexity and is rejected, since nothing
speaks for it; without trusted texts nothing is rejected but those; a null language is
a language of its own; labels may repeat (a document with any positive label is
trusted); repeated rows are decided alike; other columns stay untouched. Texts are read more than once; if Spark cuts
them otherwise in between, the job raises. So rows that are not read straight from files are stored first (``settled``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# the small closed form that tests hold against brute force
from corpusql.llm.byteclasses import ORDER, SYMBOL_BITS, SYMBOLS, count_ngrams, dense, ngrams, smoothed  # noqa: F401
from corpusql.llm.common import lean, pieces, release_memory, stored

LENGTH, CODE_BITS = 4, 21            # of an n-gram, and of a code point
QUANTILE = 0.99
MARGIN = 1.03           # of the quantile, for clean texts that are a little rarer still
PRIOR = 100             # symbols of average trusted text that every document is read with
BLOCK_BYTES = 16 << 20
STREAM = 2 << 20        # bytes of text that travel as one row
PIECE = 1 << 20         # bytes of text that are handled at once
_TABLE = 1 << 22        # entries of a lookup table
_START = 0x0A           # a document begins like a line
_LEAD = np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint8)


# --- code points and n-grams of a block -------------------------------------------

def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document offsets in them) of UTF-8 texts. Stray bytes count with the character before."""
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    width = np.minimum(np.diff(np.append(first, len(data))), 4)
    points = (data[first] & _LEAD[width - 1]).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        points[more] = points[more] << 6 | (data[first[more] + k] & 0x3F)
    return points, np.concatenate([[0], np.cumsum(lead)])[at]


def _ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different codes ascending, rank of each code); codes are below ``size``."""
    if size > _TABLE:
        return np.unique(codes, return_inverse=True)
    present = np.zeros(size, bool)
    present[codes] = True
    rank = np.cumsum(present, dtype=np.int32) - 1
    return np.flatnonzero(present), rank[codes]


def different_ngrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, last code points, n-gram of each place): the different n-grams that end at a code point."""
    begins = offsets[:-1][np.diff(offsets) > 0]
    alphabet, symbol = _ranked(np.append(points, _START), 1 << CODE_BITS)
    start, symbol = symbol[-1], symbol[:-1].astype(np.int64)
    history = [symbol]
    for _ in range(LENGTH - 1):
        back = np.concatenate([[start], history[-1]])[:len(symbol)]
        back[begins] = start
        history.append(back)
    which, grams = history[-1], [alphabet]           # ``grams``: the code points of every different n-gram so far
    count = len(alphabet)
    for last in history[-2::-1]:
        codes, which = _ranked(which * len(alphabet) + last, count * len(alphabet))
        which, count = which.astype(np.int64), len(codes)
        grams = [*(g[codes // len(alphabet)] for g in grams), alphabet[codes % len(alphabet)]]
    context = np.zeros(count, np.int64)
    for g in grams[:-1]:
        context = context << CODE_BITS | g
    return context, grams[-1], which


# --- blocks of texts --------------------------------------------------------------

class _Blocks:
    """Block numbers of a task's texts: they follow the bytes before a text, so they are the same in every pass."""

    def __init__(self):
        self.first, self.bytes = TaskContext.get().partitionId() << 32, 0

    def of(self, lengths: np.ndarray) -> np.ndarray:
        before = self.bytes + np.cumsum(lengths) - lengths
        self.bytes += int(lengths.sum())
        return self.first + before // BLOCK_BYTES


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batch: pa.RecordBatch, blocks: np.ndarray):
    """(block, rows) of a batch's runs of one block."""
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
    for i, j in zip(cuts, cuts[1:]):
        yield int(blocks[i]), batch.slice(i, j - i)


def block_ids(docs: DataFrame) -> DataFrame:
    """``(block, doc_id)`` per row."""
    def run(batches):
        blocks = _Blocks()
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.record_batch([pa.array(blocks.of(lengths)), batch.column(0)], ["block", "doc_id"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).mapInArrow(run, f"block bigint, doc_id {kind}")


def packed(docs: DataFrame) -> DataFrame:
    """``(block, rows)``: the rows of a block as compressed Arrow streams of about ``STREAM`` bytes of text each, as a
    row that holds a whole block takes several times its size where rows are sorted and sent to Python."""
    text = docs.columns.index("text")

    def run(batches):
        blocks = _Blocks()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = _lengths(batch.column(text))
            places = blocks.of(lengths)
            # a new stream where a block begins or STREAM bytes are full
            for part, block in streams(batch, lengths, places):
                sink = pa.BufferOutputStream()
                # a copy, so that a slice doesn't bring its whole batch
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part.take(pa.array(np.arange(part.num_rows))))
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                      ["block", "rows"])
    return docs.mapInArrow(lean(run), "block bigint, rows binary")


def streams(batch: pa.RecordBatch, lengths: np.ndarray, blocks: np.ndarray):
    """(rows, block) of a batch's runs of one block and of about ``STREAM`` bytes of text."""
    before = (np.cumsum(lengths) - lengths) // STREAM
    cuts = [0, *(np.flatnonzero(np.diff(blocks) | np.diff(before)) + 1), len(blocks)]
    for i, j in zip(cuts, cuts[1:]):
        yield batch.slice(i, j - i), int(blocks[i])


def _unpacked(group: pa.Table):
    for rows in group.column("rows"):
        yield from pa.ipc.open_stream(rows.as_buffer())


# --- counts -----------------------------------------------------------------------

def _gram_rows(context, last, counts) -> pa.Table:
    return pa.table({"ctx": pa.array(context, pa.int64()), "w": pa.array(last, pa.int32()), "c": pa.array(counts, pa.int64())})


def trusted_counts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(ctx, w, c)`` over the texts of all rows whose id is among ``ids``, stored."""
    placed = block_ids(docs)
    # a merge join at every size: the trusted ids grow with the corpus
    trusted = stored(placed.join(ids.hint("merge"), placed["doc_id"] == F.col("_id"), "left_semi"), "quality-trusted")

    def run(packed_rows: pa.Table, some: pa.Table) -> pa.Table:
        found, met = [], 0
        own = some.column("doc_id").combine_chunks()
        if len(own):
            for batch in _unpacked(packed_rows):
                good = batch.filter(pc.is_in(batch.column(0), value_set=own, skip_nulls=True))
                met += good.num_rows
                for _, _, data, at in pieces(good.column(1), PIECE):
                    context, last, which = different_ngrams(*code_points(data, at))
                    found.append(_gram_rows(context, last, np.bincount(which, minlength=len(context))))
        release_memory()
        return pa.concat_tables([_gram_rows([-1], [-1], [met]), *found])      # the first row counts documents
    counts = stored(packed(docs.select("doc_id", "text")).groupBy("block").cogroup(trusted.groupBy("block"))
                    .applyInArrow(run, "ctx bigint, w int, c bigint").groupBy("ctx", "w").agg(F.sum("c").alias("c")),
                    "quality-ngrams")
    met = counts.where("ctx = -1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    if met != trusted.count():
        raise PySparkRuntimeError("the texts were cut otherwise when their ids were read")
    return counts.where("ctx <> -1")


def suffix(n: int):
    """The context of the n-gram of length ``n`` at the end of a longer one."""
    return F.col("ctx").bitwiseAND(F.lit((1 << CODE_BITS * (n - 1)) - 1))


class Model:
    """Sharded tables per order: ``grams[n]`` ``(ctx, w, p)`` with discounted probabilities and ``contexts[n]``
    ``(ctx, g)`` with the weight of the next lower order."""

    def __init__(self, counts: DataFrame):
        self.counts, seen = counts, {LENGTH: counts}
        for n in range(LENGTH - 1, 0, -1):      # how many different symbols come before an n-gram
            seen[n] = stored(seen[n + 1].groupBy(suffix(n).alias("ctx"), "w").agg(F.count("*").alias("c")), f"quality-{n}grams")
        self.grams, self.contexts = {}, {}
        for n, table in seen.items():
            d = discounts(table)
            cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            row = table.withColumn("cut", cut)
            totals = row.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
            self.grams[n] = row.join(totals, "ctx").select("ctx", "w", ((F.col("c") - F.col("cut")) / F.col("total")).alias("p"))
            self.contexts[n] = totals.select("ctx", (F.col("freed") / F.col("total")).alias("g"))
        self.symbols = seen[1].count() + 1      # and the unknown one

    def probabilities(self, wanted: DataFrame, n: int = LENGTH) -> DataFrame:
        """``(ctx, w, p)`` of the different n-grams ``wanted``, all orders interpolated."""
        found = (wanted.join(self.grams[n].withColumnRenamed("p", "own"), ["ctx", "w"], "left")
                 .join(self.contexts[n], "ctx", "left"))
        if n == 1:
            below = F.lit(1.0 / self.symbols)
        else:
            lower = self.probabilities(wanted.select(suffix(n - 1).alias("ctx"), "w").distinct(), n - 1)
            found = (found.withColumn("_rest", suffix(n - 1))
                     .join(lower.select(F.col("ctx").alias("_rest"), "w", F.col("p").alias("_below")), ["_rest", "w"]))
            below = F.col("_below")
        return found.select("ctx", "w", (F.coalesce("own", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * below).alias("p"))


def discounts(seen: DataFrame) -> list[float]:
    of = {r["c"]: r["n"] for r in seen.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(raw)]


# --- scores -----------------------------------------------------------------------

def block_ngrams(docs: DataFrame) -> DataFrame:
    """``(ctx, w, block)`` for the n-grams of every block of texts, read where they are."""
    def run(batches):
        blocks = _Blocks()
        for batch in batches:
            if not batch.num_rows:
                continue
            for block, part in _parts(batch, blocks.of(_lengths(batch.column(0)))):
                found = [different_ngrams(*code_points(data, at))[:2] for _, _, data, at in pieces(part.column(0), PIECE)]
                context, last = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((last, context))
                context, last = context[order], last[order]
                new = np.append(True, (context[1:] != context[:-1]) | (last[1:] != last[:-1]))[:len(context)]
                context, last = context[new], last[new].astype(np.int32)
                for i in range(0, len(context), 100_000):
                    some = slice(i, i + 100_000)
                    yield pa.record_batch([pa.array(context[some]), pa.array(last[some]),
                                           pa.array(np.full(len(context[some]), block))], ["ctx", "w", "block"])
    return docs.select("text").mapInArrow(lean(run), "ctx bigint, w int, block bigint")


def _sorted_places(context: np.ndarray, last: np.ndarray, contexts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Where each n-gram is in a list sorted by context and last symbol; raises if one is missing."""
    known, first = np.unique(contexts, return_index=True)
    rank = np.searchsorted(known, context)
    if len(context) and (not len(known) or rank.max() >= len(known) or (known[rank] != context).any()):
        raise ValueError("the texts were cut otherwise when their n-grams were read")
    ranks = np.repeat(np.arange(len(known)), np.diff(np.append(first, len(contexts))))
    at = np.searchsorted(ranks << CODE_BITS | lasts, rank << CODE_BITS | last)
    if len(context) and (at.max() >= len(lasts) or (lasts[at] != last).any() or (ranks[at] != rank).any()):
        raise ValueError("the texts were cut otherwise when their n-grams were read")
    return at


def with_perplexity(docs: DataFrame, model: Model, name: str = "perplexity") -> DataFrame:
    """``docs`` with the perplexity of ``text``, null for texts without symbols."""
    text, schema = docs.columns.index("text"), docs.schema
    rows = block_ngrams(docs)
    # plain rows to where they are grouped: most n-grams of a task are different
    gathered = stored(rows.repartition("ctx").groupBy("ctx", "w").agg(F.collect_list("block").alias("blocks")), "quality-wanted")
    known = stored(model.probabilities(gathered.select("ctx", "w")).select("ctx", "w", F.log("p").alias("l")), "quality-logs")
    mean = known.join(model.counts, ["ctx", "w"]).agg((F.sum(F.col("l") * F.col("c")) / F.sum("c")).alias("mean")).first()["mean"]
    usual = mean or 0.0
    sent = gathered.join(known, ["ctx", "w"]).select(F.explode("blocks").alias("block"), "ctx", "w", F.col("l").cast("float").alias("l"))

    def run(packed_rows: pa.Table, logs: pa.Table) -> pa.Table:
        contexts, lasts, values = (logs.column(c).to_numpy() for c in ("ctx", "w", "l"))
        order = np.lexsort((lasts, contexts))
        contexts, lasts, values = contexts[order], lasts[order].astype(np.int64), values[order].astype(np.float64)
        out = []
        for batch in _unpacked(packed_rows):
            found = []
            for _, _, data, at in pieces(batch.column(text), PIECE):
                points, offsets = code_points(data, at)
                context, last, which = different_ngrams(points, offsets)
                n = np.diff(offsets)
                sums = np.zeros(len(n))
                if len(points):
                    each = values[_sorted_places(context, last, contexts, lasts)][which]
                    sums[n > 0] = np.add.reduceat(each, offsets[:-1][n > 0])
                found.append(np.where(n > 0, np.exp(-(sums + PRIOR * usual) / (n + PRIOR)), np.nan))
            scores = np.concatenate(found)
            out.append(pa.Table.from_batches([batch.append_column(name, pa.array(scores, mask=np.isnan(scores)))]))
        release_memory()
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in empty})
    empty = [*to_arrow_schema(schema), pa.field(name, pa.float64())]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return packed(docs).groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"{kinds}, `{name}` double")


class Classifier:
    """A fitted model: ``scores`` are the given columns with ``perplexity``; ``limits(_lang, _limit)``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, columns: list[str], perplexity: str = "perplexity",
                 trusted: str = "quality", quantile: float = QUANTILE):
        ids = labels.where(F.col(trusted) == 1).select(F.col("doc_id").alias("_id")).distinct()
        model = Model(trusted_counts(docs, ids))
        self.empty = model.symbols == 1
        self.scores = stored(with_perplexity(docs, model, perplexity).select(*columns, perplexity), "quality-perplexities")
        language = F.col("lang").cast("string").alias("_lang")
        good = self.scores.select("doc_id", language, perplexity)
        good = good.join(ids.hint("merge"), good["doc_id"] == F.col("_id"), "left_semi")
        level = F.percentile_approx(perplexity, quantile, 10_000)
        overall = good.agg(level.alias("overall"))
        limits = good.groupBy(F.col("_lang").alias("_l")).agg(level.alias("own"))
        languages = self.scores.select(language).distinct()
        self.limits = stored(languages.join(limits, F.col("_lang").eqNullSafe(F.col("_l")), "left")
                             .select("_lang", (F.coalesce("own", overall.scalar(), F.lit(float("inf"))) * MARGIN).alias("_limit")),
                             "quality-limits")

    def judged(self, scored: DataFrame, perplexity: str) -> DataFrame:
        """``scored`` with ``_limit`` and ``_keep``; limits are one row per language."""
        limit = F.lit(float("inf")) if self.empty else F.col("_limit")
        found = scored.join(self.limits, F.col("lang").cast("string").eqNullSafe(F.col("_lang")), "left")
        return found.withColumn("_keep", F.coalesce(F.col(perplexity) <= limit, F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, settled: bool = False) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, keep)`` per row of ``docs``; ``settled``: they are read straight from files."""
    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    model = Classifier(narrow if settled else stored(narrow, "quality-documents"), labels, ["doc_id", "lang"])
    return model.judged(model.scores, "perplexity").select(
        "doc_id", "lang", "perplexity", F.col("_limit").alias("threshold"), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, settled: bool = False) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    model = Classifier(docs if settled else stored(docs, "quality-documents"), labels, docs.columns, "_perplexity")
    return model.judged(model.scores, "_perplexity").where("_keep").select(*docs.columns)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), settled=True)
