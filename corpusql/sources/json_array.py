"""JSON arrays of objects, read by several tasks a file.

A file is cut into byte ranges as Spark cuts text files, with ``}`` as the line separator: every chunk
ends at a closing brace, whatever the layout of the file. Where a range starts, it is unknown whether that is
inside a string and how deep, but both follow from what comes before:

1. every range is scanned once for both cases: the parity of its quotes, and by how much it changes
   the depth if it starts outside or inside a string;
2. running sums over the ranges of a file (one row each) give every range its start;
3. every range is scanned again from its start and gives its records. One that crosses into the next
   range is given in pieces, and the few pieces are put together by record number.

The number of a record is its place among all that start, over the files in the order of their paths,
so positions are dense and records do not move. What stands between records must be commas and white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.session import stored

QUOTE, BACKSLASH, OPEN, CLOSE, COMMA = 0x22, 0x5C, 0x7B, 0x7D, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[OPEN, 0x5B]] = 1
_STEP[[CLOSE, 0x5D]] = -1
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09, 0x0A, 0x0D, COMMA, 0x5B, 0x5D]] = True
MARK = b"\xef\xbb\xbf"
RUN_BYTES = 1 << 20           # that are scanned at once, unless a chunk is longer


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"), "value",
        F.input_file_name().alias("path"))


def _runs(batches) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """((file, start), row, bytes) of consecutive chunks of a range in a batch, the separators put back; about ``RUN_BYTES``
    at a time, since the scan takes some 50 bytes a byte and a batch is a number of chunks of any length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values = batch.column(2).cast(pa.large_string())
        _, offsets, data = values.buffers()
        at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (at[1:-1] // RUN_BYTES != at[:-2] // RUN_BYTES)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(file)]):
            ends = at[i + 1:j + 1] - at[i] + np.arange(j - i)
            own = np.empty(at[j] - at[i] + j - i, np.uint8)
            kept = np.ones(len(own), bool)
            kept[ends] = False
            own[kept], own[ends] = data[at[i]:at[j]], CLOSE
            yield (int(file[i]), int(start[i])), int(i), own


def _inside(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Whether each byte follows an odd number of quotes of this run, and the parity of them all. A run starts
    behind a brace, so no backslash is open."""
    quote = data == QUOTE
    slash = data == BACKSLASH
    if slash.any():
        places = np.arange(len(data))
        last = np.maximum.accumulate(np.where(slash, -1, places))
        at = np.flatnonzero(quote)
        before = np.where(at > 0, at - 1 - last[at - 1], 0)       # backslashes right before the quote
        quote[at[before % 2 == 1]] = False
    count = np.cumsum(quote)
    return ((count - quote) % 2).astype(bool), int(count[-1] % 2) if len(count) else 0


def _summaries(batches):
    """``(path, file, start, parity, outside, inside, array)`` of each range: by how much it changes the depth if it starts
    outside or inside a string, and whether it begins with an opening bracket."""
    held: dict[tuple, list] = {}
    paths: dict[tuple, str] = {}

    def ended():
        rows = [(paths[k], *k, *v) for k, v in held.items()]
        held.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                               ["path", "file", "start", "parity", "outside", "inside", "array"])
    for batch in batches:
        for key, row, data in _runs([batch]):
            if key not in held:
                if held:
                    yield ended()
                first = data.tobytes()[:1 << 16].removeprefix(MARK).lstrip(b" \t\r\n")[:1]
                held[key], paths[key] = [0, 0, 0, first == b"["], batch.column(3)[row].as_py()
            inside, parity = _inside(data)
            step = _STEP[data]
            own = held[key]
            even, odd = int(step[~inside].sum()), int(step[inside].sum())
            own[1] += odd if own[0] else even
            own[2] += even if own[0] else odd
            own[0] ^= parity
    if held:
        yield ended()


def _bad(text: bytes) -> ValueError:
    return ValueError(f"not an array of objects: {text[:80]!r}")


def _records(batches):
    """``(file, start, n, whole, text)``: records and pieces of records of each range; n counts the records
    that start in it and is -1 for a piece of one that started before."""
    state: tuple | None = None       # the range that is read
    string = depth = n = 0
    pending: list[bytes] = []

    def rows(found: list[tuple]):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], ["file", "start", "n", "whole", "text"])
    for batch in batches:
        for key, row, data in _runs([batch]):
            if key != state:
                if pending:
                    yield rows([(*state, n - 1, False, b"".join(pending).decode())])
                state, n, pending = key, 0, []
                string, depth = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                if key[1] == 0 and data[:3].tobytes() == MARK:
                    data = data[3:]
            inside, parity = _inside(data)
            outside = inside if string else ~inside
            after = depth + np.cumsum(np.where(outside, _STEP[data], 0))
            starts = np.flatnonzero(outside & (data == OPEN) & (after == 2))
            ends = np.flatnonzero(outside & (data == CLOSE) & (after == 1))
            between = outside & (after <= 1)
            between[ends] = False
            if len(between) and after[-1] == -1:
                between[-1] = False              # the separator that Spark does not say was missing
            wrong = between & ~_BETWEEN[data]
            if wrong.any():
                raise _bad(data[np.flatnonzero(wrong)[0]:].tobytes())
            content, found, k, last = data.tobytes(), [], 0, None
            if depth >= 2:                       # a record is open
                if len(ends):
                    last = ends[0] + 1
                    found.append((*key, n - 1, n > 0, b"".join([*pending, content[:last]]).decode()))
                    pending, k = [], 1
                else:
                    pending.append(content)
            for a, b in zip(starts, ends[k:]):
                if last is not None and content[last:a].strip() != b",":
                    raise _bad(content[last:b])
                last = b + 1
                found.append((*key, n, True, content[a:last].decode()))
                n += 1
            if len(starts) > len(ends) - k:
                pending = [content[starts[-1]:]]
                n += 1
            string ^= parity
            depth = int(after[-1]) if len(after) else depth
            if found:
                yield rows(found)
    if pending:
        yield rows([(*state, n - 1, False, b"".join(pending).decode())])


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, record)``: the text of every object of the arrays in ``path``. Raises if a file is
    no array of objects or ends within one."""
    chunks = _chunks(spark, path)
    ranges = stored(chunks.mapInArrow(_summaries, "path string, file bigint, start bigint, parity int, outside bigint, inside bigint, array boolean"),
                    "json-ranges")
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = (ranges.withColumn("string", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
              .withColumn("step", F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside")))
              .withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))))
    states = stored(states.select("path", "file", "start", "array", "string", "step", "depth", "parity"), "json-states")
    wrong = states.groupBy("path").agg(F.sum("step").alias("depth"), (F.sum("parity") % 2).alias("string"),
                                       F.min_by("array", "start").alias("array")).where("depth != -1 OR string != 0 OR NOT array")
    if bad := wrong.select("path").first():
        raise PySparkValueError(f"{bad['path']} is no complete JSON array of objects")
    # one row per range of a file
    starts = F.broadcast(states.select("file", "start", "string", "depth"))
    pieces = stored(chunks.join(starts, ["file", "start"]).select("file", "start", "value", "path", "string", "depth")
                    .mapInArrow(_records, "file bigint, start bigint, n bigint, whole boolean, text string"), "json-records")
    counts = pieces.groupBy("file", "start").agg((F.max("n") + 1).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(states.select("path", "file", "start").join(counts, ["file", "start"]).select(
        "file", "start", first.alias("first")), "json-offsets")
    placed = pieces.join(F.broadcast(offsets), ["file", "start"])
    whole = placed.where("whole").select((F.col("first") + F.col("n")).alias("pos"), F.col("text").alias("record"))
    cut = (placed.where("NOT whole").groupBy((F.col("first") + F.col("n")).alias("pos"))
           .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
           .select("pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("record")))
    return whole.unionByName(cut)
