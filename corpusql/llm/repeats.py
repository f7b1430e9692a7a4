"""Windows that occur more than once in a corpus: what both substring operators share.

Texts are sequences of units (bytes or words). A window of ``length`` units is anchored
at the least hash among its runs of ``k`` units, so equal windows have equal anchors,
wherever they occur, and windows that share an anchor are neighbours. Only anchors whose hash occurs again can
hold a repeated window; the text around them (a segment) goes to the task of its anchor's
hash, where an index over the segments finds the repeated windows. Nothing is lost by
the anchors, since they follow from the window alone.

Skew: runs of units that are frequent in the whole corpus (at most ``HEAVY`` of them, a
bound by counting, so they are broadcast) are anchors only where a window holds no
other run. A window that lies in a common passage and reaches over its edge is then
anchored at the edge, and what stays anchored in the passage is equal text. Equal
segments are one row per task before they are shuffled, so a passage that a third of all
documents share meets as few rows.

A hash with more than ``HOT_BYTES`` of text around it, a limit that doesn't grow with the corpus, is split
by what its equal windows share (``split_hot``): they lie equally far from the anchor, so the windows of a
band of distances have a core of text in common, and the core's hash deals them on. Bands narrow to
one window, whose core is the window, so at the end all segments of a hash are equal and are one row.

A document is known by ``did`` (its id; null is the largest number) and ``tid`` (a hash of its text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, lean, least_of_runs, mixed, parts_for, pieces, span_hashes, stored, window_hashes, words

HEAVY = 1 << 17
LEAST_HEAVY = 64
LEAST_IN_PIECE = 4
NO_ID = (1 << 63) - 1
PART_BYTES = 8 << 20
HELD_BYTES = 8 << 20
HOT_BYTES = 2 << 20
SIZE_UNIT = 256
BANDS = 4


@dataclass(frozen=True)
class Kind:
    """What a window is: ``length`` units, anchored at runs of ``k``."""
    unit: str          # "byte" or "word"
    length: int
    k: int

    def units(self, data: np.ndarray, at: np.ndarray):
        """(values, document offsets in units, start and end bytes of the units)."""
        if self.unit == "byte":
            where = np.arange(len(data), dtype=np.int64)
            return data, at, where, where + 1
        starts, ends, first = words(data, at)
        return span_hashes(data, starts, ends), first, starts, ends


@dataclass
class Anchors:
    """Runs of consecutive window starts ``lo..hi`` with one anchor."""
    doc: np.ndarray
    nth: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    heavy: np.ndarray
    at: np.ndarray


def anchors(kind: Kind, values: np.ndarray, first: np.ndarray, heavy: np.ndarray) -> Anchors:
    length, k = kind.length, kind.k
    grams = window_hashes(values, k)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(values)) + length <= ends)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(bool), none)
    common = np.zeros(len(grams), bool)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
        common = heavy[at] == grams
    order = (grams >> np.uint64(33)) | (common.astype(np.uint64) << np.uint64(31))
    packed = (order << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    where = (least_of_runs(packed, length - k + 1)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1))
    lo, hi = starts[new], starts[np.append(new[1:], True)]
    doc = np.searchsorted(first, lo, "right") - 1
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    nth = np.arange(len(lo)) - np.repeat(begins, np.diff(np.append(begins, len(lo))))
    return Anchors(doc, nth, lo, hi, grams[where[new]], common[where[new]], where[new])


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


# --- rows that travel packed ------------------------------------------------------------
# Millions of small rows are shuffled as one compressed row per task and part.

PACKED = "part int, content binary"
DTYPES = (np.int64, np.int64, np.int64, np.int32, np.int32)      # key, did, tid, nth, size
SEGMENT = (np.int64, np.int64, np.int32, np.int64, np.int64)     # key, seg, starts, n, least


def _freeze(columns: list[np.ndarray], texts: list[bytes] | None) -> bytes:
    body = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    if texts is not None:
        body += np.array([len(t) for t in texts], np.int32).tobytes() + b"".join(texts)
    return zstd.compress(len(columns[0]).to_bytes(4, "little") + body, 1)


def _thaw(content: bytes, dtypes) -> tuple[list[np.ndarray], list[bytes]]:
    body = zstd.decompress(content)
    n, at, columns = int.from_bytes(body[:4], "little"), 4, []
    for d in dtypes:
        columns.append(np.frombuffer(body, d, n, at))
        at += n * np.dtype(d).itemsize
    texts: list[bytes] = []
    if at < len(body):
        ends = np.cumsum(np.frombuffer(body, np.int32, n, at), dtype=np.int64) + at + 4 * n
        texts = [body[a:b] for a, b in zip([at + 4 * n, *ends[:-1].tolist()], ends.tolist())]
    return columns, texts


def _dealt(rows: list[list[np.ndarray]], texts: list[bytes] | None, parts: int, apart: bool = False):
    """Packed rows per part of the first column, a hash; ``apart``: not dealt, part -1."""
    if not rows or not sum(len(r[0]) for r in rows):
        return
    columns = [np.concatenate(c) for c in zip(*rows)]
    if apart:
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([_freeze(columns, texts)], pa.binary())], ["part", "content"])
        return
    part = (mixed(columns[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        use = order[cuts[p]:cuts[p + 1]]
        content = _freeze([c[use] for c in columns], None if texts is None else [texts[i] for i in use])
        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([content], pa.binary())], ["part", "content"])


def _gathered(batches, dtypes):
    """All rows of a task's part together."""
    found = [_thaw(blob.as_py(), dtypes) for batch in batches for blob in batch.column(1)]
    if found:
        yield [np.concatenate(c) for c in zip(*(f[0] for f in found))], [t for f in found for t in f[1]]


def heavy_runs(docs: DataFrame, kind: Kind) -> np.ndarray:
    """Sorted hashes of the runs that make up at least one of ``HEAVY`` of all runs of the
    corpus. Such a run has that share in some piece, and pieces report no others. Which runs are
    heavy only decides how work is spread, never a result."""
    def count(batches):
        total, found = 0, {}
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                values, _, _, _ = kind.units(data, at)
                keys, counts = np.unique(window_hashes(values, kind.k), return_counts=True)
                total += len(values)
                many = counts >= max(LEAST_IN_PIECE, len(values) / HEAVY)
                for k, c in zip(keys[many].tolist(), counts[many].tolist()):
                    found[k] = found.get(k, 0) + c
        keys = [k for k, c in found.items() if c >= total / HEAVY]
        yield pa.record_batch([_long(np.array(keys, np.uint64)), pa.array([found[k] for k in keys], pa.int64())], ["key", "n"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([total])], ["key", "n"])
    sums = docs.select("text").mapInArrow(lean(count), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    sums = sums.where(F.col("key").isNull() | (F.col("n") >= LEAST_HEAVY)).orderBy(F.col("key").isNotNull(), F.desc("n"), "key").limit(HEAVY + 1)
    rows = sums.collect()
    total = sum(r["n"] for r in rows if r["key"] is None)
    keys = [r["key"] for r in rows if r["key"] is not None and r["n"] >= total / HEAVY]
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def _once(doc: np.ndarray, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the first anchor of every document and hash, whether there are more, the size of all)."""
    order = np.lexsort((key, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1]))[:len(order)]
    begins = np.flatnonzero(new)
    total = np.add.reduceat(size[order], begins) if len(begins) else size
    return order[begins], np.diff(np.append(begins, len(order))) > 1, total


def shared_anchors(docs: DataFrame, kind: Kind, heavy: np.ndarray, across: bool, parts: int) -> DataFrame:
    """``(did, tid, picks)``: per document, one anchor of each hash that occurs again (``across``:
    in another document). A hash travels once per document, however often a document
    has it, as it does in periodic text; ``nth`` is then negative. In ``picks`` a negative one
    is that of a hash with over ``HOT_BYTES`` of text around it, or a heavy one."""
    most = HOT_BYTES

    def emit(batches):
        rare, heavies = [], []
        for batch in batches:
            did, tid = (batch.column(i).to_numpy() for i in (0, 1))
            for i, j, data, at in pieces(batch.column(2)):
                values, first, starts, ends = kind.units(data, at)
                a = anchors(kind, values, first, heavy)
                if not len(a.lo):
                    continue
                size = -(-(ends[a.hi + kind.length - 1] - starts[a.lo]) // SIZE_UNIT)
                use, more, size = _once(a.doc, a.key, size)
                nth = np.where(more, -1 - a.nth[use], a.nth[use]).astype(np.int32)
                row = [a.key[use].view(np.int64), did[i:j][a.doc[use]], tid[i:j][a.doc[use]], nth, size.astype(np.int32)]
                rare.append([x[~a.heavy[use]] for x in row])
                heavies.append([x[a.heavy[use]] for x in row])
        yield from _dealt(rare, None, parts)
        yield from _dealt(heavies, None, parts, apart=True)

    def again(batches):
        for rows, _ in _gathered(batches, DTYPES):
            key, did, tid, nth, size = rows
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order][1:] != key[order][:-1])
            begins = np.flatnonzero(new)
            if across:
                many = np.minimum.reduceat(did[order], begins) < np.maximum.reduceat(did[order], begins)
            else:
                many = (np.diff(np.append(begins, len(key))) > 1) | (np.minimum.reduceat(nth[order], begins) < 0)
            of = np.empty(len(key), np.int64)
            of[order] = np.cumsum(new) - 1
            hot = np.add.reduceat(size[order].astype(np.int64), begins) * SIZE_UNIT > most
            nth = np.where(nth < 0, -1 - nth, nth)
            nth = np.where(hot[of], -1 - nth, nth)
            use = np.flatnonzero(many[of])
            yield pa.record_batch([pa.array(x[use]) for x in (did, tid, nth)], ["did", "tid", "nth"])

    def open_(batches):
        for batch in batches:
            for blob in batch.column(1):
                _, did, tid, nth, _ = _thaw(blob.as_py(), DTYPES)[0]
                yield pa.record_batch([pa.array(x) for x in (did, tid, np.where(nth < 0, nth, -1 - nth))], ["did", "tid", "nth"])
    every = docs.select("did", "tid", "text").mapInArrow(lean(emit), PACKED)
    schema = "did bigint, tid bigint, nth int"
    found = every.where("part >= 0").repartitionById(parts, F.col("part")).mapInArrow(lean(again), schema)
    found = found.unionByName(every.where("part < 0").mapInArrow(lean(open_), schema))
    return found.groupBy("did", "tid").agg(F.collect_list("nth").alias("picks"))


def _picked(kind: Kind, heavy: np.ndarray, batch: pa.RecordBatch, hot: bool | None = None):
    """Per piece of a batch: its rows and bytes, its units, and the picked anchors with
    their segments' hashes; only those that are ``hot`` or not, or all."""
    text, picks = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("picks"))
    for i, j, data, at in pieces(text):
        values, first, starts, ends = kind.units(data, at)
        a = anchors(kind, values, first, heavy)
        if not len(a.lo):
            continue
        some = picks.slice(i, j - i)
        sizes = np.bincount(a.doc, minlength=j - i)
        base = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(j - i), some.value_lengths().fill_null(0).to_numpy())
        # a pick stands for all anchors of its hash in its document
        pair = mixed(a.key + a.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        nth = some.flatten().to_numpy()
        at_pick = base[doc] + np.where(nth < 0, -1 - nth, nth)
        if hot is not None:
            at_pick = at_pick[(nth < 0) == hot]
        use = np.flatnonzero(np.isin(pair, pair[at_pick]))
        a = Anchors(*(x[use] for x in (a.doc, a.nth, a.lo, a.hi, a.key, a.heavy, a.at)))
        # a segment is known by its text and how many window starts it has
        seg = mixed(span_hashes(values, a.lo, a.hi + kind.length) + (a.hi - a.lo).astype(np.uint64))
        yield i, j, data, starts, ends, first, a, seg


def _merged(kind: Kind, heavy: np.ndarray, batch: pa.RecordBatch, hot: bool, sent: set[int]):
    """Per piece of a batch, its different segments: ``([key, seg, starts, n, least], distance of the
    first start from the anchor, texts)``. A text that was ``sent`` before is empty."""
    did = batch.column(batch.schema.get_field_index("did")).to_numpy()
    for i, j, data, starts, ends, first, a, seg in _picked(kind, heavy, batch, hot):
        name = mixed(a.key ^ mixed(seg))
        order = np.argsort(name, kind="stable")
        new = np.append(True, name[order][1:] != name[order][:-1])[:len(order)]
        begins = np.flatnonzero(new)
        if not len(begins):
            continue
        use = order[begins]
        row = [a.key[use].view(np.int64), seg[use].view(np.int64), (a.hi - a.lo + 1)[use].astype(np.int32),
               np.diff(np.append(begins, len(order))), np.minimum.reduceat(did[i:j][a.doc][order], begins)]
        raw, texts = data.tobytes(), []
        for x, b, e in zip(name[use].tolist(), starts[a.lo[use]].tolist(), ends[a.hi[use] + kind.length - 1].tolist()):
            texts.append(b"" if x in sent else raw[b:e])
            sent.add(x)
        yield row, (a.at - a.lo)[use], texts


def segments(joined: DataFrame, kind: Kind, heavy: np.ndarray, parts: int) -> DataFrame:
    """Packed ``(key, seg, starts, n, least, text)``: different segments with the number of their
    occurrences and the least ``did``, without the hot ones. A task sends a segment's text once and
    an empty one after."""
    def run(batches):
        sent: set[int] = set()
        rows, texts, size = [], [], 0
        for batch in batches:
            for row, _, some in _merged(kind, heavy, batch, False, sent):
                rows.append(row)
                texts += some
                size += sum(map(len, some))
                if size >= HELD_BYTES:
                    yield from _dealt(rows, texts, parts)
                    rows, texts, size = [], [], 0
        yield from _dealt(rows, texts, parts)
    return joined.mapInArrow(lean(run), PACKED)


def occurrences(joined: DataFrame, kind: Kind, heavy: np.ndarray) -> DataFrame:
    """``(key, seg, did, tid, lo)``: where every segment starts, in units of its document."""
    def run(batch):
        did, tid = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("did", "tid"))
        for i, j, data, starts, ends, first, a, seg in _picked(kind, heavy, batch):
            yield pa.record_batch([_long(a.key), _long(seg), pa.array(did[i:j][a.doc]), pa.array(tid[i:j][a.doc]),
                                   pa.array((a.lo - first[a.doc]).astype(np.int64))], ["key", "seg", "did", "tid", "lo"])
    return joined.mapInArrow(by_batch(run), "key bigint, seg bigint, did bigint, tid bigint, lo bigint")


Solve = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def solved(segs: DataFrame, solve: Solve, parts: int, most_bytes: int) -> DataFrame:
    """``(key, seg, flags)`` from ``solve(texts, starts, n, least)`` over whole keys, about
    ``most_bytes`` of text at a time; segments without flags are left out, as are keys that
    occur once."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for (key, seg, starts, n, least), texts in _gathered(batches, SEGMENT):
            empty = np.array([not t for t in texts])
            order = np.lexsort((empty, seg, key))      # of equal segments one, with its text
            new = np.append(True, (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1]))
            begins, use = np.flatnonzero(new), order[new]
            n, least = np.add.reduceat(n[order], begins), np.minimum.reduceat(least[order], begins)
            key, seg, starts = key[use], seg[use], starts[use].astype(np.int64)
            again = np.add.reduceat(n, np.flatnonzero(np.append(True, key[1:] != key[:-1]))) > 1
            some = again[np.cumsum(np.append(True, key[1:] != key[:-1])) - 1]
            key, seg, starts, n, least, use = (x[some] for x in (key, seg, starts, n, least, use))
            if not len(use):
                continue
            sizes = np.cumsum([len(texts[i]) for i in use])
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))      # of each key
            before = np.append(0, sizes)[first]
            a = 0
            while a < len(use):
                k = int(np.searchsorted(before, (sizes[a - 1] if a else 0) + most_bytes))
                b = int(first[k]) if k < len(first) else len(use)
                b = b if b > a else int(np.append(first, len(use))[np.searchsorted(first, a, "right")])
                found = solve([texts[i] for i in use[a:b]], starts[a:b], n[a:b], least[a:b])
                keep = [i for i, f in enumerate(found) if len(f)]
                yield pa.record_batch([pa.array(key[a:b][keep]), pa.array(seg[a:b][keep]),
                                       pa.array([found[i] for i in keep], kind)], ["key", "seg", "flags"])
                a = b
    return segs.repartitionById(parts, F.col("part")).mapInArrow(lean(run), "key bigint, seg bigint, flags array<bigint>")


# --- hashes with much text around them ---------------------------------------------------

ROWS = "key bigint, seg bigint, away int, starts int, n bigint, least bigint, text binary"


def hot_segments(joined: DataFrame, kind: Kind, heavy: np.ndarray) -> DataFrame:
    """``ROWS`` of the hot picks; ``away``: how far the first start is from the anchor. A task
    sends a segment's text once."""
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for row, away, texts in _merged(kind, heavy, batch, True, sent):
                key, seg, starts, n, least = row
                yield pa.record_batch([pa.array(x) for x in (key, seg, away.astype(np.int32), starts, n, least)]
                                      + [pa.array(texts, pa.binary())], ROWS.replace(",", "").split()[::2])
    return joined.mapInArrow(lean(run), ROWS)


def _different(rows: DataFrame) -> DataFrame:
    """Equal segments as one, with its text."""
    return rows.groupBy("key", "seg").agg(F.first("away").alias("away"), F.first("starts").alias("starts"), F.sum("n").alias("n"),
                                          F.min("least").alias("least"), F.max("text").alias("text"))


def _banded(rows: DataFrame, kind: Kind, width: int) -> DataFrame:
    """``(of_key, of_seg, off)`` and ``ROWS`` of the parts of segments: starts whose distance from the
    anchor lies in one band of ``width`` all hold the text between, the core."""
    def run(batch):
        key, seg, away, starts, n, least = (batch.column(c).to_numpy() for c in range(6))
        for i, j, data, at in pieces(batch.column(6)):
            values, first, begin, end = kind.units(data, at)
            far = away[i:j].astype(np.int64)
            low = (far - starts[i:j] + 1) // width
            many = far // width - low + 1
            r = np.repeat(np.arange(j - i), many)
            band = low[r] + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            lo = np.maximum(0, far[r] - band * width - width + 1)
            hi = np.minimum(starts[i:j][r] - 1, far[r] - band * width)
            core = first[r] + far[r] - band * width
            shared = span_hashes(values, core, core - width + 1 + kind.length)
            new = mixed(key[i:j][r].view(np.uint64) ^ mixed(shared + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            name = mixed(span_hashes(values, first[r] + lo, first[r] + hi + kind.length) + (hi - lo).astype(np.uint64))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(begin[first[r] + lo].tolist(), end[first[r] + hi + kind.length - 1].tolist())]
            yield pa.record_batch(
                [pa.array(key[i:j][r]), pa.array(seg[i:j][r]), pa.array(lo), _long(new), _long(name),
                 *(pa.array(x.astype(np.int32)) for x in (far[r] - lo, hi - lo + 1)), pa.array(n[i:j][r]),
                 pa.array(least[i:j][r]), pa.array(texts, pa.binary())],
                ["of_key", "of_seg", "off", *ROWS.replace(",", "").split()[::2]])
    return rows.mapInArrow(by_batch(run), f"of_key bigint, of_seg bigint, off bigint, {ROWS}")


def split_hot(rows: DataFrame, kind: Kind) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of different segments, no key of them with more than ``HOT_BYTES`` of text unless it is one
    segment; tables ``(of_key, of_seg, off, key, seg)`` that lead from round to round)."""
    done, ways, width = [], [], kind.length - kind.k + 1
    here = stored(_different(rows), "repeats-hot")
    while True:
        hot = stored(here.groupBy("key").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
                     .where((F.col("size") > HOT_BYTES) & (F.col("n") > 1)).select("key"), "repeats-hot-keys")
        if width == 1 and ways or hot.isEmpty():
            return [*done, here], ways
        done.append(here.join(hot, "key", "left_anti"))
        width = -(-width // BANDS)
        split = stored(_banded(here.join(hot, "key", "left_semi").select(here.columns), kind, width), "repeats-bands")
        ways.append(split.select("of_key", "of_seg", "off", "key", "seg"))
        here = stored(_different(split.drop("of_key", "of_seg", "off")), "repeats-hot")


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    def run(batch):
        key, seg, starts, n, least = (batch.column(c).to_numpy() for c in range(5))
        yield from _dealt([[key, seg, starts, n, least]], batch.column(5).to_pylist(), parts)
    return rows.select("key", "seg", "starts", "n", "least", "text").mapInArrow(by_batch(run), PACKED)


def hot_flags(joined: DataFrame, kind: Kind, heavy: np.ndarray, solve: Solve, parts: int, most_bytes: int) -> DataFrame:
    """``(key, seg, off, flags)`` of the hot picks; ``off``: the start in its segment that ``flags`` begin at."""
    tables, ways = split_hot(hot_segments(joined, kind, heavy), kind)
    packed = _packed(tables[0], parts)
    for t in tables[1:]:
        packed = packed.unionByName(_packed(t, parts))
    flags = stored(solved(packed, solve, parts, most_bytes).select("key", "seg", F.lit(0).cast("bigint").alias("off"), "flags"),
                   "repeats-hot-flags")
    found = flags
    for way in reversed(ways):
        up = found.withColumnRenamed("off", "inner").join(way, ["key", "seg"])
        found = flags.unionByName(up.select(F.col("of_key").alias("key"), F.col("of_seg").alias("seg"),
                                            (F.col("off") + F.col("inner")).alias("off"), "flags"))
    return found


def with_flags(docs: DataFrame, kind: Kind, solve: Solve, across: bool, wanted=None, most_bytes: int = 2 << 20) -> DataFrame:
    """``docs(did, tid, text, ..)`` with ``found``, an array of (lo, flags) or null.

    ``wanted``, a condition on ``flags`` and ``did``, drops flags that decide nothing for a
    document. Both joins read one shuffle of the texts."""
    parts = parts_for(docs, PART_BYTES)
    heavy = heavy_runs(docs, kind)
    # merge joins at every size: both sides grow with the corpus
    picks = stored(shared_anchors(docs, kind, heavy, across, parts), "repeats-picks")
    joined = docs.join(picks.hint("merge"), ["did", "tid"])
    flagged = solved(segments(joined, kind, heavy, parts), solve, parts, most_bytes).withColumn("off", F.lit(0).cast("bigint"))
    hot = picks.where(F.exists("picks", lambda x: x < 0))
    if not hot.isEmpty():
        flagged = flagged.unionByName(hot_flags(docs.join(hot, ["did", "tid"]), kind, heavy, solve, parts, most_bytes))
    found = occurrences(joined, kind, heavy).join(flagged, ["key", "seg"]).withColumn("lo", F.col("lo") + F.col("off"))
    if wanted is not None:
        found = found.where(wanted)
    found = found.groupBy("did", "tid").agg(F.collect_list(F.struct("lo", "flags")).alias("found"))
    return docs.join(found.hint("merge"), ["did", "tid"], "left")


def known_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(did, tid, text, rest)`` with the other columns in ``rest``."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("did"),
                       F.xxhash64(docs[text_col]).alias("tid"), docs[text_col].alias("text"), rest.alias("rest"))
