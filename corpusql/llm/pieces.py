"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words where no piece can cross: between two characters that stand side by
side in no piece, such as a letter and the white space behind it. Every different word becomes a lattice: its
substrings up to the longest piece are exploded, an equi-join with the piece table (a
vocabulary file, so bounded, and broadcast) keeps the edges, and the edges of a word
are grouped and folded with Spark's higher-order ``aggregate``:

* unigram models: Viterbi, forward over the end positions, best sum of scores, ties to
  the longer last piece;
* BPE models: sums of scores don't give the segmentation of such a model, so the fold
  takes the same edges in the order of their merges (score, then position). An edge is taken
  if both its ends are still borders and one border lies between them, which then
  falls. Merges only ever lead to later ones, so one fold in that order is BPE.

Words up to ``LONGEST`` characters are folded by Spark. The rare longer ones, words with
pieces of equal score (runs of spaces), and words without any piece are encoded one by one. Characters
without a piece are their UTF-8 bytes' pieces.

Documents are taken in blocks of about ``BLOCK_BYTES``, and a block numbers its different words by their
first occurrence. The words are dealt by themselves, each is folded once for the whole corpus, and its ids go
back to the blocks that hold it as packed rows without the words. Texts travel as the numbers of their words,
and the block puts both together. So no dictionary of all words is ever gathered, and a hot word is no hot
task. Answers that don't spell the block's words raise.

Defined cases: null and empty texts have no ids and decode to the empty text; white
space and unknown characters survive the round trip (U+2581 decodes to a space, as in
the library); repeated rows are encoded alike; other columns may have any name.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, lean, parts_for, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST = 60
BLOCK_BYTES = 14 << 20
CHUNK_BYTES = 1 << 20
PART_BYTES = 2 << 20
DECODED = 256          # rows at a time
PLACE_BITS = 28        # of a word's number in a place; the block's is above
UNIGRAM, BPE = 1, 2


# --- the model file ------------------------------------------------------------------

def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at:at + n]
            at += n


@dataclass
class Model:
    """Pieces of a SentencePiece model; ids are their positions."""
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Model:
        model = cls()
        with open(path, "rb") as f:
            content = f.read()
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.types.append(piece.get(3, 1))
            elif number == 2:
                model.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep texts as they are (identity normalisation)")
                model.dummy_prefix = bool(spec.get(3, 1))
        return model

    def __post_init__(self):
        self._table = None

    @property
    def table(self) -> dict[str, tuple[int, float]]:
        """Ordinary pieces: id and score."""
        if self._table is None:
            self._table = {p: (i, s) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (1, 4)}
        return self._table

    @property
    def byte_ids(self) -> list[int]:
        ids = {self.pieces[i]: i for i, t in enumerate(self.types) if t == 6}
        return [ids.get(f"<0x{b:02X}>", 0) for b in range(256)]

    @property
    def tied(self) -> list[str]:
        """For BPE, the shortest of the merged pieces that share their score with another: between
        those the order of merges isn't that of the scores."""
        if self.kind != BPE:
            return []
        count = Counter(s for _, s in self.table.values())
        some = sorted((p for p, (_, s) in self.table.items() if len(p) > 1 and count[s] > 1), key=len)
        return [p for k, p in enumerate(some) if not any(q in p for q in some[:k])]

    @property
    def unknown(self) -> float:
        return min(s for _, s in self.table.values()) - 10

    @property
    def longest(self) -> int:
        return max(map(len, self.table))

    def cutter(self) -> Cutter:
        """Words of an escaped text: a piece never reaches from one into another."""
        return Cutter([p for p in self.table if len(p) > 1])

    def escape(self, text: str | None) -> str:
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def escaped(self, column: pa.Array) -> pa.Array:
        """``escape`` of a column."""
        column = column.cast(pa.large_string()).fill_null("")
        prefix = pc.if_else(pc.equal(pc.binary_length(column), 0), "", SPACE if self.dummy_prefix else "").cast(pa.large_string())
        return pc.binary_join_element_wise(prefix, pc.replace_substring(column, " ", SPACE), pa.scalar("", pa.large_string()))


class Cutter:
    """Cuts a text between any two characters that stand side by side in no piece: no piece reaches across, and
    neither a merge nor a path does. Long stretches without spaces are cut as well as words."""

    def __init__(self, pieces: list[str]):
        codes = sorted({ord(c) for p in pieces for c in p})
        self.kinds = np.zeros(0x110000, np.uint16)
        self.kinds[codes] = np.arange(1, len(codes) + 1)
        self.together = np.zeros((len(codes) + 1, len(codes) + 1), bool)
        for p in pieces:
            kinds = self.kinds[[ord(c) for c in p]]
            self.together[kinds[:-1], kinds[1:]] = True

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word ends between two characters."""
        kinds = self.kinds[codes].astype(np.int32)
        found = self.together.ravel()[kinds[:-1] * len(self.together) + kinds[1:]]
        return ~found & (codes[:-1] != ord(SPACE))     # a word keeps its space

    def findall(self, text: str) -> list[str]:
        if not text:
            return []
        cuts = (np.flatnonzero(self.apart(np.frombuffer(text.encode("utf-32-le"), np.uint32))) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of a column of escaped texts, one after another, and where each text ends in them; the words are
        slices of the texts' bytes."""
        data, at = text_bytes(column)
        begins = np.flatnonzero((data & 0xC0) != 0x80)      # of the characters
        new = np.ones(len(begins), bool)
        new[1:] = self.apart(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32))
        new[np.searchsorted(begins, at[:-1][at[:-1] < at[-1]])] = True
        starts = begins[new]
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        return found, np.searchsorted(starts, at[1:])


# --- long words, one at a time ---------------------------------------------------------

def encode_word(word: str, model: Model) -> list[int]:
    """What the folds of the lattice give, for a word of any length; its edges are sorted
    in a heap."""
    table, n, longest = model.table, len(word), model.longest
    edges = [(i, j, *table[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in table]
    edge_of = {(i, j): k for i, j, k, _ in edges}
    if model.kind == BPE:
        score_of = {(i, j): s for i, j, _, s in edges}
        after, before = list(range(1, n + 1)), list(range(-1, n))    # borders right and left of a border

        def pair(i):
            j = after[i] if i < n else n
            return (-score_of[i, after[j]], i, after[j]) if j < n and (i, after[j]) in score_of else None
        heap = [p for p in map(pair, range(n)) if p]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, j = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] >= n or after[after[i]] != j:
                continue
            gone[after[i]] = 1
            after[i], before[j] = j, i
            for k in (i, before[i]):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        path, at = [], 0
        while at < n:
            path.append((at, after[at]))
            at = after[at]
    else:
        best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, _, s in edges:
            into[j].append((i, s))
        for j in range(1, n + 1):
            if not any(i == j - 1 for i, _ in into[j]):
                into[j].append((j - 1, model.unknown))
            score, start = max((best[i][0] + s, -i) for i, s in into[j])
            best[j] = (score, -start)
        path, at = [], n
        while at:
            path.append((best[at][1], at))
            at = best[at][1]
        path.reverse()
    ids: list[int] = []
    for i, j in path:
        if (i, j) in edge_of:
            ids.append(edge_of[i, j])
        else:
            ids += [model.byte_ids[b] for b in word[i:j].encode()]
    return ids


# --- the lattice ------------------------------------------------------------------------
# An edge is one number: order of its score << 40 | start << 32 | end << 24 | id.

def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """``(piece, id, score, nth)``: nth is the place of the score among all, best first."""
    nth = {s: k for k, s in enumerate(sorted({s for _, s in model.table.values()}, reverse=True))}
    rows = [(p, i, float(s), nth[s]) for p, (i, s) in model.table.items()]
    return spark.createDataFrame(rows, "piece string, id bigint, score double, nth bigint")


def lattice(words: DataFrame, model: Model, by: list[str]) -> DataFrame:
    """``(*by, edges)``: the edges of every word, ``by`` being ``word`` and what else names it. Where
    ``words`` is partitioned by some of them, grouping needs no shuffle."""
    # a single character is no merge, so for BPE its id is looked up when the borders are known
    least = 2 if model.kind == BPE else 1
    size = F.length("word")
    starts = words.where(size >= least).select(*by, F.explode(F.sequence(F.lit(0), size - least)).alias("i"))
    spans = starts.select(*by, "i", F.explode(F.sequence(F.lit(least), F.least(F.lit(model.longest), size - F.col("i")))).alias("n"))
    spans = spans.select(*by, (F.col("i") * 257 + F.col("n")).cast("bigint").alias("span"),
                         F.substring(F.col("word"), F.col("i") + 1, F.col("n")).alias("piece"))
    found = spans.join(F.broadcast(piece_table(words.sparkSession, model)), "piece")
    code = F.shiftleft("nth", 40).bitwiseOR(F.shiftleft("span", 24)).bitwiseOR(F.col("id")).alias("code")
    return found.groupBy(*by).agg(F.collect_list(code if model.kind == BPE else F.struct(code, "score")).alias("edges"))


def _start(code: Column) -> Column:
    return F.shiftright(code, 32).bitwiseAND(F.lit(255)).cast("int")


def _end(code: Column) -> Column:
    return F.shiftright(code, 24).bitwiseAND(F.lit(255)).cast("int")


def _bit(n) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def merge_fold(word: Column, edges: str) -> Column:
    """Borders of a BPE segmentation as bits of a long."""
    def step(borders, code):
        start, end = _start(code), _end(code)
        ends = _bit(start).bitwiseOR(_bit(end))
        inside = borders.bitwiseAND(_bit(end) - _bit(start + 1))
        taken = (end - start > 1) & (borders.bitwiseAND(ends) == ends) & (F.bit_count(inside) == 1)
        return F.when(taken, borders.bitwiseXOR(inside)).otherwise(borders)
    return F.aggregate(F.sort_array(edges), _bit(F.length(word) + 1) - F.lit(1), step)


def viterbi_fold(word: Column, edges: str, unknown: float) -> Column:
    """Borders of the best path: per end position the best score and its path's bits."""
    state = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("last"), F.lit(1).cast("bigint").alias("borders")))

    def step(best, j):
        here = F.transform(F.filter(edges, lambda e: _end(e["code"]) == j),
                           lambda e: F.struct(_start(e["code"]).alias("start"), e["score"].alias("score")))
        single = F.when(F.exists(here, lambda e: e["start"] == j - 1), F.array().cast("array<struct<start:int,score:double>>")).otherwise(
            F.array(F.struct((j - 1).alias("start"), F.lit(unknown).alias("score"))))
        paths = F.transform(F.concat(here, single), lambda o: F.struct(
            (F.element_at(best, o["start"] + 1)["score"] + o["score"]).alias("score"), (-o["start"]).alias("last"),
            F.element_at(best, o["start"] + 1)["borders"].bitwiseOR(_bit(j)).alias("borders")))
        return F.concat(best, F.array(F.array_max(paths)))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), state, step, lambda s: F.element_at(s, -1)["borders"])


def fitting(model: Model):
    """Whether the lattice answers a word, as ``fold_words`` asks in Spark: with a single character or without
    any edge there is nothing to fold."""
    tied, table, longest = model.tied, model.table, model.longest
    least = 2 if model.kind == BPE else 1

    def fits(word: str) -> bool:
        return (least <= len(word) <= LONGEST and max(word) < "\U00010000" and not any(p in word for p in tied)
                and any(word[i:j] in table for i in range(len(word)) for j in range(i + least, min(len(word), i + longest) + 1)))
    return fits


def fold_words(words: DataFrame, model: Model, by: list[str]) -> DataFrame:
    """``(*by, ids)`` of the words that the lattice is for: up to ``LONGEST`` characters of the
    basic plane, no pieces of equal score, and at least one edge. ``encode_word`` is for the
    others."""
    fit = (F.length("word") <= LONGEST) & ~F.col("word").rlike(r"[\x{10000}-\x{10FFFF}]")
    for piece in model.tied:
        fit = fit & ~F.col("word").contains(piece)
    found = lattice(words.where(fit), model, by)
    if model.kind == BPE:
        fold, code_of = merge_fold(F.col("word"), "edges"), lambda e: e
    else:
        fold, code_of = viterbi_fold(F.col("word"), "edges", model.unknown), lambda e: e["code"]
    by_bytes = F.split(F.lit(",".join(map(str, model.byte_ids))), ",").cast("array<int>")
    single = np.full(1 << 16, -1)
    for piece, (i, _) in model.table.items():
        if len(piece) == 1 and ord(piece) < len(single):
            single[ord(piece)] = i
    by_letter = F.split(F.lit(",".join(map(str, single))), ",").cast("array<int>")   # one literal when planned

    def alone(i):
        letter = F.substring(F.col("word"), i + 1, F.lit(1))
        known = F.element_at(by_letter, F.ascii(letter) + 1)
        digits = F.hex(F.encode(letter, "UTF-8"))
        fallback = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda b: F.element_at(
            by_bytes, F.conv(F.substring(digits, b * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.struct(i.alias("start"), F.when(known >= 0, F.array(known)).otherwise(fallback).alias("ids"))

    def segments(borders):
        """The edges whose ends are borders and that hold no other border, and the characters between two borders."""
        def whole(e):
            start, end = _start(code_of(e)), _end(code_of(e))
            return (end - start > 1) & (borders.bitwiseAND(_bit(end + 1) - _bit(start)) == _bit(start).bitwiseOR(_bit(end)))
        long = F.transform(F.filter("edges", whole), lambda e: F.struct(
            _start(code_of(e)).alias("start"), F.array(code_of(e).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")).alias("ids")))
        pair = F.lit(3).cast("bigint")
        short = F.filter(F.sequence(F.lit(0), F.length("word") - 1),
                         lambda i: F.call_function("shiftright", borders, i).bitwiseAND(pair) == pair)
        return F.flatten(F.transform(F.sort_array(F.concat(long, F.transform(short, alone))), lambda x: x["ids"]))
    # bound, or the fold would run again for every character
    ids = F.element_at(F.transform(F.array(fold), segments), 1)
    return found.select(*by, ids.alias("ids"))


# --- documents -----------------------------------------------------------------------------

def _blocks(batches):
    """(block, nth, rows) in runs of up to about ``CHUNK_BYTES``, about ``BLOCK_BYTES`` of them a block; the same
    for the same scan."""
    block, size, nth = TaskContext.get().partitionId() << 15, 0, 0
    for batch in batches:
        step = max(1, batch.num_rows * CHUNK_BYTES // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, step):
            some = batch.slice(i, step)
            yield block, nth, some
            size += batch.nbytes * some.num_rows // batch.num_rows
            nth += 1
            if size >= BLOCK_BYTES:
                block, size, nth = block + 1, 0, 0
                if block >> 15 != TaskContext.get().partitionId():
                    raise RuntimeError("more blocks in one partition than there are numbers for")


def _numbers() -> defaultdict[str, int]:
    """Numbers of words in the order of their first occurrence in a block."""
    return defaultdict(count().__next__)


def _numbered(column: pa.Array, model: Model, cut: Cutter, number: defaultdict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts' words, and where each text ends."""
    words, ends = cut.words(model.escaped(column))
    found = words.dictionary_encode()
    of = np.array(list(map(number.__getitem__, found.dictionary.to_pylist())), np.int32)
    if len(number) >> PLACE_BITS:
        raise RuntimeError("more different words in one block than there are numbers for")
    return of[found.indices.to_numpy()], ends


def _frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstd.compress(sink.getvalue(), 3)


def _thawed(content: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstd.decompress(content)) as stream:
        return stream.read_all()


def packed_answers(places: DataFrame, wide: bool) -> DataFrame:
    """``(block, content)``: the rows ``(place, ids)`` of a task as one compressed row per block; ``wide``: ids over
    16 bits."""
    def run(batches):
        held, size = [], 0

        def put():
            place, flat, n = (np.concatenate(column) for column in zip(*held))
            order = np.argsort(place)
            block, k = place >> PLACE_BITS, (place & (1 << PLACE_BITS) - 1).astype(np.int32)
            first = np.cumsum(n) - n
            cuts = np.append(np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1])), len(order))
            for a, b in zip(cuts[:-1], cuts[1:]):
                use = order[a:b]
                own = n[use]
                ids = flat[np.repeat(first[use] - np.cumsum(own) + own, own) + np.arange(own.sum())]
                # the lattice's words are short, so their ids are fewer than 256
                body = len(use).to_bytes(8, "little") + np.diff(k[use], prepend=np.int32(0)).tobytes() + own.astype(np.uint8).tobytes()
                body += ids.astype(np.uint32 if wide else np.uint16).tobytes()
                yield pa.record_batch([pa.array([block[use[0]]]), pa.array([zstd.compress(body, 1)], pa.binary())], ["block", "content"])
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts, n = _flat(batch.column(1))
            held.append((batch.column(0).to_numpy(), flat[starts[0]:starts[0] + n.sum()], n))
            size += batch.num_rows
            if size >= 1 << 20:
                yield from put()
                held, size = [], 0
        if held:
            yield from put()
    return places.mapInArrow(lean(run), "block bigint, content binary")


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut, fits, least = model.cutter(), fitting(model), 2 if model.kind == BPE else 1
    wide = len(model.pieces) > 1 << 16
    bytes_of = np.array([1 if t == 6 else len(p.encode()) for p, t in zip(model.pieces, model.types)])

    def ask(batches):
        def words_of(block, number):
            words = pa.array(list(number), pa.large_string())
            size = pc.utf8_length(words).to_numpy()
            own = np.flatnonzero((size >= least) & (size <= LONGEST))
            words = words.take(own)
            order = pc.sort_indices(words).to_numpy()      # in order they compress better
            for i in range(0, len(order), 50_000):
                some = order[i:i + 50_000]
                yield pa.record_batch([words.take(some).cast(pa.string()), pa.array(own[some] | block << PLACE_BITS)], ["word", "place"])
        last, number = None, _numbers()
        for block, _, batch in _blocks(batches):
            if block != last:
                yield from words_of(last, number)
                last, number = block, _numbers()
            _numbered(batch.column(1), model, cut, number)
        yield from words_of(last, number)

    def carry(batches):
        # texts travel as the numbers of their words, the words once a block, in the first row of it
        def put(block, nth, rows, told):
            return pa.record_batch([pa.array([block]), pa.array([nth], pa.int32()), pa.array([_frozen(rows)], pa.binary()),
                                    pa.array([zstd.compress(told.tobytes(), 3)], pa.binary())], ["block", "nth", "rows", "told"])

        def words_of(block, number):
            if number:
                yield put(block, -1, pa.record_batch([pa.array(list(number), pa.large_string())], ["word"]), np.zeros(0, np.int32))
        last, number = None, _numbers()
        for block, nth, batch in _blocks(batches):
            if block != last:
                yield from words_of(last, number)
                last, number = block, _numbers()
            told, ends = _numbered(batch.column(1), model, cut, number)
            rows = pa.record_batch([batch.column(0), pa.array(ends, pa.int64())], ["doc_id", "end"])
            yield put(block, nth, rows, np.ascontiguousarray(told.view(np.uint8).reshape(-1, 4).T))     # alike bytes side by side
        yield from words_of(last, number)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("nth")
        words = pa.array([], pa.large_string())
        if left.column("nth")[0].as_py() < 0:
            words = _thawed(left.column("rows")[0].as_py()).column("word").combine_chunks()
            left = left.slice(1)
        sizes, parts = np.zeros(len(words), np.int64), []
        for content in right.column("content"):
            body = zstd.decompress(content.as_py())
            n = int.from_bytes(body[:8], "little")
            k, own = np.cumsum(np.frombuffer(body, np.int32, n, 8)), np.frombuffer(body, np.uint8, n, 8 + 4 * n)
            sizes[k] = own
            parts.append((k, own, np.frombuffer(body, np.uint32 if wide else np.uint16, offset=8 + 5 * n)))
        # words that are not for the lattice
        alone = np.flatnonzero(sizes == 0)
        more: list[int] = []
        for k in alone.tolist():
            word = words[k].as_py()
            if fits(word):
                raise RuntimeError(f"the lattice has lost a word of {len(word)} characters")
            ids = encode_word(word, model)
            sizes[k] = len(ids)
            more += ids
        parts.append((alone, sizes[alone], np.array(more, np.int64)))
        # one flat array of all words' ids; a word is its number in it
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for k, own, ids in parts:
            own = own.astype(np.int64)
            flat[np.repeat(starts[k] - np.cumsum(own) + own, own) + np.arange(len(ids))] = ids
        spelt = np.add.reduceat(bytes_of[flat], starts) if len(starts) else sizes
        if (spelt != pc.binary_length(words).to_numpy()).any():
            raise RuntimeError("answers that don't spell the words they are for")
        out = []
        for rows, told in zip(left.column("rows"), left.column("told")):
            rows = _thawed(rows.as_py()).combine_chunks()
            of = np.ascontiguousarray(np.frombuffer(zstd.decompress(told.as_py()), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
            n = sizes[of]
            offsets = np.zeros(len(of) + 1, np.int64)
            np.cumsum(n, out=offsets[1:])
            at = np.repeat(starts[of] - offsets[:-1], n)
            at += np.arange(offsets[-1])
            ids = flat[at]
            ends = offsets[np.append(0, rows.column("end").to_numpy())].astype(np.int32)
            names = rows.column("doc_id")
            out.append(pa.table([names, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"]))
        return pa.concat_tables(out)
    # Every different word is folded once: words are dealt by themselves, their ids go back to the blocks that hold them
    parts = parts_for(docs, PART_BYTES)
    asked = rows.mapInArrow(lean(ask), "word string, place bigint").repartition(parts, "word")
    # the largest place is asked for so that both readers have the same columns, and so the same shuffle
    words = asked.groupBy("word").agg(F.max("place").alias("place")).where("place >= 0").select("word")
    ids = fold_words(words, model, ["word"])
    answers = packed_answers(asked.join(ids.hint("shuffle_hash"), "word").select("place", "ids"), wide).repartition(parts, "block")
    carried = rows.mapInArrow(lean(carry), "block bigint, nth int, rows binary, told binary").repartition(parts, "block")
    return carried.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, f"doc_id {kind}, ids array<int>")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a list column, and where each list starts and how long it is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def _slices(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values = chunk.values.to_numpy(zero_copy_only=False)
        offsets = chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return out


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of each row's ids."""
    content = [bytes([int(p[1:-1], 16)]) if t == 6 else p.replace(SPACE, " ").encode() if t in (1, 4) else b""
               for p, t in zip(model.pieces, model.types)]

    def run(whole):
        for i in range(0, whole.num_rows, DECODED):
            yield texts_of(whole.slice(i, DECODED))

    def texts_of(batch):
        texts = []
        for ids in _slices(pa.chunked_array([batch.column(batch.schema.get_field_index(ids_col)).fill_null([])])):
            text = b"".join(map(content.__getitem__, ids.tolist()))
            texts.append(text[1:] if model.dummy_prefix and text[:1] == b" " else text)
        return pa.record_batch([*batch.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                               [*batch.schema.names, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(by_batch(run), f"{schema}, decoded string")


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, n_ids, ids, decoded_sha256)`` per row."""
    model = Model.load(path)
    found = decode(encode(docs, model), model)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
