"""Substring deduplication by compressed FM-indexes.

A window is ``length`` consecutive words. It is removed from a document where the same
words also stand in a document with a smaller id. ``repeats`` sends the text around
windows that may be repeated to shards by anchor; each shard has an FM-index over its segments:
a Burrows-Wheeler transform in a wavelet matrix of packed bits. All windows of the
shard's documents are searched backward, side by side, one word a step; a match of
``length`` words ends in an interval of suffixes, and segments are in the order of their least document,
so the interval's first suffix names the least document that has the window.

Windows are judged on the input: removing words never makes or unmakes a window.

Defined cases: null text has no words; a null doc_id counts as larger than any other;
rows with the same doc_id never remove words of each other; words are runs of other
bytes than space and 0x09-0x0D, unchanged; an empty table gives an empty result; other columns
are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, joined_words, pieces, span_hashes, words
from corpusql.llm.repeats import NO_ID, Kind, known_documents, with_flags

LENGTH = 13
ANCHOR = 5


# --- the index ------------------------------------------------------------------------

class WaveletMatrix:
    """Rank of symbols in a sequence; a level is packed bits with a count every 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        x = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int32)).astype(np.int32))
            self.zeros.append(len(x) - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        self.begin = np.zeros(sigma, np.int64)       # where each symbol's run starts at the bottom
        heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        self.begin[x[heads]] = heads

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``, element by element."""
        for i, level in enumerate(range(self.depth - 1, -1, -1)):
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            inside = self.words[i][block] & ((np.uint64(1) << rest) - np.uint64(1))
            ones = self.counts[i][block] + np.bitwise_count(inside)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at - self.begin[symbol]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols, equal ones by position."""
    n, rank, have = len(text), text.astype(np.uint64), 1
    bits = np.uint64(max(1, int(n).bit_length()))
    order = np.arange(n)
    while True:
        step = min(have, depth - have)
        ahead = np.zeros(n, np.uint64)
        ahead[:n - step] = rank[step:] + np.uint64(1) if step else 0
        key = rank * np.uint64(n + int(text.max(initial=0)) + 2) + ahead if step else rank
        if int(key.max(initial=0)).bit_length() + int(bits) <= 64:
            packed = np.sort(key << bits | np.arange(n, dtype=np.uint64))
            order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        else:
            order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        have += step
        if have >= depth:
            return order


class FMIndex:
    """Over a text of symbols 1.. with 0 between its parts, for patterns up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int):
        sigma = int(text.max(initial=0)) + 1
        self.text, self.suffix = text, sorted_suffixes(text, depth)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.bwt = WaveletMatrix(text[self.suffix - 1], sigma)

    def intervals(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of ``text[at:at + length]`` for every ``at``, by backward search."""
        last = self.text[at + length - 1]
        lo, hi = self.before[last], self.before[last + 1]
        for t in range(length - 2, -1, -1):
            symbol = self.text[at + t]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = self.before[symbol] + both[:len(at)], self.before[symbol] + both[len(at):]
        return lo, hi


def least_documents(length: int):
    """``solve`` of ``repeats``: per window of a segment, the least document that has it."""
    def solve(texts, starts, n, least):
        order = np.argsort(least, kind="stable")
        data = np.frombuffer(b"\n".join(texts[i] for i in order), np.uint8)
        sizes = np.array([len(texts[i]) for i in order])
        begin = np.cumsum(sizes + 1) - sizes - 1
        a, b, first = words(data, np.append(begin, len(data)))
        _, symbol = np.unique(span_hashes(data, a, b), return_inverse=True)
        part = np.repeat(np.arange(len(order)), np.diff(first))
        text = np.zeros(len(symbol) + len(order), np.int64)      # a 0 behind every segment
        where = np.arange(len(symbol)) + part
        text[where] = symbol + 1
        index = FMIndex(text, length)
        head = first[:-1] + np.arange(len(order))
        many = starts[order]
        at = np.repeat(head, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lo, _ = index.intervals(at, length)
        owner = np.repeat(least[order], np.diff(first) + 1)
        found = owner[index.suffix[lo]]
        out = [np.zeros(0, np.int64)] * len(order)
        edges = np.append(0, np.cumsum(many))
        own = np.repeat(least[order], many)
        decides = np.maximum.reduceat(found != own, edges[:-1]) | (n[order] > 1)
        for i in np.flatnonzero(decides):
            out[order[i]] = found[edges[i]:edges[i + 1]]
        return out
    return solve


# --- the operator ------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_words, n_removed, rest)`` per row: the kept words joined by one
    space, and the other columns in ``rest``."""
    known = known_documents(docs, id_col, text_col)
    decides = F.exists("flags", lambda x: x < F.col("did"))
    flagged = with_flags(known, Kind("word", length, min(ANCHOR, length)), least_documents(length), True, decides)

    def run(batch):
        did, found = batch.column(0).to_numpy(), batch.column(3)
        for i, j, data, at in pieces(batch.column(1)):
            starts, ends, first = words(data, at)
            gone = np.zeros(len(starts) + 1, np.int32)
            for r in range(i, j):
                if found[r].is_valid:
                    for hit in found[r].as_py():
                        lo = hit["lo"] + first[r - i] + np.flatnonzero(np.array(hit["flags"]) < did[r])
                        np.add.at(gone, lo, 1)
                        np.add.at(gone, lo + length, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept_before = np.append(0, np.cumsum(keep))[first]
            text, begin = joined_words(data, starts[keep], ends[keep])
            edges = begin[kept_before]
            texts = [text[a:max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(texts, pa.binary()).cast(pa.string()),
                                   pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(kept_before)),
                                   batch.column(2).slice(i, j - i)], ["did", "text", "n_words", "n_removed", "rest"])
    rest = flagged.schema["rest"].dataType.simpleString()
    out = flagged.select("did", "text", "rest", "found").mapInArrow(
        by_batch(run), f"did bigint, text string, n_words bigint, n_removed bigint, rest {rest}")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "text", "n_words", "n_removed", "rest")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns; texts without their repeated windows."""
    found = remove_repeats(docs)
    return found.select(*[found["rest"][c].alias(c) if c not in ("doc_id", "text") else found[c]
                          for c in docs.columns])


def op6_fm_index_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h FROM starts),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (h) WHERE least < doc_id),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) AS w
  ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
