"""Toxic spans by a linear-chain conditional random field.

Training takes a sample of at most ``SAMPLE`` labelled documents (those whose ids hash
lowest). Words that occur significantly more often in toxic documents than in others
form a lexicon of at most ``LEXICON`` hashed words and word beginnings; in toxic documents they are the
tokens labelled toxic. The field has two states over a sentence (at most ``CHAIN``
words) and sees whether a word is in the lexicon, how strongly, what its neighbours
are, and whether it is in capitals. It is trained by gradient ascent on the
likelihood, from forward-backward marginals.

Scoring runs forward-backward over whole documents. The marginals of a document make
its score, by a logistic model of their sum and their maximum trained on the sample;
runs of words with a marginal of a half or more are the offending spans. Sentences
without any lexicon word or capitals differ in length only, so their marginals come
from a table by length.

Defined cases: null text is empty and gets the score of a text without toxic words;
labels may repeat (the highest counts) and null labels are ignored; without labelled
rows, or labels of one kind only, every score is 0; a null doc_id is never held out;
repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, mixed, pieces, span_hashes, stored, words

SAMPLE = 20_000
LEXICON = 2048
CHAIN = 128
LEAST_SEEN = 5          # toxic documents that a lexicon word occurs in
LEAST_GAIN = 30.0       # its log-likelihood ratio
STEMS = (4, 5, 7)        # bytes of a word's beginning that count as words too
BINS = (1.0, 2.0, 4.0)  # edges of a word's log odds
FEATURES = 2 + len(BINS) + 1 + 1   # bias, log-odds bins, neighbour, capitals


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- tokens ------------------------------------------------------------------------

class Tokens:
    """Words of a piece without punctuation around them, lower-cased, and its chains."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = words(data, offsets)
        n = len(starts)
        self.first, self.data = first, data
        letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0x80) | ((data >= 0x30) & (data <= 0x39))
        stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
        newline = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x0A, out=newline[1:])
        closes = np.zeros(n, bool)
        if n:
            closes = stop[ends - 1]
            closes[:-1] |= newline[starts[1:]] > newline[ends[:-1]]
        for _ in range(3):
            ends = ends - ((ends - starts > 1) & ~letter[np.maximum(ends - 1, 0)])
            starts = starts + ((ends - starts > 1) & ~letter[np.minimum(starts, len(data) - 1)])
        self.starts, self.ends = starts, ends
        lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        # a word counts as itself and by its beginnings, which inflected words share
        self.hashes = [span_hashes(lower, starts, ends)]
        self.hashes += [mixed(span_hashes(lower, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in STEMS]
        upper = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
        self.capitals = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 2)
        begins = np.zeros(n + 1, bool)
        begins[0] = True
        begins[1:] = closes
        begins[first] = True
        at = np.flatnonzero(begins[:n])
        lengths = np.diff(np.append(at, n))
        extra = (lengths - 1) // CHAIN                      # long sentences in parts
        at = np.repeat(at, extra + 1) + CHAIN * (np.arange(extra.sum() + len(at))
                                                 - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
        self.chains, self.lengths = at, np.diff(np.append(at, n))
        self.n = n

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def features(tokens: Tokens, keys: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lexicon strength per word, 0 if absent; bits of the features besides the bias)."""
    n = tokens.n
    strength = np.zeros(n, np.int8)
    for hashes in tokens.hashes if len(keys) and n else ():
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == hashes)
        strength[hit] = np.maximum(strength[hit], 1 + np.digitize(odds[at[hit]], BINS))
    bits = np.where(strength > 0, 1 << np.maximum(strength - 1, 0), 0)
    near = np.zeros(n, bool)
    begins = np.zeros(n + 1, bool)
    begins[tokens.chains] = True
    near[1:] |= (strength[:-1] > 0) & ~begins[1:n]
    near[:-1] |= (strength[1:] > 0) & ~begins[1:n]
    return strength, bits | near << (len(BINS) + 1) | tokens.capitals.astype(np.int64) << (len(BINS) + 2)


def design(bits: np.ndarray) -> np.ndarray:
    """One column per feature."""
    x = np.ones((*bits.shape, FEATURES))
    for f in range(1, FEATURES):
        x[..., f] = bits >> (f - 1) & 1
    return x


# --- the field ----------------------------------------------------------------------

def forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """Marginals of state 1, expected transitions and log partition of padded chains.
    ``e``: score of state 1 against state 0 per word."""
    n, t_max = e.shape
    score = np.stack([np.zeros_like(e), e], axis=2)
    alpha, beta = np.zeros((t_max, n, 2)), np.zeros((t_max, n, 2))
    alpha[0] = start + score[:, 0]
    for t in range(1, t_max):
        alpha[t] = np.logaddexp(alpha[t - 1][:, :1] + trans[0], alpha[t - 1][:, 1:] + trans[1]) + score[:, t]
    for t in range(t_max - 2, -1, -1):
        ahead = score[:, t + 1] + beta[t + 1]
        back = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
        beta[t] = np.where((t + 1 < length)[:, None], back, 0)
    last = alpha[length - 1, np.arange(n)]
    log_z = np.logaddexp(last[:, 0], last[:, 1])
    marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z).T
    inside = np.arange(t_max) < length[:, None]
    pairs = np.zeros((n, 2, 2))
    for t in range(t_max - 1):
        p = np.exp(alpha[t][:, :, None] + trans + (score[:, t + 1] + beta[t + 1])[:, None, :] - log_z[:, None, None])
        pairs += np.where((t + 1 < length)[:, None, None], p, 0)
    return np.where(inside, marginal, 0), pairs, log_z


class Field:
    """Weights of the features, start and transitions; trained by Adam on chains that
    carry how often they occur."""

    def __init__(self):
        self.w, self.start, self.trans = np.zeros(FEATURES), np.zeros(2), np.zeros((2, 2))

    def train(self, bits: np.ndarray, labels: np.ndarray, length: np.ndarray, weight: np.ndarray, rounds: int = 120):
        x, inside = design(bits), np.arange(bits.shape[1]) < length[:, None]
        y = labels * inside
        seen = np.zeros((len(y), 2, 2))
        for i in (0, 1):
            for j in (0, 1):
                seen[:, i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & inside[:, 1:]).sum(1)
        theta, m, v = np.zeros(FEATURES + 6), np.zeros(FEATURES + 6), np.zeros(FEATURES + 6)
        total = weight.sum()
        for step in range(1, rounds + 1):
            self._set(theta)
            p, pairs, _ = forward_backward(x @ self.w, length, self.start, self.trans)
            g = np.concatenate([
                np.einsum("n,nt,ntf->f", weight, (y - p) * inside, x),
                [(weight * (p[:, 0] - y[:, 0])).sum(), (weight * (y[:, 0] - p[:, 0])).sum()],
                np.einsum("n,nij->ij", weight, seen - pairs).ravel()]) / total - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self._set(theta)

    def _set(self, theta):
        self.w, self.start = theta[:FEATURES], theta[FEATURES:FEATURES + 2]
        self.trans = theta[FEATURES + 2:].reshape(2, 2)

    def marginals(self, tokens: Tokens, bits: np.ndarray) -> np.ndarray:
        """Marginal of the toxic state for every word of a piece."""
        out = np.zeros(tokens.n)
        if not tokens.n:
            return out
        eventful = np.add.reduceat(bits != 0, tokens.chains) > 0
        longest = int(tokens.lengths.max())
        plain, _, _ = forward_backward(np.full((longest, longest), self.w[0]), np.arange(1, longest + 1),
                                       self.start, self.trans)
        within = np.arange(tokens.n) - np.repeat(tokens.chains, tokens.lengths)
        out = plain[np.repeat(tokens.lengths, tokens.lengths) - 1, within]
        chains, lengths = tokens.chains[eventful], tokens.lengths[eventful]
        for lo, hi in ((1, 16), (17, 48), (49, CHAIN)):
            some = np.flatnonzero((lengths >= lo) & (lengths <= hi))
            if len(some):
                grid = chains[some][:, None] + np.arange(lengths[some].max())
                inside = np.arange(grid.shape[1]) < lengths[some][:, None]
                grid = np.minimum(grid, tokens.n - 1)
                p, _, _ = forward_backward(design(bits[grid]) @ self.w, lengths[some], self.start, self.trans)
                out[grid[inside]] = p[inside]
        return out


def summary(tokens: Tokens, p: np.ndarray) -> np.ndarray:
    """Per document: log of the sum of marginals, and their maximum."""
    out = np.zeros((len(tokens.first) - 1, 2))
    some = np.flatnonzero(np.diff(tokens.first))
    if len(some):
        out[some, 0] = np.log1p(np.add.reduceat(p, tokens.first[:-1][some]))
        out[some, 1] = np.maximum.reduceat(p, tokens.first[:-1][some])
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x1.T @ (y - p) - 1e-2 * w)
    return w


# --- training and scoring ------------------------------------------------------------

class Model:
    def __init__(self):
        self.keys, self.odds, self.field, self.calibration = np.zeros(0, np.uint64), np.zeros(0), Field(), None


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``(text, y)`` of at most ``SAMPLE`` labelled documents; the ids, so bounded, are broadcast."""
    known = (labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("text"))
    return stored(texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "y"), "toxicity-sample")


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, log odds) of significantly toxic words."""
    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, j, data, at in pieces(batch.column(0)):
                tokens = Tokens(data, at)
                doc = np.repeat(np.arange(j - i), np.diff(tokens.first))
                for hashes in tokens.hashes:
                    apart = mixed(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    _, once = np.unique(apart, return_index=True)
                    keys, which = np.unique(hashes[once], return_inverse=True)
                    toxic = np.bincount(which, y[i:j][doc[once]], len(keys)).astype(np.int64)
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(toxic),
                                           pa.array(np.bincount(which, minlength=len(keys)) - toxic)], ["key", "a", "b"])
    counts = (sample.mapInArrow(count, "key bigint, a bigint, b bigint")
              .groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_SEEN))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    share = F.lit(n_toxic / (n_toxic + n_clean))
    gain = 2 * (a * F.log(a / ((a + b) * share)) + b * F.log(b / ((a + b) * (1 - share))))
    odds = F.log(a / (n_toxic + 1.0)) - F.log(b / (n_clean + 1.0))
    rows = (counts.select("key", odds.alias("odds"), gain.alias("gain")).where((F.col("odds") > BINS[0]) & (F.col("gain") >= LEAST_GAIN))
            .orderBy(F.desc("gain"), "key").limit(LEXICON).collect())
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in rows])[order]


def _chains(sample: DataFrame, model: Model):
    """Training chains, equal ones counted; bounded by the sample."""
    keys, odds = model.keys, model.odds

    def collect(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, j, data, at in pieces(batch.column(0)):
                tokens = Tokens(data, at)
                strength, bits = features(tokens, keys, odds)
                toxic = (strength > 0) & (y[i:j][np.repeat(np.arange(j - i), np.diff(tokens.first))] == 1)
                code = (bits * 2 + toxic).astype(np.uint8)
                rows = [code[a:a + n].tobytes() for a, n in zip(tokens.chains.tolist(), tokens.lengths.tolist())]
                yield pa.record_batch([pa.array(rows, pa.binary())], ["chain"])
    return sample.mapInArrow(collect, "chain binary").groupBy("chain").count().collect()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    model, sample = Model(), _sample(docs, labels, label)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return model
    model.keys, model.odds = lexicon(sample, n_toxic, n_clean)
    rows = _chains(sample, model)
    codes = [np.frombuffer(r["chain"], np.uint8) for r in rows]
    length = np.array([len(c) for c in codes])
    grid = np.zeros((len(codes), length.max()), np.int64)
    for i, c in enumerate(codes):
        grid[i, :len(c)] = c
    model.field.train(grid >> 1, grid & 1, length, np.array([r["count"] for r in rows], float))
    seen = sample.mapInArrow(_summaries(model), "total double, top double, y int").collect()
    model.calibration = logistic(np.array([(r["total"], r["top"]) for r in seen]), np.array([r["y"] for r in seen]))
    return model


def _summaries(model: Model):
    def run(batch):
        found = [summary(t := Tokens(data, at), model.field.marginals(t, features(t, model.keys, model.odds)[1]))
                 for _, _, data, at in pieces(batch.column(0))]
        x = np.concatenate(found)
        yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1).cast(pa.int32())],
                              ["total", "top", "y"])
    return by_batch(run)


def _spans(tokens: Tokens, p: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Per document, runs of toxic words as code point offsets."""
    out: list[list[dict]] = [[] for _ in range(len(tokens.first) - 1)]
    toxic = np.flatnonzero(p >= 0.5)
    if not len(toxic):
        return out
    doc = tokens.doc_of(toxic)
    chars = np.zeros(len(tokens.data) + 1, np.int64)
    np.cumsum((tokens.data & 0xC0) != 0x80, out=chars[1:])
    opens = np.flatnonzero(np.append(True, (np.diff(toxic) > 1) | (np.diff(doc) > 0)))
    closes = np.append(opens[1:], len(toxic)) - 1
    for a, b in zip(opens, closes):
        first = chars[offsets[doc[a]]]
        out[doc[a]].append({"start": int(chars[tokens.starts[toxic[a]]] - first),
                            "end": int(chars[tokens.ends[toxic[b]]] - first)})
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, spans)`` per row; spans are offsets in code points."""
    def run(batch):
        scores, spans = [], []
        for i, j, data, at in pieces(batch.column(1)):
            tokens = Tokens(data, at)
            p = model.field.marginals(tokens, features(tokens, model.keys, model.odds)[1])
            if model.calibration is None:
                scores.append(np.zeros(j - i))
                spans += [[]] * (j - i)
                continue
            x = summary(tokens, p)
            z = np.clip(x @ model.calibration[:-1] + model.calibration[-1], -30, 30)
            scores.append(1 / (1 + np.exp(-z)))
            spans += _spans(tokens, p, at)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores)), pa.array(spans, kind)],
                              ["doc_id", "score", "spans"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        by_batch(run), f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint>>")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
