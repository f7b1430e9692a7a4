"""Plain Python versions of the operators, and edge documents that every operator is given."""
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, found int, part int, size string, fp int"


def table(spark, rows):
    """Documents from ``(doc_id, text, lang, source)``, with columns of names the operators use."""
    full = [(i, t, lang, source, None if t is None else len(t), "k", 1, 2, "s", 3) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    base = " ".join(f"word{i % 37}x{i}" for i in range(120))
    return [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "de", None),
        (5, "one", "en", "b"), (6, "two words", "en", "b"), (7, base + " tail end", "en", "c"), (7, base + " tail end", "en", "c"),
        (8, "Ünïcode ☃ 😀 text\nwith lines. And é!", "fr", "c"), (9, "same same same same " * 800, "en", "c"),
        (10, " ".join(f"w{(i * i) % 9973}" for i in range(30_000)), "en", "d"), (None, base + " no id", "en", None),
        (12, base.upper(), "en", "a"), (13, "x" * 5000, "en", "d")]


def words(text):
    return WORD.findall(text or "")


def fm_dedup(rows, length):
    """``(doc_id, n_words, n_removed, kept text)`` per row; a null id is larger than any other."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - length + 1):
            k = tuple(w[a:a + length])
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - length + 1):
            if first[tuple(w[a:a + length])] < order(i):
                gone |= set(range(a, a + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def byte_dedup(rows, length):
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a:a + length] for _, b in texts for a in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for k, x in enumerate(b) if not gone[k])))
    return out


def fingerprint(text, width=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(prints, most):
    """Least id of each fingerprint's component; ``prints`` are ``(id, fingerprint)``."""
    nodes = sorted({f for _, f in prints})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, f in prints:
        ids[find(f)].append(i)
    least = {f: min((i for i in v if i is not None), default=None) for f, v in ids.items()}
    return {(i, f): least[find(f)] for i, f in prints}


def mix(rows, weights=(5, 2, 1), most=3):
    """``{row number: words taken}`` by sorting the documents of each source by hash."""
    size = [len(words(t)) for _, t, _ in rows]
    of = defaultdict(list)
    for k, (_, _, source) in enumerate(rows):
        of[source].append(k)
    names = sorted((s for s in of if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in of)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(size[k] for k in of[s]) for s in names}
    target, free, rest = {}, set(names), sum(size)
    while True:
        unit = rest / max(sum(weight[s] for s in free), 1)
        held = {s for s in free if most * total[s] <= unit * weight[s]}
        if not held:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in held:
            target[s] = float(most * total[s])
            rest -= most * total[s]
        free -= held
    taken = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - whole * total[s]
        by_hash = defaultdict(list)
        for k in of[s]:
            key = "" if rows[k][0] is None else str(rows[k][0])
            by_hash[int(hashlib.md5(key.encode()).hexdigest()[:15], 16)].append(k)
        upto, done = 0, left >= total[s]
        for h in sorted(by_hash):
            n = sum(size[k] for k in by_hash[h])
            extra = 0
            if not done:
                extra = 1 if upto + n <= left or upto + n - left < left - upto else 0
                done = upto + n > left
            for k in by_hash[h]:
                taken[k] = size[k] * (whole + extra)
            upto += n
    return taken, target
