"""Awkward documents, and brute-force versions of the operators over lists of (doc_id, text)."""

import hashlib
import random
import re
import zlib

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, kept boolean, at string, rest string, g string, hash string, score double"


def words(text, lower=True):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.translate(LOWER) if lower else data)


def documents():
    """Null and empty texts, copies, near copies, shared passages, ties, odd white space, and a very long text."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = [None, "", " \t\n", "One", "one", "ONE two", "É é", "é é", "a b c\x85d e\x1cf"]
    base = [r.choice(vocabulary) for _ in range(200)]
    for k in range(14):  # near copies by a few words each
        copy = list(base)
        for _ in range(k // 3):
            copy[r.randrange(len(copy))] = f"new{r.random()}"
        out.append(" ".join(copy))
    out += [" ".join(base).upper(), "\n".join(base)]
    for _ in range(16):
        own = [r.choice(vocabulary) for _ in range(r.randint(5, 90))]
        at = r.randrange(len(own))
        out.append(" ".join(own[:at] + (passage[r.randint(0, 20) :] if r.random() < 0.6 else []) + own[at:]))
    out.append(" ".join(r.choice(vocabulary) for _ in range(60_000)))
    out.append("x" * 300_000)
    out.append("same again " * 300)
    out.append("same again " * 300)
    order = list(range(len(out)))
    r.shuffle(order)
    return list(zip(order, out, strict=True))


def frame(spark, rows):
    """With columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 6, True, "at", "rest", "g", "hash", 0.5) for i, t in rows], SCHEMA)


def shingle_set(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, window=13):
    first, out = {}, {}
    for i, t in rows:
        w = words(t, lower=False)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(i, first.get(k, i))
    for i, t in rows:
        w = words(t, lower=False)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def held_out(i, divisor):
    return zlib.crc32(str(i).encode()) % divisor == 1
