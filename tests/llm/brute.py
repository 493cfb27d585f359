"""Plain versions of the operators, row by row and pair by pair, for small tables."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = "[^\x20\x09-\x0d]+"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(WORD, ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """The least index reachable from each of n."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(docs):
    """{(doc_id, fingerprint, component)} of (doc_id, text) with ids."""
    docs = sorted(docs, key=lambda d: d[0])
    prints = [fingerprint(t) for _, t in docs]
    roots = classes(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    return Counter((docs[i][0], f"{prints[i]:016x}", docs[roots[i]][0]) for i in range(len(docs)))


def repeats(docs):
    """Counter of (doc_id, n_bytes, n_removed, n_spans, digest) of (doc_id, text)."""
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = Counter()
    for (doc_id, _), t in zip(docs, texts, strict=True):
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                covered[i : i + 400] = True
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out[doc_id, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


compiled = functools.cache(lambda pattern: re.compile(pattern, re.ASCII))  # there are more rules than the module remembers


def detections(text, rules):
    """(start, end, label) of the rules' matches that stay: every rule on every text, every match held against every other."""
    found = [(m.start(), m.end(), i) for i, r in enumerate(rules) for m in compiled(r.pattern).finditer(text or "")]

    def goes(s):
        return any(t[0] <= s[0] and s[1] <= t[1] and (t[:2] != s[:2] or t[2] < s[2]) for t in found)

    return sorted((a, b, rules[i].label) for a, b, i in found if rules[i].label and not goes((a, b, i)))


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def personal(text):
    spans = [[(k, m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in KINDS]
    joined = ",".join(f"{k}:{a}:{b}" for s in spans for k, a, b in s)
    return *map(len, spans), hashlib.sha256(joined.encode()).hexdigest(), joined


def token_digests(docs, encode):
    """[(doc_id, start, n_tokens, crc32)] of (doc_id, text) in order."""
    at, out = 0, []
    for doc_id, text in docs:
        ids = [*encode(text or ""), 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water-filling round by round: {source: target} of {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def features(text):
    """The set of hashed words, pairs and pairs that skip a word, and the bias 0, by whole numbers."""
    mask = (1 << 64) - 1
    word, pair, skip = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    words = (text or "").lower().encode().translate(None, b".,;:!?\"'()[]").split()
    h = [zlib.crc32(w) + 1 for w in words]
    mixed = [x * word & mask for x in h]
    mixed += [(a * word + b) * pair & mask for a, b in zip(h, h[1:], strict=False)] + [(a * word + b) * skip & mask for a, b in zip(h, h[2:], strict=False)]
    return {max(1, ((m ^ (m >> 29)) * word & mask) >> 44) for m in mixed} | {0}


def ftrl(rows, alpha, beta, l1, l2):
    """{feature: weight} of rows (features, label) learnt one by one, each coordinate in its own dictionary entry."""
    z, n = {}, {}

    def weight(f):
        x = z.get(f, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for at, label in rows:
        w = {f: weight(f) for f in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for f in at:
            before = n.get(f, 0.0)
            n[f] = before + g * g
            z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / alpha * w[f]
    return {f: weight(f) for f in z if weight(f)}


def local_alignment(item, words, match, mismatch, gap):
    """The best Smith-Waterman score of two lists of words, over the item's length."""
    row, best = [0.0] * (len(words) + 1), 0.0
    for a in item:
        new = [0.0]
        for j, b in enumerate(words):
            new.append(max(0.0, row[j] + (match if a == b else mismatch), row[j + 1] + gap, new[j] + gap))
        row, best = new, max(best, *new)
    return best / (match * len(item)) if item else 0.0


def plain_words(text):
    return (text or "").lower().translate(str.maketrans("", "", ".,;:!?\"'()[]")).split()


def leaked(docs, items, width, rare, threshold, points):
    """{(doc_id, item_id): score} of (doc_id, text) and (item_id, text): whole texts aligned wherever an item's rare gram stands in a document."""
    def grams(words):
        return [tuple(words[i : i + min(width, len(words))]) for i in range(max(1, len(words) - width + 1))] if words else []

    texts = [(i, plain_words(t)) for i, t in docs]
    held = [{g[i : i + n] for g in [tuple(w)] for n in range(1, width + 1) for i in range(len(g) - n + 1)} for _, w in texts]
    out = {}
    for item_id, t in items:
        item = plain_words(t)
        counts = {g: sum(g in h for h in held) for g in grams(item)}
        if not counts:
            continue
        each = sorted(counts[g] for g in grams(item))
        median = (each[(len(each) - 1) // 2] + each[len(each) // 2]) / 2
        seeds = {g for g, n in counts.items() if n <= rare * max(1.0, median)}
        for (doc_id, words), h in zip(texts, held, strict=True):
            spaced = {(words[i], words[i + j], words[i + 3]) for i in range(len(words) - 3) for j in (1, 2)} if width == 3 else set()
            if seeds & (h | spaced) and (score := local_alignment(item, words, *points)) >= threshold:
                out[doc_id, item_id] = score
    return out


def mixture(docs, seed="mix-1", weights=(3, 1, 2), share=1.5, repeats=2):
    """Counter of doc_ids taken of (doc_id, text, source): every offer of every document in one list, by finish time."""
    sizes = [(i, len(re.findall(WORD, t or "")), s) for i, t, s in docs]
    of_source = Counter()
    for _, n, s in sizes:
        of_source[s] += n
    target = targets(of_source, weights, share, float(repeats))
    key = lambda i, n: hashlib.md5(f"{seed}:{'' if i is None else i}:{n}".encode()).hexdigest()
    offers = []
    for s, total in of_source.items():
        upto = 0
        for k, n, i in sorted((key(i, n), n, i) for i, n, x in sizes if x == s and n):
            upto += n
            offers += [((upto + r * total) / target[s], s is None, s or "", k, n, r, i) for r in range(repeats)]
    out, spent = Counter(), 0
    for offer in sorted(offers, key=lambda o: o[:6]):
        spent += offer[4]
        if spent > sum(target.values()):
            break
        out[offer[6]] += 1
    return out


def words(text):
    return re.findall(WORD, text or "")


def repeated_passages(rows, window=35):
    """(doc_id, n_words, n_removed, digest of the kept words) of each (doc_id, text)."""
    split = [words(t) for _, t in rows]
    places = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = {k for i in range(len(w) - window + 1) if places[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def runs(s, power=4, least=6):
    """(start, length, period) of the maximal periodic stretches, one period after the other."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(s))}
    a, n, out = np.array([ids[x] for x in s], int), len(s), []
    for q in range(1, n // power + 1):
        same = np.flatnonzero(np.diff(np.r_[0, a[:-q] == a[q:], 0]))
        for i, j in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            length = j + q - i
            if length >= max(least, power * q) and not any(q % d == 0 and all(s[x] == s[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """The row of the twelfth query."""
    w = words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *more, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def merkle(rows):
    """The rows of the thirteenth query, from (doc_id, source, lang, n_chars, text)."""
    told = lambda *r: _joined(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])
    leaves = sorted(((r, told(*r)) for r in rows), key=lambda x: ((x[0][2] is not None, (x[0][2] or "").encode()), (x[0][0] is not None, x[0][0] or 0), x[1]))
    langs = list(dict.fromkeys(r[2] for r, _ in leaves))
    trees = {lang: _levels([h for r, h in leaves if r[2] == lang]) for lang in langs}
    top = _levels([trees[lang][-1][0] for lang in langs])
    out, at = [], Counter()
    for (doc_id, source, lang, n_chars, text), h in leaves:
        node, proof = h, []
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            node = told(doc_id, source, lang, n_chars + 1, text)
        for tree, place in ((trees[lang], at[lang]), (top, langs.index(lang))):
            for level in tree[:-1]:
                other = place ^ 1
                if other >= len(level):
                    node = _joined(node)
                else:
                    proof.append(level[other])
                    node = _joined(level[other], node) if other < place else _joined(node, level[other])
                place >>= 1
        at[lang] += 1
        out.append((doc_id, h, trees[lang][-1][0], top[-1][0], _joined(*proof), node, node == top[-1][0]))
    return out
