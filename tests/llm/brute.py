"""Brute-force versions of the operators and small fixtures for them."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _score int, block string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=7, n=60):
    """Texts with copies, near copies, shared passages, odd characters, nulls, empties and a long text."""
    r = random.Random(seed)
    words = ["der", "the", "café", "Straße", "and", "x", "of", "日本", "no.", "A1", *[f"w{k}" for k in range(60)]]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = prose(60)
    texts = [None, "", " \t\n", "one", "two words", "two words", "One", "🙂 emoji\x00 null", "  lead and  double   space "]
    while len(texts) < n:
        kind, k = r.random(), r.randrange(8, 120)
        old = r.choice([t for t in texts if t] or ["a"])
        if kind < 0.15:
            texts.append(old)
        elif kind < 0.35:
            w = old.split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append(prose(k) + " " + passage[: r.randrange(90, len(passage))] + "\n" + prose(5))
        elif kind < 0.6:
            texts.append((prose(8) + "\n") * r.randrange(2, 9))
        else:
            texts.append(prose(k))
    texts.append(prose(6000))
    return [(10 * i + 3, t, "en", "a.example", len(t or ""), 1, "b") for i, t in enumerate(texts)]


def shingle_set(text, n=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


def good_turing(counts, most=5):
    """Ratios by count, from the published formula; where it gives none, that of an absolute discount of one half."""
    n = Counter(counts.values())
    out = {}
    common = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return lambda r: out.get(r, 1.0)


def katz(rows, order=3):
    """base and score of each text, with plain dictionaries and plain recursion."""
    import math
    import zlib

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    docs = {i: [*WORD.findall(lowered(t)), "</s>"] for i, t in rows}
    counts = {k: Counter() for k in range(1, order + 1)}
    contexts = {k: Counter() for k in range(2, order + 1)}
    followers = {k: {} for k in range(2, order + 1)}
    for i, toks in docs.items():
        if not held[i]:
            padded = ["<s>"] * (order - 1) + toks
            for at in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    gram = tuple(padded[at - k + 1 : at + 1])
                    counts[k][gram] += 1
                    if k > 1:
                        contexts[k][gram[:-1]] += 1
                        followers[k].setdefault(gram[:-1], set()).add(gram[-1])
    ratio = {k: good_turing(c) for k, c in counts.items()}
    uni = counts[1]
    n, v = sum(uni.values()), len(uni)
    kept = sum(c * ratio[1](c) for c in uni.values())
    whole = n + (0.5 if n and kept >= n - 1e-9 else 0)
    unknown = 1 - kept / whole if n else 1.0

    def p(h, w):
        k = len(h) + 1
        c = counts[k][(*h, w)]
        if k == 1:
            return c * ratio[1](c) / whole if c else unknown
        return c * ratio[k](c) / (contexts[k][h] + 0.5) if c else alpha(h) * p(h[1:], w)

    known = {}

    def alpha(h):
        if h not in known:
            f = followers[len(h) + 1].get(h, ())
            known[h] = (1 - sum(p(h, w) for w in f)) / (1 - sum(p(h[1:], w) for w in f)) if f else 1.0
        return known[h]

    out = {}
    for i, toks in docs.items():
        padded = ["<s>"] * (order - 1) + toks
        score = sum(math.log10(p(tuple(padded[at - order + 1 : at]), padded[at])) for at in range(order - 1, len(padded)))
        base = sum(math.log10((uni[w,] + 1) / (n + v + 1)) for w in toks)
        out[i] = (held[i], len(toks), sum(uni[w,] > 0 for w in toks), n, base, score)
    some = [h for k in followers for h in list(followers[k])[:12]]
    total = {h: sum(p(h, w) for (w,) in uni) + p(h, "no such word") for h in some}
    return out, total


def word_runs(w, least=12):
    """(start, length, period) of the runs of at least ``least`` words, by looking at every period."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            stretch = w[i : j + p]
            if len(stretch) >= max(least, 2 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_row(doc_id, text):
    """A row of the query on runs."""
    import zlib

    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = word_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(w, runs))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests, len(w))


def line_dedup(rows, least=10):
    """doc_id, lines, dropped lines and the digest of the others, and the text that is left, for (doc_id, text) rows."""
    last = float("inf")
    key = lambda line: lowered(line).strip(" \t\n\x0b\x0c\r")
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < least or first[key(x)] == (last if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def rebuilt(rows):
    """Turns (role, text) by conversation of (conv_id, turn, role, text) rows, each begun with turns of another one."""
    import zlib

    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append(turn)
    own = {c: [(r or "", t or "") for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def prefix_trie(convs):
    """The rows of the query on the prefix trie, by counting every prefix of every conversation."""
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children.get(node, ())) or 1
        saved[node] = own + sum(saved[k] for k in children.get(node, ()))
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), up, len(of), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out
