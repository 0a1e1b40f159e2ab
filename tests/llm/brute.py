"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def embeddings(rows, threshold=0.93):
    """rows: (vec_id, embedding, label)"""
    good = [(i, np.array(e, float) / np.linalg.norm(np.array(e, float)), lab) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = set()
    for lab in {x[2] for x in good}:
        ids, m = [x[0] for x in good if x[2] == lab], np.array([x[1] for x in good if x[2] == lab])
        near = m @ m.T >= threshold
        links |= {(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b}
    count = Counter(a for a, _ in links)
    comp = components([r[0] for r in rows], links)
    return {(i, count[i], comp[i], comp[i] == i) for i, _, _ in rows}


def fingerprint(text, width=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, width=3, radius=2):
    prints = {i: fingerprint(t, width) for i, t in rows}
    at = defaultdict(list)
    for i, f in prints.items():
        at[f].append(i)
    distinct = sorted(at)
    arr = np.array(distinct, dtype=np.uint64)
    links = [(ids[0], i) for ids in at.values() for i in ids[1:]]
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1 :] ^ np.uint64(f)) <= radius):
            links.append((at[f][0], at[distinct[k + 1 + j]][0]))
    comp = components([i for i, _ in rows], links)
    return {(i, f"{prints[i]:016x}", comp[i]) for i, _ in rows}


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def statistics(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    held = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(held) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held), failed


PATTERNS = [
    ("assign", re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
    ("github", re.compile(r"gh[opsru]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), lambda m: len(m[0]) >= 15),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: True),
    ("maps_key", re.compile(r"AIza[A-Za-z0-9_-]+"), lambda m: len(m[0]) >= 39),
]


def secrets(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    name = lambda s: f"{PATTERNS[s[1]][0]}:{s[0]}:{s[2]}"
    base = ",".join(name(s) for s in spans if s[1] < 3)
    return *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(map(name, spans))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: {source: size}; targets by resharing the excess until none is above its limit"""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    held, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(most * sizes[s] for s in held)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else level * weight[s] for s in order}
        held |= over


def deleted_lines(rows, min_words=50):
    """rows: (doc_id, text) with different ids -> {(doc_id, place)}: lines in any run of min_words words that stands earlier too"""
    seqs = {i: [(k, x.strip(" "), len(words(x))) for k, x in enumerate((t or "").split("\n")) if words(x)] for i, t in rows}
    first, gone = {}, set()
    spans = []
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s)):
            total = 0
            for b in range(a, len(s)):
                total += s[b][2]
                if total >= min_words:
                    key = tuple(x[1] for x in s[a : b + 1])
                    if first.setdefault(key, (i, a)) != (i, a):
                        spans.append((i, a, b, first[key]))
    for i, a, b, (j, c) in spans:
        begin = max(a, c + b - a + 1) if i == j else a
        gone |= {(i, seqs[i][k][0]) for k in range(begin, b + 1)}
    return gone


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes, fan):
    """The last node above some digests, and for each of them its steps up: the digests before and after it in its run."""
    steps, owners, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        up, above = [], []
        for a in range(0, len(now), fan):
            run = now[a : a + fan]
            for k, own in enumerate(owners[a : a + fan]):
                for i in own:
                    steps[i].append((run[:k], run[k + 1 :]))
            up.append(_sha(*run))
            above.append(sum(owners[a : a + fan], []))
        now, owners = up, above
    return now[0], steps


def merkle(rows, fan=16):
    """rows: (doc_id, source, lang, n_chars, text); null ids come first"""
    import zlib

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[1]].append((r, _sha(*map(field, r))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: _climb([d for _, d in groups[s]], fan) for s in sources}
    root, tops = _climb([trees[s][0] for s in sources], fan) if rows else (None, [])
    for s, above in zip(sources, tops):
        for (r, leaf), path in zip(groups[s], trees[s][1]):
            path, x = path + above, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = _sha(*map(field, (*r[:4], low(r[4]))))
            for before, after in path:
                x = _sha(*before, x, *after)
            out.append((r[0], leaf, trees[s][0], root, _sha(*(y for b, a in path for y in b + a)), x, x == root))
    return out


def resampled(rows, target, percent=25, buckets=10_000):
    """rows: (doc_id, text); target: texts. Rows of the query, sorted by score, id and the rest."""
    import math
    import zlib

    low = {c: c + 32 for c in range(65, 91)}
    apart = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = [x for x in apart.split((text or "").translate(low)) if x]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own, aim = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aim for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), (n, f) in zip(rows, own):
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    draws = percent * sum(r[4] for r in out) // 100
    return [(*r[:4], k + 1 if k < draws else None) for k, r in enumerate(out)]
