"""The contracts, stated plainly in Python for small inputs."""

import base64
import hashlib
import re
import struct
import zlib
from fractions import Fraction

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def url(value, rules=RULES):
    value = value or ""
    rest = value.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UPPER)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def repeats(docs, length=50):
    """docs: (doc_id, text). Results in the order of docs."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        if i is not None:
            for q in range(len(b) - length + 1):
                w = b[q : q + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1 if i is not None else 0):
            if first[b[q : q + length]] < i:
                gone[q : q + length] = b"\1" * length
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def contamination(text, items, window=10):
    words = BENCH_WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item_id, item in items:
        have = BENCH_WORD.findall((item or "").translate(UPPER))
        n = min(window, len(have))
        grams = {tuple(have[k : k + n]) for k in range(len(have) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(item_id)
    names = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(names), sha(",".join(names)), bool(hit)


def quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    counts = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> size; shares by weight, the excess over `most` sizes shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        made = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and made[s] > most * sizes[s]}
        if not over:
            return made
        full |= over


def mark(doc_id, source, text):
    """The engine's digest of some columns: each seeds the next, nulls are passed over."""
    h = 42
    for value in (doc_id, source, text):
        if value is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", value) if isinstance(value, int) else value.encode(), seed=h)
    return h


def mix(docs, block_words=128):
    """docs in the order of cases.DOCS -> words taken of each: a source's documents laid end to end in the
    order of their digests, cut into blocks, and taken block by block until the quota is filled."""
    by_source = {}
    for k, (doc_id, text, _, source, _) in enumerate(docs):
        h = mark(doc_id, source, text)
        words = len(BLANK_WORD.findall(text or ""))
        by_source.setdefault(source, []).append(((h >> 40) % 1024, h - (h >> 63 << 64), k, words))
    sizes = {s: sum(r[3] for r in rows) for s, rows in by_source.items()}
    want, taken = targets(sizes), [0] * len(docs)
    for source, rows in by_source.items():
        size = sizes[source]
        if not size:
            continue
        length = max(1, min(block_words, int(want[source] // 32)))
        blocks = max(1, int(Fraction(size, length) + Fraction(1, 2)))
        quota = int(Fraction(want[source]) * blocks / size + Fraction(1, 2))
        order = [k for _, _, k, n in sorted(rows) for _ in range(n)]
        for b in range(blocks):
            for k in order[b * size // blocks : (b + 1) * size // blocks]:
                taken[k] += quota // blocks + (b < quota % blocks)
    return want, taken


def fingerprint(text):
    words = [w.encode() for w in BLANK_WORD.findall((text or "").translate(UPPER))]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, distance=3):
    """docs: (doc_id, fingerprint) -> least doc_id that can be reached, in the order of docs."""
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            if (a ^ docs[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [least.get(root(i)) for i in range(len(docs))]


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text = text or ""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def warc(pages):
    """pages: (page_id, html). Results in the order of pages."""
    held = {}
    for i, html in pages:
        held.setdefault(html or "", []).append(i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        holder = max((x for x in held[html or ""] if x is not None), default=None)
        revisit = holder is not None and i != holder
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", holder if revisit else None))
    return out


def jump(key, shards):
    key, shard, onward = key % 2**64, -1, 0
    while onward < shards:
        shard, key = onward, (key * 2862933555777941757 + 1) % 2**64
        onward = int((shard + 1) * (2**31 / ((key >> 33) + 1)))
    return shard


def leaf(doc, more=0):
    doc_id, text, lang, source, n_chars = doc
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    """The root, and a function from a leaf's place to what stands beside its way up: (left, digest or None)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 2])) for k in range(0, len(below), 2)])

    def path(k):
        steps = []
        for level in levels[:-1]:
            other = k ^ 1
            steps.append((other < k, level[other] if other < len(level) else None))
            k //= 2
        return steps

    return levels[-1][0], path


def merkle(docs):
    """docs in the order of cases.DOCS; sorted by their text."""
    by_lang = {}
    for d in docs:
        by_lang.setdefault(d[2], []).append(d)
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        rows = sorted(by_lang[lang], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append((rows, *tree([leaf(d) for d in rows])))
    root, last = tree([t[1] for t in trees]) if trees else (None, None)
    out = []
    for k, (rows, subroot, path) in enumerate(trees):
        for j, d in enumerate(rows):
            steps = path(j) + last(k)
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = leaf(d, tampered)
            for left, beside in steps:
                node = sha((beside or "") + node if left else node + (beside or ""))
            out.append((d[0], leaf(d), subroot, root, sha("".join(s or "" for _, s in steps)), node, node == root))
    return sorted(out, key=repr)
