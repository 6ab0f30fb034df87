"""Plain single-process versions of what the corpus queries return."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def quality(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), failed


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(FOLD))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), sha(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text, size=3):
    from xxhash import xxh64_intdigest

    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs):
    fps = {k: fingerprint(t) for k, t in docs}
    distinct = sorted(set(fps.values()))
    up = {f: f for f in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for k, f in fps.items():
        r = root(f)
        least[r] = min(least.get(r, k), k)
    return [(k, f"{f:016x}", least[root(f)]) for k, f in fps.items()]


def warc(pages):
    first = {}
    for key, html in pages:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, key), key)
    out = []
    for key, html in pages:
        b = (html or "").encode()
        lead = first.get(b, key)
        out.append((key, len(b), sha(b), "response" if lead == key else "revisit", None if lead == key else lead))
    return out


def id_files(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for key, text in sorted(docs, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def base_scores(docs):
    held = lambda k: crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(FOLD)), "\n"]
    c = Counter(w for k, t in docs if not held(k) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    out = []
    for key, text in docs:
        w = tokens(text)
        out.append((key, held(key), len(w), sum(x in c for x in w), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)))
    return out


def codec(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for key, text in docs:
        ids = enc.encode_ordinary(text or "")
        out.append((key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(enc.decode_bytes(ids))))
    return out


def token_counts(docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return [(k, len((t or "").encode()), n := len(m.encode(t or "")), n > 4096) for k, t in docs]


KINDS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def secrets(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= n]
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    spans = [f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(found)]
    return *counts, sha(",".join(spans)), spans


def line_dedup(docs, least=10):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(FOLD)
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
