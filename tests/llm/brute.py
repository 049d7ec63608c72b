"""Plain versions of the operators over lists of texts."""

import hashlib
import re
import zlib
from collections import defaultdict

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACE.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def repeats(docs):
    """{doc_id: (n_words, n_removed, kept_sha256)} of [(doc_id, text)]."""
    first = {}
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH.findall(fold(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i:i + 13])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = BENCH.findall(fold(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out
