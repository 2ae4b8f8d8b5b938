"""Plain Python versions of what the operators return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
SPACES = " \t\n\x0b\x0c\r"


def space_words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def contamination(docs, items, width=10):
    """docs: texts; items: (item_id, text)."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        if w:
            n = min(width, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def line_dedup(docs, least=10):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    split = [(t or "").split("\n") for t in docs]
    df = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out = []
    for ls in split:
        kept = [x for x in ls if df.get(key(x), 0) < least]
        out.append((len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def quality(text):
    w = space_words(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    rep = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 8)}
    wordy = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(wordy) - len(set(wordy)), len(rep), failed)


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text, spans = text or "", []
    for k, (kind, pattern, group, least) in enumerate([("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]):
        spans += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    spans.sort()
    count = Counter(s[3] for s in spans)
    return (count["assign"], count["access"], count["hex"], sha(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans))), spans


def warc(pages):
    """pages: (page_id, html)."""
    import base64

    first = {}
    rows = []
    for i, html in pages:
        data = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first[d] = max(first.get(d, i), i)
        rows.append((i, len(data), d))
    return sorted((i, n, d, "response" if i == first[d] else "revisit", None if i == first[d] else first[d]) for i, n, d in rows)


def tokens(rows, tok):
    """rows: (doc_id, text) in order."""
    import numpy as np

    out, start = [], 0
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
