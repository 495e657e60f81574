"""Hand-made rows for the edge cases, and brute-force versions of the operators."""

import re

EXTRA = "tag string, key int, node string, n int, score string, kept string, n_lines string, size string, start string, item string, w string, g string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); further columns clash with internal names."""
    full = [(*r, *[None] * (4 - len(r)), -1, *["x", 7, "y", 8, *["z"] * 8]) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


LONG = " ".join(f"w{k % 977} v{k % 613}" for k in range(40_000))
SHARED = "the quick brown fox jumps over the lazy dog and runs far away from all of the hunters"
EDGES = [
    (None, "a text without an id, " + SHARED), (None, None), (1, None), (2, ""), (3, " \t\n  \n"), (4, LONG), (5, LONG + " end"), (6, "Same words here again and AGAIN"),
    (7, "same WORDS here again and again"), (7, "same WORDS here again and again"), (8, "Ünïcödé Wörter, ÀÉ and 日本語 😀 mixed"), (9, "123 456 --- !!!"), (10, "one"),
    (11, "one"), (12, f"before {SHARED} after"), (13, SHARED.upper()), (14, "x" * 300_000), (2**53 + 1, "large id"), (2**53 + 2, "large id"), (-5, "negative id"),
]


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def hits(text, items):
    """(hit positions, ids of items with an occurring window); items: (item_id, text)."""
    words, pos, ids = doc_words(text), set(), set()
    for i, t in items:
        w = doc_words(t)
        n = min(13, len(w))
        if i is None or not n:
            continue
        windows = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in windows:
                pos |= set(range(k, k + n))
                ids.add(str(i))
    return pos, ids


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, n, up=80, down=100):
    """component by row index, over all pairs of rows."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            t = top(k)
            least[t] = min(i, least.get(t, i))
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def dedup(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, text) for each row."""
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(strip))
            if i is not None and len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(lower(x.strip(strip)), ())) < min_docs or i == max(holders[lower(x.strip(strip))])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
