"""Plain versions of the operators for small tables, and a table with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, rep long, kept boolean, row string"


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and blank texts, ties, repeated rows, one long text; the
    columns after n_chars bear names that operators use inside."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    base = " ".join(f"common{i}" for i in range(80))
    texts = [None, "", " \n\t ", "one", "one two three", base, base, base + " more", "Mixed " + base, long, long + " end", "a\nb\na\n\na", "!!! ### $$$"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, base, None, None, None), (None, None, None, None, None), (99, "shared line\nother", "en", None, 17)]
    rows += [(100 + i, f"shared line\nown {i}", "en", f"site{i}", 0) for i in range(14)]
    return [(*r, 1, "k", 2, True, "r") for r in rows]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingle_set(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_classes(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links, n_texts), sorted, by comparing all pairs of texts."""
    plain = [(d, t if words(t) else "") for d, t in rows]
    texts = sorted({t for _, t in plain})
    copies = {t: sum(x == t for _, x in plain) for t in texts}
    sets = [shingle_set(t) for t in texts]
    label, links = list(range(len(texts))), [[] for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                links[i].append(j)
                links[j].append(i)
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    ids: dict[int, list] = {}
    for d, t in plain:
        ids.setdefault(label[texts.index(t)], []).append(d)
    out = []
    at = {t: k for k, t in enumerate(texts)}
    for d, t in plain:
        k = at[t]
        known = [x for x in ids[label[k]] if x is not None]
        out.append((d, min(known) if known else None, copies[t] - 1 + sum(copies[texts[j]] for j in links[k]), len(links[k])))
    return sorted(out, key=repr)


def quality_stats(text: str | None) -> tuple:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    count: dict = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    inside = {i + s for i, x in enumerate(windows) if count[x] > 1 for s in range(3)}
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside), failed


def anomaly(row: list[float], usual: list[list[float]], low: list[float], high: list[float], trees: int, sample: int, rng: random.Random) -> float:
    """Isolation score of one row: each tree is drawn only along the row's own path."""
    def expected(n: int) -> float:
        return 2 * (math.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0

    sample = min(sample, len(usual))
    total = 0.0
    for _ in range(trees):
        part, lo, hi, level = rng.sample(usual, sample), list(low), list(high), 0
        while len(part) > 1 and level < 2 * math.ceil(math.log2(sample)):
            f = rng.choice([k for k in range(len(lo)) if hi[k] > lo[k]])
            cut = rng.uniform(lo[f], hi[f])
            if row[f] <= cut:
                part, hi[f] = [r for r in part if r[f] <= cut], cut
            else:
                part, lo[f] = [r for r in part if r[f] > cut], cut
            level += 1
        total += level + expected(len(part))
    return 2 ** (-total / trees / expected(sample))
