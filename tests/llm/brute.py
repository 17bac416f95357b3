"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from vectorloom.llm import secret_scan

from .helpers import WS

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def quality(pairs):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    out = []
    for i, t in pairs:
        t = t or ""
        w = WS.findall(t)
        lines = [x for x in t.split("\n") if WS.search(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        rep = {p for k, g in enumerate(grams) if n[g] > 1 for p in (k, k + 1, k + 2)}
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return sorted(out, key=repr)


def hits(pairs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in pairs:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def components(pairs, k, percent):
    """{doc_id: (set size, component)} of distinct doc_ids"""
    sets = {}
    for i, t in pairs:
        w = WS.findall(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    both = Counter()
    for ids in by.values():
        ids.sort()
        both.update((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def tail(z):
    return 1 / (1 + math.exp(min(700, 0.07056 * z**3 + 1.5976 * z)))


def tested(v):
    """p of the battery and p of structured text, for the token without its padding; None where no alphabet holds it."""
    own = [(d, lam) for p, d, lam in secret_scan.ALPHABETS if re.search(p, v)]
    if not own or len(v) < 20:
        return None
    (d, lam), n = own[0], len(v)
    k = len(d)
    y = [d.index(c) for c in v]
    chi = sum((v.count(c) - n / k) ** 2 / (n / k) for c in d)
    mean = sum(y) / n
    half = [x >= k / 2 for x in y]
    hi, runs = sum(half), 1 + sum(a != b for a, b in zip(half, half[1:], strict=False))
    runs_mean = 1 + 2 * hi * (n - hi) / n
    runs_var = 2 * hi * (n - hi) * (2 * hi * (n - hi) - n) / (n * n * (n - 1))
    cov = sum((a - mean) * (b - mean) for a, b in zip(y, y[1:], strict=False))
    ss = sum((a - mean) ** 2 for a in y)
    p = 0.0
    if runs_var > 0 and ss > 0:
        chi_z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        p = min(1, 3 * min(tail(chi_z), 2 * tail(abs((runs - runs_mean) / math.sqrt(runs_var))), 2 * tail(abs((cov / ss + 1 / n) * math.sqrt(n)))))
    return p, tail((k - 1 + n * lam - chi) / math.sqrt(2 * (k - 1) + 4 * n * lam))


def all_spans(t):
    """Base spans and those that the randomness battery finds, as the query lists them."""
    base, found = base_spans(t), []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t or ""):
        if re.search("[+/]", m[0]) and re.search("[_-]", m[0]):
            found += dict.fromkeys((m.start() + x.start(), m.start() + x.end()) for p in (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}") for x in re.finditer(p, m[0]))
        else:
            found.append(m.span())
    found = [(s, e) for s, e in found if not any(b < e and s < z for b, _, z in base)]
    rows = [(s, e, len(t[s:e].rstrip("=")), *p) for s, e in found if (p := tested(t[s:e].rstrip("=")))]
    total = sum(r[2] for r in rows)
    rank = sorted((even * total / len(rows) / n, s, e, p) for s, e, n, p, even in rows)
    passed = max([i for i, x in enumerate(rank, 1) if x[0] <= i * 0.01 / len(rank)], default=0)
    spans = sorted([*base, *[(s, 3, e) for _, s, e, p in rank[:passed] if p >= 0.001]])
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
