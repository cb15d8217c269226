"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby, permutations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def alnum(text):
    return ALNUM.findall((text or "").translate(FOLD))


def solid(text):
    return SOLID.findall(text or "")


def op1(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if item_id is None else str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = alnum(text)
        hit, its = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    its |= found
                    hit[i : i + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), len(its), sha(",".join(sorted(its))), any(hit)))
    return out


def op2(docs, n=100):
    """``docs`` in the order of the operator: by doc_id, NULL first."""
    seen, out = set(), []
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = [True] * n
            else:
                seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def op3(docs):
    kinds = [
        ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    out = []
    for doc_id, text in docs:
        spans, counts = [], []
        for k, (name, p, ok) in enumerate(kinds):
            found = [(m.start(), k, name, m.end()) for m in p.finditer(text or "") if ok(m)]
            spans += found
            counts.append(len(found))
        base = ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(spans))
        out.append((doc_id, *counts, sha(base)))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def op5(docs):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
        ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(digits(s)) <= 15),
    ]
    out = []
    for doc_id, text in docs:
        spans, counts = [], []
        for k, (name, p, ok) in enumerate(kinds):
            found = [(m.start(), k, name, m.end()) for m in p.finditer(text or "") if ok(m[0])]
            spans += found
            counts.append(len(found))
        base = ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(spans))
        out.append((doc_id, *counts, sha(base)))
    return out


def op4(docs, need=75):
    """(row, n_shingles, component) with rows in the given order; ids must be distinct."""
    sets = []
    for _, text in docs:
        w = (text or "").translate(FOLD)
        w = SOLID.findall(w)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(where[g])
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= need * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs)]


def op6(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = []
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def op8(docs):
    out = []
    for doc_id, text in docs:
        w = solid(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] >= 2:
                hit |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if solid(line):
                dup += line in seen
                seen.add(line)
        n = len(w)
        failed = n < 50 or 100 * len(hit) > 50 * n
        out.append((doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed))
    return out


def op9(docs):
    phrases = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]
    out = []
    for doc_id, text in docs:
        w = alnum(text)
        found = [(i, label) for p, label in phrases for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        at = [i for i, _ in found]
        out.append((doc_id, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def op10(docs, n=35):
    words = [solid(t) for _, t in docs]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def _reached(sets, need):
    """Number of the class of every set, two sets being linked from a similarity of ``need`` percent."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(where[g])
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= need * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def op11(docs, labels):
    """``docs``: (doc_id, text, lang); ``labels``: (doc_id, quality, toxic). Every order is walked."""
    marks = defaultdict(lambda: [0, 0])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id] = [marks[doc_id][0] or int(quality == 1), marks[doc_id][1] or int(toxic == 1)]
    ids = defaultdict(list)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    rows = defaultdict(list)
    for doc_id, text, lang in docs:
        t = text or ""
        w = solid(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and min(ids[t]) < doc_id}
        rows[lang or ""].append(({f for f, x in fails.items() if x}, *(marks[doc_id] if doc_id is not None else (0, 0))))
    out = []
    for part, own in rows.items():
        steps, shares = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in own)
                steps.append((part, "".join(order), k, f, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)))
                shares[f] += len(gone)
        out += [(*s, shares[s[3]]) for s in steps]
    return out


def op12(rows, fan=16):
    """``rows``: (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
        return levels

    def climb(levels, at, h):
        siblings = []
        for level in levels[:-1]:
            low = at // fan * fan
            run = level[low : low + fan]
            siblings += [x for i, x in enumerate(run) if low + i != at]
            run[at - low] = h
            h, at = sha("".join(run)), at // fan
        return siblings, h

    def name(row):
        return row[1] is not None, (row[1] or "").encode()

    rows = sorted(rows, key=lambda r: (name(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=name)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low, h = climb(t, i, leaf((*r[:4], r[4].translate(FOLD))) if hit else t[0][i])
            high, h = climb(top, k, h)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], sha("".join(low + high)), h, h == top[-1][0]))
    return out


def op13(docs):
    """Ids must be distinct."""
    sets = []
    for _, text in docs:
        w = solid((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    root = _reached(sets, 80)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low[root[i]] = min(low.get(root[i], doc_id), doc_id)
    return [(d, len(sets[i]), low[root[i]], d == low[root[i]]) for i, (d, _) in enumerate(docs)]
