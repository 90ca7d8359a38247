"""Plain single-process versions of the operators, for small tables only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)

    def least(self, ids):
        low = {}
        for i, d in enumerate(ids):
            r = self.find(i)
            if d is not None:
                low[r] = min(low.get(r, d), d)
        return [low.get(self.find(i)) for i in range(len(ids))]


def jaccard(rows, k, percent):
    """rows: (doc_id, text); returns (doc_id, n_shingles, component_id) rows and the Union."""
    sets = [shingles(t, k) for _, t in rows]
    u, index = Union(len(rows)), defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
            index[x].append(i)
        for j, v in shared.items():
            if 100 * v >= percent * (len(s) + len(sets[j]) - v):
                u.join(i, j)
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, u.least([d for d, _ in rows]))], u


def unit(v):
    x = np.array(v, float)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def cosine(rows, t):
    """rows: (vec_id, vector, label); returns (vec_id, n_links, component_id, kept) rows."""
    ok = [i for i, (_, v, lab) in enumerate(rows)
          if lab is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    u, links = Union(len(rows)), [0] * len(rows)
    for a, i in enumerate(ok):
        x = unit(rows[i][1])
        for j in ok[:a]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                if x @ unit(rows[j][1]) >= t:
                    links[i] += 1
                    links[j] += 1
                    u.join(i, j)
    return [(d, n, c, d == c) for (d, _, _), n, c in zip(rows, links, u.least([r[0] for r in rows]))]


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in _EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in _IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def _slots(text, base):
    """(start, end, possible kinds) of the strings that meet no base span and could be personal data."""
    local = r"[A-Za-z0-9._%+-]"
    spelt = [m.span() for m in re.finditer(local + r"+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]+)+", text)]
    runs = []
    for m in re.finditer(r"\S+", text):
        a, b = m.span()
        if not re.search("[0-9@]", m.group()):
            continue
        while a < b and not re.match(r"[\w+(@]", text[a]):
            a += 1
        while b > a and not re.match(r"[\w)]", text[b - 1]):
            b -= 1
        if text[a:b].startswith("(") and ")" not in text[a:b]:
            a += 1
        if text[a:b].endswith(")") and "(" not in text[a:b]:
            b -= 1
        number = re.fullmatch(r"[0-9().+-]+", text[a:b])
        if number and runs and runs[-1][2] and text[runs[-1][1]: a] == " ":
            runs[-1] = (runs[-1][0], b, True)
        else:
            runs.append((a, b, bool(number)))
    free = lambda a, b, taken: all(b <= x or a >= y for x, y in taken)
    taken = [(a, b) for a, b, _ in base]
    spelt = [x for x in spelt if free(*x, taken)]
    out = [(a, b, True) for a, b in spelt] + [(a, b, False) for a, b, _ in runs if a < b and free(a, b, taken + spelt)]
    found = []
    for a, b, at in out:
        digits = len(re.findall("[0-9]", text[a:b]))
        kinds = [k for k, ok in (("email", at or "@" in text[a:b]), ("ip", digits > 3), ("card", digits > 11), ("phone", digits > 6)) if ok]
        if kinds:
            found.append((a, b, kinds))
    return found


def bootstrapped(texts, min_seeds=3, min_score=0.8):
    """The spans that contexts of base spans discover, as a set of (text number, start, end, kind)."""
    hits = []
    for i, t in enumerate(texts):
        t = t or ""
        base = personal(t)
        for a, b, kind, may in [(a, b, k, []) for a, b, k in base] + [(a, b, None, may) for a, b, may in _slots(t, base)]:
            words = lambda s: re.sub(r"\d", "0", s.lower())
            left = [words(w) for w in re.findall(r"\w+|[^\w\s]", t[:a].split("\n")[-1])][-3:]
            right = [words(w) for w in re.findall(r"\w+|[^\w\s]", t[b:].split("\n")[0])][:3]
            around = {("l", *left[-n:]) for n in (1, 2, 3) if n <= len(left)} | {("r", *right[:n]) for n in (1, 2, 3) if n <= len(right)}
            around |= {("b", *left[-n:], *right[:n]) for n in (1, 2) if n <= min(len(left), len(right))}
            hits.append((i, a, b, kind, may, around, re.sub(r"[\s()\[\]+-]", "", t[a:b].lower())))
    members, seeds = defaultdict(set), set()
    for *_, kind, may, around, name in hits:
        for p in around:
            members[p].add(name)
        if kind and around:
            seeds.add((name, kind))
    known, settled = {x: 1_000_000 for x in seeds}, {n for n, _ in seeds}
    while True:
        good = {}
        for p, names in members.items():
            for k in ("email", "ip", "card", "phone"):
                s = sum(known.get((n, k), 0) for n in names)
                if s >= min_seeds * 1_000_000 and s // len(names) >= min_score * 1_000_000:
                    good[p, k] = s // len(names)
        new = defaultdict(int)
        for *_, kind, may, around, name in hits:
            for k in may:
                if name not in settled and (name, k) not in known:
                    for p in around:
                        if (p, k) in good:
                            new[name, k] = max(new[name, k], good[p, k])
        if not new:
            break
        known.update(new)
    out = set()
    for i, a, b, kind, may, around, _ in hits:
        best = [(-good[p, k], ("email", "ip", "card", "phone").index(k), k) for k in may for p in around if (p, k) in good]
        if kind is None and best:
            out.add((i, a, b, min(best)[2]))
    return out


def line_dedup(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    keyed = [[(line, line.strip(strip).translate(LOWER)) for line in (t or "").split("\n")] for _, t in rows]
    ids = [2**63 if d is None else d for d, _ in rows]
    where = defaultdict(set)
    for d, lines in zip(ids, keyed):
        for _, k in lines:
            if len(k) >= least:
                where[k].add(d)
    out = []
    for (doc, _), d, lines in zip(rows, ids, keyed):
        kept = [line for line, k in lines if not (len(where.get(k, ())) > 1 and d != min(where[k]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def contained(rows, items, k=5, percent=80):
    """(doc_id, item_id, n_item, n_shared) of each document that holds an item."""
    out = {}
    tests = [(i, shingles(t, k)) for i, t in items]
    for d, t in rows:
        s = shingles(t, k)
        for i, q in tests:
            n = len(q & s)
            if q and 100 * n >= percent * len(q):
                out[d, i, len(q)] = max(n, out.get((d, i, len(q)), 0))
    return [(*key, n) for key, n in out.items()]


def tokens(rows, path, end=0):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    out, start = [], 0
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def quality_targets(sizes, names, epochs=3):
    """Water-filling by repeated resharing: sizes by source, names in order."""
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.discard(s)
    return target
