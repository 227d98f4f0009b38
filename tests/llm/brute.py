"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

W = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def substring(docs: list[tuple], n: int = 13) -> list[tuple]:
    least: dict[tuple, int] = {}
    words = [(d, W.findall(t or "")) for d, t in docs]
    for d, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone: set[int] = set()
        for k in range(len(w) - n + 1):
            if d is not None and least[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept))))
    return out


def shingles(t: str | None, n: int = 5) -> set:
    w = W.findall(ascii_lower(t or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(docs: list[tuple], percent: int = 80) -> list[tuple]:
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]


def contamination(docs: list[tuple], items: list[tuple], n: int = 13) -> list[tuple]:
    grams: dict[tuple, set[str]] = {}
    for i, t in items:
        w = ALNUM.findall(ascii_lower(t or ""))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = ALNUM.findall(ascii_lower(t or ""))
        hit: set[int] = set()
        found: set[str] = set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                g = grams.get(tuple(w[k : k + size]))
                if g:
                    hit.update(range(k, k + size))
                    found |= g
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bad))
    return out


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_secrets(t: str | None) -> list[tuple]:
    found = [
        (m.start(), k, name, m.end())
        for k, (name, p, group, least) in enumerate(KINDS)
        for m in p.finditer(t or "")
        if len(m[group]) >= least
    ]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def inner_products(rows: list[tuple], k: int, every: int) -> list[tuple]:
    out = []
    good = [(i, v) for i, v in rows if v and all(x is not None and x == x and abs(x) != float("inf") for x in v) and any(v)]
    for i, v in good:
        if i is None or i % every:
            continue
        scored = []
        for j, u in good:
            if j is not None and j != i:
                s = 0.0
                for x, y in zip(v, u, strict=True):
                    s += x * y
                scored.append((-s, j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def line_dedup(docs: list[tuple], least: int = 10) -> list[tuple]:
    key = lambda x: ascii_lower(x.strip(" \t\n\v\f\r"))
    first: dict[str, int] = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), d), d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def merkle(docs: list[tuple], fanout: int = 16) -> list[tuple]:
    """Documents are (doc_id, source, lang, n_chars, text); rows as the contract of op12 names them."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        """The root, and for each node its list of (left, right)."""
        ways = [[] for _ in nodes]
        under = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
            for run in runs:
                for k in run:
                    step = "".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)
                    for x in under[k]:
                        ways[x].append(step)
            under = [[x for k in run for x in under[k]] for run in runs]
            nodes = [sha("".join(nodes[k] for k in run)) for run in runs]
        return nodes[0], ways

    by_source: dict = {}
    for row in docs:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        rows = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = rows, *tree([leaf(r) for r in rows])
    root, tops = tree([built[n][1] for n in names]) if names else (None, [])
    out = []
    for name, top in zip(names, tops, strict=True):
        rows, subroot, ways = built[name]
        for row, way in zip(rows, ways, strict=True):
            proof = way + top
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = leaf((*row[:4], ascii_lower(row[4])))
            for a, b in proof:
                node = sha(a + node + b)
            out.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in proof)), node, node == root))
    return out


_DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def _after(state: str, initial: str) -> str | None:
    """The state after a turn whose role has this initial, if the pattern allows it."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
    return initial if initial and initial in allowed else None


def cheapest_audit(rows: list[tuple]) -> tuple[int, str]:
    """Least (cost, audit) over rows of (initial, fault), forwards over whole prefixes."""
    best = {"": (0, "")}

    def inserts(at: dict) -> dict:
        at = dict(at)
        for _ in range(4):
            for q, (c, a) in list(at.items()):
                new = (c + 3, a + "I")
                at[_DUE[q]] = min(at.get(_DUE[q], new), new)
        return at

    for initial, fault in rows:
        after: dict = {}

        def put(q, value, after=after):
            after[q] = min(after.get(q, value), value)

        extra = 3 if fault == "truncated" else 0
        for q, (c, a) in inserts(best).items():
            put(q, (c + 4, a + "D"))
            if fault not in ("blank", "duplicate"):
                put(_DUE[q], (c + 3 + extra, a + "R"))
                if _after(q, initial):
                    put(_after(q, initial), (c + extra, a + "K"))
        best = after
    return min(v for q, v in inserts(best).items() if q in ("", "a"))


def faults(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        kind = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def conversation_repair(rows: list[tuple]) -> list[tuple]:
    """Rows are (conv_id, turn, role, text), undamaged; results as the contract of op13 names them."""
    blank = lambda v: " " if v is None else v
    convs: dict = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], sha(f"{len(r[1])}:{r[1]}{r[2]}")))
        said = [(r, t) for _, r, t in own]
        kinds = faults(said)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
        cost, audit = cheapest_audit(list(zip(initials, kinds, strict=True)))
        state, left, kept = "", iter(said), []
        for op in audit:
            role, text = ("", "") if op == "I" else next(left)
            if op == "K":
                state = role[0]
                kept.append(f"{role}:{text}")
            elif op != "D":
                state = _DUE[state]
                kept.append(f"{'user' if state == 'u' else 'assistant'}:{text}")
        count = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *count, illegal, cost, audit, sha("\n".join(kept))))
    return out
