"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are the white-space words of a text, tagged as the beginning, inside or
outside of a secret. A token's potentials add the weights of its shape, of the
class and the (hashed) word of both neighbours and of a feature of the whole
file; Viterbi finds the best tag sequence of the whole text. All features are
counted over character arrays, a text at a time.

The field is trained here, by gradient ascent on the likelihood, on snippets of a
bounded sample whose tags come from the fixed patterns, and on copies of them:
with another value in the secret's place (alphabet, length, prefix and signs
vary), another keyword or none, and plain strings with digits and signs (paths,
addresses, dates, numbers) among the other words. It then adds the parts of its
spans that no pattern covers, if they beat "outside" by ``LEAST_MARGIN``, and
never removes one.

Decoding is exact and still cheap: a token whose margin for "outside" exceeds
everything that the transitions and its right neighbour could win is outside in
every best sequence, so the chain is cut there and only the stretches between
are decoded step by step.

Defined results
    null or empty text: no spans. Very long texts are scanned whole, and searched
    whole for training snippets (``DOC_SNIPPETS`` of one document at most).
    Repeated rows each get their result; an id that repeats is one training text.
    Empty table: no rows; no pattern match in the sample: the field adds nothing.
    Only ``doc_id`` and ``text`` are read. Positions count code points; ends are
    exclusive.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import hash_sample, small_batches, stored

#: the fixed patterns, in the order of their kinds: name, pattern, group, least length
PATTERNS = [
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # greedy runs: a run of 24 is found exactly where a whole run has 24 or more
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
]
KINDS = [p[0] for p in PATTERNS] + ["crf"]
FIT_ROWS = 400
SNIPPET = 24
DOC_SNIPPETS = 8  # of one document, beside that of its middle
TOKEN_CHARS = 512  # of a token in a training snippet
COPIES = 3
B, I, O = 0, 1, 2  # noqa: E741
#: a decoded span is added if it beats "outside" by this log-odds margin
LEAST_MARGIN = 1.0
LEAST_PART = 4  # characters of a part beside base spans
_EDGES = " \n\t\r\v\f\"'`,;()[]{}<>:="

_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)


def may_have_keyword(text: str) -> bool:
    """A cheap test that loses no match: lower-casing keeps ASCII letters as letters."""
    low = text.lower()
    return any(k in low for k in ("passw", "secret", "token", "api_key", "apikey"))


_GATES = {"assign": may_have_keyword, "access": lambda t: "AKIA" in t, "hex": lambda t: True}
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, kind number, kind, end)`` of the pattern matches, in order."""
    found = []
    for number, (kind, pattern, group, least) in enumerate(PATTERNS):
        if not _GATES[kind](text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                found.append((m.start(), number, kind, m.end()))
    return sorted(found)


# ------------------------------------------------------------------ features
SHAPE_FEATURES = 24
CLASSES = 6  # word, number, keyword, sign, opaque, other
FILE_CLASSES = 4
WORDS = 1 << 10  # buckets of the neighbouring words
_SPACE, _DIGIT, _ALPHA, _UPPER, _LOWER, _OPAQUE, _STRIP, _BIG, _SYMBOL = (1 << k for k in range(9))


def _properties(c: str) -> int:
    """Bits of one character; the upper and lower bits are those of A-Z and a-z."""
    return (
        _SPACE * (c in " \n\t\r\v\f") | _DIGIT * c.isdigit() | _ALPHA * c.isalpha() | _UPPER * ("A" <= c <= "Z")
        | _LOWER * ("a" <= c <= "z") | _OPAQUE * (c.isascii() and (c.isalnum() or c in "+/_.=-"))
        | _STRIP * (c in "\"'`,;()[]{}<>") | _BIG * c.isupper() | _SYMBOL * (c in "!#$%&*^~")
    )


@cache
def _plane() -> np.ndarray:
    """The bits of the characters of the basic plane."""
    return np.array([_properties(chr(k)) for k in range(1 << 16)], dtype=np.uint16)


def properties(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or codes.max() < 1 << 16:
        return _plane()[codes]
    bits = _plane()[np.minimum(codes, (1 << 16) - 1)]
    far = codes >= 1 << 16
    kinds, place = np.unique(codes[far], return_inverse=True)
    bits[far] = np.array([_properties(chr(k)) for k in kinds.tolist()], dtype=np.uint16)[place]
    return bits


@cache
def _powers() -> np.ndarray:
    return np.array([pow(0x100000001B3, k, 1 << 64) for k in range(256)], dtype=np.uint64)


class Tokens:
    """The white-space words of a text: place, shape bits, class and word bucket of each, by arrays."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        props = properties(codes)
        inside = np.zeros(len(codes) + 2, dtype=bool)
        inside[1:-1] = props & _SPACE == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = edges[::2].astype(np.int64), edges[1::2].astype(np.int64)
        self.lengths = ends - self.starts
        self.n = len(self.starts)
        if not self.n:
            self.bits = self.kinds = self.words = np.zeros(0, dtype=np.int64)
            self.file = 0
            return
        count = lambda mask: np.add.reduceat(mask, self.starts, dtype=np.int32)

        def upto(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(codes), dtype=np.int32)
            np.cumsum(mask, out=total[1:])
            return total

        # sums run on over white space up to the next word; it has none of the counted bits
        digits, alpha, upper = (count(props & bit > 0) for bit in (_DIGIT, _ALPHA, _UPPER))
        lower = count(props & _LOWER > 0) > 0
        opaque_chars = count(props & _OPAQUE > 0)
        # the core is what is left without quotes and brackets at both ends
        at = np.arange(len(codes), dtype=np.int32)
        solid = (props & (_STRIP | _SPACE)) == 0
        first = np.minimum.reduceat(np.where(solid, at, len(codes)), self.starts)
        last = np.maximum.reduceat(np.where(solid, at, -1), self.starts)
        n = np.maximum(last - first + 1, 0)
        n[first == len(codes)] = 0
        head = np.minimum(first, len(codes) - 1)
        is_digit = props & _DIGIT > 0
        changed = upto(is_digit[1:] != is_digit[:-1])
        runs = np.maximum(last, 0), head  # a running count's ends over the core
        turns = np.where(n > 0, changed[runs[0]] - changed[runs[1]], 0)
        group = props & (_UPPER | _LOWER | _DIGIT)
        switched = upto(group[1:] != group[:-1])
        switches = np.where(n > 0, switched[runs[0]] - switched[runs[1]], 0)
        letters = alpha * 5 >= n
        symbols = count(props & _SYMBOL > 0) > 0
        opaque = (opaque_chars == n) & (n > 0)
        plain = (alpha == n) & (n > 0)
        lead, second = codes[head], codes[np.minimum(head + 1, len(codes) - 1)]
        sign = (n == 1) & ((lead == 58) | (lead == 61)) | (n == 2) & (lead == 58) & (second == 61)
        opening = codes[self.starts]
        quoted = (opening == 34) | (opening == 39)
        keyword = np.zeros(self.n, dtype=bool)
        valued = np.zeros(self.n, dtype=bool)
        if may_have_keyword(text):
            for m in _KEYWORD.finditer(text):
                k = int(np.searchsorted(self.starts, m.start(), side="right")) - 1
                keyword[k] = True
            for k in np.flatnonzero(keyword).tolist():
                token = text[self.starts[k] : self.starts[k] + self.lengths[k]]
                valued[k] = re.search(r"[:=].{5}", token) is not None
        tests = (
            n < 4, (n >= 4) & (n < 8), (n >= 8) & (n < 16), (n >= 16) & (n < 24), (n >= 24) & (n < 64), n >= 64,
            plain & (upper == 0), plain & (upper == 1) & (props[head] & _BIG > 0), plain & (upper > 1),
            digits > 0, (digits * 4 >= n) & (n > 0), (digits == n) & (n > 0), opaque & (digits > 0) & (lower | (upper > 1)),
            turns >= 4, turns >= 8, (upper >= 4) & lower, keyword, sign, valued, quoted & (n >= 8),
            (upper >= 8) & (digits > 0) & ~lower & opaque,
            (switches * 3 >= n) & (n >= 12) & letters, (switches >= 16) & letters, symbols & (digits > 0) & letters & (n >= 8),
        )
        self.bits = (1 << np.arange(SHAPE_FEATURES, dtype=np.int64)) @ np.array(tests)
        self.kinds = np.select(
            [keyword, sign, opaque & (n >= 16) & (digits >= 3), (digits == n) & (n > 0), plain | (n == 0)], [2, 3, 4, 1, 0], 5
        )
        folded = np.where(props & _UPPER > 0, codes + 32, codes).astype(np.uint64)
        folded[props & (_SPACE | _STRIP) > 0] = 0
        begin = np.repeat(self.starts, np.diff(np.r_[self.starts, len(codes)]))
        place = at - np.concatenate([np.zeros(self.starts[0], dtype=np.int64), begin])
        coded = np.add.reduceat(folded * _powers()[place % 256], self.starts)
        self.words = ((coded * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        share = ((self.kinds >= 2) & (self.kinds <= 4)).mean()
        self.file = int(np.searchsorted([0.0001, 0.01, 0.1], share, side="right"))


def bit_rows(bits: np.ndarray) -> np.ndarray:
    return (np.asarray(bits, dtype=np.int64)[..., None] >> np.arange(SHAPE_FEATURES) & 1).astype(float)


class Field:
    """The weights: shape (features x 3), class and word of both neighbours (x 3), file class, transitions (3 x 3)."""

    def __init__(self) -> None:
        self.shape = np.zeros((SHAPE_FEATURES + 1, 3))
        self.before = np.zeros((CLASSES + 1, 3))
        self.after = np.zeros((CLASSES + 1, 3))
        self.word_before = np.zeros((WORDS + 1, 3))
        self.word_after = np.zeros((WORDS + 1, 3))
        self.file = np.zeros((FILE_CLASSES, 3))
        self.move = np.zeros((3, 3))

    def parts(self) -> list[np.ndarray]:
        return [self.shape, self.before, self.after, self.word_before, self.word_after, self.file, self.move]

    def moves(self) -> np.ndarray:
        move = self.move.copy()
        move[O, I] = -1e9
        return move


def _beside(values: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's left and right neighbour; ``outside`` beyond the text."""
    edge = np.full((*values.shape[:-1], 1), outside)
    return np.concatenate([edge, values[..., :-1]], axis=-1), np.concatenate([values[..., 1:], edge], axis=-1)


def potentials(field: Field, shaped: np.ndarray, kinds: np.ndarray, words: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Emission scores (..., tokens, 3); ``shaped`` is what the shapes alone score."""
    before, after = _beside(kinds, CLASSES)
    left, right = _beside(words, WORDS)
    near = field.before[before] + field.after[after] + field.word_before[left] + field.word_after[right]
    return shaped + near + field.file[file][..., None, :]


def train(snippets: list[tuple[Tokens, int, np.ndarray]], steps: int = 150, rate: float = 0.1) -> Field:
    """Gradient ascent on the log-likelihood of equally long snippets ``(tokens, file class, tags)``."""
    field = Field()
    if not snippets:
        return field
    rows = np.stack([bit_rows(s[0].bits) for s in snippets])
    kinds, words = np.stack([s[0].kinds for s in snippets]), np.stack([s[0].words for s in snippets])
    file, tags = np.array([s[1] for s in snippets]), np.stack([s[2] for s in snippets]).astype(int)
    n, length = tags.shape
    gold = np.eye(3)[tags]
    mean = [np.zeros_like(p) for p in field.parts()]
    square = [np.zeros_like(p) for p in field.parts()]

    def summed(values: np.ndarray):
        """Adds rows of errors up by their value, whose order is sorted once."""
        flat = values.reshape(-1)
        order = np.argsort(flat, kind="stable")
        known, starts = np.unique(flat[order], return_index=True)
        return known, order, starts

    near = [summed(v) for v in (*_beside(kinds, CLASSES), *_beside(words, WORDS))]
    moved = np.zeros((3, 3))
    np.add.at(moved, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1.0)
    for step in range(1, steps + 1):
        emit = potentials(field, rows @ field.shape[:-1] + field.shape[-1], kinds, words, file)
        # forward and backward in shares: one exponential a potential, each step scaled to sum 1
        step_odds = np.exp(field.moves())
        odds = np.exp(emit - emit.max(axis=-1, keepdims=True))
        fore, back, scale = np.empty_like(odds), np.ones_like(odds), np.empty((n, length, 1))
        for t in range(length):
            reached = odds[:, t] * (np.array([1.0, 0.0, 1.0]) if t == 0 else fore[:, t - 1] @ step_odds)
            scale[:, t] = reached.sum(axis=1, keepdims=True)
            fore[:, t] = reached / scale[:, t]
        for t in range(length - 2, -1, -1):
            back[:, t] = (odds[:, t + 1] * back[:, t + 1] / scale[:, t + 1]) @ step_odds.T
        unary = fore * back
        onward = (odds * back / scale)[:, 1:]
        pair = np.einsum("ntx,nty->xy", fore[:, :-1], onward, optimize=True) * step_odds
        error = gold - unary
        flat = error.reshape(-1, 3)
        grads = [np.zeros_like(p) for p in field.parts()]
        grads[0][:-1] = rows.reshape(-1, SHAPE_FEATURES).T @ flat
        grads[0][-1] = flat.sum(axis=0)
        for grad, (known, order, starts) in zip(grads[1:5], near, strict=True):
            grad[known] = np.add.reduceat(flat[order], starts)
        np.add.at(grads[5], file, error.sum(axis=1))
        grads[6] += moved - pair
        grads[6][O, I] = 0.0
        for k, (p, g, m, v) in enumerate(zip(field.parts(), grads, mean, square, strict=True)):  # Adam steps
            g = g / n - (0.002 if k in (3, 4) else 0.0005) * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """The best tags of one stretch that has "outside" (or the text's edge) on both sides."""
    score = (emit[0] + move[O]).tolist()
    links = []
    steps = move.tolist()
    for e in emit[1:].tolist():
        link, new = [], []
        for y in range(3):
            options = [score[x] + steps[x][y] for x in range(3)]
            x = options.index(max(options))
            link.append(x)
            new.append(options[x] + e[y])
        links.append(link)
        score = new
    score = [s + steps[y][O] for y, s in enumerate(score)]
    y = score.index(max(score))
    tags = [y]
    for link in reversed(links):
        y = link[y]
        tags.append(y)
    return tags[::-1]


def decode(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Viterbi tags of a whole text (its edges count as "outside")."""
    tags = np.full(len(emit), O, dtype=np.int8)
    if not len(emit):
        return tags
    # turning a tag to "outside" may change the transitions before and after it
    # and force an I on its right to B: at most this is lost
    free = move[move > -1e8]
    spread = 3 * (free.max() - free.min())
    right = np.append(np.maximum(0, emit[1:, I] - emit[1:, B]), 0.0)
    open_ = np.flatnonzero(emit[:, O] - np.maximum(emit[:, B], emit[:, I]) <= spread + right)
    if len(open_):
        ends = np.flatnonzero(np.diff(open_) > 1)
        for a, b in zip(np.r_[0, ends + 1], np.r_[ends, len(open_) - 1], strict=True):
            part = slice(open_[a], open_[b] + 1)
            tags[part] = viterbi(emit[part], move)
    return tags


class Scanner:
    """Finds all spans of whole texts with one trained field."""

    def __init__(self, field: Field):
        self.field, self.move = field, field.moves()
        self.shaped: dict[int, np.ndarray] = {}

    def _shape_scores(self, bits: np.ndarray) -> np.ndarray:
        known, place = np.unique(bits, return_inverse=True)
        for b in known.tolist():
            if b not in self.shaped:
                self.shaped[b] = bit_rows(np.array([b]))[0] @ self.field.shape[:-1] + self.field.shape[-1]
        return np.array([self.shaped[b] for b in known.tolist()])[place]

    def tagged(self, text: str) -> Iterator[tuple[int, int]]:
        """The spans whose tags beat "outside" by ``LEAST_MARGIN``."""
        t = Tokens(text)
        if not t.n:
            return
        emit = potentials(self.field, self._shape_scores(t.bits), t.kinds, t.words, np.int64(t.file))
        tags = decode(emit, self.move)
        begins = np.flatnonzero(tags == B)
        for a in begins.tolist():
            b = a + 1
            while b < len(tags) and tags[b] == I:
                b += 1
            if margin(emit, self.move, tags, a, b) >= LEAST_MARGIN:
                yield int(t.starts[a]), int(t.starts[b - 1] + t.lengths[b - 1])

    def spans(self, text: str | None) -> list[dict]:
        text = text or ""
        base = base_spans(text)
        found = list(base)
        if np.any(self.field.shape):
            held = [(s, e) for s, _, _, e in base]
            for a, b in self.tagged(text):
                found += [(x, len(PATTERNS), "crf", y) for x, y in outside_of(a, b, held, text)]
        return [{"kind": k, "start": a, "end": b} for a, _, k, b in sorted(found)]


def margin(emit: np.ndarray, move: np.ndarray, tags: np.ndarray, a: int, b: int) -> float:
    """How much the tags of ``a .. b - 1`` win over "outside" there, the tags around as they are."""
    before, after = tags[a - 1] if a else O, tags[b] if b < len(tags) else O
    if after == I:
        after = B
    own = [before, *tags[a:b].tolist(), after]
    best = sum(emit[k, tags[k]] for k in range(a, b)) + sum(move[x, y] for x, y in pairwise(own))
    out = emit[a:b, O].sum() + move[before, O] + (b - a - 1) * move[O, O] + move[O, after]
    return float(best - out)


def outside_of(a: int, b: int, held: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """The parts of a span that no held span covers, without the white space, quotes and separators at their ends."""
    parts, at = [], a
    for s, e in sorted(held):
        if e > at and s < b:
            parts.append((at, min(s, b)))
            at = max(at, e)
    parts.append((at, b))
    out = []
    for x, y in parts:
        piece = text[x:y]
        left = len(piece) - len(piece.lstrip(_EDGES))
        core = piece.strip(_EDGES)
        if len(core) >= LEAST_PART:
            out.append((x + left, x + left + len(core)))
    return out


def has_pattern(text: Column) -> Column:
    """A superset of the texts with a pattern match (JVM-side, for choosing the sample)."""
    return text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")


SNIPPET_TYPE = "tokens array<string>, tags array<int>, file int"
_SNIPPETS = pa.schema([("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("file", pa.int32())])


def snippets_of(text: str) -> list[tuple[list[str], list[int], int]]:
    """Windows of ``SNIPPET`` tokens around base spans (``DOC_SNIPPETS`` at most, spread over the text) and one
    around the text's middle, with tags; tokens beyond ``TOKEN_CHARS`` characters are cut."""
    t = Tokens(text)
    pad = SNIPPET - t.n
    if pad > 0:
        text = text + " a" * pad
        t = Tokens(text)
    tags = np.full(t.n, O)
    centres = []
    merged: list[list[int]] = []
    for a, _, _, b in base_spans(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        inside = np.flatnonzero((t.starts < b) & (t.starts + t.lengths > a))
        if len(inside):
            tags[inside] = I
            tags[inside[0]] = B
            centres.append(int(inside[0]))
    step = max(1, -(-len(centres) // DOC_SNIPPETS))
    out = []
    for c in [t.n // 2, *centres[::step]]:
        a = min(max(0, c - SNIPPET // 2), t.n - SNIPPET)
        own = tags[a : a + SNIPPET].copy()
        if own[0] == I:
            own[0] = B
        ends = t.starts + np.minimum(t.lengths, TOKEN_CHARS)
        out.append(([text[t.starts[k] : ends[k]] for k in range(a, a + SNIPPET)], own.tolist(), t.file))
    return out


#: what copies of a training snippet put in a secret's place: alphabets, words before it, and signs between
ALPHABETS = [string.ascii_letters + string.digits, string.hexdigits.lower()[:16], string.ascii_lowercase + string.digits,
             string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"]
CONTEXTS = ["key", "auth", "bearer", "credential", "credentials", "pwd", "login", "access", "private", "pass", "apikey",
            "authorization", "is", "with", "using", "use"]


def made_secret(rng: random.Random) -> str:
    """A string as secrets look: one or more runs of an alphabet, maybe after a short prefix."""
    letters = rng.choice(ALPHABETS)
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    kind = rng.randrange(4)
    if kind == 0:
        body = run(rng.randint(16, 64))
    elif kind == 1:
        body = run(rng.randint(2, 6)).lower() + rng.choice("_-") + run(rng.randint(14, 48))
    elif kind == 2:
        body = rng.choice(".-").join(run(rng.randint(6, 40)) for _ in range(rng.randint(2, 5)))
    else:
        body = run(rng.randint(9, 16)) + rng.choice("!#$%&*@") + run(rng.randint(1, 4))
    return body if any(c.isdigit() for c in body) else body + str(rng.randint(10, 99))


def made_plain(rng: random.Random) -> str:
    """A string with digits or signs that is no secret: an address, a path, a date, a version, a number, a name."""
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    number = lambda a, b: "".join(rng.choice(string.digits) for _ in range(rng.randint(a, b)))
    words = lambda sep, a, b: sep.join(word() for _ in range(rng.randint(a, b)))
    kind = rng.randrange(12)
    if kind == 0:
        tail = rng.choice(["", "?id=" + number(1, 8), "#" + word(), "." + word()[:4], "-" + number(1, 6)])
        return rng.choice(["http://", "https://", "www.", ""]) + words(".", 2, 3) + "/" + words(rng.choice("/-_"), 0, 5) + tail
    if kind == 1:
        return words(".", 1, 2) + number(0, 3) + "@" + words(".", 2, 2)
    if kind == 2:
        return rng.choice(["/", "./", "~/", "C:\\", ""]) + words("/", 2, 5) + rng.choice(["", "." + word()[:3], number(1, 3)])
    if kind == 3:
        date = f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return date + rng.choice(["", f"T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z", f".{word()}", f"_{number(2, 6)}"])
    if kind == 4:
        return rng.choice(["v", "", word() + "-", word() + "=="]) + ".".join(number(1, 2) for _ in range(rng.randint(2, 4))) + rng.choice(["", "-beta", "rc1"])
    if kind == 5:
        return rng.choice(["", "+", "#", "$", "-"]) + number(3, 19)
    if kind == 6:
        return rng.choice("-./ ").join(number(2, 5) for _ in range(rng.randint(2, 5))).replace(" ", "-")
    if kind == 7:
        return words(rng.choice("_-."), 2, 6) + rng.choice(["", "()", "[0]", ":", number(1, 2)])
    if kind == 8:
        return "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + number(0, 2)
    if kind == 9:
        return word().upper() + rng.choice("-_") + number(1, 5)
    if kind == 10:
        return words("", 2, 6) + rng.choice(["", "!", "!!", "...", "?"])
    return f"{word()}={rng.choice([word(), number(1, 5)])}" + rng.choice(["", "&" + word() + "=" + number(1, 4), ";"])


def copies_of(tokens: list[str], tags: list[int], rng: random.Random, n: int) -> list[tuple[list[str], list[int]]]:
    """Copies of a snippet whose secrets have another value, with another keyword or none, among other plain strings."""
    out = []
    for _ in range(n):
        new, marks, k = [], [], 0
        while k < len(tokens):
            if tags[k] == O:
                new.append(made_plain(rng) if rng.random() < 0.15 else tokens[k])
                marks.append(O)
                k += 1
                continue
            k += 1
            while k < len(tokens) and tags[k] == I:
                k += 1
            value, word = made_secret(rng), rng.choice(CONTEXTS)
            style = rng.randrange(4)
            said = [[word, value], [word + rng.choice(":="), value], [word, rng.choice([":", "="]), value], [value]][style]
            quote = rng.choice(["", "", "\"", "'"])
            said[-1] = quote + said[-1] + quote + rng.choice(["", "", ",", "."])
            new += said
            marks += [O] * (len(said) - 1) + [B]
        new, marks = (new + ["a"] * SNIPPET)[:SNIPPET], (marks + [O] * SNIPPET)[:SNIPPET]
        out.append((new, marks))
    return out


def fit_field(snippets: list[tuple[list[str], list[int], int]], copies: int = COPIES) -> Field:
    """The field of the snippets and their copies; without any secret among them it adds nothing."""
    if not any(B in tags for _, tags, _ in snippets):
        return Field()
    rng = random.Random(17)
    rows = []
    for tokens, tags, file in snippets:
        for new, marks in [(tokens, tags), *copies_of(tokens, tags, rng, copies)]:
            t = Tokens(" ".join(new))
            if t.n == SNIPPET:
                rows.append((t, file, np.array(marks)))
    return train(rows)


def fit(documents: DataFrame, rows: int = FIT_ROWS) -> Field:
    """The field trained on about ``rows`` documents with a pattern and ``rows`` without, chosen by id hash.

    The share of ids that are looked at grows until it holds enough documents
    with a pattern (or all of them). An id that repeats counts with its least
    text. Whole texts are searched for snippets in the scan; only snippets travel.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("text IS NOT NULL AND id IS NOT NULL")
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    n = documents.count()
    share = min(1.0, 4 * rows / max(1, n))
    while True:
        near = docs.where(at < int(share * (1 << 40))).select("id", has_pattern(F.col("text")).alias("hit"))
        flags = stored(near.groupBy("id").agg(F.max("hit").alias("hit")), "flags")
        hits = flags.where("hit").count()
        if hits >= rows or share >= 1.0:
            break
        share = min(1.0, share * max(2.0, 1.3 * rows / max(1, hits)))
    with_hit, without = (hash_sample(flags.where(F.col("hit") == hit), "id", rows) for hit in (True, False))
    # at most 2 x rows numbers: the texts of all other documents stay where they are
    ids = F.broadcast(stored(with_hit.unionByName(without).select("id"), "chosen"))
    texts = docs.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for text in batch.column("text").to_pylist() for s in snippets_of(text)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _SNIPPETS, strict=True)], schema=_SNIPPETS
            )

    found = texts.select("text").mapInArrow(cut, SNIPPET_TYPE).collect()  # 2 x rows x (DOC_SNIPPETS + 1) at most
    return fit_field(sorted((list(r["tokens"]), list(r["tags"]), r["file"]) for r in found))


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, spans)``: all spans by start, then kind."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        for batch in batches:
            spans = [scanner.spans(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, type=_SPANS)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def mask(text: str, spans: list[dict], put: str = "[SECRET]") -> str:
    """The text with every (merged) span replaced."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], put]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame, field: Field) -> DataFrame:
    """The documents (all columns) with secrets masked in ``text``; ``n_chars``, if there, follows the text."""
    small_batches(documents.sparkSession)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        for batch in batches:
            texts = []
            for t in batch.column(place).to_pylist():
                spans = scanner.spans(t)
                texts.append(mask(t, spans) if spans else t)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, type=batch.schema.field(place).type))

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
