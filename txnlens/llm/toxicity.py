"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps tokens to weighted symbols (insult, threat, target,
negation, reported speech). A white-space token is looked up by each of its runs
of letters, as the arcs are learned (``you,idiot``, ``<b>idiot</b>``), and by
all its letters together (``i.d.i.o.t``). Three context transducers read the symbols of one
clause and mark an insult or threat that follows a negation, a reporting verb
or a target; their composition is one table that walks every clause once. The
target transducer also walks it backwards ("you will die", "I will kill you"). A
clause is scored by the weights of its matches; a document by its matched
clauses, through a logistic curve.

Insult arcs are learned: words and word stems that labelled toxic documents
hold far more often than others (likelihood ratio of at least ``LEAST_G2``,
log-odds of at least ``LEAST_WEIGHT``), all of them. Threat words weigh their log-odds
among the same labels. The lexicon and the curve are fitted on
at most ``FIT_ROWS`` labelled documents, chosen by a hash of their id among
those that the caller allows; equal texts count once.

Defined results
    null or empty text: no match, the score of a text without matches. No
    labels or only one label: no arcs, the curve's constant. Repeated labels of
    an id count as toxic if any is; for training an id that repeats counts with its
    least text; repeated documents are scored each. Empty
    table: no rows. Of ``documents`` only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import hash_sample, small_batches, stored

FIT_ROWS = 12_000
LEAST_G2 = 30.0
LEAST_WEIGHT = 1.5
LEAST_FIXED = 0.2  # weight of a function word that the labels say nothing about
STEMS = (4, 5, 6)
PREDICT_AT = 0.7
MEMO_TOKENS = 200_000

INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
NEGATED, REPORTED, TARGETED = 1, 2, 4
#: function words of the grammar (English, German, French, Spanish)
WORDS = {
    THREAT: "kill hurt destroy die murder beat töten umbringen sterben tuer mourir matar morir",
    TARGET: "you your yours he she they them him her du dich dein ihr euch tu toi ton vous usted tú ti vosotros",
    NEGATION: "not never no none nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says called calls wrote quoted sagte nannte schrieb dit disait écrit dijo llamó escribió",
}
_CLAUSE_END = re.compile(r"[.!?;:]\W*$")
_CLAUSE_MARK = re.compile(r"[.!?;:]")
N_FEATURES = 8

Table = dict[tuple[int, tuple[int, int]], tuple[int, tuple[int, int]]]
_SYMBOLS = [(kind, marks) for kind in range(1, 6) for marks in range(8)]


def mark_after(trigger: int, mark: int) -> Table:
    """A transducer that adds ``mark`` to insults and threats after ``trigger``."""
    table: Table = {}
    for state, (kind, marks) in product((0, 1), _SYMBOLS):
        matched = state and kind in (INSULT, THREAT)
        table[state, (kind, marks)] = (1 if kind == trigger else state, (kind, marks | mark if matched else marks))
    return table


def compose(first: Table, second: Table) -> Table:
    """The transducer that feeds the first one's output to the second; states are numbered from (0, 0) = 0."""
    table: Table = {}
    number = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        pair = todo.pop()
        for symbol in _SYMBOLS:
            a, middle = first[pair[0], symbol]
            b, out = second[pair[1], middle]
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            table[number[pair], symbol] = (number[a, b], out)
    return table


def grammar() -> Table:
    return compose(compose(mark_after(NEGATION, NEGATED), mark_after(REPORT, REPORTED)), mark_after(TARGET, TARGETED))


class Scanner(dict):
    """Codes tokens (``2 * entry + ends a clause``; ``-1 - k`` for the codes ``several[k]``), memoised, and scores texts."""

    def __init__(self, arcs: dict[str, float]):
        super().__init__()
        self.arcs = arcs
        self.kind, self.weight = [0], [0.0]
        self.entries: dict[tuple[int, float], int] = {(0, 0.0): 0}
        self.several: list[list[int]] = []
        self.fixed = {w: kind for kind, words in WORDS.items() for w in words.split()}
        self.table = grammar()
        self.behind = mark_after(TARGET, TARGETED)

    def key(self, word: str) -> tuple[int, float]:
        found = [self.arcs.get(f"={word}", 0.0), *(self.arcs.get(f"^{word[:n]}", 0.0) for n in STEMS if len(word) >= n)]
        if max(found) > 0:
            return INSULT, max(found)
        return (self.fixed[word], self.arcs.get(f"+{word}", 1.0)) if word in self.fixed else (0, 0.0)

    def entry(self, key: tuple[int, float]) -> int:
        if key not in self.entries:
            self.entries[key] = len(self.kind)
            self.kind.append(key[0])
            self.weight.append(key[1])
        return self.entries[key]

    def parts(self, token: str, glued: tuple[int, float]) -> list[int]:
        """Codes of the letter runs of a token of several, in order; none if the token matches as a whole or not at all."""
        runs = [(alpha, "".join(run)) for alpha, run in groupby(token, str.isalpha)]
        keys = [self.key(run.lower()) if alpha else (0, 0.0) for alpha, run in runs]
        insults = sum(w for kind, w in keys if kind == INSULT)
        if not any(kind for kind, _ in keys) or (glued[0] and not insults) or (glued[0] == INSULT and insults < glued[1]):
            return []
        codes = []
        for key, (alpha, run) in zip(keys, runs, strict=True):
            if alpha:
                codes.append(2 * self.entry(key))
            elif codes and _CLAUSE_MARK.search(run):
                codes[-1] |= 1
        # the token's own end is what it is for one that has no runs
        codes[-1] = (codes[-1] & ~1) | bool(_CLAUSE_END.search(token))
        return [c for c in codes if c]

    def __missing__(self, token: str) -> int:
        letters = "".join(filter(str.isalpha, token))
        glued = self.key(letters.lower())
        if len(self) > MEMO_TOKENS:
            self.clear()
        if letters and letters not in token:
            codes = self.parts(token, glued)
            if codes:
                self.several.append(codes)
                self[token] = -len(self.several)
                return -len(self.several)
        code = self[token] = 2 * self.entry(glued) + bool(_CLAUSE_END.search(token))
        return code

    def followed(self, kinds: list[int], clauses: list[int]) -> list[int]:
        """The marks of the target transducer run backwards over each clause: the target may come after the threat."""
        out, state, last = [], 0, None
        for kind, c in zip(reversed(kinds), reversed(clauses), strict=True):
            if c != last:
                state, last = 0, c
            state, (_, marks) = self.behind[state, (kind, 0)]
            out.append(marks)
        return out[::-1]

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if len(self.several) > MEMO_TOKENS:
            self.clear()
            self.several.clear()
        codes = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if (codes < 0).any():
            codes = np.array([c for code in codes.tolist() for c in (self.several[-1 - code] if code < 0 else (code,))], dtype=np.int64)
        kinds = np.array(self.kind)[codes >> 1]
        at = np.flatnonzero(kinds)
        if not ((kinds[at] == INSULT) | (kinds[at] == THREAT)).any():
            return [0.0] * N_FEATURES
        clause = np.cumsum(codes & 1) - (codes & 1)
        matched = np.unique(clause[at][kinds[at] <= THREAT])
        at = at[np.isin(clause[at], matched)]
        sums = dict.fromkeys(("plain", "negated", "reported", "targeted", "threat"), 0.0)
        best = score = 0.0
        state, last = 0, -1
        kind_list, clause_list = kinds[at].tolist(), clause[at].tolist()
        follows = self.followed(kind_list, clause_list)
        for kind, w, c, later in zip(kind_list, (codes[at] >> 1).tolist(), clause_list, follows, strict=True):
            if c != last:
                state, score, last = 0, 0.0, c
            state, (kind, marks) = self.table[state, (kind, 0)]
            marks |= later
            if kind == THREAT and marks & TARGETED and not marks & NEGATED:
                sums["threat"] += self.weight[w]
            if kind == INSULT:
                weight = self.weight[w]
                sums["plain"] += 0 if marks & (NEGATED | REPORTED) else weight
                sums["negated"] += weight if marks & NEGATED else 0
                sums["reported"] += weight if marks & REPORTED else 0
                sums["targeted"] += weight if marks & TARGETED else 0
                score += weight
                best = max(best, score)
        clauses = clause[-1] + 1
        return [*np.log1p(list(sums.values())).tolist(), float(np.log1p(len(matched))), best / 10, len(matched) / clauses]


def learn_arcs(sample: DataFrame) -> dict[str, float]:
    """``=word`` and ``^stem`` arcs and ``+word`` weights of function words with their log-odds, from ``(text, toxic)``."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if not 0 < p < n:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    docs = sample.select("toxic", F.explode(F.array(words)).alias("w"))
    stems = [
        F.transform(F.filter("w", lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k)))
        for k in STEMS
    ]
    entries = F.array_distinct(F.concat(F.transform("w", lambda w: F.concat(F.lit("="), w)), *stems))
    counts = docs.select("toxic", F.explode(entries).alias("entry")).groupBy("entry").agg(
        F.sum("toxic").alias("pos"), F.count("*").alias("all")
    )
    share = p / n
    x, m = F.col("pos"), F.col("all")
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    g2 = 2 * (part(x, m * share) + part(m - x, m * (1 - share)))
    odds = F.log((x + 0.5) / (p + 1)) - F.log((m - x + 0.5) / (n - p + 1))
    scored = stored(counts.select("entry", "pos", "all", g2.alias("g2"), odds.alias("weight")), "arcs")
    good = scored.where((x > 1) & (x > m * share) & (F.col("g2") >= LEAST_G2) & (F.col("weight") >= LEAST_WEIGHT))
    # the function words' own log-odds weigh what the grammar marks with them
    fixed = scored.where(F.col("entry").isin([f"={w}" for words in WORDS.values() for w in words.split()]))
    weights = {f"+{r['entry'][1:]}": max(LEAST_FIXED, r["weight"]) for r in fixed.select("entry", "weight").collect()}
    return weights | {r["entry"]: r["weight"] for r in good.orderBy(F.desc("g2"), "entry").collect()}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, arcs: dict[str, float], beta: np.ndarray):
        self.arcs, self.beta = arcs, beta


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, rows: int = FIT_ROWS) -> Model:
    """Lexicon and curve from at most ``rows`` labelled documents that ``allowed`` (on doc_id) admits."""
    small_batches(documents.sparkSession)
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    chosen = named.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = stored(hash_sample(stored(chosen, "labels"), "id", rows), "chosen")
    # at most ``rows`` rows of two numbers: the text need not move
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("id", "text", "toxic")
    # an id that repeats is one text; equal texts of several ids count once
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(sample.groupBy(F.md5("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    arcs = learn_arcs(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(arcs)
        for batch in batches:
            x = [scanner.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    found = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    if not found:
        return Model(arcs, np.zeros(N_FEATURES + 1))
    order = sorted((list(r["x"]), r["toxic"]) for r in found)
    return Model(arcs, fit_curve(np.array([o[0] for o in order]), np.array([o[1] for o in order], dtype=float)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` that are asked for, with ``score``: here ``doc_id`` and ``score``."""
    small_batches(documents.sparkSession)
    arcs, beta = model.arcs, model.beta
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(arcs)
        for batch in batches:
            x = np.array([scanner.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(documents: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """The documents (all columns, order of rows free) that score below ``at``; decided row by row in the scan."""
    small_batches(documents.sparkSession)
    arcs, beta = model.arcs, model.beta
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(arcs)
        for batch in batches:
            x = np.array([scanner.features(t) for t in batch.column(place).to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield batch.filter(pa.array(p < at))

    return documents.mapInArrow(run, documents.schema)
