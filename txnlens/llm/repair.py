"""Conversation structure repair by a rank-convergent parallel Viterbi.

A conversation's turns should read ``(system? (user assistant)+)?``. The rows
are kept, reroled, deleted, or joined by inserted empty turns so that they do,
at the least cost; among the cheapest ways the one whose edit initials are
least in ASCII. A row's first fault decides what may happen to it: blank and
duplicate rows must go, truncated ones cost more unless they go.

The edits are paths through four states (nothing yet, system said, user said,
assistant said), and each row turns the vector of the four costs-to-go behind
it into the one before it: a (min, +) matrix. Such products soon have rank one,
after which two vectors differ by a constant whatever they started from.

1. Rows are range-partitioned in order, so a long conversation spans several
   partitions; its rows in one partition are a chunk, held from then on as one
   byte a row (role class and fault).
2. All chunks run backwards at once. A conversation's last chunk starts from the
   true cost vector of its end, the others from a speculative one.
3. Fix-up passes: a chunk whose successor's vector differs from the one it
   started from by more than a constant runs again, up to the row where its new
   vector and its former one differ by a constant; from there on the former run
   holds. The passes end when no chunk is left.
4. With the stitched costs-to-go every chunk traces the least audit from each
   state it could begin in; the states of a conversation's chunks are then
   chained, one row a chunk, and pick the audits that hold.

The repaired rows are made where a chunk's rows are, so no task holds a
conversation. Only a digest over a whole conversation streams its rows through
one task, in bounded memory, because SHA-256 is sequential; the audit is one
text of a character an edit.

Defined results
    null role or text: one space. Rows go by turn (nulls first); rows of one
    turn by the first 32 characters of role and of text, then by SHA-256 of
    both. Equal rows are rows each, all but the first duplicates. A role's
    initial is its first character (none if empty); roles with initials other
    than s, u, a cannot be kept. Rows with a null ``conv_id`` are one
    conversation. Empty table: no rows. Only ``conv_id``, ``turn``, ``role``
    and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
PART_ROWS = 50_000
MAX_PARTS = 20_000  # the partitioner samples on the driver in proportion to them
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("clean", "truncated", "blank", "duplicate")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: the state after the turn that may be inserted or reroled in each state
DUE = (USER, USER, ASSISTANT, USER)
#: the state after a kept turn, by state and role class (s, u, a, other); -1 where it cannot be kept
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
#: costs-to-go behind the last row
END = (0, 2 * INSERT, INSERT, 0)
#: the speculative vector of a chunk that has a successor
ANY = (0, 0, 0, 0)
LEGAL = ((0, 1), (1, 2), (2, 1))  # role classes of adjacent turns


def _before(behind: tuple, symbol: int) -> tuple:
    """The costs-to-go before a row, from those behind it."""
    role, fault = divmod(symbol, len(FAULTS))
    extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
    costs = []
    for q in STATES:
        best = DELETE + behind[q]
        if FAULTS[fault] in ("clean", "truncated"):
            best = min(best, REROLE + extra + behind[DUE[q]])
            if KEPT[q][role] >= 0:
                best = min(best, extra + behind[KEPT[q][role]])
        costs.append(best)
    for _ in STATES:  # inserted turns before the row
        costs = [min(costs[q], INSERT + costs[DUE[q]]) for q in STATES]
    return tuple(costs)


@cache
def vectors() -> tuple[list[tuple], list[list[tuple[int, int]]]]:
    """All cost vectors up to a constant that can occur, and their steps.

    ``steps[vector][symbol]`` is the vector before a row and the constant that it
    lost. Vector 0 is the end's, vector 1 the speculative one.
    """
    known, steps = [END, ANY], []
    at = {v: k for k, v in enumerate(known)}
    for v in known:  # grows meanwhile
        row = []
        for symbol in range(4 * len(FAULTS)):
            costs = _before(v, symbol)
            low = min(costs)
            plain = tuple(c - low for c in costs)
            if plain not in at:
                at[plain] = len(known)
                known.append(plain)
            row.append((at[plain], low))
        steps.append(row)
    return known, steps


def run_back(symbols: bytes, given: int, former: bytes | None = None) -> tuple[bytearray, int]:
    """The vector before each row and the constants lost, from the vector ``given`` behind the last row.

    With the vectors of a ``former`` run it ends where both differ by a constant
    and takes the rest from there.
    """
    _, steps = vectors()
    out = bytearray(len(symbols)) if former is None else bytearray(former)
    lost, v = 0, given
    k = len(symbols) - 1
    while k >= 0:
        v, low = steps[v][symbols[k]]
        lost += low
        if former is not None and former[k] == v:
            k -= 1
            break
        out[k] = v
        k -= 1
    while k >= 0:  # converged: the same vectors, the same constants
        lost += steps[out[k + 1]][symbols[k]][1]
        k -= 1
    return out, lost


def trace(symbols: bytes, before: bytes, given: int, state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state`` along the cheapest edits, and the state it ends in."""
    known, steps = vectors()
    audit = []
    n = len(symbols)
    for k in range(n):
        role, fault = divmod(symbols[k], len(FAULTS))
        extra = TRUNCATED if fault == 1 else 0
        behind = known[before[k + 1]] if k + 1 < n else known[given]
        own = known[before[k]]
        lost = steps[before[k + 1] if k + 1 < n else given][symbols[k]][1]
        while True:
            rest = own[state] + lost
            if DELETE + behind[state] == rest:
                audit.append("D")
            elif INSERT + own[DUE[state]] + lost == rest:
                audit.append("I")
                state = DUE[state]
                continue
            elif fault < 2 and KEPT[state][role] >= 0 and extra + behind[KEPT[state][role]] == rest:
                audit.append("K")
                state = KEPT[state][role]
            else:
                audit.append("R")
                state = DUE[state]
            break
    while last and state in (SYSTEM, USER):
        audit.append("I")
        state = DUE[state]
    return "".join(audit), state


def role_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def damage(conversations: DataFrame) -> DataFrame:
    """Seeded faults: rows dropped, emptied, cut, repeated or reroled by the CRC-32 of ``conv_id:turn``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        named("role").alias("role"),
        named("text").alias("text"),
        (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20).alias("_kind"),
    ).where("_kind <> 0")
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _key(conv: Column) -> Column:
    """Conversation ids as texts without null."""
    return F.coalesce(conv.cast("long").cast("string"), F.lit(""))


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows in order, stored: ``id`` ascends, ``part`` is the partition and part of the id."""
    rows = conversations.select(
        _key(F.col("conv_id")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # equal rows are interchangeable, the number only keeps them from one partition
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    order += [F.col("digest"), F.col("_row")]
    parts = max(1, min(MAX_PARTS, -(-rows.count() // PART_ROWS)))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")
    placed = placed.withColumn("id", F.monotonically_increasing_id())
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", 2).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    return stored(
        placed.withColumns({"part": F.shiftright("id", 33), "role_class": role_class(F.col("role")), "fault": fault}),
        "repair_rows",
    )


CHUNK_SCHEMA = "key string, part long, symbols binary"
_CHUNK = pa.schema([("key", pa.string()), ("part", pa.int64()), ("symbols", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _runs(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
    return list(zip(cuts, cuts[1:])) if keys else []  # noqa: B905


def chunks(rows: DataFrame) -> DataFrame:
    """One row for each conversation and partition: a byte for every row, in order."""
    # the first row of each role and text; joined by the unique id, so no key is hot
    first = rows.groupBy("key", "digest").agg(F.min("id").alias("id")).select("id", F.lit(1).alias("_first"))
    faults = rows.select("key", "id", "part", "role_class", "fault").join(first, "id", "left")
    fault = F.when(F.col("fault") == 2, 2).when(F.col("_first").isNull(), 3).otherwise(F.col("fault"))
    coded = faults.select("key", "part", "id", (F.col("role_class") * len(FAULTS) + fault).cast("int").alias("symbol"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[bytes] = []
        out: list[tuple] = []
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True))
            symbols = np.asarray(batch.column("symbol")).astype(np.uint8)
            for a, b in _runs(keys):
                if held is not None and keys[a] != held:
                    out.append((*held, b"".join(parts)))
                    parts = []
                held = keys[a]
                parts.append(symbols[a:b].tobytes())
            if len(out) > 2000:
                yield _batch(out, _CHUNK)
                out = []
        if held is not None:
            out.append((*held, b"".join(parts)))
        yield _batch(out, _CHUNK)

    placed = coded.repartition("part").sortWithinPartitions("part", "id")
    return placed.mapInArrow(gather, CHUNK_SCHEMA)


RUN_FIELDS = "n_chunks long, last boolean, given int, start int, lost long, vectors binary"
_RUN = pa.schema(
    [*_CHUNK, ("n_chunks", pa.int64()), ("last", pa.bool_()), ("given", pa.int32()), ("start", pa.int32()),
     ("lost", pa.int64()), ("vectors", pa.binary())]
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks run backwards from ``given``; those with vectors of a former run are fixed up."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            found, lost = run_back(r["symbols"], r["given"], r["vectors"])
            start = found[0]
            out.append((r["key"], r["part"], r["symbols"], r["n_chunks"], r["last"], r["given"], start, lost, bytes(found)))
        yield _batch(out, _RUN)


def solve(pieces: DataFrame) -> DataFrame:
    """The chunks with their vectors, each started from its successor's up to a constant."""
    schema = f"{CHUNK_SCHEMA}, {RUN_FIELDS}"
    own = Window.partitionBy("key")  # of at most one row a partition of the input
    known = pieces.withColumn("n_chunks", F.count(F.lit(1)).over(own))
    known = known.withColumn("last", F.col("part") == F.max("part").over(own))
    first = known.withColumns({"given": F.when(F.col("last"), 0).otherwise(1), "vectors": F.lit(None).cast("binary")})
    done = stored(first.mapInArrow(_run, schema), "repair_runs")
    alone, chained = done.where("n_chunks = 1"), done.where("n_chunks > 1")
    while True:
        seen = chained.withColumn("_next", F.lead("start").over(own.orderBy("part")))
        seen = seen.withColumn("_open", ~F.col("last") & (F.col("_next") != F.col("given")))
        seen = stored(seen, "repair_fixups")
        again = seen.where("_open")
        if again.isEmpty():
            return alone.unionByName(seen.drop("_next", "_open"))
        fixed = again.withColumn("given", F.col("_next")).drop("_next", "_open").mapInArrow(_run, schema)
        chained = seen.where("NOT _open").drop("_next", "_open").unionByName(fixed)


TRACE_SCHEMA = (
    "key string, part long, n_chunks long, last boolean, start int, lost long, first_class int, last_class int, "
    "truncated long, blank long, duplicate long, illegal long, ends array<int>, audits array<string>"
)
_TRACE = pa.schema(
    [("key", pa.string()), ("part", pa.int64()), ("n_chunks", pa.int64()), ("last", pa.bool_()), ("start", pa.int32()),
     ("lost", pa.int64()), ("first_class", pa.int32()), ("last_class", pa.int32()), ("truncated", pa.int64()),
     ("blank", pa.int64()), ("duplicate", pa.int64()), ("illegal", pa.int64()),
     ("ends", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = np.zeros(16, dtype=bool)
    legal[[4 * a + b for a, b in LEGAL]] = True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            symbols = np.frombuffer(r["symbols"], dtype=np.uint8)
            roles, faults = symbols // 4, np.bincount(symbols % 4, minlength=4).tolist()
            illegal = int((~legal[4 * roles[:-1] + roles[1:]]).sum())
            states = STATES if r["n_chunks"] > 1 else [NOTHING]
            ways = [trace(r["symbols"], r["vectors"], r["given"], q, r["last"]) for q in states]
            out.append(
                (r["key"], r["part"], r["n_chunks"], r["last"], r["start"], r["lost"], int(roles[0]), int(roles[-1]),
                 *faults[1:], illegal, [q for _, q in ways], [a for a, _ in ways])
            )
        yield _batch(out, _TRACE)


def _chain(table: pa.Table) -> pa.Table:
    """The state each chunk of one conversation begins in."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    state, out = NOTHING, []
    for r in rows:
        out.append((r["key"], r["part"], state))
        state = r["ends"][state]
    columns = list(zip(*out, strict=True))
    return pa.table({"key": columns[0], "part": columns[1], "state": pa.array(columns[2], pa.int32())})


def audited(solved: DataFrame) -> DataFrame:
    """The chunks with the state they begin in and the audit that holds."""
    traced = stored(solved.mapInArrow(_trace, TRACE_SCHEMA), "repair_traces")
    alone = traced.where("n_chunks = 1").withColumn("state", F.lit(NOTHING))
    chained = traced.where("n_chunks > 1")
    states = chained.select("key", "part", "ends").groupBy("key").applyInArrow(_chain, "key string, part long, state int")
    both = alone.unionByName(chained.join(states, ["key", "part"]))
    return stored(both.withColumn("audit", F.element_at("audits", F.col("state") + 1)).drop("ends", "audits"), "repair_audits")


REPAIRED_SCHEMA = "key string, place long, turn long, role string, text string, edit string"
_REPAIRED = pa.schema(
    [("key", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
     ("edit", pa.string())]
)
BATCH_CHARS = 4_000_000


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after the head of their chunk, edited by its audit; ``place`` ascends in a chunk."""
    out: list[tuple] = []
    chars = place = at = state = 0
    audit, key = "", None

    def add(turn: int | None, role: str, text: str, edit: str) -> None:
        nonlocal place, chars
        out.append((key, place, turn, role, text, edit))
        place += 1
        chars += len(text) + 16

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = DUE[state]
            add(None, "user" if state == USER else "assistant", "", "I")
            at += 1

    for batch in batches:
        for r in batch.to_pylist():
            if r["audit"] is not None:
                audit, key, state, at = r["audit"], r["key"], r["state"], 0
                place = r["part"] << 33
                inserted()
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                state = KEPT[state][r["role_class"]]
                add(r["turn"], r["role"], r["text"], edit)
            elif edit == "R":
                state = DUE[state]
                add(r["turn"], "user" if state == USER else "assistant", r["text"], edit)
            inserted()
            if chars > BATCH_CHARS:
                yield _batch(out, _REPAIRED)
                out, chars = [], 0
    yield _batch(out, _REPAIRED)


def apply_audits(rows: DataFrame, audits: DataFrame, by: list[str]) -> DataFrame:
    """The repaired rows; partitioned by ``by`` and, in each partition, in order."""
    own = rows.select("key", "part", "id", "turn", "role", "text", "role_class")
    heads = audits.select("key", "part", F.lit(-1).cast("long").alias("id"), "state", "audit")
    both = own.unionByName(heads, allowMissingColumns=True)
    return both.repartition(*by).sortWithinPartitions("key", "part", "id").mapInArrow(_edit, REPAIRED_SCHEMA)


def prepare(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows and the audits of their chunks, both stored."""
    rows = ordered(conversations)
    return rows, audited(solve(chunks(rows)))


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, role, text, edit)``: the repaired turns; ``place`` gives their order."""
    rows, audits = prepare(conversations)
    fixed = apply_audits(rows, audits, ["key", "part"])
    return fixed.select(F.expr("try_cast(key AS long)").alias("conv_id"), "place", "turn", "role", "text", "edit")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, from its rows in order."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    key, running = None, None
    out: list[tuple] = []
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
            if k != key:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(out) > 10_000:
            yield _batch(out, schema)
            out = []
    if running is not None:
        out.append((key, running.hexdigest()))
    yield _batch(out, schema)


NO_ROWS = hashlib.sha256(b"").hexdigest()


def report(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """One row a conversation: its gaps, faults, least cost, audit, and the digest of the repaired turns.

    ``of`` gives the conversations to report on (those of the rows by default).
    """
    rows, audits = prepare(conversations)
    known, _ = vectors()
    own = Window.partitionBy("key").orderBy("part")  # of at most one row a partition of the input
    pair = F.struct(F.col("last_class").alias("a"), F.lead("first_class").over(own).alias("b"))
    legal = F.lit(False)
    for a, b in LEGAL:
        legal = legal | ((F.col("_pair.a") == a) & (F.col("_pair.b") == b))
    joint = F.when(F.col("_pair.b").isNull() | legal, 0).otherwise(1)
    start = F.element_at(F.array(*[F.lit(v[NOTHING]) for v in known]), F.col("start") + 1)
    is_first = F.row_number().over(own) == 1
    per_chunk = audits.withColumn("_pair", pair).withColumn("_open", F.when(is_first, start).otherwise(0))
    sums = per_chunk.groupBy("key").agg(
        F.sum("blank").alias("blank"),
        F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + joint).alias("illegal"),
        F.sum(F.col("lost") + F.col("_open")).alias("cost"),
        F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("_audits"),
    )
    sums = sums.withColumn("audit", F.array_join(F.transform("_audits", lambda x: x["audit"]), "")).drop("_audits")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("key").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    digests = apply_audits(rows, audits, ["key"]).mapInArrow(_digest, "key string, repaired_sha256 string")
    ids = (conversations if of is None else of).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.withColumn("key", _key(F.col("conv_id")))
    for part in (gaps, sums, digests):
        out = out.join(part, "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id",
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_ROWS)).alias("repaired_sha256"),
    )
