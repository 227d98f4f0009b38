"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, that reply as the only trainable text. Turns after the last reply
would be in no example; they close the conversation in one more row without a
target, so that the output holds every turn.

Template (an example starts with ``<s>``)
    user        ``[INST] text [/INST]``
    assistant   `` text</s>``
    other role  ``[ROLE role] text [/ROLE]``

Inside texts and roles the backslash escapes itself and the two characters that
begin a control string (``\\b`` for ``[``, ``\\l`` for ``<``; ``\\r`` for ``]`` in
roles), so no text can hold a control string and :func:`read_turns` inverts the
format exactly.

The rows of a conversation meet in one partition, sorted by turn, and are
formatted as a stream: a task holds one conversation's prefix and one output
batch of about ``BATCH_CHARS``. The expansion itself repeats every prefix, so
its output grows with the square of a conversation's length; that is the format.

Defined results
    null text or role: empty. Equal turn numbers are ordered by role, then
    text; repeated rows are turns each. Rows with a null ``conv_id`` form one
    conversation. Empty table: no rows. Only ``conv_id``, ``turn``, ``role`` and
    ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import small_batches

BATCH_CHARS = 4_000_000
EXAMPLE_SCHEMA = "conv_id long, example int, text string, loss_start long, loss_end long"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_examples long"
)
_ESCAPED = {"\\": "\\\\", "[": "\\b", "<": "\\l", "]": "\\r"}
_PLAIN = {v[1]: k for k, v in _ESCAPED.items()}
_TEXT_TABLE = str.maketrans({k: v for k, v in _ESCAPED.items() if k != "]"})
_ROLE_TABLE = str.maketrans(_ESCAPED)
_TURN = re.compile(
    r"\[INST\] (?P<user>[^\[<]*) \[/INST\]"
    r"|\[ROLE (?P<role>[^\[<\]]*)\] (?P<other>[^\[<]*) \[/ROLE\]"
    r"| (?P<assistant>[^\[<]*)</s>"
)
BEGIN = "<s>"


def escape(text: str) -> str:
    return text.translate(_TEXT_TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its escaped text."""
    body = escape(text)
    if role == "assistant":
        before, after = " ", "</s>"
    elif role == "user":
        before, after = "[INST] ", " [/INST]"
    else:
        before, after = f"[ROLE {role.translate(_ROLE_TABLE)}] ", " [/ROLE]"
    return before + body + after, len(before), len(before) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted example."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not a formatted example")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return turns


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_EXAMPLES = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())]
)


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of conversations whose rows arrive together and in order."""
    rows: list[tuple] = []
    chars = 0
    current: list = []  # [conv_id]; empty before the first row
    parts: list[str] = []
    length = examples = 0
    pending = False

    def close() -> None:
        """Turns after the last reply: one row without a target."""
        nonlocal chars
        if pending:
            rows.append((current[0], examples, "".join(parts), None, None))
            chars += length

    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if current != [conv]:
                close()
                current, parts, length, examples = [conv], [BEGIN], len(BEGIN), 0
            piece, a, b = format_turn(role or "", text or "")
            parts.append(piece)
            pending = role != "assistant"
            if not pending:
                parts = ["".join(parts)]
                rows.append((conv, examples, parts[0], length + a, length + b))
                examples += 1
                chars += length + len(piece)
            length += len(piece)
            if chars > BATCH_CHARS:
                yield _batch(rows, _EXAMPLES)
                rows, chars = [], 0
    close()
    yield _batch(rows, _EXAMPLES)


def format_examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, example, text, loss_start, loss_end)``; loss positions count code points."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(expand, EXAMPLE_SCHEMA)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest row per conversation, from its examples in order."""
    rows: list[tuple] = []
    current: list = []
    last = ""
    loss, loss_chars, total, examples = hashlib.sha256(), 0, 0, 0

    def close() -> None:
        if current:
            turns = read_turns(last)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            digest = hashlib.sha256(said.encode()).hexdigest()
            rows.append((current[0], len(turns), digest, loss_chars, loss.hexdigest(), total, examples))

    for batch in batches:
        for row in batch.to_pylist():
            if current != [row["conv_id"]]:
                close()
                current = [row["conv_id"]]
                loss, loss_chars, total, examples = hashlib.sha256(), 0, 0, 0
            last = row["text"]
            total += len(last)
            if row["loss_start"] is not None:
                target = unescape(last[row["loss_start"] : row["loss_end"]])
                loss.update(target.encode())
                loss_chars += len(target)
                examples += 1
        if len(rows) > 10_000:
            yield _batch(rows, _DIGEST)
            rows = []
    close()
    yield _batch(rows, _DIGEST)


def digest(examples: DataFrame) -> DataFrame:
    """What :func:`format_examples` wrote, read back (its partitions and order are kept)."""
    return examples.mapInArrow(read_back, DIGEST_SCHEMA)
