"""Merkle manifest of a dataset: subtree roots meet in a butterfly exchange.

A document's leaf is the hash of its five fields. Per source the leaves ascend
by id; runs of ``FANOUT`` consecutive nodes become their hash until one is left,
the subroot. The subroots in order of their sources form a tree of the same
kind, whose root stands for the dataset. Every document gets its proof: the
siblings that lead from its leaf to the root.

1. Leaves (no text travels beyond the scan) get their place by a two-level rank:
   range buckets, counts, prefix sums.
2. A tree is cut into aligned chunks of ``FANOUT ** CHUNK_LEVELS`` leaves; each
   is reduced to one root, wherever it lies.
3. Butterfly: in round ``r`` the chunks whose numbers differ only in digit ``r``
   (base ``FANOUT``) form a group and swap the roots of their subtrees. Every
   member then hashes the group itself, so the ancestor is computed redundantly
   below and each chunk gathers its upper proof on the way up; nothing is sent
   down again. The last subtree of a tree may have fewer chunks than its
   siblings: its chunks stand in for the missing ones, each for the chunks
   that have its number modulo theirs. A round moves at most two messages a chunk.
4. The chunk's upper proof precedes its leaves in one sorted stream, which is
   reduced once more and yields every leaf's proof. Subroots take the same three
   steps as the one tree above the sources.

Tasks hold one chunk; a source with most of the rows is many chunks, and sources
of a few rows share tasks.

Defined results
    Null fields count as ``-``. A null source comes first and is a source; null
    ids come first. Rows with equal ids are ordered by their leaf; equal rows are
    leaves each. A lone leaf is its source's subroot, a lone subroot the root,
    with no siblings on that way. Empty table: no rows. Other columns are
    ignored, except those named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.common import stored
from txnlens.plans.ordered import with_range_buckets

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
CHUNK_LEVELS = 3
HEX = 64  # characters of a digest
BUCKET_ROWS = 100_000
MAX_BUCKETS = 20_000  # the partitioner samples on the driver in proportion to them
PROOF = "array<struct<left: string, right: string>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 over byte count, colon and value of each field (``-`` for null)."""
    coded = []
    for c in fields:
        value = c.cast("string")
        coded.append(
            F.when(c.isNull(), F.lit("-")).otherwise(
                F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
            )
        )
    return F.sha2(F.concat(*coded), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chunk_size() -> int:
    return FANOUT**CHUNK_LEVELS


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (``tree``, ``hash``, ...) with ``pos`` in their tree, ``chunk`` and the tree's ``size``; stored."""
    n = nodes.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    # equal rows are interchangeable, the number only keeps them from one bucket
    numbered = nodes.withColumn("_row", F.monotonically_increasing_id())
    ranged = with_range_buckets(numbered, ["tree", *order, "_row"], "_bucket", buckets)
    counts = ranged.groupBy("tree", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    tree = Window.partitionBy("tree")  # of at most `buckets` rows
    before = F.sum("_c").over(tree.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "tree", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(tree).alias("size")
    )
    own = Window.partitionBy("tree", "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_row")
    pos = F.col("_before") + F.row_number().over(own) - 1
    out = ranged.join(offsets, ["tree", "_bucket"]).withColumn("pos", pos.cast("long"))
    out = out.withColumn("chunk", F.floor(F.col("pos") / chunk_size()).cast("long"))
    return stored(out.drop("_bucket", "_before", "_row"), "merkle_nodes")


def reduce_chunk(hashes: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """The joined runs of each level, and the root; without a number of levels it ends when one node is left."""
    runs, level = [], hashes
    while len(level) > 1 if levels is None else len(runs) < levels:
        joined = ["".join(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
        runs.append(joined)
        level = [_hash(x) for x in joined]
    return runs, level[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one chunk after the other, from a stream sorted by tree and chunk."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, chunk = batch.column("tree"), np.asarray(batch.column("chunk"))
        other = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
        if tree[0] != tree[len(tree) - 1]:
            names = tree.to_pylist()
            other = np.array([k for k, (a, b) in enumerate(zip(names, names[1:]), 1) if a != b or chunk[k] != chunk[k - 1]])  # noqa: B905
        for a, b in pairwise([0, *other.tolist(), batch.num_rows]):
            key = (tree[a].as_py(), int(chunk[a]))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "pos")


ROOT_SCHEMA = "tree string, chunk long, size long, hash string"
_ROOT = pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("size", pa.int64()), ("hash", pa.string())])


def chunk_roots(nodes: DataFrame) -> DataFrame:
    """One row a chunk: its root, and the number ``n`` of the tree's chunks."""
    width, levels = chunk_size(), CHUNK_LEVELS

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table in _chunks(batches):
            size = table.column("size")[0].as_py()
            _, root = reduce_chunk(table.column("hash").to_pylist(), None if size <= width else levels)
            out.append((table.column("tree")[0].as_py(), table.column("chunk")[0].as_py(), size, root))
            if len(out) >= 10_000:
                yield _rows(out, _ROOT)
                out = []
        yield _rows(out, _ROOT)

    found = _streamed(nodes.select("tree", "chunk", "pos", "size", "hash")).mapInArrow(roots, ROOT_SCHEMA)
    return found.select("tree", "chunk", F.ceil(F.col("size") / width).cast("long").alias("n"), "hash")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def exchange(chunks: DataFrame, span: int) -> DataFrame:
    """One butterfly round among subtrees of ``span`` chunks; trees that are one subtree already pass."""
    whole = lambda c, by: F.floor(c / by).cast("long")
    active = (
        chunks.where(F.col("n") > span)
        .withColumn("_t", whole(F.col("chunk"), span))
        .withColumn("_low", F.col("chunk") % span)
        .withColumn("_digit", F.col("_t") % FANOUT)
        .withColumn("_group", whole(F.col("_t"), FANOUT))
        .withColumn("_last", whole(F.col("n") - 1, span))
    )
    few = F.col("n") - F.col("_last") * span  # chunks of the last subtree
    stands_in = (F.col("_t") == F.col("_last")) & (F.col("_digit") > 0)
    lows = F.when(stands_in, F.sequence(F.col("_low"), F.lit(span - 1).cast("long"), few)).otherwise(
        F.array(F.col("_low"))
    )
    sent = active.select("tree", "_group", "_digit", "hash", F.explode(lows).alias("_low"))
    rings = sent.groupBy("tree", "_group", "_low").agg(
        F.collect_list(F.struct("_digit", "hash")).alias("_ring")  # FANOUT entries at most
    )
    met = active.join(rings, ["tree", "_group", "_low"])
    at = F.col("_digit")
    side = lambda keep: F.array_join(
        F.transform(F.sort_array(F.filter("_ring", keep)), lambda x: x["hash"]), ""
    )
    met = met.withColumn("_left", side(lambda x: x["_digit"] < at)).withColumn("_right", side(lambda x: x["_digit"] > at))
    climbed = met.select(
        "tree",
        "chunk",
        "n",
        F.sha2(F.concat("_left", "hash", "_right"), 256).alias("hash"),
        F.concat("path", F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))).alias("path"),
    )
    return climbed.unionByName(chunks.where(F.col("n") <= span))


def butterfly(roots: DataFrame) -> DataFrame:
    """``(tree, chunk, n, hash, path)``: every chunk with its tree's root and the proof that leads there."""
    chunks = stored(roots.withColumn("path", F.array().cast(PROOF)), "merkle_chunks")
    most = chunks.agg(F.max("n")).first()[0] or 0
    span = 1
    while span < most:
        chunks = stored(exchange(chunks, span), "merkle_round")
        span *= FANOUT
    return chunks


def proofs(nodes: DataFrame, uppers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every node, the columns of its chunk's upper row, and its whole proof.

    ``uppers`` has one row a chunk: ``tree``, ``chunk``, ``path`` and others.
    """
    given = [c for c in uppers.columns if c not in ("tree", "chunk", "path")]
    width, levels = chunk_size(), CHUNK_LEVELS
    heads = uppers.withColumn("pos", F.lit(-1).cast("long"))
    rows = nodes.select("tree", "chunk", "pos", "size", "hash", F.struct(*columns).alias("_node"))
    both = rows.unionByName(heads, allowMissingColumns=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            head, own = table.slice(0, 1), table.slice(1)
            if not own.num_rows:
                continue
            upper = [(x["left"], x["right"]) for x in head.column("path")[0].as_py()]
            alone = own.column("size")[0].as_py() <= width
            runs, _ = reduce_chunk(own.column("hash").to_pylist(), None if alone else levels)
            left, right = [], []
            for k in range(own.num_rows):
                at = k
                for joined in runs:
                    at, digit = divmod(at, FANOUT)
                    run = joined[at]
                    left.append(run[: HEX * digit])
                    right.append(run[HEX * (digit + 1) :])
                for a, b in upper:
                    left.append(a)
                    right.append(b)
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            ends = np.arange(own.num_rows + 1, dtype=np.int32) * (len(runs) + len(upper))
            made = own.select(["pos", "hash", "_node"])
            for c in given:
                value = head.column(c)[0]
                made = made.append_column(c, pa.array([value.as_py()] * own.num_rows, type=value.type))
            made = made.append_column("proof", pa.ListArray.from_arrays(pa.array(ends), steps))
            yield from made.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("pos", "hash", "_node", *given)) + f", proof {PROOF}"
    return _streamed(both).mapInArrow(walk, schema).select("_node.*", "pos", "hash", *given, "proof")


def _tree_name(source: Column) -> Column:
    """Sources as texts without null, in the same order (null first, bytewise)."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def manifest(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, source, carried, position, leaf, subroot, root, proof)`` of every document.

    ``proof`` holds a step a level, each with the sibling digests left and right
    of the way, joined; :func:`fold` leads from ``leaf`` to ``root``. ``carried``
    is a struct of the columns named in ``carry`` (null without any).
    """
    fields = [F.col(c) for c in FIELDS]
    extra = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    leaves = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        _tree_name(F.col("source").cast("string")).alias("tree"),
        leaf_hash(fields).alias("hash"),
        extra.alias("carried"),
    )
    nodes = placed(stored(leaves, "merkle_leaves"), ["doc_id", "hash"])
    chunks = butterfly(chunk_roots(nodes))
    subroots = chunks.where("chunk = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    tops = placed(stored(subroots, "merkle_subroots"), ["name"])
    top_chunks = butterfly(chunk_roots(tops)).select("tree", "chunk", "path", F.col("hash").alias("root"))
    above = stored(
        proofs(tops, top_chunks, ["name"]).select(
            F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("top")
        ),
        "merkle_tops",
    )
    uppers = chunks.select("tree", "chunk", "path").join(above, "tree")
    uppers = uppers.select("tree", "chunk", F.concat("path", "top").alias("path"), "subroot", "root")
    out = proofs(nodes, uppers, ["doc_id", "source", "carried"])
    return out.select(
        "doc_id", "source", "carried", F.col("pos").alias("position"), F.col("hash").alias("leaf"), "subroot", "root", "proof"
    )
