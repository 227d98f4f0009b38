"""Near duplicates by circulant MinHash.

A document's set is its distinct word shingles, hashed to 64 bits. Two
permutations make all signature coordinates: ``sigma`` scatters a shingle into a
universe of 2**32 places, ``pi`` permutes that universe, and coordinate ``k`` is
the least ``pi(sigma(x) + k mod 2**32)``, the one permutation shifted
circularly. Coordinates are banded; documents that agree in a band share a bucket.

Texts with equal word sequences are one class and enter once. With the default
36 bands of 5 rows a pair at similarity 0.80 misses all buckets with probability
6e-7 (32 bands of 6 rows at 0.85: 3e-7), less at any higher similarity.

Buckets become components in two steps, and no step writes out the pairs of a
large bucket:

1. Members of buckets of up to ``SMALL_BUCKET`` are compared pair by pair (each
   pair once, however many buckets it shares); members of larger buckets are
   compared with one pivot, the member that shares most buckets. Pairs are
   verified on the full shingle sets; linked documents become components.
2. Larger buckets that still hold several components are joined into families
   (sets of documents connected by such buckets). A family is dealt into blocks
   of about ``TILE_SHINGLES`` shingles or ``TILE_DOCUMENTS`` documents, whichever
   is less; each pair of blocks is one tile, which
   intersects all its full sets at once (a matrix product over the shingles
   that occur twice) and returns only the links that join components. So the
   result is linear in the documents, while every pair of different
   components is verified.

Defined results
    null, empty and white-space texts: empty set, linked with nothing. Texts
    with fewer words than a shingle: the whole sequence is the one shingle.
    Rows of one id are one document: the largest set size and the smallest
    component of its rows. Null ids are left out (they cannot name a component). Empty table: no rows. Only
    ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import small_batches, stored
from txnlens.llm.graph import components
from txnlens.llm.words import WordHasher, mix, shared_hasher, split_words, window_hashes
from txnlens.plans.small import join_small

SHINGLE = 5
BANDS = 36
ROWS = 5
SIMILARITY_PERCENT = 80
SMALL_BUCKET = 16
TILE_SHINGLES = 200_000
#: and documents: a tile holds a matrix of its documents by its documents
TILE_DOCUMENTS = 500
#: rows of that matrix that are made and looked through at a time
TILE_ROWS = 512
TILE_COLUMNS = 4096
#: shingles hashed at a time: keeps the (shingles x coordinates) block in cache
BLOCK = 1024
MAX_BROADCAST_IDS = 2_000_000

_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_hi", pa.int64()), ("class_lo", pa.int64()),
     ("bands", pa.list_(pa.int64()))]
)
SKETCH_SCHEMA = "doc_id long, n_shingles long, class_hi long, class_lo long, bands array<long>"


def shingle_set(words: list[bytes], hasher: WordHasher, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(hasher(words), min(shingle, len(words))))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of the circulant MinHash of a non-empty set."""
    sigma = (mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(sigma), BLOCK):
        x = sigma[a : a + BLOCK, None] + shifts
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key ^ parts[:, r])
    return key


def sketches(documents: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, text class and band keys of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shared_hasher()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split_words(text, lower=True)
                found = shingle_set(words, hasher, shingle)
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                keys = band_keys(signature(found, bands * rows), bands, rows) if len(found) else found
                row = (doc, len(found), *np.frombuffer(digest, dtype="<i8").tolist(), keys.astype(np.int64))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(out, _SKETCH, strict=True)], schema=_SKETCH
            )

    return documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(sketch, SKETCH_SCHEMA)


def pick(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the given ids: filtered in the scan while the id list is small (8 bytes a row, counted)."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    ids = stored(ids, "ids")
    return join_small(docs, ids, docs["doc_id"] == ids["id"], "left_semi", max_rows=MAX_BROADCAST_IDS, check=True)


def verify(pairs: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity; only the texts of a and b move."""
    text_a = pick(documents, pairs.select(F.col("a").alias("id")).distinct())
    text_b = pick(documents, pairs.select(F.col("b").alias("id")).distinct())
    right = pairs.join(text_b, pairs["b"] == text_b["doc_id"]).select("a", "b", F.col("text").alias("text_b"))
    both = right.join(text_a, right["a"] == text_a["doc_id"]).select("a", "b", F.col("text").alias("text_a"), "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shared_hasher()
        last, last_set = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept: list[tuple[int, int]] = []
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            for k, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
                if a != last:  # the join leaves the rows of one pivot together
                    last, last_set = a, shingle_set(split_words(text_a[k].as_py(), lower=True), hasher, shingle)
                other = shingle_set(split_words(text_b[k].as_py(), lower=True), hasher, shingle)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * common >= percent * (len(last_set) + len(other) - common):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64())], names=["a", "b"]
            )

    return both.mapInArrow(check, "a long, b long")


def _shared_buckets(sketch: DataFrame) -> DataFrame:
    """``(key, id, size, weight)``: members of buckets that hold two classes or more."""
    members = sketch.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    counts = stored(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket_sizes")
    shared = stored(members.join(counts, "key"), "buckets")
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    return stored(shared.join(stored(weights, "weights"), "id"), "members")


def _first_pairs(shared: DataFrame) -> DataFrame:
    """All pairs of small buckets, and each larger bucket's members with its pivot; every pair once."""
    small = shared.where(F.col("size") <= SMALL_BUCKET).select("key", "id")
    other = small.select(F.col("key").alias("same"), F.col("id").alias("other"))
    pairs = small.join(other, (F.col("key") == F.col("same")) & (F.col("id") < F.col("other")))
    pairs = pairs.select(F.col("id").alias("a"), F.col("other").alias("b"))
    large = shared.where(F.col("size") > SMALL_BUCKET)
    best = F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("best")
    pivots = large.groupBy("key").agg(best).select(F.col("key").alias("same"), (-F.col("best.minus")).alias("pivot"))
    stars = large.join(stored(pivots, "pivots"), F.col("key") == F.col("same")).where(F.col("id") != F.col("pivot"))
    # the pivot is the left side: its set is made once for all its members
    stars = stars.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    every = pairs.unionByName(stars).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return every.agg(F.max("a").alias("a")).select(
        "a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")
    )


def _families(shared: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(id, component, family, blocks)`` of the members of larger buckets that still hold several components."""
    large = shared.where(F.col("size") > SMALL_BUCKET).select("key", "id")
    now = large.join(found, F.col("id") == F.col("node"), "left")
    now = stored(now.select("key", "id", F.coalesce("component", "id").alias("component")), "labelled")
    spread = now.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("first_id")
    )
    spread = stored(spread.where("lo <> hi").select(F.col("key").alias("open"), "first_id"), "open")
    unresolved = stored(now.join(spread, F.col("key") == F.col("open")).select("id", "component", "first_id"), "unresolved")
    stars = unresolved.where("id <> first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b")).distinct()
    family = stored(components(stars), "families").select("node", F.col("component").alias("family"))
    members = unresolved.select("id", "component").distinct().join(family, F.col("id") == F.col("node"))
    members = stored(members.join(sizes, F.col("id") == F.col("doc_id")).select("id", "component", "family", "n_shingles"), "members")
    blocks = members.groupBy("family").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_DOCUMENTS)).cast("int").alias("blocks")
    )
    blocks = stored(blocks.withColumnRenamed("family", "of"), "blocks")
    return members.join(blocks, F.col("family") == F.col("of")).select("id", "component", "family", "blocks")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    sizes = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one document is in no intersection
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + TILE_COLUMNS]))
        block = np.zeros((len(sets), TILE_COLUMNS), dtype=np.float32)
        block[row[part], column[part] - a] = 1
        for b in range(0, len(sets), TILE_ROWS):
            common[b : b + TILE_ROWS] += block[b : b + TILE_ROWS] @ block.T
    return common


def joining_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components; of those that join the same components, one."""
    common = intersections(sets)
    size = np.array([len(x) for x in sets], dtype=np.float32)
    label = np.array(labels)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    for at in range(0, len(ids), TILE_ROWS):
        rows, part = slice(at, at + TILE_ROWS), common[at : at + TILE_ROWS]
        linked = 100 * part >= percent * (size[rows, None] + size[None, :] - part)
        linked &= label[rows, None] != label[None, :]
        for i, j in zip(*np.nonzero(np.triu(linked, at)), strict=True):
            i += at
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _tile_links(families: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components, from all pairs of blocks of every family."""
    named = families.join(texts, F.col("id") == F.col("doc_id")).select("id", "component", "family", "blocks", "text")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    named = named.withColumn("own", own)
    named = named.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    named = named.select(
        "id", "component", "family", "text", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")
    )

    def tile(table: pa.Table) -> pa.Table:
        hasher = shared_hasher()
        sets = [shingle_set(split_words(t, lower=True), hasher, shingle) for t in table.column("text").to_pylist()]
        found = joining_links(table.column("id").to_pylist(), table.column("component").to_pylist(), sets, percent)
        return pa.table(
            {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}
        )

    return named.groupBy("family", "i", "j").applyInArrow(tile, "a long, b long")


def near_duplicates(
    documents: DataFrame,
    shingle: int = SHINGLE,
    percent: int = SIMILARITY_PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document id."""
    small_batches(documents.sparkSession)
    sketch = stored(sketches(documents, shingle, bands, rows), "sketches")
    classes = stored(
        sketch.where("n_shingles > 0").groupBy("class_hi", "class_lo").agg(F.min("doc_id").alias("first_id")), "classes"
    )
    first = sketch.join(classes.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi")
    shared = _shared_buckets(first)
    texts = stored(pick(documents, shared.select("id").distinct()), "texts")
    pairs = stored(_first_pairs(shared), "pairs")
    links = stored(verify(pairs, texts, shingle, percent), "links")
    found = stored(components(links), "components")
    families = stored(_families(shared, found, first.select("doc_id", "n_shingles")), "families")
    more = stored(_tile_links(families, texts, shingle, percent), "links")
    # a component stands for its documents: only its links to others are new edges
    found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    result = sketch.join(classes, ["class_hi", "class_lo"], "left")
    result = result.join(found, F.coalesce("first_id", "doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "first_id", "doc_id")
    result = result.where("n_shingles > 0").select("doc_id", "n_shingles", component.alias("component_id")).unionByName(
        sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    result = result.groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def own_ids(documents: DataFrame, name: str) -> DataFrame:
    """The documents with their own id as ``name``: a hash of id and text where rows of one id differ in their texts."""
    key = F.xxhash64("text")
    ids = documents.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    clashing = stored(ids.where("lo <> hi").select(F.col("doc_id").alias(f"{name}_clash")), "clashing")
    if clashing.isEmpty():  # ids are unique: nothing to tell apart
        return documents.withColumn(name, documents["doc_id"].cast("long"))
    clash = clashing[f"{name}_clash"]
    joined = join_small(documents, clashing, documents["doc_id"] == clash, "left", check=True)
    own = F.when(clash.isNull(), documents["doc_id"].cast("long")).otherwise(F.xxhash64(documents["doc_id"], documents["text"]))
    return joined.withColumn(name, own).drop(clash)


def drop_near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """The documents (all columns), one of each group; rows with a null id stay.

    Rows of one id and text are one document; rows of one id with different texts
    are documents each, so no text goes that has no near duplicate.
    """
    own = "_own"
    while any(c.startswith(own) for c in documents.columns):
        own += "_"
    named = own_ids(documents.where("doc_id IS NOT NULL"), own)
    seen = near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), **how)
    keep = stored(seen.where("kept").select(F.col("doc_id").alias("keep_id")), "kept")
    kept = named.join(keep, named[own] == keep["keep_id"], "left_semi").dropDuplicates([own]).drop(own)
    return kept.unionByName(documents.where("doc_id IS NULL"))
