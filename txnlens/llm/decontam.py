"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised n-grams form a hash set that is broadcast (its rows
and bytes are counted; beyond the limits only hashes and places are shuffled).
Every document is tokenised in the scan, each window is hashed and looked up
in the set, and a hit counts only after the words themselves were compared.

Defined results
    null or empty text: no words, no hits. Null ``item_id``: an item whose id is
    the empty string. Repeated items or documents: items are a set of ids; every
    document row gets its own result row. Empty benchmark: nothing is hit.
    Only ``doc_id``/``text`` and ``item_id``/``text`` are read; other columns of
    any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import ascii_lower, stored
from txnlens.plans.small import fits, join_small

#: ASCII characters that are neither digits nor lower-case letters (after lower-casing)
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
MAX_BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.array_remove(parts, "")


def window_hash(words: Column, start: Column, length: int) -> Column:
    """64-bit hash of ``length`` words from ``start`` (from 1); equals ``xxhash64`` of the slice."""
    return F.xxhash64(*[F.get(words, start + (k - 1)) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(len, hash, gram, window_id)`` and ``(window_id, item)``, both stored.

    An item shorter than a window is one window. A window's items stay rows, so one
    that very many items share is no long array that every hit carries.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.explode(F.array(words_of(F.col("text")))).alias("w"),
    ).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    grams = items.select("item", "w", "len", starts.alias("i")).select(
        "item", "len", F.expr("slice(w, i, len)").alias("gram")
    )
    grams = stored(grams.distinct(), "grams")
    windows = grams.select("len", "gram").distinct().select("*", F.xxhash64("gram").alias("hash"))
    windows = stored(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    held = grams.join(windows.select("len", "gram", "window_id"), ["len", "gram"]).select("window_id", "item")
    return windows, stored(held, "window_items")


def doc_key() -> list[Column]:
    """Identifies a document's text also where ids are repeated or null."""
    return [F.col("doc_id"), F.xxhash64(F.col("text")).alias("text_key")]


def find_hits(documents: DataFrame, grams: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verified occurrences ``(doc_id, text_key, start, len, window_id)`` of the windows ``grams``; start from 1.

    Up to ``MAX_BROADCAST_WINDOWS`` windows are broadcast (rows and bytes are
    counted) and compared in the scan. Beyond, only hashes and places are
    shuffled to them, and the words of the documents that hold a hash come in
    one join afterwards.
    """
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most ``window`` values
    base = documents.select(*doc_key(), F.explode(F.array(words_of(F.col("text")))).alias("w"))
    # compiled from the scan to the probe: no lambda, no array of hashes, one row per window
    lengths = lengths or [window]
    rows = base.select("doc_id", "text_key", "w", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
    rows = rows.where(F.size("w") >= F.col("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("start"))
    h = F.lit(None).cast("long")
    for n in lengths:
        h = F.when(F.col("n") == n, window_hash(F.col("w"), F.col("start"), n)).otherwise(h)
    rows = rows.withColumn("h", h)
    same = F.expr("n = len AND slice(w, start, len) = gram")
    out = ["doc_id", "text_key", "start", "len", "window_id"]
    if fits(grams, MAX_BROADCAST_WINDOWS):
        return rows.join(F.broadcast(grams), F.col("h") == F.col("hash")).where(same).select(*out)
    listed = grams.select(F.col("hash").alias("h")).distinct()
    near = rows.select("doc_id", "text_key", "n", "start", "h").join(listed, "h", "left_semi").distinct()
    near = stored(near.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n", "start", "h"), "near")
    # one row a text, however often it repeats: the copies' places are the same
    texts = base.join(near.select("d", "k").distinct(), F.expr("doc_id <=> d AND text_key = k"), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_key"])
    probed = texts.join(near, F.expr("doc_id <=> d AND text_key = k"))
    return probed.join(grams, F.col("h") == F.col("hash")).where(same).select(*out)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """One row per document row: words, hit words, items, and whether one word in ``one_in`` or more is hit."""
    grams, held = benchmark_windows(benchmark, window)
    hits = stored(find_hits(documents, grams, window), "hits")
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))))
    per_doc = hits.groupBy("doc_id", "text_key").agg(F.size(covered).alias("hit"))
    found = join_small(hits.select("doc_id", "text_key", "window_id").distinct(), held, "window_id", check=True)
    items = found.select("doc_id", "text_key", "item").distinct().groupBy("doc_id", "text_key")
    items = items.agg(F.array_sort(F.collect_list("item")).alias("item_list")).alias("i")
    per_doc = per_doc.alias("p").join(items, F.expr("p.doc_id <=> i.doc_id AND p.text_key = i.text_key"))
    per_doc = per_doc.select("p.doc_id", "p.text_key", "hit", "item_list")
    docs = documents.select(*doc_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words")).alias("d")
    per_doc = per_doc.alias("h")
    joined = docs.join(
        per_doc, F.expr("d.doc_id <=> h.doc_id AND d.text_key <=> h.text_key"), "left"
    ).select("d.doc_id", "d.text_key", "n_words", "hit", "item_list")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("item_list"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) that the contamination rule leaves."""
    bad = contamination(documents, benchmark, window).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")
    )
    bad = stored(bad.distinct(), "contaminated")  # two numbers a document: broadcast while the list is small
    on = documents["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents["text"]) == bad["_bad_key"])
    return join_small(documents, bad, on, "left_anti", check=True)


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text)`` with hit words cut; the words left are lower-cased and joined by one space."""
    hits = find_hits(documents, benchmark_windows(benchmark, window)[0], window)
    cut = hits.groupBy("doc_id", "text_key").agg(
        F.array_distinct(
            F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
        ).alias("cut")
    )
    docs = documents.select(*doc_key(), "text", F.explode(F.array(words_of(F.col("text")))).alias("w")).alias("d")
    cut = cut.alias("c")
    joined = docs.join(cut, F.expr("d.doc_id <=> c.doc_id AND d.text_key <=> c.text_key"), "left")
    kept = F.expr("filter(w, (x, i) -> NOT array_contains(cut, i + 1))")
    return joined.select(
        "d.doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text")
    )
