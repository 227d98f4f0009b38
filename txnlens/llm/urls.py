"""URL filter: a blocked Bloom filter in front of an exact hash join.

Two lists are looked up at once: rules ``host/path`` (a rule fits its host, all
subdomains, and every path that starts with its path; the longest rule decides)
and canonical URLs to block where no rule fits. Both become string keys. Every
URL asks for its own canonical key and for one key per (host suffix, path
prefix) whose label count and length occur among the rules.

The filter holds 512-bit blocks, eight bits per key, one bit in each 64-bit
word. It is built by a grouped ``bit_or`` (pre-aggregated map-side) and grows with
the lists, so its false-positive rate does not. Up to ``MAX_BLOCKS`` rows of 72
bytes are broadcast; a larger filter stays dealt by block, and the keys go to it
by an ordinary join. Keys that pass go to the exact join,
whose list side is broadcast only up to ``MAX_BROADCAST_KEYS`` rows and 64 MB.

Defined results
    null URL or no ``://``: empty host and path, no rule, not listed, allowed.
    Repeated rows each get their result; ties between equally long rules go to
    the greater string. Empty lists: everything is allowed. Only ``page_id`` and
    ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import LOWER, UPPER, stored
from txnlens.plans.small import join_small

KEYS_PER_BLOCK = 32  # 16 bits a key
MAX_BLOCKS = 1 << 18  # of a filter that is broadcast, 18 MB
MAX_BROADCAST_KEYS = 200_000
WORDS = 8


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling per address: no ``www.``, no trailing slashes (scheme, query and fragment are gone)."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_entries(rules: DataFrame) -> DataFrame:
    """``(rule, verdict)`` as list entries; the rule text before its first ``/`` is the host."""
    return rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict")).select(
        F.concat(F.lit("^"), "rule").alias("key"), "rule", "verdict"
    )


def listed_entries(listed: DataFrame) -> DataFrame:
    """``(canonical)`` URLs as list entries."""
    return listed.where(F.col("canonical").isNotNull()).select(
        F.concat(F.lit("="), "canonical").alias("key"),
        F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("verdict"),
    ).distinct()


def _bits(key: Column) -> list[Column]:
    """The key's bit in each word of its block."""
    h = F.xxhash64(key, F.lit(1))
    place = [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def bloom(entries: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows ``(block, w0 .. w7)`` and its number of blocks."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    keyed = entries.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"),
        *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("key")))],
    )
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def possible(keyed: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` may be listed, and markers (keys that begin with ``-``)."""
    filter_rows = F.broadcast(filter_rows) if blocks <= MAX_BLOCKS else filter_rows
    probed = keyed.join(filter_rows, "block", "left")
    may = F.lit(True)
    for k, b in enumerate(_bits(F.col("key"))):
        may = may & (F.col(f"w{k}").bitwiseAND(b) != 0)
    is_marker = F.col("key").startswith("-")
    return probed.where(is_marker | F.coalesce(may, F.lit(False)))


def _suffixes(host: Column, counts: list[int]) -> Column:
    """Host suffixes that have one of the rules' label counts."""
    labels = F.split(host, r"\.")
    ends = [F.when(F.size(labels) >= n, F.substring_index(host, ".", -n)) for n in counts]
    return F.array_compact(F.array(*ends)) if ends else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, listed)`` for every page row.

    ``rules``: ``(rule, verdict)``; ``listed``: ``(canonical)``.
    """
    by_rule = rule_entries(rules)
    shapes = by_rule.select(
        F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
        (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("chars"),
    )
    labels, chars = shapes.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("chars"))).first()
    entries = stored(by_rule.unionByName(listed_entries(listed)), "url_keys")
    filter_rows, blocks = bloom(entries, entries.count())

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    prefixes = F.array_compact(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars])
    ) if chars else F.array().cast("array<string>")
    rows = rows.select(
        "page_id",
        "url",
        F.concat(F.lit("="), canonical(F.col("host"), F.col("path"))).alias("own"),
        _suffixes(F.col("host"), labels).alias("suffixes"),
        prefixes.alias("prefixes"),
    )
    asked = F.flatten(
        F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: F.concat(F.lit("^"), s, p)))
    )
    # the marker row keeps every page and counts repeated rows
    marker = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("url", F.lit("")))
    keyed = rows.select("page_id", "url", F.explode(F.concat(F.array(marker, "own"), asked)).alias("key"))
    keyed = keyed.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    passed = possible(keyed, filter_rows, blocks).select("page_id", "url", "key")
    entries = entries.withColumnRenamed("key", "entry")
    exact = join_small(passed, entries, F.col("key") == F.col("entry"), "left", max_rows=MAX_BROADCAST_KEYS, check=True)
    found = exact.groupBy("page_id", "url").agg(
        F.sum(F.when(F.col("key").startswith("-"), 1).otherwise(0)).alias("copies"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule", "verdict"))).alias("best"),
        F.coalesce(F.max(F.col("key").startswith("=") & F.col("entry").isNotNull()), F.lit(False)).alias("listed"),
    )
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return found.select(
        "page_id",
        "url",
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


#: the query's list holds the addresses whose SHA-256 begins with this digit, one in sixteen
LISTED_DIGIT = "0"


def listed_share(pages: DataFrame, digit: str = LISTED_DIGIT) -> DataFrame:
    """A list of canonical URLs to judge by: a share of the addresses of the pages, chosen by their hash.

    It stands for a block list from outside; :func:`judge` takes any.
    """
    address = canonical(host_of(F.col("url")), path_of(F.col("url")))
    rows = pages.select(address.alias("canonical")).distinct()
    return rows.where((F.col("canonical") != "") & F.sha2("canonical", 256).startswith(digit))
