"""Operators with one right answer, against plain versions on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute
from txnlens.llm import ann, chat, decontam, minhash, packing, queries, substring, urls

DOC = "doc_id long, text string"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def awkward_documents() -> list[tuple]:
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + ["Über", "ß", "x y", "日本"]
    base = [rng.choice(vocab) for _ in range(120)]
    docs = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "One two")]
    for k in range(7, 60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        if k % 3 == 0:
            words = [rng.choice(vocab) for _ in range(rng.randint(1, 90))] + base[10:40]
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(60, "one two three"), (61, "ONE two\nthree"), (62, "a " * 3000), (63, "a " * 2999 + "b")]
    return docs


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def frame(spark, rows):
    clash = [(d, t, 1, "z", None) for d, t in rows]
    return spark.createDataFrame(clash, DOC + ", block long, component string, _keep string")


def test_substring(spark, small):
    docs, plain = small
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    with_hash = lambda df: df.withColumn("kept_sha256", F.sha2("text", 256))
    assert rows_of(with_hash(substring.remove_repeats(docs)), *cols) == sorted(brute.substring(plain), key=repr)
    odd = awkward_documents() + [(None, awkward_documents()[0][1])]
    got = rows_of(with_hash(substring.remove_repeats(frame(spark, odd))), *cols)
    assert got == sorted(brute.substring(odd), key=repr)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_prefilter_loses_nothing_when_crowded(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substring, "CELLS_PER_WINDOW", 1)
    monkeypatch.setattr(substring, "EXACT_SHARD_WINDOWS", 64)
    odd = awkward_documents()
    got = rows_of(substring.remove_repeats(frame(spark, odd)), "doc_id", "n_words", "n_removed")
    assert got == sorted((r[:3] for r in brute.substring(odd)), key=repr)


def test_near_duplicates(spark, small):
    docs, plain = small
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash.near_duplicates(docs), *cols) == sorted(brute.near_duplicates(plain), key=repr)
    query = queries.op8_minhash(spark, SF_SMALL)
    assert rows_of(query, *cols) == sorted(brute.near_duplicates(plain, 85), key=repr)
    odd = awkward_documents()
    assert rows_of(minhash.near_duplicates(frame(spark, odd)), *cols) == sorted(brute.near_duplicates(odd), key=repr)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.drop_near_duplicates(frame(spark, odd + [odd[0], (None, "x")]))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [
        d for d, _, c, k in sorted(brute.near_duplicates(odd)) if k
    ]
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == frame(spark, []).columns


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A family whose members differ by more and more words: pivots fail, tiles find the chain."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 3)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 2500)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        if k > 60:  # copies of copies
            words = docs[rng.randrange(len(docs))][1].split()
            words[rng.randrange(150)] = f"y{k}"
        docs.append((k, " ".join(words)))
    got = rows_of(minhash.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept")
    want = sorted(brute.near_duplicates(docs), key=repr)
    assert got == want and len({r[2] for r in want}) > 5


def test_family_blocks_are_bounded_by_documents(spark):
    """Short texts in one bucket: few shingles, but no tile may hold them all."""
    n = 5 * minhash.TILE_DOCUMENTS // 2
    shared = spark.range(n).selectExpr("7L AS key", "id", "CAST(1000 AS LONG) AS size")
    found = spark.createDataFrame([], "node long, component long")
    sizes = spark.range(n).selectExpr("id AS doc_id", "20L AS n_shingles")
    got = minhash._families(shared, found, sizes)
    assert {r.blocks for r in got.select("blocks").distinct().collect()} == {3} and got.count() == n


def test_tile_links_in_row_strips(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 20, 30, dtype=np.uint64)) for _ in range(30)]
    labels = [k // 2 for k in range(30)]
    want = minhash.joining_links(list(range(30)), labels, sets, 70)
    monkeypatch.setattr(minhash, "TILE_ROWS", 4)
    assert want and minhash.joining_links(list(range(30)), labels, sets, 70) == want
    common = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    assert all(100 * common(i, j) >= 70 * (len(sets[i]) + len(sets[j]) - common(i, j)) for i, j in want)


def test_intersections_in_column_chunks(monkeypatch):
    monkeypatch.setattr(minhash, "TILE_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.intersections(sets)
    assert all(got[i][j] == want[i][j] for i in range(12) for j in range(12) if i != j)


def test_components(spark):
    from txnlens.llm.graph import components

    rng = random.Random(6)
    for edges in (
        [],
        [(5, 5)],
        [(k, k + 1) for k in range(40)],  # a chain
        [(k, 1000 - k) for k in range(40)] + [(3, 7), (900, 7)],
        [(50, k) for k in range(60) if k != 50],  # a star whose middle is not least
        [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)],
    ):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(tuple(r) for r in got.collect()) == sorted((x, root(x)) for x in list(parent))


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = (minhash.signature(x, 600) == minhash.signature(y, 600)).mean()
    assert abs(same - 900 / 1100) < 0.06


def test_contamination(spark, small):
    docs, plain = small
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontam.contamination(docs, bench), *cols) == sorted(brute.contamination(plain, items), key=repr)
    odd = awkward_documents() + [(None, "W1, w2"), (5, "one")]
    text = odd[0][1]
    items = [(1, "ONE"), (1, "ONE"), (None, "w2 w3"), (7, text.upper()), (8, None), (9, "..."), (10, text[60:200])]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = rows_of(decontam.contamination(frame(spark, odd), bench), *cols)
    assert got == sorted(brute.contamination(odd, items), key=repr)
    none = decontam.contamination(frame(spark, odd), bench.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(odd)
    left = decontam.drop_contaminated(frame(spark, odd), bench)
    assert left.count() == sum(not r[5] for r in brute.contamination(odd, items))
    cut = {r.doc_id: r.text for r in decontam.remove_spans(frame(spark, odd), bench).collect()}
    assert cut[60] == "two three" and cut[3] == "" and cut[2] is None


def test_nearest(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for k in range(300)]
    rows += [(400 + k, rows[3][1]) for k in range(60)] + [(20, rows[20][1])]
    bad = [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [None] + [1.0] * 7), (580, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + bad], "vec_id long, embedding array<float>, qb string")
    got = rows_of(ann.nearest(df, F.col("vec_id") % 20 == 0, 20), "query_id", "rank", "vec_id", "score")
    want = brute.inner_products(list(dict((i, (i, v)) for i, v in rows).values()), 20, 20)
    # id 20 occurs twice: a second candidate for the others, one query
    plain = {(q, v) for q, _, v, _ in want}
    assert {(q, v) for q, _, v, _ in got if v != 20} <= plain
    once = ann.nearest(df.dropDuplicates(["vec_id"]), F.col("vec_id") % 20 == 0, 20)
    assert rows_of(once, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_nearest_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 70)
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in emb.collect()]
    got = rows_of(ann.nearest(emb, F.col("vec_id") % 20 == 0, 20), "query_id", "rank", "vec_id", "score")
    assert got == sorted(brute.inner_products(rows, 20, 20), key=repr)


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\b\\l\\\\[", None, "", "[ROLE x] a [/ROLE]", "é日\n<s>", "]\\r"]
    roles = ["user", "assistant", "system", "tool]<[", None, "assistant", "user"]
    rows = [(1, k, r, t, "e") for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
    rows += [(2, 0, "assistant", "a" * 50_000, "e"), (None, 1, "user", "x", "e"), (3, 1, "user", "b", "e"), (3, 1, "user", "b", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_examples(df).collect()
    last = {r.conv_id: r.text for r in examples}
    assert chat.read_turns(last[1]) == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    targets = [(r.conv_id, chat.unescape(r.text[r.loss_start : r.loss_end])) for r in examples if r.loss_start is not None]
    assert sorted(targets) == [(1, texts[1]), (1, texts[5]), (2, "a" * 50_000)]
    for r in examples:
        assert r.loss_start is None or r.text[r.loss_end :] == "</s>"
    digest = {r.conv_id: r for r in chat.digest(chat.format_examples(df)).collect()}
    assert digest[3].n_turns == 2 and digest[3].loss_chars == 0 and digest[None].n_turns == 1
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(roles, texts, strict=True))
    assert digest[1].turns_sha256 == brute.sha(said) and digest[1].loss_sha256 == brute.sha(texts[1] + texts[5])
    assert chat.digest(chat.format_examples(df.limit(0))).count() == 0


def test_url_filter(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://A.example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "http://x.com/?a=/en/": ("x.com", "/", "com/", "allow"),
        "http://b.www.example.com/en/#z": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://n.net/es/1://": ("n.net", "/es/1://", "net/es/", "block"), "http://internet/es/": ("internet", "/es/", None, "allow"),
        "http://bad.org/x/": ("bad.org", "/x/", None, "block"), "https://www.bad.org/x?q": ("www.bad.org", "/x", None, "block"),
    }
    rows = [(k, u, "c") for k, u in enumerate(cases)] + [(3, list(cases)[3], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, block string")
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    listed = spark.createDataFrame([("bad.org/x",)], "canonical string")
    got = rows_of(urls.judge(pages, rules, listed), "url", "host", "path", "rule", "verdict")
    want = [(u, *cases[u]) for _, u, _ in rows]
    assert got == sorted(want, key=repr)
    empty = urls.judge(pages, rules.limit(0), listed.limit(0))
    assert empty.count() == len(rows) and empty.where("verdict <> 'allow'").count() == 0


def test_packing(spark, small):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    odd = [(900, None), (901, ""), (902, " a  b\n c"), (903, "x <|endoftext|> y"), (904, "a b c  d"), (905, " it's 'll 12ab!?")]
    plain = [*small[1], *odd, (904, odd[4][1]), (None, "z")]
    df = frame(spark, plain)
    got = packing.pack_documents(df, path).collect()
    want = []
    for d, t in plain:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_best_two_fit_keeps_every_length():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(n for b in bins for n in b) == sorted(lengths) and max(map(sum, bins)) <= 100
    assert len(bins) <= 1.02 * sum(lengths) / 100 + 2


def test_token_ids_equal_the_tokenizer_file(tmp_path, small):
    import json

    path = queries.tokenizer_path()
    coder = packing.TextTokenizer(path)
    assert coder.fast is not None
    rng = random.Random(4)
    letters = "abcdefghij'ABC 12 .,!?\n\t\r éüß日本  ̀😀"
    texts = [t or "" for _, t in small[1]] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 50_000, " " * 5000 + "x", "x<|endoftext|>y", "\n" * 999]
    assert [t for t in texts if coder.encode(t) != coder.whole(t)] == []
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]  # ids no longer follow the merges
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert packing.merge_ranks(str(other)) is None and packing.TextTokenizer(str(other)).fast is None


def test_substring_of_short_texts_alone_and_of_a_hot_id(spark, monkeypatch):
    short = [(k, "few words here") for k in range(5)] + [(9, None)]
    got = rows_of(substring.remove_repeats(frame(spark, short)), "doc_id", "n_words", "n_removed")
    assert got == sorted((r[:3] for r in brute.substring(short)), key=repr)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 4000)
    base = " ".join(f"w{k}" for k in range(40))
    hot = [(7, f"{base} x{k}") for k in range(150)] + [(k, f"a{k} {base}") for k in range(8, 160)] + [(3, base)]
    blocks = substring.deal(frame(spark, hot), 20)
    assert max(r["count"] for r in blocks.groupBy("block").count().collect()) < 4 * len(hot) / 20
    got = rows_of(substring.remove_repeats(frame(spark, hot)), "doc_id", "n_words", "n_removed")
    assert got == sorted((r[:3] for r in brute.substring(hot)), key=repr)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("substring_")]


def test_near_duplicate_stage_keeps_unlinked_texts_of_one_id(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    shared = text()
    rows = [(1, text()), (1, text()), (2, shared), (1, shared + " end"), (3, text()), (3, text()), (3, None), (4, "")]
    rows += [(5, text()) for _ in range(20)] + [(6, shared), (6, shared), (None, shared)]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, _own string, keep_id int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    links = {shared, shared + " end"}
    alone = sorted({r for r in rows if r[0] is not None and r[1] not in links}, key=repr)
    assert sorted((r for r in left if r[0] is not None and r[1] not in links), key=repr) == alone
    assert sum(r[0] is not None and r[1] in links for r in left) == 1 and (None, shared) in left


def test_contamination_is_equal_on_both_sides_of_the_broadcast_limit(spark, small, monkeypatch):
    docs, _ = small
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    odd = [(d, t) for d, t in awkward_documents()] + [(None, "x"), (5, None)]
    words = " ".join(awkward_documents()[0][1].split()[:40])
    for table, items in ((docs, bench), (frame(spark, odd + odd[:2]), spark.createDataFrame([("a", words), ("b", words), (None, "one")], "item_id string, text string"))):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 500_000)
        near = rows_of(decontam.contamination(table, items), *CONTAMINATION)
        cut = rows_of(decontam.remove_spans(table, items), "doc_id", "text")
        monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
        assert rows_of(decontam.contamination(table, items), *CONTAMINATION) == near
        assert rows_of(decontam.remove_spans(table, items), "doc_id", "text") == cut


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_nearest_when_bounds_overflow(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=4) * 1e200).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert len(got) == 3 * 5 and {r.query_id for r in got} == {0, 20, 40}


def test_url_filter_on_both_sides_of_its_limits(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    cols = ("page_id", "host", "path", "rule", "verdict", "listed")
    listed = urls.listed_share(pages, "1").unionByName(urls.listed_share(pages, "8")).unionByName(urls.listed_share(pages, "c"))
    near = rows_of(urls.judge(pages, rules, listed), *cols)
    assert {r[4] for r in near} == {"allow", "block"} and 0 < sum(r[5] for r in near) < len(near) / 2
    monkeypatch.setattr(urls, "MAX_BLOCKS", 0)
    monkeypatch.setattr(urls, "MAX_BROADCAST_KEYS", 0)
    assert rows_of(urls.judge(pages, rules, listed), *cols) == near


def test_exact_join_removes_the_false_positives(spark, monkeypatch):
    """A crowded filter lets unlisted addresses through; none of them is blocked."""
    monkeypatch.setattr(urls, "KEYS_PER_BLOCK", 200)
    listed = spark.range(2000).select(F.concat(F.lit("bad.org/"), "id").alias("canonical"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://bad.org/"), "id").alias("url"))
    entries = urls.listed_entries(listed)
    filter_rows, blocks = urls.bloom(entries, entries.count())
    keyed = pages.select(F.concat(F.lit("=bad.org/"), "page_id").alias("key"))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    passed = urls.possible(keyed, filter_rows, blocks).count()
    assert 2000 < passed < 6000
    rules = spark.createDataFrame([], "rule string, verdict string")
    got = urls.judge(pages, rules, listed).where("verdict = 'block'")
    assert sorted(r.page_id for r in got.collect()) == list(range(2000))
