"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import ann, chat, decontam, html, lines, merkle, minhash, packing, repair, secrets, substring, toxicity, urls
from txnlens.llm.common import ascii_lower, table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows that also start in an earlier document, removed from all documents."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: (rule, verdict)
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules, then the list of addresses, over every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(pages, rules, urls.listed_share(pages)).drop("url")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


CHAT_PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", CHAT_PROBE), (-1, 1, "assistant", CHAT_PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.digest(chat.format_examples(rows.unionByName(probe)))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern spans and the field's added spans of all documents."""
    documents = table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.fit(documents))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=32, rows=6)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word benchmark windows found in every document."""
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of held-out ids are not used."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.PREDICT_AT, 1).otherwise(0).alias("predicted"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that an earlier document holds, dropped from all documents."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def merkle_check(documents: DataFrame) -> DataFrame:
    """Every document's proof, folded from its leaf or, for a fifth of the ids, from a lower-cased text's leaf."""
    lowered = [ascii_lower(F.col("text")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    made = merkle.manifest(documents.withColumn("altered", F.when(tampered, merkle.leaf_hash(lowered))), ["altered"])
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("carried.altered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and what folding tampered documents shows."""
    return merkle_check(table(spark, sf_dir, "documents"))


def repair_check(conversations: DataFrame) -> DataFrame:
    """What repairing the damaged conversations takes, for every original conversation."""
    return repair.report(repair.damage(conversations), conversations)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_check(table(spark, sf_dir, "conversations"))


def llm_queries() -> dict:
    return {
        "op1_substring": op1_substring,
        "op2_url_filter": op2_url_filter,
        "op3_nearest": op3_nearest,
        "op4_chat_format": op4_chat_format,
        "op5_main_text": op5_main_text,
        "op6_packing": op6_packing,
        "op7_secrets": op7_secrets,
        "op8_minhash": op8_minhash,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
        "op11_line_dedup": op11_line_dedup,
        "op12_merkle": op12_merkle,
        "op13_conversation_repair": op13_conversation_repair,
    }
