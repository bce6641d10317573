"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import chat, decontam, html_text, line_dedup, packing, quality, ranking, secrets, sharding, simhash, spelling, sql, suffix_dedup, token_codec

SHARDS = 40
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of the same mixture; counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    slim = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharding.interleave(slim, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = token_codec.new_path(spark)
    token_codec.write(_table(spark, sf_dir, "documents"), path)
    return token_codec.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 50-byte strings of earlier documents cover."""
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and components of links at two bits or fewer."""
    linked = simhash.groups(_table(spark, sf_dir, "documents"), words=3, radius=2)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit(tricky))
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.render(chat.fold(chat.events_of_messages(given.union(extra))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("turns", chat.parse(F.col("formatted")))
        .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turn_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct content scanned once."""
    findings, _ = secrets.scan(_table(spark, sf_dir, "documents"))
    return findings.select(
        "doc_id",
        *[secrets.count(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.RULES],
        F.sha2(secrets.joined(F.col("spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occurrences of 13-word benchmark windows cover."""
    found = decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), nameless=True)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind the plain rules, and the verdict of the line field, for every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), longest=SEQUENCE)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of 20 code points or more that three documents share, but for the last."""
    kept = line_dedup.drop_repeated(_table(spark, sf_dir, "documents"), least=20, documents=3)
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of seven letters or more with their most frequent near word and the root of such forms."""
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), least=7, occurrences=2, spoil=31)
    return spelling.variants(words, least=7, factor=10)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the ten documents of the highest score."""
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interleave": op1_interleave,
    "op2_token_files": op2_token_files,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_main_text": op9_main_text,
    "op10_pack": op10_pack,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling": op12_spelling,
    "op13_lexical_search": op13_lexical_search,
}

# The other queries need CRC-32, a tokenizer, XXH64, byte strings or a fitted model; tests hold them against brute force.
SQL: dict[str, str] = {
    "op5_chat": sql.OP5,
    "op6_secrets": sql.OP6,
    "op7_decontaminate": sql.OP7,
    "op11_line_dedup": sql.OP11,
    "op13_lexical_search": sql.OP13,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
