"""The registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hunkwise.llm import ann, chat, decontaminate, middle, mixing, neardup, phrases, pii, quality, secrets, shards, tokens, urls
from hunkwise.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 100."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def digest(joined: Column) -> Column:
    return F.sha2(joined.cast("binary"), 256)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        digest(F.array_join("item_ids", ",")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))[0]


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.span_text(F.col("base"), pii.kind_name)

    def number(place: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == place)).cast("long")

    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, digest(base).alias("base_sha256"),
                        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(pii.span_text(F.col("terms"), lambda s: F.lit("term")), F.lit(""))).alias("spans"))


#: The public unigram pieces and scores that the registered query counts with.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.load(vocabulary)).select("doc_id", "n_tokens")


#: The conversation that the query adds: each turn says the template's own control strings.
TRAP = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    found = chat.format_conversations(rows.unionByName(added))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: chat.unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list out of the pages' own hosts: about a third of the hosts, and of their parents, are added to a category and
    removed again, two changes each, at days that a digest of the name gives."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    names = hosts.select(F.explode(F.slice(urls.suffixes(F.col("host")), 1, 2)).alias("entry")).distinct()
    number = F.conv(F.substring(F.md5("entry"), 1, 4), 16, 10).cast("int")
    listed = names.withColumn("number", number).where(F.col("number") % 3 == 0)
    category = F.element_at(F.array(*map(F.lit, ("ads", "gambling", "malware"))), (F.expr("number div 3") % 3 + 1).cast("int"))
    changes = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return (listed.withColumn("category", category).withColumn("k", changes)
            .select("entry", "category", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("number") * 7 + F.col("k") * 97) % 366).alias("changed"),
                    F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    found = urls.judge(captures, url_list(pages), "page_id")
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", F.array_join("categories", ",").alias("categories"), F.array_join("entries", ",").alias("entries"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                        digest(middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), stored=True)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_minhash_dedup, op3_nearest, op4_decontaminate, op5_secrets, op6_personal_data, op7_token_counts,
                                   op8_chat, op9_quality, op10_url_filter, op11_fill_in_middle, op12_phrases, op13_shards, pipeline)}
