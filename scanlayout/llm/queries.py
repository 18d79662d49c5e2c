"""The queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, exact_dedup, language_id, lm_scoring, near_dedup, ngram_join, packing, periodic_runs, sharding, substring_dedup, token_counts
from .common import held_out, saved, shared_dir

#: A text that tries to end its turn and to open another.
HOSTILE = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_texts(_read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"), sharding.tree_of(8), sharding.tree_of(9))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents with an estimate, revises it by the true count, adds a public BPE as a second tokenizer, deletes toxic documents, and replays all batches."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    counts = docs.select("doc_id", "source", "lang", F.coalesce(F.expr("n_chars div 6"), F.lit(0)).alias("guess"), token_counts.words_1(F.col("text")).alias("words_1"), "text")
    counts = saved(token_counts.bpe_tokens(counts, tokenizer_path()))
    toxic = counts.join(labels.where("toxic = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")

    def changes(rows: DataFrame, op: str, version: str, tokens: str, old: str | None = None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    batches = {
        "load": changes(counts, "insert", "words-1", "guess"),
        "recount": changes(counts, "revise", "words-1", "words_1", "guess"),
        "second": changes(counts, "insert", "byte-bpe-50k", "bpe"),
        "takedown": changes(toxic, "delete", "words-1", "words_1").unionByName(changes(toxic, "delete", "byte-bpe-50k", "bpe")),
    }
    state = token_counts.TokenCounts.create(spark, shared_dir(spark))
    for name, rows in [*batches.items(), *batches.items()]:
        state.apply(name, rows)
    return token_counts.rolled_up(state.totals())


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(saved(packing.pieces_of(_read(spark, sf_dir, "documents"), tokenizer_path())))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents get a tail that repeats: its first p words, over and over."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words").cast("int"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)"))).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("int((n - a + p - 1) div p)")))
    text = F.when(F.col("n") > 0, F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    first = F.lit(None).cast(periodic_runs.RUN)
    best = F.reduce("runs", first, lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.align(_read(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"), keep=[digest])


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r""",
}
