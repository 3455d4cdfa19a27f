"""A corpus pipeline: five stages over documents, each an operator of passagemill.llm.

Language ID drops what it rejects; line dedup drops lines that an earlier line makes superfluous, and
documents of which nothing is left; the Jaccard join keeps one document of each class; decontamination
drops documents that hold benchmark passages; encoding turns what stays into token ids.

Every stage keeps all rows that it has no reason to drop: null and empty texts are rejected by
language ID (no letter), empty tables stay empty, of fully equal rows the Jaccard join keeps one, and
columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import decontaminate, jaccard_join, language, line_dedup, trie_bpe
from passagemill.llm.common import discard, materialize, read_documents, whole_row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", whole_row(docs))
    return language.identify(rows, language.learn(docs), ["_row"]).where(~F.col("rejected")).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their superfluous lines, n_chars with them; a document goes if lines went and nothing but white space is left."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", whole_row(docs)), ["_row"], short=True)
    went = (F.size("equal") > 0) | (F.size("near") > 0)
    row = F.col("_row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(went, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return out.where(~went | (F.trim("kept") != "")).select(row.alias("_row")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_classes(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and digests of the ids and of the decoded text."""
    path = public_tokenizers.path(trie_bpe.TOKENIZER)
    return trie_bpe.digests(trie_bpe.roundtrip(docs, ["doc_id"], path), "token_ids")


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("jaccard_join", near_duplicates), ("decontaminate", decontaminated), ("bpe", encode)]
#: Compression, hashing sketches and a tokenizer library's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            made = materialize(made, name)
            if i:
                discard(docs)  # the next stage is written: nothing reads the one before
        docs = made
    return docs
