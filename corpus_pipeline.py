"""Corpus pipeline: documents to token ids. Each stage works on all that the one before kept.

1. toxicity: documents that the fitted classifier rejects go;
2. near duplicates: of each class of the exact 5-gram Jaccard join at 0.8, the document with the least doc_id stays;
3. repeated substrings: strings of 51 words that occur elsewhere too are cut out, overlaps included, so that no passage of over 50 words stands in two places;
4. benchmark leaks: documents that contain a window of a benchmark item of 8 words or more go, and those with two shorter items or more;
5. SentencePiece: the texts become token ids; ``exact`` tells whether decoding gives the text back.

A stage is written and read again before the next one begins, so that lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontaminate, jaccard_join, sp_encode, suffix_dedup, toxicity
from seqspark.llm.common import cut, table

#: Repeated passages of so many words go.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(docs, PASSAGE_WORDS, "words")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), least_short=2)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = sp_encode.decode(sp_encode.encode(docs, model), model)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sp_encode.BLANK, " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("exact"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_substrings", cut_repeats), ("decontamination", drop_leaks), ("sentencepiece", tokenize)]
#: Learned, byte-wise and tokenizer stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
