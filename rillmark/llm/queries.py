"""The registered queries of this package: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=False)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.packing import pack_sequences, spans

    return spans(pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.urlfilter import RULES, judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "component_id")


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.telephony import describe_bytes, store_bytes

    return describe_bytes(store_bytes(table(spark, sf_dir, "documents")))


def op6_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.huffman import roundtrip

    return roundtrip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"), 3, 1)


def op9_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.permindex import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.katz import score

    return score(table(spark, sf_dir, "documents"), 7, 2)


def op11_parsed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.parsing import edit_probe

    return edit_probe(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillmark.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from rillmark.llm import oracles

    return dict(oracles.SQL)
