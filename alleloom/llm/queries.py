"""The thin queries over the operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The queries' key; a corpus in use has a secret of its own.
PII_KEY = b"surrogates of the test corpus"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.substrings import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.jaccard import joined

    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.url_filter import filtered

    return filtered(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.langid import identified

    return identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.quality import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.bpe import round_trips

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm import media

    store = media.saved(table(spark, sf_dir, "documents").select("doc_id", "text"))
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    seqs = media.sequences(store.select("doc_id", "n_bytes", media.page_of(F.col("digest"), caption).alias("html")))
    found = media.resolved(seqs, media.described(store.select("media")), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", *(F.col("payload").getField(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")), "position", "caption")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.toxicity import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.vector_codes import digests

    return digests(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alleloom.llm.periodic import digests

    return digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_pii, op3_substrings, op4_jaccard, op5_url_filter, op6_language_id, op7_quality, op8_embeddings, op9_byte_bpe, op10_media, op11_toxicity, op12_vector_codes, op13_periodic_runs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from alleloom.llm import jaccard, substrings, url_filter, vector_codes

    return {"op3_substrings": substrings.SQL, "op4_jaccard": jaccard.SQL, "op5_url_filter": url_filter.SQL, "op12_vector_codes": vector_codes.SQL}
