"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.catalog import register
from penprint.llm import extendible_shards, filter_audit, line_dedup, value_codebooks
from penprint.llm.byte_cnn import fit, held_out, with_language
from penprint.llm.common import table
from penprint.llm.decontaminate import contaminations
from penprint.llm.nn_descent import near_duplicates
from penprint.llm.permutation_index import search
from penprint.llm.piece_offsets import piece_digests
from penprint.llm.secret_scan import scan_secrets
from penprint.llm.simhash import simhash_rows
from penprint.llm.token_planes import token_files
from penprint.llm.weak_quality import quality_scores

END_ID = 2


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file (installed beside the library, never copied)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_token_planes")
def op1(spark, sf_dir):
    """Documents as bit-plane token files; what the files hold per document."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), END_ID)


@register("op2_piece_offsets")
def op2(spark, sf_dir):
    """SentencePiece ids and decoded text of every document, digested."""
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@register("op7_simhash")
def op7(spark, sf_dir):
    """SimHash components: three-word shingles, three bits."""
    return simhash_rows(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@register("op8_byte_cnn")
def op8(spark, sf_dir):
    """Language of every document by the byte network, learnt on the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register("op3_decontaminate")
def op3(spark, sf_dir):
    """Documents that hold a passage of an item of ``benchmark``."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op10_permutation_index")
def op10(spark, sf_dir):
    """Five nearest rows of ``embeddings`` for every fiftieth."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op9_line_dedup", line_dedup.ORACLE)
def op9(spark, sf_dir):
    """Documents without lines that occur earlier, equal or within two edits."""
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


@register("op4_weak_quality")
def op4(spark, sf_dir):
    """Weak labels and linear quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"))


@register("op5_extendible_shards", extendible_shards.ORACLE)
def op5(spark, sf_dir):
    """Extendible-hashing shard of every document."""
    return extendible_shards.shard_rows(table(spark, sf_dir, "documents"))


@register("op6_secret_scan")
def op6(spark, sf_dir):
    """Secret candidates of every document, judged by the forest."""
    return scan_secrets(table(spark, sf_dir, "documents"))


@register("op11_nn_descent")
def op11(spark, sf_dir):
    """Links and components of ``embeddings`` at a cosine of 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op12_filter_audit", filter_audit.ORACLE)
def op12(spark, sf_dir):
    """Five filters in all orders, by source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_value_codebooks", value_codebooks.ORACLE)
def op13(spark, sf_dir):
    """Product codes of ``embeddings``: four parts, 256 entries, four rounds."""
    return value_codebooks.value_codes(table(spark, sf_dir, "embeddings"))
