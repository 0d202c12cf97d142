"""The thin queries of the llm operators over the given tables; operators keep their own interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_content, language_id, manifest, ngram_join, packing, pieces, pii, prefix_trie, quality_model, quality_rules, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of all documents."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).drop("n_checked_links")


def _days(days) -> F.Column:
    """The start of the day so many days into 2024."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + 86_400 * days)


def _number(text) -> F.Column:
    """A number below 2^24 from the digest of a text."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries drawn from the hosts of the pages: domains blocked for a time, hosts allowed, language folders blocked."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    domains = hosts.select(F.substring_index("host", ".", -3).alias("key")).distinct().withColumn("m", _number(F.col("key")))
    hosts = hosts.withColumn("m", _number(F.col("host")))
    columns = ["list_name", "effect", "kind", "key", "action", "at"]

    def rows(of: DataFrame, list_name: str, effect: str, kind: str, key, action: str, at) -> DataFrame:
        return of.select(F.lit(list_name), F.lit(effect), F.lit(kind), key, F.lit(action), at).toDF(*columns)

    m, listed = F.col("m"), domains.filter("m % 3 = 0")
    parts = [
        rows(listed, "spam", "block", "domain", F.col("key"), "add", _days(m % 200)),
        rows(listed.filter("m % 2 = 0"), "spam", "block", "domain", F.col("key"), "remove", _days(m % 200 + 40 + m % 97)),
        rows(listed.filter("m % 4 = 0"), "spam", "block", "domain", F.col("key"), "add", _days(m % 200 + 160 + m % 97)),
        rows(hosts.filter("m % 7 = 0"), "partners", "allow", "host", F.col("host"), "add", _days(m % 300)),
        rows(hosts.filter("m % 5 = 0"), "folders", "block", "prefix", F.concat("host", F.lit("/en")), "add", _days(m % 365)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures of a day that their URL's digest gives, against dated lists drawn from their hosts."""
    pages = _table(spark, sf_dir, "pages")
    fetched = _number(F.coalesce("url", F.lit(""))) % 365
    captures = pages.select("page_id", "url", fetched.alias("day"), (F.timestamp_seconds(F.lit(1_704_067_200 + 43_200) + 86_400 * fetched)).alias("fetched"))
    return url_filters.judge(captures, _list_entries(pages)).select("page_id", "url", "day", "n_block", "n_allow", "lists", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-score pieces of all documents and whether decoding gives the text again."""
    import public_tokenizers

    return pieces.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned on three quarters of them."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_content.extract(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents, with cutoffs chosen on the labelled ones, by language."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    # the same vocabulary as byte_bpe_50k.json in the form of ranks: equal ids, in less than half the time
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=packing.SPECIAL)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in all documents."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned on two thirds of the labelled ones."""
    return quality_model.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprints.compare_edits(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of all documents, and whether the proof holds for what a third of them are tampered into."""
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_trie": op13_conversation_trie,
}
