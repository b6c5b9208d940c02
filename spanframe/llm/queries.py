"""The queries of the corpus operators over the test tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import ann, bpe, infill, langid, mixing, neardup, pii, pitman_yor, quality_prior, quality_rules, sharding, spellings, substrings
from spanframe.llm.common import shared_path, table, written


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the shards that the operator has written."""
    sharded = sharding.shard(table(spark, sf_dir, "documents"), 16)
    docs = sharding.write_shards(sharded, shared_path(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs, ~held_out)
    predicted = langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
    return written(predicted, "languages")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = ann.build(rows)
    return ann.search(index, ann.usable(rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding"), 10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    base = F.filter("pii", lambda x: x["base"])
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once, for their sizes and hashes; the mix itself works on those."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n"), F.xxhash64("text").alias("h")), "words")
    return mixing.mix(sizes, size=F.col("n"), content=F.col("h")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measure(table(spark, sf_dir, "documents")).drop("text", "n_chars")
    measured = written(measured, "measures")
    kept = quality_rules.apply_fences(measured, quality_rules.thresholds(measured))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size of every document."""
    docs = table(spark, sf_dir, "documents")
    classed = written(neardup.classes(docs.select("doc_id", "text")).select("doc_id", "root"), "classes")
    joined = neardup.with_sizes(classed, "doc_id")
    return joined.select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("class_size"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return written(coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "tokens")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: sites are their sources, paths their languages. quality_of_pages has hosts and paths."""
    docs = table(spark, sf_dir, "documents")
    model = quality_prior.fit(docs, table(spark, sf_dir, "labels"))
    evidence = written(quality_prior.classify(docs, model).select("doc_id", "source", "lang", "p_doc"), "evidence")
    scored = quality_prior.combine(evidence, "source", "lang")
    return scored.select("doc_id", "p_doc", "site_post", "path_post", "score", (F.col("score") >= 0.5).alias("kept"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spellings.counts(table(spark, sf_dir, "documents"), drop_every=97)
    return spellings.group(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infill.rearrange(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return written(moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")), "moved")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = pitman_yor.fit(docs, "doc_id", "text", ~held_out)
    scored = pitman_yor.scores(model, docs.schema["doc_id"].dataType.simpleString())
    out = scored.select(F.col("key").alias("doc_id"), (~F.col("train") & F.col("key").isNotNull()).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return written(out, "scores")


OP12 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, x, n, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS UBIGINT) % 100 AS c, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS d FROM t),
v AS (SELECT doc_id, x, CAST(n AS BIGINT) AS n, CAST(least(a, b) AS BIGINT) AS lo, CAST(greatest(a, b) AS BIGINT) AS hi,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, substring(x, 1, lo) AS p, substring(x, lo + 1, hi - lo) AS m, substring(x, hi + 1) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM w"""


def quality_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10 over web pages: fitted on labelled documents, sites are hosts, paths the first part of the URL's path."""
    model = quality_prior.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    host, path = quality_prior.site_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract(path, "^/([^/]*)/", 1).alias("path"), quality_prior.page_text(F.col("html")).alias("text"))
    evidence = written(quality_prior.classify(pages, model).drop("text"), "evidence")
    return quality_prior.combine(evidence, "host", "path").select("page_id", "host", "path", "p_doc", "site_post", "path_post", "score")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_nearest, op4_pii, op5_mixing, op6_quality_rules, op7_substrings, op8_near_duplicates, op9_bpe, op10_quality_classifier, op11_spelling_variants, op12_fill_in_middle, op13_lm_scoring, quality_of_pages)}
ORACLES: dict[str, str] = {"op12_fill_in_middle": OP12}
