"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import alignment, fingerprints, html, mixing, neighbours, packing, phrases, quality, rules, similarity, tokens, toxicity, warc
from lodestar.llm.oracles import ORACLES  # noqa: F401
from lodestar.sources.workspace import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.crc_mod("doc_id", 3) == 1, F.lit(False))
    net = quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, net).select("row.doc_id", "score", "predicted").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = materialize(rules.measure(docs).drop("text"), "measured")  # numbers only
    judged = rules.with_verdict(measured, rules.rejected_hosts(measured))
    return judged.select("doc_id", *rules.METRICS, "base_failed", "kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.components(_table(spark, sf_dir, "documents")).drop("node", "top")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).drop("record_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("row.doc_id", "score", "predicted").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(mixing.measured(_table(spark, sf_dir, "documents")), "sizes")  # texts are read once
    return mixing.fair_queue(sizes, size="size").select("row.doc_id", "size", "source_size", "target", "taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.phrase_counts(_table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_html": op10_html,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_neighbours": op13_neighbours,
}
