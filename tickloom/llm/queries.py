"""Registered queries of the text operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import covertree, divergence, filter_audit, langid, licenses, merkle, minhash, mixing, packing, sanitise, secret_scan, suffixes, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_strings": lambda spark, sf: suffixes.query(table(spark, sf, "documents"), passages=True),
    "op2_temperature_mixing": lambda spark, sf: mixing.query(table(spark, sf, "documents")),
    "op3_circulant_minhash": lambda spark, sf: minhash.query(table(spark, sf, "documents")),
    "op4_complement_packing": lambda spark, sf: packing.query(table(spark, sf, "documents")),
    "op5_toxic_segments": lambda spark, sf: toxicity.query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op6_trigram_secrets": lambda spark, sf: secret_scan.query(table(spark, sf, "documents")),
    "op7_merkle_fingerprints": lambda spark, sf: merkle.query(table(spark, sf, "documents")),
    "op8_licence_sentences": lambda spark, sf: licenses.query(table(spark, sf, "documents")),
    "op9_cover_tree_links": lambda spark, sf: covertree.query(table(spark, sf, "embeddings")),
    "op10_ftrl_language": lambda spark, sf: langid.query(table(spark, sf, "documents")),
    "op11_filter_orders": lambda spark, sf: filter_audit.query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op12_disclosing_terms": lambda spark, sf: sanitise.query(table(spark, sf, "documents")),
    "op13_source_divergence": lambda spark, sf: divergence.query(table(spark, sf, "documents")),
}
ORACLES: dict[str, str] = {
    "op8_licence_sentences": licenses.oracle(),
    "op11_filter_orders": filter_audit.oracle(),
    "op12_disclosing_terms": sanitise.oracle(),
    "op13_source_divergence": divergence.oracle(),
}
