"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, neardup, packing, pagediff, pieces, recode, residue, sitelines, tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": neardup.p1_found,
    "p1_classes": neardup.p1_classes,
    "p2_found": langid.p2_found,
    "p2_languages": langid.p2_languages,
    "p3_found": pagediff.p3_found,
    "p3_articles": pagediff.p3_articles,
    "p4_found": sitelines.p4_found,
    "p4_clean": sitelines.p4_clean,
    "p4_lines": sitelines.p4_lines,
    "p5_found": residue.p5_found,
    "p5_evidence": residue.p5_evidence,
    "p5_kept": residue.p5_kept,
    "p6_found": recode.p6_found,
    "p6_restored": recode.p6_restored,
    "p7_ids": tokenizer.p7_ids,
    "p7_spans": tokenizer.p7_spans,
    "p8_pack": packing.p8_pack,
    "p8_fill": packing.p8_fill,
    "p9_found": pieces.p9_found,
    "p9_pieces": pieces.p9_pieces,
}

ORACLES: dict[str, str] = {**sitelines.ORACLES}
