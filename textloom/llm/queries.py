"""Queries of the training-data operators."""

from __future__ import annotations

from textloom.llm import alignment, canonical, leakage, packing, private, scans, sentences

QUERIES = {
    "p1_found": alignment.p1_found,
    "p1_scored": alignment.p1_scored,
    "p2_found": sentences.p2_found,
    "p3_found": canonical.p3_found,
    "p3_canonical_bodies": canonical.p3_canonical_bodies,
    "p4_found": scans.p4_found,
    "p4_paragraphs": scans.p4_paragraphs,
    "p6_packed": packing.p6_packed,
    "p6_fill": packing.p6_fill,
    "p6_properties": packing.p6_properties,
    "p7_found": leakage.p7_found,
    "p7_matches": leakage.p7_matches,
    "p7_clean_documents": leakage.p7_clean_documents,
    "p8_found": private.p8_found,
    "p8_redacted": private.p8_redacted,
}
ORACLES: dict[str, str] = {"p6_properties": packing.PROPERTIES_SQL}
