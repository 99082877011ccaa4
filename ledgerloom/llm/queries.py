"""Queries of this package by name, and their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_in_middle, licenses, matroska, merkle, mixing, ngram_join, pii, quality_rules, sentencepiece_codec, token_counts, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_media_columns": matroska.op2_media_columns,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_personal_data": pii.op6_personal_data,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "media_packets": matroska.media_packets,
    "quality_statistics": quality_rules.quality_statistics,
}
#: Texts that SQL can't give (tokenizers, media files, a fitted model, fuzzy and bootstrapped matches) are tested otherwise.
SQL = {
    "op3_ngram_jaccard_join": ngram_join.OP3_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
    "media_packets": matroska.MEDIA_PACKETS_SQL,
    "quality_statistics": quality_rules.QUALITY_STATISTICS_SQL,
}
