"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import balls, exact_dedup, media, mixing, near_dedup, passages, pieces, pii, prefix_trie, quality, secrets, token_files, warc

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_media_fingerprints": media.query,
    "op3_secret_scan": secrets.query,
    "op4_token_files": token_files.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_warc_archive": warc.query,
    "op7_sentencepiece": pieces.query,
    "op8_source_mixing": mixing.query,
    "op9_quality_classifier": quality.query,
    "op10_personal_data": pii.query,
    "op11_substring_dedup": passages.query,
    "op12_centroid_clusters": balls.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLES = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_warc_archive": warc.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op11_substring_dedup": passages.ORACLE,
    "op12_centroid_clusters": balls.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
