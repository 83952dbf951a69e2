"""Queries of this subpackage and their SQL, by name."""

from . import hamming, html_text, langid, licenses, media, minhash, mixing, packing, quality, warc

QUERIES = {
    "op1_warc_round_trip": warc.query,
    "op2_quality_crf": quality.query,
    "op3_minhash_fingerprints": minhash.query,
    "op4_language_masks": langid.query,
    "op5_best_fit_packing": packing.query,
    "op6_main_text": html_text.query,
    "op7_license_scan": licenses.query,
    "op8_media_columns": media.query,
    "op9_simhash_components": hamming.query,
    "op10_pfair_mixing": mixing.query,
}

#: The others train models, hash or pack, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_warc_round_trip": warc.ORACLE_SQL}
