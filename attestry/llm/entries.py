"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, bpe, html, jaccard_join, line_dedup, packing, quality, suffix_dedup, toxicity, warc


def queries() -> dict:
    out = {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_toxicity": toxicity.query,
        "op3_line_dedup": line_dedup.query,
        "op4_warc_derivatives": warc.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_packing": packing.query,
        "op7_html_extraction": html.query,
        "op8_quality_rules": quality.query,
        "op9_audio_fingerprints": audio.query,
        "op10_bpe": bpe.query,
    }
    return out


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.SQL, "op3_line_dedup": line_dedup.SQL, "op5_jaccard_join": jaccard_join.SQL}
