"""Queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chroma, fill_middle, jaccard_join, license_scan, maxent_lm, mixing, packing, piece_spans, toxicity, url_filter, vamana, wavelet, whitening

QUERIES = {"op1_license_scan": license_scan.query, "op2_maxent_lm": maxent_lm.query, "op3_wavelet": wavelet.query, "op4_vamana": vamana.query, "op5_url_filter": url_filter.query, "op6_jaccard_join": jaccard_join.query, "op7_toxicity": toxicity.query, "op8_mixing": mixing.query, "op9_packing": packing.query, "op10_chroma": chroma.query, "op11_whitening": whitening.query, "op12_piece_spans": piece_spans.query, "op13_fill_middle": fill_middle.query}
ORACLE_SQL = {"op1_license_scan": license_scan.ORACLE_SQL, "op5_url_filter": url_filter.ORACLE_SQL, "op6_jaccard_join": jaccard_join.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op13_fill_middle": fill_middle.ORACLE_SQL}
