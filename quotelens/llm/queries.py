"""The registered queries of this package and the SQL they must agree with, where SQL can express them."""

from __future__ import annotations

from . import alignment, decontam, licenses, neardup, neighbours, packing, pii, quality, sharding, substrings, tokencount, warc, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_repeated_substrings": substrings.op4_repeated_substrings,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_warc": warc.op6_warc,
    "op7_packing": packing.op7_packing,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_extendible_sharding": sharding.op10_extendible_sharding,
    "op11_alignment": alignment.op11_alignment,
    "op12_whitening": whitening.op12_whitening,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op3_decontamination": decontam.SQL,
    "op6_warc": warc.SQL,
    "op10_extendible_sharding": sharding.SQL,
    "op13_licenses": licenses.SQL,
}
