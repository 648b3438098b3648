"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import licenses, linededup, mixing, packing, pseudonyms, secrets, simhash, topk, toxicity, winnowing

QUERIES = {"op1_toxicity": toxicity.query, "op2_license_scan": licenses.query, "op3_mixing": mixing.query, "op4_top_k": topk.query, "op5_fingerprints": winnowing.query, "op6_packing": packing.query, "op7_line_dedup": linededup.query, "op8_pseudonyms": pseudonyms.query, "op9_simhash": simhash.query, "op10_secret_scan": secrets.query, "pipeline": corpus_pipeline.run}
ORACLES = {"op2_license_scan": licenses.SQL, "op3_mixing": mixing.SQL, "op4_top_k": topk.SQL, "op7_line_dedup": linededup.SQL}
