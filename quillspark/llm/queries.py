"""Queries of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline

from . import avi, bpe, fingerprint, idfiles, jaccard, langid, licences, linededup, mixing, secrets

QUERIES = {
    "op1_token_files": idfiles.op1_token_files,
    "op2_secrets": secrets.op2_secrets,
    "op3_language": langid.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_ngram_join": jaccard.op5_ngram_join,
    "op6_bpe": bpe.op6_bpe,
    "op7_media": avi.op7_media,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_licences": licences.op9_licences,
    "op10_line_dedup": linededup.op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}

#: DuckDB SQL of those that SQL can express.
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
}
