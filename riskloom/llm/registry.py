"""The queries of this subpackage and their SQL."""
from __future__ import annotations

from riskloom.llm import (attribution, bpe, fingerprints, language, lexical, minhash, ngram_join, packing, quality,
                          quotations, sharding, token_files, whitening)

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quotations": quotations.op3_quotations,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_packing": packing.op5_packing,
    "op6_token_files": token_files.op6_token_files,
    "op7_language": language.op7_language,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": attribution.op10_token_counts,
    "op11_lexical": lexical.op11_lexical,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash": minhash.op13_minhash,
}
SQL = {
    "op2_ngram_join": ngram_join.op2_sql(),
    "op3_quotations": quotations.op3_sql(),
    "op9_quality": quality.op9_sql(),
    "op11_lexical": lexical.op11_sql(),
    "op13_minhash": minhash.op13_sql(),
}
