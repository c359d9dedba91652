"""The queries of this package, and their SQL where SQL can express them."""

from . import bpe, conversations, counting, embedding, extraction, langid, minhash, mixture, negatives, packing, pii, quality, suffix

QUERIES = {
    f.__name__: f
    for f in (pii.op1_pii, packing.op2_packing, bpe.op3_bpe, extraction.op4_extraction, embedding.op5_embedding, langid.op6_langid, suffix.op7_suffix, mixture.op8_mixture, quality.op9_quality, minhash.op10_minhash, conversations.op11_conversations, negatives.op12_negatives, counting.op13_counting)
}
ORACLE_SQL = {"op8_mixture": mixture.ORACLE_SQL, "op9_quality": quality.ORACLE_SQL, "op12_negatives": negatives.ORACLE_SQL}
