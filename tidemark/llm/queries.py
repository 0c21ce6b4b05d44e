"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import audit, bpe, centroids, chat, embeddings, licenses, media, mixing, simhash, substring, tokenfiles, toxicity, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_media": media.op2_media,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_substring": substring.op6_substring,
    "op7_bpe": bpe.op7_bpe,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_centroids": centroids.op11_centroids,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_filter_audit": audit.op13_filter_audit,
}

SQL = {"op1_chat": chat.OP1_SQL, "op2_media": media.OP2_SQL, "op9_warc": warc.OP9_SQL, "op11_centroids": centroids.OP11_SQL, "op13_filter_audit": audit.OP13_SQL}
