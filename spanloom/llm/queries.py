"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, langid, licenses, lines, media, mixing, simhash, substrings, vectors

QUERIES = {
    "op1_langid_compression": langid.op1,
    "op2_subspace_join": vectors.op2,
    "op3_license_templates": licenses.op3,
    "op4_fuzzy_lines": lines.op4,
    "op5_png_media": media.op5,
    "op6_sainte_lague_mix": mixing.op6,
    "op7_byte_bpe": bpe.op7,
    "op8_simhash_bitsliced": simhash.op8,
    "op9_chat_windows": chat.op9,
    "op10_substring_index": substrings.op10,
}

ORACLES: dict[str, str] = {
    "op2_subspace_join": vectors.OP2_SQL,
    "op9_chat_windows": chat.OP9_SQL,
    "op10_substring_index": substrings.OP10_SQL,
}
