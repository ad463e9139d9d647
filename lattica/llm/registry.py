"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, line_templates, maxscore, secrets, shuffle, simhash, token_counts, weak_labels


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_simhash": simhash.query,
        "op3_maxscore": maxscore.query,
        "op4_token_counts": token_counts.query,
        "op5_shards": shuffle.query,
        "op6_chat": chat.query,
        "op7_secrets": secrets.query,
        "op8_bpe": bpe.query,
        "op9_line_dedup": line_templates.query,
        "op10_quality": weak_labels.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op3_maxscore": maxscore.SQL,
        "op6_chat": chat.SQL,
    }
