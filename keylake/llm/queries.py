"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from keylake.llm import fingerprint, line_dedup, lm_scoring, near_dedup, packing, piece_encoding, quality_rules, toxicity, url_filter, warc
from keylake.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {
        "op1_lm_scoring": lambda s, d: lm_scoring.op1(s, table(s, d, "documents")),
        "op2_url_filter": lambda s, d: url_filter.op2(s, table(s, d, "pages")),
        "op3_warc": lambda s, d: warc.op3(s, table(s, d, "pages")),
        "op4_near_dedup": lambda s, d: near_dedup.op4(s, table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.op5(s, table(s, d, "documents"), table(s, d, "labels")),
        "op6_piece_encoding": lambda s, d: piece_encoding.op6(s, table(s, d, "documents"), tokenizer("piece_bpe_32k.model")),
        "op7_fingerprints": lambda s, d: fingerprint.op7(s, table(s, d, "documents")),
        "op8_packing": lambda s, d: packing.op8(s, table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
        "op9_line_dedup": lambda s, d: line_dedup.op9(s, table(s, d, "documents")),
        "op10_quality_rules": quality_rules.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": lm_scoring.OP1_SQL, "op2_url_filter": url_filter.OP2_SQL, "op3_warc": warc.OP3_SQL, "op9_line_dedup": line_dedup.OP9_SQL}
