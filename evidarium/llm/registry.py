"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, hard_negatives, idfile, jaccard, periodic, pii, quality, secret_scan, separators, shard

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": separators.op2_token_counts,
    "op3_feistel_shards": shard.op3_feistel_shards,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_line_quality": quality.op5_line_quality,
    "op6_ranked_id_files": idfile.op6_ranked_id_files,
    "op7_bpe_roundtrip": bpe.op7_bpe_roundtrip,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_personal_data": pii.op9_personal_data,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_chat_windows": chat.op11_chat_windows,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op8_jaccard_join": jaccard.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
