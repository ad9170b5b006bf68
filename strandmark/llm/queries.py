"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import chat, decontaminate, langid, lm, mixing, quality, secrets, simhash, suffix, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_warc_index": warc.op5_warc_index,
    "op6_ctw_score": lm.op6_ctw_score,
    "op7_simhash_bktree": simhash.op7_simhash_bktree,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_chat_snapshots": chat.op9_chat_snapshots,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op4_language_id": langid.OP4_SQL,
    "op5_warc_index": warc.OP5_SQL,
    "op8_poisson_mix": mixing.OP8_SQL,
    "op9_chat_snapshots": chat.OP9_SQL,
    "op10_suffix_dedup": suffix.OP10_SQL,
}
