"""Named queries of the training-data operators, and SQL for those that SQL can say."""

from __future__ import annotations

from foliometry.llm import (
    collocations,
    decontamination,
    filter_audit,
    host_reputation,
    html_extraction,
    jaccard_join,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    token_counts,
    training_order,
)

PLANS = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        training_order.op2_training_order,
        decontamination.op3_decontamination,
        jaccard_join.op4_jaccard_join,
        quality_rules.op5_quality_rules,
        quality_classifier.op6_quality_classifier,
        sharding.op7_sharding,
        secrets.op8_secret_scans,
        html_extraction.op9_html_extraction,
        packing.op10_packing,
        host_reputation.op11_host_reputation,
        filter_audit.op12_filter_audit,
        collocations.op13_collocations,
    )
}
ORACLES = {
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op11_host_reputation": host_reputation.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
