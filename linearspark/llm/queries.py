"""The contract queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from linearspark.llm import (
    centroids,
    chat,
    decontaminate,
    extract,
    jaccard,
    language_model,
    licences,
    lines,
    packing,
    quality,
    repair,
    simhash,
    toxicity,
)

QUERIES = {
    "op1_license_scan": licences.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_html_extract": extract.op3_html_extract,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op9_proximity": decontaminate.op9_proximity,
    "op10_lm_score": language_model.op10_lm_score,
    "op11_jaccard_join": jaccard.op11_jaccard_join,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_repair": repair.op13_repair,
}

ORACLE = {
    "op1_license_scan": licences.OP1_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op12_centroid_clusters": centroids.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
