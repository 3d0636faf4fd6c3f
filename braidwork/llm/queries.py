"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import decontaminate, htmltext, linededup, media, mixing, ngram_join, quality, shard, substring, toxicity

QUERIES = {
    "op1_sharding": shard.op1_sharding,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_html_extraction": htmltext.op4_html_extraction,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_media_columns": media.op10_media_columns,
}

ORACLE_SQL = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op8_mixing": mixing.oracle_sql(),
}
