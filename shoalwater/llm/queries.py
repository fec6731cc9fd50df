"""The registered queries of this package, one per operator, and their DuckDB twins."""

from . import embedding_dedup, exact_dedup, filter_audit, html_extract, language, line_dedup, mixing, near_dedup, packing, quality, tokens, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality": quality.op3_quality,
    "op4_language": language.op4_language,
    "op5_mixing": mixing.op5_mixing,
    "op6_html_text": html_extract.op6_html_text,
    "op7_token_files": tokens.op7_token_files,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_packing": packing.op9_packing,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_whitening": whitening.op12_whitening,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
