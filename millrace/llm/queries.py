"""Queries of this subpackage and the SQL that DuckDB can run for them."""

import corpus_pipeline
from millrace.llm.decontaminate import op9_decontaminate
from millrace.llm.html_blocks import op5_html_blocks
from millrace.llm.language import op10_language_id
from millrace.llm import mixing, ranking
from millrace.llm.mixing import op1_mixing
from millrace.llm.quality import op11_quality
from millrace.llm.ranking import op12_ranked_search
from millrace.llm.simhash import op7_simhash
from millrace.llm.spotsigs import op2_spotsigs
from millrace.llm.substrings import op3_substring_dedup
from millrace.llm.suffix_array import op4_suffix_dedup
from millrace.llm.templates import op8_line_templates
from millrace.llm.tokens import op6_token_counts
from millrace.llm.whitening import op13_whitening

QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_mixing, op2_spotsigs, op3_substring_dedup, op4_suffix_dedup, op5_html_blocks, op6_token_counts, op7_simhash, op8_line_templates, op9_decontaminate, op10_language_id, op11_quality, op12_ranked_search, op13_whitening)}
ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op12_ranked_search": ranking.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
