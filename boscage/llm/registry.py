"""The queries of this subpackage and their SQL."""

from . import bpe, dac, decontaminate, host_rules, html_template, langid, ngram_join, token_count, toxicity, url_filter

QUERIES = {
    "op1_html_template": html_template.query,
    "op2_bpe_codec": bpe.query,
    "op3_ngram_join": ngram_join.query,
    "op4_url_filter": url_filter.query,
    "op5_token_dac": dac.query,
    "op6_toxicity": toxicity.query,
    "op7_language_id": langid.query,
    "op8_host_rules": host_rules.query,
    "op9_token_count": token_count.query,
    "op10_decontaminate": decontaminate.query,
}
SQL = {"op3_ngram_join": ngram_join.SQL, "op4_url_filter": url_filter.SQL, "op8_host_rules": host_rules.SQL, "op10_decontaminate": decontaminate.SQL}
