"""Queries of this package and the SQL that must give the same rows."""

from mailspark.llm.bpe import op7_speculative_bpe
from mailspark.llm.conversation_trie import op12_rollup_prefix_trie
from mailspark.llm.exact_dedup import OP9_SQL, op9_digest_index
from mailspark.llm.html_text import op10_site_style_tree
from mailspark.llm.mixing import op8_pfair_mix
from mailspark.llm.pii import op1_weak_supervision_pii
from mailspark.llm.quality_model import op5_random_indexing_quality
from mailspark.llm.quality_rules import OP3_SQL, op3_rule_ledger
from mailspark.llm.sharding import OP2_SQL, op2_stratified_interleave
from mailspark.llm.simhash import op4_simhash_bktree
from mailspark.llm.spelling import op13_sorted_list_variants
from mailspark.llm.token_counts import op11_whole_token_counts
from mailspark.llm.url_filter import op6_url_language_models

QUERIES = {f.__name__: f for f in (
    op1_weak_supervision_pii, op2_stratified_interleave, op3_rule_ledger, op4_simhash_bktree,
    op5_random_indexing_quality, op6_url_language_models, op7_speculative_bpe, op8_pfair_mix,
    op9_digest_index, op10_site_style_tree, op11_whole_token_counts, op12_rollup_prefix_trie,
    op13_sorted_list_variants)}

ORACLES = {
    "op2_stratified_interleave": OP2_SQL,
    "op3_rule_ledger": OP3_SQL,
    "op9_digest_index": OP9_SQL,
}
