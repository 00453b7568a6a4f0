"""Queries opN_<name>, each over its whole table, op2's banding and verification as one more, and the SQL of those that SQL can express."""

from tidewrack.llm import balltree, editprint, htmltext, language, mixing, packing, secrets, simhash, suffixes, templates

QUERIES = {
    "op1_grammar_secrets": secrets.op1_grammar_secrets,
    "op2_edit_embedding": editprint.op2_edit_embedding,
    "op3_template_tree": templates.op3_template_tree,
    "op4_pareto_mix": mixing.op4_pareto_mix,
    "op5_suffix_arrays": suffixes.op5_suffix_arrays,
    "op6_linear_grouping": packing.op6_linear_grouping,
    "op7_text_blocks": htmltext.op7_text_blocks,
    "op8_simhash_trie": simhash.op8_simhash_trie,
    "op9_cross_parsing": language.op9_cross_parsing,
    "op10_ball_tree": balltree.op10_ball_tree,
    "edit_near_duplicates": editprint.edit_near_duplicates,
}
SQL = {
    "op3_template_tree": templates.OP3_SQL,
    "op4_pareto_mix": mixing.OP4_SQL,
    "op10_ball_tree": balltree.OP10_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
