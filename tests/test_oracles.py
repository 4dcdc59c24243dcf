"""Queries against DuckDB on the same tables; one of each family and all with a rule of their own."""

import pytest

from txloom.plans import registry

CHOSEN = """flagship_history_by_split win3_seconds_since_previous_log win4_window_counts_log win6_amount_log_z win8_pair_surprisal win9_amount_7d win12_activity_share
win13_merchant_channel win15_card_missing win16_merchant_channel_two_level win17_chronological_id win18_episode_start win20_frozen_entity_mean win21_rank_quartiles win22_ema
prj2_timestamp_assembly prj3_currency prj7_state_bin prd2_load_audit prd6_misaligned prd7_completeness spl2_tie_safe_split spl5_first_eligible_anchor spl7_nearest_anchors
spl8_parity_blocks spl9_selection_tail spl13_drift enc3_robust enc6_first_appearance enc9_frequency gra2_directed_edges gra11_coordinates gra15_pagerank gra17_ppr_by_steps gra25_camouflage_mask
sam2_weighted_gumbel sam8_recent sam9_two_layers sam14_stratified_roots sam19_inclusion joi10_previous_event set6_keep_last srt4_natural_key agg1_monthly_support agg15_weighted
met3_average_precision met4_roc_auc met7_ndcg met11_best_f_beta met12_min_precision_f1 met14_fpr_budget met25_bootstrap_mean str1_daily_replay str2_keyed_state src1_csv_scan src11_flat_json snk7_row_digest""".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_has_sql_or_a_reason():
    without = set(registry.QUERIES) - set(registry.ORACLE_SQL)
    assert without == {"enc8_sparse_matrix", "gra27_spectral_sketch", "met26_block_bootstrap", "met27_hierarchical_bootstrap", "met28_mcnemar_holm", "met36_gain_share", "mod1_sage_inference", "mod2_factorised_forward", "mod3_causal_forward", "mod9_hybrid_trees", "mod10_pca"}
