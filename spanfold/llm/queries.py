"""The queries of this package and, where SQL can say the same, their SQL."""

from .chat import OP5_SQL, op5_reply_tree_chat
from .decontamination import op3_string_tiling_decontamination
from .embeddings import OP1_SQL, op1_spherical_kmeans_dedup
from .hmm import op8_hmm_language_model
from .jaccard import OP4_LINKS_SQL, OP4_SQL, op4_token_group_jaccard, op4_token_group_jaccard_links
from .packing import op7_variable_best_fit_packing
from .secrets import op9_blob_ledger_secrets
from .sharding import op6_weighted_tree_sharding
from .tokens import op2_overlap_token_counts
from .toxicity import op10_boosted_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_spherical_kmeans_dedup,
        op2_overlap_token_counts,
        op3_string_tiling_decontamination,
        op4_token_group_jaccard,
        op4_token_group_jaccard_links,
        op5_reply_tree_chat,
        op6_weighted_tree_sharding,
        op7_variable_best_fit_packing,
        op8_hmm_language_model,
        op9_blob_ledger_secrets,
        op10_boosted_toxicity,
    )
}
ORACLE_SQL = {
    "op1_spherical_kmeans_dedup": OP1_SQL,
    "op4_token_group_jaccard": OP4_SQL,
    "op4_token_group_jaccard_links": OP4_LINKS_SQL,
    "op5_reply_tree_chat": OP5_SQL,
}
