"""Registered queries of the subpackage, and the DuckDB statements of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm.bpe import op2_bpe_automaton
from funnelkit.llm.chat import OP7_SQL, op7_chat_format
from funnelkit.llm.collocations import OP11_SQL, op11_collocations
from funnelkit.llm.embed_dedup import OP9_SQL, op9_pca_tiled_dedup
from funnelkit.llm.license_scan import op6_license_scan
from funnelkit.llm.merkle import OP12_SQL, op12_merkle_manifest
from funnelkit.llm.mixing import op1_pareto_mix
from funnelkit.llm.ngram_join import op3_ngram_jaccard_join
from funnelkit.llm.pii import op13_personal_data
from funnelkit.llm.sharding import op10_hash_tree_shards
from funnelkit.llm.substring import op5_substring_dedup
from funnelkit.llm.topk import OP4_SQL, op4_maxscore_topk
from funnelkit.llm.toxicity import op8_kneser_ney_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pareto_mix, op2_bpe_automaton, op3_ngram_jaccard_join,
                            op4_maxscore_topk, op5_substring_dedup, op6_license_scan,
                            op7_chat_format, op8_kneser_ney_toxicity, op9_pca_tiled_dedup,
                            op10_hash_tree_shards, op11_collocations,
                            op12_merkle_manifest, op13_personal_data)}

SQL: dict[str, str] = {"op4_maxscore_topk": OP4_SQL, "op7_chat_format": OP7_SQL,
                       "op9_pca_tiled_dedup": OP9_SQL, "op11_collocations": OP11_SQL,
                       "op12_merkle_manifest": OP12_SQL}
