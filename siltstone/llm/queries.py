"""The registered queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from siltstone.llm.decontaminate import op7_wu_manber
from siltstone.llm.mixing import op8_mixing
from siltstone.llm.near import op5_jaccard_join
from siltstone.llm.oracle import ORACLE_SQL
from siltstone.llm.quality import op1_rule_ensemble
from siltstone.llm.search import op10_bm25_wand
from siltstone.llm.secrets import op3_secrets
from siltstone.llm.sharding import op6_vector_sharding
from siltstone.llm.suffixes import op2_suffix_merge
from siltstone.llm.surrogates import op4_surrogates
from siltstone.llm.warc import op9_warc

QUERIES = {
    "op1_rule_ensemble": op1_rule_ensemble,
    "op2_suffix_merge": op2_suffix_merge,
    "op3_secrets": op3_secrets,
    "op4_surrogates": op4_surrogates,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_vector_sharding": op6_vector_sharding,
    "op7_wu_manber": op7_wu_manber,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_bm25_wand": op10_bm25_wand,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
