"""The queries of this subpackage and the DuckDB SQL of those that have one."""

from lorespark.llm.bpe import op4_bpe
from lorespark.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from lorespark.llm.jaccard_join import op13_jaccard_join
from lorespark.llm.mixing import OP5_SQL, op5_mix_sources
from lorespark.llm.near_dedup import op3_near_dedup
from lorespark.llm.periodic_runs import op11_periodic_runs
from lorespark.llm.quality import OP7_SQL, op7_quality_rules
from lorespark.llm.resampling import OP12_SQL, op12_importance_resampling
from lorespark.llm.sharding import op8_sharding
from lorespark.llm.substring import op6_substring_dedup
from lorespark.llm.token_counts import op2_token_counts
from lorespark.llm.url_filter import OP1_SQL, op1_url_filters
from lorespark.llm.warc import OP9_SQL, WARC_SALVAGE_SQL, op9_warc, warc_salvage

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_bpe": op4_bpe,
    "op5_mix_sources": op5_mix_sources,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "warc_salvage": warc_salvage,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLE_SQL = {
    "op1_url_filters": OP1_SQL,
    "op5_mix_sources": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_warc": OP9_SQL,
    "warc_salvage": WARC_SALVAGE_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
}
