"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_chunks import op7_bpe_chunks
from .decontamination import ORACLE_OP9, op9_decontamination
from .language_id import op10_language_id
from .licenses import ORACLE_OP1, op1_license_scan
from .line_dedup import ORACLE_OP4, op4_line_dedup
from .periodic_runs import op11_periodic_runs
from .prefix_trie import op12_prefix_trie
from .private_data import op13_private_data
from .quality import op5_quality
from .simhash import op8_simhash
from .token_counts import op3_token_counts
from .toxicity import op6_toxicity
from .url_filter import ORACLE_OP2, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_bpe_chunks": op7_bpe_chunks,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_private_data": op13_private_data,
}
ORACLES: dict[str, str] = {"op1_license_scan": ORACLE_OP1, "op2_url_filter": ORACLE_OP2, "op4_line_dedup": ORACLE_OP4, "op9_decontamination": ORACLE_OP9}
