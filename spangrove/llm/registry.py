"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .apportion import op12_sainte_lague
from .chosen_path import op9_chosen_path
from .chunk_bpe import op7_chunk_bpe
from .katz import op4_katz
from .pigeonhole import op10_pigeonhole
from .pii import op2_weak_pii
from .pivot_search import SQL8, op8_pivot_search
from .prefix_trie import SQL11, op11_prefix_trie
from .secret_owners import op5_secret_owners
from .simple8b import op3_simple8b
from .site_quality import op1_site_quality
from .spelling import SQL13, op13_spelling
from .token_counts import op6_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_site_quality, op2_weak_pii, op3_simple8b, op4_katz, op5_secret_owners, op6_token_counts, op7_chunk_bpe, op8_pivot_search, op9_chosen_path, op10_pigeonhole, op11_prefix_trie, op12_sainte_lague, op13_spelling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op8_pivot_search": SQL8, "op11_prefix_trie": SQL11, "op13_spelling": SQL13}
