"""The queries of this subpackage, by name, and their DuckDB equivalents."""

from __future__ import annotations

from propgraph.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup_query
from propgraph.llm.fingerprint import fingerprint_query
from propgraph.llm.langid import langid_query
from propgraph.llm.minhash import NEAR_DEDUP_SQL, near_dedup_query
from propgraph.llm.mixing import mixing_query
from propgraph.llm.packing import packing_query
from propgraph.llm.pii import pii_query
from propgraph.llm.quality import quality_query
from propgraph.llm.suffix_dedup import suffix_query
from propgraph.llm.warc import warc_query


def queries() -> dict:
    return {
        "op1_packing": packing_query,
        "op2_suffix_dedup": suffix_query,
        "op3_warc": warc_query,
        "op4_pii": pii_query,
        "op5_langid": langid_query,
        "op6_mixing": mixing_query,
        "op7_quality": quality_query,
        "op8_near_dedup": near_dedup_query,
        "op9_fingerprints": fingerprint_query,
        "op10_exact_dedup": exact_dedup_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_near_dedup": NEAR_DEDUP_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL}
