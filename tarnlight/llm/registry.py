"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .align import op12_alignment
from .hnsw import op3_hnsw
from .langid import op7_language_id
from .decontaminate import op9_decontamination
from .minhash import op2_minhash
from .mtree import OP11_SQL, op11_mtree
from .packing import op4_packing
from .pii import op1_pii
from .toolcalls import OP5_SQL, op5_tool_calls
from .toxicity import op10_toxicity
from .turns import op13_repair
from .urlfilter import op6_sql, op6_url_filter
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_minhash, op3_hnsw, op4_packing, op5_tool_calls, op6_url_filter, op7_language_id, op8_warc, op9_decontamination, op10_toxicity, op11_mtree, op12_alignment, op13_repair)}


def oracle_sql() -> dict:
    return {"op5_tool_calls": OP5_SQL, "op6_url_filter": op6_sql(), "op8_warc": OP8_SQL, "op11_mtree": OP11_SQL}
