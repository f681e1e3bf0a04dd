"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .covertree import OP9_SQL, op9_topk
from .html_text import op3_html
from .jaccard import OP8_SQL, op8_jaccard
from .mixing import OP1_SQL, op1_mixing
from .packing import op2_packing
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .quality import op10_quality
from .resampling import OP12_SQL, op12_resampling
from .secret_scan import op6_secrets
from .token_counts import op13_token_counts
from .toxicity import op4_toxicity
from .vectors import OP5_SQL, op5_embedding_neardup
from .warc import OP7_SQL, op7_warc

QUERIES = {"op1_mixing": op1_mixing, "op2_packing": op2_packing, "op3_html": op3_html, "op4_toxicity": op4_toxicity, "op5_embedding_neardup": op5_embedding_neardup, "op6_secrets": op6_secrets, "op7_warc": op7_warc, "op8_jaccard": op8_jaccard, "op9_topk": op9_topk, "op10_quality": op10_quality, "op11_periodic_runs": op11_periodic_runs, "op12_resampling": op12_resampling, "op13_token_counts": op13_token_counts}
SQL = {"op1_mixing": OP1_SQL, "op5_embedding_neardup": OP5_SQL, "op7_warc": OP7_SQL, "op8_jaccard": OP8_SQL, "op9_topk": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_resampling": OP12_SQL}
