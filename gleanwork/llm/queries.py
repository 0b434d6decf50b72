"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from gleanwork.llm.ann import op6_ann
from gleanwork.llm.clusters import OP12_SQL, op12_clusters
from gleanwork.llm.html_text import op4_html_text
from gleanwork.llm.language import op7_language_id
from gleanwork.llm.licenses import op9_licenses
from gleanwork.llm.mixing import OP5_SQL, op5_mixing
from gleanwork.llm.neardup import op10_neardup
from gleanwork.llm.packing import op1_packing
from gleanwork.llm.quality import op2_quality
from gleanwork.llm.resampling import OP13_SQL, op13_resampling
from gleanwork.llm.sharding import op8_sharding
from gleanwork.llm.topk import OP3_SQL, op3_topk
from gleanwork.llm.warc import OP11_SQL, op11_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_topk, op4_html_text, op5_mixing, op6_ann, op7_language_id, op8_sharding, op9_licenses, op10_neardup, op11_warc, op12_clusters, op13_resampling)}
SQL = {"op3_topk": OP3_SQL, "op5_mixing": OP5_SQL, "op11_warc": OP11_SQL, "op12_clusters": OP12_SQL, "op13_resampling": OP13_SQL}
