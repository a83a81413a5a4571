"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe_rank_queue
from .classify import op4_toxicity_cnn, op7_quality_ftrl
from .media import op8_avi_media
from .near import op2_minhash_near_dedup
from .packing import op6_best_fit_packing
from .shards import op5_kd_tree_shards
from .spans import op10_sentence_spans
from .topk import OP3_SQL, op3_cover_tree_topk
from .urls import op1_url_gbt


def queries() -> dict:
    from corpus_pipeline import run

    operators = [
        op1_url_gbt, op2_minhash_near_dedup, op3_cover_tree_topk, op4_toxicity_cnn, op5_kd_tree_shards,
        op6_best_fit_packing, op7_quality_ftrl, op8_avi_media, op9_bpe_rank_queue, op10_sentence_spans,
    ]
    return {f.__name__: f for f in operators} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op3_cover_tree_topk": OP3_SQL}
