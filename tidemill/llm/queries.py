"""Queries of the training-data operators: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tidemill.llm.bwt_dedup import op1
from tidemill.llm.cells import lean
from tidemill.llm.config_packing import op6
from tidemill.llm.cover_dedup import op8
from tidemill.llm.fim_markers import OP12_SQL, op12
from tidemill.llm.hilbert_shard import op4
from tidemill.llm.importance import OP11_SQL, op11
from tidemill.llm.line_dedup import OP13_SQL, op13
from tidemill.llm.piece_codec import op2
from tidemill.llm.pq_neardup import op3
from tidemill.llm.quality_net import op10
from tidemill.llm.quality_rules import op9
from tidemill.llm.simhash_mih import op5
from tidemill.llm.toxicity import op7

OPERATORS = {
    "op1_suffix_dedup": op1,
    "op2_piece_codec": op2,
    "op3_pq_neardup": op3,
    "op4_hilbert_shard": op4,
    "op5_simhash": op5,
    "op6_config_packing": op6,
    "op7_toxicity": op7,
    "op8_cover_dedup": op8,
    "op9_quality_rules": op9,
    "op10_quality_net": op10,
    "op11_importance_postings": op11,
    "op12_fim_markers": op12,
    "op13_line_dedup": op13,
}


def _lean(query):
    return lambda spark, sf_dir: query(lean(spark), sf_dir)


QUERIES = {**{name: _lean(query) for name, query in OPERATORS.items()}, "pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {"op11_importance_postings": OP11_SQL, "op12_fim_markers": OP12_SQL, "op13_line_dedup": OP13_SQL}
