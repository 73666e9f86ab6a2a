"""Queries of the training-data operators by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .embedding_dedup import op6_sorted_projections
from .media_avi import op5_avi_mjpeg
from .mixing import OP1_SQL, op1_pareto_mix
from .passage_dedup import op3_collinear_chains
from .sentencepiece_bpe import op7_sentencepiece
from .simhash import op4_simhash_variants
from .suffix_dedup import op9_suffix_refinement
from .token_files import op10_token_parquet
from .toxicity import op2_toxicity_counterfactual
from .url_filter import OP8_SQL, op8_url_cascade

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_toxicity_counterfactual": op2_toxicity_counterfactual,
    "op3_collinear_chains": op3_collinear_chains,
    "op4_simhash_variants": op4_simhash_variants,
    "op5_avi_mjpeg": op5_avi_mjpeg,
    "op6_sorted_projections": op6_sorted_projections,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_cascade": op8_url_cascade,
    "op9_suffix_refinement": op9_suffix_refinement,
    "op10_token_parquet": op10_token_parquet,
}

ORACLES: dict[str, str] = {
    "op1_pareto_mix": OP1_SQL,
    "op8_url_cascade": OP8_SQL,
}
