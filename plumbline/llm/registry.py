"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm.decontaminate import op5_spaced_seed_leaks
from plumbline.llm.language_crf import op8_crf_language
from plumbline.llm.license_scan import op9_license_signatures
from plumbline.llm.line_dedup import op2_line_chunk_dedup
from plumbline.llm.media_gif import op6_gif_media
from plumbline.llm.packing import op3_best_fit_packing
from plumbline.llm.sharding import op10_differencing_shards
from plumbline.llm.simhash import op4_simhash_components
from plumbline.llm.token_output import op1_token_orc
from plumbline.llm.url_filter import op7_url_logistic


def queries() -> dict:
    return {
        "op1_token_orc": op1_token_orc,
        "op2_line_chunk_dedup": op2_line_chunk_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash_components": op4_simhash_components,
        "op5_spaced_seed_leaks": op5_spaced_seed_leaks,
        "op6_gif_media": op6_gif_media,
        "op7_url_logistic": op7_url_logistic,
        "op8_crf_language": op8_crf_language,
        "op9_license_signatures": op9_license_signatures,
        "op10_differencing_shards": op10_differencing_shards,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
