"""Registry of the numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.attention_lm import op7_language_scores
from barloom.llm.centroids import OP12_SQL, op12_centroids
from barloom.llm.compression_quality import op13_quality_scores
from barloom.llm.decontamination import OP8_SQL, op8_decontamination
from barloom.llm.html_text import op1_html_text
from barloom.llm.licenses import op9_license_scan
from barloom.llm.mixing import op3_mixing
from barloom.llm.near_dedup import op5_near_duplicates
from barloom.llm.quality import OP4_SQL, op4_quality_rules
from barloom.llm.spelling import OP11_SQL, op11_spelling_variants
from barloom.llm.suffix_dedup import op2_suffix_dedup
from barloom.llm.token_output import op6_token_output
from barloom.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_output": op6_token_output,
    "op7_language_scores": op7_language_scores,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroids": op12_centroids,
    "op13_quality_scores": op13_quality_scores,
}
ORACLE_SQL = {"op4_quality_rules": OP4_SQL, "op8_decontamination": OP8_SQL, "op10_warc": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_centroids": OP12_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
