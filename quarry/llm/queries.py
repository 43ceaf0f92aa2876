"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import OP9_SQL, op9_fm_index
from .html_text import op10_crf_main_text
from .language import op3_subword_softmax
from .line_templates import op1_log_templates
from .mixing import op5_soft_membership_mix
from .near_dedup import OP8_SQL, op8_minhash_bayes
from .repetition import op2_suffix_repetition
from .substring_dedup import OP6_SQL, op6_prefix_doubling
from .surrogates import op4_keyed_surrogates
from .warc import OP7_SQL, op7_warc_derivatives


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_log_templates": op1_log_templates,
        "op2_suffix_repetition": op2_suffix_repetition,
        "op3_subword_softmax": op3_subword_softmax,
        "op4_keyed_surrogates": op4_keyed_surrogates,
        "op5_soft_membership_mix": op5_soft_membership_mix,
        "op6_prefix_doubling": op6_prefix_doubling,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_minhash_bayes": op8_minhash_bayes,
        "op9_fm_index": op9_fm_index,
        "op10_crf_main_text": op10_crf_main_text,
    }


def oracle_sql() -> dict:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL, "op6_prefix_doubling": OP6_SQL, "op7_warc_derivatives": OP7_SQL, "op8_minhash_bayes": OP8_SQL, "op9_fm_index": OP9_SQL}
    return {name: text for name, text in sql.items() if text}
