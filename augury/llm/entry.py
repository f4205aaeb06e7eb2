"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from augury.llm import bpe, chat, decontamination, language_id, line_dedup, merkle, near_duplicates, quality_classifier, quality_rules, sharding, toxicity, vector_codes, warc  # noqa: F401
from augury.llm.common import ORACLES, QUERIES


def load():
    return QUERIES, ORACLES
