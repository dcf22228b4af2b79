"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Part of the subpackage ``llm``."""

from __future__ import annotations

from zoomgraph.llm.common import cut, table
from zoomgraph.llm.decontaminate import stage_decontaminate
from zoomgraph.llm.language import stage_language
from zoomgraph.llm.mixing import stage_mixing
from zoomgraph.llm.ngram_join import stage_ngram_join
from zoomgraph.llm.sharding import stage_sharding

STAGES = [
    ("language_id", stage_language),
    ("ngram_join", stage_ngram_join),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: A trained classifier and graph components can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
