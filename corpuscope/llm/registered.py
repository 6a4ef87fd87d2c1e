"""What the entry points register: the numbered queries and the pipeline."""

import corpus_pipeline
from corpuscope.llm.queries import LLM_ORACLES, LLM_QUERIES

LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
