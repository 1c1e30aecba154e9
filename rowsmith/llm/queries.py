"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from rowsmith.llm.bpe import op8_bpe
from rowsmith.llm.common import ship
from rowsmith.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from rowsmith.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from rowsmith.llm.lm_scoring import op4_lm_scoring
from rowsmith.llm.mixing import op6_mix_sources
from rowsmith.llm.ngram_join import OP3_SQL, op3_ngram_join
from rowsmith.llm.quality import op5_quality
from rowsmith.llm.sharding import op7_shard
from rowsmith.llm.toxicity import op1_toxicity
from rowsmith.llm.warc import OP9_SQL, op9_warc


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (op1_toxicity, op2_exact_dedup, op3_ngram_join, op4_lm_scoring, op5_quality, op6_mix_sources, op7_shard, op8_bpe, op9_warc, op10_embedding_dedup)
}

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op9_warc": OP9_SQL, "op10_embedding_dedup": OP10_SQL}
