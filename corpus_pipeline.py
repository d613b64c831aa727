"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasheaf.llm import common, decontaminate, mixing, quality, simhash, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    name = common.free_name(docs, "_quality")
    return quality.quality_rules(docs, result_col=name).filter(f"{name}.kept").drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, of each group of texts alike in 80 % of their five-word shingles."""
    return simhash.keep_one(docs, simhash.similar_texts(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.drop_contaminated(docs, decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none, once or twice)."""
    return mixing.take(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) as read back from the ORC files."""
    return tokens.read_token_ids(spark, tokens.write_token_ids(docs, common.scratch(spark, "ids")))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix_sources), ("token_ids", token_ids)]

#: Mixing draws by hash and tokenizing has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote besides its result is removed once that is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.passing(spark) as keep:
            docs = keep(common.written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
