"""A training-data pipeline over `documents`: each stage's rows are written and read again as the next one's input.

All stages but the last return the columns of documents. Language ID drops documents without letters or below a
posterior of one half, near-dedup keeps one document of each group, decontamination drops documents that hold a
benchmark passage, mixing repeats or drops documents so that sources come near their targets, and the last stage
writes token ids and describes each document from the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.llm import decontaminate, language_id, mixing, near_dedup, queries, token_output
from tickwell.llm.common import WORD, discard, fresh, materialise


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs, F.lit(True))
    lang, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    told = language_id.identify(docs, model, lang_as=lang, score_as=score)
    return materialise(told.filter((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns), "languages")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of its smallest id, whatever rows repeat it. Documents without words are
    groups of their own.

    Rows of one id and text are merged in each task before they are dealt by both, so a text is shuffled once and not
    held twice; the groups' documents are then picked where these rows lie."""
    told = near_dedup.classified(docs).filter("doc_id <=> component_id AND th = kept_th").select("doc_id", "th").distinct()
    none, key, text_hash, row = (fresh(docs.columns, c) for c in ("_none", "_key", "_hash", "_row"))
    names = [none, key, text_hash]

    def keyed(df: DataFrame, hashed: Column, *rest: Column) -> DataFrame:
        own = F.col("doc_id").cast("long")  # plain equality, also of null ids, so that one dealing serves both steps
        return df.select(own.isNull().alias(none), F.coalesce(own, F.lit(0)).alias(key), hashed.alias(text_hash), *rest)

    order = F.struct(text_hash, *[c for c, kind in docs.dtypes if c != "text" and kind in ("string", "bigint", "int", "double", "boolean", "float", "date", "timestamp")])
    one = keyed(docs, F.xxhash64("text"), "*").groupBy(*names).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    one = one.join(keyed(told, F.col("th")), names, "left_semi").select(f"{row}.*")
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    return one.union(docs.filter(wordless))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    mixed = mixing.mix(docs, prefix=prefix)
    copies = F.explode(F.expr(f"array_repeat(0, CAST({prefix}copies AS int))"))
    return mixed.filter(f"{prefix}copies > 0").select(*docs.columns, copies.alias(prefix)).drop(prefix)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Stages with models and array files can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)  # the stage before; an input of one's own is left alone
    return STAGES[-1][1](spark, docs, sf_dir)
