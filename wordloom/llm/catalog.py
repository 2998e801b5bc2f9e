"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import ann, audit, bpe, chat, collocations, ctw, jaccard, lines, mixing, pages, quality, substrings, toxicity
from wordloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "REGISTRY"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(body: Query) -> Query:
        REGISTRY[name] = body
        return body

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query("op2_ann")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op3_chat")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat.example_turns(turns))
    return chat.digests(chat.render(chat.fold(chat.turn_events(turns))))


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


@query("op6_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(load(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.sized(load(spark, sf_dir, "documents")))


@query("op8_substrings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(load(spark, sf_dir, "documents"))


@query("op9_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(load(spark, sf_dir, "documents"))


@query("op10_pages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(load(spark, sf_dir, "pages"))


@query("op11_audit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op12_ctw")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(load(spark, sf_dir, "documents"))


@query("op13_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))
