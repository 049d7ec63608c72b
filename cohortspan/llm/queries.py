"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers

from ..runtime import scratch_path
from . import (
    decontamination,
    hard_negatives,
    jaccard_join,
    language_model,
    mixing,
    secret_scan,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    token_files,
    top_k,
    toxicity,
)
from .common import table
from .oracles import ORACLES as ORACLES

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op2_mix_sources(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query
def op3_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_token_files(spark, folder):
    tokens = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), tokens, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, tokens)


@query
def op5_toxicity(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op7_lm_score(spark, folder):
    return language_model.scores(table(spark, folder, "documents"))


@query
def op8_top_k(spark, folder):
    return top_k.top_k(table(spark, folder, "embeddings"))


@query
def op9_decontaminate(spark, folder):
    found = decontamination.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_key")


@query
def op10_shards(spark, folder):
    return sharding.shards(table(spark, folder, "documents"))


@query
def op11_hard_negatives(spark, folder):
    return hard_negatives.mine(table(spark, folder, "embeddings"))


@query
def op12_ngram_jaccard(spark, folder):
    return jaccard_join.similar_sets(table(spark, folder, "documents"))


@query
def op13_spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))
