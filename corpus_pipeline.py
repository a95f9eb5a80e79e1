"""From raw documents to token files: five stages, each on what its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame

from caseloom.llm import decontaminate, language, mixing, simhash, token_files
from caseloom.llm.suite import TOKENIZER
from caseloom.llm.tables import read
from caseloom.plans.store import given_paths, remove_paths, stored

#: Of a chain of stages, by thread and tables, what the stage before wrote on its way.
_left: dict[tuple, list[str]] = {}


def _stage(work: Callable) -> Callable:
    """A stage that begins by removing what its predecessor wrote on the way: that one's result is written by now.

    The first stage removes nothing, and what the last one wrote stays, as its
    result reads it: results of several runs can be open side by side.
    """

    @wraps(work)
    def run_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        chain = (get_ident(), sf_dir)
        before = _left.pop(chain, [])
        if work.__name__ != STAGES[0][0]:
            remove_paths(spark, before)
        with given_paths() as made:
            result = work(spark, docs, sf_dir)
        if work.__name__ != STAGES[-1][0]:
            _left[chain] = made
        return result

    return run_stage


@_stage
def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, NULL ones, and those with no trigram of any learned language go."""
    return language.keep_identified(docs)


@_stage
def simhash_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most three differing bits: of each group the document with the smallest id stays."""
    return simhash.keep_one_per_group(docs)


@_stage
def benchmark_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in twenty inside a 13-word passage of ``benchmark`` go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


@_stage
def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for every epoch in which a document gives words."""
    return mixing.mixed_texts(docs)


@_stage
def token_output(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, told from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_files.token_output(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Fingerprints, hashed permutations and token ids are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
