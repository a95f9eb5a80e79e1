"""Scoring and banding applicants, and finding the papers they still owe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import scoring

# The papers an application needs, and the lines shown when none or some are missing.
REQUIRED_DOCS = ["passeport", "photos", "relevé_bancaire", "lettre_invitation", "preuve_linguistique"]
ALL_PRESENT = "Tous les documents requis sont présents!"
SOME_MISSING = "Documents manquants : "


def eligibility_score(applicants: DataFrame, jitter_seed: int | None = None) -> DataFrame:
    """``(applicant_id, score, error)``. An unknown diploma, or a missing age, mark or number of years, gives a NULL score and an error text.

    ``jitter_seed`` adds a draw from ±0.05 that depends on the applicant and
    the seed only; without it the score is exact.
    """
    score = scoring.weighted_score(
        F.col("age"), F.col("education"), F.col("language_score"), F.col("work_experience")
    )
    if jitter_seed is not None:
        width = scoring.JITTER_WIDTH
        score = score + scoring.hash_uniform(F.col("applicant_id"), jitter_seed) * F.lit(2 * width) - F.lit(width)
    unknown = scoring.education_factor(F.col("education")).isNull()
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("age", "language_score", "work_experience")]))
    return applicants.select(
        "applicant_id",
        F.when((F.size(missing) == 0) & ~unknown, scoring.clamp_unit(score)).alias("score"),
        F.when(unknown, F.concat(F.lit("unknown education: "), F.coalesce(F.col("education"), F.lit("NULL"))))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).alias("error"),
    )


def eligibility_band(scores: DataFrame) -> DataFrame:
    """``(applicant_id, score, band, percent)``."""
    return scores.select(
        "applicant_id", "score",
        scoring.band_of(F.col("score")).alias("band"),
        scoring.percent_text(F.col("score")).alias("percent"),
    )


def band_summary(banded: DataFrame) -> DataFrame:
    """Size and score range of each band. A handful of groups, combined before the shuffle."""
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def _missing_lists(applicants: DataFrame, submitted: DataFrame, required: Sequence[str]) -> DataFrame:
    """``(applicant_id, missing array)`` for every applicant, names in order.

    An applicant's set of papers holds required names only, so it is no larger
    than their list, and repeated names melt away before the shuffle; the join
    is one row to one row instead of applicants x papers.
    """
    names = sorted(set(required))
    held = submitted.filter(F.col("doc").isin(names)).groupBy("applicant_id").agg(F.collect_set("doc").alias("held"))
    return applicants.select("applicant_id").join(held, "applicant_id", "left").select(
        "applicant_id", missing_in_array(F.coalesce("held", F.array().cast("array<string>")), names).alias("missing"))


def missing_documents(applicants: DataFrame, submitted: DataFrame,
                      required: Sequence[str] = REQUIRED_DOCS) -> DataFrame:
    """``(applicant_id, doc)``: every required paper an applicant has not handed in. Other names are ignored."""
    lists = _missing_lists(applicants, submitted, required)
    return lists.select("applicant_id", F.explode("missing").alias("doc"))


def missing_in_array(documents: Column, required: Sequence[str] = REQUIRED_DOCS) -> Column:
    """The same difference where an applicant's papers are an array column."""
    return F.array_except(F.array(*[F.lit(name) for name in sorted(set(required))]), documents)


def completeness_report(applicants: DataFrame, submitted: DataFrame,
                        required: Sequence[str] = REQUIRED_DOCS) -> DataFrame:
    """``(applicant_id, n_missing, message)`` for every applicant, complete ones included."""
    lists = _missing_lists(applicants, submitted, required)
    return lists.select(
        "applicant_id",
        F.size("missing").alias("n_missing"),
        F.when(F.size("missing") == 0, F.lit(ALL_PRESENT))
        .otherwise(F.concat(F.lit(SOME_MISSING), F.array_join("missing", ", "))).alias("message"),
    )
