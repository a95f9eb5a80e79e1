"""Eligibility score of one applicant as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Points per diploma, weights per factor, top marks.
EDUCATION_POINTS = {"Secondaire": 0.4, "Baccalauréat": 0.5, "Master": 0.7, "Doctorat": 1.0}
WEIGHTS = {"age": 0.25, "education": 0.3, "language": 0.3, "experience": 0.25}
TOP_LANGUAGE_MARK = 9
TOP_EXPERIENCE_YEARS = 6
JITTER_WIDTH = 0.05

# Lower edge of each band, best first.
BAND_EDGES = [("top", 0.8), ("good", 0.6), ("medium", 0.3)]
LOWEST_BAND = "limited"


def age_factor(age: Column) -> Column:
    """Full marks from 18 to 35, then five points in a hundred less per year up to 47."""
    return (
        F.when(age.between(18, 35), F.lit(1.0))
        .when(age.between(36, 47), 1 - (age - 35) * F.lit(0.05))
        .otherwise(F.lit(0.0))
    )


def education_factor(education: Column) -> Column:
    """NULL for a diploma that is not on the list."""
    points = F.lit(None).cast("double")
    for diploma, value in EDUCATION_POINTS.items():
        points = F.when(education == diploma, F.lit(value)).otherwise(points)
    return points


def capped_share(amount: Column, full: int) -> Column:
    return F.when(amount.isNotNull(), F.least(amount.cast("double") / F.lit(float(full)), F.lit(1.0)))


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, so a retried task draws it again."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_score(age: Column, education: Column, language: Column, experience: Column) -> Column:
    """Weighted sum of the four factors. The weights add up to 1.10."""
    return (
        age_factor(age) * F.lit(WEIGHTS["age"])
        + education_factor(education) * F.lit(WEIGHTS["education"])
        + capped_share(language, TOP_LANGUAGE_MARK) * F.lit(WEIGHTS["language"])
        + capped_share(experience, TOP_EXPERIENCE_YEARS) * F.lit(WEIGHTS["experience"])
    )


def clamp_unit(value: Column) -> Column:
    """Into [0, 1]; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def band_of(score: Column) -> Column:
    name = F.when(score.isNull(), F.lit(None).cast("string"))
    for band, edge in BAND_EDGES:
        name = name.when(score >= edge, band)
    return name.otherwise(LOWEST_BAND)


def percent_text(score: Column) -> Column:
    return F.when(score.isNotNull(), F.format_string("%.2f%%", score * 100))
