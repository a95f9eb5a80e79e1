"""Contact submissions: record check, accepted and rejected records, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The subjects on offer, and the e-mail form the HTML standard publishes.
SUBJECTS = ["evaluation", "information", "rendez-vous", "autre"]
EMAIL = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)
FIELDS = ["nom", "email", "telephone", "sujet", "message"]


def validate_submissions(submissions: DataFrame) -> DataFrame:
    """The records with ``reasons array<string>`` and ``valid``. ``telephone`` may be missing."""

    def blank(name: str):
        return F.coalesce(F.col(name), F.lit("")) == ""

    checks = [
        F.when(blank("nom"), F.lit("nom: missing")),
        F.when(blank("email"), F.lit("email: missing")).when(~F.col("email").rlike(EMAIL), F.lit("email: malformed")),
        F.when(~F.coalesce(F.col("sujet").isin(SUBJECTS), F.lit(False)), F.lit("sujet: unknown")),
        F.when(blank("message"), F.lit("message: missing")),
    ]
    return submissions.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn("valid", F.size("reasons") == 0)


def accepted_submissions(checked: DataFrame) -> DataFrame:
    """``(sub_id, payload)``: the JSON record that would be sent."""
    record = F.struct(*[F.coalesce(F.col(name), F.lit("")).alias(name) for name in FIELDS])
    return checked.filter("valid").select("sub_id", F.to_json(record).alias("payload"))


def rejected_submissions(checked: DataFrame) -> DataFrame:
    """``(sub_id, reasons)``."""
    return checked.filter(~F.col("valid")).select("sub_id", F.array_join("reasons", "; ").alias("reasons"))
