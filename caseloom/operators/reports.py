"""Model replies: summary and JSON apart, strict check, nested facts as rows. Row-local throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions import reports as R

PARSE_ERROR = "Failed to parse JSON. Raw output:"


def split_report(responses: DataFrame) -> DataFrame:
    """``(doc_id, summary, json_part)``; ``json_part`` is NULL when the reply holds no fenced JSON."""
    return responses.select(
        "doc_id",
        R.summary_part(F.col("response")).alias("summary"),
        R.json_text(R.raw_json_part(F.col("response"))).alias("json_part"),
    )


def parse_report_json(responses: DataFrame) -> DataFrame:
    """``(doc_id, summary, has_json, ok, report, raw, error)``.

    ``ok`` iff the JSON part is exactly one JSON value. A valid value of another
    shape is ok with NULL fields. A broken part is kept in ``raw`` beside the
    error text; a reply without a fence has neither.
    """
    raw = R.raw_json_part(F.col("response"))
    split = responses.select(
        "doc_id", R.summary_part(F.col("response")).alias("summary"), raw.alias("__raw"), R.json_text(raw).alias("__js")
    )
    checked = split.withColumn("ok", R.is_one_json_value(F.col("__js")))
    broken = F.col("__js").isNotNull() & ~F.col("ok")
    return checked.select(
        "doc_id", "summary",
        F.col("__js").isNotNull().alias("has_json"), "ok",
        F.when(F.col("ok"), R.typed_report(F.col("__js"))).alias("report"),
        F.when(broken, F.col("__raw")).alias("raw"),
        F.when(broken, F.lit(PARSE_ERROR)).alias("error"),
    )


def good_reports(parsed: DataFrame) -> DataFrame:
    return parsed.filter("ok").select("doc_id", "summary", "report")


def quarantined_reports(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("doc_id", "raw", "error")


def report_topics(parsed: DataFrame) -> DataFrame:
    """``(doc_id, pos, topic)``."""
    return parsed.filter("ok").select("doc_id", F.posexplode(F.col("report.sujets_principaux")).alias("pos", "topic"))


def report_themes(parsed: DataFrame) -> DataFrame:
    """``(doc_id, pos, theme, description, related)``."""
    rows = parsed.filter("ok").select("doc_id", F.posexplode(F.col("report.`thèmes_clés`")).alias("pos", "t"))
    return rows.select("doc_id", "pos", F.col("t.`thème`").alias("theme"), F.col("t.description").alias("description"),
                       F.col("t.sujets_connexes").alias("related"))


def theme_related_topics(parsed: DataFrame) -> DataFrame:
    """``(doc_id, pos, theme, related_pos, topic)``."""
    return report_themes(parsed).select("doc_id", "pos", "theme", F.posexplode("related").alias("related_pos", "topic"))


def report_data_points(parsed: DataFrame) -> DataFrame:
    """``(doc_id, pos, data_point, context, source)``."""
    rows = parsed.filter("ok").select(
        "doc_id", F.posexplode(F.col("report.`points_de_données_significatifs`")).alias("pos", "p"))
    return rows.select("doc_id", "pos", F.col("p.`point_de_donnée`").alias("data_point"),
                       F.col("p.contexte").alias("context"), F.col("p.source").alias("source"))


def report_insights(parsed: DataFrame) -> DataFrame:
    """``(doc_id, pos, insight, explanation)``."""
    rows = parsed.filter("ok").select("doc_id", F.posexplode(F.col("report.insights")).alias("pos", "i"))
    return rows.select("doc_id", "pos", F.col("i.insight").alias("insight"), F.col("i.explication").alias("explanation"))


def topic_counts(parsed: DataFrame) -> DataFrame:
    """``(topic, n_reports)``; counted before the shuffle, so a topic in most reports costs one row per task."""
    return (
        parsed.filter("ok")
        .select("doc_id", F.explode(F.array_distinct(F.col("report.sujets_principaux"))).alias("topic"))
        .groupBy("topic").agg(F.count(F.lit(1)).alias("n_reports"))
    )


def report_facts(parsed: DataFrame) -> DataFrame:
    """``(doc_id, kind, pos, name, detail, source)``: all four kinds of facts as one relation, in one pass."""
    report = F.col("report")

    def facts(items, kind, name, detail, source=None):
        return F.transform(
            F.coalesce(items, F.array().cast(f"array<{item_types[kind]}>")),
            lambda item, pos: F.struct(
                F.lit(kind).alias("kind"), pos.alias("pos"), name(item).alias("name"), detail(item).alias("detail"),
                (source(item) if source else F.lit(None).cast("string")).alias("source"),
            ),
        )

    item_types = {
        "topic": "string",
        "theme": "struct<`thème`:string,`description`:string,`sujets_connexes`:array<string>>",
        "data_point": "struct<`point_de_donnée`:string,`contexte`:string,`source`:string>",
        "insight": "struct<`insight`:string,`explication`:string>",
    }
    none = F.lit(None).cast("string")
    every = F.concat(
        facts(report["sujets_principaux"], "topic", lambda i: i, lambda i: none),
        facts(report["thèmes_clés"], "theme", lambda i: i["thème"], lambda i: i["description"]),
        facts(report["points_de_données_significatifs"], "data_point", lambda i: i["point_de_donnée"],
              lambda i: i["contexte"], lambda i: i["source"]),
        facts(report["insights"], "insight", lambda i: i["insight"], lambda i: i["explication"]),
    )
    return parsed.filter("ok").select("doc_id", F.inline(every))
