"""Secrets in texts: candidate strings, and a random forest that takes the false ones out.

A candidate is a run of sixteen or more characters of a key; a word of a line can
have several. A JSON web token is one candidate with all its parts. A name before
``=`` or ``:`` is no candidate, but belongs to what stands around the value.
What a candidate is like - length, changes between kinds of characters, how much of it
dictionary words cover, whether it looks like a path and what stands next to it -
goes to a random forest trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import ROW, stored_with_row
from caseloom.plans.store import stored

KEY = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
NAME = r"[A-Za-z_\-]+(?:[0-9]{1,2}[A-Za-z_\-]*)?[\"'`]?[=:][\"'`]?[A-Za-z0-9+/_\-]"   # a variable or a member, and the first character of its value
WEB_TOKEN = r"eyJ[A-Za-z0-9_\-]{13,}(?:\.[A-Za-z0-9_\-]+){1,4}"
RUN = rf"(?<![A-Za-z0-9+/_\-])(?!{NAME})(?:{WEB_TOKEN}|{KEY})"
MAX_FINDINGS = 2000      # labelled findings per label that are learned from
DICTIONARY = 2000        # most frequent words, the pieces of which count as dictionary
NEAR = 3                 # neighbouring words on each side
SECRET_AT = 0.5

# Words that stand before secrets, and words that stand around examples.
CREDENTIAL = r"(?i)(api|access|auth|private|secret|client)?[_\-]?(key|token|secret|password|passwd|pwd|credential|bearer|apikey)\b"
EXAMPLE = r"(?i)(?<![\w.@])(example|sample|dummy|test|placeholder|changeme|xxx+|fake|todo)\b(?!\.\w)"

FEATURES = ["length", "changes", "distinct", "digits", "upper", "vowels", "hex_only", "covered", "slashes", "like_path", "credential", "assigned",
            "quoted", "example", "test_place"]


def candidates(docs: DataFrame, text: str, place: Column, carry: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Stored documents ``(row, carry, found)`` and candidates ``(row, line_no, word_no, run_no, place, value, before, word, after)``.

    Only lines that have a candidate are taken apart; ``before`` and ``after`` are the
    neighbouring words in the line. ``word`` is the candidate's part of its word: what
    follows the candidate before it, and behind the last one the rest.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("x")))
    own = docs.select(*carry, place.alias("place"), F.filter(lines, lambda p: p["x"].rlike(RUN)).alias("l"))
    exploded = own.withColumn("l", F.transform("l", lambda l: F.struct(l["no"].alias("no"), F.split(l["x"], r"[ \t\r\f\x0B]+").alias("w"))))
    near = exploded.withColumn("words", F.flatten(F.transform("l", lambda l: F.transform(
        F.filter(F.transform(l["w"], lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike(RUN)),
        lambda p: F.struct(
            l["no"].alias("line_no"), p["i"].alias("word_no"), F.regexp_extract_all(p["x"], F.lit(RUN), F.lit(0)).alias("values"), F.split(p["x"], RUN).alias("around"),
            F.array_join(F.slice(l["w"], F.greatest(F.lit(1), p["i"] + 1 - NEAR), F.least(p["i"], F.lit(NEAR))), " ").alias("before"),
            F.array_join(F.slice(l["w"], p["i"] + 2, F.lit(NEAR)), " ").alias("after"))))))
    near = near.withColumn("found", F.flatten(F.transform("words", lambda p: F.transform(p["values"], lambda v, k: F.struct(
        p["line_no"], p["word_no"], k.alias("run_no"), v.alias("value"),
        F.concat(p["around"][k], v, F.when(k == F.size(p["values"]) - 1, p["around"][k + 1]).otherwise("")).alias("word"),
        p["before"], p["after"])))))
    scanned = stored_with_row(near.drop("l", "words"), "candidates")
    return scanned, scanned.select(ROW, "place", F.inline("found"))


def dictionary_pieces(docs: DataFrame, text: str, size: int = DICTIONARY) -> DataFrame:
    """``(piece)``: all runs of three letters in the ``size`` most frequent words of four or more letters of all texts."""
    words = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))
    top = docs.select(words.alias("word")).filter(F.length("word").between(4, 15)).groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return top.select(F.explode(_threes(F.col("word"))).alias("piece")).distinct()


def _threes(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - 2)), lambda i: F.substring(value, i, F.lit(3)))


def with_features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``. ``covered`` is worked out once per distinct value."""
    values = found.select("value").distinct()
    low = F.lower(F.col("value"))
    parts = values.select("value", F.explode(_threes(low)).alias("piece"))
    covered = parts.join(F.broadcast(pieces.withColumn("known", F.lit(1))), "piece", "left").groupBy("value").agg(  # at most 13 a dictionary word
        F.avg(F.coalesce("known", F.lit(0)).cast("double")).alias("covered"))

    def part(pattern):
        return F.regexp_count("value", F.lit(pattern)).cast("double") / F.length("value")

    made = {
        "length": F.length("value").cast("double"),
        "changes": part(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "digits": part("[0-9]"), "upper": part("[A-Z]"), "vowels": part("[aeiouAEIOU]"),
        "hex_only": F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "slashes": part("/"),
        "like_path": (F.col("word").rlike(r"^(https?:|/|\./|[A-Za-z]:\\)") | F.col("word").rlike(r"\.[a-z]{2,4}$")).cast("double"),
        "credential": (F.col("before").rlike(CREDENTIAL) | F.col("word").rlike(CREDENTIAL)).cast("double"),
        "assigned": (F.col("before").rlike(r"[=:]$") | F.col("word").rlike(r"^[^=:]*[=:]")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "example": F.concat_ws(" ", "before", "word", "after").rlike(EXAMPLE).cast("double"),
        "test_place": F.coalesce(F.col("place"), F.lit("")).rlike(r"(?i)test|spec|example|fixture|docs?/").cast("double"),
    }
    return found.join(covered, "value").withColumns(made)


def rule_labelled(featured: DataFrame) -> DataFrame:
    """Findings that two independent signs agree on, with ``label``.

    1: assigned to a credential word, with letters and digits mixed. 0: nothing is
    assigned and the string is letters only, or digits only, or an example. All others
    have no label.
    """
    mixed = (F.col("digits") > 0.1) & (F.col("digits") < 0.95) & (F.col("distinct") * F.col("length") >= 8)
    yes = (F.col("credential") == 1) & (F.col("assigned") == 1) & (F.col("example") == 0) & mixed
    no = (F.col("credential") == 0) & ((F.col("digits") == 0) | (F.col("digits") == 1)) | (F.col("example") == 1)
    return featured.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).filter("label is not null")


def train_forest(labelled: DataFrame, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from findings with ``FEATURES`` and ``label``; None unless both labels are there.

    Of each label at most ``max_findings`` distinct ones count, those with the lowest hash.
    """
    picked = None
    rows = labelled.select("value", "before", *FEATURES, "label").dropDuplicates(["value", "before", "label"])
    for label in (0.0, 1.0):
        some = rows.filter(F.col("label") == label).withColumn("h", F.xxhash64("value", "before")).orderBy("h", "value", "before").limit(max_findings)
        picked = some if picked is None else picked.union(some)
    picked = stored(picked.orderBy("label", "h", "value", "before").coalesce(1), "findings")  # one order, so that the same forest grows again
    if picked.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(picked.coalesce(1))
    return RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=42).fit(vectors)


def scored(featured: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """``featured`` with ``score``, the forest's probability of a secret; without a forest, what the rules say."""
    if forest is None:
        return featured.withColumn("score", ((F.col("credential") == 1) & (F.col("assigned") == 1) & (F.col("example") == 0)).cast("double"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured)
    return forest.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def find_secrets(docs: DataFrame, text: str, place: Column, carry: list[Column], findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored documents and their candidates with ``score`` and ``secret``.

    ``findings`` are labelled findings (``candidates`` with ``FEATURES`` and ``label``);
    without them those that the rules agree on are the labelled ones.
    """
    scanned, found = candidates(docs, text, place, carry)
    pieces = stored(dictionary_pieces(docs, text), "dictionary")
    featured = stored(with_features(found, pieces), "featured")
    forest = train_forest(rule_labelled(featured) if findings is None else findings)
    judged = scored(featured, forest).select(ROW, "line_no", "word_no", "run_no", "place", "value", "before", "after", "score")
    return scanned, judged.withColumn("secret", F.col("score") >= SECRET_AT)


def secret_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", place: str = "source") -> DataFrame:
    """One row per document: ``doc_id, n_candidates, n_secrets, best_score, secrets_sha256``.

    ``secrets_sha256`` is the digest of the secrets in their order, line-feed-joined, so
    that results hold no secret; it is empty without any, and ``best_score`` NULL without
    candidates. NULL and empty texts have no candidates. Each row is a document; an
    empty table gives no rows; other columns play no part.
    """
    where = F.col(place).cast("string") if place in docs.columns else F.lit("")
    scanned, judged = find_secrets(docs, text, where, [F.col(id_col).alias("id")])
    order = F.array_sort(F.collect_list(F.when(F.col("secret"), F.struct("line_no", "word_no", "run_no", "value"))))
    by_row = judged.groupBy(ROW).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("secret").cast("long")).alias("n_secrets"), F.max("score").alias("best_score"),
        F.array_join(F.transform(order, lambda s: s["value"]), "\n").alias("all"))
    return scanned.select(ROW, "id").join(by_row, ROW, "left").select(
        F.col("id").alias("doc_id"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"), F.round("best_score", 6).alias("best_score"),
        F.when(F.col("n_secrets") > 0, F.sha2("all", 256)).otherwise("").alias("secrets_sha256"))


def without_secrets(docs: DataFrame, text: str = "text", place: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret found replaced by ``mark``."""
    where = F.col(place).cast("string") if place in docs.columns else F.lit("")
    scanned, judged = find_secrets(docs, text, where, [F.struct(*docs.columns).alias("doc")])
    values = judged.filter("secret").groupBy(ROW).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("values"))
    clean = F.aggregate(F.coalesce("values", F.array().cast("array<string>")), F.col(f"doc.`{text}`"), lambda t, v: F.replace(t, v, F.lit(mark)))
    rows = scanned.join(values, ROW, "left").withColumn("clean", clean)
    return rows.select(*[F.col("clean").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
