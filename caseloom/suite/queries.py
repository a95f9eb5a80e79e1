"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import cases, conversations, eligibility, intake, layout, pages, reports, tables, uploads
from caseloom.plans.store import fresh_path, stored
from caseloom.sources import files
from caseloom.streaming import ingest
from caseloom.suite import inputs as I

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- applicants -----------------------------------------------------------------------------------------------------

@query
def eligibility_score(spark, sf_dir):
    scores = eligibility.eligibility_score(I.applicants(spark, sf_dir))
    return scores.select("applicant_id", F.round("score", 6).alias("score"), "error")


@query
def eligibility_score_jitter(spark, sf_dir):
    scores = eligibility.eligibility_score(I.applicants(spark, sf_dir), jitter_seed=42)
    return scores.select("applicant_id", F.round("score", 6).alias("score"))


@query
def eligibility_band(spark, sf_dir):
    banded = eligibility.eligibility_band(eligibility.eligibility_score(I.applicants(spark, sf_dir)))
    return banded.select("applicant_id", "band", "percent")


@query
def band_summary(spark, sf_dir):
    banded = eligibility.eligibility_band(eligibility.eligibility_score(I.applicants(spark, sf_dir)))
    return eligibility.band_summary(banded).select(
        "band", "n", *[F.round(c, 6).alias(c) for c in ("mean_score", "min_score", "max_score")])


@query
def missing_documents(spark, sf_dir):
    return eligibility.missing_documents(I.applicants(spark, sf_dir), I.submitted(spark, sf_dir))


@query
def completeness_report(spark, sf_dir):
    return eligibility.completeness_report(I.applicants(spark, sf_dir), I.submitted(spark, sf_dir))


# --- conversations --------------------------------------------------------------------------------------------------

@query
def normalize_messages(spark, sf_dir):
    return conversations.normalize_messages(I.messages(spark, sf_dir))


def _line(message):
    return F.concat(message["role"], F.lit(": "), message["text"])


def _told(history):
    return conversations.told(history, _line)


@query
def conversation_context(spark, sf_dir):
    return conversations.conversation_context(I.messages(spark, sf_dir), line=_line)


@query
def sliding_context(spark, sf_dir):
    context = conversations.conversation_context(I.messages(spark, sf_dir), include_current=False, max_turns=3)
    return context.select("conv_id", "turn", _told(F.col("history")).alias("history"))


def _numbered(spark, sf_dir):
    return stored(conversations.numbered_messages(I.messages(spark, sf_dir)), "numbered")


@query
def history_blocks(spark, sf_dir):
    blocks = conversations.history_blocks(_numbered(spark, sf_dir), size=16)
    return blocks.select("conv_id", "block", _told(F.col("messages")).alias("told"))


@query
def history_pieces(spark, sf_dir):
    """The whole history of every user turn, in rows."""
    numbered = _numbered(spark, sf_dir)
    ranges = conversations.context_ranges(numbered, size=16)
    pieces = conversations.history_pieces(ranges, stored(conversations.history_blocks(numbered, size=16), "blocks"), line=_line)
    return pieces.select("conv_id", "turn", "block", F.col("messages").alias("told"))


@query
def build_prompt_with_ranges(spark, sf_dir):
    ranges = conversations.context_ranges(_numbered(spark, sf_dir), include_current=False, size=16)
    asked = conversations.prompts(ranges, I.conversation_docs(spark, sf_dir), I.table(spark, sf_dir, "documents"), I.PROMPT)
    return asked.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), "blocks", "tail")


@query
def build_prompt(spark, sf_dir):
    return conversations.build_prompt(
        I.messages(spark, sf_dir), I.conversation_docs(spark, sf_dir), I.table(spark, sf_dir, "documents"), I.PROMPT)


@query
def build_prompt_with_history(spark, sf_dir):
    asked = conversations.build_prompt(I.messages(spark, sf_dir), I.conversation_docs(spark, sf_dir), I.table(spark, sf_dir, "documents"),
                                       I.PROMPT, with_history=True, line=_line)
    return asked.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), "history")


@query
def build_prompt_tabular(spark, sf_dir):
    return conversations.build_prompt(I.messages(spark, sf_dir), I.conversation_docs(spark, sf_dir), I.table(spark, sf_dir, "documents"),
                                      I.PROMPT, ending=conversations.TABLE_ENDING)


@query
def export_transcript_md(spark, sf_dir):
    return conversations.export_transcript(I.messages(spark, sf_dir), "md")


@query
def export_transcript_html(spark, sf_dir):
    return conversations.export_transcript(I.messages(spark, sf_dir), "html")


@query
def export_transcript_rich(spark, sf_dir):
    return conversations.export_transcript(I.markdown_messages(spark, sf_dir), "rich")


@query
def transcript_pieces(spark, sf_dir):
    return conversations.transcript_pieces(I.messages(spark, sf_dir), "html")


@query
def export_message(spark, sf_dir):
    return conversations.export_message(I.messages(spark, sf_dir), "md")


@query
def append_messages(spark, sf_dir):
    added = conversations.report_messages(I.report_runs(spark, sf_dir))
    log = conversations.append_messages(I.messages(spark, sf_dir), added)
    return log.select("conv_id", "turn", "role", conversations.message_text().alias("text"))


# --- pages ----------------------------------------------------------------------------------------------------------

@query
def captured_pages(spark, sf_dir):
    return files.captured_pages(spark, f"{sf_dir.rstrip('/')}/pages.parquet")


@query
def extract_main_text(spark, sf_dir):
    return pages.extract_main_text(I.pages(spark, sf_dir))


@query
def main_text_by_blocks(spark, sf_dir):
    return pages.main_text_by_blocks(I.boxed_pages(spark, sf_dir))


@query
def extract_main_text_fallback(spark, sf_dir):
    return pages.extract_main_text(I.bare_pages(spark, sf_dir), fallback=F.col("other"))


@query
def extract_links(spark, sf_dir):
    return pages.extract_links(I.pages(spark, sf_dir))


@query
def resolve_links(spark, sf_dir):
    return pages.extract_links(I.pages(spark, sf_dir), mode="resolve")


@query
def crawl_frontier(spark, sf_dir):
    return pages.crawl_frontier(I.link_plan(spark, sf_dir))


@query
def crawl_join(spark, sf_dir):
    frontier = pages.crawl_frontier(I.link_plan(spark, sf_dir))
    return pages.crawl_join(frontier, pages.extract_main_text(I.pages(spark, sf_dir)))


@query
def pending_links(spark, sf_dir):
    return pages.pending_links(pages.link_status(I.link_plan(spark, sf_dir), I.pages(spark, sf_dir)))


@query
def crawl_coverage(spark, sf_dir):
    status = pages.link_status(I.link_plan(spark, sf_dir), I.pages(spark, sf_dir), dense=True)
    return pages.crawl_coverage(status).withColumn("progress", F.round("progress", 6))


def _accumulated(spark, sf_dir, links):
    # The texts are needed twice, for a page itself and for the links to it: the HTML is read once.
    texts = stored(pages.extract_main_text(I.pages(spark, sf_dir)), "page-texts")
    return pages.accumulate_text(texts, pages.crawl_join(pages.crawl_frontier(links), texts))


@query
def accumulate_text(spark, sf_dir):
    return _accumulated(spark, sf_dir, I.link_plan(spark, sf_dir))


@query
def report_context(spark, sf_dir):
    links = stored(I.link_plan(spark, sf_dir), "links")
    return pages.report_context(_accumulated(spark, sf_dir, links), links)


@query
def context_pieces(spark, sf_dir):
    links = stored(I.link_plan(spark, sf_dir), "links")
    texts = stored(pages.extract_main_text(I.pages(spark, sf_dir)), "page-texts")
    return pages.context_pieces(texts, pages.crawl_join(pages.crawl_frontier(links), texts), links).filter("text <> ''")


@query
def keyed_text_store(spark, sf_dir):
    texts = pages.keyed_texts(pages.extract_main_text(I.pages(spark, sf_dir)))
    path = fresh_path(spark, "texts")
    files.write_keyed_texts(texts, path)
    return spark.read.parquet(path).select("file_name", "page_id", "text")


@query
def keyed_text_runs(spark, sf_dir):
    """A run over all pages, then one over those of a later crawl, which has fewer addresses."""
    path = fresh_path(spark, "text-runs")
    captured = I.pages(spark, sf_dir)
    again = captured.filter("page_id % 3 = 0").withColumn("html", F.concat(F.lit("<p>again</p>"), "html"))
    for pages_of_run in (captured, again):
        files.append_keyed_texts(pages.keyed_texts(pages.extract_main_text(pages_of_run)), path)
    return files.latest_keyed_texts(spark, path).select("file_name", "page_id", "text", "version")


# --- reports --------------------------------------------------------------------------------------------------------

@query
def split_report(spark, sf_dir):
    return reports.split_report(I.responses(spark, sf_dir))


@query
def parse_report_json(spark, sf_dir):
    parsed = reports.parse_report_json(I.responses(spark, sf_dir))
    return parsed.select(
        "doc_id", "has_json", "ok", "raw", "error",
        F.get("report.sujets_principaux", F.lit(0)).alias("first_topic"),
        F.get("report.insights", F.lit(0))["insight"].alias("first_insight"),
    )


@query
def report_facts(spark, sf_dir):
    return reports.report_facts(reports.parse_report_json(I.responses(spark, sf_dir)))


@query
def theme_related_topics(spark, sf_dir):
    return reports.theme_related_topics(reports.parse_report_json(I.responses(spark, sf_dir)))


@query
def report_data_points(spark, sf_dir):
    return reports.report_data_points(reports.parse_report_json(I.responses(spark, sf_dir)))


@query
def quarantined_reports(spark, sf_dir):
    return reports.quarantined_reports(reports.parse_report_json(I.responses(spark, sf_dir)))


@query
def topic_counts(spark, sf_dir):
    return reports.topic_counts(reports.parse_report_json(I.responses(spark, sf_dir)))


# --- cases ----------------------------------------------------------------------------------------------------------

@query
def case_status_extract(spark, sf_dir):
    return cases.case_status_extract(I.status_pages(spark, sf_dir))


@query
def case_history(spark, sf_dir):
    return cases.case_history(I.status_pages(spark, sf_dir))


@query
def error_capture(spark, sf_dir):
    return cases.error_capture(I.status_pages(spark, sf_dir))


@query
def case_status(spark, sf_dir):
    shown = F.array_join("detail", "~", "<null>")
    return cases.case_status(I.status_pages(spark, sf_dir)).withColumn("detail", shown)


# --- uploads --------------------------------------------------------------------------------------------------------

@query
def upload_ingest(spark, sf_dir):
    return uploads.upload_ingest(I.uploads(spark, sf_dir))


@query
def content_dedup(spark, sf_dir):
    return uploads.content_dedup(uploads.upload_ingest(I.uploads(spark, sf_dir)))


@query
def route_by_format(spark, sf_dir):
    return uploads.route_by_format(I.uploads(spark, sf_dir))


@query
def upload_texts(spark, sf_dir):
    return uploads.upload_texts(I.csv_uploads(spark, sf_dir), I.upload_elements(spark, sf_dir))


def _arrive(path, parts):
    """Write the parts to the folder as they are scanned, each in as many files as that takes; how many files there are now."""
    for part in parts:
        part.write.mode("append").parquet(path)
    return len(parts[0].sparkSession.read.schema(parts[0].schema).parquet(path).inputFiles())


@query
def incremental_ingest(spark, sf_dir):
    arriving, store, checkpoint = (fresh_path(spark, label) for label in ("arriving", "store", "progress"))
    rows = I.uploads(spark, sf_dir).select("name", "content", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("file"))
    n = _arrive(arriving, [rows.filter(F.col("file") == part).drop("file") for part in range(4)])
    for _ in range(2):  # four batches; the second run finds nothing new
        found = ingest.arriving_rows(spark, arriving, "name string, content string", files_per_batch=-(-n // 4))
        ingest.incremental_ingest(found, store, checkpoint).awaitTermination()
    return ingest.ingest_store(spark, store).select("md5", "ext", "copies")


@query
def emit_once(spark, sf_dir):
    """Two batches; then, after a restart, one with late copies of a third of the files under other names."""
    arriving, store, checkpoint = (fresh_path(spark, label) for label in ("arriving", "store", "progress"))
    rows = I.uploads(spark, sf_dir).select("doc_id", "name", "content", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("file"))
    early = [rows.filter(kept).select("name", "content") for kept in ("file in (0, 2)", "file = 1")]
    late = rows.filter("file = 3 or doc_id % 3 = 0").select(F.concat(F.lit("again-"), "name").alias("name"), "content")
    seen = 0
    for arrived in (early, [late]):
        n = _arrive(arriving, arrived)
        found = ingest.arriving_rows(spark, arriving, "name string, content string", files_per_batch=-(-(n - seen) // len(arrived)))
        ingest.emit_once(found, store, checkpoint, partitions=2).awaitTermination()
        seen = n
    return ingest.emitted(spark, store).select("md5", "ext", "stored_name")


# --- tables ---------------------------------------------------------------------------------------------------------

def _part_table(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@query
def table_to_markdown(spark, sf_dir):
    return tables.table_to_markdown(_part_table(spark, sf_dir), index="p_partkey")


@query
def tables_to_markdown(spark, sf_dir):
    return tables.tables_to_markdown(tables.parse_table_rows(I.table_texts(spark, sf_dir)))


@query
def table_records(spark, sf_dir):
    records = tables.table_records(tables.parse_table_rows(I.mixed_table_texts(spark, sf_dir)))
    return records.select("table_id", "row_no", F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "~").alias("record"))


@query
def table_schemas(spark, sf_dir):
    return tables.table_schemas(tables.parse_table_rows(I.mixed_table_texts(spark, sf_dir)))


@query
def typed_columns(spark, sf_dir):
    records = tables.table_records(tables.parse_table_rows(I.mixed_table_texts(spark, sf_dir)))
    return tables.typed_columns(records, {"p_partkey": "long", "p_size": "int", "x": "string", "a.1#2": "int"}).withColumnRenamed("a.1#2", "a_1_2")


@query
def csv_export(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = I.table(spark, sf_dir, "documents").selectExpr("doc_id", "nullif(lang, 'de') as lang", "text")
    files.csv_export(rows, path)
    back = files.csv_scan(spark, path, "doc_id long, lang string, text string", keep_bad_rows=False, multi_line=True)
    return back.select("doc_id", "lang", "text")


@query
def csv_export_numbered(spark, sf_dir):
    """Ragged rows under headers that are numbers, as many as the widest row needs."""
    path = fresh_path(spark, "csv")
    files.csv_export(tables.padded_columns(I.cell_rows(spark, sf_dir), ["row_no"]), path)
    back = files.csv_scan(spark, path, 'row_no long, `0` string, `1` string, `2` string', keep_bad_rows=False)
    return back.select("row_no", *[F.col(f"`{i}`").alias(f"c{i}") for i in range(3)])


@query
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv")
    files.csv_export(_part_table(spark, sf_dir), path)
    return files.csv_scan(spark, path).select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"))


@query
def csv_to_markdown(spark, sf_dir):
    """A CSV file as the pipe table that a prompt holds."""
    path = fresh_path(spark, "csv")
    files.csv_export(_part_table(spark, sf_dir).orderBy("p_partkey"), path)
    scanned = files.csv_scan(spark, path, "p_partkey long, p_name string, p_brand string, p_size int", keep_bad_rows=False)
    return tables.table_to_markdown(files.with_row_index(scanned), index="row_no")


@query
def detect_delimiter(spark, sf_dir):
    return tables.detect_delimiter(I.table_texts(spark, sf_dir))


@query
def parse_table_text(spark, sf_dir):
    return tables.parse_table_text(I.table_texts(spark, sf_dir))


@query
def construct_table(spark, sf_dir):
    return tables.construct_table(tables.parse_table_rows(I.table_texts(spark, sf_dir)))


@query
def wide_table(spark, sf_dir):
    parsed = tables.parse_table_rows(I.table_texts(spark, sf_dir))
    return tables.wide_table(parsed, ["part_key", "name", "size"]).select("table_id", "part_key", "name", "size")


@query
def overlong_rows(spark, sf_dir):
    found = tables.overlong_rows(tables.parse_table_rows(I.table_texts(spark, sf_dir)))
    return found.withColumn("cells", F.array_join("cells", "~"))


@query
def preview(spark, sf_dir):
    parsed = tables.parse_table_rows(I.table_texts(spark, sf_dir))
    table = tables.wide_table(parsed, ["part_key", "name", "size"])
    return tables.preview(table, 5, order=["table_id", "row_no"]).select("table_id", "part_key", "name", "size")


@query
def render_table_rows(spark, sf_dir):
    return tables.render_table_rows(I.order_tables(spark, sf_dir), "doc_id", "page_no", "table_no")


@query
def map_string_columns(spark, sf_dir):
    rows = tables.padded_columns(I.cell_rows(spark, sf_dir), ["row_no"], width=3)
    named = rows.select("row_no", *[F.col(str(i)).alias(f"c{i}") for i in range(3)])
    return tables.map_string_columns(named, lambda c: F.concat(F.reverse(c), F.lit("*")))


# --- page layout ----------------------------------------------------------------------------------------------------

@query
def select_pages(spark, sf_dir):
    rows = layout.select_pages(I.cell_rows(spark, sf_dir), page_ids=[0, 1])
    return rows.select("doc_id", "page_no", "row_no")


@query
def collect_tables(spark, sf_dir):
    rows = layout.collect_tables(I.order_tables(spark, sf_dir), 1, 4)
    shown = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("<null>"))), "~")
    return rows.select("doc_id", "page_no", "table_no", "row_no", shown.alias("cells"))


@query
def normalize_line_text(spark, sf_dir):
    return layout.normalize_line_text(I.table(spark, sf_dir, "documents"), "doc_id")


@query
def page_reading_order(spark, sf_dir):
    ordered = layout.page_reading_order(I.elements(spark, sf_dir))
    return ordered.select("doc_id", "page_no", "elem_no", F.col("reading_order").cast("long").alias("reading_order"))


def _assembled(spark, sf_dir, **options):
    return layout.assemble_page(
        I.elements(spark, sf_dir), I.page_tables(spark, sf_dir), I.page_boxes(spark, sf_dir), **options)


@query
def assemble_page(spark, sf_dir):
    return _assembled(spark, sf_dir).select("doc_id", "page_no", "content", "error")


@query
def assemble_page_text_only(spark, sf_dir):
    return _assembled(spark, sf_dir, table=False).select("doc_id", "page_no", "content", "error")


@query
def page_pieces(spark, sf_dir):
    return layout.page_pieces(I.elements(spark, sf_dir), I.page_tables(spark, sf_dir), I.page_boxes(spark, sf_dir), spread=True, chunk=50)


@query
def assemble_document(spark, sf_dir):
    return layout.assemble_document(_assembled(spark, sf_dir))


@query
def document_pieces(spark, sf_dir):
    return layout.document_pieces(_assembled(spark, sf_dir))


# --- intake ---------------------------------------------------------------------------------------------------------

@query
def validate_submissions(spark, sf_dir):
    checked = intake.validate_submissions(I.submissions(spark, sf_dir))
    return checked.select("sub_id", "valid", F.array_join("reasons", "; ").alias("reasons"))


@query
def rejected_submissions(spark, sf_dir):
    return intake.rejected_submissions(intake.validate_submissions(I.submissions(spark, sf_dir)))


@query
def accepted_submissions(spark, sf_dir):
    return intake.accepted_submissions(intake.validate_submissions(I.submissions(spark, sf_dir)))
