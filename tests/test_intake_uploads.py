import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import intake, uploads
from caseloom.plans import store as S
from caseloom.sources import files
from caseloom.streaming import ingest
from caseloom.suite import inputs as I, queries as suite


def test_submissions(spark, rows):
    df = spark.createDataFrame([
        (1, "A", "a@b.org", None, "autre", "hi"), (2, "", "a@b", "1", "evaluation", "x"), (3, "A", "bad", None, "information", "x"),
        (4, "A", None, None, "other", None), (5, "A", "a b@c.d", None, None, "x")], schemas.SUBMISSIONS)
    checked = intake.validate_submissions(df)
    assert rows(intake.rejected_submissions(checked)) == [
        (2, "nom: missing"), (3, "email: malformed"), (4, "email: missing; sujet: unknown; message: missing"),
        (5, "email: malformed; sujet: unknown")]
    good = intake.accepted_submissions(checked).collect()
    assert [(r.sub_id, json.loads(r.payload)) for r in good] == [
        (1, {"nom": "A", "email": "a@b.org", "telephone": "", "sujet": "autre", "message": "hi"})]


def test_ingest_and_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a.pdf", "x"), (2, "b.pdf", "x"), (3, "c.csv", "x"), (4, "noext", "y"), (5, "d.tar.gz", "z"),
                                (6, "E.PDF", "q")], schemas.UPLOADS)
    got = {r.doc_id: r.stored_name for r in uploads.upload_ingest(df).collect()}
    digest = hashlib.md5(b"x").hexdigest()
    assert got[1] == got[2] == digest + ".pdf" and got[3] == digest + ".csv"
    assert got[4].endswith(".noext") and got[5].endswith(".gz")
    copies = {(r.md5, r.ext): (r.doc_id, r.copies) for r in uploads.content_dedup(uploads.upload_ingest(df)).collect()}
    assert copies[digest, "pdf"] == (1, 2) and len(copies) == 5
    routes = {r.doc_id: r.route for r in uploads.route_by_format(df).collect()}
    assert routes == {1: "text", 2: "text", 3: "table", 4: None, 5: None, 6: None}


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_files_are_stored_once_also_after_a_restart(spark, tmp_path, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")

    def run():
        arrivals = ingest.arriving_files(spark, str(inbox), files_per_batch=2)
        ingest.incremental_ingest(arrivals, store, progress).awaitTermination()
        return rows(ingest.ingest_store(spark, store), "md5", "ext")

    put(inbox, "a.pdf", b"one")
    put(inbox, "b.pdf", b"one")
    put(inbox, "c.csv", b"one")
    one = hashlib.md5(b"one").hexdigest()
    assert run() == [(one, "csv"), (one, "pdf")]
    assert run() == [(one, "csv"), (one, "pdf")]
    put(inbox, "d.pdf", b"one")
    put(inbox, "e.pdf", b"two")
    assert len(run()) == 3
    listed = {r.name: bytes(r.content) for r in files.uploaded_files(spark, str(inbox)).collect()}
    assert listed["e.pdf"] == b"two" and len(listed) == 5


def counted(spark, store):
    return {(r.md5, r.ext): r.copies for r in ingest.ingest_store(spark, store).collect()}


def test_copies_add_up_over_batches_restarts_and_checkpoints(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = str(tmp_path / "store")
    one, two = hashlib.md5(b"one").hexdigest(), hashlib.md5(b"two").hexdigest()

    def run(checkpoint, folder=inbox):
        found = ingest.arriving_files(spark, str(folder), files_per_batch=1)
        ingest.incremental_ingest(found, store, str(tmp_path / checkpoint)).awaitTermination()
        return counted(spark, store)

    for i in range(3):
        put(inbox, f"{i}.pdf", b"one")
    assert run("first") == {(one, "pdf"): 3}
    put(inbox, "3.pdf", b"one")
    assert run("first") == {(one, "pdf"): 4}
    assert run("first") == {(one, "pdf"): 4}
    late = tmp_path / "late"
    late.mkdir()
    put(late, "x.pdf", b"two")
    assert run("second", late) == {(one, "pdf"): 4, (two, "pdf"): 1}  # a new checkpoint begins at batch 0 and overwrites nothing


def test_written_intermediates_are_removed(spark):
    with S.given_paths() as paths:
        kept = S.stored(spark.range(3), "kept")
    assert len(paths) == 1 and kept.count() == 3
    other = S.stored(spark.range(2), "other")
    S.remove_paths(spark, paths)
    assert not os.path.exists(paths[0].removeprefix("file:")) and other.count() == 2


def _once(spark, folder, store, checkpoint, **options):
    found = ingest.arriving_rows(spark, folder, "name string, content string, arrived timestamp", files_per_batch=1, oldest="3650d")
    query = ingest.emit_once(found, store, checkpoint, partitions=2, **options)
    query.awaitTermination()
    assert query.exception() is None
    return query


def _add(spark, folder, rows, days_old=0):
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.createDataFrame(rows, "name string, content string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).coalesce(1).write.mode(
        "append").parquet(folder)
    for name in set(os.listdir(folder)) - before:
        then = time.time() - days_old * 86400
        os.utime(os.path.join(folder, name), (then, then))


def test_every_content_is_sent_on_once_over_batches_restarts_and_late_files(spark, tmp_path):
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "progress"))
    now = "2024-05-01 10:00:00"
    _add(spark, folder, [("a.pdf", "one", now), ("b.pdf", "one", now), ("c.txt", "one", now), ("d.pdf", None, now)])
    _add(spark, folder, [("e.pdf", "two", now)] + [(f"x{i}.pdf", "hot", now) for i in range(200)])
    _once(spark, folder, store, checkpoint)
    first = {(r.name, r.arrived) for r in ingest.emitted(spark, store).collect()}
    _add(spark, folder, [("f.pdf", "one", now), ("g.pdf", "three", now), ("h.pdf", "hot", now)], days_old=60)
    _once(spark, folder, store, checkpoint)
    _once(spark, folder, store, checkpoint)     # nothing new
    got = [(r.md5, r.ext) for r in ingest.emitted(spark, store).collect()]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert sorted(got, key=str) == sorted(
        [(md5("one"), "pdf"), (md5("one"), "txt"), (md5("two"), "pdf"), (md5("hot"), "pdf"), (md5("three"), "pdf"), (None, "pdf")], key=str)
    assert first <= {(r.name, r.arrived) for r in ingest.emitted(spark, store).collect()}


def test_state_holds_what_arrived_within_its_time(spark, tmp_path):
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for day in (1, 2, 3, 4):
        _add(spark, folder, [(f"{i}.pdf", f"{day}-{i}", f"2024-05-0{day} 10:00:00") for i in range(50)])
        query = _once(spark, folder, store, checkpoint, within="1 hour")
    held = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]][-1]
    # the batch before goes with the watermark that its successor sets
    assert all(op["numRowsTotal"] <= 100 for op in held) and ingest.emitted(spark, store).count() == 200


def test_settings_of_the_session_stay(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    _add(spark, str(tmp_path / "in"), [("a.pdf", "one", "2024-05-01 10:00:00")])
    _once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert {k: spark.conf.get(k) for k in before} == before


def test_an_upload_takes_the_branch_of_its_name(spark):
    given = [(1, "a.pdf", "bytes"), (2, "b.csv", 'k,"v, w"\n1,"x ""y"""\r\n\n2.5,"two\nlines"\n3\n'), (3, "c.txt", "t"), (4, "d.csv", ""), (5, "e.CSV", "a,b"),
             (6, "f.pdf", None), (7, "g.csv", None), (8, "h.csv", ",b\n1,2,3"), (9, "i.csv", 'a\n"open')]
    elements = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, "no")], "doc_id long, elem_no int, text string")
    got = {r.doc_id: r.text for r in uploads.upload_texts(spark.createDataFrame(given, "doc_id long, name string, content string"), elements).collect()}
    assert got[1] == "first\n\nsecond" and got[6] == "" and got[3] is got[4] is got[5] is got[7] is None
    assert got[2] == ("|    |   k | v, w      |\n|---:|----:|:----------|\n|  0 |   1 | x \"y\"     |\n|  1 | 2.5 | two\nlines |\n|  2 |   3 |           |")
    assert got[8] == "|    |   Unnamed: 0 |   b |\n|---:|-------------:|----:|\n|  0 |            1 |   2 |"
    assert got[9] == '|    | a     |\n|---:|:------|\n|  0 | "open |'


@pytest.mark.parametrize("name", ["incremental_ingest", "emit_once"])
def test_arriving_files_follow_the_scan(spark, tmp_path, monkeypatch, name):
    """A table of eight files arrives in as many as that for every part, not in one for each; no text is left out, none comes twice."""
    docs = [(i, f"text {i % 50}" + "x" * (i % 50), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(docs, I.TABLES["documents"])
    df.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    paths = {}

    def noted(spark, label):
        paths[label] = f"{tmp_path}/{label}"
        return paths[label]

    monkeypatch.setattr(suite, "fresh_path", noted)
    got = suite.QUERIES[name](spark, str(tmp_path)).collect()
    arrived = spark.read.schema("name string, content string").parquet(paths["arriving"])
    assert len(arrived.inputFiles()) > 8
    wanted = {(hashlib.md5(t.encode()).hexdigest(), ("pdf", "csv", "txt")[i % 3]) for i, t, *_ in docs}
    assert sorted((r.md5, r.ext) for r in got) == sorted(wanted)
    if name == "incremental_ingest":
        assert sum(r.copies for r in got) == 400
