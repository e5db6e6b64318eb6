"""Sources, sessions, job log, guards, the sample document and streams."""

import pytest
from pyspark.sql import functions as F

from specloom.operators import catalog, extract, material
from specloom.sources import sample, tables
from specloom.streaming import pages as stream


def test_sample_document(spark):
    pages = sample.sample_pages(spark)
    items = extract.line_items(pages).toPandas()
    assert len(items) == 18 and ((items.category == "pipe") & (items.unit == "m")).sum() == 7
    warnings = sample.sample_warnings(pages).orderBy("ord", "code").collect()
    assert warnings[0].code == "SAMPLE_TEXT_FALLBACK" and warnings[0].severity == "info"
    row = extract.project(pages).first()
    assert (row["name"], row.project_number, row.revision, row.discipline) == ("1403 AB - 33 Rev03(1)", "1403", "Rev03", "Sprinkler / fire suppression")
    counts = extract.summary(pages).first()
    assert (counts.n_pages, counts.n_systems, counts.n_standards) == (3, 4, 2)
    kinds = {(r.type, r.value) for r in extract.requirements(pages).collect()}
    assert {("standard", "NFPA 13"), ("pressure", "12 bar"), ("property", "K=80"), ("property", "68°C"), ("dimension", "DN100")} <= kinds


def test_sections_and_near_titles(spark):
    text = "1.2 UTENDØRS ARBEID\nRør DN50 stk 2\nDeluge\nTOTAL OVERSIKT\nRør DN65 stk 3\nTOTAL OVERSIKT"
    pages = extract.normalize_pages(spark.createDataFrame([(1, 0, 1, text), (1, 1, 1, "total\nTOTAL OVERSIKT"), (1, 2, 2, "TOTAL OVERSIKT"), (2, 0, 0, None)], "doc_id long, page_ord int, page_number int, text string"))
    found = [(r.id, r.title, r.source_page, r.confidence) for r in extract.sections(pages).collect()]
    assert sorted(found) == [("section-1", "UTENDØRS ARBEID", 1, 78), ("section-2", "Delugeanlegg", 1, 72), ("section-3", "TOTAL OVERSIKT", 1, 78), ("section-4", "TOTAL OVERSIKT", 2, 78)]
    assert [(r.section_title, r.id) for r in extract.line_items(pages).orderBy("item_ord").collect()] == [("UTENDØRS ARBEID", "line-1"), ("TOTAL OVERSIKT", "line-2")]


def test_long_page_is_linear(spark):
    text = "\n".join(f"14.{i}.2 HEADING NUMBER {i}" if i % 50 == 0 else f"14.33.{i}.1 Pipe DN{10 + i % 90} stk {i + 1}" for i in range(20_000))
    pages = extract.normalize_pages(spark.createDataFrame([(1, 0, 1, text)], "doc_id long, page_ord int, page_number int, text string"))
    items = extract.line_items(pages)
    assert items.filter("section_title = 'HEADING NUMBER 19950'").count() == 49 and items.count() == 19_600


def test_pages_are_parsed_once(spark):
    pages = extract.normalize_pages(spark.createDataFrame([(1, 0, 1, "Rør DN50 stk 2")], "doc_id long, page_ord int, page_number int, text string"))
    plan = extract.line_items(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1


def test_update_returns_changed_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    snapshot, changed = tables.update(rows, F.col("name") == "a", name="z")
    assert [tuple(r) for r in snapshot.orderBy("id").collect()] == [(1, "z"), (2, "b"), (3, None)] and [tuple(r) for r in changed.collect()] == [(1, "z")]


def test_append_and_select(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert tables.append(rows, f"{tmp_path}/t").count() == 2 and tables.append(rows, f"{tmp_path}/t").count() == 2
    got = tables.select(spark.read.parquet(f"{tmp_path}/t"), ["id"], 1, name="b")
    assert got.columns == ["id"] and [tuple(r) for r in got.collect()] == [(2,)]


def test_guards(spark):
    some = spark.range(3)
    assert tables.import_guard(some, True) is None
    assert tables.import_guard(some, False) == tables.import_guard(some.limit(0), True) == "At least one confirmed product is required."
    assert "maximum" in tables.import_guard(spark.range(5001), True) and tables.import_guard(spark.range(5000), True) is None
    assert "10 MB" in tables.import_guard(some, True, content_length=(10 << 20) + 1) and "Preview" in tables.import_guard(some, True, "text/plain")


def test_json_files_and_uploads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"sin": 1}]')
    (tmp_path / "b.json").write_text("[" + " " * 400 + "]")
    (tmp_path / "c.json").write_text("")
    monkeypatch.setattr(tables, "MOST_JSON", 300)
    small, large = tables.product_json(spark, str(tmp_path))
    assert "a.json" in small.orderBy(F.desc("json")).first().import_id and [r.import_id.rpartition("/")[2] for r in large.collect()] == ["b.json"]
    monkeypatch.setattr(tables, "MOST_UPLOAD", 300)
    good, bad = tables.uploads(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in good.collect()] == ["a.json"] and [r.reason for r in bad.collect()] == ["file too large"]


def test_page_texts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\ftwo\f")
    assert [(r.page_ord, r.page_number, r.text) for r in tables.page_texts(spark, str(tmp_path)).orderBy("page_ord").collect()] == [(0, 1, "one"), (1, 2, "two"), (2, 3, "")]


def test_sessions(spark, tmp_path):
    path, rows = f"{tmp_path}/s", spark.createDataFrame([(1,), (2,)], "id long")
    tables.save_session(rows, path, "a")
    tables.save_session(rows.limit(1), path, "b")
    tables.save_session(rows.limit(1), path, "a")
    assert tables.load_session(spark, path, "a").count() == tables.load_session(spark, path, "b").count() == 1
    tables.reset_session(spark, path, "a", f"{tmp_path}/next")
    assert tables.load_session(spark, f"{tmp_path}/next", "a").isEmpty() and tables.load_session(spark, f"{tmp_path}/next", "b").count() == 1


def test_job_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bad"), (2, None)], "row int, e string")
    made = catalog.import_summary(rows, F.col("e"), ["row"])
    assert tables.log_job(made, f"{tmp_path}/jobs", "x" * 300) is None
    row = spark.read.parquet(f"{tmp_path}/jobs").first()
    assert (len(row.file_name), row.total_records, row.failed_records, row.error_message, row.status) == (255, 2, 1, "bad", "completed")
    tried = []

    def refuse(df, path, whole_too=False):
        tried.append(df.columns)
        if "id" in df.columns or whole_too:
            raise OSError("no such column")
        tables.append(df, path)

    assert tables.log_job(made, f"{tmp_path}/fewer", "f.json", write=refuse) is None and len(tried) == 2
    assert spark.read.parquet(f"{tmp_path}/fewer").columns == list(tables.JOB_COLUMNS)
    assert tables.log_job(made, "", "f.json", write=lambda df, path: refuse(df, path, True)) == "extraction_jobs logging failed: no such column"


def test_queue_rows_and_last_of_several(spark):
    made = spark.createDataFrame([("1", "M", "S", "n", "c", None, "Red", "K5", None)], "source_row string, manufacturer string, product_no string, product_name string, category string, sub_category string, color string, k_value_raw string, rti string")
    row = catalog.queue_rows(made, "f.json").first()
    assert (row.status, row.source_document, row.raw_text) == ("needs_review", "f.json", '{"source_row":"1","k_value_raw":"K5"}')
    details = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2)], "id long, note string, ord int")
    assert catalog.overlay(spark.createDataFrame([(1,), (2,)], "id long"), details).orderBy("id").collect() == [(1, "y"), (2, None)]
    with pytest.raises(Exception, match="ord"):
        catalog.overlay(details.select("id"), details.drop("ord"))


def test_breakdown_with_own_matches(spark):
    lines = spark.createDataFrame([("pipe", "p", None), ("valve", None, ""), ("pipe x", None, None)], "category string, product_id string, matched_product string")
    matches = spark.createDataFrame([("Pipe",), ("Pipe",), ("odd",)], "category string")
    got = [(r.category, r.material_items, r.matched, r.missing) for r in material.category_breakdown(lines, matches).orderBy("ord").collect()]
    assert got == [("Pipe", 2, 2, 1), ("Valve", 1, 0, 1), ("Unknown", 0, 1, 0)]


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, 1, "Rør DN50 stk 2"), (2, 0, 1, "Bend DN32 m 3")], "doc_id long, page_ord int, page_number int, text string")
    pages.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        stream.extract_to(stream.read(spark, f"{tmp_path}/in", pages.schema), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted((r.doc_id, r.unit) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "stk"), (2, "m")]
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    query = stream.once(stream.read(spark, f"{tmp_path}/events", events.schema)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2
