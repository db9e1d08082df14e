"""Readers, the lead store and the ingestion streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadlake.session import new_folder
from leadlake.sources import readers as R
from leadlake.sources import upsert as U
from leadlake.streaming import jobs as J

def at():
    return F.lit(datetime(2024, 2, 1))



def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_keeps_text_and_strips_the_mark(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Record ID,Note,\n007,"two\nlines, ""quoted""",x\n', "utf-8-sig")
    df = R.read_leads_csv(spark, path)
    assert df.columns == ["Record ID", "Note"]
    assert df.first().asDict() == {"Record ID": "007", "Note": 'two\nlines, "quoted"'}


def test_html_answers_are_rejected(spark, tmp_path):
    write(tmp_path / "good.csv", "id,v\n1,a\n2,b\n")
    write(tmp_path / "late.csv", "id,v\n" + "".join(f"{i},{'x' * 30}\n" for i in range(20)) + "9,<html>\n")
    write(tmp_path / "bad.csv", "<!DOCTYPE html>\n<HTML><body>no</body></HTML>\n")
    records, rejected = R.sheet_export_scan(spark, str(tmp_path), multiline=False)
    assert [r["file"].rsplit("/", 1)[-1] for r in rejected.collect()] == ["bad.csv"]
    assert records.columns == ["id", "v"] and records.count() == 23


def test_contacts(spark, tmp_path):
    page = {"results": [{"id": "1", "properties": {"email": "a@b", "plan": "x", "secret": "s"}}, {"id": "2", "properties": {}}]}
    path = write(tmp_path / "page.json", json.dumps(page))
    rows = R.crm_contact_pages(spark, path, ["plan"]).orderBy("hs_object_id").collect()
    assert [r["hs_object_id"] for r in rows] == ["1", "2"] and rows[0]["plan"] == "x" and "secret" not in rows[0].asDict()


def test_unknown_kind_names_the_known_ones(spark):
    with pytest.raises(ValueError, match="csv.*hubspot"):
        R.read_source(spark, "fax")


def test_inline_records(spark):
    got = R.read_leads_inline(spark, [{"a": 1, "b": None}], ["a", "b", "c"]).first()
    assert got.asDict() == {"a": "1", "b": None, "c": None}


def rows(spark, *records):
    shape = "tenant_id string, source_id string, external_id string, display_name string, channel string, converted string, deal_value string, email string"
    return U.lead_rows(spark.createDataFrame(list(records), shape), at())


A = ("t", "s", "1", "Ann", "Google", None, "100", "a@b.c")


def test_upsert_keeps_sticky_values_and_replaces_the_payload(spark):
    target = rows(spark, A, ("t", "s", "2", "Bob", "x", "yes", None, None))
    batch = rows(spark, ("t", "s", "1", None, "Direct", "won", "", None), ("t", "s", "3", "Cy", "y", None, "7", None)).withColumn("ord", F.lit(0))
    got = {r["external_id"]: r for r in U.upsert_leads(target, batch).collect()}
    assert got["1"]["display_name"] == "Ann" and got["1"]["converted"] is True and got["1"]["deal_value"] == 100.0
    assert got["1"]["payload"]["channel"] == "Direct" and "display_name" not in got["1"]["payload"]
    assert [got[k]["is_new"] for k in "123"] == [False, False, True] and not got["2"]["touched"]


def test_records_without_an_id_meet_themselves_again(spark):
    first = rows(spark, ("t", "s", None, "x", "Google", None, None, None), ("t", "s", "", "y", "Direct", None, None, None)).collect()
    again = rows(spark, ("t", "s", "", "y", "Direct", None, None, None)).collect()
    assert len({r["external_id"] for r in first}) == 2 and again[0]["external_id"] in {r["external_id"] for r in first}


def test_counts_of_a_second_sync(spark):
    target = rows(spark, A)
    got = U.sync_counts(target, rows(spark, A, A, ("t", "s", "9", None, None, None, None, None))).first()
    assert (got["fetched"], got["created"], got["updated"]) == (3, 1, 2)


def test_store_is_idempotent_and_survives_compaction(spark):
    store = U.LeadStore(spark, new_folder(spark, "store"))
    assert store.current().count() == 0
    store.append(rows(spark, A), 0)
    for _ in range(2):
        store.append(rows(spark, ("t", "s", "1", None, "Direct", "no", None, None)), 1)
    before = store.current().collect()
    store.compact()
    store.compact()
    assert store.current().collect() == before and len(before) == 1
    store.append(rows(spark, ("t", "s", "1", None, "Mail", None, None, None)), 2)
    after = store.current().first()
    assert after["payload"]["channel"] == "Mail" and after["converted"] is False and after["display_name"] == "Ann"


def test_stream_resumes_from_its_cursor(spark, tmp_path):
    landing, mark = tmp_path / "in", str(tmp_path / "mark")
    landing.mkdir()
    store = U.LeadStore(spark, str(tmp_path / "leads"))
    shape = spark.createDataFrame([], "tenant_id string, source_id string, `Record ID` string, Amount string").schema
    run = lambda: J.stream_ingest(J.file_stream(spark, str(landing), shape, "json"), {"Record ID": "external_id", "Amount": "deal_value"}, store, mark, at()).awaitTermination()
    line = lambda i, v: json.dumps({"tenant_id": "t", "source_id": "s", "Record ID": i, "Amount": v}) + "\n"
    (landing / "1.json").write_text(line("1", "5") + line("2", "6"))
    run()
    run()
    assert store.current().count() == 2
    (landing / "2.json").write_text(line("2", "8") + line("3", "9"))
    run()
    assert {r["external_id"]: r["deal_value"] for r in store.current().collect()} == {"1": 5.0, "2": 8.0, "3": 9.0}


def test_local_warehouse_is_refused_on_a_cluster(spark):
    from leadlake import session

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._warehouse_folder(spark)


def test_last_record_of_a_batch_wins(spark, tmp_path):
    store = U.LeadStore(spark, str(tmp_path / "leads"))
    rows = spark.createDataFrame(
        [("t", "s", "e1", f"n{i}", f"{i}" if i < 3 else None) for i in range(5)],
        "tenant_id string, source_id string, external_id string, display_name string, deal_value string")
    store.append(U.lead_rows(rows, F.lit("2024-01-01").cast("timestamp")).repartition(4), 0,
                 position=F.substring("display_name", 2, 1).cast("int"))
    [lead] = store.current().collect()
    assert (lead["display_name"], lead["deal_value"]) == ("n4", 2.0)
    store.compact()
    before = sorted((tmp_path / "leads" / "base").rglob("*.parquet"))
    store.compact()  # nothing newer than the base
    assert sorted((tmp_path / "leads" / "base").rglob("*.parquet")) == before
    assert store.current().collect() == [lead]


def test_sheets_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nann,1\n")
    (tmp_path / "b.csv").write_text("amount,name,more\n2,bob,x\n")
    (tmp_path / "c.csv").write_text("<!doctype html><html><body>name,amount</body></html>\n")
    records, rejected = R.sheet_export_scan(spark, str(tmp_path))
    assert {(r["name"], r["amount"], r["more"]) for r in records.collect()} == {("ann", "1", None), ("bob", "2", "x")}
    assert rejected.count() == 1


def test_a_label_is_zero_one_or_nothing(spark):
    from leadlake.functions.text import coerce_label

    rows = spark.createDataFrame([("99999999999",), ("2",), ("1.0",), ("0",), ("yes",), ("lost?",), (None,)], "v string")
    assert [r[0] for r in rows.select(coerce_label(F.col("v"))).collect()] == [None, None, 1, 0, 1, None, None]


def many(spark, ids, name="n"):
    made = ids.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source_id"),
                      F.col("id").cast("string").alias("external_id"), F.lit(name).alias("display_name"), F.col("id").cast("string").alias("deal_value"))
    return U.lead_rows(made, at())


def files_read(df):
    """Files and rows that the parquet scans of an executed plan read, from their metrics."""
    df.collect()
    found, todo = [0, 0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            metrics = node.metrics()
            found[0] += metrics.apply("numFiles").value()
            found[1] += metrics.apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_batch_opens_only_its_slots(spark, tmp_path):
    store = U.LeadStore(spark, str(tmp_path / "leads"), rows_per_file=2)
    store.append(many(spark, spark.range(5000)), 0)
    store.compact()
    _, slots, manifest = store._manifest()
    total, rows = manifest.agg(F.count("*"), F.sum("rows")).first()
    assert slots == 4096 and rows == 5000 and total > 2000
    batch = many(spark, spark.range(0, 6000, 60), "new")
    found = store.rows_of(batch)
    assert found.count() == 84
    last, slots, files = store._manifest()
    touched = files.join(batch.select(store._slot(slots).alias("slot")).distinct(), "slot", "left_semi")
    opened, read = files_read(store._base(touched))
    assert opened == touched.count() < 0.05 * total and read < 0.05 * 5000 + 100
    assert sorted(r.external_id for r in found.collect()) == sorted(str(i) for i in range(0, 5000, 60))
    store.append(batch, 1)
    assert store.rows_of(batch, before=1).where("display_name = 'new'").count() == 0
    assert store.rows_of(batch).where("display_name = 'new'").count() == 100
    store.compact()
    _, _, after = store._manifest()
    kept = after.join(manifest.select("path"), "path", "left_semi").count()
    assert kept > 0.95 * total and after.agg(F.sum("rows")).first()[0] == 5016  # only touched slots were written anew
    assert store.current().count() == 5016 and store.current().where("display_name = 'new'").count() == 100


def test_slots_grow_with_the_leads(spark, tmp_path):
    store = U.LeadStore(spark, str(tmp_path / "leads"), rows_per_file=100)
    for batch, (first, until) in enumerate(((0, 50), (50, 120), (120, 2000))):
        store.append(many(spark, spark.range(first, until)), batch)
        store.compact()
    _, slots, files = store._manifest()
    assert slots == 32 and store.current().count() == 2000
    assert store.rows_of(many(spark, spark.range(1990, 2010))).count() == 10


def test_a_retry_reads_and_counts_alike(spark, tmp_path):
    from leadlake.sources.sync import sync_sources

    store = U.LeadStore(spark, str(tmp_path / "leads"))
    sources = spark.createDataFrame([("s", True)], "source_id string, mapping_confirmed boolean")
    raw = spark.createDataFrame([("t", "s", "1", "a", "5"), ("t", "s", "1", "b", None), ("t", "s", "2", "c", "7")],
                                "tenant_id string, source_id string, id string, name string, v string")
    mapping = {"id": "external_id", "name": "display_name", "v": "deal_value"}
    runs, stands = [], []
    for shuffled in (raw, raw.repartition(3), raw.orderBy(F.desc("name"))):
        runs.append([tuple(r)[:6] for r in sync_sources(shuffled, sources, mapping, store, 0, str(tmp_path), at()).collect()])
        stands.append(sorted(map(str, store.current().collect())))
    assert runs[0] == runs[1] == runs[2] and runs[0][0][2:5] == (3, 2, 1)
    assert stands[0] == stands[1] == stands[2]


def test_records_of_a_batch_without_position_fold_the_same_way(spark, tmp_path):
    store = U.LeadStore(spark, str(tmp_path / "leads"))
    rows = many(spark, spark.range(1)).unionByName(many(spark, spark.range(1), "m")).unionByName(many(spark, spark.range(1), "k"))
    seen = set()
    for parts in (1, 2, 5):
        store.append(rows.repartition(parts), 0)
        seen.add(store.current().first()["display_name"])
    assert len(seen) == 1
