"""Paged sources: walking, stop rules, resuming, batch and stream; late rows and outcome pairs."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.sources import pages as P
from leadlake.sources import readers as R
from leadlake.streaming import jobs as J


class Scripted:
    """Answers from a table: cursor -> (number of records, next cursor, more)."""

    def __init__(self, script):
        self.script, self.asked = script, []

    def fetch(self, cursor, limit):
        self.asked.append(cursor)
        n, after, more = self.script[cursor]
        return P.Page([{"id": str(i)} for i in range(min(n, limit))], after, more)


def test_walk_stops():
    assert P.walk(Scripted({None: (2, "a", True), "a": (2, "b", True), "b": (1, "c", False)}), None) == [(None, "a"), ("a", "b"), ("b", "c")]
    assert P.walk(Scripted({None: (2, "a", True), "a": (2, "a", True)}), None) == [(None, "a"), ("a", "a")]  # a repeated cursor
    assert P.walk(Scripted({None: (2, None, True)}), None) == [(None, None)]
    assert P.walk(Scripted({None: (0, None, False)}), None) == []
    endless = Scripted({None: (1, "0", True)} | {str(i): (1, str(i + 1), True) for i in range(300)})
    assert len(P.walk(endless, None)) == P.MOST_PAGES
    assert P.walk(Scripted({"a": (1, "b", True), "b": (1, "c", True)}), "a", until="b") == [("a", "b")]


def lines(n, first=0):
    return "".join(json.dumps({"id": str(i), "v": None if i % 5 == 0 else i, "é": [i]}) + "\n" for i in range(first, first + n))


def test_landed_pages(tmp_path):
    (tmp_path / "1.json").write_text(lines(25))
    (tmp_path / "2.json").write_text("\n" + lines(3, 25))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".3.crc").write_text("x")
    reader = P.LandedPages({"path": str(tmp_path)})
    steps = P.walk(reader, None, 10)
    seen = [r["id"] for asked, _ in steps for r in reader.fetch(asked, 10).records]
    assert seen == [str(i) for i in range(28)] and [len(reader.fetch(a, 10).records) for a, _ in steps] == [10, 10, 5, 3]
    last = steps[-1][1]
    assert reader.fetch(last, 10) == P.Page([], last, False)
    (tmp_path / "4.json").write_text(lines(2, 28))
    assert [r["id"] for r in reader.fetch(last, 10).records] == ["28", "29"]
    assert P.LandedPages({"path": str(tmp_path / "none")}).fetch(None, 5) == P.Page([], None, False)


def test_batch_and_resumed_stream(spark, tmp_path):
    landing, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    landing.mkdir()
    R.register_paged_source(spark, "test_pages")
    assert ("test_pages", False) in R.source_kinds()
    (landing / "1.json").write_text(lines(25))
    batch = R.read_source(spark, "test_pages", ["id", "v", "missing"], path=str(landing), limit="4").orderBy(F.col("id").cast("int")).collect()
    assert [(r.id, r.v, r.missing) for r in batch[:2]] == [("0", None, None), ("1", "1", None)] and len(batch) == 25
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "é")])

    def run(pages="100"):
        stream = spark.readStream.format("test_pages").schema(shape).options(path=str(landing), limit="4", pages=pages).load()
        J.stream_score(stream, lambda b: b, out, mark).awaitTermination()
        return sorted(int(r.id) for r in spark.read.parquet(out).collect())

    assert run("3") == list(range(12))  # three pages a run; the next resumes there
    assert run() == list(range(25))
    assert run() == list(range(25))
    (landing / "2.json").write_text(lines(2, 25))
    assert run() == list(range(27))
    assert spark.read.parquet(out).where("id = '26'").first()["é"] == "[26]"


AT = datetime(2024, 2, 1)
TOLD = "tenant_id string, lead_ref string, converted boolean, recorded_at timestamp"
LOG = "tenant_id string, lead_id string, external_id string, probability double, created_at timestamp"


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    path, mark = str(tmp_path / "intake"), str(tmp_path / "mark")
    landing = str(tmp_path / "in")

    def land(*days):
        rows = [("t", str(d), True, None if d is None else AT + timedelta(days=d)) for d in days]
        spark.createDataFrame(rows, TOLD).coalesce(1).write.mode("append").parquet(landing)
        J.stream_intake(J.file_stream(spark, landing, spark.createDataFrame([], TOLD).schema), "recorded_at", "36 HOURS", path, mark).awaitTermination()

    land(0, 10, -5)  # a first batch has nothing before it
    land(9, 8, None, 20)
    land(18, 19)
    ids = lambda part: sorted(r.lead_ref for r in spark.read.schema(TOLD).parquet(f"{path}/{part}").collect())
    assert ids("ontime") == ["-5", "0", "10", "19", "20", "9"] and ids("late") == ["18", "8", "None"]


def test_outcome_pairs_of_streams(spark, tmp_path):
    day = lambda d: AT + timedelta(days=d)
    log = spark.createDataFrame([
        ("t", "s-1", "1", 0.9, day(-3)), ("t", "s-1", "1", 0.8, day(-1)), ("t", "s-1", "1", 0.7, day(5)), ("t", "s-2", "2", 0.4, day(-60)),
        ("u", "s-1", "1", 0.1, day(-1)), ("t", "s-9", "9", 0.5, day(30))], LOG)
    told = spark.createDataFrame([
        ("t", "s-1", True, day(0)), ("t", "s-1", True, day(0)), ("t", "1", False, day(2)), ("t", "s-2", True, day(0)), ("t", "gone", True, day(1)),
        (None, "s-1", True, day(1)), ("t", None, True, day(1)), ("t", "gone", True, day(29)), ("t", "s-9", True, day(31))], TOLD)
    folders = {n: str(tmp_path / n) for n in ("told", "log", "out", "mark")}
    told.coalesce(1).write.parquet(folders["told"])
    log.coalesce(1).write.parquet(folders["log"])
    J.stream_outcome_pairs(J.file_stream(spark, folders["told"], told.schema), J.file_stream(spark, folders["log"], log.schema),
                           folders["out"], folders["mark"], "36 hours", "40 days").awaitTermination()
    got = sorted(map(str, spark.read.parquet(folders["out"]).collect()))
    twin = J.closed_outcome_pairs(told, log, "40 days", F.lit(day(30) - timedelta(hours=36)))
    assert got == sorted(map(str, twin.collect()))
    rows = {(r.tenant_id, r.lead_ref, r.probability, r.matched_by) for r in twin.collect()}
    assert rows == {
        ("t", "s-1", 0.9, "lead_id"), ("t", "s-1", 0.8, "lead_id"), ("t", "1", 0.9, "external_id"), ("t", "1", 0.8, "external_id"),
        ("t", "s-2", None, None), ("t", "gone", None, None), (None, "s-1", None, None), ("t", None, None, None), ("t", "s-9", 0.5, "lead_id")}
    assert len(got) == 9  # the outcome told twice comes once; the one behind the watermark is still open
