import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from conftest import day
from vigil.operators import alerts as alert_ops, directory, enrich, labels
from vigil import session
from vigil.sources import catalogue, readers, writers


def test_directory_files(spark, tmp_path):
    (tmp_path / "2010-01.csv").write_text("employee_name,user_id,email,role,supervisor\nAnn Lee,DTAA/A1,a@x.example,ITAdmin,Bob Ray\nBob Ray,b2,b@x.example,Clerk,\n")
    (tmp_path / "2010-02.csv").write_text("employee_name,user_id,email,role,supervisor\nOld Name,a1,a@x.example,Clerk,\nAnn Lee,a1, A@X.example ,Clerk,\n")
    table = directory.build_directory(readers.read_directory(spark, str(tmp_path)))
    got = sorted((r.user_key, str(r.event_month), r.employee_name, r.email, r.supervisor_key) for r in table.collect())
    assert got == [("a1", "2010-01-01", "Ann Lee", "a@x.example", "b2"), ("a1", "2010-02-01", "Ann Lee", "a@x.example", None),
                   ("b2", "2010-01-01", "Bob Ray", "b@x.example", None)]


def test_event_files_to_profiles(spark, tmp_path):
    src = tmp_path / "logon.csv"
    src.write_text('id,date,user,pc,activity\n{1},01/02/2010 06:59:59,DTAA/U1,PC-1,Logon\n{1},01/02/2010 06:59:59,DTAA/U1,PC-1,Logon\n{2},bad,u2,,Logoff\n')
    clean = enrich.clean_events(readers.read_events(spark, str(src), "logon"), "logon")
    assert sorted((r.user_key, r.after_hours, r.activity) for r in clean.collect()) == [("u1", True, "logon"), ("u2", False, "logoff")]
    paths = writers.write_profiles(clean, "logon", str(tmp_path / "out"))
    lean = spark.read.parquet(paths["lean"])
    assert lean.count() == 2 and "user_raw" not in lean.columns and "user_raw" in spark.read.parquet(paths["full"]).columns
    writers.write_profiles(clean.limit(0), "logon", str(tmp_path / "out"))
    assert spark.read.parquet(paths["lean"]).count() == 2


def test_email_and_edges(spark, tmp_path):
    src = tmp_path / "email.csv"
    src.write_text("id,date,user,pc,to,cc,bcc,from,size,attachments,content\n"
                   "1,01/02/2010 10:00:00,,p,a@corp.example;b@out.example,,,Jo.Doe@corp.example,10,2,text\n")
    df = enrich.clean_events(readers.read_events(spark, str(src), "email"), "email", ["corp.example"], ["gmail.com"])
    r = df.first()
    assert (r.user_key, r.to_count, r.attachment_count, r.dir_internal_to_external, r.content) == ("jo.doe", 2, 2, True, "text")
    edges = sorted(tuple(e) for e in enrich.recipient_edges(df).collect())
    assert edges == [("jo.doe@corp.example", "a@corp.example", 1), ("jo.doe@corp.example", "b@out.example", 1)]


def test_ground_truth_and_insiders(spark, tmp_path):
    (tmp_path / "r5.2-1-ABC0001.csv").write_text("logon,{x},08/01/2010 20:00:00,ABC0001,more,of,it\nshort\nfile,{y},nonsense,ABC0001\nhttp,{z},08/03/2010 01:00:00,ABC0001,a\n")
    ranges = labels.exfil_ranges(readers.read_ground_truth(spark, str(tmp_path))).collect()
    assert [(r.user_key, r.exfil_start, r.exfil_end) for r in ranges] == [("abc0001", dt.date(2010, 8, 1), dt.date(2010, 8, 3))]
    src = tmp_path / "insiders.txt"
    src.write_text("dataset,scenario,details,user,start,end\n5.2,1,d,ABC0001,08/01/2010 20:00:00,08/03/2010 01:00:00\n4.2,1,d,ZZZ,01/01/2010 00:00:00,01/01/2010 00:00:00\n")
    assert [(r.user_key, r.scenario, r.start) for r in readers.read_insiders(spark, str(src)).collect()] == [("abc0001", "1", dt.date(2010, 8, 1))]


def test_alert_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", day(0), "ml", "ml:x", 0.7)], "user_key string, day date, detector string, reason string, score double")
    alerts = alert_ops.union_alerts(df)
    path = str(tmp_path / "alerts")
    writers.write_alerts(alerts, path)
    with open(tmp_path / "alerts" / "extra.json", "w") as f:
        f.write('{"day": "2024-01-01", "detector": "loop", "reason": "heartbeat"}\nnot json\n')
    back = readers.read_alerts(spark, path)
    assert [(r.user_key, r.day, r.score) for r in back.collect()] == [("u", day(0), 0.7)]


def test_daily_scan_is_pushed_down(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("u"), F.col("id")).alias("user_key"), F.expr("date_add(date'2024-01-01', cast(id as int))").alias("day"),
                                 F.col("id").alias("x"), F.col("id").alias("y"))
    meta = writers.write_meta(df, str(tmp_path / "d"))
    assert meta["rows"] == 100 and json.loads(spark.read.text(str(tmp_path / "d_meta.json"), wholetext=True).first()[0])["cols"][0] == "user_key"
    got = readers.read_daily(spark, str(tmp_path / "d"), "2024-01-10", "2024-01-12", ["user_key", "x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3 and "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day" in plan and ",y:" not in plan
    writers.write_sorted(df, str(tmp_path / "s"), ["user_key", "day"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "2010-01.csv").write_text("user_id,employee_name,email,role,supervisor\nAAA,Ann,a@x.example,Clerk,Boss\n")
    (tmp_path / "2010-02.csv").write_text("Role,extra,Supervisor,USER_ID,employee_name\nClerk,?,Boss,bbb,\"Bo, B\"\n")
    got = sorted((r.user_key, str(r.snapshot_date), r.employee_name, r.email, r.role, r.supervisor)
                 for r in readers.read_directory(spark, str(tmp_path)).collect())
    assert got == [("aaa", "2010-01-01", "Ann", "a@x.example", "Clerk", "Boss"), ("bbb", "2010-02-01", "Bo, B", None, "Clerk", "Boss")]
    (tmp_path / "2010-03.csv").write_text("employee_name,email\nNo One,n@x.example\n")
    with pytest.raises(ValueError):
        readers.read_directory(spark, str(tmp_path))
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.csv").write_text("id,date,user,pc,activity\n1,01/02/2010 06:00:00,AAA,p1,Logon\n")
    (logs / "b.csv").write_text("user,activity,id,pc,date\nBBB,Logoff,2,p2,01/03/2010 06:00:00\n")
    rows = sorted((r.user, r.date, r.pc, r.id) for r in readers.read_events(spark, str(logs), "logon").collect())
    assert rows == [("AAA", "01/02/2010 06:00:00", "p1", "1"), ("BBB", "01/03/2010 06:00:00", "p2", "2")]


def _read_so_far():
    with open("/proc/self/io") as f:
        return int(f.readline().split()[1])


def test_headers_cost_a_block_whatever_the_size(tmp_path):
    for name, lines in (("small.csv", 1), ("large.csv", 300_000)):
        (tmp_path / name).write_text("id,date,user\n" + ("x" * 99 + "\n") * lines)
        before = _read_so_far()
        assert catalogue.first_line((tmp_path / name).as_uri()) == "id,date,user"
        assert _read_so_far() - before < 8 * catalogue.BLOCK
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "wide.csv").write_text("c," * 40_000 + "\r\n1")
    assert catalogue.first_line((tmp_path / "none.csv").as_uri()) is None
    assert catalogue.first_line((tmp_path / "wide.csv").as_uri()) == "c," * 40_000


def test_layouts(spark, tmp_path, monkeypatch):
    import gzip

    (tmp_path / "a b.csv").write_text("\ufeffid,user\n1,u1\n")
    (tmp_path / "b.csv").write_text("id,user\n2,u2\n")
    (tmp_path / "c.csv").write_text("user,id\nu3,3\n")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("id,user\n4,u4\n")
    found = catalogue.layouts(spark, str(tmp_path))
    names = {head: [f.rsplit("/", 1)[1] for f in files] for head, files in found.items()}
    assert names == {"id,user": ["a b.csv", "b.csv", "d.csv.gz"], "user,id": ["c.csv"]}
    rows = readers.read_events(spark, str(tmp_path), "logon").select("id", "user", "pc").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "u1", None), ("2", "u2", None), ("3", "u3", None), ("4", "u4", None)]
    # Where tasks cannot open the store, Spark's reader is asked.
    kind = "file string, opened boolean, head string"
    closed = lambda s, p: s.createDataFrame([(f, False, None) for f in s.read.text(p).inputFiles()], kind)
    monkeypatch.setattr(catalogue, "header_lines", closed)
    again = catalogue.layouts(spark, str(tmp_path))
    assert {head: [f.rsplit("/", 1)[1] for f in files] for head, files in again.items()} == names


def test_a_snapshot_may_be_a_folder(spark, tmp_path):
    for month, name in (("month=2010-01", "part-0.csv"), ("2010-02", "part-1.csv")):
        (tmp_path / month).mkdir()
        (tmp_path / month / name).write_text("user_id,role\nu1,Clerk\n")
    rows = readers.read_directory(spark, [str(tmp_path / "month=2010-01"), str(tmp_path / "2010-02")])
    assert sorted(str(r.snapshot_date) for r in rows.collect()) == ["2010-01-01", "2010-02-01"]


class _Unset:
    def __init__(self, spark, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": spark.sparkContext.applicationId})


def test_shared_folder_without_a_setting(spark):
    folder = session.shared_folder(_Unset(spark, "local[4]"))
    assert folder and folder == session.shared_folder(_Unset(spark, "local[4]"))
    session._FOLDERS.clear()
    with pytest.raises(RuntimeError):
        session.shared_folder(_Unset(spark, "spark://host:7077"))


def test_folder_names_are_cut_not_searched(spark, tmp_path):
    """A pattern tried at each place of a path costs more per row than all else that is read."""
    for folder in ("2010-01", "month=2010-02", "a=b=2010-03", "month=", "x.y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p.csv").write_text("user_id\nu1\n")
    rows = spark.read.text(str(tmp_path / "*")).select(readers.folder_name().alias("name"))
    assert sorted(r.name for r in rows.distinct().collect()) == ["", "2010-01", "2010-02", "2010-03", "x.y"]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
