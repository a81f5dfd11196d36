import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import alerts as alert_ops, reports, rules
from vigil.streaming import ingest, sinks, stateful, windows


def drain(stream, tmp_path, name):
    job = sinks.to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"), once=True)
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_csv_stream_to_days(spark, tmp_path):
    stateful.use_state_store(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["id,date,user,pc,activity"]
    for n in range(6):
        stamp = (dt.datetime(2024, 1, 1, 20) + dt.timedelta(days=n)).strftime("%m/%d/%Y %H:%M:%S")
        lines += [f"{n},{stamp},U1,p1,Connect", f"{n},{stamp},U1,p1,Connect", f"{n}x,{stamp},U1,p2,Disconnect"]
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    layout = ("id", "date", "user", "pc", "activity")
    events = ingest.stream_events(spark, str(folder), "device", columns=layout)
    got = drain(windows.stream_daily(events), tmp_path, "days").orderBy("day").collect()
    assert [(r.n_device_events, r.n_usb_connects, r.n_after_hours) for r in got] == [(2, 1, 2)] * len(got)
    assert [r.day for r in got] == [dt.date(2024, 1, 1 + n) for n in range(len(got))] and len(got) >= 3
    # A row far behind the watermark is dropped, newer ones go on.
    (folder / "b.csv").write_text("id,date,user,pc,activity\nold,01/01/2024 09:00:00,U1,p9,Connect\nnew,01/20/2024 09:00:00,U1,p1,Connect\n")
    again = drain(windows.stream_daily(ingest.stream_events(spark, str(folder), "device", columns=layout)), tmp_path, "days")
    days = {r.day: r.n_device_events for r in again.collect()}
    assert days[dt.date(2024, 1, 1)] == 2 and days[dt.date(2024, 1, 6)] == 2


def in_batches(spark, tmp_path, name, rows, schema, order, after):
    """The rows as a stream with one batch for each list of positions in `order`, then the end of input."""
    src = str(tmp_path / name)
    for part in order:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(src)
    stateful.end_of_input(spark.createDataFrame(rows, schema), after).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return stateful.with_day_time(stream, "30 days")


@pytest.mark.parametrize("order", [[(0, 1, 2, 3, 4)], [(0, 1), (2,), (3, 4)], [(0, 1), (4,), (2, 3)], [(4, 2), (3,), (1, 0, 3)]])
def test_rules_of_shuffled_batches(spark, tmp_path, order):
    """Days that arrive in any order fire as if they had come at once, the late grave one too."""
    stateful.use_state_store(spark)
    schema = f"user_key string, {stateful.RULE_DAY}"
    rows = [("u", dt.date(2024, 1, 1 + n), True, 1, int(n == 3), 1, 1, 0.0) for n in range(5)]
    out = stateful.stream_rules(in_batches(spark, tmp_path, "days", rows, schema, order, 31))
    got = sorted((r.day, r.reason) for r in drain(out, tmp_path, "alerts").collect())
    assert got == [(dt.date(2024, 1, 4), "rules:s1_chain"), (dt.date(2024, 1, 5), "rules:s1_near_miss")]


@pytest.mark.parametrize("order", [[(0, 1, 2, 3)], [(3,), (0, 2), (1,)]])
def test_watches_of_shuffled_batches(spark, tmp_path, order):
    stateful.use_state_store(spark)
    schema = f"user_key string, {stateful.WATCH_DAY}"
    rows = [("u", dt.date(2024, 1, 1), 0.8, False, False), ("u", dt.date(2024, 1, 3), 0.9, False, False),
            ("u", dt.date(2024, 1, 5), None, True, False), ("u", dt.date(2024, 2, 1), 0.77, False, False)]
    out = stateful.stream_watch(in_batches(spark, tmp_path, "days", rows, schema, order, 60))
    got = sorted(tuple(r) for r in drain(out, tmp_path, "watches").collect())
    assert got == [("u", dt.date(2024, 1, 1), dt.date(2024, 1, 8), 0.9, True, dt.date(2024, 1, 5), 4),
                   ("u", dt.date(2024, 2, 1), dt.date(2024, 2, 8), 0.77, False, None, None)]


@pytest.mark.parametrize("kind", ["rules", "watch"])
def test_users_share_a_row_of_state(spark, tmp_path, kind):
    """Waiting days come and go with the rows of a group of users, not by a call to the store for each."""
    stateful.use_state_store(spark)
    day = lambda n: dt.date(2024, 1, 1 + n)
    values, schema, machine = {
        "rules": ((True, 1, 0, 1, 1, 0.0), stateful.RULE_DAY, stateful.stream_rules),
        "watch": ((0.8, False, False), stateful.WATCH_DAY, stateful.stream_watch),
    }[kind]
    rows = [(f"u{u}", day(n), *values) for u in range(20) for n in range(10)]
    src = str(tmp_path / "days")
    spark.createDataFrame(rows, f"user_key string, {schema}").write.parquet(src)
    stream = spark.readStream.schema(f"user_key string, {schema}").parquet(src)
    assert stateful.groups_for(spark.read.parquet(src)) == 1
    out = machine(stateful.with_day_time(stream, "30 days"), groups=4)
    job = sinks.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    job.awaitTermination()
    assert job.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_batch_of_a_stream_is_dealt_to_many_tasks(spark):
    """No batch lies in one file, and none holds only some of the days."""
    from vigil.plans.stream_queries import _out_of_order

    df = spark.range(0, 4000, numPartitions=8).select(
        F.concat(F.lit("u"), F.col("id") % 100).alias("user_key"), F.date_add(F.lit("2024-01-01"), (F.col("id") / 100).cast("int")).alias("day")
    )
    seen = []

    def look(batch, _):
        seen.append((batch.count(), batch.rdd.getNumPartitions(), batch.select("day").distinct().count()))

    stream = _out_of_order(df, "many-files")
    stream.writeStream.foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for n, _, _ in seen) == 4000
    assert min(parts for _, parts, _ in seen) > 1 and min(days for _, _, days in seen) == 40


def test_copies_without_id_go(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = ",01/01/2024 09:00:00,U1,p1,Connect"
    (folder / "a.csv").write_text("id,date,user,pc,activity\n" + "\n".join([line, line, line, ",01/01/2024 09:00:00,U1,p2,Connect"]) + "\n")
    events = ingest.stream_events(spark, str(folder), "device", columns=("id", "date", "user", "pc", "activity"))
    assert drain(events.select("pc"), tmp_path, "kept").count() == 2


def test_rollups_per_batch(spark, tmp_path):
    data = [("u", dt.date(2024, 1, 1), "ml", "ml:x", 0.9), ("v", dt.date(2024, 1, 2), "forecast", "forecast:x", 0.8)]
    df = spark.createDataFrame(data, "user_key string, day date, detector string, reason string, score double")
    alerts = alert_ops.normalize_alerts(alert_ops.union_alerts(df))
    alerts.write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "alerts"))
    sinks.stream_rollups(stream, str(tmp_path / "roll"), str(tmp_path / "cp"), once=True).awaitTermination()
    beat = sinks.merge_heartbeats(spark.read.parquet(str(tmp_path / "roll" / "heartbeat"))).orderBy("day").collect()
    assert [r["count"] for r in beat] == [1, 1]
    users = sinks.merge_rankings(spark.read.parquet(str(tmp_path / "roll" / "users")))
    assert sorted(users.collect()) == sorted(reports.user_ranking(alerts).select(*users.columns).collect()) and users.count() == 2
    sinks.stream_alerts(stream.select("user_key", "day", F.col("ml_score").alias("score")), str(tmp_path / "json"), str(tmp_path / "cp2"), once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 2


@pytest.mark.parametrize("order", [[(0, 1), (2, 3)], [(0, 2), (1, 3)], [(3, 2), (1, 0)], [(0, 1, 2, 3)]])
def test_a_day_that_comes_twice_is_the_greater_one(spark, tmp_path, order):
    """Which of a day's rows counts does not hang on which came last."""
    stateful.use_state_store(spark)
    schema = f"user_key string, {stateful.RULE_DAY}"
    d = lambda n: dt.date(2024, 1, n)
    rows = [("u", d(1), True, 1, 0, 1, 1, 0.0), ("u", d(2), True, 3, 0, 1, 1, 0.0),
            ("u", d(2), None, None, 9, None, None, None), ("u", d(3), True, 2, 1, 1, 1, 0.0)]
    params = rules.RuleParams(min_days=3)
    out = stateful.stream_rules(in_batches(spark, tmp_path, "days", rows, schema, order, 31), params)
    assert [(r.day, r.reason) for r in drain(out, tmp_path, "alerts").collect()] == [(d(3), "rules:s1_chain")]


def test_an_ended_stream_gives_the_batch_result(spark, tmp_path):
    """All days and weeks come out once the end is written, and none before that is lost."""
    stateful.use_state_store(spark)
    schema = "ts timestamp, user_key string, domain string, pc string, after_hours boolean, event_id long"
    rows = [(dt.datetime(2024, 1, 1 + n, 9), f"u{n % 2}", "logon", f"p{n}", n % 3 == 0, n) for n in range(8)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    control = str(tmp_path / "control")
    ingest.end_row(spark, df.schema).where("false").write.parquet(control)

    def days():
        stream = ingest.with_end(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events")), control)
        timed = ingest.with_event_time(stream.withColumnRenamed("ts", "timestamp"))
        return windows.stream_daily(ingest.dedupe_stream(timed, "event_id"))

    before = {(r.user_key, r.day) for r in drain(days(), tmp_path, "days").collect()}
    ingest.end_row(spark, df.schema).write.mode("append").parquet(control)
    after = [(r.user_key, r.day) for r in drain(days(), tmp_path, "days").collect()]
    assert before < set(after) and sorted(after) == sorted((r[1], r[0].date()) for r in rows)


def test_files_of_any_layout_are_ingested(spark, tmp_path):
    """Each file by its own header; what does not fit is set aside, and copies across batches count once."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("id,date,user,pc,activity\n1,01/02/2010 06:00:00,U1,p1,Logon\n2,01/02/2010 09:00:00,U2,p1,Logoff\n")
    (folder / "b.csv").write_text("pc,extra,user,DATE,id\np2,x,U3,01/03/2010 09:00:00,3\n")
    (folder / "c.csv").write_text("id,user\n4,U4\n")
    (folder / "d.csv").write_text("\n")
    (folder / "none.csv").write_text("")

    def run():
        job = ingest.ingest_files(spark, str(folder), "logon", out, str(tmp_path / "cp"), once=True, files_a_batch=3)
        job.awaitTermination()
        assert job.exception() is None

    run()
    got = sorted((r.id, r.user_key, r.pc, r.after_hours) for r in ingest.read_ingested(spark, out, "logon").collect())
    assert got == [("1", "u1", "p1", True), ("2", "u2", "p1", False), ("3", "u3", "p2", False)]
    aside = sorted((r.file.rsplit("/", 1)[1], r["head"], r.reason) for r in ingest.read_quarantine(spark, out).collect())
    assert aside == [("c.csv", "id,user", "needs date"), ("d.csv", "", "empty")]
    (folder / "e.csv").write_text("user,id,date\nU1,1,01/02/2010 06:00:00\nU5,5,01/02/2010 10:00:00\n")
    run()
    assert sorted(r.id for r in ingest.read_ingested(spark, out, "logon").collect()) == ["1", "2", "3", "5"]


def test_rollups_keep_no_texts(spark, tmp_path, monkeypatch):
    """A batch is kept in memory while it is counted twice: only the columns that are counted."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    data = [("u", dt.date(2024, 1, 1), "ml", "ml:x", 0.9)]
    df = spark.createDataFrame(data, "user_key string, day date, detector string, reason string, score double")
    alerts = alert_ops.normalize_alerts(alert_ops.union_alerts(df))
    alerts.write.parquet(str(tmp_path / "alerts"))
    kept, persist = [], Frame.persist
    monkeypatch.setattr(Frame, "persist", lambda self, *args: kept.append(self.columns) or persist(self, *args))
    stream = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "alerts"))
    sinks.stream_rollups(stream, str(tmp_path / "roll"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert kept and all(columns == [*reports.ROLLED_UP] for columns in kept)
