import datetime as dt

from pyspark.sql import functions as F

from vigil.functions import scoring, text, times, web


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normalize_user(spark):
    rows = [(" DTAA/ABC0123 ",), ("dtaa\\Xy1",), ("  ",), (None,), ("plain",)]
    assert values(spark, rows, "u string", text.normalize_user(F.col("u"))) == [
        "abc0123", "xy1", None, None, "plain",
    ]


def test_to_bool_and_keylogger(spark):
    rows = [("Yes",), ("0",), (None,), (" T ",)]
    assert values(spark, rows, "c string", text.to_bool(F.col("c"))) == [True, False, False, True]
    names = [("C:\\a\\KeyLogger.exe",), ("/x/keylogger.tar.gz",), ("keylogger",), (None,)]
    assert values(spark, names, "c string", text.is_keylogger(F.col("c"))) == [True, False, True, False]


def test_recipients(spark):
    rows = [("a@x;b@y, nan",), ("",), (None,), ("nan",), ("a@x;;b@y",)]
    assert values(spark, rows, "c string", text.recipient_count(F.col("c"))) == [3, 0, 0, 0, 2]


def test_direction_flags(spark):
    rows = [("u@corp.example", "x@mail.corp.example", None), ("u@corp.example", "x@out.example", None),
            ("z@out.example", "u@corp.example", "me@gmail.com"), ("z@out.example", "q@out.example", None)]
    flags = text.direction_flags(
        F.col("f"), text.recipient_domains([F.col("t"), F.col("c")]), ["corp.example"], ["gmail.com"]
    )
    df = spark.createDataFrame(rows, "f string, t string, c string").select(*[c.alias(n) for n, c in flags.items()])
    got = [r.asDict() for r in df.collect()]
    assert [g["dir_internal_only"] for g in got] == [True, False, False, False]
    assert [g["dir_internal_to_external"] for g in got] == [False, True, False, False]
    assert [g["dir_external_to_internal"] for g in got] == [False, False, True, False]
    assert [g["dir_external_only"] for g in got] == [False, False, False, True]
    assert [g["any_personal_recipient"] for g in got] == [False, False, True, False]


def test_internal_domains(spark):
    rows = [("a@corp.example",), ("a@b.corp.example",), ("a@notcorp.example",), (None,)]
    assert values(spark, rows, "c string", text.is_internal(F.col("c"), ["corp.example"])) == [
        True, True, False, False,
    ]


def test_timestamps(spark):
    rows = [("01/02/2010 07:00:00",), ("2010-01-02 18:59:59",), ("junk",), ("01/02/2010 19:00:00",)]
    got = values(spark, rows, "c string", times.parse_ts(F.col("c")))
    assert got == [dt.datetime(2010, 1, 2, 7), dt.datetime(2010, 1, 2, 18, 59, 59), None, dt.datetime(2010, 1, 2, 19)]
    late = values(spark, rows, "c string", times.after_hours(times.parse_ts(F.col("c"))))
    assert late == [False, False, False, True]


def test_employment(spark):
    rows = [("2010-01-01", "2010-02-01", "2010-05-01"), ("2010-06-01", "2010-02-01", "2010-05-01"),
            ("2010-03-01", "2010-02-01", "2010-05-01"), ("2010-03-01", None, None)]
    df = spark.createDataFrame(rows, "m string, a string, b string").select(*[F.col(c).cast("date") for c in "mab"])
    args = (F.col("m"), F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(times.is_active(*args), times.join_reason(*args)).collect()]
    assert got == [(False, "pre_hire"), (False, "post_departure"), (True, "matched"), (False, "not_in_ldap")]


def test_urls(spark):
    rows = [("http://Docs.WikiLeaks.org//a/b.html?x=1",), ("https://localhost/",), ("not a url",), (None,),
            ("http://wikileaks.org/a|b",), ("http://my_host.wikileaks.org/{x}",), ('http://www.wikileaks.org">text/a',),
            ("HTTPS://me:pw@dropbox.com:8080/a b/c",), ("ftp://[::1]/x",), ("http://wikileaks.org|x",), ("http://",)]
    url = F.col("u")
    df = spark.createDataFrame(rows, "u string").select(
        web.url_depth(url), web.registrable(web.host(url)), web.in_hosts(url, web.LEAK_HOSTS)
    )
    assert [tuple(r) for r in df.collect()] == [
        (2, "wikileaks.org", True), (0, "localhost", False), (0, None, False), (0, None, False),
        (1, "wikileaks.org", True), (1, "wikileaks.org", True), (1, "wikileaks.org", True),
        (2, "dropbox.com", False), (1, "[::1]", False), (0, "wikileaks.org", True), (0, None, False),
    ]


def test_scores(spark):
    rows = [(0.95, -1.0), (0.8, 0.5), (0.5, 2.0), (0.1, None)]
    df = spark.createDataFrame(rows, "s double, c double")
    got = [tuple(r) for r in df.select(scoring.bucket(F.col("s"), scoring.ENSEMBLE_BUCKETS), scoring.clip(F.col("c"), 0.0, 1.0)).collect()]
    assert got == [("critical", 0.0), ("high", 0.5), ("medium", 1.0), ("low", None)]
    zero = F.lit(0.0)
    p = df.select(scoring.logistic(zero, zero, zero, zero, zero)).first()[0]
    assert abs(p - 0.02572) < 1e-4
