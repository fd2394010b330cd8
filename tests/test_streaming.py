import pytest
from pyspark.sql import functions as F

from textsentry.operators.pii import PIIDetector
from textsentry.plans.compiler import Compiler
from textsentry.plans.model import Policy, Rule
from textsentry.streaming import scan as S


class Small:
    """An engine with one cheap rule."""

    def __init__(self):
        self.compiler = Compiler()
        self.compiler.register("custom", lambda text, config: PIIDetector(enabled=["SSN"]).detect(text))

    def scan(self, df, text="text", into="scan"):
        return self.compiler.scan(df, [Policy("p", rules=[Rule("r", "custom", action="deny")])], text, into)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = [(i, f"u{i % 3}", "SSN 123-45-6789" if i % 2 else "none") for i in range(60)]
    spark.createDataFrame(rows, "i int, user string, text string").withColumn("ts", F.timestamp_seconds(F.col("i") * 60 + 1_700_000_000)).coalesce(1).write.parquet(path)
    return path


def run(spark, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream(spark, table):
    return spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)


def test_stream_equals_batch(spark, table):
    got = run(spark, S.scan_stream(stream(spark, table), Small()).select("i", "scan.action"), "rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Small().scan(spark.read.parquet(table)).select("i", "scan.action").collect()))


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows(spark, table, slide):
    build = lambda df: S.windowed(Small().scan(df), "ts", "10 minutes", slide)
    got = run(spark, build(stream(spark, table)), f"windows{slide is None}", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(spark.read.parquet(table)).collect()))


def test_sessions(spark, table):
    rows = S.sessions(Small().scan(spark.read.parquet(table)), "ts", "user").collect()
    assert len(rows) == 3 and sum(r.denied for r in rows) == 30


def test_escalation(spark, table):
    got = run(spark, S.escalated(Small().scan(stream(spark, table)), "user", 5), "users", "complete")
    assert sorted((r.user, r.denied) for r in got.collect()) == [("u0", 10), ("u1", 10), ("u2", 10)]


def test_observed(spark, table):
    from pyspark.sql import Observation

    seen = Observation("o")
    Small().scan(spark.read.parquet(table)).observe(seen, F.count(F.lit(1)).alias("scans")).collect()
    assert seen.get["scans"] == 60
    assert S.observed(Small().scan(spark.read.parquet(table))).count() == 60
