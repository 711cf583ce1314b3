"""Every registered query that has a DuckDB twin gives the twin's rows, on the smallest tables; streams; sources."""

import gzip
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalogue
from veilspark.plans import registry
from veilspark.sources import files
from veilspark.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    def one(v):
        return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


def test_all_queries_have_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("rule", F.col("event_type")).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = windows.with_watermark(spark.readStream.schema(schema).parquet(source))
    for name, make in (("tumbling", lambda d: windows.tumbling(d, "1 minute")), ("sessions", lambda d: windows.sessions(d, "5 minutes"))):
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        want = sorted(map(tuple, make(spark.read.parquet(source)).collect()))
        assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == want


def test_streaming_redaction_and_new_values(spark, tmp_path):
    source = str(tmp_path / "lines")
    rows = [("2024-01-01 00:00:00", "mail a@b.cd"), ("2024-01-01 00:00:01", "again a@b.cd and x@y.zz"), ("2024-01-01 00:00:02", "none")]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("cast(ts as timestamp) as ts", "text").write.parquet(source)
    stream = windows.with_watermark(spark.readStream.schema("ts timestamp, text string").parquet(source))
    rules = catalogue.rules("email")
    q = windows.redacted_lines(stream, rules).writeStream.format("memory").queryName("red").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("red").collect()) == ["again [EMAIL] and [EMAIL]", "mail [EMAIL]", "none"]
    q = windows.new_values(windows.hit_rows(stream, rules)).writeStream.format("memory").queryName("new").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("new").count() == 2


def test_files_and_writers(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("mail a@b.cd\nline")
    (tmp_path / "in/sub/b.txt").write_text("x")
    with gzip.open(tmp_path / "in/c.txt.gz", "wt") as f:
        f.write("zipped")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, data in (("d/e.txt", b"inside"), ("__MACOSX/x.txt", b"no"), (".hidden", b"no"), ("bin.txt", b"a\0b"), ("pic.png", b"no"), ("bad.txt", b"\xff\xfe")):
            z.writestr(name, data)
    read = {r.path.rsplit("/", 1)[-1]: r for r in files.text_files(spark, str(tmp_path / "in")).collect()}
    assert {k: r.text for k, r in read.items()} == {"a.txt": "mail a@b.cd\nline", "b.txt": "x", "c.txt.gz": "zipped"}
    members = files.archive_members(spark, str(tmp_path / "z.zip")).collect()
    assert [(r.name, r.text, r.size) for r in members] == [("d/e.txt", "inside", 6)]
    rules = [{"id": "email", "enabled": False}]
    files.write_rules(spark, catalogue.merged(rules), str(tmp_path / "rules"))
    assert not {r.id: r for r in files.read_rules(spark, str(tmp_path / "rules"))}["email"].enabled
    mapping = spark.createDataFrame([("[EMAIL-1]", 'a"b@c.de', "email", 2, "1,3")], "replacement string, original string, rule string, n long, lines string")
    files.write_mapping_csv(mapping, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().original == 'a"b@c.de'
    files.write_texts(spark.createDataFrame([("x", "one\ntwo")], "name string, text string"), str(tmp_path / "out"), "gzip")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).where("value <> ''").first().value == "one\ntwo\n"
