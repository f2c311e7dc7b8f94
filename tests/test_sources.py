"""Connector options and file round trips.  Document stores, Kafka and JDBC
need servers or jars that are absent here: their option maps are checked and
their calls must fail with a clear error."""

from __future__ import annotations

import json
import os

import pytest

from tidewater.sources import documents, files, jdbc, kafka
from tidewater.sources.errors import ConnectorUnavailable
from tidewater.sources.registry import ConnectorType, connector


def test_csv_null_token_and_header(spark, tmp_dir):
    df = spark.createDataFrame([(1, None), (2, "x")], "a INT, b STRING")
    opts = files.FileOptions(path=tmp_dir + "/csv", format="csv")
    files.write(df, opts)
    text = "".join(open(os.path.join(tmp_dir, "csv", f)).read() for f in os.listdir(tmp_dir + "/csv") if f.endswith(".csv"))
    assert "a,b" in text and "1,null" in text
    back = files.read(spark, opts, "a INT, b STRING").orderBy("a").collect()
    assert [tuple(r) for r in back] == [(1, None), (2, "x")]
    inferred = files.read(spark, opts)
    assert dict(inferred.dtypes)["a"] == "int"


def test_json_multiline_document(spark, tmp_dir):
    path = os.path.join(tmp_dir, "doc.json")
    with open(path, "w") as f:
        json.dump([{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}], f, indent=2)
    df = files.read(spark, files.FileOptions(path=path, format="json", multiline=True))
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_extra_write_options_win(spark, tmp_dir):
    df = spark.createDataFrame([(1, None)], "a INT, b STRING")
    opts = files.FileOptions(path=tmp_dir + "/csv2", format="csv")
    files.write(df, opts, extra={"nullValue": "NA", "header": "false"})
    text = "".join(open(os.path.join(tmp_dir, "csv2", f)).read() for f in os.listdir(tmp_dir + "/csv2") if f.endswith(".csv"))
    assert text.strip() == "1,NA"


def test_merge_writes_one_file(spark, tmp_dir):
    df = spark.range(100).repartition(4)
    files.write(df, files.FileOptions(path=tmp_dir + "/one", merge=True))
    assert len([f for f in os.listdir(tmp_dir + "/one") if f.endswith(".parquet")]) == 1


def test_option_validation():
    with pytest.raises(ValueError):
        files.FileOptions(path="x", format="xml")
    with pytest.raises(ValueError):
        files.FileOptions(path="x", save_mode="upsert")
    with pytest.raises(ValueError):
        files.FileOptions(path="x", compression="rar")
    assert files.object_store_conf("s3a", endpoint="http://minio:9000", path_style=True)[
        "spark.hadoop.fs.s3a.path.style.access"
    ] == "true"


def test_jdbc_options():
    o = jdbc.JdbcOptions(url="jdbc:postgresql://db/x", user="u", password="p", create_table_options="ENGINE=X")
    r, w = o.read_options(), o.write_options()
    assert r["fetchsize"] == "1000" and "batchsize" not in r
    assert w["batchsize"] == "1000" and w["isolationLevel"] == "READ_UNCOMMITTED" and "fetchsize" not in w
    assert w["createTableOptions"] == "ENGINE=X"
    split = jdbc.JdbcOptions(url="u", partition_column="id", lower_bound=0, upper_bound=100, num_partitions=8)
    assert split.read_options()["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc.JdbcOptions(url="u", partition_column="id")
    with pytest.raises(ValueError):
        jdbc.JdbcOptions(url="u", isolation_level="SOMETIMES")


def test_jdbc_batch_writer_skips_committed_batches(spark):
    calls = []
    body = jdbc.batch_writer(jdbc.JdbcOptions(url="jdbc:none:"), "t", committed_batches=lambda b: calls.append(b) or True)
    body(spark.range(1), 7)  # already committed: nothing is written, no connection is opened
    assert calls == [7]


def test_jdbc_at_least_once_never_skips(spark):
    calls = []
    body = jdbc.batch_writer(
        jdbc.JdbcOptions(url="jdbc:none:"), "t", exactly_once=False, committed_batches=lambda b: calls.append(b) or True
    )
    with pytest.raises(Exception):
        body(spark.range(1), 7)  # goes straight to the (unreachable) database
    assert calls == []


class _Cause:
    def __init__(self, state=None, cause=None):
        self.state, self.cause = state, cause

    def getSQLState(self):
        return self.state

    def getErrorCode(self):
        return 0

    def getCause(self):
        return self.cause


def test_jdbc_probe_forgives_only_a_missing_table():
    def failed(cause):
        error = RuntimeError("read failed")
        error.java_exception = cause
        return error

    assert jdbc.is_missing_table(failed(_Cause("42P01")))
    assert jdbc.is_missing_table(failed(_Cause(None, _Cause("42S02"))))
    assert not jdbc.is_missing_table(failed(_Cause("08001")))  # no connection
    assert not jdbc.is_missing_table(failed(_Cause("28000")))  # refused login
    assert not jdbc.is_missing_table(RuntimeError("time-out"))


def test_jdbc_failed_probe_fails_the_batch(spark):
    from unittest import mock

    body = jdbc.batch_writer(jdbc.JdbcOptions(url="jdbc:none:"), "t")
    with mock.patch("pyspark.sql.DataFrameWriter.save") as save, pytest.raises(Exception):
        body(spark.range(1), 0)  # no such driver: not the same as "nothing written yet"
    save.assert_not_called()


def test_jdbc_replayed_batch_appends_only_what_is_missing(spark):
    rows = [("a", 1), ("a", 1), ("a", 1), ("b", None), (None, 2)]
    batch = jdbc.stamped(spark.createDataFrame(rows, "v STRING, n INT"), "s1", 4)
    assert batch.select("stream_id", "batch_id").distinct().collect() == [("s1", 4)]
    digests = {(r.v, r.n): r.row_digest for r in batch.collect()}
    assert len(set(digests.values())) == 3
    written = spark.createDataFrame([(digests["a", 1],), (digests["a", 1],), (digests[None, 2],)], "row_digest STRING")
    left = jdbc.missing_rows(batch, written)
    assert left.columns == batch.columns
    assert sorted((r.v, r.n) for r in left.collect()) == [("a", 1), ("b", None)]
    assert jdbc.missing_rows(batch, batch.select("row_digest")).count() == 0
    assert jdbc.missing_rows(batch, written.limit(0)).count() == 5


def test_kafka_options_and_payload(spark):
    o = kafka.KafkaOptions(bootstrap_servers="b:9092", topic="logs", starting_offsets="earliest", max_offsets_per_trigger=100)
    r = o.read_options()
    assert r == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "logs", "startingOffsets": "earliest",
        "failOnDataLoss": "false", "maxOffsetsPerTrigger": "100",
    }
    assert "key.serializer" not in o.write_options()
    with pytest.raises(ValueError):
        kafka.KafkaOptions(bootstrap_servers="b", topic="t", starting_offsets="yesterday")
    raw = spark.createDataFrame([(bytearray(b'{"k": 3, "z": "q"}'),)], "value BINARY")
    assert tuple(kafka.parse_json_payload(raw, "k INT, z STRING").first()) == (3, "q")
    rec = kafka.to_kafka_records(spark.createDataFrame([(1, "a")], "id INT, v STRING"), key_column="id").first()
    assert rec.key == "1" and json.loads(rec.value) == {"id": 1, "v": "a"}


def test_kafka_missing_jar_is_clear(spark):
    with pytest.raises(ConnectorUnavailable):
        kafka.read_stream(spark, kafka.KafkaOptions(bootstrap_servers="b:9092", topic="t"))


def test_arango_ssl_cursor_and_overwrite_options():
    plain = documents.ArangoOptions(endpoints="h:8529")
    assert not {"ssl.enabled", "ssl.cert.value", "ttl", "confirmTruncate"} & set(plain.read_options(collection="c"))
    assert "confirmTruncate" not in plain.write_options("c")
    assert plain.write_options("c", "overwrite")["confirmTruncate"] == "true"
    o = documents.ArangoOptions(endpoints="h:8529", ssl=True, ssl_certificate="QUJD", cursor_ttl_s=60)
    r = o.read_options(query="RETURN 1")
    assert (r["ssl.enabled"], r["ssl.cert.value"], r["ttl"]) == ("true", "QUJD", "60")
    assert "ttl" not in o.write_options("c")


def test_document_store_options(spark):
    m = documents.MongoOptions(connection_uri="mongodb://h", database="db")
    assert m.read_options("sales") == {"connection.uri": "mongodb://h", "database": "db", "collection": "sales"}
    a = documents.ArangoOptions(endpoints="h:8529")
    assert a.read_options(collection="products")["table"] == "products"
    assert a.read_options(query="FOR d IN products RETURN d")["query"].startswith("FOR")
    with pytest.raises(ValueError):
        a.read_options()
    with pytest.raises(ConnectorUnavailable):
        documents.mongo_read(spark, m, "sales", pipeline=[{"$match": {"x": 1}}])
    with pytest.raises(ConnectorUnavailable):
        documents.arango_read(spark, a, "products", "product_id = '1'", ["product_name"])


def test_registry():
    assert connector("file").read is files.read
    assert connector(ConnectorType.KAFKA).read_stream is kafka.read_stream
    with pytest.raises(ValueError):
        connector("ftp")
    with pytest.raises(LookupError):
        connector("mongodb", enabled={"file"})


def test_query_reads(spark):
    with pytest.raises(ValueError):
        jdbc.read_query(spark, jdbc.JdbcOptions(url="u", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=2), "SELECT 1")
    with pytest.raises(ConnectorUnavailable):
        documents.arango_read_query(spark, documents.ArangoOptions(endpoints="h:8529"), "FOR d IN products RETURN d")


def test_sampling_ratio_only_for_inference():
    o = files.FileOptions(path="x", format="json", sampling_ratio=0.1)
    assert o.read_options(infer_schema=True)["samplingRatio"] == "0.1"
    assert "samplingRatio" not in o.read_options(infer_schema=False)


def test_registry_dispatch(spark, tmp_dir):
    from tidewater.sources.registry import read_with

    spark.range(3).write.parquet(tmp_dir + "/p")
    assert read_with("file", spark, files.FileOptions(path=tmp_dir + "/p")).count() == 3
    with pytest.raises(ConnectorUnavailable):
        read_with("mongodb", spark, documents.MongoOptions("mongodb://h", "db"), "sales")
    with pytest.raises(LookupError):
        read_with("kafka", spark)  # a stream-only connector has no batch reader
