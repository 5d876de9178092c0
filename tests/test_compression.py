import pytest
from pyspark.errors import PySparkException

from braidpress.plans import compress
from braidpress.sources import model
from braidpress.streaming.compress import compress_stream, decompress_stream

TEXTS = ["", "x", "the " * 100, "a\r\nb c 😀" * 20, "on <|endoftext|> it", None, "q" * 700]


@pytest.fixture(scope="module")
def weights():
    return model.fixture()


@pytest.mark.parametrize("level", [1, 3])
def test_documents_round_trip(spark, weights, level):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    boxes = compress.compress_documents(df, weights, level=level).cache()
    assert {r.doc_id: r.text for r in compress.decompress_documents(boxes, weights).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    r = compress.compression_report(boxes, []).first()
    assert r.texts == len(TEXTS) and r.n_bytes == sum(len((t or "").encode()) for t in TEXTS) and r.ratio > 0
    none = compress.compression_report(boxes.where("doc_id = 0"), ["doc_id"]).first()
    assert none.percent is None and none.bits_per_token is None
    boxes.unpersist()


def test_repeated_keys_raise(spark, weights):
    for texts in (["one", "two"], ["", "two"], ["", ""]):
        with pytest.raises(PySparkException, match="several texts"):
            compress.compress_documents(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"), weights).collect()


def test_partitioning_does_not_matter(spark, weights):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    a = {r.doc_id: bytes(r.container) for r in compress.compress_documents(df, weights).collect()}
    b = {r.doc_id: bytes(r.container) for r in compress.compress_documents(df.repartition(1), weights).collect()}
    assert a == b


def test_stream_equals_batch(spark, weights, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = compress_stream(src, weights).writeStream.format("memory").queryName("braid_boxes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    boxes = spark.table("braid_boxes")
    batch = compress.compress_documents(df, weights)
    assert {r.doc_id: bytes(r.container) for r in boxes.collect()} == {r.doc_id: bytes(r.container) for r in batch.collect()}
    assert {r.doc_id: r.text for r in decompress_stream(boxes, weights).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
