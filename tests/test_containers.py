import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidpress.__main__ import main
from braidpress.operators import container as box
from braidpress.sources import formats, model


def sample():
    c = box.Container(0x12345678, 3, 6, flags=5, uncompressed_len=1000)
    for i, data in enumerate((b"a" * 100, b"b" * 150, b"")):
        c.add_chunk(data, 48 if i == 2 else 64, i == 2)
    return c


def test_round_trip():
    c = sample()
    back = box.Container.from_bytes(c.to_bytes())
    assert back == c and back.total_tokens == 176 and [back.chunk_tokens(i) for i in range(3)] == [64, 64, 48]
    assert box.Container.from_bytes(c.to_bytes(compressed=False), compressed=False) == c
    assert c.compressed_size() == len(c.to_bytes())
    c.multifile = False
    assert not c.multifile and c.flags == 4
    c.multifile = True
    assert c.flags == 5
    assert box.Container().total_tokens == 0


def test_broken_containers():
    raw = sample().to_bytes()
    payload = sample().payload()
    for bad in (raw[:10], b"X" + raw[1:], raw[:7] + b"\x07" + raw[8:], raw[:30]):
        with pytest.raises(box.ContainerError):
            box.Container.from_bytes(bad)
    for bad in (payload[:8], payload[:14], payload[:-1]):
        with pytest.raises(box.ContainerError):
            box.Container.from_payload(bad)
    zero = payload[:11] + b"\0" + payload[12:]
    assert box.Container.from_payload(zero).context_log2 == 6
    with pytest.raises(box.ContainerError):
        box.Container(context_log2=13)
    with pytest.raises(box.ContainerError):
        box.Container().add_chunk(b"x" * 65536, 1)
    with pytest.raises(box.ContainerError):
        box.codec_name(7)


def test_columns_read_what_python_writes(spark):
    c = sample()
    df = spark.createDataFrame([(1, c.to_bytes())], "id int, container binary")
    rows = box.split_chunks(df, ["id"]).orderBy("chunk_idx").collect()
    assert [bytes(r.coded) for r in rows] == c.chunks and [r.n_tokens for r in rows] == [64, 64, 48]
    inner = spark.createDataFrame([(c.payload(),)], "p binary").select(box.parse_inner(F.col("p")).alias("i")).first().i
    assert inner.model_id_hash == 0x12345678 and inner.chunk_byte_lens == [100, 150, 0] and inner.tokenizer_id == 3


@pytest.mark.parametrize("damage", [lambda r: r[:10], lambda r: b"X" + r[1:], lambda r: r[:7] + b"\x07" + r[8:]])
def test_columns_reject_damage(spark, damage):
    df = spark.createDataFrame([(1, damage(sample().to_bytes()))], "id int, container binary")
    with pytest.raises(PySparkException):
        box.split_chunks(df, ["id"]).collect()


def test_brotli_is_named_when_missing():
    try:
        import brotli  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="brotli"):
            box.outer_compress(b"x", "brotli")


def test_files_and_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "c").mkdir()
    path = str(tmp_path / "m" / "model.bin")
    assert main(["export", "--output", path]) == 0 and main(["verify", path]) == 0
    text = "The old line.\r\nGrüße 😀 <|endoftext|>\r\n" * 9
    for name, raw in (("a", text.encode()), ("b", b""), ("c", b"x")):
        src, out, back = (str(tmp_path / f"{name}.{e}") for e in ("txt", "czip", "back"))
        with open(src, "wb") as f:
            f.write(raw)
        assert main(["compress", src, out, "-m", path, "-L", "2"]) == 0
        assert main(["decompress", out, back, "-m", path]) == 0
        with open(back, "rb") as f:
            assert f.read() == raw
    formats.register(spark)
    import shutil

    shutil.copy(tmp_path / "a.czip", tmp_path / "c" / "a.czip")
    by_format = spark.read.format("braid_container").load(str(tmp_path / "c")).orderBy("chunk_idx").collect()
    by_plan = formats.read_containers(spark, str(tmp_path / "c")).orderBy("chunk_idx").collect()
    assert [bytes(r.coded) for r in by_format] == [bytes(r.coded) for r in by_plan] and len(by_plan) > 1
    t = spark.read.format("braid_tensors").load(str(tmp_path / "m"))
    assert t.count() == formats.read_tensors(spark, str(tmp_path / "m")).count() == 28
    cells = formats.tensor_cells(formats.read_tensors(spark, str(tmp_path / "m")).where("name = 'lut.exp2'"))
    assert cells.agg(F.sum("value")).first()[0] == 12118595
    read = formats.read_texts(spark, str(tmp_path / "a.txt"))
    assert read.first().text == text
    formats.write_texts(read.withColumn("doc_id", F.lit(3)), str(tmp_path / "t"))
    assert (tmp_path / "t" / "3.txt").read_bytes() == text.encode()
    boxes = spark.createDataFrame([(7, sample().to_bytes())], "doc_id long, container binary")
    formats.write_containers(boxes, str(tmp_path / "w"))
    assert box.Container.from_bytes((tmp_path / "w" / "7.czip").read_bytes()) == sample()


def test_model_hash(spark):
    assert spark.range(1).select(box.model_hash(F.lit("models/x.czm"))).first()[0] == 2722661412


def test_decompress_rejects_another_model(tmp_path):
    from braidpress.__main__ import compress, decompress

    w, v = model.fixture(), model.small_vocabulary()
    out, figures = compress(b"plain text here", w, v)
    assert decompress(out, w, v) == b"plain text here" and figures["tokens"] > 0
    empty, figures = compress(b"", w, v)
    assert decompress(empty, w, v) == b"" and figures["ratio"] is None
