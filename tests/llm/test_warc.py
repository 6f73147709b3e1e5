import base64
import gzip
import hashlib
import io
import random

import pytest
from mnemora.llm import warc
from mnemora.llm.warc import WarcOptions

PAGES = "page_id long, url string, html string, payload string, digest int, salt int, refers_to string"


def rows():
    rng = random.Random(0)
    body = lambda n: "".join(rng.choice("abc é😀<>&\r\n") for _ in range(n))
    same = body(400)
    data = [(i, f"http://x.org/ü {i}\n", body(rng.choice([0, 1, 50, 3000])) if i % 3 else same, "c", 0, 0, "r") for i in range(5, 150)]
    return data + [(900, None, None, None, None, None, None), (901, "u", "", "c", 0, 0, "r"), (902, "u", "WARC/1.0\r\n\r\n", "c", 0, 0, "r"), (903, "u", body(300_000), "c", 0, 0, "r"), (904, "u", "z", "c", 0, 0, "r"), (904, "u", "z", "c", 0, 0, "r"), (None, "u", "z", "c", 0, 0, "r"), (None, "u", "only here", "c", 0, 0, "r")]


def brute(data, least=0):
    out = []
    for i, _, h, *_ in data:
        raw = (h or "").encode()
        ids = [j for j, _, g, *_ in data if (g or "") == (h or "") and j is not None]
        again = len(raw) >= least and ids and i != min(ids)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def digest_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_over_small_splits(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES)
    for k, options in enumerate((WarcOptions(), WarcOptions(split_bytes=700, chunk_bytes=64, file_bytes=20_000), WarcOptions(split_bytes=97))):
        assert digest_rows(warc.round_trip(df, f"file://{tmp_path}/{k}", options)) == brute(rows())


def test_small_payloads_are_always_stored(spark, tmp_path):
    options = WarcOptions(min_revisit_bytes=100)
    assert digest_rows(warc.round_trip(spark.createDataFrame(rows(), PAGES), f"file://{tmp_path}/w", options)) == brute(rows(), 100)


def test_archives_are_plain_gzip_and_payloads_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(spark.createDataFrame(rows(), PAGES), folder)
    listed = warc.files(spark, [folder])
    assert sorted((r.path, r.bytes) for r in listed.collect()) == sorted((r.path, r.bytes) for r in manifest.collect())
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert text.count(b"\r\nWARC-Record-ID: ") == len(rows()) == manifest.agg({"records": "sum"}).first()[0]
    by = {(r.page_id, r.payload_digest): bytes(r.payload) for r in warc.read(listed).where("record_type = 'response'").collect()}
    assert by[903, brute(rows())[[x[0] for x in brute(rows())].index(903)][2]].decode() == next(h for i, _, h, *_ in rows() if i == 903)


def test_reader_survives_false_magic():
    options = WarcOptions()
    good = [warc.record(i, "u", bytes([65 + i]) * 50, None, options) for i in range(4)]
    noise = warc.MAGIC + b"not gzip at all" + gzip.compress(b"gzip, but no record")
    data = noise + good[0] + warc.MAGIC + good[1] + noise + good[2] + good[3]
    whole = [m for _, m in warc._Members(io.BytesIO(data), 0, len(data), 32)]
    assert len(whole) == 4
    for step in (1, 7, 50, 1000):
        cut = [m for s in range(0, len(data), step) for _, m in warc._Members(io.BytesIO(data), s, s + step, 64)]
        assert cut == whole


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w").count() == 0


def test_one_stream_and_plain_archives(spark, tmp_path):
    options = WarcOptions(split_bytes=700, chunk_bytes=64)
    body = lambda i: bytes([65 + i % 20]) * (40 * i)
    plain = b"".join(gzip.decompress(warc.record(i, "u", body(i), None, options)) for i in range(60))
    for name, data in (("one.warc.gz", gzip.compress(plain)), ("plain.warc", plain), ("empty.warc", b"")):
        (tmp_path / name).write_bytes(data)
        got = warc.read(warc.files(spark, [f"file://{tmp_path}/{name}"]), options).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in got) == ([] if name == "empty.warc" else [(i, body(i)) for i in range(60)])


def test_damage_is_an_error(spark, tmp_path):
    rng = random.Random(3)
    options = WarcOptions()
    members = [warc.record(i, "u", rng.randbytes(3000), None, options) for i in range(3)]
    flipped = bytearray(members[2])
    flipped[-6] ^= 255  # its checksum
    plain = gzip.decompress(members[0])
    for k, data in enumerate((members[0] + members[1][:2000], members[0] + bytes(flipped), plain + plain[:-500], b"something else" + members[0])):
        name = f"{k}.warc" + ("" if k == 2 else ".gz")
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="cut short|damaged|neither"):
            warc.read(warc.files(spark, [f"file://{tmp_path}/{name}"])).collect()


def test_records_are_counted(spark, tmp_path):
    options = WarcOptions(split_bytes=900)
    manifest = warc.write(spark.createDataFrame(rows()[:20], PAGES).coalesce(1), f"file://{tmp_path}/w", options)
    assert warc.read(manifest).count() == 20
    path = max((tmp_path / "w").iterdir(), key=lambda p: p.stat().st_size)
    data = path.read_bytes()
    path.write_bytes(data[: data.rindex(warc.MAGIC)])  # the last record is gone, cleanly
    with pytest.raises(Exception, match="records from"):
        warc.read(manifest).collect()


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    options = WarcOptions(split_bytes=8000)
    manifest = warc.write(spark.createDataFrame(rows(), PAGES).coalesce(1), f"file://{tmp_path}/w", options)
    n = manifest.select(F.ceil(F.col("bytes") / 8000).alias("n")).groupBy().sum("n").first()[0]
    back = warc.read(manifest, options)
    assert n >= 8 and back.rdd.getNumPartitions() == n
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > n // 4
    assert warc.read(manifest, WarcOptions(split_bytes=8000, max_tasks=3)).rdd.getNumPartitions() == 3
