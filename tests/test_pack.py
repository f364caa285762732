import gzip
import random

import pytest
from driftline.sources import pack
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rnd = random.Random(4)
    texts = [b"", b"a", b"x" * 5000, bytes(rnd.randrange(256) for _ in range(3000)), "é".encode() * 90] + [f"text {k} ".encode() * (k % 40) for k in range(60)]
    rows = [(k, f"sha256:{texts[k % len(texts)].hex()[:40]}{len(texts[k % len(texts)])}", texts[k % len(texts)]) for k in range(200)] + [(900, None, b"q"), (901, "sha256:none", None)]
    df = spark.createDataFrame(rows, "seq long, data_hash string, body binary").repartition(3)
    path = f"file://{tmp_path_factory.mktemp('packs')}"
    return df, path, pack.store(df, path), rows


def test_each_hash_has_one_place(held):
    df, path, index, rows = held
    placed = pack.placed(df.drop("body"), index).collect()
    by_hash = {}
    for r in placed:
        by_hash.setdefault(r.data_hash, set()).add((r.file, r.offset))
    assert all(len(p) == 1 for p in by_hash.values()) and by_hash[None] == by_hash["sha256:none"] == {(None, None)}
    assert index.count() == len({h for _, h, b in rows if h and b is not None})


def test_bodies_come_back(held):
    df, path, index, rows = held
    got = {r.seq: r.body for r in pack.bodies(pack.placed(df.drop("body"), index), path).collect()}
    assert got == {k: bytes(b) if h and b is not None else None for k, h, b in rows}
    kinds = {r.data_hash: (r.type, r.stored, r.size) for r in index.collect()}
    for _, h, b in rows:
        if h and b is not None:
            small = len(gzip.compress(b, mtime=0))
            assert kinds[h] == (("DATZ", small, len(b)) if small < 0.9 * len(b) else ("DATA", len(b), len(b)))


def test_records_as_they_lie(spark, held):
    df, path, index, rows = held
    pack.register(spark)
    found = spark.read.format("pack").load(f"{path}/packs")
    assert {(r.file, r.offset, r.type) for r in found.where("type <> 'INFO'").collect()} == {(r.file, r.offset, r.type) for r in index.collect()}
    assert found.where("type = 'INFO'").count() == found.select("file").distinct().count()
    assert pack.disk_size(spark, path) == found.agg(F.sum(F.octet_length("data") + 8)).first()[0]


def test_only_asked_records_are_read(spark, tmp_path):
    df = spark.createDataFrame([(f"h{k}", bytes([65 + k]) * 50) for k in range(5)], "data_hash string, body binary").coalesce(1)
    index = pack.store(df, f"file://{tmp_path}")
    places = {r.data_hash: (r.file, r.offset) for r in index.collect()}
    file = tmp_path / "packs" / places["h2"][0]
    raw = bytearray(file.read_bytes())
    for h, (f, at) in places.items():  # all others of the file become nonsense, their lengths too
        if h != "h2" and f == file.name:
            raw[at : at + 20] = b"\xff" * 20
    file.write_bytes(raw)
    wanted = index.where("data_hash = 'h2'")
    assert bytes(pack.bodies(wanted, f"file://{tmp_path}").first().body) == b"C" * 50
    pack.register(spark)
    found = spark.read.format("pack").load(f"file://{tmp_path}/packs").where((F.col("file") == file.name) & F.col("offset").isin(places["h2"][1], 10**9))
    rows = found.collect()
    assert [(r.offset, pack.unpacked(r.type, bytes(r.data))) for r in rows] == [(places["h2"][1], b"C" * 50)]
    assert pack.bodies(spark.createDataFrame([(file.name, 10**9), (None, 3)], "file string, offset long"), f"file://{tmp_path}").where("body is not null").count() == 0


def test_more_bodies_are_more_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = pack.store(spark.createDataFrame([("h1", b"one"), ("h2", b"two")], "data_hash string, body binary"), path)
    before = {r.data_hash: (r.file, r.offset) for r in first.collect()}
    old = {p.name: p.read_bytes() for p in (tmp_path / "packs").iterdir() if p.suffix == ".pack"}
    again = pack.store(spark.createDataFrame([("h2", b"two"), ("h3", b"three"), ("h3", b"three")], "data_hash string, body binary"), path)
    after = {r.data_hash: (r.file, r.offset) for r in again.collect()}
    assert after.keys() == {"h1", "h2", "h3"} and all(after[h] == before[h] for h in before) and again.count() == 3
    assert all((tmp_path / "packs" / n).read_bytes() == b for n, b in old.items())
    assert pack.store(spark.createDataFrame([], "data_hash string, body binary"), path).count() == 3


def test_a_record_of_another_type(spark):
    assert pack.record("AB", b"xyz") == b"AB  \x03\x00\x00\x00xyz" and pack.unpacked("DATZ", b"bad") is None
    with pytest.raises(ValueError):
        pack.record("ABCDE", b"")


def test_packed_bodies_as_sql_on_odd_texts(spark, tmp_path):
    """Long texts that hardly shrink are compressed too, and null texts have a row."""
    import duckdb
    from driftline import catalog

    rnd = random.Random(7)
    hard = ["".join(chr(rnd.randrange(0x800, 0xD7FF)) for _ in range(n)) for n in (70, 75)]
    rows = [(k, t) for k, t in enumerate([*hard, hard[0], None, None, "", "short", "word " * 30, "word " * 300])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["packed_bodies"](spark, f"file://{tmp_path}").select("doc_id", "digest", "shared", "packed").collect()))
    assert got == sorted(con.sql(catalog.ORACLES["packed_bodies"]).fetchall())
    assert all(len(gzip.compress(t.encode(), mtime=0)) >= 0.9 * len(t.encode()) > 180 for t in hard)
