import gzip
import random
from datetime import datetime

import pytest
from driftline.sources import warc

T0 = datetime(2023, 1, 1)


def one(n, size):
    rnd = random.Random(n)
    return warc.record("response", f"gemini://h/{n}", T0, "application/gemini", b"20 text/plain\r\n" + bytes(rnd.randrange(256) for _ in range(size)))


def members(numbers, size=300):
    return b"".join(gzip.compress(one(n, size), mtime=0) for n in numbers)


def urls(df):
    return sorted(r.url for r in df.select("url").collect())


def names(numbers):
    return sorted(f"gemini://h/{n}" for n in numbers)


@pytest.mark.parametrize("split", [1, 200, 1000, 5000])
def test_parts_of_a_gzip_file(spark, tmp_path, split):
    """Every record is in one part, wherever the parts begin."""
    raw = members(range(40))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    files = warc._Files({"path": f"file://{tmp_path}", "split": str(split)})
    parts = files.parts(files.sizes())
    assert len(parts) == -(-len(raw) // split)
    rows = [r for p in parts for r in files.rows(p)]
    assert [r[3] for r in rows] == [f"gemini://h/{n}" for n in range(40)]
    whole = [r for p in warc._Files({"path": f"file://{tmp_path}", "split": "0"}).parts(files.sizes()) for r in files.rows(p)]
    assert rows == whole and all(a[1] < b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_several_tasks_and_damaged_places(spark, tmp_path):
    raw = members(range(30), 2000)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "plain.warc").write_bytes(one(100, 50) + one(101, 50))
    (tmp_path / "one-member.warc.gz").write_bytes(gzip.compress(b"".join(one(n, 500) for n in range(200, 220))))
    df = warc.read(spark, f"file://{tmp_path}", split=len(raw) // 5 + 1)
    assert df.rdd.getNumPartitions() > 6 and urls(df) == names([*range(30), 100, 101, *range(200, 220)])
    assert df.select("file", "record_no").distinct().count() == 52
    # the middle of a part is damaged: the other parts stay, and what came before
    broken = bytearray(raw)
    broken[len(raw) // 2 : len(raw) // 2 + 500] = b"\x00" * 500
    (tmp_path / "a.warc.gz").write_bytes(broken)
    left = {r.url for r in warc.read(spark, f"file://{tmp_path}/a.warc.gz", split=len(raw) // 5 + 1).collect()}
    assert left < set(names(range(30))) and {"gemini://h/0", "gemini://h/29"} <= left and len(left) >= 24
    # a file that ends within a record
    (tmp_path / "a.warc.gz").write_bytes(raw[:-100])
    assert urls(warc.read(spark, f"file://{tmp_path}/a.warc.gz", split=len(raw) // 5 + 1)) == names(range(29))


def test_files_are_read_once_as_they_come(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    want = []
    for batch in ([(0, 5)], [(5, 9), (9, 12)], [], [(12, 13)]):
        for a, z in batch:
            held = source / f".{a}"
            held.write_bytes(members(range(a, z)))
            held.rename(source / f"{9999 - a}.warc.gz")  # later files have earlier names
            want += range(a, z)
        run = warc.read_stream(spark, f"file://{source}", split=700).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        assert urls(spark.read.parquet(f"{out}/rows")) == names(want)


def test_blocked_responses_but_special_files(spark):
    from driftline.operators import crawl, rules

    lines = spark.createDataFrame([(0, "gemini://a/"), (1, "regex:secret")], "line_no int, line string")
    rows = spark.createDataFrame([("gemini://a/x", "a"), ("gemini://a/robots.txt", "a"), ("gemini://b/secret", "b"), ("gemini://b/favicon.txt", "b"), ("gemini://b/ok", "b")], "url string, authority string")
    assert urls(crawl.admitted(rows, rules.parse_block_rules(lines))) == ["gemini://a/robots.txt", "gemini://b/favicon.txt", "gemini://b/ok"]


def test_empty_folder(spark, tmp_path):
    assert warc.read(spark, f"file://{tmp_path}").count() == 0
