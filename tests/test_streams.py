from datetime import datetime, timedelta

import pytest
from driftline.streaming import state


@pytest.mark.parametrize("form", [state.captures, lambda rows: state.first_seen(rows, order="captured")])
def test_old_rows_in_a_later_batch(spark, tmp_path, form):
    new, old = datetime(2023, 1, 1), datetime(2019, 1, 1)
    batches = [[(1, new), (1, new), (2, new + timedelta(days=400))], [(3, old), (3, old), (1, new)], [(4, old), (3, old)]]
    source, schema = tmp_path / "in", "url_id long, captured timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        # each call goes on from the state of the one before
        got = state.replay(form(spark.readStream.schema(schema).parquet(f"file://{source}")), f"file://{tmp_path}/out")
        want, seen = set(), set()
        for b in batches[: n + 1]:
            own = sorted(set(b), key=lambda r: r[1])
            if form is not state.captures:
                own = [r for k, r in enumerate(own) if r[0] not in seen | {x[0] for x in own[:k]}]
            want |= set(own)
            seen |= {r[0] for r in own}
        assert sorted((r.url_id, r.captured) for r in got.collect()) == sorted(want)


def _files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        yield spark.readStream.schema(schema).parquet(f"file://{folder}")


def test_robots_are_fetched_once(spark, tmp_path):
    batches, seen = [[("a", 1), ("b", 3)], [("a", 4), ("c", 5)], [("c", 6), ("b", 7)]], set()
    for n, stream in enumerate(_files(spark, tmp_path / "in", batches, "authority string, seq long")):
        got = state.replay(state.robots_fetches(stream), f"file://{tmp_path}/out").collect()
        for authority, seq in batches[n]:
            seen |= {(authority, seq)} if authority not in {a for a, _ in seen} else set()
        assert sorted(map(tuple, got)) == sorted(seen)


def test_robots_answers_from_state(spark, tmp_path):
    """Three sites, a good file, a failed fetch and one without rules, asked before and after, batch by batch."""
    batches = [
        [("good", 1, "/x/1", None), ("bad", 2, "/x", None), ("none", 3, "/x", None), ("good", 4, None, "User-agent: *\nDisallow: /x\nUser-agent: indexer\nDisallow: /y\nUser-agent: other\nDisallow: /"), ("good", 5, "/x/1", None)],
        [("bad", 6, None, None), ("bad", 7, "/x", None), ("good", 8, "/y", None), ("good", 9, "/z", None), ("none", 10, None, "no file")],
        [("none", 12, "/x", None), ("bad", 13, "/y", None), ("good", 11, "/x", None), ("new", 14, "/", None), ("bad", 15, None, "User-agent: *\nDisallow:"), ("bad", 16, "/x", None)],
    ]
    want = {
        1: (True, True), 2: (True, True), 3: (True, True), 5: (False, False), 7: (True, False), 8: (False, False), 9: (True, True), 12: (True, False), 13: (True, False), 11: (False, False), 14: (True, True), 16: (True, True),
    }
    for n, stream in enumerate(_files(spark, tmp_path / "in", batches, "authority string, seq long, path string, content string")):
        got = {r.seq: (r.allowed, r.allowed_offline) for r in state.replay(state.robots_answers(stream), f"file://{tmp_path}/out").collect()}
        asked = {r[1] for b in batches[: n + 1] for r in b if r[2] is not None}
        assert got == {k: v for k, v in want.items() if k in asked}


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    """Connectivity, politeness and documents over several batches are those of all rows in one batch form."""
    from driftline.operators import documents, reports

    schema = "authority long, url_id long, seq long, received timestamp, status_code int, response_hash string, is_text boolean, failed boolean, terminal boolean"
    rows = [(k % 3, k % 5, k, datetime(2023, 1, 1) + timedelta(hours=(k * 7) % 40), (20, 51, 44, 20, 31)[k * k % 5], f"h{k % 4}", k % 6 != 0, k % 4 != 0, k == 70) for k in range(90)]
    batches = [rows[:31], rows[31:32], rows[32:]]
    forms = {"c": state.connectivity, "p": state.politeness}
    latest = {}
    for stream in _files(spark, tmp_path / "in", batches, schema):
        got = {k: state.replay(f(stream), f"file://{tmp_path}/{k}") for k, f in forms.items()}
        put = []
        run = state.documents(stream).writeStream.outputMode("update").foreachBatch(lambda b, e, put=put: put.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/d").trigger(availableNow=True).start()
        run.awaitTermination()
        latest |= {r.url_id: r for r in put}
    log = spark.createDataFrame(rows, schema)
    assert sorted((r.authority, r.seq, r.down) for r in got["c"].collect()) == sorted((r.authority, r.seq, r.down) for r in reports.connectivity(log).collect())
    assert sorted((r.authority, r.seq, r.wait_ms) for r in got["p"].collect()) == sorted((r.authority, r.seq, r.wait_ms) for r in reports.politeness(log).collect())
    names = ["url_id", "first_seen", "last_visit", "last_successful_visit", "last_time_updated", "status_code", "response_hash", "seq"]
    want = {r.url_id: tuple(r[n] for n in names) for r in documents.fold(log).collect()}
    assert {k: tuple(r[n] for n in names) for k, r in latest.items()} == want


def test_index_and_links_by_batch(spark, tmp_path):
    held = {"index": spark.createDataFrame([(1, "t", "old"), (2, "t", "stays")], "url_id long, title string, body string").collect()}
    schema = "url_id long, title string, body string"

    def write(df, epoch):
        held["index"] = df.collect()

    put = state.upsert_into(lambda s: s.createDataFrame(held["index"], schema), write)
    batches = [[(1, "RefreshWithCurrent", "t", "new"), (3, "AddCurrent", "t", "three")], [(3, "DeletePrevious", None, None), (2, "Nothing", "t", "x")]]
    for stream in _files(spark, tmp_path / "in", batches, "url_id long, action string, title string, body string"):
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, held["index"])) == [(1, "t", "new"), (2, "t", "stays")]

    links, changes = [(1, 2, True, "x"), (1, 3, True, "y"), (5, 6, True, "z")], []
    link_schema = "source_url_id long, target_url_id long, is_external boolean, link_text string"
    told = state.link_changes_per_batch(lambda s: s.createDataFrame(links, link_schema), lambda df, epoch: changes.append({(r.source_url_id, r.target_url_id): r.change for r in df.collect()}))
    for stream in _files(spark, tmp_path / "links", [[(1, 2, True, "x"), (1, 4, True, "n")], [(5, 6, True, "new text")]], link_schema):
        stream.writeStream.foreachBatch(told).option("checkpointLocation", f"file://{tmp_path}/l").trigger(availableNow=True).start().awaitTermination()
    assert changes == [{(1, 2): "unchanged", (1, 3): "removed", (1, 4): "added"}, {(5, 6): "updated"}]
