"""Incremental forms of the stateful operators, on Structured Streaming.

State is kept per key: the document state, the last ten outcomes, the key itself of what has been seen. Nothing is
dropped as late. Rows of a key arrive batch by batch; within a batch they are folded in order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.functions.robots import robots_lines
from driftline.operators.reports import DOWN_SHARE, FIRST_WAIT, LONGEST_WAIT, SAMPLES, SLOW_DOWN

_DOC = "url_id bigint, first_seen timestamp, last_visit timestamp, last_successful_visit timestamp, last_time_updated timestamp, status_code int, response_hash string, seq bigint, action string"
_DOC_STATE = "first_seen timestamp, last_visit timestamp, last_successful_visit timestamp, last_time_updated timestamp, status_code int, response_hash string, seq bigint"


def _ok(status: int | None) -> bool:
    return status is not None and 20 <= status <= 29


def _none(x):
    return None if x is None or x is pd.NaT else x


def _documents(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = [_none(x) for x in state.get] if state.exists else None
    action = "Nothing"
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.itertuples(index=False):
        ok, was_ok = _ok(r.status_code), s is not None and _ok(s[4])
        if s is None or (r.received > s[1] and r.response_hash != s[5]):
            action = ("AddCurrent" if s is None else "RefreshWithCurrent") if ok and r.is_text else "DeletePrevious" if was_ok and not ok else "Nothing"
            success = r.received if ok else (s[2] if s else None)
            s = [r.received if s is None else s[0], r.received, success, r.received, int(r.status_code), r.response_hash, int(r.seq)]
        elif r.received == s[1]:
            continue
        elif r.received < s[1]:
            s[0] = min(s[0], r.received)
            if r.response_hash == s[5]:
                s[3] = r.received
        else:
            s[1] = r.received
            if ok:
                s[2] = r.received
    state.update(tuple(s))
    yield pd.DataFrame([(key[0], *s, action)], columns=[x.split()[0] for x in _DOC.split(", ")])


def documents(responses: DataFrame) -> DataFrame:
    """Update stream of a URL's document state and its last index action, as documents.fold() has it in batch."""
    return responses.groupBy("url_id").applyInPandasWithState(_documents, _DOC, _DOC_STATE, "update", GroupStateTimeout.NoTimeout)


def _connectivity(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, stuck = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
    out = []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
        last = [*last, int(r.failed)][-SAMPLES:]
        stuck = bool(stuck or r.terminal)
        out.append((key[0], r.seq, stuck or (len(last) == SAMPLES and sum(last) / SAMPLES > DOWN_SHARE)))
    state.update((last, stuck))
    yield pd.DataFrame(out, columns=["authority", "seq", "down"])


def connectivity(log: DataFrame) -> DataFrame:
    return log.groupBy("authority").applyInPandasWithState(_connectivity, "authority bigint, seq bigint, down boolean", "last array<int>, stuck boolean", "append", GroupStateTimeout.NoTimeout)


def _politeness(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    out = []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
        n += int(r.status_code == SLOW_DOWN)
        out.append((key[0], r.seq, min(LONGEST_WAIT, FIRST_WAIT * 2 ** min(n, 20))))
    state.update((n,))
    yield pd.DataFrame(out, columns=["authority", "seq", "wait_ms"])


def politeness(log: DataFrame) -> DataFrame:
    return log.groupBy("authority").applyInPandasWithState(_politeness, "authority bigint, seq bigint, wait_ms bigint", "n int", "append", GroupStateTimeout.NoTimeout)


def _firsts(order: str):
    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:  # one row of each is kept
            best = pd.concat([x for x in (best, frame) if x is not None]).nsmallest(1, order)
        if not state.exists and best is not None:
            state.update((True,))
            yield best

    return first


def _first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the batch in which it first comes. The state is a flag per key."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(_firsts(order), schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def first_seen(urls: DataFrame, key: str = "url_id", order: str = "seq") -> DataFrame:
    """Each URL when it first comes, with all its columns. No watermark: rows are in any order of time, so the state keeps every
    key. Null keys are left out."""
    return _first_of(urls, key, order)


def robots_fetches(requests: DataFrame) -> DataFrame:
    """For each site the first request of it (authority, seq): the one for which the robots file is fetched; what it says
    is kept for all later ones, see ``robots_answers``."""
    return _first_of(requests.select("authority", "seq"), "authority", "seq")


def _robots(agent: str):
    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, denied = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            if r.path is None:  # the answer to a fetch
                found = [(a, p) for _, what, a, p, _ in robots_lines(r.content) if what == "rule"] if r.content is not None else []
                asked, denied = True, sorted({p for a, p in found if a in ("*", agent) and p}) if found else None
            else:
                free = denied is None or not any(r.path.startswith(p) for p in denied)
                out.append((key[0], r.seq, r.path, free, not asked or (denied is not None and free)))
        if asked:
            state.update((None if denied is None else list(denied),))
        yield pd.DataFrame(out, columns=["authority", "seq", "path", "allowed", "allowed_offline"])

    return answer


def robots_answers(rows: DataFrame, agent: str = "indexer") -> DataFrame:
    """Requests answered from what is kept of their sites' robots files. ``rows`` (authority, seq, path, content) are requests, and
    with a null path what a fetch of a site's file gave: its content, or null where it failed. A site's state is the paths
    that it denies, or nothing where the fetch failed or gave no rule. ``allowed`` refuses denied paths only;
    ``allowed_offline``, for who may not fetch, allows sites that weren't asked and refuses those whose fetch gave nothing."""
    known = "authority bigint" if rows.schema["authority"].dataType.simpleString() == "bigint" else "authority string"
    return rows.select("authority", "seq", "path", "content").groupBy("authority").applyInPandasWithState(_robots(agent.lower()), f"{known}, seq bigint, path string, allowed boolean, allowed_offline boolean", "denied array<string>", "append", GroupStateTimeout.NoTimeout)


def captures(responses: DataFrame, event_time: str = "captured") -> DataFrame:
    """Each (url_id, captured) once. No watermark, as old files are loaded after new ones too: the state keeps every key
    (in memory unless the session sets RocksDB as its state store)."""
    return responses.dropDuplicates(["url_id", event_time])


def upsert_into(read_index, write_index):
    """For foreachBatch: applies a batch of index actions. read_index(spark) and write_index(df, epoch) own the table."""

    def apply(batch: DataFrame, epoch: int) -> None:
        from driftline.operators.fts import apply_actions

        write_index(apply_actions(read_index(batch.sparkSession), batch), epoch)

    return apply


def link_changes_per_batch(read_links, write_changes):
    """For foreachBatch: differences between a batch's links and those known of the same sources."""

    def apply(batch: DataFrame, epoch: int) -> None:
        from driftline.operators.documents import link_changes

        known = read_links(batch.sparkSession).join(batch.select("source_url_id").distinct(), "source_url_id", "left_semi")
        write_changes(link_changes(known, batch), epoch)

    return apply


def replay(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over all that its source has now, into Parquet under ``folder``, and reads that."""
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


__all__ = ["captures", "connectivity", "documents", "first_seen", "link_changes_per_batch", "politeness", "replay", "robots_answers", "robots_fetches", "upsert_into"]
