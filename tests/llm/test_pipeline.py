import corpus_pipeline
from driftline.llm import quality, queries, secrets
from driftline.llm.common import Scratch, owned, table
from driftline.llm.encode import Encoder, public
from pyspark.sql import functions as F

from .test_neardup import brute

DIR = "/root/testdata/sf0.001"


def test_pipeline_against_plain(spark):
    docs = table(spark, DIR, "documents")
    model = quality.fit(docs, table(spark, DIR, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    import numpy as np

    good = {i: t for i, t in rows.items() if model.score(np.array([quality.features(t or "")]))[0] >= quality.CUT}
    assert 0 < len(good) < len(rows)
    kept = {i: good[i] for i, c in brute(list(good.items())).items() if c == i}
    lib = Encoder(public(queries.PACKED)).library
    want = {i: len(lib.encode(secrets.redacted(t), add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = {}
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_keep_columns(spark):
    docs = table(spark, DIR, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, DIR).toPandas()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        said = [sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).values)) for df in (got, want)]
        assert said[0] == said[1], name


def test_repeated_ids_with_several_texts(spark, tmp_path):
    """A copy under an id that is kept for another text goes; the run of an empty table is empty."""
    a, b = "words of one text that stand here", "quite another text with other words"
    rows = [(1, a), (5, a), (5, b)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, df, DIR).collect()) == [(1, a), (5, b)]
    df.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "x"), (2, "A b c d e f"), (3, ""), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 5.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    got = corpus_pipeline.one_of_each(spark, df, DIR).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, "x"), (-1, "x"), (1, "a b c d e f"), (3, ""), (4, "")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, DIR).columns == df.columns
        assert stage(spark, df.limit(0), DIR).count() == 0
    assert corpus_pipeline.packed(spark, df, DIR).count() == len(rows)


def test_columns_of_any_name_and_type(spark):
    """Columns named as the operators' own, maps, and ids that are no integers."""
    import pytest

    rows = [(1, "a b c d e f", {"k": 2}, 9), (1, "a b c d e f", {"k": 1}, 9), (2, "a b c d e f", {"k": 3}, 9), (3, "other words", {}, 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, own_id map<string,int>, screen_word int").withColumns({"own_digest": F.lit("x"), "is_again": F.lit(1), "screen_place": F.lit(2), "SCREEN_BITS": F.lit(3)})
    got = corpus_pipeline.one_of_each(spark, df, DIR)
    assert got.columns == df.columns and sorted((r.doc_id, str(r.own_id)) for r in got.collect()) == [(1, "{'k': 1}"), (3, "{}")]
    for kind in ("string", "double", "decimal(10,2)"):
        with pytest.raises(TypeError):
            corpus_pipeline.one_of_each(spark, df.withColumn("doc_id", F.col("doc_id").cast(kind)), DIR)


def test_runs_side_by_side_keep_their_tables(spark):
    """What one run deletes is its own."""
    from threading import Thread

    mine = Scratch(spark, "mine").keep(spark.range(3), "rows")
    counts = []

    def other():
        with owned() as made:
            Scratch(spark, "theirs").keep(spark.range(5), "rows")
        counts.append(len(made))
        for own in made:
            own.remove()

    with owned() as made:
        thread = Thread(target=other)
        thread.start()
        thread.join()
    assert counts == [1] and made == [] and mine.count() == 3
