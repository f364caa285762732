"""A written full-text index that takes updates, and searches that answer from it.

An index is a row of generations, oldest first. A generation is written once and never changed: ``postings`` has a row per
field, term and document, with the term's positions; ``pages`` has what searches show and scope by, without the texts;
``hidden`` has the ids that it replaces or removes, which hides their rows in all older generations. ``build`` writes the
first generation, ``update`` adds one from a batch of index actions, ``merge`` makes one of several (from their postings, no
text is read), ``vacuum`` deletes what no longer belongs to the index.

What an index consists of is one row in ``manifest``: its generations, and how many documents and terms are alive in all of them.
So a search knows the mean length without reading a row per document, and what a stopped update or merge left behind is
never seen. A row is written at the end of each step under the next version's name, so of two writers at once the later one
fails. An ``Index`` is one version: it stays as it is while others write.

Texts are dealt to tasks by block; a document's rows are made there and written without a shuffle, a file per task and bucket of
terms, so that a frequent term is spread over files. Within a file rows stand by term. A search reads the row groups of
its own terms: no text is read but those of the hits on the page that it shows.

The documents of a generation are dealt into blocks. ``bounds`` has, for a term of bodies and a block, how many of its documents have
the term and the most that it can add to a document's total rank. A search for a page of single words reads the blocks that may
rank highest first, and ends when what is left can't reach the page (``best_blocks``): top documents of a word stand in as many
blocks as the page has rows at most.

Terms are those of FTS5's tokenizer 'porter unicode61'; see ``functions.stem``. A null text has no terms. Rows with a null id
are not in an index. A build's ids are those of a document table, each once; of a batch's rows with the same id that with the
greatest ``seq`` counts (any of them where there is no such column).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import formats
from driftline.functions.stem import analyzed, plain, plain_words, term
from driftline.functions.text import snippet_of
from driftline.operators import fts
from driftline.plans.userquery import Expression, Page, Phrase, UserQuery, phrase
from driftline.shared import released

#: Fields of a posting; each document has a row of ALL with the empty term, for its length.
ALL, TITLE, BODY = 0, 1, 2
BUCKETS = 32
#: A merge takes a generation in when it has at most so many times the rows of all later ones.
FAN = 2
#: How the files of an index are compressed.
CODEC = "zstd"
#: Documents of a block, and blocks of a generation at most.
PER_BLOCK, BLOCKS = 64, 4096
#: Documents of a task that splits texts, at about.
PER_TASK = 4096
#: The index's own columns, beside those of the pages: which generation a row is of, and the block of its document.
ORDER, BLOCK = "order_of_generation", "block_of_index"
_SCHEMA = "field tinyint, term string, url_id bigint, length int, boost double, positions array<int>"


@dataclass(frozen=True)
class Generation:
    """``part`` names its folders. ``order`` says what it hides: rows of generations of lower order. ``hidden`` counts the ids
    that it hides; ``rows`` its documents, hidden ones included. ``mean`` is the length for which its bounds were made."""

    part: str
    order: int
    rows: int
    hidden: int
    blocks: int = 1
    mean: float = 1.0


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    version: int
    generations: tuple[Generation, ...]
    #: Documents that are alive, and their terms.
    rows: int
    terms: int
    page_columns: T.StructType
    #: The last batch taken from each source.
    taken: dict[str, int] = field(default_factory=dict)
    #: None: terms are porter stems. Else they are words in lower case, and the forms listed here as the word that they are given.
    forms: dict[str, str] | None = None
    #: Documents that are alive and have no length: in an index of words those without a body, as SQL has it.
    bodiless: int = 0

    def term(self, word: str) -> str:
        return _term_of(self.forms)(word)

    def analyzed(self, p: Phrase) -> Phrase:
        return Phrase(tuple(self.term(w) for w in p.words))

    @property
    def mean_length(self) -> float:
        known = self.rows - self.bodiless
        return self.terms / known if known else 0.0

    def _read(self, what: str, schema: T.StructType, generations: tuple[Generation, ...] | None = None) -> DataFrame:
        """Rows of the generations, with ORDER."""
        generations = self.generations if generations is None else generations
        schema = T.StructType([*schema.fields, T.StructField("part", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/part={g.part}" for g in generations])
        orders = F.create_map(*[F.lit(x) for g in generations for x in (g.part, g.order)])
        return rows.withColumn(ORDER, F.element_at(orders, F.col("part"))).drop("part")

    def _hidden(self, generations: tuple[Generation, ...] | None = None) -> DataFrame | None:
        """The ids that generations hide, and up to which order; None if there is none."""
        own = tuple(g for g in (self.generations if generations is None else generations) if g.hidden)
        if not own:
            return None
        return self._read("hidden", _HIDDEN, own).groupBy("url_id").agg(F.max(ORDER).alias("below"))

    def alive(self, rows: DataFrame, generations: tuple[Generation, ...] | None = None) -> DataFrame:
        """Of rows with url_id and ORDER those that no later generation hides."""
        hidden = self._hidden(generations)
        if hidden is None:
            return rows
        return rows.join(hidden, "url_id", "left").where(F.col("below").isNull() | (F.col(ORDER) >= F.col("below"))).drop("below")

    @property
    def postings(self) -> DataFrame:
        """All rows of all generations, hidden ones too; see ``alive``."""
        return self._read("postings", _POSTINGS)

    def _pages_by_block(self) -> DataFrame:
        return self._read("pages", T.StructType([*self.page_columns.fields, T.StructField(BLOCK, T.IntegerType())]))

    @property
    def pages(self) -> DataFrame:
        """The pages that are alive."""
        return self.alive(self._read("pages", self.page_columns)).drop(ORDER)

    def of(self, terms: list[tuple[int, str]]) -> DataFrame:
        """The postings of (field, term)s: folders by bucket and row groups by term are pruned."""
        words = sorted({w for _, w in terms})
        buckets = [_bucket(F.lit(w)) for w in words]
        wanted = F.lit(False)
        for number, word in terms:
            wanted = wanted | ((F.col("term") == word) & (F.col("field") == number))
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(words) & wanted)

    def bounds(self, words: list[str]) -> list[tuple[int, str, int, float, int]]:
        """(order, word, block, most, documents) of the words: at most as many rows as words times blocks."""
        rows = self._read("bounds", _BOUNDS).where(F.col("bucket").isin([_bucket(F.lit(w)) for w in words]) & F.col("term").isin(words))
        return [tuple(r) for r in rows.select(ORDER, "term", BLOCK, "most", "n").collect()]


_POSTINGS = (
    T.StructType().add("field", T.ByteType()).add("term", T.StringType()).add("url_id", T.LongType()).add("length", T.IntegerType()).add("boost", T.DoubleType())
    .add("positions", T.ArrayType(T.IntegerType())).add(BLOCK, T.IntegerType()).add("bucket", T.IntegerType())
)
_BOUNDS = T.StructType().add("term", T.StringType()).add(BLOCK, T.IntegerType()).add("most", T.DoubleType()).add("n", T.LongType()).add("bucket", T.IntegerType())
_HIDDEN = T.StructType([T.StructField("url_id", T.LongType())])


def _sums() -> list[Column]:
    """Of a row per document: their number, their terms, and how many have no length."""
    return [F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms"), F.count_if(F.col("length").isNull()).alias("bodiless")]


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _term_of(forms: dict[str, str] | None):
    """The term of a word, as an index with these forms has it."""
    return term if forms is None else lambda word: plain(word, forms)


def _postings(batches: Iterator[pa.RecordBatch], forms: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
    split = analyzed if forms is None else lambda text: plain_words(text, forms)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            fields, terms, ids, lengths, boosts, sizes, places = [], [], [], [], [], [], []
            for key, title, body, boost in zip(*(part.column(n).to_pylist() for n in ("url_id", "title", "body", "boost")), strict=True):
                head, rest = split(title), split(body)
                first = len(terms)
                fields.append(ALL)
                terms.append("")
                sizes.append(0)
                for number, words in ((TITLE, head), (BODY, rest)):
                    found: dict[str, list[int]] = {}
                    for n, w in enumerate(words):
                        if w in found:
                            found[w].append(n)
                        else:
                            found[w] = [n]
                    fields += [number] * len(found)
                    terms += found
                    for own in found.values():
                        sizes.append(len(own))
                        places += own
                ids += [key] * (len(terms) - first)
                lengths += [None if forms is not None and body is None else len(head) + len(rest)] * (len(terms) - first)
                boosts += [boost] * (len(terms) - first)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields, pa.int8()), pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(boosts, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32()))],
                ["field", "term", "url_id", "length", "boost", "positions"],
            )


def _with_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("url_id").isNotNull()).withColumn("url_id", F.col("url_id").cast("bigint"))


def _one_each(rows: DataFrame) -> DataFrame:
    """A row per id: that with the greatest seq, if there is one."""
    rows = _with_ids(rows)
    if "seq" not in rows.columns:
        return rows.dropDuplicates(["url_id"])
    rest = [c for c in rows.columns if c not in ("url_id", "seq")]
    last = rows.groupBy("url_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("seq").isNotNull(), "seq")).alias("last"))
    return last.select("url_id", "last.*")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("url_id"), F.lit(blocks)).cast("int")


def _write_postings(rows: DataFrame, where: str, blocks: int) -> None:
    """A task writes a file per bucket, with its rows by term; they aren't shuffled."""
    rows = rows.withColumn(BLOCK, _block(blocks)).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "field", BLOCK)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(where, compression=CODEC)


def _write_bounds(spark: SparkSession, path: str, part: str, mean: float) -> None:
    """Of each term and block the most that it adds to a total rank, but for its idf. A term's rows of a block stand in one file (of
    a merge: in few), so about a row for each is what is shuffled."""
    rows = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/part={part}").where(F.col("field") == BODY)
    most = F.max(-fts.bm25(F.size("positions"), F.col("length"), mean or 1.0, 1.0) * F.col("boost"))
    found = rows.groupBy("bucket", "term", BLOCK).agg(most.alias("most"), F.count("*").alias("n"))
    found.sortWithinPartitions("bucket", "term", BLOCK).write.mode("overwrite").parquet(f"{path}/bounds/part={part}", compression=CODEC)


def _boost(columns: list[str]) -> Column:
    """What popularity and type make of a rank, at most."""
    popularity = F.greatest(F.coalesce("popularity_rank", F.lit(0.0)), F.lit(0.0)) if "popularity_rank" in columns else F.lit(0.0)
    return (1 + fts.POPULARITY_WEIGHT * popularity) * (F.when(F.col("content_type") == fts.GEMTEXT, fts.GEMTEXT_BOOST).otherwise(1.0) if "content_type" in columns else F.lit(1.0))


def _write(docs: DataFrame, path: str, part: str, order: int, hidden: int = 0, page_columns: list[str] | None = None, forms: dict[str, str] | None = None) -> tuple[Generation, int, int, T.StructType]:
    """``docs`` as a generation; gives it with the number of its terms, of its documents without a length, and the pages' columns."""
    spark, rows = docs.sparkSession, docs.select("url_id").count()
    blocks = _blocks_of(rows)
    texts = docs.select("url_id", "title", "body", _boost(docs.columns).alias("boost"))
    # texts are dealt by block, not their postings; a block's postings are then in one file of each bucket
    dealt = texts.repartition(max(rows // PER_TASK, spark.sparkContext.defaultParallelism), _block(blocks))
    _write_postings(dealt.mapInArrow(lambda batches: _postings(batches, forms), _SCHEMA), f"{path}/postings/part={part}", blocks)
    released(spark)
    pages = docs.withColumn("lead", formats.lead(F.col("body"))).drop("body")
    pages = pages.select(*[f"`{c}`" for c in page_columns]) if page_columns else pages
    _write_pages(pages, f"{path}/pages/part={part}", blocks)
    return *_finish(spark, path, part, order, hidden, blocks), pages.schema


def _write_pages(pages: DataFrame, where: str, blocks: int) -> None:
    """A block is in one file, by id."""
    pages.withColumn(BLOCK, _block(blocks)).repartition(BLOCK).sortWithinPartitions(BLOCK, "url_id").write.mode("overwrite").parquet(where, compression=CODEC)


def _finish(spark: SparkSession, path: str, part: str, order: int, hidden: int, blocks: int) -> tuple[Generation, int, int]:
    """Bounds of a generation whose postings are written; gives it with the number of its terms, and of its documents without a length."""
    rows = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/part={part}").where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == ""))
    found = rows.agg(*_sums()).first()
    known = found["n"] - found["bodiless"]
    mean = found["terms"] / known if known else 1.0
    _write_bounds(spark, path, part, mean)
    return Generation(part, order, found["n"], hidden, blocks, mean), found["terms"], found["bodiless"]


def _blocks_of(rows: int) -> int:
    return max(1, min(BLOCKS, rows // PER_BLOCK))


def _commit(index: Index) -> Index:
    """Writes the version's row; an error if there is one already."""
    row = {
        "version": index.version, "rows": index.rows, "terms": index.terms, "pages": index.page_columns.json(), "taken": json.dumps(index.taken), "forms": None if index.forms is None else json.dumps(index.forms),
        "bodiless": index.bodiless, "generations": json.dumps([[g.part, g.order, g.rows, g.hidden, g.blocks, g.mean] for g in index.generations]),
    }
    released(index.spark)
    index.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").json(f"{index.path}/manifest/{index.version:012d}")
    return index


_MANIFEST = "version bigint, rows bigint, terms bigint, pages string, taken string, generations string, forms string, bodiless bigint"


def opened(spark: SparkSession, path: str) -> Index:
    """The latest version of the index under ``path``."""
    row = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest").orderBy(F.desc("version")).first()
    generations = tuple(Generation(*g) for g in json.loads(row["generations"]))
    return Index(spark, path, row["version"], generations, row["rows"], row["terms"], T.StructType.fromJson(json.loads(row["pages"])), json.loads(row["taken"]), row["forms"] and json.loads(row["forms"]), row["bodiless"] or 0)


def build(docs: DataFrame, path: str, forms: dict[str, str] | None = None) -> Index:
    """Writes the index of ``docs`` (url_id, title, body and what pages show) under ``path``, where none is: of stems, or with
    ``forms`` of words as they are."""
    generation, terms, bodiless, columns = _write(_with_ids(docs), path, uuid.uuid4().hex, 0, forms=forms)
    return _commit(Index(docs.sparkSession, path, 0, (generation,), generation.rows, terms, columns, forms=forms, bodiless=bodiless))


def update(index: Index, actions: DataFrame, source: str = "", batch: int | None = None) -> Index:
    """The index after a batch of (url_id, action, title, body and what its pages show): AddCurrent and RefreshWithCurrent put
    a document in place of what is there under its id, DeletePrevious removes it, all others leave it. A numbered batch
    that was taken from the source before is left out, so a stream may repeat it. Reads lengths of the ids that the
    batch changes, and rewrites nothing."""
    if batch is not None and index.taken.get(source, -1) >= batch:
        return index
    spark, path, part = index.spark, index.path, uuid.uuid4().hex
    changes = _one_each(actions).where(F.col("action").isin("DeletePrevious", "AddCurrent", "RefreshWithCurrent"))
    hides = f"{path}/hidden/part={part}"
    # what is alive under these ids; others have nothing to hide
    old = index.alive(index.of([(ALL, "")]).select("url_id", ORDER, "length"))
    old.join(changes.select("url_id"), "url_id", "left_semi").select("url_id", "length").write.mode("overwrite").parquet(hides)
    lost = spark.read.schema("url_id bigint, length int").parquet(hides).agg(*_sums()).first()
    order = max((g.order for g in index.generations), default=-1) + 1
    made, terms, bodiless, _ = _write(changes.where("action <> 'DeletePrevious'").drop("action"), path, part, order, lost["n"], index.page_columns.names, index.forms)
    taken = index.taken if batch is None else {**index.taken, source: batch}
    return _commit(Index(spark, path, index.version + 1, (*index.generations, made), index.rows - lost["n"] + made.rows, index.terms - lost["terms"] + terms, index.page_columns, taken, index.forms, index.bodiless - lost["bodiless"] + bodiless))


def remove(index: Index, ids: DataFrame, source: str = "", batch: int | None = None) -> Index:
    """The index without the documents of ``ids`` (url_id)."""
    shown = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.page_columns.fields if f.name not in ("url_id", "lead", "title", "body")]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("title", "body")]
    return update(index, ids.select("url_id", F.lit("DeletePrevious").alias("action"), *shown, *nothing), source, batch)


def due(index: Index, fan: int = FAN) -> int:
    """The first of the generations that a merge should make one: it has at most ``fan`` times the rows of all later ones,
    so that each row is rewritten a logarithmic number of times. Their number if none is due."""
    later = 0
    first = len(index.generations)
    for n in range(len(index.generations) - 1, -1, -1):
        own = index.generations[n]
        if n < len(index.generations) - 1 and own.rows + own.hidden <= fan * later:
            first = n
        later += own.rows + own.hidden
    return first


def merge(index: Index, first: int = 0) -> Index:
    """The generations from the ``first`` on as one, without the rows that are hidden among them. From 0 on nothing is left
    to hide. Their files stay for who reads an older version, until ``vacuum``."""
    own = index.generations[first:]
    if len(own) < 2:
        return index
    part, order, blocks = uuid.uuid4().hex, own[-1].order, _blocks_of(sum(g.rows for g in own))
    read = index._read("postings", _POSTINGS, own)
    _write_postings(index.alive(read, own).drop(ORDER, "bucket", BLOCK), f"{index.path}/postings/part={part}", blocks)
    pages = index.alive(index._read("pages", index.page_columns, own), own).select(*[f"`{c}`" for c in index.page_columns.names])
    _write_pages(pages, f"{index.path}/pages/part={part}", blocks)
    hidden, count = index._hidden(own) if first else None, 0
    if hidden is not None:
        hidden.select("url_id").write.mode("overwrite").parquet(f"{index.path}/hidden/part={part}")
        count = index.spark.read.schema(_HIDDEN).parquet(f"{index.path}/hidden/part={part}").count()
    made, *_ = _finish(index.spark, index.path, part, order, count, blocks)
    return _commit(Index(index.spark, index.path, index.version + 1, (*index.generations[:first], made), index.rows, index.terms, index.page_columns, index.taken, index.forms, index.bodiless))


def vacuum(index: Index) -> int:
    """Deletes the folders that this version doesn't name: merged generations, and what stopped steps left. Gives their
    number. No one may be writing, or reading an older version."""
    jvm = index.spark._jvm
    conf = jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()
    named, gone = {f"part={g.part}" for g in index.generations}, 0
    for what in ("postings", "bounds", "pages", "hidden"):
        root = jvm.org.apache.hadoop.fs.Path(f"{index.path}/{what}")
        files = root.getFileSystem(conf)
        for found in files.listStatus(root) if files.exists(root) else ():
            if found.getPath().getName() not in named:
                files.delete(found.getPath(), True)
                gone += 1
    return gone


def taking(path: str, source: str, merging: bool = True, alone: bool = False):
    """For foreachBatch: takes each batch of index actions into the index under ``path``, once, and merges small
    generations. With ``alone`` no one else reads or writes meanwhile, and what was merged is deleted."""

    def take(batch: DataFrame, number: int) -> None:
        index = update(opened(batch.sparkSession, path), batch, source, number)
        if merging:
            merged = merge(index, due(index))
            if alone and merged is not index:
                vacuum(merged)

    return take


def _frequency(p: Phrase, field: int, place: dict[tuple[int, str], Column]) -> Column:
    """How often the phrase stands in the field: starts that each next word follows."""
    first = place[field, p.words[0]]
    if len(p.words) == 1:
        return first

    def follows(x: Column) -> Column:
        hit = F.lit(True)
        for n, w in enumerate(p.words[1:], 1):
            hit = hit & F.coalesce(F.array_contains(place[field, w], x + n), F.lit(False))
        return hit

    return F.coalesce(F.size(F.filter(first, follows)), F.lit(0))


def hits(index: Index, q: UserQuery, among: Column | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """url_id, ORDER and rank of the documents that match the terms of ``q``. With ``among`` only those whose postings it selects;
    then ``counts`` has to say how many documents have each word."""
    body = list(dict.fromkeys(index.analyzed(p) for p in q.phrases))
    head = [Phrase((index.term(w),)) for w in (phrase(q.title).words if q.title else ())]
    asked = [(BODY, p) for p in body] + [(TITLE, p) for p in head]
    # a single word needs its count, words of a phrase their places
    counted = {(f, p.words[0]) for f, p in asked if len(p.words) == 1}
    placed = {(f, w) for f, p in asked if len(p.words) > 1 for w in p.words}
    aggs, single, many = [F.max("length").alias("length")], {}, {}
    for n, (f, w) in enumerate(sorted(counted | placed)):
        mine = (F.col("term") == w) & (F.col("field") == f)
        if (f, w) in counted:
            aggs.append(F.coalesce(F.max(F.when(mine, F.size("positions"))), F.lit(0)).alias(f"n{n}"))
            single[f, w] = F.col(f"n{n}")
        if (f, w) in placed:
            aggs.append(F.max(F.when(mine, F.col("positions"))).alias(f"p{n}"))
            many[f, w] = F.col(f"p{n}")
    rows = index.of(sorted(counted | placed))
    docs = index.alive((rows if among is None else rows.where(among)).groupBy("url_id", ORDER).agg(*aggs))
    names = [f"f{n}" for n in range(len(asked))]
    docs = docs.select("url_id", ORDER, "length", *[_frequency(p, f, single if len(p.words) == 1 else many).alias(c) for (f, p), c in zip(asked, names, strict=True)])
    if counts is None:
        found = docs.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in names]).first().asDict()  # a number per phrase
    else:
        found = {c: counts.get(p.words[0], 0) for (_, p), c in zip(asked, names, strict=True)}
    rank = F.lit(0.0)
    for c in names:
        rank = rank + fts.bm25(F.col(c), F.col("length"), index.mean_length or 1.0, fts.idf(index.rows, found[c]))
    keep = F.lit(True)
    for c in names[len(body) :]:
        keep = keep & (F.col(c) > 0)
    if q.expression is not None:
        count = {p: F.col(names[body.index(index.analyzed(p))]) for p in q.phrases}
        keep = keep & fts.matches(q.expression, count)
    return docs.where(keep).select("url_id", ORDER, rank.alias("rank"))


def matched(index: Index, q: UserQuery, among: Column | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """The pages that match, with rank (null without terms)."""
    if q.expression is None and not q.title:
        return fts.scoped(index.pages, q).withColumn("rank", F.lit(None).cast("double"))
    # a hit is alive, and so is the page of its generation
    pages = index._pages_by_block()
    pages = (pages if among is None else pages.where(among)).drop(BLOCK)
    return fts.scoped(pages.join(hits(index, q, among, counts), ["url_id", ORDER]).drop(ORDER), q)


def _may_match(index: Index, e: Expression, there: set[str]) -> bool:
    """Whether a document of a block that has these words may match."""
    if isinstance(e, Phrase):
        return index.term(e.words[0]) in there
    left = _may_match(index, e.left, there)
    return left or _may_match(index, e.right, there) if e.kind == "OR" else left and (e.kind == "NOT" or _may_match(index, e.right, there))


def word_counts(index: Index, words: list[str], bounds: list[tuple]) -> dict[str, int]:
    """How many documents have each word: by the bounds, or counted where some are hidden."""
    if any(g.hidden for g in index.generations):
        rows = index.alive(index.of([(BODY, w) for w in words]).select("term", "url_id", ORDER)).groupBy("term").count()
        return {r["term"]: r["count"] for r in rows.collect()}  # a row per word
    found: dict[str, int] = {}
    for _, word, _, _, n in bounds:
        found[word] = found.get(word, 0) + n
    return found


def best_blocks(index: Index, q: UserQuery, bounds: list[tuple], counts: dict[str, int]) -> list[tuple[float, int, int]]:
    """(the most that a total rank can be, order, block) of the blocks that may hold matches, the highest first."""
    weight = {w: fts.idf(index.rows, n) for w, n in counts.items()}
    # bounds were made for the mean length of their generation; a greater one adds at most in proportion
    scale = {g.order: max(1.0, index.mean_length / (g.mean or 1.0)) for g in index.generations}
    most: dict[tuple[int, int], float] = {}
    there: dict[tuple[int, int], set[str]] = {}
    for order, word, block, value, _ in bounds:
        most[order, block] = most.get((order, block), 0.0) + weight.get(word, fts.LEAST_IDF) * value * scale[order]
        there.setdefault((order, block), set()).add(word)
    return sorted(((m, *key) for key, m in most.items() if _may_match(index, q.expression, there[key])), reverse=True)


def _within(blocks: list[tuple[float, int, int]]) -> Column:
    """Rows of the blocks."""
    among = F.lit(False)
    for order in sorted({o for _, o, _ in blocks}):
        among = among | ((F.col(ORDER) == order) & F.col(BLOCK).isin([b for _, o, b in blocks if o == order]))
    return among


def _bounded(q: UserQuery) -> bool:
    return q.expression is not None and not q.title and all(len(p.words) == 1 for p in q.phrases)


def _best(index: Index, q: UserQuery, page: Page, total: Column, read: list | None = None) -> DataFrame:
    """The rows of a page, from the blocks that can reach it. Blocks are read in rounds, each of four times as many; ``read`` takes
    (blocks read, blocks in all)."""
    words = sorted({index.term(p.words[0]) for p in q.phrases})
    bounds = index.bounds(words)
    counts = word_counts(index, words, bounds)
    left = every = best_blocks(index, q, bounds, counts)
    wanted, take, best = page.offset + page.size, max(2 * page.size, len(every) // 4), []
    shape = matched(index, q, F.lit(False), counts).withColumn("total_rank", total).schema
    while left and (len(best) < wanted or left[0][0] * (1 + 1e-9) >= -best[-1]["total_rank"]):
        now, left, take = left[:take], left[take:], 4 * take
        found = matched(index, q, _within(now), counts).withColumn("total_rank", total).orderBy("total_rank", "url").limit(wanted)
        best = sorted([*best, *found.collect()], key=lambda r: (r["total_rank"], r["url"] is not None, r["url"]))[:wanted]  # the rows up to the page's end
    if read is not None:
        read.append((len(every) - len(left), len(every)))
    return index.spark.createDataFrame(best[page.offset :], shape)


def _page(index: Index, q: UserQuery, page: Page, total: Column, read: list | None = None) -> DataFrame:
    if _bounded(q):
        return _best(index, q, page, total, read)
    order = [F.asc("total_rank"), F.asc("url")] if q.expression is not None or q.title else [F.desc("external_inbound_links"), F.asc("url")]
    return matched(index, q).withColumn("total_rank", total).orderBy(*order).offset(page.offset).limit(page.size)


def text_search(index: Index, q: UserQuery, page: Page = Page(1), texts: DataFrame | None = None, read: list | None = None) -> DataFrame:
    """A page of hits by total rank; without terms by inbound links. With ``texts`` (url_id, body) hits have a snippet,
    for which the texts of the page's rows alone are read; without terms it's the page's first characters."""
    shown = _page(index, q, page, fts.total_rank(F.col("rank"), F.col("popularity_rank"), F.col("content_type")), read)
    phrases = [p.words for p in q.phrases]
    if texts is None or not phrases:
        return shown.withColumnRenamed("lead", "snippet")
    ids = [r["url_id"] for r in shown.select("url_id").collect()]  # a page of ids
    own = texts.where(F.col("url_id").isin(ids)).select("url_id", snippet_of(phrases, term=_term_of(index.forms))("body").alias("snippet"))
    return shown.drop("lead").join(own, "url_id", "left")


def image_search(index: Index, q: UserQuery, page: Page = Page(1)) -> DataFrame:
    """As text_search over image terms, without the gemtext boost."""
    return _page(index, q, page, fts.total_rank(F.col("rank"), F.col("popularity_rank")))


def result_count(index: Index, q: UserQuery) -> DataFrame:
    """How many pages match: of the postings alone, unless a scope asks for what pages have."""
    found = hits(index, q) if (q.expression is not None or q.title) and not any((q.site, q.filetype, q.url)) else matched(index, q)
    return found.agg(F.count("*").alias("n"))


def stored(index: Index, ids: list[int], column: str) -> DataFrame:
    """What the pages of a few ids have in a column, as it was written: for an image the text that it is found by. Files and row
    groups of other blocks are left out."""
    among = F.lit(False)
    for g in index.generations:
        blocks = [F.pmod(F.xxhash64(F.lit(i).cast("bigint")), F.lit(g.blocks)).cast("int") for i in ids]
        among = among | ((F.col(ORDER) == g.order) & F.col(BLOCK).isin(blocks))
    found = index._pages_by_block().where(among & F.col("url_id").isin(ids)).select("url_id", ORDER, column)
    return index.alive(found).drop(ORDER)


def with_favicons(pages: DataFrame, favicons: DataFrame) -> DataFrame:
    """Pages with the favicon of their site, if there is one."""
    return pages.join(_emoji(favicons), ["protocol", "domain", "port"], "left")


def _emoji(favicons: DataFrame) -> DataFrame:
    return favicons.select("protocol", "domain", "port", F.col("emoji").alias("favicon"))


def image_pages(images: DataFrame, documents: DataFrame, favicons: DataFrame) -> DataFrame:
    """What an image search shows and searches: images (url_id, width, height, image_type, terms) with their documents'
    columns and the favicon of their site, if there is one."""
    rows = with_favicons(images.join(documents, "url_id"), favicons)
    return rows.withColumn("title", F.lit(None).cast("string")).withColumn("body", F.col("terms"))


__all__ = ["Generation", "Index", "best_blocks", "build", "due", "hits", "image_pages", "image_search", "matched", "merge", "opened", "remove", "result_count", "stored", "taking", "text_search", "update", "vacuum", "with_favicons"]
