"""Full-text search as plans: match a boolean expression of phrases, score by BM25, rank by popularity.

A document is scanned once; its phrases' frequencies are array expressions inside the scan, so a query shuffles
nothing but one row of sums per task (document frequencies, rows and lengths), and the page it returns. For repeated
queries ``postings`` gives the inverted index, to be written by term; ``from_postings`` answers from it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.stem import analyzed, stems, term
from driftline.functions.text import fold, snippet_of
from driftline.plans.userquery import Expression, Page, Phrase, UserQuery, phrase
from driftline.shared import folder

#: Fixed values of the ranking: BM25's k1 and b, the least idf, weights of popularity and of gemtext.
K1, B, LEAST_IDF, POPULARITY_WEIGHT, GEMTEXT_BOOST = 1.2, 0.75, 1e-6, 0.3, 1.03
GEMTEXT = 1


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Index terms in order: stems without accents, as the tokenizer 'porter unicode61' has them; unstemmed ones are
    words in lower case, for comparison with plain SQL."""
    if stemmed:
        return stems(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def frequency(tokens_: Column, p: Phrase) -> Column:
    """How often the phrase occurs."""
    if len(p.words) == 1:
        return F.size(F.filter(tokens_, lambda t: t == p.words[0]))
    # side by side: the tokens, zipped with themselves moved by one, two, ... places
    moved = [tokens_ if n == 0 else F.slice(tokens_, F.lit(n + 1), F.greatest(F.size(tokens_), F.lit(1))) for n in range(len(p.words))]
    zipped = F.arrays_zip(*[m.alias(f"w{n}") for n, m in enumerate(moved)])

    def hit(z: Column) -> Column:
        found = F.lit(True)
        for n, w in enumerate(p.words):
            found = found & F.coalesce(z[f"w{n}"] == w, F.lit(False))
        return found

    return F.size(F.filter(zipped, hit))


def matches(e: Expression, count: dict[Phrase, Column]) -> Column:
    if isinstance(e, Phrase):
        return count[e] > 0
    left, right = matches(e.left, count), matches(e.right, count)
    return left & right if e.kind == "AND" else left | right if e.kind == "OR" else left & ~right


def idf(rows: float, found: float) -> float:
    return max(math.log((rows - found + 0.5) / (found + 0.5)), LEAST_IDF) if found is not None else LEAST_IDF


def bm25(frequency_: Column, length: Column, mean_length: float, idf_: float) -> Column:
    """FTS scores are negative, the best the lowest."""
    return -(F.lit(idf_) * frequency_ * (K1 + 1) / (frequency_ + K1 * (1 - B + B * length / mean_length)))


def analyzed_phrase(p: Phrase, stemmed: bool) -> Phrase:
    return Phrase(tuple(term(w) for w in p.words)) if stemmed else p


def occurrences(terms: list[str], p: Phrase) -> int:
    if len(p.words) == 1:
        return terms.count(p.words[0])
    words, n = list(p.words), len(p.words)
    return sum(terms[i] == words[0] and terms[i : i + n] == words for i in range(len(terms) - n + 1))


def stemmed_counts(in_body: list[Phrase], in_title: list[Phrase]):
    """(body, title) to the number of terms of both, then how often each phrase occurs. Spark takes it as changing, so
    that a text is split once for all uses of its counts."""
    in_body, in_title = [analyzed_phrase(p, True) for p in in_body], [analyzed_phrase(p, True) for p in in_title]

    def row(body: str | None, title: str | None) -> list[int]:
        b, t = analyzed(body), analyzed(title)
        return [len(b) + len(t), *[occurrences(b, p) for p in in_body], *[occurrences(t, p) for p in in_title]]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counts(body: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([row(b, t) for b, t in zip(body, title, strict=True)], dtype=object)

    return counts.asNondeterministic()


def _counted(docs: DataFrame, q: UserQuery, stemmed: bool) -> tuple[DataFrame, dict, dict, DataFrame]:
    title = phrase(q.title) if q.title else None
    # the words of a title scope belong together, wherever in the title each stands
    in_title = [Phrase((w,)) for w in title.words] if title else []
    phrases = list(dict.fromkeys(q.phrases))
    if stemmed and (phrases or in_title):
        df = docs.withColumn("_counts", stemmed_counts(phrases, in_title)("body", "title"))
        names = ["_length", *[f"_b{n}" for n in range(len(phrases))], *[f"_t{n}" for n in range(len(in_title))]]
        df = df.select("*", *[F.col("_counts")[n].alias(c) for n, c in enumerate(names)])
    else:
        df = docs.withColumn("_body", tokens(F.col("body"), False)).withColumn("_head", tokens(F.col("title"), False)).withColumn("_length", F.size("_body") + F.size("_head"))
        for n, p in enumerate(phrases):
            df = df.withColumn(f"_b{n}", frequency(F.col("_body"), p))
        for n, p in enumerate(in_title):
            df = df.withColumn(f"_t{n}", frequency(F.col("_head"), p))
    return df, {p: F.col(f"_b{n}") for n, p in enumerate(phrases)}, {p: F.col(f"_t{n}") for n, p in enumerate(in_title)}, df


def matched(docs: DataFrame, q: UserQuery, stemmed: bool = False) -> DataFrame:
    """Rows of ``docs`` (url_id, title, body and what scopes need) that match, with rank (null without terms). The
    searches below stem; the plain form is what the tests against unstemmed tokenizers and SQL ask for."""
    df, body, head, counted = _counted(docs, q, stemmed)
    rank = F.lit(None).cast("double")
    keep = F.lit(True)
    if body or head:
        found = counted.agg(
            F.count("*").alias("rows"), F.avg("_length").alias("mean"), *[F.count_if(c > 0).alias(f"b{n}") for n, c in enumerate(body.values())], *[F.count_if(c > 0).alias(f"t{n}") for n, c in enumerate(head.values())]
        ).first()  # one row of as many numbers as the query has phrases
        mean = found["mean"] or 1.0
        rank = F.lit(0.0)
        for n, c in enumerate(body.values()):
            rank = rank + bm25(c, F.col("_length"), mean, idf(found["rows"], found[f"b{n}"]))
        for n, c in enumerate(head.values()):
            rank = rank + bm25(c, F.col("_length"), mean, idf(found["rows"], found[f"t{n}"]))
            keep = keep & (c > 0)
        if q.expression is not None:
            keep = keep & matches(q.expression, body)
    return scoped(df.where(keep), q).withColumn("rank", rank).drop(*[c for c in df.columns if c.startswith("_")])


def scoped(df: DataFrame, q: UserQuery) -> DataFrame:
    if q.site:
        df = df.where(F.col("domain") == q.site)
    if q.filetype:
        df = df.where(F.col("file_extension") == q.filetype)
    if q.url:
        df = df.where(F.lower("path").contains(q.url))
    return df


def total_rank(rank: Column, popularity: Column, content_type: Column | None = None) -> Column:
    """Rank lifted by popularity (none counts as 0), and by gemtext where a content type is given."""
    base = rank + rank * POPULARITY_WEIGHT * F.coalesce(popularity, F.lit(0.0))
    return base if content_type is None else base * F.when(content_type == GEMTEXT, GEMTEXT_BOOST).otherwise(1.0)


def text_search(docs: DataFrame, q: UserQuery, page: Page = Page(1), stemmed: bool = True) -> DataFrame:
    """A page of hits by total rank; without terms by inbound links. Snippets are made for the page's rows alone."""
    hits = matched(docs, q, stemmed).withColumn("total_rank", total_rank(F.col("rank"), F.col("popularity_rank"), F.col("content_type")))
    by_terms = q.expression is not None or q.title
    order = [F.asc("total_rank"), F.asc("url")] if by_terms else [F.desc("external_inbound_links"), F.asc("url")]
    shown = hits.orderBy(*order).offset(page.offset).limit(page.size)
    phrases = [p.words for p in q.phrases]
    return shown.withColumn("snippet", snippet_of(phrases, term=term if stemmed else fold)("body") if phrases else F.substring("body", F.lit(1), F.least(F.lit(100), F.length("body")) - 1)).drop("body")


def image_search(images: DataFrame, q: UserQuery, page: Page = Page(1), stemmed: bool = True) -> DataFrame:
    """As text_search over image terms (in body), without the gemtext boost."""
    hits = matched(images, q, stemmed).withColumn("total_rank", total_rank(F.col("rank"), F.col("popularity_rank")))
    order = [F.asc("total_rank"), F.asc("url")] if q.expression is not None else [F.desc("external_inbound_links"), F.asc("url")]
    return hits.orderBy(*order).offset(page.offset).limit(page.size)


def result_count(docs: DataFrame, q: UserQuery, stemmed: bool = True) -> DataFrame:
    return matched(docs, q, stemmed).agg(F.count("*").alias("n"))


def postings(docs: DataFrame, key: str = "url_id", stemmed: bool = True) -> DataFrame:
    """term, field, key, tf, positions, length: the inverted index; write it partitioned or bucketed by term."""
    split = docs.select(key, tokens(F.col("title"), stemmed).alias("_head"), tokens(F.col("body"), stemmed).alias("_body"))
    both = F.array(F.struct(F.lit("title").alias("field"), F.col("_head").alias("tokens")), F.struct(F.lit("body").alias("field"), F.col("_body").alias("tokens")))
    fields = split.select(key, F.explode(both).alias("f"), (F.size("_head") + F.size("_body")).alias("length"))
    words = fields.select(key, "length", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("position", "term"))
    return words.groupBy("term", "field", key, "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def from_postings(index: DataFrame, terms: list[str], rows: int, mean_length: float, key: str = "url_id", stemmed: bool = True) -> DataFrame:
    """Documents with any of the terms in the body and their BM25 rank, from a written index (stemmed as it is)."""
    terms = list(dict.fromkeys(w for t in terms for w in (analyzed(t) if stemmed else [t])))
    hits = index.where((F.col("field") == "body") & F.col("term").isin(terms))
    found = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.countDistinct(key).alias("n")).collect()}  # a row per term of the query
    weight = F.lit(0.0)
    for word, n in found.items():
        weight = F.when(F.col("term") == word, bm25(F.col("tf"), F.col("length"), mean_length, idf(rows, n))).otherwise(weight)
    return hits.withColumn("w", weight).groupBy(key).agg(F.sum("w").alias("rank"))


def matched_workload(asked: DataFrame, words: DataFrame) -> DataFrame:
    """item_id, doc_id: documents (doc_id, own: distinct words) with all words of a query (item_id, ws). A query looks up
    its rarest word only, and each candidate's words are compared in its own row. The word sets are written once to the shared
    folder, as they are read three times."""
    place = folder(words.sparkSession, "word-sets")
    words.select("doc_id", "own").write.parquet(place)
    words = words.sparkSession.read.schema(words.select("doc_id", "own").schema).parquet(place)
    each = asked.select(F.explode("ws").alias("word")).distinct()
    # how many documents have each asked word: a row per asked word
    known = words.select(F.explode("own").alias("word")).join(each, "word", "left_semi").groupBy("word").count()
    rare = asked.select("item_id", "ws", F.explode("ws").alias("word")).join(known, "word", "left")
    rare = rare.groupBy("item_id", "ws").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)), "word")).alias("word"))
    met = words.select("doc_id", F.explode("own").alias("word")).join(rare, "word").select("item_id", "doc_id", "ws")
    return met.join(words, "doc_id").where(F.size(F.array_except("ws", "own")) == 0).select("item_id", "doc_id")


def file_index_terms(docs: DataFrame, links: DataFrame, words_of_path: Column) -> DataFrame:
    """Terms for files without an indexed body: their inbound links' distinct texts and the words of their path."""
    texts = links.where(F.col("link_text") != "").groupBy("target_url_id").agg(F.array_join(F.array_sort(F.collect_set("link_text")), " ").alias("link_texts"))
    joined = docs.join(texts, F.col("url_id") == F.col("target_url_id"), "left")
    return joined.select("url_id", F.trim(F.concat_ws(" ", "link_texts", F.array_join(words_of_path, " "))).alias("terms"))


def apply_actions(index: DataFrame, actions: DataFrame) -> DataFrame:
    """The index (url_id, title, body) after a batch of (url_id, action, title, body): refresh and add replace, delete
    removes, nothing leaves as is."""
    changed = actions.where(F.col("action").isin("DeletePrevious", "AddCurrent", "RefreshWithCurrent"))
    fresh = actions.where(F.col("action").isin("AddCurrent", "RefreshWithCurrent")).select("url_id", "title", "body")
    return index.join(changed.select("url_id"), "url_id", "left_anti").unionByName(fresh)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("url_id"), "url_id", "left_anti")


