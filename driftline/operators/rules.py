"""URL rules: block lists, robots policies, depth, seen URLs and bodies, and the chain that a frontier applies.

Rules grow with the sites known, so none but regular expressions are collected or compared with a URL one by one: a URL gives
its beginnings of the lengths that the rules of its site have, and a hash join finds those that are rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.robots import robots_rows

#: How deep a crawl goes, and how many URLs a site may add.
MOST_DEPTH, MOST_PER_SITE = 25, 15_000


def parse_block_rules(lines: DataFrame) -> DataFrame:
    """rule_no, definition, kind (prefix, global, nosub, regex), authority (null: everywhere), pattern.

    ``lines`` has line and line_no; blank lines and comments go. ``regex:`` starts a pattern, a ``*`` at the end makes
    a prefix hold everywhere, a ``$`` at the end spares the prefix itself.
    """
    x = F.trim("line")
    kind = F.when(x.startswith("regex:"), "regex").when(x.endswith("*"), "global").when(x.endswith("$"), "nosub").otherwise("prefix")
    pattern = F.when(kind == "regex", F.trim(F.substring(x, 7, 1 << 30))).when(kind == "global", F.regexp_replace(x, r"\*", "")).when(kind == "nosub", F.regexp_replace(x, r"\$$", "")).otherwise(x)
    authority = F.when(kind.isin("prefix", "nosub"), F.regexp_extract(pattern, "^[a-z]+://([^/]+)", 1))
    return lines.where((x != "") & ~x.startswith("#")).select(F.col("line_no").alias("rule_no"), x.alias("definition"), kind.alias("kind"), authority.alias("authority"), pattern.alias("pattern"))


def _keyed(patterns: DataFrame, by: list[str]) -> DataFrame:
    """A row per pattern (``by``, _pattern): the least rule of a text that is the pattern, and of one that goes on after it."""
    return patterns.groupBy(*by, "_pattern").agg(F.min(F.when(F.col("_whole"), F.col("_rule"))).alias("_at_end"), F.min("_rule").alias("_before"))


def _least_rule(tried: DataFrame, keyed: DataFrame, by: list[str]) -> DataFrame:
    """The least rule of each text (``by``, _text) whose first _n characters are a pattern."""
    met = tried.withColumn("_pattern", F.substr("_text", F.lit(1), "_n")).join(keyed, [*by, "_pattern"])
    rule = F.when(F.col("_n") < F.length("_text"), F.col("_before")).otherwise(F.col("_at_end"))
    return met.groupBy(*by, "_text").agg(F.min(rule).alias("_rule")).where("_rule is not null")


def _first_prefix(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``texts`` (_site, _text) that begin with patterns (_site, _pattern, _rule, _whole) of their site, with the least rule; where
    ``_whole`` is false the text has to go on after the pattern. Each text is tried at the lengths that its site's patterns
    have, at most as many as the longest has characters. Only hits are gathered for the minimum; the URLs of a large site
    meet its patterns by the pattern, not in one place."""
    keyed = _keyed(patterns, ["_site"])
    sizes = keyed.groupBy("_site").agg(F.collect_set(F.length("_pattern")).alias("_sizes"))
    tried = texts.join(sizes, "_site").select("_site", "_text", F.explode(F.filter("_sizes", lambda n: n <= F.length("_text"))).alias("_n"))
    return _least_rule(tried, keyed, ["_site"])


def _first_prefix_everywhere(texts: DataFrame, patterns: DataFrame, sizes: list[int]) -> DataFrame:
    """As _first_prefix, for patterns of all sites, which have ``sizes``: _text and _rule."""
    lengths = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")
    tried = texts.select("_text", F.explode(F.filter(lengths, lambda n: n <= F.length("_text"))).alias("_n"))
    return _least_rule(tried, _keyed(patterns, []), [])


def blocked_by(urls: DataFrame, rules: DataFrame, url: str = "url", authority: str = "authority") -> DataFrame:
    """``urls`` with blocked_by: the definition of the first rule that hits, those for all sites before a site's own. Regular
    expressions hold for all sites and are tried one by one; other rules are looked up, however many there are. A null URL
    is not blocked, and one without an authority by the rules for all sites alone."""
    said = F.struct(F.when(F.col("authority").isNull(), 0).otherwise(1).alias("scope"), F.col("rule_no").cast("bigint").alias("rule_no"), "definition")
    patterns = rules.where("kind <> 'regex'").select("authority", F.col("pattern").alias("_pattern"), said.alias("_rule"), (F.col("kind") != "nosub").alias("_whole"))
    everywhere = patterns.where("authority is null").drop("authority")
    # the regular expressions, and numbers up to the longest pattern's length
    own_regex = F.when(F.col("kind") == "regex", F.struct("rule_no", "definition", "pattern"))
    known = rules.agg(F.collect_set(F.when((F.col("kind") != "regex") & F.col("authority").isNull(), F.length("pattern"))).alias("sizes"), F.sort_array(F.collect_list(own_regex)).alias("regex")).first()
    of_all = _first_prefix_everywhere(urls.select(F.col(url).alias("_text")).where("_text is not null"), everywhere, known["sizes"]) if known["sizes"] else None
    own = _first_prefix(urls.select(F.col(authority).alias("_site"), F.col(url).alias("_text")).where("_site is not null and _text is not null"), patterns.where("authority is not null").withColumnRenamed("authority", "_site"))
    first = F.coalesce(*[F.when(F.col(url).rlike(r["pattern"]), F.struct(F.lit(0).alias("scope"), F.lit(r["rule_no"]).cast("bigint").alias("rule_no"), F.lit(r["definition"]).alias("definition"))) for r in known["regex"]], F.lit(None).cast("struct<scope:int,rule_no:bigint,definition:string>"))
    none = F.lit(None).cast("struct<scope:int,rule_no:bigint,definition:string>")
    joined = urls.withColumn("_of_all", none) if of_all is None else urls.join(of_all.withColumnRenamed("_rule", "_of_all"), F.col(url) == F.col("_text"), "left").drop("_text")
    joined = joined.join(own.withColumnRenamed("_rule", "_own"), (F.col(url) == F.col("_text")) & (F.col(authority) == F.col("_site")), "left")
    # null rules are left out of the least
    return joined.withColumn("blocked_by", F.least(first, F.col("_of_all"), F.col("_own"))["definition"]).drop("_of_all", "_own", "_site", "_text")


def parse_robots(files: DataFrame) -> DataFrame:
    """authority, user_agent, path, line, line_number of each deny rule of ``files`` (authority, content); see
    ``functions.robots``. A rule with an empty path, which denies nothing, is one too."""
    return robots_rows(files).where("what = 'rule'").select("authority", "user_agent", "path", "line", "line_number")


def robots_valid(files: DataFrame) -> DataFrame:
    """``files`` (authority, content) with valid: it gives at least one rule."""
    found = parse_robots(files).select("authority").distinct().withColumn("_valid", F.lit(True))
    return files.join(found, "authority", "left").withColumn("valid", F.coalesce("_valid", F.lit(False))).drop("_valid")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` (authority, path) with allowed: no denied path of the site begins the URL's. Rules for all agents hold even for one
    with rules of its own. Denied paths are looked up, however many a site has."""
    denied = rules.where(F.col("user_agent").isin("*", agent.lower()) & (F.col("path") != ""))
    denied = denied.select(F.col("authority").alias("_site"), F.col("path").alias("_pattern"), F.lit(1).alias("_rule"), F.lit(True).alias("_whole"))
    hits = _first_prefix(urls.select(F.col("authority").alias("_site"), F.col("path").alias("_text")).where("_site is not null and _text is not null"), denied)
    joined = urls.join(hits, (F.col("authority") == F.col("_site")) & (F.col("path") == F.col("_text")), "left")
    return joined.withColumn("allowed", F.col("_rule").isNull()).drop("_site", "_text", "_rule")


def within_depth(entries: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    return entries.where(F.col("is_proactive") | (F.col("depth") < most))


def within_site_limit(entries: DataFrame, most: int = MOST_PER_SITE) -> DataFrame:
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy("authority").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")


def first_seen(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; no window, as the least order value and a join-free aggregate do."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def content_seen(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """``rows`` with seen: an earlier row has the same digest; null digests are never seen. Digests are summed up before they are
    shuffled, and a digest of many rows is met by each of them, not gathered."""
    first = rows.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("_digest")).agg(F.min(order).alias("_first"))
    return rows.join(first, F.col(digest) == F.col("_digest"), "left").withColumn("seen", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_digest", "_first")


def frontier_chain(entries: DataFrame, seen: DataFrame, seeds: DataFrame | None, rules: DataFrame) -> DataFrame:
    """``entries`` (url, authority, depth, is_proactive, seq) with rejection: seen, scope, depth, block or null."""
    df = entries.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left")
    first = F.row_number().over(Window.partitionBy("url").orderBy("seq")) == 1
    scope = F.lit(True)
    if seeds is not None:
        df = df.join(seeds.select("authority").distinct().withColumn("_seed", F.lit(True)), "authority", "left")
        scope = F.coalesce("_seed", F.lit(False))
    df = blocked_by(df, rules)
    reason = F.when(F.coalesce("_seen", F.lit(False)) | ~first, "seen").when(~scope, "scope").when(~F.col("is_proactive") & (F.col("depth") >= MOST_DEPTH), "depth").when(F.col("blocked_by").isNotNull(), "block")
    return df.withColumn("rejection", reason).drop("_seen", "_seed")


def frontier_priority(entries: DataFrame) -> DataFrame:
    """Priority of each entry: how many its site added before; 5000 more for files that aren't pages; 100 for special
    files, which still count."""
    n = F.row_number().over(Window.partitionBy("authority").orderBy("seq"))
    page = (F.col("filename") == "") | F.col("file_extension").isin("gmi", "txt")
    return entries.withColumn("priority", F.when(F.col("is_proactive"), 100).otherwise(n + F.when(page, 0).otherwise(5000)))


def bfs_depth(edges: DataFrame, seeds: DataFrame, most: int = MOST_DEPTH, scratch_dir: str | None = None) -> DataFrame:
    """node, depth over ``edges`` (source, target) from ``seeds`` (node). Each level is checkpointed where a
    checkpoint folder is set, so that plans and lost executors don't pile up."""
    spark: SparkSession = edges.sparkSession
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    level = reached
    for depth in range(1, most):
        found = level.join(edges, level["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        level = found.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth))
        if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
            level = level.checkpoint()
        if not level.limit(1).count():
            break
        reached = reached.unionByName(level)
    return reached
