"""The latest-wins document table and what follows from it: index actions, side tables, link differences, dirty work.

Responses may come out of order. A newer response with new content replaces what is known; with the same content it
moves the last visit; an older one can only move first_seen back, and last_time_updated if its content is the current
one; the same time again changes nothing. The rule depends on order, so each URL's responses are folded in ingestion
order (``seq``), in one expression per URL; the streaming form folds the same way, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of work a changed URL asks for.
FILE, IMAGE, POPULARITY = 1, 2, 4
_STATE = "struct<first_seen:timestamp,last_visit:timestamp,last_successful_visit:timestamp,last_time_updated:timestamp,status_code:int,response_hash:string,seq:bigint,action:string>"


def fold(responses: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """url_id and state after all of ``responses`` (url_id, seq, received, status_code, response_hash, is_text), from nothing or
    from what is ``known`` (url_id and state, one row each); ``action`` is that of these responses alone."""
    one = F.struct("seq", "received", "status_code", "response_hash", "is_text")

    def step(s: Column, r: Column) -> Column:
        ok, was_ok = r["status_code"].between(20, 29), s["status_code"].between(20, 29)
        new, same_time, older = s["first_seen"].isNull(), r["received"] == s["last_visit"], r["received"] < s["last_visit"]
        same = r["response_hash"].eqNullSafe(s["response_hash"])
        success = F.when(ok, F.greatest(r["received"], s["last_successful_visit"])).otherwise(s["last_successful_visit"])
        action = F.when(ok & r["is_text"], F.when(new, "AddCurrent").otherwise("RefreshWithCurrent")).when(~ok & was_ok, "DeletePrevious").otherwise("Nothing")

        def state(first, visit, success_, updated, status, digest, seq, action_) -> Column:
            names = ("first_seen", "last_visit", "last_successful_visit", "last_time_updated", "status_code", "response_hash", "seq", "action")
            return F.struct(*[v.alias(n) for n, v in zip(names, (first, visit, success_, updated, status, digest, seq, action_), strict=True)]).cast(_STATE)

        kept = [s[n] for n in ("status_code", "response_hash", "seq", "action")]
        back = state(F.least(s["first_seen"], r["received"]), s["last_visit"], s["last_successful_visit"], F.when(same, r["received"]).otherwise(s["last_time_updated"]), *kept)
        seen = state(s["first_seen"], r["received"], success, s["last_time_updated"], *kept)
        fresh = state(F.coalesce(s["first_seen"], r["received"]), r["received"], success, r["received"], r["status_code"], r["response_hash"], r["seq"], action)
        return F.when(new, fresh).when(same_time, s).when(older, back).when(same, seen).otherwise(fresh)

    ordered = F.array_sort(F.collect_list(one))
    if known is None:
        return responses.groupBy("url_id").agg(F.aggregate(ordered, F.lit(None).cast(_STATE), step).alias("_s")).select("url_id", "_s.*")
    names = [x.split(":")[0] for x in _STATE[7:-1].split(",")]
    state = F.struct(*[(F.lit("Nothing") if n == "action" else F.col(n)).alias(n) for n in names]).cast(_STATE)
    met = responses.groupBy("url_id").agg(ordered.alias("_rows")).join(known.select("url_id", state.alias("_known")), "url_id", "left")
    return met.select("url_id", F.aggregate("_rows", F.col("_known"), step).alias("_s")).select("url_id", "_s.*")


def by_authority(responses: DataFrame, path: str, valid: Column) -> DataFrame:
    """The latest special file of each site, if that one is valid; sites whose latest isn't have none."""
    own = responses.where(F.col("path") == path).groupBy("protocol", "domain", "port").agg(F.max_by(F.struct("content", "source_url_id", "status_code"), "received").alias("_r"))
    return own.select("protocol", "domain", "port", "_r.*").where(F.col("status_code").between(20, 29) & valid).drop("status_code")


def valid_security_contact(content: Column) -> Column:
    return F.lower(content).contains("contact:")


def one_link_per_target(links: DataFrame, order: str) -> DataFrame:
    """Of a source's links to one target the first; of several with one order value the least by the other columns."""
    rest = [c for c in links.columns if c not in ("source_url_id", "target_url_id")]
    first = links.groupBy("source_url_id", "target_url_id").agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return first.select("source_url_id", "target_url_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target) with change: added, removed, updated or unchanged, and the work it asks for."""
    keys = ["source_url_id", "target_url_id"]
    a = old.select(*keys, F.col("is_external").alias("_e0"), F.col("link_text").alias("_t0"), F.lit(1).alias("_in0"))
    b = new.select(*keys, F.col("is_external").alias("_e1"), F.col("link_text").alias("_t1"), F.lit(1).alias("_in1"))
    both = a.join(b, keys, "full_outer")
    text, external = ~F.col("_t0").eqNullSafe(F.col("_t1")), ~F.col("_e0").eqNullSafe(F.col("_e1"))
    change = F.when(F.col("_in0").isNull(), "added").when(F.col("_in1").isNull(), "removed").when(text | external, "updated").otherwise("unchanged")
    work = F.when(text, FILE | IMAGE).otherwise(0).bitwiseOR(F.when(external, POPULARITY).otherwise(0))
    return both.select(*keys, change.alias("change"), F.when(change == "unchanged", 0).otherwise(work).alias("work"))


def dirty(documents: DataFrame) -> DataFrame:
    """Work for new or newly available URLs that aren't special files."""
    work = F.lit(POPULARITY).bitwiseOR(F.when(~F.col("is_body_indexed"), FILE).otherwise(0)).bitwiseOR(F.when(F.col("is_image"), IMAGE).otherwise(0))
    return documents.where("is_new and not is_proactive").select("url_id", work.alias("work_types"))


def merged_work(*queues: DataFrame) -> DataFrame:
    out = queues[0]
    for q in queues[1:]:
        out = out.unionByName(q)
    return out.groupBy("url_id").agg(F.bit_or("work_types").alias("work_types"))


def proactive_links(responses: DataFrame) -> DataFrame:
    """For each site's first available response, the special files to ask for."""
    first = responses.where("is_available").withColumn("_n", F.row_number().over(Window.partitionBy("authority").orderBy("seq"))).where("_n = 1")
    return first.select("authority", F.explode(F.array(F.lit("/favicon.txt"), F.lit("/.well-known/security.txt"))).alias("path"))
