"""The operators as queries over whole tables, with their production parameters, and their SQL where it can say it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, fingerprint, ledger, neardup, packing, periodic, quality, secrets, sentencepieces, shard, tokcount, topk
from .common import Scratch, table
from .encode import public

COUNTED = "byte_bpe_50k.json"
PACKED = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), public(PIECES))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.count_tokens(table(spark, sf_dir, "documents"), public(COUNTED))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"), -1, PROBE)))


def op5_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = shard.shard(rows, "doc_id", 16, order=("size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"), "embedding")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"), parts)


def op10_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return packing.pack(scratch.keep(packing.pieces(table(spark, sf_dir, "documents"), public(PACKED)), "pieces"), scratch)


def op11_filtering_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()
    rows = codes.with_group_error(Scratch(spark, "coded").keep(coded, "rows"), "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def made_periodic(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth document, by a hash of its id, repeats with a period from some word on. A null id is never among them."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic(docs, rewrite=made_periodic, given=("doc_id",))
    # the longest run; ties: the smallest start, then period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("longest"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("longest.length"), -F.col("longest.period")
    return rows.select("doc_id", "n_runs", (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [m for m in ledger.MEASURES if m != "n_lines"]
    return rows.select("doc_id", *counts, (~ledger.passes("base")).alias("base_failed"), ledger.passes().alias("kept"), "failures")


def op13_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version of the policy does to all documents."""
    rows = Scratch(spark, "ledger").keep(ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "rows")
    found = [ledger.ablations(rows, policy) for policy in ledger.POLICIES]
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_shared_prefix_pieces, op3_token_counts, op4_chat_format, op5_hash_ring, op6_secret_scan, op7_kd_tree_topk, op8_minhash_dedup, op9_fingerprints, op10_genetic_packing, op11_filtering_codes, op12_lyndon_runs, op13_rule_ledger, op13_rule_ablations)
}

_ESCAPED = r"regexp_replace(text, '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g')"

#: The ring's arcs, the crc32 of texts by a table of 256 entries, then the walk over the arcs step by step.
_RING = r"""
WITH RECURSIVE ring AS (
    SELECT point, shard, row_number() OVER (ORDER BY point, shard) - 1 AS arc
    FROM (SELECT CAST('0x' || substr(md5('shard ' || s || ' place ' || v), 1, 8) AS BIGINT) AS point, s AS shard FROM range(16) a(s), range(64) b(v))),
crcs AS (
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
rows_ AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), 0) AS point FROM documents),
sized AS (
    SELECT doc_id, point, CAST(strlen(text) + 1 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
            lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
    FROM rows_, crcs),
placed AS (
    SELECT s.*, coalesce((SELECT min(arc) FROM ring WHERE ring.point >= s.point), 0) AS arc FROM sized s),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY arc ORDER BY point, doc_id, size, text_crc32) - 1 AS rank FROM placed),
given AS (
    SELECT list(r.shard + 1 ORDER BY r.arc) AS owner, list(coalesce(n, 0) ORDER BY r.arc) AS per_arc,
        (SELECT list(c // 16 + CASE WHEN s < c % 16 THEN 1 ELSE 0 END ORDER BY s) FROM (SELECT count(*) AS c FROM documents), range(16) x(s)) AS room
    FROM ring r LEFT JOIN (SELECT arc, count(*) AS n FROM placed GROUP BY arc) p USING (arc)),
walk AS (
    SELECT 0 AS arc, 0 AS place_, 0::BIGINT AS rank, per_arc[1] AS left_, list_transform(range(16), lambda x: 0::BIGINT) AS used,
        least(per_arc[1], room[owner[1]]) AS take, owner[1] AS shard, 0::BIGINT AS slot FROM given
    UNION ALL
    SELECT n.arc, n.place_, n.rank, n.left_, n.used, least(n.left_, room[owner[n.place_ + 1]] - n.used[owner[n.place_ + 1]]), owner[n.place_ + 1], n.used[owner[n.place_ + 1]]
    FROM (
        SELECT CASE WHEN take = left_ THEN arc + 1 ELSE arc END AS arc, CASE WHEN take = left_ THEN arc + 1 ELSE (place_ + 1) % 1024 END AS place_,
            CASE WHEN take = left_ THEN 0 ELSE rank + take END AS rank, CASE WHEN take = left_ THEN per_arc[arc + 2] ELSE left_ - take END AS left_,
            list_transform(used, lambda u, i: CASE WHEN i = shard THEN u + take ELSE u END) AS used, owner, room
        FROM walk, given WHERE arc < 1024) n
    WHERE n.arc < 1024)
SELECT r.doc_id, r.size, r.text_crc32, 'rows' AS law, CAST(w.shard - 1 AS INTEGER) AS shard, w.slot + r.rank - w.rank AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked r JOIN walk w ON r.arc = w.arc AND w.rank <= r.rank AND r.rank < w.rank + w.take"""


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, factor: int = codes.FACTOR) -> str:
    """Every part against every entry, in as many rounds."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT vec_id, part, x, arg_min(entry, away * {entries} + entry) AS entry, min(away) AS away
    FROM (SELECT p.vec_id, p.part, p.x, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS away FROM p JOIN book{r} b ON p.part = b.part)
    GROUP BY vec_id, part, x)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
    SELECT part, entry, list(x ORDER BY place) AS x
    FROM (SELECT part, entry, place, CAST(floor(sum(c) / count(*)) AS BIGINT) AS x FROM (SELECT part, entry, unnest(range(len(x))) AS place, unnest(x) AS c FROM near{r}) GROUP BY part, entry, place) GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k AS part, v[k * (len(v) // {parts}) + 1:(k + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) r(k)),
book0 AS MATERIALIZED (SELECT part, n AS entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM v QUALIFY n < {entries}) f USING (vec_id)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)"""


_LEDGER_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS said FROM split WHERE len(w) > 4),
again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, said) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, sum(least(coalesce(later - i, 5), 5)) AS n FROM again GROUP BY doc_id),
counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
    FROM split LEFT JOIN repeated USING (doc_id)),
failed AS (
    SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT)
        + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT) + 16 * CAST(word_chars > 40 * n_words AS BIGINT) AS failures FROM counted)"""

ORACLES = {
    "op11_filtering_codes": _codes_sql(),
    "op13_rule_ledger": f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM failed""",
    "op13_rule_ablations": f"""{_LEDGER_SQL},
policies AS (SELECT * FROM (VALUES ('base', 3), ('v1', 7), ('v2', 31)) p(policy, mask)),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('long_words', 16)) r(rule, bit))
SELECT policy, rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & mask = bit) AS n_only,
    count(*) FILTER (failures & mask & ~bit <> 0) AS n_rejected_without, count(*) AS n_rows, count(*) FILTER (failures & bit <> 0) = 0 AS never, count(*) FILTER (failures & bit = 0) = 0 AS always
FROM failed, policies, rules WHERE mask & bit <> 0 GROUP BY policy, rule""",
    "op5_hash_ring": _RING,
    "op4_chat_format": rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + length({_ESCAPED}) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op7_kd_tree_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op8_minhash_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
    SELECT doc_id AS node, doc_id AS found FROM documents
    UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.found = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT node, min(found) AS component_id FROM reach GROUP BY node) c ON c.node = sets.doc_id""",
}
