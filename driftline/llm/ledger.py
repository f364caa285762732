"""Quality rules as a ledger of bits, in DataFrame functions alone.

``ledger`` measures each text once and evaluates every rule once: a row has the measurements and ``failures``, a number
whose bit k says that rule k failed. What is kept is decided afterwards by a policy, a named set of rules (a mask), so a new
version of a policy needs no text to be read again. ``ablations`` tells in one aggregation, from the bits alone, what each
rule of a policy does.

Words are runs of characters other than white space (U+0020, U+0009 to U+000D). A null text counts as empty: it has no words, so
it fails ``few_words``. Rows are judged one by one: repeated rows and ids, null ids and ties have no bearing on each
other, and nothing is shuffled or broadcast, so no key or text can crowd a task. A text of n words takes time of n log n and some
100 bytes a word in one row. Columns of the input pass through; those named as a measurement, ``failures`` or ``kept`` are replaced.

Windows of words are told apart by 64-bit hashes and then by their words: two different windows never count as the same.
(The same window twice is missed only where a third, different one of the text has its hash and stands between them.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: The rules by bit: a name, and when it fails, in measurements. New rules go to the end, as bits are kept in tables.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    ("long_words", lambda: F.col("word_chars") > 40 * F.col("n_words")),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that a kept text must pass.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"],
    "v2": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"],
}
LATEST = "v2"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, wherever the optimizer puts it."""
    return F.transform(F.array(value), then)[0]


def _same_window(words: Column, a: Column, b: Column) -> Column:
    same = F.lit(True)
    for k in range(WINDOW):
        same = same & (F.get(words, a + k) == F.get(words, b + k))
    return same


def _repeated(words: Column, hashes: Column) -> Column:
    """How many words stand in windows that the words have twice or more."""

    def places(windows: Column) -> Column:
        """Of (hash, place)s in order: the places whose neighbour has the same words, ascending."""

        def again(x: Column, k: Column) -> Column:
            before, after = F.get(windows, k - 1), F.get(windows, k + 1)
            return ((before["h"] == x["h"]) & _same_window(words, before["at"], x["at"])) | ((after["h"] == x["h"]) & _same_window(words, after["at"], x["at"]))

        return F.array_sort(F.transform(F.filter(windows, lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        """Each place covers as many words as there are up to the next one, a window at most."""
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    # most texts repeat no window: that's seen without sorting
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(pairs, lambda w: _let(places(w), covered))).otherwise(0)


def _windows(words: Column) -> Column:
    """A hash for each window, from a hash of each word."""

    def of(own: Column) -> Column:
        starts = F.slice(own, F.lit(1), F.greatest(F.size(own) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda h, k: F.xxhash64(h, *[F.get(own, k + n) for n in range(1, WINDOW)]))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measured(text: Column) -> Column:
    """The measurements of a text: a struct of longs."""

    def of(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

        def both(words: Column) -> Column:
            values = {
                "n_words": F.size(words),
                "word_chars": F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
                "n_symbols": F.size(F.regexp_extract_all(s, F.lit(SYMBOLS), F.lit(0))),
                "n_lines": F.size(lines),
                "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                "n_repeat_words": _let(_windows(words), lambda hashes: _repeated(words, hashes)),
            }
            return F.struct(*[values[m].cast("bigint").alias(m) for m in MEASURES])

        return _let(F.regexp_extract_all(s, F.lit(f"[^{SPACE}]+"), F.lit(0)), both)

    return _let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, the measurements, and ``failures`` (bigint): a bit for each rule."""
    rest = [f"`{c}`" for c in docs.columns if c not in (text, *MEASURES, "failures", "kept")]
    own = fresh(docs.columns, "measured")
    rows = docs.select(*rest, measured(F.col(f"`{text}`")).alias(own)).select(*rest, f"{own}.*")
    bits = F.lit(0).cast("bigint")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(), F.lit(BIT[name])).otherwise(0).cast("bigint"))
    return rows.withColumn("failures", bits)


def passes(policy: str = LATEST) -> Column:
    """Whether a row of a ledger is kept by a policy."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of a policy: how many rows fail it, how many only it (they would be kept without it), and how many the
    policy without it rejects, beside the number of all rows. One aggregation of counts, whatever the number of rules; an
    empty ledger has zeros. ``never`` and ``always`` say whether no row fails the rule, or every one: the bits of all rows
    or'ed and and'ed."""
    mask = POLICIES[policy]
    own = [name for name, _ in RULES if BIT[name] & mask]
    failed = F.col("failures").bitwiseAND(F.lit(mask).cast("bigint"))
    counts = []
    for name in own:
        bit, others = F.lit(BIT[name]).cast("bigint"), F.lit(mask & ~BIT[name]).cast("bigint")
        counts.append(F.struct(F.lit(name).alias("rule"), F.count_if(failed.bitwiseAND(bit) != 0).alias("n_failed"), F.count_if(failed == bit).alias("n_only"), F.count_if(failed.bitwiseAND(others) != 0).alias("n_rejected_without")))
    seen = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_or(failed), F.lit(0)).alias("any"), F.coalesce(F.bit_and(failed), F.lit(0)).alias("all"), F.array(*counts).alias("rules"))
    bit = F.element_at(F.create_map(*[F.lit(x) for name in own for x in (name, BIT[name])]), F.col("r.rule")).cast("bigint")
    each = seen.select("n_rows", "any", "all", F.explode("rules").alias("r"))
    return each.select(F.lit(policy).alias("policy"), "r.*", "n_rows", (F.col("any").bitwiseAND(bit) == 0).alias("never"), (F.col("all").bitwiseAND(bit) != 0).alias("always"))
