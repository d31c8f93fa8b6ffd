"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

On a sample of the rows that pass the base rule, each rule's running time is measured, and which rules reject each row. The
cascade's first rule is the one with most rejections a second; the next is the one with most among the rows that are left; and so
on. A row that one rule rejects is not shown to the next. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACE_RUN, sampled, stash, unstash

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample on which the rules are timed, about, and how often each is timed.
SAMPLE_ROWS, REPEAT = 1000, 16
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also where use() needs it in each step of a loop."""
    return F.transform(F.array(value), use)[0]


def repeated_words(hashes: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more, from the words' hashes."""
    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, x, i: (F.get(s, i)["g"] == x["g"])
        twice = let(order, lambda s: F.filter(s, lambda x, i: F.coalesce((i > 0) & same(s, x, F.greatest(i - 1, F.lit(0))), F.lit(False)) | F.coalesce(same(s, x, i + 1), F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).cast("long").alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(hashes) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, n_lines (lines with a word), and text and hashes for the rules that need them."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.array_remove(F.split("text", SPACE_RUN), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    return d.withColumn("n_repeat_words", let(F.col("hashes"), repeated_words))


def stutters(hashes: Column) -> Column:
    """Words that equal the word before them."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("n"))
    return F.aggregate(hashes, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.coalesce((a["last"] == x).cast("int"), F.lit(0))).alias("n")), lambda a: a["n"])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: A rule is true for a row to be rejected; they see rows with at least one word.
RULES: dict[str, Callable[[], Column]] = {
    "word_length": lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words")),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "capitals": lambda: 2 * F.regexp_count("text", F.lit(r"\p{Lu}")) > F.col("word_chars"),
    "stutter": lambda: 5 * stutters(F.col("hashes")) > F.col("n_words"),
}


def cascade_order(costs: dict[str, float], patterns: dict[tuple[bool, ...], int]) -> list[str]:
    """Rules by rejections per cost among the rows that those before them leave; ties by name. patterns: rows by which rules, in the order
    of costs, reject them."""
    names, left, out = list(costs), dict(patterns), []
    while len(out) < len(names):
        rejected = {n: sum(c for p, c in left.items() if p[k]) for k, n in enumerate(names) if n not in out}
        best = min(rejected, key=lambda n: (-rejected[n] / costs[n], costs[n] if not rejected[n] else 0.0, n))
        out.append(best)
        left = {p: c for p, c in left.items() if not p[names.index(best)]}
    return out


def ordered_rules(measured: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """The cascade's order, from a sample of about `rows` rows that a hash of doc_id picks.

    Each rule runs over REPEAT copies of the sample, so that its own work outweighs the job's start; what the same job takes without a rule
    is taken off.
    """
    share = min(1.0, rows / max(measured.count(), 1))
    sample = stash(measured.where(sampled(F.col("doc_id"), share)).where(~base_failed()))
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def seconds(value: Column) -> float:
        begun = time.monotonic()
        many.agg(F.sum(value), F.sum("copy")).collect()
        return time.monotonic() - begun

    verdict = {n: F.coalesce(rule(), F.lit(False)) for n, rule in rules.items()}
    read = F.length("text") + F.size("hashes")
    seconds(read)
    nothing = seconds(read)
    costs = {n: max(seconds(read + v.cast("int")) - nothing, 1e-3) for n, v in verdict.items()}
    counted = sample.groupBy(F.array(*verdict.values()).alias("p")).count().collect()  # a row for each set of rules at most
    unstash(sample)
    return cascade_order(costs, {tuple(r["p"]): r["count"] for r in counted})


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES) -> DataFrame:
    """The base counts of every whole text, and whether it passes all rules.

    docs: doc_id, text; other columns, whatever their names, are not read. A null, empty or blank text has no words and fails the
    base rule. Null doc_ids and repeated rows pass through, one row out for each row in; an empty table gives no rows.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and rejected_by: the first
    rule of the cascade that rejected the row.
    """
    m = measures(docs)
    base = base_failed()
    cascade = F.when(base, F.lit("base"))
    for name in ordered_rules(m, rules):
        cascade = cascade.when(rules[name](), F.lit(name))
    out = m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), cascade.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())
