"""Secret scan: patterns, and sliding-window Shannon entropy of candidate strings, in DataFrame functions alone.

The entropy of a window of n characters is log2(n) - sum(c * log2(c)) / n over the counts c of its characters. The counts are kept
packed in a few numbers. As the window moves by one character, one count falls and one rises, so the sum changes by two differences of
f(c) = c * log2(c): the sums are kept in millionths, as whole numbers, so that results do not depend on the order of the steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.quality_rules import let

#: Patterns as the contract states them: fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes: patterns that must all be found and one that must not be, the entropy in bits that some window of a candidate must
#: reach, and what else it must hold. A candidate belongs to the first class that it fits. Words and numbers with single separators
#: between them are names, paths and dates, whatever their entropy; letters alone must hold more consonants in a row than words do.
#: No pattern repeats a group: the matcher would recurse once for each repetition.
CLASSES = (
    ("names", (r"^[A-Za-z][A-Za-z_/-]*[A-Za-z]$", r"[-_/]"), r"[-_/][-_/]", None, ""),
    ("numbers", (r"^[0-9][0-9_/-]*[0-9]$", r"[-/_]"), r"[-/_][-/_]", None, ""),
    ("letters", (r"^[A-Za-z]+$",), None, 3.8, r"[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{7}"),
    ("digits", (r"^[0-9]+$",), None, 3.1, ""),
    ("hex", (r"^[0-9a-fA-F]+$",), None, 2.9, ""),
    ("alphanumeric", (r"^[A-Za-z0-9]+$",), None, 3.4, ""),
    ("base64", (), None, 3.6, ""),
)
#: These parts of a candidate are documentation or rulers, not secrets; what is between them is judged.
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|x{6,}|[=_-]{6,}|0{8,}|1234567890|abcdefghij"
KINDS = ("assign", "access", "hex", "entropy")
SCALE = 1_000_000
#: Bits of a character's count in a window, and counts packed in one number.
BITS = WINDOW.bit_length()
PACKED = 63 // BITS
#: Matches of a text that are placed together: an array grows by one match at a time, and only so far.
TOGETHER = 512


def matches(pattern: str, text: Column) -> Column:
    """start and end (code points) and value of each leftmost non-overlapping match, from the gaps between matches."""

    def place(gaps: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), gaps.alias("gap"))
        return let(F.filter(pairs, lambda p: p["m"].isNotNull()), in_blocks)

    def in_blocks(found: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(found) / TOGETHER).cast("int") - 1)
        return let(F.transform(numbers, lambda b: F.slice(found, b * TOGETHER + 1, F.lit(TOGETHER))), placed)

    def placed(blocks: Column) -> Column:
        width = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, p: a + F.length(p["gap"]) + F.length(p["m"])))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(width, none, lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda block, b: spans(block, F.get(at, b)))))

    def spans(block: Column, at: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + F.length(p["gap"])
            end = start + F.length(p["m"])
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value")))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    found = let(F.split(text, pattern, -1), place)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def highest_entropy(s: Column) -> Column:
    """The highest entropy, in bits, of a window of WINDOW characters of s (at least as long)."""
    table = F.array(*(F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(WINDOW + 1)))
    f = lambda c: F.get(table, c)
    # a character's place among the packed counts: which number, and from which of its bits on
    words = -(-len(ALPHABET) // PACKED)
    place = lambda ch: let(F.position(ch, F.lit(ALPHABET)) - 1, lambda n: F.floor(n / PACKED).cast("int") * 64 + n % PACKED * BITS)
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63))
    count = lambda counts, p: F.call_function("shiftright", F.get(counts, F.shiftright(p, 6)), p.bitwiseAND(63)).bitwiseAND((1 << BITS) - 1).cast("int")
    plus = lambda counts, p, by: F.transform(counts, lambda c, k: F.when(k == F.shiftright(p, 6), c + by * one(p)).otherwise(c))

    def windows(places: Column) -> Column:
        empty = F.array_repeat(F.lit(0).cast("long"), words)
        first = let(F.aggregate(F.slice(places, 1, WINDOW), empty, lambda a, p: plus(a, p, 1)), lambda counts: started(counts, F.slice(places, 1, WINDOW)))
        steps = F.when(F.size(places) > WINDOW, F.sequence(F.lit(0), F.size(places) - WINDOW - 1)).otherwise(F.array().cast("array<int>"))
        return let(first, lambda start: F.aggregate(steps, start, lambda a, i: moved(a, F.get(places, i), F.get(places, i + WINDOW)), lambda a: a["low"]))

    def started(counts: Column, places: Column) -> Column:
        total = F.aggregate(F.array_distinct(places), F.lit(0).cast("long"), lambda a, p: a + f(count(counts, p)))
        return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), t.alias("low")))

    def moved(a: Column, out: Column, new: Column) -> Column:  # the window loses one character and gains one
        return F.when(out == new, a).otherwise(changed(a, out, new))

    def changed(a: Column, out: Column, new: Column) -> Column:
        less, more = count(a["counts"], out), count(a["counts"], new)
        total = a["sum"] + f(less - 1) - f(less) + f(more + 1) - f(more)
        return let(total, lambda t: F.struct(plus(plus(a["counts"], out, -1), new, 1).alias("counts"), t.alias("sum"), F.least(a["low"], t).alias("low")))

    characters = F.filter(F.split(s, ""), lambda ch: ch != "")
    low = let(F.transform(characters, place), windows)
    return F.lit(math.log2(WINDOW)) - low / F.lit(float(SCALE * WINDOW))


def is_secret(value: Column) -> Column:
    need = F.lit(None).cast("double")
    for _, found, never, least, must in reversed(CLASSES):
        fits = F.lit(True)
        for pattern in found:
            fits = fits & value.rlike(pattern)
        if never:
            fits = fits & ~value.rlike(never)
        need = F.when(fits, F.when(value.rlike(must), F.lit(least).cast("double"))).otherwise(need)
    parts = F.filter(F.split(value, ALLOWED, -1), lambda p: F.length(p) >= WINDOW)
    return F.coalesce(let(need, lambda n: F.when(n.isNotNull(), F.exists(parts, lambda p: highest_entropy(p) >= n))), F.lit(False))


def number_before(values: Column, marks: Column, equal: bool) -> Column:
    """For each of the sorted marks, how many values are below it (or equal to it): its place among all, less its place among the marks."""
    of_value, of_mark = (0, 1) if equal else (1, 0)
    tagged = lambda a, tag: F.transform(a, lambda x: F.struct(x.alias("at"), F.lit(tag).alias("tag")))
    order = F.sort_array(F.concat(tagged(values, of_value), tagged(marks, of_mark)))
    places = F.filter(F.transform(order, lambda x, i: F.when(x["tag"] == of_mark, i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i, k: i - k)


def free(candidates: Column, spans: Column) -> Column:
    """The candidates (sorted, apart from each other) that no span overlaps: as many spans start before a candidate's end as end by its start."""
    starts = number_before(F.transform(spans, lambda b: b["start"]), F.transform(candidates, lambda m: m["end"]), equal=False)
    ends = number_before(F.transform(spans, lambda b: b["end"]), F.transform(candidates, lambda m: m["start"]), equal=True)
    pairs = F.arrays_zip(candidates.alias("m"), starts.alias("starts"), ends.alias("ends"))
    return F.transform(F.filter(pairs, lambda p: p["starts"] == p["ends"]), lambda p: p["m"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    docs: doc_id, text; other columns, whatever their names, are not read. Kinds: assign, access and hex by pattern (matches of
    too few characters are dropped after matching), and entropy: candidates with a window of high entropy for their character
    class, outside of what the allow list names, and not overlapping a span of another kind. Null and empty texts have none. Null doc_ids and repeated
    rows pass through, one row out for each row in; an empty table gives no rows.
    Returns doc_id and spans: kind, start, end (code points, end exclusive), by start, then kind in that order.
    """
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longer = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6
    d = d.select("doc_id", "text", F.filter(matches(ASSIGN, text), longer).alias("assign"), matches(ACCESS, text).alias("access"), matches(HEX, text).alias("hex"), matches(CANDIDATE, text).alias("candidates"))
    d = d.select("doc_id", "assign", "access", "hex", F.filter(free(F.col("candidates"), F.concat("assign", "access", "hex")), lambda m: is_secret(m["value"])).alias("entropy"))

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    spans = F.concat(*(ranked(n, k) for n, k in enumerate(KINDS)))
    kinds = F.array(*map(F.lit, KINDS))
    return d.select("doc_id", F.transform(F.sort_array(spans), lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans' list, and the list of all spans."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
