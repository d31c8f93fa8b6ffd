"""Documents with every odd case, and the words of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)] + ["été", "Über", "naïve", "日本", "the", "of"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, source, lang): copies, near copies, shared passages, empty, null, blank and long texts, repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    base = [sentence(rng, rng.randint(1, 150)) for _ in range(n)]
    base += [base[3], base[3].upper(), base[5].replace(" ", "\n\t", 3), base[7] + " tail", "", "   ", None, None, "x", sentence(rng, 3000)]
    for i in range(0, 12):
        base[i] = f"{base[i]} {passage} {sentence(rng, 5)}"
    for i in range(12, 20):  # near copies of one text
        words = base[20].split() + sentence(rng, 60).split() if i == 12 else base[12].split()
        if i > 12:
            words[rng.randrange(len(words))] = f"edit{i}"
        base[i] = " ".join(words)
    rows = [(i * 3 % (len(base) * 3 + 1), t, f"s{i % 4}" if i % 9 else None, ("en", "fr")[i % 2]) for i, t in enumerate(base)]
    rows.append(rows[0])  # a row that repeats
    rows.append((None, "no id at all but some words in this text here", "s1", None))
    return rows


SCHEMA = "doc_id long, text string, source string, lang string"


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    if clash:  # extra columns with names that operators use inside
        for c in ("n_words", "key", "fp", "rep", "class", "size", "kept", "hashes", "score", "label", "part", "quality", "sha_of_text", "own_sha256", "gone_id", "gone_sha256", "__times", "__id", "__copy", "Plan_Id", "plan_times"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df
