"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators: hashed word n-grams (one and two words, lower-cased), n-grams of word shapes (case, last character, digits, whether a
word repeats the one before), each shape n-gram with the share of the text that it makes up, and the share of lines
and of five-word shingles that repeat. A text's indicators are scaled by the log-count ratios of the classes and to unit length;
the weights come from dual coordinate descent, and the margins from a fold that had no part in it are turned into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACES, Kept, Segment, crc32_of_id, distinct, map_rows, mix64, sampled, segments, shingles, ship, spans, trim, word_bounds

BITS = 18
#: The bounded training sample: labelled rows that are learned from, about so many.
TRAIN_ROWS = 6000
ALPHA, COST, EPOCHS = 1.0, 1.0, 12
SHARES = (0.5, 0.25, 0.125, 0.0625, 0.03125)


def _kinds() -> np.ndarray:
    """A class for each byte: 0 other, 1 lower case, 2 upper case, 3 digit, 4 '.', 5 ',', 6 '!' or '?', 7 symbols, 8 the bytes of
    letters beyond ASCII."""
    kind = np.zeros(256, np.uint8)
    for chars, k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".", 4), (b",", 5), (b"!?", 6), (b"#*$%&|<>", 7), (range(128, 256), 8)):
        kind[list(chars)] = k
    return kind


_KIND = _kinds()


def shapes(seg: Segment) -> np.ndarray:
    """A small number, below SHAPES, for the shape of each word of a segment's texts as they are."""
    start, end = word_bounds(seg.data)
    kind = _KIND[np.frombuffer(seg.data, np.uint8)]
    upper = np.add.reduceat((kind == 2).astype(np.int64), start)
    lower = np.add.reduceat((kind == 1).astype(np.int64), start)
    digit = np.add.reduceat((kind == 3).astype(np.int64), start) > 0
    case = np.where(upper == 0, 0, np.where((upper == 1) & (lower > 0), 1, np.where(upper > lower, 3, 2)))
    same = np.concatenate(([False], seg.hashes[1:] == seg.hashes[:-1]))
    same[seg.first[:-1][seg.counts > 0]] = False
    long = np.minimum(np.log2(end - start).astype(np.int64), 5)
    return (((case * 9 + kind[end - 1]) * 2 + digit) * 2 + same) * 6 + long


def shares(values: np.ndarray, owner: np.ndarray, totals: np.ndarray, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indicators, with their texts, of each text's values (below 2**22), and of each share of the text's values that one reaches."""
    seen, count = np.unique(owner << 22 | values, return_counts=True)
    own, value = seen >> 22, (seen & (1 << 22) - 1).astype(np.uint64)
    out = [(own, mix64(value + np.uint64(salt << 40)))]
    for k, share in enumerate(SHARES):
        high = count >= share * totals[own]
        out.append((own[high], mix64(value[high] + np.uint64((salt << 40) + (k + 1 << 48)))))
    return out


def repeats(distinct: np.ndarray, totals: np.ndarray, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indicators, with their texts, of the shares that repeats among a text's values reach."""
    share = 1 - distinct / np.maximum(totals, 1)
    out = []
    for k, s in enumerate(SHARES):
        own = np.flatnonzero((share >= s) & (totals > 0))
        out.append((own, np.full(len(own), mix64(np.array([(salt << 40) + k], np.uint64))[0])))
    return out


def line_counts(text: bytes | None) -> tuple[int, int]:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(SPACES)]
    return len(set(lines)), len(lines)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct indicator numbers below 2**BITS of each text, one text after another, and how many each has: none for a text
    without words."""
    out, sizes = [np.empty(0, np.int32)], []
    for seg, low in zip(segments(texts), segments(texts, lower=True), strict=True):
        n, owner, words = seg.texts, seg.owner(), low.hashes
        if not len(words):
            sizes.append(np.zeros(n, np.int64))
            continue
        two, five, shape = low.inside(2), low.inside(5), shapes(seg)
        # texts of a segment have 12 bits, shingles of one text are told apart by 52
        grams = distinct(owner[five].astype(np.uint64) << np.uint64(52) | shingles(words, 5)[five] >> np.uint64(12))
        lines = np.array([line_counts(t) for t in texts[seg.at : seg.at + n]]).reshape(-1, 2).T
        lines = np.where(seg.counts > 0, lines, 0)
        fives = np.bincount(owner[five], minlength=n)
        parts = [(owner, words), (owner[two], shingles(words, 2)[two])]
        parts += shares(shape, owner, seg.counts, 1)
        parts += shares(shape[two + 1] * 4096 + shape[two], owner[two], np.maximum(seg.counts - 1, 1), 2)
        parts += repeats(lines[0], lines[1], 3) + repeats(np.bincount((grams >> np.uint64(52)).astype(np.int64), minlength=n), fives, 4)
        key = distinct(np.concatenate([own << BITS | (x >> np.uint64(64 - BITS)).astype(np.int64) for own, x in parts]))
        out.append((key & (1 << BITS) - 1).astype(np.int32))
        sizes.append(np.bincount(key >> BITS, minlength=n))
    return np.concatenate(out), np.concatenate(sizes) if sizes else np.empty(0, np.int64)


@dataclass
class Model:
    weight: np.ndarray  # of each indicator, log-count ratio included
    scale: np.ndarray  # squared log-count ratios, for a text's length
    bias: float
    slope: float
    offset: float

    def margins(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts whose indicators are x, one text after another."""
        out, some = np.full(len(sizes), self.bias), np.flatnonzero(sizes)
        if len(some):
            begin = (np.cumsum(sizes) - sizes)[some]
            length = np.sqrt(np.add.reduceat(self.scale[x].astype(np.float64), begin))
            worth = np.add.reduceat(self.weight[x].astype(np.float64), begin)
            out[some] += np.where(length > 0, worth / np.maximum(length, 1e-30), 0.0)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts)) + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << BITS, ALPHA) for _ in (0, 1)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss; each class weighs as much as the other."""
    w, bias = np.zeros(1 << BITS), 0.0
    norm = np.array([np.sqrt((ratio[x] ** 2).sum()) or 1.0 for x in rows])
    each = {k: COST * len(y) / (2 * max((y == k).sum(), 1)) for k in (-1, 1)}
    dual, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(y)):
            x = rows[i]
            values = ratio[x] / norm[i]
            slope = y[i] * (float((w[x] * values).sum()) + bias) - 1
            new = min(max(dual[i] - slope / (float((values * values).sum()) + 1), 0.0), each[int(y[i])])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                most = max(most, abs(step))
                w[x] += step * values
                bias += step
                dual[i] = new
        if most < 1e-3:
            break
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps on smoothed labels."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.array([hess[1, 1] * grad[0] - hess[0, 1] * grad[1], hess[0, 0] * grad[1] - hess[1, 0] * grad[0]]) / (hess[0, 0] * hess[1, 1] - hess[0, 1] ** 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 0.0), b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0) -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod `parts` is not `held`.

    Of these about TRAIN_ROWS are used at most, picked by a hash of doc_id; their indicators come to the driver, their texts
    don't. Rows with a null label, doc_id or text are passed over; of a doc_id labelled twice the larger label counts. The last part
    calibrates. Without labels of both classes every text scores 0.5.
    """
    part = F.pmod(crc32_of_id(), F.lit(parts))
    labels = labels.select("doc_id", label)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (part != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = TRAIN_ROWS / max(chosen.count(), TRAIN_ROWS)
    chosen = chosen.where(sampled(F.col("doc_id"), share)).withColumn("part", part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "label", "part", F.col("text").cast("binary").alias("text"))

    def make():
        def fn(rows):
            x, sizes = features(rows["text"])
            ends = np.cumsum(sizes).tolist()
            return {"doc_id": rows["doc_id"], "label": rows["label"], "part": rows["part"], "x": [x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]}

        return fn

    got = sorted(map_rows(rows, make, "doc_id long, label int, part long, x binary").toLocalIterator(), key=lambda r: (r["doc_id"], r["x"]))
    x = [np.frombuffer(bytes(r["x"]), np.int32) for r in got]
    y = np.array([1 if r["label"] > 0 else -1 for r in got])
    last = (held - 1) % parts
    fit = np.array([r["part"] != last for r in got], dtype=bool)
    if not len(y) or len({*y[fit].tolist()}) < 2:
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, 0.0)
    ratio = log_count_ratios([v for v, f in zip(x, fit, strict=True) if f], y[fit])
    w, bias = dual_coordinate_descent([v for v, f in zip(x, fit, strict=True) if f], y[fit], ratio)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    check = ~fit if len({*y[~fit].tolist()}) == 2 else fit
    held_x = [v for v, c in zip(x, check, strict=True) if c]
    model.slope, model.offset = calibrated(model.margins(np.concatenate(held_x), np.array([len(v) for v in held_x])), y[check])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The probability of label 1 for every whole text.

    docs: doc_id, text; other columns, whatever their names, are not read. Null, empty and blank texts have no indicators and get
    the score of the bias. Null doc_ids and repeated rows pass through, one row out for each row in; an empty table gives no rows.
    Returns doc_id, score.
    """

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "score": model.scores(rows["text"])}

    return map_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), make, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents with a score of `threshold` or more, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        Kept.forget()
        texts = text.tolist()
        out = pd.Series([x for a, b in spans(texts) for x in model.scores(texts[a:b])], dtype="float64")
        del texts
        trim()
        return out

    return docs.where(scores(F.col("text").cast("binary")) >= threshold)
