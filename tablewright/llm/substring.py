"""Repeated passages across documents, by seed and extend.

Seeds: of the k-word hashes that a window of `words` words covers, winnowing picks the smallest (the leftmost of equals), from
the window's content alone. So each occurrence of a window, in any document, is seeded by the same anchor. Consecutive windows
of one anchor are its run: the anchor extended to both sides, up to all windows that it can seed. Documents are joined on
anchors. Occurrences of an anchor whose runs are equal match to the runs' whole extent. Of the different runs of one anchor only the
one of the smallest doc_id is taken each: a match ends inside them, so their windows are compared one by one. Adjoining repeated
windows then merge into maximal repeats.

Each text is hashed once for its anchors and runs, which are kept as two arrays a document; texts are hashed again only where they
have repeats. Hot passages are combined before each shuffle: what is gathered for an anchor, a run or a window is a few numbers.
Equal means: of equal 64-bit hashes of the anchor and of the run; for windows, of two hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Segment, map_rows, mix64, ragged, segments, shingles, stash, unstash

SEED = 5


class Runs:
    """The windows of a segment's texts, and the runs of windows that share an anchor."""

    def __init__(self, seg: Segment, words: int, seed: int):
        self.at = seg.inside(words)  # the word at which each window starts
        windows, grams, width = shingles(seg.hashes, words), shingles(seg.hashes, seed), words - seed + 1
        low, place = grams[: len(windows)].copy(), np.arange(len(windows))
        for j in range(1, width):  # the window's smallest gram, step by step: no table of windows x grams
            other = grams[j : j + len(windows)]
            less = other < low
            low[less] = other[less]
            place[less] = np.flatnonzero(less) + j
        self.windows, low, place = windows[self.at], low[self.at], place[self.at]
        self.starts = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else np.empty(0, np.int64)
        self.lengths = np.diff(np.append(self.starts, len(self.windows)))
        self.anchors, self.owner = low[self.starts], seg.owner()[self.at]

    def run_ids(self) -> np.ndarray:
        """A hash of each run's windows in their order."""
        if not len(self.windows):
            return self.anchors
        place = (np.arange(len(self.windows)) - np.repeat(self.starts, self.lengths)).astype(np.uint64)
        return np.add.reduceat(mix64(self.windows + place * np.uint64(0x9E3779B97F4A7C15)), self.starts)

    def in_runs(self, wanted: list[list[int] | None]) -> np.ndarray:
        """Which windows belong to one of the runs that are wanted of their text."""
        return np.repeat(self._among(self.run_ids(), self.owner[self.starts], wanted), self.lengths)

    def among(self, wanted: list[list[int] | None]) -> np.ndarray:
        """Which windows are wanted of their text."""
        return self._among(self.windows, self.owner, wanted)

    @staticmethod
    def _among(values: np.ndarray, owner: np.ndarray, wanted: list[list[int] | None]) -> np.ndarray:
        lists = [np.array(w or [], np.int64).view(np.uint64) for w in wanted]
        salt = mix64(np.arange(len(lists), dtype=np.uint64) + np.uint64(1))
        keys = np.concatenate(lists) + np.repeat(salt, [len(x) for x in lists]) if lists else np.empty(0, np.uint64)
        return np.isin(values + salt[owner], keys)


def marks(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, anchors and runs (in order, a run for each anchor) of each text with a window; null doc_ids and texts have none."""

    def make():
        def fn(rows):
            anchors, runs, sizes = [], [], []
            for seg in segments(rows["text"]):
                r = Runs(seg, words, seed)
                anchors.append(r.anchors)
                runs.append(r.run_ids())
                sizes.append(np.bincount(r.owner[r.starts], minlength=seg.texts))
            sizes = np.concatenate(sizes)
            return {"doc_id": rows["doc_id"], "anchors": ragged(anchors, sizes), "runs": ragged(runs, sizes)}

        return fn

    return map_rows(docs.where("doc_id is not null and text is not null"), make, "doc_id long, anchors array<long>, runs array<long>")


def windows_of(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """window, check (a second hash) and doc_id of the windows that a text has in its runs of `open`; null texts have none."""

    def make():
        def fn(rows):
            out: dict = {"window": [], "check": [], "doc_id": []}
            for seg in segments(rows["text"]):
                r, part = Runs(seg, words, seed), slice(seg.at, seg.at + seg.texts)
                hit = np.flatnonzero(r.in_runs(rows["open"][part]))
                check = shingles(mix64(seg.hashes ^ np.uint64(0x5851F42D4C957F2D)), words)
                out["window"].append(r.windows[hit].view(np.int64))
                out["check"].append(check[r.at[hit]].view(np.int64))
                out["doc_id"].append(np.array(rows["doc_id"][part], np.int64)[r.owner[hit]])
            return {k: np.concatenate(v) for k, v in out.items()}

        return fn

    return map_rows(docs.select("doc_id", "text", "open"), make, "window long, check long, doc_id long")


def remove_repeats(docs: DataFrame, words: int = 13, seed: int = SEED) -> DataFrame:
    """Each text without the words of passages that a document with a smaller doc_id has, too.

    docs: doc_id, text; other columns, whatever their names, are not read. A window is `words` consecutive words of one text; each
    word is removed that a window covers whose words also start in a document with a smaller doc_id, judged on the input.
    Null, empty and blank texts have no words; texts of fewer words lose nothing; rows without doc_id neither remove nor
    lose words; of rows that repeat a doc_id none is smaller. An empty table gives no rows.
    Returns doc_id, n_words, n_removed, spans (start and end of each maximal repeat, in words, flattened) and kept_text (the
    words left, joined by one space), one row for each row.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    marked = stash(marks(texts, words, seed))
    rows = marked.select("doc_id", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("runs").alias("run"))).alias("m")).select("doc_id", "m.anchor", "m.run")

    # anchors of two documents or more; written, so that a hot one's rows can be split where they meet it
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("run").alias("a"), F.max("run").alias("b"))
    shared = stash(shared.where("first < last").select("anchor", "first", (F.col("a") != F.col("b")).alias("differ")))
    met = stash(rows.join(shared, "anchor").where("differ or first < doc_id"))
    unstash(marked)
    # of the different runs of an anchor: the smallest document of each
    smallest = stash(met.where("differ").groupBy("anchor", "run").agg(F.min("doc_id").alias("holder")))
    other = met.where("differ").join(smallest, ["anchor", "run"]).select("doc_id", "run", (F.col("holder") < F.col("doc_id")).alias("whole"))
    runs = met.where("not differ").select("doc_id", "run", F.lit(True).alias("whole")).union(other)
    hits = stash(runs.groupBy("doc_id").agg(F.collect_set(F.when(F.col("whole"), F.col("run"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("run"))).alias("open")))
    for old in (shared, met, smallest):
        unstash(old)

    found = stash(windows_of(texts.join(hits.where("size(open) > 0").select("doc_id", "open"), "doc_id"), words, seed))
    firsts = stash(found.groupBy("window", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "check", "first"))
    flagged = stash(found.join(firsts, ["window", "check"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("parts")))
    repeats = hits.select("doc_id", "whole").join(flagged, "doc_id", "left").where("size(whole) > 0 or parts is not null")
    unstash(found)
    unstash(firsts)

    def make():
        def fn(rows):
            n = len(rows["text"])
            out: dict = {"doc_id": rows["doc_id"], "n_words": [0] * n, "n_removed": [0] * n, "spans": [[]] * n, "kept_text": [""] * n}
            touched = [k for k in range(n) if rows["whole"][k] or rows["parts"][k]]
            for k in set(range(n)).difference(touched):
                pieces = (rows["text"][k] or b"").split()
                out["n_words"][k], out["kept_text"][k] = len(pieces), b" ".join(pieces).decode()
            for seg in segments([rows["text"][k] for k in touched]):
                ids = touched[seg.at : seg.at + seg.texts]
                r = Runs(seg, words, seed)
                at = r.at[r.in_runs([rows["whole"][k] for k in ids]) | r.among([rows["parts"][k] for k in ids])]
                step = np.zeros(len(seg.hashes) + 1, np.int64)
                step[at] += 1
                step[at + words] -= 1
                gone = np.cumsum(step[:-1]) > 0
                for k, a, b in zip(ids, seg.first[:-1], seg.first[1:], strict=True):
                    own = gone[a:b]
                    out["n_words"][k], out["n_removed"][k] = int(b - a), int(own.sum())
                    out["spans"][k] = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                    out["kept_text"][k] = b" ".join(compress(rows["text"][k].split(), (~own).tolist())).decode()
            return out

        return fn

    return map_rows(texts.join(repeats, "doc_id", "left").select("doc_id", "text", "whole", "parts"), make, "doc_id long, n_words long, n_removed long, spans array<long>, kept_text string")


def brute_force(rows: list[tuple[int | None, str | None]], words: int = 13) -> list[tuple[int | None, int, int, str]]:
    """What remove_repeats() returns, by comparing all windows; for tests."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - words + 1):
                key = tuple(w[k : k + words])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - words + 1):
            if i is not None and first[tuple(w[k : k + words])] < i:
                gone |= set(range(k, k + words))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
