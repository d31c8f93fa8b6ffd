"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text yields the longest match from any place of a new text: following its
transitions until there is none. Cutting a text into such longest phrases, one after another and across its words, takes few
phrases with its own language's automaton and many with another's; the language with the fewest phrases a letter wins. A text is
parsed as lower-case letters with one space between words, in pieces of PIECE characters, whose last phrase ends with them:
the pieces of a batch's texts are parsed together, a character at a time.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows

#: The bounded training sample: documents of a language, and characters of each of them: a longer one gives that many from a place
#: of its own.
TRAIN_DOCS, TRAIN_CHARS = 40, 2000
#: Characters of a text that are parsed on their own, and letters of a batch that are parsed together.
PIECE, TOGETHER = 512, 1 << 22
#: Letters of a language that its table has a column for, the most frequent ones; the others' transitions are found by binary search.
ALPHABET = 126
#: Cells of all languages' tables together; with more, columns are left to the search, which finds the same.
CELLS = 1 << 26
#: Numbers of characters: no letter, and letters that no language has learned.
SPACE, OTHER = 0, 1


def suffix_automaton(text: str) -> dict[tuple[int, str], int]:
    """Transitions (state, character) -> state of the automaton of all substrings of text; state 0 is the start."""
    nexts: list[dict[str, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for ch in text:
        now = len(nexts)
        nexts.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and ch not in nexts[p]:
            nexts[p][ch] = now
            p = link[p]
        if p != -1:
            q = nexts[p][ch]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(ch) == q:
                    nexts[p][ch] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return {(s, ch): t for s, row in enumerate(nexts) for ch, t in row.items()}


def phrases(automaton: dict[tuple[int, str], int], text: str) -> int:
    """Longest matches, one after another, that make up text; a character that never occurred is a phrase of its own."""
    n, state, go = 0, 0, automaton.get
    for ch in text:
        after = go((state, ch))
        if after is None:
            n += state != 0
            after = go((0, ch))
            if after is None:
                n += 1
                after = 0
        state = after
    return n + (state != 0)


def letters_only(text: str) -> str:
    """Lower-cased letters, with one space for all that is between them."""
    return " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())


class Steps:
    """A language's automaton, for many texts at once: a table of state x letter for its frequent letters, sorted keys
    state * letters + letter for the others."""

    def __init__(self, text: str, code: dict[str, int], cells: int):
        """code: the number, from 2, of each letter of any language."""
        automaton = suffix_automaton(text)
        code = code | {" ": SPACE}
        letters = [ch for ch, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))]
        states = max(automaton.values(), default=0) + 1
        self.n = len(letters) + 1
        self.width = 1 + min(len(letters), ALPHABET, max(cells // states, 1))
        self.column = np.zeros(max(code.values()) + 1 if code else 2, np.int64)  # 0: no letter of this language
        self.column[[code[ch] for ch in letters]] = np.arange(1, self.n)
        own = {ch: k for k, ch in enumerate(letters, 1)}
        self.table = np.full((states, self.width), -1, np.int32)
        self.root = np.full(self.n, -1, np.int32)
        rare = []
        for (s, ch), t in automaton.items():
            c = own[ch]
            if s == 0:
                self.root[c] = t
            if c < self.width:
                self.table[s, c] = t
            else:
                rare.append((s * self.n + c, t))
        self.keys, self.targets = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after letters c (of this language's columns); -1 where there is none."""
        if not len(self.keys):
            return self.table[state, c]
        out = self.table[state, np.where(c < self.width, c, 0)]
        rare = np.flatnonzero(c >= self.width)
        key = state[rare] * self.n + c[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[rare] = np.where(self.keys[at] == key, self.targets[at], -1)
        return out


class Parser:
    """Phrases that texts take with each language's automaton."""

    loaded: dict = {}

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        code = {ch: k for k, ch in enumerate(sorted(set().union(*samples.values()) - {" "}), 2)}
        self.code = np.array([OTHER if chr(c).isalpha() else SPACE for c in range(sys.maxunicode + 1)], np.int32)
        self.code[[ord(ch) for ch in code]] = np.arange(2, len(code) + 2)
        self.steps = [Steps(samples[lang], code, CELLS // len(self.langs)) for lang in self.langs]

    @classmethod
    def get(cls, samples: dict[str, str]) -> Parser:
        """The one that this worker has built; another model takes its place."""
        if cls.loaded.get("samples") != samples:
            cls.loaded = {"samples": samples, "parser": cls(samples)}
        return cls.loaded["parser"]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (a row) by language (a column), and its letters."""
        lower = [t.lower() for t in texts]
        codes = self.code[np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
        space = codes == SPACE
        keep = ~space | np.concatenate(([False], ~space[:-1] & (owner[1:] == owner[:-1])))[: len(space)]
        codes, owner = codes[keep], owner[keep]
        letters = np.bincount(owner[codes != SPACE], minlength=len(texts))
        length = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        pieces = -(-length // PIECE)
        of = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(length) - length)[of] + PIECE * number
        size = np.minimum(length[of] - PIECE * number, PIECE)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), TOGETHER // PIECE):
            part = order[at : at + TOGETHER // PIECE]
            for k, steps in enumerate(self.steps):
                np.add.at(out[:, k], of[part], self.parse(steps, codes, begin[part], size[part]))
        return out, letters

    @staticmethod
    def parse(steps: Steps, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each piece; sizes descend, so that the pieces that still go on are the first ones."""
        state, n = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left") if len(size) else []
        for t, m in enumerate(live):
            c = steps.column[codes[begin[:m] + t]]
            before = state[:m]
            after = steps.after(before, c)
            cut = np.flatnonzero(after < 0)
            if len(cut):
                again = steps.root[c[cut]]
                n[cut] += (before[cut] != 0).astype(np.int64) + (again < 0)
                after[cut] = np.maximum(again, 0)
            state[:m] = after
        return n + (state != 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its score."""
        n, letters = self.counts([t or "" for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        order = np.argsort(n, axis=1, kind="stable")  # ties: the first by name
        rows = np.arange(len(texts))
        best, second = n[rows, order[:, 0]], n[rows, order[:, min(1, len(self.langs) - 1)]]
        some = letters > 0
        score = np.where(some, second / np.maximum(best + second, 1), 0.0)
        return [self.langs[k] if s else "und" for k, s in zip(order[:, 0].tolist(), some.tolist(), strict=True)], score


def train(docs: DataFrame, learn: Column, lang: str = "lang") -> dict[str, str]:
    """The text of each language's training sample, as letters_only().

    Where `learn` holds and lang and text are not null: of each language TRAIN_DOCS documents at most, picked by a hash of the
    doc_id, and TRAIN_CHARS characters of each, from a place that a hash picks; this bound is all that the driver gets for a
    language. Null doc_ids are one document; repeated rows count once; no rows give no language.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col("text").isNotNull())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(TRAIN_DOCS))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    part = F.substring(F.col("text"), place, F.lit(TRAIN_CHARS))
    picked = rows.groupBy(F.col(lang).alias("lang"), slot.alias("slot")).agg(F.min_by(part, F.struct(F.xxhash64("doc_id", F.lit(7)), part)).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["slot"])):
        out.setdefault(r["lang"], []).append(letters_only(r["text"]))
    return {k: f" {joined} " for k, v in out.items() if (joined := " ".join(t for t in v if t))}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The language of every whole text, from its text alone.

    docs: doc_id, text; other columns, whatever their names, are not read. `und`, with score 0, where text is null or has no
    letter, or nothing was learned. Score: the second-best language's share of the phrases of the best two, 0.5 for a tie (then the
    first by name wins). Null doc_ids and repeated rows pass through, one row out for each row in; an empty table gives no rows.
    Returns doc_id, lang_pred, score.
    """

    def make():
        parser = Parser.get(samples)

        def fn(rows):
            lang, score = parser.predict(rows["text"])
            return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score}

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
