"""Token counts by the whole-token shortcut, and token ids, of a word-BPE vocabulary file.

The tokenizer drops white space before it merges, and no pre-token spans white space. So a text's tokens are those of its
white-space chunks, each taken alone. Which vocabulary strings encode alone as one token is proven once, on the driver, by
encoding every one of them; tasks get the proven ones. Chunks and pre-tokens among these count as one without any merging, and
only the distinct rest are merged. The distinct chunks of a batch are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Kept, map_rows, word_bounds, word_hashes

#: Distinct chunks that a worker remembers; when it has so many, those not met again until it has so many anew are forgotten.
CACHE = 250_000
END, MARK = "</w>", b"\xff"


#: Texts of these characters alone are normalised by lower(), and their chunks split by PRE, as the tokenizer would do it
#: (see proves_latin); others go through the tokenizer's own normaliser and splitter.
LATIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i if i in plain else next(rest)) for i in range(256)]


def proven(path: str) -> list[str]:
    """The vocabulary strings that, alone, encode as exactly one token: a fixed set, at most of the size of the vocabulary."""
    if path not in _proven:
        tok = loaded_tokenizer(path)
        strings = sorted(s[: -len(END)] for s in tok.get_vocab() if s.endswith(END) and s[: -len(END)].isascii() and s != END)
        got = tok.encode_batch(strings, add_special_tokens=False)
        _proven[path] = [s for s, e in zip(strings, got, strict=True) if len(e.ids) == 1 and tok.normalizer.normalize_str(s) == s]
    return _proven[path]


_proven: dict[str, list[str]] = {}


def loaded_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkTokens:
    """Tokens of texts from tokens of chunks. ids=True keeps little-endian 32-bit ids, else counts. whole: what proven() returns."""

    def __init__(self, path: str, whole: list[str], ids: bool = False):
        from tokenizers import normalizers

        self.tok, self.ids = loaded_tokenizer(path), ids
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {s: self.value([i]) for s, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.whole = {s: self.value([self.tok.token_to_id(s + END)]) for s in whole}
        # merges what is normalised already; a special string that only lower-casing made is ordinary text
        self.plain = loaded_tokenizer(path)
        self.plain.normalizer, self.plain.encode_special_tokens = normalizers.Sequence([]), True
        self.letters = byte_alphabet()
        self.latin = self.proves_latin()
        self.proven = {s.encode(): v for s, v in self.whole.items()}
        self.known: dict[bytes, int | bytes] = dict(self.proven)
        self.older: dict[bytes, int | bytes] = {}
        self.met: dict[str, int | bytes] = {}

    @classmethod
    def get(cls, path: str, whole: list[str], ids: bool = False) -> ChunkTokens:
        """One for each worker, file and kind, while its tasks are of this operator."""
        return Kept.get(("tokens", path, ids), lambda: cls(path, whole, ids))

    def value(self, ids: list[int]):
        return struct.pack(f"<{len(ids)}I", *ids) if self.ids else len(ids)

    def proves_latin(self) -> bool:
        """Whether lower() and PRE do what the tokenizer does, tried for every character of LATIN, alone and among letters."""
        chars = [c for c in map(chr, range(0x250)) if LATIN.fullmatch(c) and c.strip()]
        same = lambda s: PRE.findall(s.lower()) == [s.lower()[a:b] for _, (a, b) in self.plain.pre_tokenizer.pre_tokenize_str(s.lower())]
        alphabet = all(self.plain.pre_tokenizer.pre_tokenize_str(c)[0][0] == self.raised(c) for c in chars)
        return alphabet and all(self.tok.normalizer.normalize_str(x) == x.lower() and same(x) for c in chars for x in (c, f"a{c}b", f"{c}7{c}"))

    def raised(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())

    def normalised(self, text: str | None) -> bytes:
        """The text as its chunks between spaces, in UTF-8; a special string is a chunk of MARK, which no UTF-8 holds, and its name."""
        if not text:
            return b""
        parts = []
        for part in self.split.split(text) if self.split and "<|" in text else [text]:
            if part in self.special:
                parts.append(MARK + part.encode())
            elif part and self.latin and LATIN.fullmatch(part):
                parts.append(part.lower().encode())
            elif part:
                parts.append(self.tok.normalizer.normalize_str(part).encode())
        return b" ".join(parts)

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if self.latin and LATIN.fullmatch(chunk):
            return [chunk] if chunk.isalpha() else PRE.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.plain.pre_tokenizer.pre_tokenize_str(chunk)]

    def merged(self, pieces: list[str]) -> list:
        """The values of pre-tokens that have to be merged."""
        got = map(self.plain.model.tokenize, map(self.raised, pieces))
        return [self.value([t.id for t in g]) for g in got] if self.ids else list(map(len, got))

    def learn(self, new: set[bytes]) -> None:
        """Make the chunks known: proven pre-tokens count as they are, the distinct rest are merged."""
        if len(self.known) > CACHE + len(self.proven):
            self.known, self.older, self.met = dict(self.proven), self.known, {}
        known, older, met = self.known, self.older, self.met
        known.update((c, older[c]) for c in new & older.keys())
        parts = {c: self.pieces(c.decode()) for c in new if c not in known and c[:1] != MARK}
        rest = list({p for ps in parts.values() for p in ps} - self.whole.keys() - met.keys())
        met.update(zip(rest, self.merged(rest), strict=True))
        of = lambda p: self.whole[p] if p in self.whole else met[p]
        for c, ps in parts.items():
            known[c] = of(ps[0]) if len(ps) == 1 else b"".join(map(of, ps)) if self.ids else sum(map(of, ps))
        known.update((c, self.special[c[1:].decode()]) for c in new if c[:1] == MARK)

    def values(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct chunks of all texts, which of them each chunk is, and the number of each text's first chunk."""
        parts = [self.normalised(t) for t in texts]
        data = b" ".join(parts)
        starts, ends = word_bounds(data)
        first = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        _, at, which = np.unique(word_hashes(data), return_index=True, return_inverse=True)
        chunks = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        out = list(map(self.known.get, chunks))
        missing = [k for k, v in enumerate(out) if v is None]
        if missing:
            self.learn({chunks[k] for k in missing})
            for k in missing:
                out[k] = self.known[chunks[k]]
        return out, which, first

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. Null has none."""
        values, which, first = self.values(texts)
        upto = np.concatenate(([0], np.cumsum(np.array(values, np.int64)[which])))
        return upto[first[1:]] - upto[first[:-1]]

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of each text as little-endian unsigned 32-bit numbers."""
        values, which, first = self.values(texts)
        pool = np.frombuffer(b"".join(values), "<u4")
        size = np.array([len(v) // 4 for v in values], np.int64)
        length, begin = size[which], (np.cumsum(size) - size)[which]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = pool[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])]
        return [ids[a:b] for a, b in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist(), strict=True)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    docs: any table with `key` and `text`; other columns, whatever their names, are not read. A null text counts as empty:
    0 bytes, 0 tokens. Null keys and repeated rows pass through, one row out for each row in.
    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    """

    whole = proven(vocabulary)

    def make():
        tokens = ChunkTokens.get(vocabulary, whole)

        def fn(rows):
            return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": tokens.counts(rows["text"])}

        return fn

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return map_rows(narrow, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
