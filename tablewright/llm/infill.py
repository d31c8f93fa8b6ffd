"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent zstandard frames of FRAME bytes at most, with the numbers of units, code points and bytes before each frame.
A cut after so many units is found in these numbers; only the frame that holds it is decompressed. Outputs are written, and digests taken,
by streaming frames in the order of the output, so no text is ever copied whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows, word_bounds

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: The order of parts and markers of each form; a part is named by its marker.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def ends_of_words(data: bytes) -> np.ndarray:
    return word_bounds(data)[1]


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes, also of a part of a text."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def blocks(data: bytes) -> Iterator[bytes]:
    """Parts of FRAME bytes at most, cut between code points."""
    at = 0
    while at < len(data):
        end = min(at + FRAME, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


class FrameWriter:
    """Gathers chunks of bytes into compressed frames."""

    def __init__(self) -> None:
        self.zip, self.frames, self.rest = zstandard.ZstdCompressor(level=1), [], bytearray()

    def write(self, chunk: bytes) -> None:
        self.rest += chunk
        while len(self.rest) >= 2 * FRAME:
            self.flush(FRAME)

    def flush(self, size: int) -> None:
        self.frames.append(self.zip.compress(bytes(self.rest[:size])))
        del self.rest[:size]

    def done(self) -> list[bytes]:
        while self.rest:
            self.flush(FRAME)
        return self.frames


def opened(frames: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of each frame, one frame at a time."""
    unzip = zstandard.ZstdDecompressor()
    return (unzip.decompress(f) for f in frames)


@dataclass
class Frames:
    """A text as frames. A unit is white space and the word after it, or the white space at the end."""

    frames: list[bytes]
    units: np.ndarray  # units that end in the frames before each, and in all
    at: np.ndarray  # bytes before each, and all
    chars: np.ndarray  # code points before each, and all
    tail: bool  # whether white space without a word ends the text

    @classmethod
    def of(cls, data: bytes) -> Frames:
        zipped, units, at, chars = [], [0], [0], [0]
        zipper = zstandard.ZstdCompressor(level=1)
        for part in blocks(data):
            end = at[-1] + len(part)
            ends = ends_of_words(part)
            going_on = len(ends) and ends[-1] == len(part) and end < len(data) and data[end] not in b" \t\n\x0b\x0c\r"
            zipped.append(zipper.compress(part))
            units.append(units[-1] + len(ends) - bool(going_on))
            at.append(end)
            chars.append(chars[-1] + characters(part))
        tail = bool(data) and data[-1] in b" \t\n\x0b\x0c\r"
        return cls(zipped, np.array(units), np.array(at), np.array(chars), tail)

    @property
    def n(self) -> int:
        return int(self.units[-1]) + self.tail

    @property
    def size(self) -> int:
        return int(self.at[-1])

    def frame(self, k: int) -> bytes:
        return next(opened(self.frames[k : k + 1]))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first so many units."""
        if units == 0:
            return 0, 0
        if units > self.units[-1]:
            return self.size, int(self.chars[-1])
        k = int(np.searchsorted(self.units, units)) - 1
        part = self.frame(k)
        end = int(ends_of_words(part)[units - self.units[k] - 1])
        return int(self.at[k]) + end, int(self.chars[k]) + characters(part[:end])

    def part(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        k = int(np.searchsorted(self.at, start, side="right")) - 1
        while k < len(self.frames) and self.at[k] < end:
            if self.at[k + 1] > start:
                yield self.frame(k)[max(start - int(self.at[k]), 0) : end - int(self.at[k])]
            k += 1


def rearranged(text: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output: the text itself (plain), or its parts before `first` bytes, up to `second` and after, behind their markers."""
    if form == "plain":
        yield from text.part(0, text.size)
        return
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.size)}
    for marker in ORDER[form]:
        yield marker
        yield from text.part(*parts[marker])


def split_at_markers(chunks: Iterable[bytes]) -> Iterator[tuple[bytes | None, bytes]]:
    """(marker of the part, bytes) of an output that is not plain, in its order; a marker may lie across chunks."""
    marker, rest = None, b""
    for chunk in chunks:
        rest += chunk
        while True:
            at, found = min(((rest.find(m), m) for m in MARKERS if m in rest), default=(-1, None))
            if found is None:
                break
            yield marker, rest[:at]
            marker, rest = found, rest[at + len(found) :]
        keep = len(rest) - 2  # a marker that is not whole yet
        if keep > 0:
            yield marker, rest[:keep]
            rest = rest[keep:]
    yield marker, rest


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text, rebuilt from an output's frames and its form alone: prefix, middle and suffix, a pass over the output for each."""
    if form == "plain":
        yield from opened(frames)
        return
    for wanted in (PREFIX, MIDDLE, SUFFIX):
        yield from (part for marker, part in split_at_markers(opened(frames)) if marker == wanted)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """The four numbers of a document: the first groups of eight digits of the SHA-256 of "<seed>:<doc_id>" (a null id: nothing)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """Every whole text, `share` percent of them cut into prefix, middle and suffix and rearranged, of which `spm_share` percent suffix first.

    docs: doc_id, text; other columns, whatever their names, are not read. Texts that are null (taken as empty), empty, or hold a
    marker stay plain. Cuts and forms depend on the seed and doc_id alone, so rows that repeat come out alike and a null doc_id counts as an
    empty one; one row out for each row in. A text of one word, or of white space alone, is one unit; parts may be empty.
    Returns doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain), output (zstandard frames, to be
    decompressed one after another).
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *draws(seed, F.col("doc_id")))

    def make():
        def fn(rows: dict[str, list]) -> dict:
            out = {k: [] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
            for doc_id, data, h1, h2, h3, h4 in zip(*(rows[c] for c in ("doc_id", "text", "h1", "h2", "h3", "h4")), strict=True):
                data = data or b""
                text = Frames.of(data)
                n, form, first, second, prefix_chars, middle_chars = text.n, "plain", 0, 0, None, None
                if data and h3 % 100 < share and not any(m in data for m in MARKERS):
                    form = "spm" if h4 % 100 < spm_share else "psm"
                    (first, prefix_chars), (second, upto) = (text.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    middle_chars = upto - prefix_chars
                if form == "plain":
                    output = text.frames
                else:
                    writer = FrameWriter()
                    for chunk in rearranged(text, form, first, second):
                        writer.write(chunk)
                    output = writer.done()
                for key, value in zip(out, (doc_id, n, form, prefix_chars, middle_chars, output), strict=True):
                    out[key].append(value)
            return out

        return fn

    return map_rows(rows, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def digest(transformed: DataFrame) -> DataFrame:
    """In place of each output, its SHA-256 and that of the text rebuilt from it, both streamed frame by frame."""

    def make():
        def sha256(chunks: Iterable[bytes]) -> str:
            h = hashlib.sha256()
            for chunk in chunks:
                h.update(chunk)
            return h.hexdigest()

        def fn(rows: dict[str, list]) -> dict:
            output = rows.pop("output")
            rows["output_sha256"] = [sha256(opened(frames)) for frames in output]
            rows["restored_sha256"] = [sha256(restored(frames, form)) for frames, form in zip(output, rows["form"], strict=True)]
            return rows

        return fn

    return map_rows(transformed, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
