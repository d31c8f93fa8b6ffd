import hashlib
import random
import re

import pytest

from tablewright.llm import infill
from tests.llm.helpers import corpus, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_force(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    digits = SHA("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, SHA(t), SHA(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), SHA(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), SHA(t)


@pytest.mark.parametrize("size", [7, 64, infill.FRAME])
def test_fill_in_middle(spark, monkeypatch, size):
    odd = ["<P>", "a <M> b", "<S", "<S<", ">P>", "< P >", "\n", "x\n", "  x", "日本語 テキスト" * 9, "é" * 50, "<" * 40, "a\x0b\x0cb\x1cc d"]
    rows = [r[:2] for r in corpus(5)] + [(7000 + 50 * k + i, t) for k, t in enumerate(odd) for i in range(12)]
    want = sorted((brute_force(*r) for r in rows), key=str)
    if size == infill.FRAME:
        got = infill.digest(infill.fill_in_middle(frame(spark, [(*r, None, None) for r in rows]))).collect()
        assert sorted(map(tuple, got), key=str) == want
    else:  # tiny frames, in this process: words and markers lie across them
        monkeypatch.setattr(infill, "FRAME", size)
        for doc_id, n, form, p, m, out, _ in want:
            text = next(t or "" for i, t in rows if i == doc_id) if doc_id is not None else rows[[r[0] for r in rows].index(None)][1]
            f = infill.Frames.of(text.encode())
            assert f.n == n and max(map(len, infill.opened(f.frames)), default=0) <= size
            for k in {0, 1, n // 2, n} & set(range(n + 1)):
                head = "".join(UNIT.findall(text)[:k])
                assert f.cut(k) == (len(head.encode()), len(head))
            if form != "plain":
                data = text.encode()
                first = len(text[:p].encode())
                writer = infill.FrameWriter()
                for chunk in infill.rearranged(f, form, first, first + len(text[p : p + m].encode())):
                    writer.write(chunk)
                assert hashlib.sha256(b"".join(infill.opened(writer.done()))).hexdigest() == out
                assert b"".join(infill.restored(writer.done(), form)) == data


def test_long_text_in_frames():
    rng = random.Random(2)
    data = b" ".join(bytes(rng.choices(b"abcdef", k=rng.randint(1, 9))) for _ in range(300_000)) + b"x" * 200_000 + b"\n"
    f = infill.Frames.of(data)
    assert f.n == 300_001 and len(f.frames) > 20
    at, chars = f.cut(150_000)
    assert at == chars == len(b" ".join(data.split(b" ")[:150_000]))
    assert b"".join(f.part(at, len(data))) == data[at:] and f.cut(f.n) == (len(data), len(data))


def test_empty_table(spark):
    assert infill.digest(infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string, h1 long, form int"))).count() == 0
