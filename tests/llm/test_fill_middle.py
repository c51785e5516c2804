"""Fill-in-the-middle against plain Python; frames against whole texts."""

import hashlib
import random
import re

import zstandard

from presage.llm import fill_middle

LINE = re.compile(r"[^\n]*\n|[^\n]+")
unzip = zstandard.ZstdDecompressor().decompress


def plain(doc_id, text, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = LINE.findall(text)
    h = [int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "\n", "a", "a\nb", "\n\n\n", "no <M> here", "<P", "x<\nP>\n<", "é\nü\r\n日本", "a\n" * 9000 + "é" * 200_000 + "\n" + "b", "long line " * 40_000, "same\ntext\n", "same\ntext\n"]


def test_rows(spark):
    rows = [(i, t, "form", 3) for i, t in enumerate(ODD)] + [(None, "x\ny\nz", "f", 1), (3, "a", "f", 1), (3, "a", "f", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for rate, spm in ((100, 50), (60, 0), (0, 50)):
        out = fill_middle.transform(table, rate=rate, spm=spm)
        want = sorted(((d, *plain(d, t, rate, spm)) for d, t, *_ in rows), key=repr)
        assert sorted((tuple(r) for r in fill_middle.texts(out).collect()), key=repr) == want
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        texts = sorted(((d, *plain(d, t, rate, spm)[:4], sha(plain(d, t, rate, spm)[4]), sha(t or "")) for d, t, *_ in rows), key=repr)
        assert sorted((tuple(r) for r in fill_middle.digests(out).collect()), key=repr) == texts
    assert fill_middle.digests(fill_middle.transform(table.limit(0))).count() == 0


def test_frames_of_any_size():
    """Cuts, marks and copies over frame borders give what the whole text gives."""
    dice = random.Random(4)
    for size in (1, 4, 7, 64, 1000):
        for _ in range(60):
            text = "".join(dice.choice(["\n", "a", "é", "日", "<", "P", ">", "<M>"]) for _ in range(dice.randint(0, 200)))
            data, writer = text.encode(), fill_middle.Writer(max(4, size))
            writer.put(data)
            reader = fill_middle.Reader(writer.done(), unzip)
            units = LINE.findall(text)
            assert reader.lines() == len(units) and b"".join(reader.stream(0, reader.size)) == data
            for u in range(len(units) + 1):
                before = "".join(units[:u])
                assert reader.after(u) == (len(before.encode()), len(before))
            start = dice.randint(0, len(data))
            assert reader.find(b"<M>", start) == data.find(b"<M>", start)
            stop = dice.randint(start, len(data))
            assert b"".join(reader.stream(start, stop)) == data[start:stop]


def test_only_cut_frames_are_opened():
    """A cut opens the frame it falls into; frames between the cuts go over closed."""
    opened = []
    writer = fill_middle.Writer()
    writer.put(b"".join(b"line %09d of a text that is long enough\n" % i for i in range(40_000)))
    frames = writer.done()
    reader = fill_middle.Reader(frames, lambda data: opened.append(data) or unzip(data))
    cut, _ = reader.after(20_000)
    assert len(opened) == 1 and len(frames) > 10
    opened.clear()
    to = fill_middle.Writer()
    reader.copy(0, cut, to)
    assert len(opened) == 1
    assert b"".join(fill_middle.Reader(to.done(), unzip).stream(0, cut)) == b"".join(reader.stream(0, cut))
