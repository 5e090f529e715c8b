import random

import pytest
from helpers import documents, nothing, rows, sha

from quire.llm import fingerprints as fp

FULL = (1 << 64) - 1


def mixed(x):
    return int(fp.mix64(fp.np.array([x], fp.np.uint64))[0])


def plain(text: bytes) -> str:
    """The fingerprint byte by byte."""
    byte = [int(x) for x in fp._BYTE]
    ones = []
    for i in range(len(text)):
        h = 0
        for b in text[max(0, i - 7) : i + 1]:
            h = (h * fp._ROLL + byte[b]) & FULL
        h, n = mixed(h), 0
        while i >= 7 and h >> n & 1:
            n += 1
        ones.append(n)
    k = 0
    while 64 << k < len(text):
        k += 1
    while k and sum(x >= k for x in ones) + 1 < 32:
        k -= 1

    def signature(level):
        out, chunk = "", b""
        for i, b in enumerate(text):
            chunk += bytes([b])
            if i + 1 == len(text) or (ones[i] >= level and len(out) < 63):
                total = sum(byte[c] * pow(fp._CHUNK, j, 1 << 64) for j, c in enumerate(chunk)) & FULL
                out, chunk = out + chr(fp.LETTERS[mixed(total) >> 58]), b""
        return out

    return ":".join([str(1 << k), *(signature(k + j) for j in range(3))])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    one, two = ({int(x.split(":")[0]) << j: s for j, s in enumerate(x.split(":")[1:])} for x in (a, b))
    for size in sorted(one):
        if size in two:
            x, y = one[size], two[size]
            run = min(4, len(x), len(y))
            near = run and any(x[k : k + run] in y for k in range(len(x) - run + 1))
            return 1 - distance(x, y) / max(len(x), len(y)) if near else 0.0
    return 0.0


def told(docs):
    """Each document beside its next in descending order of id."""
    held = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    out = []
    for (i, text, *_), (_, after, *_) in zip(held, held[1:] + held[:1], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        marks = [plain(x.encode()) for x in (text, new, after)]
        out.append((i, len(text), sha(new), marks[0], marks[1], likeness(marks[0], marks[1]), likeness(marks[0], marks[2])))
    return out


def found(df):
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert df.columns == list(columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé日") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_fingerprints_equal_the_plain_version():
    r = random.Random(4)
    texts = [b"", b"a", b"abcdefg", b"ab" * 300, b"long " * 800, bytes(range(256)) * 2, *(words(k, r.randint(1, 200)).encode() for k in range(25))]
    r.shuffle(texts)
    assert fp.fingerprints_of(texts) == [plain(t) for t in texts]


def test_long_texts_are_worked_in_segments(monkeypatch):
    texts = [words(k, 300).encode() for k in range(4)]
    want = fp.fingerprints_of(texts)
    monkeypatch.setattr(fp, "SEGMENT", 64)
    monkeypatch.setattr(fp, "_WEIGHTS", fp._WEIGHTS[:64])
    monkeypatch.setattr(fp, "_UNWEIGHTS", fp._UNWEIGHTS[:64])
    assert fp.fingerprints_of(texts) == want


def test_edit_distance():
    r = random.Random(2)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 66))) for _ in range(2))
        assert fp.edit_distance(a, b) == distance(a, b)


@pytest.mark.parametrize("ranges", ["1", "4", "40"])
def test_edited_texts(spark, ranges):
    docs = [d for d in rows() if d[0] is not None] + [(None, "no name", "en", "b", 1)]
    docs += [(k, words(k, 20 + k % 60), "en", "a", 1) for k in range(100, 140)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = found(fp.edited(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(told(docs), key=str)
    near = [r[5] for r in got if r[1] > 200]
    assert sum(x >= 0.4 for x in near) > 0.9 * len(near)


def test_odd_tables(spark):
    assert fp.edited(nothing(spark)).count() == 0
    one = [(7, "just this one text", "en", "a", 1)]
    assert found(fp.edited(spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long"))) == told(one)
    odd = documents(spark)
    for c in ("part", "first", "last", "after", "place", "h", "sha", "fingerprint"):
        odd = odd.withColumn(c, odd["lang"])
    got = found(fp.edited(odd))
    assert len(got) == len(rows()) and [r for r in got if r[0] == 41] == [r for r in told([d for d in rows() if d[0]]) if r[0] == 41]
    equal = {}
    for r in fp.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        equal.setdefault(r["text"], set()).add(r["fingerprint"])
    assert len(equal["long " * 4000]) == 1
