import itertools
import re
from collections import Counter

from helpers import documents, nothing, rows

from quire.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"
KNOWN = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1), (9, 1, 0), (20, 1, 0), (21, None, 1), (None, 1, 1), (777, 1, 1)]
EXTRA = [(60, "A B C D " * 20, "en", "a", 1), (61, "A B C D " * 20, "en", None, 1), (59, "A B C D " * 20, "en", "", 1), (62, "plain # sign " + " ".join(f"q{k}" for k in range(70)), "en", "b", 1), (None, "x", "en", "a", 1)]


def plain(docs, known):
    """Every order walked document by document."""
    good = {i for i, q, _ in known if i is not None and q == 1}
    toxic = {i for i, _, t in known if i is not None and t == 1}
    parts = {}
    for i, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs))
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, held in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = held
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(hit)
                failing = sum(f in x[0] for x in held)
                out[part, order, step] = [len(left), len(hit), failing - len(hit), sum(x[0] == f for x in held), sum(x[1] for x in hit), sum(x[2] for x in hit)]
        for (at, order, step), x in out.items():
            if at == part:
                x.append(total[order[step - 1]])
    return out


def found(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in df.collect()}


def test_audit_equals_walking_every_order(spark):
    got = filter_audit.audit(documents(spark, EXTRA), spark.createDataFrame(KNOWN, LABELS))
    assert found(got) == plain([*rows(), *EXTRA], KNOWN)
    assert dict(got.dtypes)["shapley"] == "bigint"


def test_audit_without_rows_or_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(nothing(spark), none).count() == 0
    got = found(filter_audit.audit(documents(spark), none))
    assert len(got) == 600 * 4 and all(x[4] == x[5] == 0 for x in got.values())


def test_audit_with_clashing_columns(spark):
    odd = documents(spark)
    for c in ("part", "mask", "words", "digest", "good", "n", "n0", "__d", "id"):
        odd = odd.withColumn(c, odd["lang"])
    known = spark.createDataFrame(KNOWN, LABELS)
    assert found(filter_audit.audit(odd, known.withColumn("part", known["quality"]))) == plain(rows(), KNOWN)


def test_cells_give_back_the_counts(spark):
    held = [("p", m, m % 2, (m // 3) % 2) for m in (0, 0, 1, 5, 31, 31, 31, 16)] + [("q", 7, 0, 0)]
    got = {r["part"]: r for r in filter_audit.cells(spark.createDataFrame(held, "part string, mask int, good int, toxic int")).collect()}
    for part in "pq":
        for name, weight in (("n", lambda x: 1), ("good", lambda x: x[2]), ("toxic", lambda x: x[3])):
            assert got[part][name] == [sum(weight(x) for x in held if x[0] == part and x[1] == m) for m in range(32)]
