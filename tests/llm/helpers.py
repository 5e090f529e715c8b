"""Small tables with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "b", 10),
        (3, "", "en", None, 0),
        (4, None, None, None, None),
        (5, "Écoute é ÉCOUTE", "fr", "c", 3),
        (6, "écoute é écoute", "fr", "c", 3),
        (7, "x", "en", "a", 1),
        (8, "one two", "en", "a", 1),
        (9, "long " * 4000, "en", "a", 1),
        (9, "long " * 4000, "en", "a", 1),
        (10, "mail bob@example.com or +1 (555) 123-4567, ip 10.0.0.1 card 4111 1111 1111 1111.", "en", "b", 1),
        (None, "no name", "en", "b", 1),
        (None, None, "en", "b", 1),
    ]
    words = [f"w{k}" for k in range(60)]
    base += [(20 + k, " ".join(words[:k] + [f"z{k}"] + words[k + 1 :]), "en", "a", 1) for k in range(6)]
    passage = "".join(f"passage {k} " for k in range(60))
    base += [(40 + k, f"start {k} {passage} end {k * 7}", "en", "c", 1) for k in range(3)]
    base += [(50, passage[:300] + passage[:300], "en", "c", 1), (51, "ab" * 500, "en", "c", 1)]
    return base


def documents(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", normal(text).encode())
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def linked(sets: list[frozenset], percent: int) -> list[int]:
    """Component number of each set, by comparing all pairs."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def repeated_runs(texts: list[bytes], span: int) -> list[list[list[int]]]:
    counts = Counter(b[k : k + span] for b in texts for k in range(len(b) - span + 1))
    out = []
    for b in texts:
        runs: list[list[int]] = []
        for k in range(len(b) - span + 1):
            if counts[b[k : k + span]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + span
                else:
                    runs.append([k, k + span])
        out.append(runs)
    return out


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
    )
    for kind, pattern, ok in kinds:
        for m in re.finditer(pattern, text or ""):
            if ok(m[0], re.sub("[^0-9]", "", m[0])):
                out.append((kind, m.start(), m.end()))
    return out


def by_id(df, *columns):
    found = defaultdict(list)
    for r in df.collect():
        found[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=str) for k, v in found.items()}
