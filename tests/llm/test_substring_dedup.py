import hashlib
import random

import pytest

from quarry.llm import substring_dedup
from quarry.llm.common import Work
from quarry.llm.substring_dedup import every_position, remove_repeats


def brute(docs, n):
    """One result a row; rows without an id are one document, after all others."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            g = b[k : k + n]
            first[g] = min(first.get(g, order(i)), order(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < order(i):
                gone[k : k + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def corpus(seed, alphabet, size=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 160))) for _ in range(12)]
    docs = ["".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(alphabet) * rng.randint(1, 70) for _ in range(rng.randint(0, 9))) for _ in range(size)]
    docs += docs[:5] + [None, "", "a" * 400, "a" * 399, "ab" * 200, "é" * 100]
    return list(enumerate(docs))


@pytest.mark.parametrize(
    ("seed", "alphabet", "length", "hot"), [(1, "ab", 50, 20000), (2, "abcdefgh ", 50, 20000), (3, "aé字", 50, 5), (4, "ab ", 17, 3), (5, "abc", 8, 20000), (6, "abcdefgh ", 50, 0), (7, "abcd", 50, 4)]
)
def test_against_brute_force(spark, seed, alphabet, length, hot):
    docs = corpus(seed, alphabet)
    df = remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string"), length=length, row_bytes=150, hot_texts=hot)
    assert rows(df) == brute(docs, length)


@pytest.mark.parametrize("hot", [20000, 2])
def test_ids_that_repeat_or_lack(spark, hot):
    """Rows of one id with several texts, equal rows many times, no id: with texts that others share."""
    docs = corpus(8, "abcdefgh ")
    docs += [(7, docs[3][1]), (7, docs[9][1]), (7, docs[40][1])] + [(12, docs[12][1])] * 30
    docs += [(None, docs[20][1]), (None, docs[21][1]), (None, docs[2][1] + docs[30][1])] + [(None, "of its own " + docs[1][1][:20] * 9)] * 30
    df = remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), row_bytes=150, hot_texts=hot)
    assert rows(df) == brute(docs, 50)


def test_every_position_agrees(spark):
    docs = corpus(9, "abcdefgh ", 25)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks: dict[int, set[int]] = {}
    for r in every_position(spark, df).collect():
        marks.setdefault(r["doc_id"], set()).update(range(r["pos"], r["pos"] + 50))
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark, df, row_bytes=150).collect()}
    assert {i: n for i, n in got.items() if n} == {i: len(m) for i, m in marks.items()}


def test_rows_grow_with_the_input(spark, monkeypatch):
    """Four times the text makes four times the rows in every step, however dense the repeats are."""
    seen = {}

    class Counted(Work):
        def write(self, df, name):
            out = super().write(df, name)
            seen[name] = out.count()
            return out

    monkeypatch.setattr(substring_dedup, "Work", Counted)
    counts = []
    base = [t for _, t in corpus(10, "abcdefgh ", 120) if t]
    for times in (1, 4):
        docs = [(i * len(base) + j, f"{i} {t[: len(t) // 2]} {i} {t[len(t) // 2 :]}") for i in range(2 * times) for j, t in enumerate(base)]
        size = sum(len(t.encode()) for _, t in docs)
        remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string"), row_bytes=512).collect()
        counts.append((size, dict(seen)))
    (small, a), (large, b) = counts
    assert a["found"] > 20 and a["shared"] > 20
    for name in ("shared", "found", "done"):
        assert b[name] / a[name] <= 1.05 * large / small, name


def test_kept_bytes_and_awkward(spark, awkward, nothing):
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"], len(r["kept"])) for r in remove_repeats(spark, awkward, with_text=True).collect())
    assert len(got) == 10 and all(b - n == k for _, b, n, k in got)
    by = {d: n for d, _, n, _ in got}
    assert by[6] > 100_000 and by[5] == by[4] == by[8] == 0
    assert remove_repeats(spark, nothing).isEmpty()
