import random
import re

import pytest

from quarry.llm import near_dedup
from quarry.llm.common import Work
from quarry.llm.near_dedup import least_matches, near_duplicates


def brute(docs, n, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, size=14, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"small": 2, "block": 4}), (3, {"small": 1, "block": 3, "most": 0})])
def test_components(spark, seed, options):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), shingle=4, **options).collect()}
    assert got == brute(docs, 4)


def test_one_band_for_unlike_texts(spark, monkeypatch):
    """A bucket of many texts without a link among most of them: all pairs give the same, and rows stay in proportion."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(60))
    own = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(60))
    rows, docs = {}, []
    for i in range(240):
        text = f"{common} {own()}"
        docs += [text, f"{text} x"] if i % 40 == 0 else [text]
    docs = list(enumerate(docs))

    class Counted(Work):
        def write(self, df, name):
            out = super().write(df, name)
            rows[name] = out.count()
            return out

    monkeypatch.setattr(near_dedup, "Work", Counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), shingle=4, rows=1, small=8).collect()}
    assert got == brute(docs, 4)
    assert rows["left-0"] > 240 and max(n for name, n in rows.items() if name not in ("candidates", "left-0", "left-1")) < 4 * len(docs)


def test_ids_that_repeat(spark):
    """Each row counts by its own text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(1, a), (2, b), (2, a + " z"), (3, c), (3, b + " z"), (2, b), (4, c)]
    for parts in (1, 5):
        out = near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), shingle=4)
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect())
        assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (3, 3, True), (4, 3, False)]


def test_awkward(spark, awkward):
    got = {(r["doc_id"], r["n_shingles"] > 0): r for r in near_duplicates(spark, awkward).collect()}
    assert got[5, True]["component_id"] == got[6, True]["component_id"] == 5 and not got[6, True]["kept"]
    assert got[1, False]["kept"] and got[2, False]["component_id"] == 2
    assert got[None, True]["component_id"] is None and got[None, True]["kept"]
    assert got[4, True]["n_shingles"] == 1 and got[8, True]["n_shingles"] == 3


def test_nothing(spark, nothing):
    assert near_duplicates(spark, nothing).isEmpty()


def test_pruning_bound():
    assert least_matches(0.8, 30, 1e-6) < least_matches(0.8, 30, 1e-2) <= 24
    assert least_matches(0.8, 150, 1e-6) > 5 * least_matches(0.8, 30, 1e-6) - 30
