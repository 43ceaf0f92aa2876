import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm.repetition import longest_repeats, repetition_rules


def brute(text, min_words):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)

    def covered(k):
        c = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = max((k for k in range(1, n) if len({tuple(w[i : i + k]) for i in range(n - k + 1)}) < n - k + 1), default=0)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, covered(3), covered(min_words), longest


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        words = [rng.choice(["a", "b", "ç#", "d|e", "字"]) if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))]
        docs.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in words)))
    docs += [(60, None), (61, ""), (62, " \n\n "), (63, "x " * 130), (64, "x y\nx y\n x y\n\n")]
    df = repetition_rules(spark, spark.createDataFrame(docs, "doc_id long, text string"), min_words=4)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    got = {r["doc_id"]: r for r in df.collect()}
    for i, t in docs:
        want = brute(t, 4)
        assert tuple(got[i][c] for c in names) == want, i
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_suffix_array_of_many_texts():
    rng = np.random.default_rng(3)
    of = np.sort(rng.integers(0, 6, 200))
    h = rng.integers(0, 3, 200).astype(np.uint64)
    got = longest_repeats(h, of)
    for d in range(6):
        w = h[of == d].tolist()
        for i in range(len(w)):
            want = max((k for k in range(1, len(w) - i + 1) if any(w[j : j + k] == w[i : i + k] for j in range(len(w) - k + 1) if j != i)), default=0)
            assert got[of == d][i] == want


def test_verdicts(spark, awkward, nothing):
    unique = " ".join(f"w{i}" for i in range(300))
    rows = [(1, unique), (2, unique + " " + " ".join(f"w{i}" for i in range(70))), (3, unique + "\n" + "spam again and again today friends of mine\n" * 20), (4, "short")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition_rules(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False)}
    assert repetition_rules(spark, awkward).count() == 10 and repetition_rules(spark, nothing).isEmpty()
