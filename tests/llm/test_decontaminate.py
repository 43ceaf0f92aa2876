import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.decontaminate import FMIndex, contamination, suffix_array, without_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c3", "dé", "E"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(25)] + [(99, None)]
    items += [(50, ",".join(word() for _ in range(60)))] + [(51, items[3][1]), (3, items[4][1])] + [items[5]] * 30
    docs = [(d, rng.choice([" ", "-", "\n"]).join(word() if rng.random() < 0.9 else "zz" for _ in range(rng.randint(0, 300)))) for d in range(30)] + [(98, None)]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "piece"), [(1, 8 << 20, 4096), (2, 8 << 20, 3), (3, 400, 5)])
def test_against_brute_force(spark, seed, block, piece):
    docs, items = case(seed)
    df = contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=8, block_bytes=block, piece=piece)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in df.collect()}
    assert got == brute(docs, items, 8)


def test_blocks_do_not_show_in_the_result(spark):
    docs, items = case(4)
    docs += [(None, "one text without an id"), (None, docs[0][1]), docs[1], docs[1], (docs[2][0], docs[3][1] + " other")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")), spark.createDataFrame(items, "item_id long, text string")
    once, often = (
        sorted(repr((r["doc_id"], r["text"], r["lang"], r["n_words"], r["n_hit"], r["word_spans"], r["byte_spans"], sorted(r["items"]))) for r in contamination(spark, docs, items, block_bytes=b, columns=("lang", "text")).collect())
        for b in (8 << 20, 400)
    )
    assert len(once) == 36 and once == often


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 300):
        seq = np.append(rng.integers(0, 4, size), 0)
        order = suffix_array(seq)
        assert sorted(order) == list(range(size + 1))
        words = rng.integers(1, 4, (40, 3))
        length = rng.integers(1, 4, 40)
        words[np.arange(3) < 3 - length[:, None]] = 0
        which, at = FMIndex(seq, sample=4).search(words, length)
        want = [(i, p) for i in range(40) for p in range(size + 2 - length[i]) if list(seq[p : p + length[i]]) == list(words[i, 3 - length[i] :])]
        assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == want


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Ä keep. ONE two, three four! keep ß"), (2, None), (3, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "two three four"), (6, "one two three")], "item_id long, text string")
    df = contamination(spark, docs, items, width=3, columns=("text",)).withColumn("cut", without_spans(F.col("text"), F.col("byte_spans")))
    assert [(r["doc_id"], r["cut"], r["n_hit"]) for r in df.orderBy("doc_id").collect()] == [(1, "Ä keep. ! keep ß", 4), (2, None, 0), (3, "", 3)]


def test_awkward_and_nothing(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(None, "one two"), (1, None), (2, ""), (3, "one two")], "item_id long, text string")
    assert contamination(spark, awkward, none).agg({"n_hit": "sum"}).first()[0] == 0
    got = [r for r in contamination(spark, awkward, odd).collect() if r["n_hit"]]
    assert [(r["doc_id"], r["items"]) for r in got] == [(4, [3]), (4, [3])]
    assert contamination(spark, nothing, odd).isEmpty()
