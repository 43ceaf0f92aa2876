import random
import re

import pytest

from quarry.llm.line_templates import drop_recurring_lines

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, depth, min_docs, min_tokens, min_const, similar):
    """Of texts that are no copies of each other: leaves, constants and templates by plain counting."""
    lines, leaves, at = [], {}, {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            w = SPACE.findall(line)
            if len(w) >= min_tokens:
                leaf = (len(w), *("*" if any(c in "0123456789" for c in x) else x for x in w[:depth]))
                lines.append((d, n, leaf, tuple(w)))
                leaves.setdefault(leaf, set()).add(d)
    lines = [x for x in lines if len(leaves[x[2]]) >= min_docs]
    distinct = {}
    for d, _, leaf, w in lines:
        distinct.setdefault((leaf, w), set()).add(d)
    for (leaf, w), ds in distinct.items():
        for p, token in enumerate(w):
            at[leaf, p, token] = at.get((leaf, p, token), 0) + len(ds)
    templates = {}
    for d, n, leaf, w in lines:
        const = tuple((p, x) for p, x in enumerate(w) if at[leaf, p, x] >= min_docs)
        if len(const) >= max(min_const, similar * len(w)):
            templates.setdefault((leaf, const), []).append((d, n))
    out = {d: set() for d, _ in docs}
    for found in templates.values():
        if len({d for d, _ in found}) >= min_docs:
            for d, n in found:
                out[d].add(n)
    return {d: sorted(x) for d, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))
    boilerplate = ["Page {} of {}", "Copyright {} Example Inc. All rights reserved.", "posted by {} at {} in general", "share this with friends", "short"]
    docs = []
    for d in range(80):
        lines = [made(rng.randint(20, 30)) for _ in range(4)]
        lines += [b.format(rng.randrange(10**5), rng.randrange(10**5)) for b in boilerplate if rng.random() < rng.choice([0.1, 0.6])]
        rng.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    options = dict(depth=2, min_docs=8, min_tokens=3, min_const=2, similar=0.5)
    got = drop_recurring_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    want = brute(docs, **options)
    assert sum(map(len, want.values())) > 40
    texts = dict(docs)
    for r in got:
        assert (r["dropped"] or []) == want[r["doc_id"]] and r["n_dropped"] == len(want[r["doc_id"]])
        assert r["text"] == "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if n not in want[r["doc_id"]])
        assert r["n_lines"] == texts[r["doc_id"]].count("\n") + 1


def unrelated(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


@pytest.mark.parametrize("n", [100, 1200])
def test_templates_do_not_fade_as_the_corpus_grows(spark, n):
    rng = random.Random(5)
    months = "January February March April May June July August September October November December".split()
    posted = lambda: f"Posted on the {rng.randint(1, 28)} {rng.choice(months)} {rng.randint(2010, 2024)} in our news section"
    docs = [(d, f"{unrelated(rng, 30)}\n{posted()}\n{unrelated(rng, 25)}") for d in range(n)]
    got = drop_recurring_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == n and all(r["dropped"] == [1] for r in got)


@pytest.mark.parametrize(("n", "own"), [(50, 20), (400, 10)])
def test_a_shared_passage_does_not_make_texts_copies(spark, n, own):
    rng = random.Random(6)
    passage = unrelated(rng, 60)
    docs = [(d, f"{unrelated(rng, own)}\n{passage}") for d in range(n)]
    got = drop_recurring_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == n and all(r["dropped"] == [1] for r in got)


@pytest.mark.parametrize("others", [0, 40])
def test_a_group_of_near_copies_saves_no_line_of_others(spark, others):
    rng = random.Random(7)
    base = unrelated(rng, 300).split()

    def copy():
        words = list(base)
        for at in rng.sample(range(300), 4):
            words[at] = unrelated(rng, 1)
        return "\n".join(" ".join(words[i : i + 50]) for i in range(0, 300, 50))

    footer = "\nSubscribe to our newsletter today"
    docs = [(d, copy() + footer) for d in range(500)] + [(1000 + d, unrelated(rng, 60) + footer) for d in range(others)]
    got = drop_recurring_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 500 + others
    for r in got:
        assert r["dropped"] == ([r["n_lines"] - 1] if others else None)


def test_lines_of_copies_stay(spark):
    body = "\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(5))
    copies = [(i, body) for i in range(60)] + [(100 + i, body + f"\nlast line of copy {i} here") for i in range(40)]
    other = [(200 + i, " ".join(f"x{i}y{j}" for j in range(40)) + "\nSubscribe to our newsletter today") for i in range(30)]
    got = drop_recurring_lines(spark, spark.createDataFrame(copies + other, "doc_id long, text string")).collect()
    assert all(r["n_dropped"] == 0 for r in got if r["doc_id"] < 200)
    assert all(r["n_dropped"] == 1 and "newsletter" not in r["text"] for r in got if r["doc_id"] >= 200)


def test_awkward(spark, awkward, nothing):
    got = drop_recurring_lines(spark, awkward, min_docs=2).collect()
    assert len(got) == 10 and [(r["n_lines"], r["text"]) for r in got if r["doc_id"] == 1] == [(0, None)]
    assert [(r["n_lines"], r["text"]) for r in got if r["doc_id"] == 2] == [(1, "")]
    assert drop_recurring_lines(spark, nothing).isEmpty()
