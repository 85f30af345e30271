"""Near copies by shingle similarity, against brute force."""

import random
from itertools import combinations

import corpus_pipeline
from docweave.llm import near, simhash


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, texts = prose(12), []
    for i in range(25):
        base = prose(rng.choice([6, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 80)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + prose(rng.choice([0, 0, 2, 9]))))
        texts.append(" ".join(line + prose(25)))
    # One shingle of most of the text, and the same with other words around.
    texts += ["x " * 300 + " ".join(prose(40)) for _ in range(3)]
    texts += [texts[0], texts[1].upper(), None, "", " \n", "one two", "One  two", "one two three"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[2], "en", "s", 1), (3, texts[3], "en", "s", 1)]

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(label))
    assert len(set(label)) < 0.75 * len(texts)


def test_each_pair_comes_by_its_route(spark, monkeypatch):
    """Without the links of fingerprints the copies within their distance stay, and those alone; without rare shingles the others."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts, copies = [], {True: set(), False: set()}
    for close in [True, False] * 6:
        while True:
            base = [rng.choice(vocabulary) for _ in range(300)]
            other = list(base)
            for _ in range(1 if close else 6):
                other[rng.randrange(300)] = rng.choice(vocabulary)
            pair = [" ".join(base), " ".join(other)]
            a, b = map(shingles, pair)
            bits = int.bit_count(int(simhash.fingerprint_of([pair[0].encode()], 5)[0] ^ simhash.fingerprint_of([pair[1].encode()], 5)[0]))
            if 5 * len(a & b) >= 4 * len(a | b) and (0 < bits <= near.DISTANCE if close else bits > near.DISTANCE):
                break
        copies[close].add(len(texts) + 1)
        texts += pair
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = set(range(0, len(texts), 2))
    kept = lambda: {r["doc_id"] for r in near.one_of_each(docs).collect()}
    assert kept() == first
    links, cells = simhash.links, near._cells
    with monkeypatch.context() as without:
        without.setattr(simhash, "links", lambda *given: links(*given).where("false"))
        assert kept() == first | copies[True]
    with monkeypatch.context() as without:
        without.setattr(near, "_cells", lambda classes: near.stored(cells(classes).where("false"), "cells"))
        assert kept() == first | copies[False]


def test_large_components_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(near, "TOGETHER", 2)
    test_edited_copies_against_brute_force(spark)
