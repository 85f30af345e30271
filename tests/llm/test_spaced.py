"""Spaced and doubled letters, look-alikes and whole lattices of the noisy channel."""

import numpy as np
import pytest

from docweave.llm import toxicity


@pytest.fixture(scope="module")
def reader():
    said = ["you are a loser and a stupid moron or an idiot ", "i know a clown is a stupid loser with a letter ", "a stupid idea and a loser idea i say "]
    counts = toxicity.count_trigrams([" ".join(said * 50)], toxicity.class_table()) + 0.5
    counts = counts.reshape((toxicity.CLASSES,) * 3)
    return toxicity.Reader(-np.log(counts / counts.sum(2, keepdims=True)))


@pytest.mark.parametrize("given, wanted", [
    ("you are a l o s e r", ["a", "loser"]), ("a s t u p i d idea", ["a", "stupid"]), ("s t u p i d m o r o n", ["stupid", "moron"]),
    ("l  o  s  e  r", ["loser"]), ("l\to\ts\te\tr", ["loser"]), ("l\no\ns\ne\nr", ["loser"]), ("$ t u p 1 d", ["stupid"]), ("s t u p i d   m o r o n", ["stupid", "moron"]), ("plain words only", []),
])
def test_spaced_runs(reader, given, wanted):
    assert reader.segmented(given) == wanted
    assert set().union(*map(set, map(reader.features, wanted))) <= reader.of_runs(given)


def test_doubled_letters(reader):
    assert "idiot" in reader.spelled("iddiot") and "stupid" in reader.spelled("stuupid") and "letter" in reader.spelled("letter")


def test_letters_of_other_scripts(reader):
    assert "stupid" in reader.spelled("ѕtuріd") and "loser" in reader.spelled("lοser") and "moron" in reader.spelled("mоrоn")
    assert reader.spelled("слово") == ["слово"]


def every_path(channel, word, gaps):
    """(cost, letters) of every path through the lattice of a word or a spaced run."""
    narrow = min(gaps[1:]) if gaps else 0
    open_paths = [(0.0, 0, 0, "", "")]
    for i, c in enumerate(word):
        if gaps and i:
            wide = toxicity.WIDE_COST if gaps[i] > narrow else 0.0
            cut = [(s + channel.cost[a][b][0], b, 0, "", out + " ") for s, a, b, last, out in open_paths if b]
            open_paths = [(s + wide, *rest) for s, *rest in open_paths] + cut
        ahead = []
        for s, a, b, last, out in open_paths:
            for letter, k, own in channel.options(c):
                if not letter:
                    ahead.append((s + own, a, b, last, out))
                    continue
                ahead.append((s + own + channel.cost[a][b][k], b, k, letter, out + letter))
                if letter == last:
                    ahead.append((s + own + toxicity.REPEAT_COST, a, b, last, out))
        open_paths = ahead
    return [(s + (channel.cost[a][b][0] if b or not a else 0.0), out) for s, a, b, last, out in open_paths]


@pytest.mark.parametrize("word, gaps", [
    ("$tup1d", None), ("l.0.s.e.r", None), ("looooser", None), ("iddiiot", None), ("m*r*n", None), ("ѕtuріd", None), ("!|1", None), ("..", None), ("", None), ("é$$3", None),
    ("loser", [0, 1, 1, 1, 1]), ("astupid", [0, 1, 1, 1, 1, 1, 1]), ("al0ser", [0, 2, 1, 1, 1, 1]), ("$tup1d", [0, 1, 1, 3, 1, 1]), ("aaa", [0, 1, 1]), ("?!.", [0, 1, 1]),
])
def test_viterbi_finds_the_cheapest_of_all_paths(reader, word, gaps):
    paths = every_path(reader.channel, word, gaps)
    cost, out = reader.channel.best(word, gaps)
    least = min(s for s, _ in paths)
    assert cost == pytest.approx(least) and any(o == out and s == pytest.approx(least) for s, o in paths)
