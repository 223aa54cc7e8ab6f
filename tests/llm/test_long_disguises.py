"""Disguised words of any length and any separators are decoded, and what is
scored is the restored text."""

import itertools
import random

import numpy as np
import pytest

from epochloom.llm import toxicity


def model(*words):
    """A model whose language is some words, the last one an insult."""
    s = toxicity.Settings()
    counts = np.bincount(toxicity.gram_codes([" ".join(words)] * 300), minlength=toxicity.N_GRAMS)
    return toxicity.Model(s, toxicity.gram_costs(counts), {f: 5.0 for f in toxicity.features_of(words[-1], s)}, (-2.0, 1.0, 0.0))


def test_long_spaced_runs_are_scored_as_restored():
    phrase = "idiotsareeverywherearoundhere"
    scorer = toxicity.Scorer(model("well", "then", phrase))
    text = "well " + " ".join(phrase) + " then"
    assert toxicity.restored_text(text, scorer.reader.decoder) == f"well {phrase} then"
    assert scorer.score(text) == scorer.score(f"well {phrase} then") > scorer.score("well then")


@pytest.mark.parametrize("run", ["i d i o t", "i  d  i  o  t", "i\td\ti\to\tt", "i-d-i-o-t", "i. d. i. o. t", "1 d 1 0 t", "y o u i d i o t", "y o u   i d i o t", "you.are.an.idiot"])
def test_separators(run):
    scorer = toxicity.Scorer(model("you", "are", "an", "idiot"))
    assert "idiot" in toxicity.restored_text(f"oh {run} oh", scorer.reader.decoder).split()
    assert scorer.score(f"oh {run} oh") > 0.9


@pytest.mark.parametrize("text", ["i d i o t!", "i d i o t.", "i d i o t, you", "(i d i o t)", '"i d i o t"', "you: i-d-i-o-t?", "«i d i o t»", "[i. d. i. o. t]", "you...i d i o t...", "'1 d 1 0 t'"])
def test_marks_beside_letters_set_apart(text):
    scorer = toxicity.Scorer(model("you", "are", "an", "idiot"))
    words = [w for t in scorer.reader.tokens(text) for w in scorer.reader.bare(t)]
    assert "idiot" in words and scorer.score(text) > 0.9
    assert "idiot" in [w.strip(toxicity._STRIP) for w in toxicity.restored_text(text, scorer.reader.decoder).split()]


def test_letters_of_words_are_no_run():
    for text in ("plan a b", "x1 y2 z3", "sh i t", "a b ctr", "1 2 3 4"):
        assert not toxicity.spaced_runs(text)


def test_stretched_and_long_tokens():
    scorer = toxicity.Scorer(model("on", "and", "stupid"))
    assert "stupid" in scorer.reader.bare("st" + "u" * 80 + "pid") and "stupid" in scorer.reader.bare("s" * 60 + "tupid")
    token = "stup1d" + "-and-on" * 20
    fixed = toxicity.restore(token, scorer.reader.decoder)
    assert fixed == scorer.reader.decoder.decode(token) and fixed.startswith("stupid")
    assert scorer.score(token) > scorer.score("on")


def test_very_long_token():
    decoder = toxicity.Decoder(model("stupid").costs)
    assert toxicity.restore("stup1d" + "." * 200_000 + "x", decoder).startswith("stupid")


def test_viterbi_finds_the_cheapest_of_all_readings():
    """Against every way through the lattice of short words."""
    decoder = toxicity.Decoder(model("you", "are", "an", "idiot").costs)
    rnd = random.Random(2)
    for _ in range(150):
        word = "".join(rnd.choice("aidoty1043.- !$") for _ in range(rnd.randint(1, 7)))
        best = None
        for way in itertools.product(*(decoder.options(word, i) for i in range(len(word)))):
            state, cost = 0, 0.0
            for x, c in way:
                cost += c
                if x:
                    at = state * toxicity.SYMBOLS + int(toxicity._FOLD[min(ord(x), 0x250)])
                    cost, state = cost + decoder.costs[at], at % (toxicity.N_GRAMS // toxicity.SYMBOLS)
            cost += decoder.costs[state * toxicity.SYMBOLS]
            best = cost if best is None else min(best, cost)
        said = decoder.decode(word)
        # the reading's own cheapest way costs as much as the best one
        mine = min(
            sum(c for _, c in way)
            for way in itertools.product(*(decoder.options(word, i) for i in range(len(word))))
            if "".join(x for x, _ in way) == said
        )
        state = 0
        for x in said:
            at = state * toxicity.SYMBOLS + int(toxicity._FOLD[min(ord(x), 0x250)])
            mine, state = mine + decoder.costs[at], at % (toxicity.N_GRAMS // toxicity.SYMBOLS)
        assert mine + decoder.costs[state * toxicity.SYMBOLS] == pytest.approx(best)


def test_words_are_those_of_the_restored_text():
    scorer = toxicity.Scorer(model("you", "are", "an", "idiot"))
    rnd = random.Random(4)
    for _ in range(200):
        text = " ".join(rnd.choice(["You", "i d i o t", "1d10t!", "A.", "an", "y o u", "(idioot)", "x-y", "b"]) for _ in range(6))
        words = {w for t in scorer.reader.tokens(text) for w in scorer.reader.bare(t)}
        assert words == {w for w in (x.strip(toxicity._STRIP) for x in toxicity.restored_text(text, scorer.reader.decoder).split()) if w}


def test_ties_and_repeats_in_the_fit(spark):
    """Labels twice, with both values, and for rows that come twice."""
    docs = spark.createDataFrame([(i % 40, "you are an idiot" if i % 2 else "you are an author") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 80 and all(r.predicted == r.doc_id % 2 for r in got)
