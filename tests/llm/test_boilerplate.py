"""Boilerplate phrases in long lines, and documents of boilerplate alone."""

import pytest

from epochloom.llm import quality_rules

PROSE = [" ".join(f"{w}{n}" for w in ("rivers", "rose", "again", "while", "villages", "moved", "boats", "uphill")) + "." for n in range(40)]


@pytest.mark.parametrize("phrase", ["Click here.", "See the terms of use.", "This is licensed under MIT.", "© 2024 Someone."])
def test_long_lines_lose_only_the_sentence(phrase):
    lines = [*PROSE[:20], phrase, *PROSE[20:]]
    got = quality_rules.judge(" ".join(lines))
    assert got["kept"] and got["n_words_lost"] == len(phrase.split())
    assert got["clean_text"] == " ".join(PROSE)


def test_long_sentences_and_unended_lines_stay():
    long = "She read the terms of use of the old lending library aloud to the whole village while the rain went on and on outside."
    assert quality_rules.judge(long)["clean_text"] == long
    unended = " ".join(f"word{i}" for i in range(200)) + " click here " + " ".join(f"term{i}" for i in range(200))
    assert quality_rules.judge(unended)["clean_text"] == unended


def test_short_lines_go_and_nothing_left_is_rejected():
    text = PROSE[0] + " Then it was over.\nReleased under the MIT License."
    assert quality_rules.judge(text)["clean_text"] == PROSE[0] + " Then it was over."
    bare = quality_rules.judge("This page is licensed under the general public licence of its author, version three.")
    assert bare["clean_text"] == "" and not bare["kept"]
    many = "Subscribe to our monthly letter about old boats. Click here for tea or cod. Follow us on every known network, reader. All rights reserved by nobody."
    assert not quality_rules.judge(many)["base_failed"] and not quality_rules.judge(many)["kept"]


def test_documents_that_lose_nearly_all_go():
    lines = [f"Privacy policy of the site number {n} and its many partners, all rights reserved." for n in range(60)]
    got = quality_rules.judge("\n".join([*lines, PROSE[0]]))
    assert not got["kept"] and got["n_words_lost"] == got["n_words"] - 8 == 60 * 14
    licence = quality_rules.judge("\n".join([PROSE[0], PROSE[1], "Licensed under the MIT License."]))
    assert licence["kept"] and licence["n_words_lost"] == 5 and licence["clean_text"] == "\n".join(PROSE[:2])
    short = quality_rules.judge("Only nine good words are left in this text.\nmenu | home | about | shop")
    assert not short["base_failed"] and not short["kept"]


def test_pipeline_keeps_one_line_documents(spark):
    texts = [" ".join(["You may click here.", *PROSE[i : i + 10]]) for i in (0, 10, 20)] + ["All rights reserved by the many owners of this old page."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.clean_documents(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {i: " ".join(PROSE[10 * i : 10 * i + 10]) for i in range(3)}
    assert all(r.n_chars == len(r.text) for r in got.values())
