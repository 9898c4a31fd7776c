"""Toxic terms behind byte 40 of an unbroken run are seen in fit and in score."""

import random

from pickwise.llm import toxicity


def test_toxic_term_behind_a_long_run():
    rng = random.Random(4)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    texts = [run(40) + ("笨蛋" if i % 3 == 0 else "") + run(5) for i in range(300)]
    score = toxicity.fit_texts(texts, [int(i % 3 == 0) for i in range(300)]).scorer()
    assert min(score(run(30) + "笨蛋" + run(30)) for _ in range(20)) > 0.5 > max(score(run(62)) for _ in range(20))
    words = [" ".join(rng.choices("day long talk work home food".split(), k=8)) + (" stupididiot" if i % 3 == 0 else "") for i in range(300)]
    score = toxicity.fit_texts(words, [int(i % 3 == 0) for i in range(300)]).scorer()
    assert score("daylongtalkwork" * 5000 + "stupididiot" + "homefood" * 9) > 0.5 > score("daylongtalkwork" * 5000)


def test_short_words_have_the_same_pieces():
    assert set(toxicity.word_pieces(b"idiots")) == {b"^idiots$", b"^idi", b"^idio", b"^idiot", b"^idiots", b"iots$", b"idiot", b"diots"}
    assert set(toxicity.word_pieces(b"a")) == {b"^a$"}
