"""Restoring of obfuscated words: the short ways give what the whole lattice gives."""

import numpy as np

from tallysheet.llm import toxicity as T


def lattice(token: str, flat: list[float]) -> str:
    """The best path over all states, character by character."""
    paths, before = {0: (0.0, "")}, ""
    for c in token:
        choices, before, after = T.CHOICES[c, c == before], c, {}
        for state, (value, text) in paths.items():
            for number, cost, x in choices:
                to = state if number < 0 else state % T.LETTERS * T.LETTERS + number
                found = value - cost if number < 0 else value - cost + flat[state * T.LETTERS + number]
                if to not in after or found > after[to][0]:
                    after[to] = (found, text + x)
        paths = after
    return max((value + flat[state * T.LETTERS], text) for state, (value, text) in paths.items())[1]


def test_decoding_and_candidates():
    rng = np.random.default_rng(3)
    model = T.log_model(rng.integers(0, 50, T.LETTERS**3).astype(float))
    flat, runs = model.ravel().tolist(), {}
    whole = ["badword", "addle", "adle", "abba", "abe", "been", "é"]
    reader = T.Reader({f"={w}": 1.0 for w in whole} | {"badw": 2.0}, model)
    tokens = ["".join(rng.choice(list("abdeéow*$1!"), rng.integers(1, 9))) for _ in range(1500)] + ["badw*rd", "b**n", "ad*dle", "ab*be", "abbb*", "*", "be3n$$$"]
    for token in tokens:
        assert T.decoded(token, flat, runs) == lattice(token, flat), token
        if T.plain(token):
            assert lattice(token, flat) == token
        if reader.readings(token) & set(whole):
            assert reader.may_be_whole(token), token


def test_letters_that_no_word_has_together_are_not_decoded():
    reader = T.Reader({"=badword": 1.0, "=bone": 1.0}, T.log_model(np.ones(T.LETTERS**3)))
    assert reader.may_be_whole("bad***ord") and reader.may_be_whole("b*ne")
    # begins and ends like words, but like no single one; has more letters than any; has letters that none has together
    assert not reader.may_be_whole("ba***ne") and not reader.may_be_whole("b***ne$$$words***") and not reader.may_be_whole("b*ordw***")


def test_pieces_are_those_of_the_pattern():
    text = "a_b c__d* _ ²x½ 3é_4 $$_$ é|_\u0301b i\u0307 ٣a_"
    assert T.pieces_of(text) == T.PIECE.findall(text)
