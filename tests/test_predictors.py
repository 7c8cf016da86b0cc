"""Sequential models: exact round trips, probabilities that add up, gradients against differences."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions import predictor, recurrent
from quillstone.functions.text import causal_bits

TEXT = b"the cat sat on the mat; the cat ate the rat. " * 12


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=60) | st.lists(st.sampled_from([b"ab", b"the ", b"\xff", b"\0"]), max_size=20).map(b"".join))
def test_coding_comes_back(raw):
    code = predictor.encode(raw)
    assert predictor.decode(code, len(raw)) == raw and len(code) <= predictor.coded_bits(raw) / 8 + 8 + len(raw) / 50


def test_mixing_beats_its_parts():
    bits = predictor.coded_bits(TEXT)
    assert bits < min(causal_bits(TEXT.decode(), k)[1].sum() for k in (0, 1, 2)) and predictor.coded_bits(b"") == 0.0
    assert predictor.coded_bits(TEXT[:90], pretraining=TEXT) < 0.3 * predictor.coded_bits(TEXT[:90])
    assert predictor.decode(predictor.encode(TEXT, b"the cat "), len(TEXT), b"the cat ") == TEXT


def test_counters_are_running_means():
    c = predictor.Counters()
    bits = [1, 0, 0, 1, 1, 1, 0]
    for n, b in enumerate(bits):
        p = c.predict("x")
        assert p is None if n == 0 else abs(p - (0.25 + sum(bits[:n])) / (n + 0.5)) < 1e-12
        c.learn(b)


def test_a_match_follows_the_latest_place():
    m, past = predictor.Match(), bytearray()
    for b in b"abcdeXabcdeYabcde":
        past.append(b)
        m.begin(past)
    assert m.byte == ord("Y") and m.length == 5


def test_partial_matching_adds_up_and_equals_its_rule():
    model = predictor.PartialMatch(order=2)
    for byte in b"abracadabra":
        d = model.distribution()
        assert abs(d.sum() - 1) < 1e-12 and (d > 0).all()
        model.learn(byte)
    # after "ra" only c came: c, or an escape of 1 in 2; after "a" b twice, c, d: 5 of 7 without c, and so on
    d = model.distribution()
    assert abs(d[ord("c")] - 1 / 2) < 1e-12 and abs(d[ord("b")] - 1 / 2 * 2 / 5) < 1e-12 and abs(d[ord("d")] - 1 / 2 * 1 / 5) < 1e-12
    assert predictor.PartialMatch.bits(TEXT) < causal_bits(TEXT.decode(), 2)[1].sum()


def test_gradients_equal_differences():
    model = recurrent.Lstm(cells=3, horizon=99)

    def loss(weights):
        m = recurrent.Lstm(cells=3, horizon=99)
        m.w = weights
        total = 0.0
        for b in b"abcab":
            total -= math.log(m.distribution()[b])
            m.learn(b)
        return total

    for b in b"abcab":
        model.distribution()
        model.learn(b)
    got, rng = model.gradients(), np.random.default_rng(0)
    for k, g in got.items():
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in g.shape) if k != "x" else (int(rng.choice([0, 97, 98, 99])), int(rng.integers(g.shape[1])))
            sides = []
            for e in (1e-5, -1e-5):
                w = {n: v.copy() for n, v in model.w.items()}
                w[k][at] += e
                sides.append(loss(w))
            assert abs(g[at] - (sides[0] - sides[1]) / 2e-5) < 1e-6


def test_a_recurrent_model_learns():
    assert recurrent.Lstm.bits(b"ab" * 300) < 0.5 * 8 * 600 and recurrent.Lstm.bits(b"") == 0.0
