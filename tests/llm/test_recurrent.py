"""The recurrent network against a step-by-step one, its gradients against differences, scores against all windows."""

import math
import random

import numpy as np
import pytest

from sluice.llm import recurrent, toxicity

WORDS = [b"an", b"vile", b"er", b"the", b"zoggthe", b"in", "é".encode(), b"longerword"]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def step_by_step(p, x):
    """Logit of one window of input vectors, a number at a time."""
    h, states = recurrent.HIDDEN, {}
    for d in "fb":
        state, found = [0.0] * h, []
        for vector in x if d == "f" else x[::-1]:
            given = [sum(float(v) * float(w) for v, w in zip(vector, p[f"in_{d}"][:, k])) + float(p[f"in_b_{d}"][k]) for k in range(3 * h)]
            back = [sum(s * float(w) for s, w in zip(state, p[f"rec_{d}"][:, k])) for k in range(3 * h)]
            z, r = ([sigmoid(given[k + o] + back[k + o]) for k in range(h)] for o in (0, h))
            c = [math.tanh(given[2 * h + k] + r[k] * back[2 * h + k]) for k in range(h)]
            state = [z[k] * state[k] + (1 - z[k]) * c[k] for k in range(h)]
            found.append(state)
        states[d] = found if d == "f" else found[::-1]
    both = [f + b for f, b in zip(states["f"], states["b"])]
    energy = [sum(math.tanh(sum(s * float(w) for s, w in zip(row, p["att"][:, k])) + float(p["att_b"][k])) * float(p["att_v"][k])
                  for k in range(recurrent.ATTENTION)) for row in both]
    weights = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(w * row[k] for w, row in zip(weights, both)) / sum(weights) for k in range(2 * h)]
    return sum(v * float(w) for v, w in zip(pooled, p["out"])) + float(p["out_b"][0])


@pytest.fixture(scope="module")
def model():
    p = recurrent.init(len(WORDS), 3)
    rng = np.random.default_rng(4)
    for name in ("word", "char"):
        p[name] = rng.normal(0, 0.5, p[name].shape).astype(np.float32)
    return toxicity.Model(p, {w: i + 1 for i, w in enumerate(WORDS[:5])}, 0.1)


def inputs(model, found):
    ids = np.array([model.vocabulary.get(w, 0) for w in found])
    return recurrent.inputs(model.params, ids, *recurrent.char_grams(found))


def test_windows_of_any_length_match_the_steps(model):
    rng, x = random.Random(1), inputs(model, WORDS)
    windows = [[rng.randrange(len(WORDS)) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    ids, mask = np.zeros((12, 9), dtype=np.int64), np.zeros((12, 9), dtype=bool)
    for i, w in enumerate(windows):
        ids[i, :len(w)], mask[i, :len(w)] = w, True
    found = recurrent.logits(model.params, recurrent.project(model.params, x), ids, mask)
    for got, w in zip(found, windows):
        assert got == pytest.approx(step_by_step(model.params, x[w]), abs=2e-4)


def test_gradients_match_differences(model):
    rng, x = np.random.default_rng(2), inputs(model, WORDS)
    p = {k: v.copy() for k, v in model.params.items()}
    ids, mask = rng.integers(0, len(WORDS), (6, 5)), np.ones((6, 5), dtype=bool)
    mask[1, 3:] = mask[4, 1:] = False
    y, weight = np.array([0, 1, 1, 0, 1, 0], dtype=np.float32), np.array([1, 2, 1, 1, 0.5, 1], dtype=np.float32)

    def loss():
        out = recurrent.logits(p, recurrent.project(p, x), ids, mask).astype(float)
        return float((weight * (np.log1p(np.exp(out)) - y * out)).sum() / weight.sum())

    g, d_x, _ = recurrent.gradients(p, x, ids, mask, y, weight)
    for name, values, grad in [(k, p[k], g[k]) for k in g] + [("x", x, d_x)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in values.shape)
            held, step = values[at], np.float32(0.02)
            values[at] = held + step
            up = loss()
            values[at] = held - step
            down = loss()
            values[at] = held
            assert grad[at] == pytest.approx((up - down) / (2 * float(step)), abs=2e-3, rel=0.05), name


def test_a_text_scores_as_its_worst_window(model):
    """All overlapping windows count: a score is that of the largest logit among them."""
    rng = random.Random(6)
    texts = [b"", None, b"vile", b" ".join(rng.choices(WORDS, k=toxicity.WINDOW)), b" ".join(rng.choices(WORDS, k=3 * toxicity.WINDOW + 7))]
    scores = toxicity._Scorer(model).scores(texts)
    assert scores[0] == scores[1] == 0
    for text, got in zip(texts[2:], scores[2:]):
        found = text.replace("é".encode(), "é".encode()).split()
        n, last = len(found), max(0, len(found) - toxicity.WINDOW)
        starts = [s for s in range(0, last + toxicity.STRIDE, toxicity.STRIDE) if s == 0 or s < last + toxicity.STRIDE]
        assert starts == toxicity.window_starts(n) and starts[-1] + toxicity.WINDOW >= n
        worst = max(step_by_step(model.params, inputs(model, found[s:s + toxicity.WINDOW])) for s in starts)
        assert got == pytest.approx(float(model.probability(np.array([worst]))[0]), abs=2e-4)
