"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from odd_rows import no_docs, odd_docs  # noqa: F401
from sluice.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, top):
    held = [(d, terms(t)) for d, t in docs]
    total, count = sum(len(t) for _, t in held), sum(1 for _, t in held if t)
    rows = []
    for item, text in items:
        scores = []
        for d, own in held:
            if not own:
                continue
            m, score = 100 - 50 + (50 * len(own) * count) // total, 0
            for w in set(terms(text)):
                tf, df = own.count(w), sum(w in t for _, t in held)
                if tf:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        rows += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, rows))


@pytest.mark.parametrize("options", [{}, {"top": 3, "block": 7, "leaf": 1}, {"top": 5, "max_bytes": 60}])
def test_ranks_like_scoring_everything(spark, odd_docs, no_docs, options):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    common, long = docs[8][1] or docs[9][1], max((t or "" for _, t in docs), key=len)
    items = [(1, " ".join(common.split()[:30]).upper()), (2, long[5000:5200]), (3, None), (4, "!! ?"), (None, "line same words"), (5, "absent"), (1, "head x3 x9"), (1, "head x3 x9"),
             (6, " ".join(f"x{i}" for i in range(120)) + " new head")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = ball_tree.rank(odd_docs, bench, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(docs, items, options.get("top", 50))
    assert ball_tree.rank(no_docs, bench).count() == 0 and ball_tree.rank(odd_docs, bench.limit(0)).count() == 0


def test_trees_prune_and_stay_exact():
    rng = random.Random(5)
    vocabulary, rows = 300, []
    for _ in range(1500):
        topic = rng.randrange(12) * 25
        rows.append(sorted({rng.randrange(25) + topic for _ in range(12)} | {rng.randrange(vocabulary)}))
    offsets = np.cumsum([0] + [len(r) for r in rows])
    flat = np.array([t for r in rows for t in r])
    values = np.array([rng.randrange(1, 10**6) for _ in flat])
    weights = np.array([rng.randrange(0, 9000) for _ in range(vocabulary)])
    items = ball_tree.Items([0, 1, 2], [1, 1, 1], [list(range(30, 45)), [3, 260, 7], list(range(0, 300, 9))], weights)
    tree = ball_tree.BallTree(offsets, flat, values, weights, leaf=8)
    bounds, leaves = tree.bounds(items), sum(left < 0 for _, _, left, _ in tree.nodes)
    scored = []
    for i, own in enumerate(items.terms):
        query = np.zeros(vocabulary, dtype=np.int64)
        query[own] = weights[own]
        scores = [sum(int(query[t]) * int(v) for t, v in zip(r, values[a:])) for r, a in zip(rows, offsets)]
        for node, (lo, hi, _, _) in enumerate(tree.nodes):
            assert bounds[node, i] >= max(scores[r] for r in tree.order[lo:hi])
        best = []
        scored.append(tree.search(i, query, bounds, [(True, -k) for k in range(len(rows))], best, 10))
        assert sorted(best, reverse=True) == sorted(((s, (True, -k)) for k, s in enumerate(scores) if s > 0), reverse=True)[:10]
    assert min(scored) < leaves / 2
