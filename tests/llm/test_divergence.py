"""Divergence of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from odd_rows import TEXT_SCHEMA, no_docs, odd_docs  # noqa: F401
from sluice.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    count, holding, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(AZ))
        count[lang or "", source or ""].update(found)
        holding[lang or ""].update(set(found))
        langs[lang or ""].add(source or "")
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in holding[lang].items() if n >= least)
        n = {s: [count[lang, s][t] for t in kept] for s in sources}
        share = lambda v: [1 + 10**9 * (c + 5) // (sum(v) + 5 * len(kept)) for c in v]
        p, q = {s: share(v) for s, v in n.items()}, share([sum(c) for c in zip(*n.values())])
        for s in sources:
            pair = [(-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s]
            term = [(b - a, t.encode(), t) for t, c, a, b in zip(kept, n[s], p[s], q) if c and a > b]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(term)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("n", "é", "中x", "ing", "Q", "zz", "m", "pp")]
    texts = [(i, " ".join(rng.choices(words[k % 3:], weights=range(1, len(words) + 1 - k % 3), k=rng.randint(0, 90))) + " 4x4", rng.choice(["en", "fr", None]), f"s{k}", 0, 0.0, 0, 0)
             for i in range(260) for k in [rng.choice([0] * 8 + list(range(9)))]]
    return spark.createDataFrame(texts + texts[:20] + [(None, None, "de", "only", 0, 0.0, 0, 0), (None, "", "de", None, 0, 0.0, 0, 0)], TEXT_SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [{}, {"min_documents": 3, "chunk_terms": 5, "block_sources": 2, "top": 4}, {"min_documents": 1, "chunk_terms": 70, "block_sources": 3}])
def test_like_plain_counting(many, odd_docs, no_docs, options):
    for docs in (many, odd_docs):
        found = divergence.audit(docs, **options).collect()
        rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
        assert sorted(map(tuple, found)) == brute(rows, options.get("min_documents", 30), options.get("top", 50))
    assert divergence.audit(no_docs, **options).count() == 0


def test_flushes_add_up(many, monkeypatch):
    wanted = sorted(divergence.audit(many, min_documents=3).collect())
    monkeypatch.setattr(divergence, "FLUSH", 10)
    assert sorted(divergence.audit(many, min_documents=3).collect()) == wanted


def test_shares_do_not_overflow():
    counts, total = [0, 7, 10**12, 8 * 10**14], 9 * 10**14
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]
