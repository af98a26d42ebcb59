"""Prefix counts against encoding every prefix with the plain library."""

import random

import pytest
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from odd_rows import no_docs, odd_docs  # noqa: F401
from sluice.llm import prefix_counts
from sluice.llm.tokens import default_tokenizer

PLAIN = Tokenizer.from_file(default_tokenizer())
PARTS = st.one_of(st.text(alphabet="ab Zé'.,!?\n\t　\xa0\x1f½²1_<|>ßſ中 😀", max_size=8), st.text(max_size=4),
                  st.sampled_from(["<|endoftext|>", "<|endoftext|", "'re", "'ll", "'v", "   ", "\n\n", " indivisible", " déjà.", "…", "ing", "antidis"]))


def size(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


def stored(text):
    steps, _ = prefix_counts.counter(default_tokenizer()).table.texts([text.encode()])
    return prefix_counts.PrefixCounts(prefix_counts.stored_form(steps))


@settings(max_examples=250, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
@example("it're  <|endoftext|>'ve x   \n\n y")
@example("\n x \n\ty　　z 're!'re")
def test_every_prefix_counts_like_the_library(text):
    held = stored(text)
    wanted = [size(text[:i]) for i in range(len(text) + 1)]
    assert [held.at(len(text[:i].encode())) for i in range(len(text) + 1)] == wanted
    assert held.total() == wanted[-1]
    for budget in range(0, wanted[-1] + 2):
        assert held.longest(budget) == max(len(text[:i].encode()) for i, w in enumerate(wanted) if w <= budget)


def test_made_up_words():
    rng = random.Random(8)
    words = ["".join(rng.choice(["an", "er", "th", "qu", "zx", "ing", "é", "ô", "str", "ious", "0", "Q"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = " ".join(words)
    held = stored(text)
    for i in sorted(rng.sample(range(len(text)), 300)) + [len(text)]:
        assert held.at(len(text[:i].encode())) == size(text[:i])


@pytest.mark.parametrize("limit", [1024, 20])
def test_query_on_odd_rows(spark, odd_docs, no_docs, limit):
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    rows = prefix_counts.answers(prefix_counts.count_prefixes(odd_docs, default_tokenizer()), limit).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows))) == sorted(
        map(str, ((i, len(t.encode()), size(t), size(t) > limit) for i, t in texts)))
    kept = {(r["doc_id"], r["n_bytes"]): r["keep_bytes"] for r in rows}
    for i, t in texts:
        cut = t.encode()[:kept[i, len(t.encode())]].decode()
        assert size(cut) <= limit and (cut == t or all(size(t[:len(cut) + k]) > limit for k in (1, 2)))
    assert prefix_counts.answers(prefix_counts.count_prefixes(no_docs, default_tokenizer())).count() == 0
