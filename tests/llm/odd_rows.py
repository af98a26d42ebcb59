"""Fixtures and folders of these tests."""

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = line(120)
    words = base.split()
    texts = [None, "", " \n\t ", "one", "two words", "MIT License.\nunder the General Public License", "<|endoftext|> it's 2 o'clock...  ß½²",
             base, base, base.upper(), " ".join(words[:60] + ["new"] + words[60:]), " ".join(["head"] + words), line(9000),
             "Same line here\n" + line(80) + "\nSame line here", "ab " * 300, line(60) + "\n" + line(60)]
    texts += [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in range(3, 110, 6)] + [line(70) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 0.5, 9, 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id", None, None, None, None, None, None), (None, base, None, "s1", None, None, None, None), (-5, line(70), None, "s1", 3, 0.0, 0, 0)]
    return spark.createDataFrame(rows, TEXT_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], TEXT_SCHEMA)
