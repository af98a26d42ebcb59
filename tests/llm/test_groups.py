"""Near duplicates, components, shards, archives and the pipeline on odd rows."""

import random
import zlib

import pytest
import zstandard

import corpus_pipeline
from odd_rows import SF_DIR, no_docs, odd_docs  # noqa: F401
from sluice.llm import archives, ngram_join, shards, toxicity
from sluice.llm.common import scratch
from sluice.llm.components import components


def shingles(text):
    found = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    roots = list(range(len(rows)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                roots[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), smallest.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = [tuple(r) for r in ngram_join.near_duplicates(odd_docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_components(rows)))
    assert ngram_join.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_with_shared_passages(spark, seed):
    """Chains of edits, frequent passages and short texts, where prefix order and components matter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 60]))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text + passage * rng.randint(0, 1)))
            base = text if rng.random() < 0.5 else base
    rows = list(enumerate(rows))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_components(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 60), (60, 80), (7, 7), (200, 201), (200, 201)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 60 for i in (60, 80, 100)} | {200: 200, 201: 200}


def least_capacity(sizes, shards_n):
    low, high = max(max(sizes), -(-sum(sizes) // shards_n)), sum(sizes)
    while low < high:
        middle, need, used = (low + high) // 2, 1, 0
        for s in sizes:
            need, used = (need + 1, s) if used + s > middle else (need, used + s)
        low, high = (low, middle) if need <= shards_n else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(rng.choice([3, 40, 300]))] + [rng.choice([1, 400])]
    atoms = spark.createDataFrame(list(enumerate(sizes)), "k int, v long")
    row = shards.minimax(atoms, "k", "v", 5).first()
    edges = [0, *row["starts"], len(sizes)]
    assert row["capacity"] == least_capacity(sizes, 5)
    assert len(row["starts"]) <= 4 and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= row["capacity"]


def test_shards(odd_docs, no_docs):
    rows = shards.shard(odd_docs, 6).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    assert len(rows) == odd_docs.count() and shards.shard(no_docs).count() == 0
    of_text = {}
    for r in rows:
        text = next(t for t in texts[r["doc_id"]] if zlib.crc32(t.encode()) == r["text_crc32"])
        assert r["size"] == len(text.encode()) + 8
        assert of_text.setdefault(text, r["shard"]) == r["shard"]
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_archives(spark):
    rows = [(i, f"http://a/{i}\r\n" if i % 5 else None, h, "x") for i, h in enumerate(
        [None, "", "same", "same", "é" * 300_000, "same", "a\r\n\r\nb"] + [f"<p>{i % 40} text of a page</p>" * 9 for i in range(300)])]
    rows += [rows[3], (None, "u", "same", "x"), (None, "u", "lonely", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    for least in (0, 6):
        folder = scratch(spark, "w")
        found = archives.read(archives.write(pages, folder, min_revisit_bytes=least), folder).collect()
        payload = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
        assert len(found) == len(rows)
        for r in found:
            full = payload.get(r["page_id"])
            if full is None:
                continue
            target = max(i for i, p in payload.items() if p == full)
            response = len(full) < least or target == r["page_id"]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", target))
            assert (r["payload_bytes"], r["payload_digest"]) == (len(full), archives.digest(full))
            assert r["payload"] == (full if response else None)
    folder = scratch(spark, "w")
    assert archives.read(archives.write(pages.limit(0), folder), folder).count() == 0


def test_archive_reader_rejects_damage():
    good = archives.build_record(1, "http://a/", b"abc", 3, archives.digest(b"abc"), None, "2024-01-01T00:00:00Z")
    assert archives.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"X-Date"), good + b"x"):
        with pytest.raises(ValueError):
            archives.parse_record(bad)
    import io
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(archives.frames(io.BytesIO(frame * 3), block=7)) == [good] * 3
    with pytest.raises(ValueError):
        list(archives.frames(io.BytesIO(frame[:-2])))


@pytest.fixture
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 24)


def test_pipeline(spark, short_training):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, SF_DIR)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        assert 0 < left.count() <= before.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.collect()}


def test_stages_take_odd_and_empty_tables(spark, short_training, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            assert stage(spark, docs, SF_DIR).count() >= 0, name


def test_near_duplicate_stage_loses_no_other_text(spark):
    """One of each component stays, the one with the smallest id; rows that share an id but no text are told apart."""
    one, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, other), (2, one + " more"), (None, one), (None, third), (3, None), (4, ""), (5, third), (5, third), (6, "a b"), (7, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF_DIR).collect()]
    assert sorted(left, key=str) == sorted([(1, one), (1, other), (5, third), (3, None), (4, ""), (6, "a b")], key=str)
