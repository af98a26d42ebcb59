"""Token files, Elias-Fano lists and packing."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from odd_rows import no_docs, odd_docs  # noqa: F401
from sluice.llm import contamination, elias_fano, ngram_join, packing, quality, segments, token_files, toxicity
from sluice.llm.common import BATCH_CONF, bounded_batches, give_back, scratch
from sluice.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 10**6), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    held = elias_fano.EliasFano(elias_fano.encode(np.array(values, dtype=np.int64)))
    assert held.values().tolist() == values
    assert [held.select(i) for i in range(len(values))] == values
    for first in range(0, len(values), 97):
        assert held.select_range(first, min(first + 300, len(values))).tolist() == values[first:first + 300]


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 500))
    assert len(elias_fano.encode(values)) < 10_000 * 12 / 8 + 600


ODD_TEXT = st.lists(st.one_of(st.text(alphabet="ab Zé'.,!?\n\t\u3000\xa0\x1f½²1_<|>ßſ中\u2028", max_size=12),
                              st.sampled_from(["<|endoftext|>", "<|endoftext|", "'re", " 'll", "  ", "\n\n", "word", " word", " déjà.", "…."])),
                    max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_TEXT, max_size=5))
def test_segments_encode_like_whole_texts(texts):
    from tokenizers import Tokenizer

    own = test_segments_encode_like_whole_texts
    own.plain = plain = getattr(own, "plain", None) or Tokenizer.from_file(default_tokenizer())
    own.coder = coder = getattr(own, "coder", None) or Encoder(default_tokenizer())
    assert coder.by_segment
    whole = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = coder.batch([t.encode() for t in texts])
    assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


def test_long_texts_and_full_tables_encode_alike(monkeypatch):
    from tokenizers import Tokenizer

    rng, plain = random.Random(4), Tokenizer.from_file(default_tokenizer())
    text = "".join(rng.choice(["ab", "éa ", " the", "\n", "  ", "中文", "x" * 50, ". ", "'s"]) for _ in range(30_000)) + "y" * 9000
    monkeypatch.setattr(segments, "PIECE", 5000)
    coder = Encoder(default_tokenizer())
    coder.table = segments.SegmentTable(coder._learn, np.uint32, max_segments=300)
    monkeypatch.setattr(segments.SegmentTable, "_hash", lambda self, data, starts, lengths: (lengths % 7).astype(np.uint64))
    assert coder.batch([text.encode(), None, b"a b"])[0].tolist() == [i for t in (text, "a b") for i in plain.encode(t, add_special_tokens=False).ids]


def test_token_file_lookups(spark, odd_docs, library):
    folder = scratch(spark, "t")
    texts = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for f in token_files.write(odd_docs, folder, default_tokenizer()).orderBy("file_no").collect():
        opened = token_files.TokenFile(folder, f["path"])
        assert len(opened) == f["documents"]
        for i in range(len(opened)):
            doc_id = opened.key(i)
            assert opened.ids(i).tolist() in [library(t) + [0] for d, t in texts if d == doc_id]
        for bad in (b"", b"EFTOKEN1" + bytes(60)):
            with open(f["path"] + "x", "wb") as out:
                out.write(bad)
            with pytest.raises(Exception):
                token_files.TokenFile(folder, f["path"] + "x")


def test_token_files(spark, odd_docs, no_docs, library):
    folder = scratch(spark, "t")
    rows = token_files.read(token_files.write(odd_docs, folder, default_tokenizer()), folder, block=500).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    wanted = sorted((i or -1, len(ids), zlib.crc32(np.array(ids, dtype="<u4"))) for i, t in texts for ids in [library(t) + [0]])
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == wanted
    empty = scratch(spark, "t")
    assert token_files.read(token_files.write(no_docs, empty, default_tokenizer()), empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(sizes, 20)
    room = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [20] * (at == len(room))
        assert (bins[i], offsets[i]) == (at, 20 - room[at])
        room[at] -= sizes[i]


@pytest.mark.parametrize("group_documents", [7, 4096])
def test_packing(odd_docs, no_docs, library, group_documents):
    rows = packing.pack(odd_docs, default_tokenizer(), length=64, group_documents=group_documents).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0) and 0 < r["length"] <= 64
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64
    wanted = []
    for doc in odd_docs.collect():
        ids = np.array(library(doc["text"]) + [1], dtype="<u4")
        wanted += [(doc["doc_id"], a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64]), len(ids)) for a in range(0, len(ids), 64)]
    found = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    assert packing.pack(no_docs, default_tokenizer()).count() == 0


def _resident_mb() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_freed_memory_goes_back_to_the_system():
    """Small pieces freed below one that stays are otherwise held by the worker for good."""
    held = [b"x" * (400 + i % 7) for i in range(400_000)]
    last, full = b"x" * 400, _resident_mb()
    del held
    give_back()
    assert len(last) == 400 and _resident_mb() < full - 100


def test_workers_get_long_texts_in_bounded_batches(spark):
    """Thirty megabytes of text in one partition; a limit that the session names is kept."""
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word number ten ', 640) AS text", "'s' AS source")
    labels, benchmark = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, "some item")], "item_id long, text string")
    before = spark.conf.get(BATCH_CONF, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    try:
        for stage in (lambda: toxicity.fit(docs, labels), lambda: quality.judged(docs), lambda: ngram_join.near_duplicates(docs.limit(2)),
                      lambda: contamination.with_hits(docs, benchmark), lambda: packing.pack(docs.limit(2), default_tokenizer())):
            spark.conf.unset(BATCH_CONF)
            stage()
            found = [r[0] for r in docs.mapInArrow(sizes, "size long").collect()]
            assert sum(found) > 30_000_000 and max(found) < 10_000_000
        spark.conf.set(BATCH_CONF, "1m")
        bounded_batches(spark)
        assert spark.conf.get(BATCH_CONF) == "1m"
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)
