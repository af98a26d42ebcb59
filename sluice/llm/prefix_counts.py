"""Token counts of every prefix of every text, by dynamic programming.

In a byte-pair encoding, a row of tokens is what the library gives exactly
when each two neighbours are (each pair encodes to itself). So each prefix of a
pre-token has one last token that fits the last token of what precedes it, and

    count(prefix) = count(prefix without its last token) + 1

finds the counts of all prefixes from left to right, each prefix once. Across
pre-tokens counts add up. A prefix that ends inside a run of white space, a
contraction or an added token is cut differently from the whole text; these
are counted as the library would count the prefix on its own.

Counts are stored per document as a compressed row of steps, one per byte:
how much the count changes there, and a mark inside characters, where no prefix
ends. ``PrefixCounts`` answers from it how many tokens a prefix has, and what
the longest prefix within a budget is, without the text and without encoding.

Null or empty text: no bytes, no tokens. Null ids, ties and repeated rows are
kept, a row each. Very long texts are worked in parts. An empty table gives no
rows. Other columns are unused.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import records, slices, written
from sluice.llm.registry import query
from sluice.llm.segments import SegmentTable
from sluice.llm.tokens import WHOLE, byte_alphabet, default_tokenizer, encoder

LIMIT = 1024
#: The byte-level pre-tokenizer's fixed pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: The step stored where no prefix ends, inside a character.
INSIDE = np.iinfo(np.int32).min
INSIDE_NARROW = -128
MAX_PAIRS = 2_000_000
COUNTS = "doc_id long, n_bytes long, counts binary"


class PrefixDP:
    """Counts of all prefixes of a segment."""

    def __init__(self, tokenizer_file: str) -> None:
        coder = encoder(tokenizer_file)
        if not coder.by_segment:
            raise ValueError("prefix counts need a byte-level BPE tokenizer without a normalizer")
        model = json.loads(coder.tokenizer.to_str())["model"]
        if model["ignore_merges"] or model["dropout"] or model["byte_fallback"]:
            raise ValueError("prefix counts need plain merges")
        back = {c: b for b, c in byte_alphabet().items()}
        self.tokens = {bytes(back[c] for c in t): i for t, i in coder.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        for token in coder.added:
            self.tokens.pop(token, None)
        self.alphabet, self.tokenize = byte_alphabet(), coder.tokenizer.model.tokenize
        self.endings = {t[n:] for t in self.tokens for n in range(len(t))}
        self.added, self.fits = sorted(coder.added, key=len, reverse=True), {}
        self.find_added = regex.compile("|".join(regex.escape(t.decode()) for t in self.added)) if self.added else None
        self.table = SegmentTable(self.learn, np.int32)

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens in a row are what the library makes of their bytes; ``left`` may be empty."""
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()
        found = [t.id for t in self.tokenize((left + right).decode("latin-1").translate(self.alphabet))]
        known = self.fits[left, right] = found == [self.tokens[t] for t in (left, right) if t]
        return known

    def extend(self, data: bytes, counts: list[int], last: list[bytes]) -> None:
        """Fill in counts and last tokens of the prefixes of one pre-token that are longer than those given.

        ``counts[i]`` and ``last[i]`` belong to the prefix of ``i`` bytes. The
        last token is one of the prefix's endings, and exactly one fits.
        """
        tokens, endings, fits = self.tokens, self.endings, self.fits
        for stop in range(len(counts), len(data) + 1):
            start = stop - 1
            while start >= 0 and (token := data[start:stop]) in endings:
                if token in tokens:
                    before = last[start]
                    known = fits.get((before, token))
                    if known or known is None and self.neighbours(before, token):
                        break
                start -= 1
            last.append(token)
            counts.append(counts[start] + 1)

    def pre_token(self, data: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes of one pre-token."""
        counts, last = [0], [b""]
        self.extend(data, counts, last)
        return counts[1:]

    def text(self, text: str) -> list[int]:
        """Counts of the prefixes that end at each byte of a text without whole added tokens."""
        out, base, i, pre_tokens = [], 0, 0, PRE_TOKEN.findall(text)
        while i < len(pre_tokens):
            token = pre_tokens[i]
            counts = self.pre_token(token.encode())
            total = counts[-1]
            if token.isspace() and i + 1 < len(pre_tokens) and pre_tokens[i + 1][0].isspace():
                # White space before a word: its last character stands with the word, or alone, but ends a prefix as part of the run.
                follower = pre_tokens[i + 1]
                rest = self.pre_token(follower.encode())
                out += [base + n for n in self.pre_token((token + follower[0]).encode())]
                base += total
                out += [base + n for n in rest[len(follower[0].encode()):]]
                base += rest[-1]
                i += 2
                continue
            if token in LONG_CONTRACTIONS:
                counts[1] = counts[0] + self.pre_token(token[1:2].encode())[0]
            out += [base + n for n in counts]
            base += total
            i += 1
        return out

    def segment(self, text: str) -> list[int]:
        """Counts of the prefixes that end at each byte."""
        out, base, at = [], 0, 0
        for hit in (self.find_added.finditer(text) if self.find_added else ()):
            before = text[at:hit.start()]
            out += [base + n for n in self.text(before + hit[0][:-1])]
            base += (self.text(before)[-1] if before else 0) + 1
            out += [base] * len(hit[0][-1].encode())
            at = hit.end()
        return out + [base + n for n in self.text(text[at:])]

    def learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The step at each byte of each segment; ``INSIDE`` where the next byte belongs to the same character.

        Segments that are one word are taken in order of their bytes, and one
        goes on from where it leaves the one before.
        """
        found: list[list[int]] = [[]] * len(segments)
        counts, last, known = [0], [b""], b""
        for i in sorted(range(len(segments)), key=segments.__getitem__):
            raw = segments[i]
            if WHOLE.fullmatch(raw) and raw not in self.added:
                same, most = 0, min(len(raw), len(known))
                while same < most and raw[same] == known[same]:
                    same += 1
                del counts[same + 1:], last[same + 1:]
                self.extend(raw, counts, last)
                known, ends = raw, counts
            else:
                ends = [0, *self.segment(raw.decode())]
            if raw.isascii():
                found[i] = [b - a for a, b in zip(ends, ends[1:])]
                continue
            steps, before = [INSIDE] * len(raw), 0
            for at in range(len(raw)):
                if at + 1 == len(raw) or raw[at + 1] & 0xC0 != 0x80:
                    steps[at], before = ends[at + 1] - before, ends[at + 1]
            found[i] = steps
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64)


class PrefixCounts:
    """Counts of the prefixes of one text, from their stored form."""

    def __init__(self, stored: bytes) -> None:
        narrow = stored[:1] == b"\x01"
        steps = np.frombuffer(zlib.decompress(stored[1:]), dtype="<i1" if narrow else "<i4")
        self.ends = np.flatnonzero(steps != (INSIDE_NARROW if narrow else INSIDE))
        self.counts = np.cumsum(steps[self.ends], dtype=np.int64)

    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def at(self, n_bytes: int) -> int:
        """Tokens of the prefix of ``n_bytes`` bytes, down to a whole character."""
        i = int(np.searchsorted(self.ends, n_bytes))
        return int(self.counts[i - 1]) if i else 0

    def longest(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens."""
        within = np.flatnonzero(self.counts <= budget)
        return int(self.ends[within[-1]]) + 1 if len(within) else 0


def stored_form(steps: np.ndarray) -> bytes:
    real = steps != INSIDE
    if (np.abs(steps, where=real, out=np.zeros_like(steps)) < -INSIDE_NARROW).all():
        return b"\x01" + zlib.compress(np.where(real, steps, INSIDE_NARROW).astype("<i1").tobytes(), 1)
    return b"\x04" + zlib.compress(steps.astype("<i4").tobytes(), 1)


_COUNTERS: dict[str, PrefixDP] = {}


def counter(tokenizer_file: str) -> PrefixDP:
    """The counter of this worker process, with its table of segments."""
    if tokenizer_file not in _COUNTERS:
        _COUNTERS[tokenizer_file] = PrefixDP(tokenizer_file)
    return _COUNTERS[tokenizer_file]


def count_prefixes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with the counts of all its prefixes, for ``PrefixCounts``. Texts are not shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer).table
        for batch in slices(batches, text_column=1):
            # Bytes that are no UTF-8 become replacement characters, as for the encoder.
            texts = [(t or b"").decode("utf-8", "replace").encode() for t in batch.column(1).to_pylist()]
            steps, sizes = table.texts(texts)
            rows = [stored_form(part) for part in np.split(steps, np.cumsum(sizes)[:-1])]
            yield records({"doc_id": (batch.column(0).to_pylist(), pa.int64()), "n_bytes": (sizes, pa.int64()), "counts": (rows, pa.binary())})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(count, COUNTS)


def _answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for stored, budgets in batches:
        found = [(p.total(), p.longest(b)) for p, b in ((PrefixCounts(s), b) for s, b in zip(stored, budgets))]
        yield pd.DataFrame(found, columns=["n_tokens", "keep_bytes"], dtype="int64")


def answers(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Totals, whether they are over the limit, and how many bytes a cut at the limit keeps."""
    return counts.withColumn("_a", F.pandas_udf(_answers, "n_tokens long, keep_bytes long")("counts", F.lit(limit))).selectExpr(
        "doc_id", "n_bytes", "_a.n_tokens", f"_a.n_tokens > {limit} AS over_limit", "_a.keep_bytes")


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(written(count_prefixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()), "prefix-counts"))
