"""Toxicity of whole texts by a recurrent network over overlapping windows.

The network of ``recurrent`` reads words and their characters. It is trained
in numpy on a bounded sample: at most ``SAMPLE_DOCS`` documents of each label,
those with the smallest hash of their id, and ``SAMPLE_WINDOWS`` windows of
each. A document's label holds for the worst of its windows, so in the second
part of the training a window of a toxic document counts only if it is the
worst of its document or already scores high, and clean windows that score
high are drawn more often.

Every text is then scored whole, in overlapping windows; its score is that of
its worst window. Scoring is per row, so nothing is shuffled and no key is hot.

Null or empty text, and text without words: score 0. Null labels teach
nothing; of several labels of one id the larger holds. Without labels of both
kinds every score is 0. Null ids and repeated rows are kept. An empty table
gives no rows. Other columns are unused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.llm import recurrent
from sluice.llm.common import bounded_batches, giving_back, words
from sluice.llm.registry import query

WINDOW = 32
STRIDE = 16
SAMPLE_DOCS = 2000
SAMPLE_WINDOWS = 12
SAMPLE_WORD = 64
VOCABULARY = 4096
STEPS = 480
BATCH = 256
RATE = 0.01
SEED = 5
LIMIT = 0.7
KNOWN_WORDS = 100_000
CHUNK = 2048
#: Of a batch, clean windows of one word over and over; share of words read by their characters alone;
#: every which sampled document sets the cut instead of the weights.
REPEATS, UNKNOWN, APART = 24, 0.2, 5


def window_starts(n: int) -> list[int]:
    """First words of the overlapping windows that cover ``n`` words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def _sampled_windows(texts: pd.Series) -> pd.Series:
    """A bounded number of evenly spread windows of a text."""
    out = []
    for text in texts:
        found = [w[:SAMPLE_WORD] for w in words(text)]
        starts = window_starts(len(found))
        picked = [starts[len(starts) * k // SAMPLE_WINDOWS] for k in range(SAMPLE_WINDOWS)] if len(starts) > SAMPLE_WINDOWS else starts
        out.append([b" ".join(found[s:s + WINDOW]).decode("utf-8", "replace") for s in picked])
    return pd.Series(out)


def sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> list[tuple[int, list[str]]]:
    """Label and windows of each sampled document; bounded by the sample's parameters."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IN (0, 1) AND _id IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [known.filter(f"_y = {y}").orderBy(F.expr("xxhash64(_id)"), "_id").limit(SAMPLE_DOCS) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * SAMPLE_DOCS rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(few, "_id")
    held = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    return sorted((r[0], list(r[1])) for r in held.select("_y", F.pandas_udf(_sampled_windows, "array<string>")("_text")).collect())


class Model:
    """Network, vocabulary and cut of a trained scorer."""

    def __init__(self, params: recurrent.Arrays, vocabulary: dict[bytes, int], cut: float) -> None:
        self.params, self.vocabulary, self.cut = params, vocabulary, cut

    def tables(self, found: list[bytes]) -> dict[str, np.ndarray]:
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in found), dtype=np.int64, count=len(found))
        return recurrent.project(self.params, recurrent.inputs(self.params, ids, *recurrent.char_grams(found)))

    def probability(self, logit: np.ndarray) -> np.ndarray:
        """Scores that reach ``LIMIT`` at the cut."""
        shift = np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) - self.cut + shift, -30, 30)))


def _matrix(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of concatenated texts: word numbers, mask, and text of each window."""
    ends = np.cumsum(sizes)
    starts = [window_starts(n) for n in sizes.tolist()]
    owner = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
    first = np.concatenate([np.array(s, dtype=np.int64) for s in starts]) + (ends - sizes)[owner] if len(owner) else np.zeros(0, dtype=np.int64)
    at = first[:, None] + np.arange(WINDOW)
    mask = at < ends[owner][:, None]
    return ids[np.where(mask, at, 0)] if len(ids) else at, mask, owner


def train(rows: list[tuple[int, list[str]]], steps: int | None = None, seed: int = SEED) -> Model | None:
    """Fit the network to labelled windows; None without both labels."""
    steps = steps or STEPS
    texts = [(y, [words(w.encode()) for w in windows]) for y, windows in rows]
    texts = [(y, [w for w in windows if w]) for y, windows in texts]
    owner = np.array([i for i, (_, windows) in enumerate(texts) for _ in windows], dtype=np.int64)
    label = np.array([y for y, _ in texts], dtype=np.float32)
    flat = [w for _, windows in texts for w in windows]
    if len(np.unique(label[owner])) < 2:
        return None
    seen = Counter(w for _, windows in texts for w in {x for window in windows for x in window})
    vocabulary = {w: i + 1 for i, w in enumerate(sorted((w for w, n in seen.items() if n > 2), key=lambda w: (-seen[w], w))[:VOCABULARY])}
    number = {w: i for i, w in enumerate(seen)}
    grams, starts = recurrent.char_grams(list(number))
    stops = np.append(starts[1:], len(grams))
    word_ids = np.fromiter((vocabulary.get(w, 0) for w in number), dtype=np.int64, count=len(number))
    ids, mask = np.zeros((len(flat), WINDOW), dtype=np.int64), np.zeros((len(flat), WINDOW), dtype=bool)
    for i, window in enumerate(flat):
        ids[i, :len(window)], mask[i, :len(window)] = [number[w] for w in window], True

    p, rng = recurrent.init(len(vocabulary), seed), np.random.default_rng(seed)
    adam, y, (apart, taught) = recurrent.Adam(p, RATE), label[owner], _split(label)
    free = taught[owner]
    pick, teach = free * np.where(y > 0, 1 / (y > 0).sum(), 1 / (y == 0).sum()), np.ones(len(y), dtype=np.float32)

    def all_logits() -> np.ndarray:
        tables = recurrent.project(p, recurrent.inputs(p, word_ids, grams, starts))
        return np.concatenate([recurrent.logits(p, tables, ids[a:a + CHUNK], mask[a:a + CHUNK]) for a in range(0, len(ids), CHUNK)])

    for step in range(steps):
        if step >= steps // 3 and step % max(1, steps // 12) == 0:
            out = all_logits()
            worst = np.full(len(texts), -np.inf, dtype=np.float32)
            np.maximum.at(worst, owner, out)
            teach = np.where((y > 0) & (out < worst[owner]) & (out < 1), 0, 1).astype(np.float32)
            pick = free * teach * np.where(y > 0, 1, 1 + 20 / (1 + np.exp(-np.clip(out, -30, 30))))
            pick = np.where(y > 0, pick / pick[y > 0].sum(), pick / pick[y == 0].sum())
        chosen = rng.choice(len(ids), BATCH, p=pick / pick.sum())
        there, batch = mask[chosen], ids[chosen]
        repeats = np.flatnonzero(y[chosen] == 0)[:REPEATS]
        batch[repeats], there[repeats] = batch[repeats, rng.integers(0, there[repeats].sum(axis=1))][:, None], True
        used, local = np.unique(batch, return_inverse=True)
        known = np.where(rng.random(len(used)) < UNKNOWN, 0, word_ids[used])
        parts = [grams[starts[u]:stops[u]] for u in used]
        counts = np.array([len(g) for g in parts])
        own, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = recurrent.inputs(p, known, own, begin)
        g, d_x, _ = recurrent.gradients(p, x, local.reshape(BATCH, WINDOW), there, y[chosen], teach[chosen])
        g["word"] = recurrent.scatter(known, d_x[:, :recurrent.WORD_DIM], len(p["word"]))
        g["char"] = recurrent.scatter(own, np.repeat(d_x[:, recurrent.WORD_DIM:] / counts[:, None], counts, axis=0), len(p["char"]))
        g["word"][0] = 0
        adam.rate = RATE * min(1.0, 2 * (1 - step / steps))
        adam.step(p, g)

    worst = np.full(len(texts), -np.inf, dtype=np.float32)
    np.maximum.at(worst, owner, all_logits())
    there = np.isfinite(worst) & apart
    return Model(p, vocabulary, _cut(worst[there], label[there]))


def _split(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that set the cut, every ``APART``-th of each label, and those that teach; few documents do both."""
    apart, taught = np.zeros(len(label), dtype=bool), np.ones(len(label), dtype=bool)
    for kind in (0, 1):
        of_kind = np.flatnonzero(label == kind)
        few = len(of_kind) < 2 * APART
        apart[of_kind if few else of_kind[::APART]] = True
        taught[of_kind] = few | ~apart[of_kind]
    return apart, taught


def _cut(out: np.ndarray, label: np.ndarray) -> float:
    """Cut with the fewest weighted errors, in the middle of the gap it falls into; both labels weigh the same."""
    order = np.argsort(out, kind="stable")
    values, y = out[order].astype(np.float64), label[order]
    missed = np.concatenate([[0], np.cumsum(y) / max(y.sum(), 1)])
    wrong = np.concatenate([[1], 1 - np.cumsum(1 - y) / max((1 - y).sum(), 1)])
    edges = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    return float(edges[np.argmin(missed + wrong)])


class _Scorer:
    """Scores texts with a cache of projected words, emptied when it is full."""

    def __init__(self, model: Model) -> None:
        self.model, self.number, self.tables = model, {}, {}

    def _number(self, found: list[list[bytes]]) -> np.ndarray:
        if len(self.number) > KNOWN_WORDS:
            self.number, self.tables = {}, {}
        flat = [w for text in found for w in text]
        new = [w for w in dict.fromkeys(flat) if w not in self.number]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.number |= zip(part, range(len(self.number), len(self.number) + len(part)))
            more = self.model.tables(part)
            self.tables = {d: np.concatenate([self.tables[d], more[d]]) if self.tables else more[d] for d in "fb"}
        return np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        found = [words(t) for t in texts]
        ids, mask, owner = _matrix(self._number(found), np.array([len(f) for f in found], dtype=np.int64))
        worst = np.full(len(texts), -np.inf, dtype=np.float32)
        order = np.argsort(mask.all(axis=1), kind="stable")  # whole windows need no mask
        for at in range(0, len(order), CHUNK):
            part = order[at:at + CHUNK]
            np.maximum.at(worst, owner[part], recurrent.logits(self.model.params, self.tables, ids[part], mask[part]))
        return np.where(np.isfinite(worst), self.model.probability(worst), 0.0)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model | None:
    bounded_batches(docs.sparkSession)
    return train(sample(docs, labels, text_col, id_col, label_col))


def score(model: Model | None, text_col: str = "text") -> Column:
    """Score of a text column, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    @giving_back
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model)
        for texts in batches:
            held = texts.tolist()
            yield pd.Series(np.concatenate([scorer.scores(held[at:at + 200]) for at in range(0, len(held), 200)] or [np.zeros(0)]))

    return scored(F.col(text_col).cast("binary"))


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: the others are held out."""
    return labels.filter(f"pmod(crc32(CAST(CAST({id_col} AS STRING) AS BINARY)), 3) <> 1")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = docs.withColumn("score", score(model)).drop("text")
    return scored.selectExpr("doc_id", "coalesce(pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) = 1, false) AS held_out", "score",
                             f"CAST(score >= {LIMIT} AS INT) AS predicted")
