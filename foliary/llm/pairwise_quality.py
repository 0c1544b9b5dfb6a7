"""Quality by Bradley-Terry pairwise ranking.

A labelled good text should beat a labelled bad one: P(a beats b) is the
logistic function of w . (x_a - x_b), fitted by Newton steps on the features'
differences over preference pairs. Scores are then cut at a quantile: the
share of bad labels in the sample fixes the score that has 0.3 as probability,
and a slope fitted by logistic loss turns the others into probabilities.

Scale: at most `sample` labelled documents are fitted on (those of the least
hash of doc_id, a documented bound); their few features reach the driver.
Scoring is one pass over the texts without a shuffle.

Edge cases: null and empty texts have all counts 0 and get a score like any
other; of rows with equal doc_ids one (of least features) is learnt from; labels that are null count as none, several labels of a document count
by their mean; without labels of both kinds, the score is 0.5 throughout;
columns besides doc_id and text are ignored, rows that repeat each get a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster, textstats

#: Labelled documents to fit on, at most, and preference pairs made of them.
SAMPLE = 20_000
PAIRS = 200_000
CUT = 0.3


def held_out(doc_id):
    """True for the fifth of documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Texts by features, from whole-text counts alone."""
    words, letters, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_letters"], 1), np.maximum(c["n_chars"], 1)
    share = {
        "symbols": np.minimum(c["n_symbols"] / words, 1),
        "capitals": c["n_upper"] / letters,
        "marks": np.minimum(c["n_marks"] / words, 1),
        "marked": c["n_marked_words"] / words,
        "repeats": c["n_repeat_words"] / words,
        "lines": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "twins": c["n_twins"] / words,
        "digits": c["n_digits"] / chars,
        "long": c["n_long_words"] / words,
    }
    length = c["word_chars"] / words
    rest = [np.log1p(c["n_words"]), length, np.maximum(length - 8, 0), np.maximum(4 - length, 0), c["n_words"] < 10]
    worst = np.max([share[k] for k in ("symbols", "capitals", "marks", "marked", "repeats", "twins")], axis=0)
    steps = [share["marked"] > 0.1, share["capitals"] > 0.4, share["marks"] > 0.2, share["twins"] > 0.2, share["repeats"] > 0.3, worst > 0.25]
    return np.column_stack([*share.values(), *(np.sqrt(v) for v in share.values()), worst, *rest, *steps]).astype(float)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        z = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> Ranker:
    """Bradley-Terry weights from rows of features and their labels (True: good)."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    wins, losses = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(wins) or not len(losses):
        return Ranker(mean, scale, w, 0.0, 0.0)
    draw = np.random.default_rng(seed)
    n = min(pairs, len(wins) * len(losses))
    first = np.resize(draw.permutation(wins), n)
    second = np.resize(draw.permutation(losses), n) if len(losses) > 1 else np.resize(losses, n)
    draw.shuffle(second)
    d = z[first] - z[second]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        gradient = d.T @ (1 - p) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), gradient)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    cut = float(np.quantile(s, np.mean(~good)))  # as many below it as there are bad labels
    slope, offset = 1.0, np.log(CUT / (1 - CUT))
    for _ in range(50):  # the slope alone; the cut stays at its quantile
        p = 1 / (1 + np.exp(-np.clip(slope * (s - cut) + offset, -500, 500)))
        gradient = (s - cut) @ (good - p) - 1e-3 * (slope - 1)
        slope = float(np.clip(slope + gradient / ((s - cut) ** 2 @ (p * (1 - p)) + 1e-3), 1e-3, 50))
    return Ranker(mean, scale, w, slope, cut)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` documents, none of them held out."""
    quality = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    quality = quality.groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good"))
    few = quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    names = [f"f{i}" for i in range(features({k: np.zeros(1, np.int64) for k in textstats.COLUMNS}).shape[1])]

    def batch(b: pa.RecordBatch) -> pa.Table:
        x = features(textstats.count_arrow(b.column(1)))
        return pa.table([b.column(0), b.column(2), *(pa.array(x[:, i]) for i in range(len(names)))], ["doc_id", "good", *names])

    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # few is bounded by `sample`
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, good boolean, " + ", ".join(f"{n} double" for n in names)
    # Rows that share a doc_id are one to learn from, so `sample` bounds what comes to the driver.
    first = F.min(F.struct("good", *names)).alias("x")
    rows = cluster.map_batches(chosen, batch, schema).groupBy("doc_id").agg(first).select("doc_id", "x.*").toArrow().sort_by([("doc_id", "ascending"), ("f0", "ascending")])
    x = np.column_stack([rows[n].to_numpy() for n in names]) if rows.num_rows else np.zeros((0, len(names)))
    return x, np.array(rows["good"].to_pylist(), bool)


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from CUT on)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        p = model.score(features(textstats.count_arrow(b.column(1))))
        return pa.table({"doc_id": b.column(0), "held_out": b.column(2), "score": pa.array(p), "predicted": pa.array((p >= CUT).astype(np.int32))})

    return cluster.map_batches(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), batch, f"doc_id {kind}, held_out boolean, score double, predicted int")


def above_quantile(scored: DataFrame, share: float) -> DataFrame:
    """The scored documents at or above the quantile that leaves out `share` of them; ties at it stay."""
    least = scored.agg(F.percentile_approx("score", share, 100_000).alias("least"))
    return scored.join(F.broadcast(least), F.col("score") >= F.col("least")).drop("least")


def rank_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(*training_rows(docs, labels, sample)))
