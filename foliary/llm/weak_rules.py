"""Quality rules as weak supervision.

Each rule votes that a text is good (1), bad (-1), or abstains (0). Each
rule votes at one rate on good texts and at another on bad ones, so that
expectation-maximisation over how often each combination of votes occurs
estimates these rates, hence accuracies, and the share of good texts without
any labels. A text
stays if its posterior probability of being good is high enough.

Scale: one pass counts vote combinations, of which there are at most
2**len(RULES) as each rule has one vote besides abstaining; only these counts
reach the driver. A second pass applies the fitted table. Texts are never shuffled.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; an empty table gives an empty result (the fit then rests on its priors);
repeated rows each get their row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster, textstats

#: Base rules, fixed values.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    name: str
    vote: int


#: Detectors of faults vote -1, of sound text 1.
RULES = (
    Rule("symbols", -1),
    Rule("capitals", -1),
    Rule("marks", -1),
    Rule("marked_words", -1),
    Rule("repeats", -1),
    Rule("repeated_lines", -1),
    Rule("stutter", -1),
    Rule("plain_characters", 1),
    Rule("fresh_words", 1),
    Rule("usual_words", 1),
)


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """True where a rule casts its vote: texts by RULES."""
    words, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_letters"], 1)
    lines = np.maximum(c["n_lines"], 1)
    symbols, capitals, marks = c["n_symbols"] / words, c["n_upper"] / letters, c["n_marks"] / words
    marked, repeats, twins = c["n_marked_words"] / words, c["n_repeat_words"] / words, c["n_twins"] / words
    length = c["word_chars"] / words
    return np.column_stack(
        [
            symbols > 0.2,
            (capitals > 0.5) & (c["n_letters"] > 20),
            marks > 0.3,
            marked > 0.15,
            (repeats > 0.3) & (c["n_words"] >= 30),
            c["n_dup_lines"] / lines > 0.5,
            (twins > 0.2) & (c["n_words"] >= MIN_WORDS),
            (symbols < 0.02) & (capitals < 0.3) & (marks < 0.1),
            (repeats < 0.1) & (c["n_dup_lines"] == 0) & (twins < 0.05),
            (length > 2.5) & (length < 12) & (c["n_words"] >= MIN_WORDS),
        ]
    ).reshape(len(words), len(RULES))


@dataclass(frozen=True)
class Fit:
    """How often each rule votes on good and on bad texts, the share of good texts, log-likelihood by step."""

    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    prior: float
    history: tuple[float, ...]

    @property
    def accuracy(self) -> tuple[float, ...]:
        """How many of a rule's votes are right."""
        good, bad = self.prior * np.array(self.on_good), (1 - self.prior) * np.array(self.on_bad)
        return tuple((np.where([r.vote > 0 for r in RULES], good, bad) / (good + bad)).tolist())

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        good = _log_likelihood(cast, np.array(self.on_good)) + np.log(self.prior)
        bad = _log_likelihood(cast, np.array(self.on_bad)) + np.log1p(-self.prior)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def _log_likelihood(cast: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return cast @ np.log(rate) + (1 - cast) @ np.log1p(-rate)


#: Least, prior mean and greatest of the rates at which rules vote. Detectors of faults vote on less than half
#: of good texts and those of soundness on more, which keeps the classes from swapping; else rates are free.
_FAULT_ON_GOOD, _FAULT_ON_BAD = (1e-5, 0.02, 0.5), (1e-5, 0.3, 1 - 1e-5)
_SOUND_ON_GOOD, _SOUND_ON_BAD = (0.5, 0.9, 1 - 1e-5), (1e-5, 0.4, 1 - 1e-5)


def fit(combinations: np.ndarray, counts: np.ndarray, steps: int = 50, strength: float = 50.0) -> Fit:
    """Expectation-maximisation from combinations of votes and how many texts have each.

    Priors are worth `strength` texts each; rates stay within the bounds above.
    """
    cast, n = np.asarray(combinations, float).reshape(-1, len(RULES)), np.asarray(counts, float)
    sound = np.array([[r.vote > 0] for r in RULES])
    low_good, on_good, high_good = np.where(sound, _SOUND_ON_GOOD, _FAULT_ON_GOOD).T
    low_bad, on_bad, high_bad = np.where(sound, _SOUND_ON_BAD, _FAULT_ON_BAD).T
    mean_good, mean_bad, prior, history = on_good, on_bad, 0.8, []
    for _ in range(steps):
        good, bad = _log_likelihood(cast, on_good) + np.log(prior), _log_likelihood(cast, on_bad) + np.log1p(-prior)
        top = np.maximum(good, bad)
        evidence = top + np.log(np.exp(good - top) + np.exp(bad - top))
        history.append(float(n @ evidence))
        p = np.exp(good - evidence)
        on_good = np.clip(((n * p) @ cast + strength * mean_good) / (n @ p + strength), low_good, high_good)
        on_bad = np.clip(((n * (1 - p)) @ cast + strength * mean_bad) / (n @ (1 - p) + strength), low_bad, high_bad)
        prior = float(np.clip((n @ p + strength * 0.8) / (n.sum() + strength), 0.5, 0.95))
    return Fit(tuple(on_good.tolist()), tuple(on_bad.tolist()), prior, tuple(history))


def _codes(c: dict[str, np.ndarray]) -> np.ndarray:
    return votes(c) @ (1 << np.arange(len(RULES)))


def _cast(codes: np.ndarray) -> np.ndarray:
    return (np.asarray(codes, np.int64)[:, None] >> np.arange(len(RULES)) & 1).astype(float)


def count_votes(docs: DataFrame) -> DataFrame:
    """code (bits by RULES), n: how many texts cast each combination of votes."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        code, n = np.unique(_codes(textstats.count_arrow(b.column(0))), return_counts=True)
        return pa.table({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    return cluster.map_batches(docs.select(F.col("text")), batch, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit_votes(docs: DataFrame) -> Fit:
    """At most 2**len(RULES) counts come to the driver, however many documents there are."""
    rows = count_votes(docs).collect()
    rows.sort()
    return fit(_cast(np.array([r[0] for r in rows], np.int64)), np.array([r[1] for r in rows], float))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def verdicts(c: dict[str, np.ndarray], model: Fit, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    p = model.posterior(votes(c).astype(float))
    return p, (p >= threshold) & ~base_failed(c)


def judge(docs: DataFrame, model: Fit | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts of each text, base_failed, posterior and kept, a row for each document."""
    model = model or fit_votes(docs)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        c = textstats.count_arrow(b.column(1))
        p, kept = verdicts(c, model, threshold)
        columns = {"doc_id": b.column(0)} | {k: pa.array(c[k]) for k in counts}
        return pa.table(columns | {"base_failed": pa.array(base_failed(c)), "kept": pa.array(kept), "posterior": pa.array(p)})

    schema = f"doc_id {kind}, {', '.join(f'{k} long' for k in counts)}, base_failed boolean, kept boolean, posterior double"
    return cluster.map_batches(docs.select("doc_id", "text"), batch, schema)


def keep(docs: DataFrame, model: Fit | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents that stay, with all their columns. Null and empty texts go; repeated rows stay or go together; an empty table stays empty."""
    model = model or fit_votes(docs)
    at = docs.columns.index("text")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(verdicts(textstats.count_arrow(b.column(at)), model, threshold)[1]))

    return cluster.map_batches(docs, batch, docs.schema)
