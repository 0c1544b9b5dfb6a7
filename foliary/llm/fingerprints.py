"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its windows of five words (weight 4 for each
occurrence) and its single words (weight 1 for each). Every sample draws, for
each term, r and c from Gamma(2, 1) and b from the uniform distribution, all
fixed by the term and the sample. With weight S it takes t = floor(ln S / r + b)
and a = c exp(-r (t - b) - r); the sample is the (term, t) of least a. Two texts
agree in a sample with the probability of their generalised Jaccard similarity,
sum of least weights over sum of greatest, so the share of equal samples
estimates it (standard error at most 0.063 with 64 samples).

The draws come from a table of 65536 triples, indexed by a hash of the term
for each sample; ties go to the term of least hash. A fingerprint is 16 bits
of hash of each sample, written as hexadecimal digits.

Scale: texts are shuffled once, by range of doc_id, which puts each document
beside its next; only the first and last of each partition meet again in a join.

Edge cases: null and empty texts and those of white space alone have no term
and one fingerprint of zeros, like only each other; equal doc_ids follow by
text; null doc_ids come last; a lone document is its own next; columns besides
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

SAMPLES = 64
SHINGLE_WORDS = 5
SHINGLE_WEIGHT = 4
_LEVELS = 1 << 16
_TABLED = 16  # weights up to here have tables of their own
_BLOCK = 2048


class Sampler:
    """The draws of all samples."""

    def __init__(self, samples: int = SAMPLES, seed: int = 20_100_813) -> None:
        draw = np.random.default_rng(seed)
        self.r, self.c, self.b = draw.gamma(2, 1, _LEVELS), draw.gamma(2, 1, _LEVELS), draw.random(_LEVELS)
        self.times = ta.mix64(np.arange(1, samples + 1, dtype=ta.U64)) | ta.U64(1)
        weights = [self.draws(np.full(_LEVELS, s + 1.0), np.arange(_LEVELS)) for s in range(_TABLED)]
        self.level_a = np.concatenate([a for a, _ in weights]).astype(np.float32)

    def draws(self, weight: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of terms of these weights at these places of the table."""
        r, b = self.r[level], self.b[level]
        t = np.floor(np.log(weight) / r + b)
        return np.log(self.c[level]) - r * (t - b) - r, t

    def signature(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One uint16 for each sample, of terms in ascending order of hash."""
        n = len(self.times)
        if not len(term):
            return np.zeros(n, np.uint16)
        best = np.full(n, np.inf)
        at = np.zeros(n, np.int64)
        for i in range(0, len(term), _BLOCK):
            level = ((term[i : i + _BLOCK, None] * self.times) >> ta.U64(48)).astype(np.int32)
            w = weight[i : i + _BLOCK]
            a = self.level_a[level + (np.minimum(w, _TABLED).astype(np.int32)[:, None] - 1) * _LEVELS]
            for j in np.flatnonzero(w > _TABLED):
                a[j] = self.draws(np.full(n, float(w[j])), level[j])[0]
            low = a.argmin(0)
            value = a[low, np.arange(n)]
            better = value < best
            best[better], at[better] = value[better], i + low[better]
        chosen = term[at]
        level = ((chosen * self.times) >> ta.U64(48)).astype(np.int64)
        t = self.draws(weight[at].astype(float), level)[1]
        return (ta.mix64(chosen + t.astype(np.int64).astype(ta.U64) * ta.U64(0x9E3779B97F4A7C15)) >> ta.U64(48)).astype(np.uint16)


def terms(texts: ta.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes, ascending, and weights of the terms of each text."""
    starts, ends, bounds = ta.words(texts)
    hashes = ta.hash_runs(texts.buf, starts, ends)
    value, _, text = ta.windows(hashes, bounds, SHINGLE_WORDS)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        both = np.concatenate([value[cuts[i] : cuts[i + 1]], hashes[bounds[i] : bounds[i + 1]]])
        of = np.ones(len(both), np.int64)
        of[: cuts[i + 1] - cuts[i]] = SHINGLE_WEIGHT
        order = np.argsort(both)
        both, of = both[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        yield both[first], np.add.reduceat(of, first) if len(first) else of


def signatures(texts: list[str], sampler: Sampler) -> np.ndarray:
    """Texts by samples."""
    found = [sampler.signature(*x) for a, b in ta.slices(pa.array(texts, pa.large_string())) for x in terms(ta.from_strings(texts[a:b]))]
    return np.array(found, np.uint16).reshape(len(texts), len(sampler.times))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by the first as many code points of `following`."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _resolve(ids: list, texts: list[str], following: list[str], sampler: Sampler) -> list[dict]:
    """Result rows of documents, given the text that follows each."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, other = signatures(texts, sampler), signatures(changed, sampler)
    if texts[1:] == following[:-1]:
        after = np.concatenate([own[1:], signatures(following[-1:], sampler)])
    else:
        after = signatures(following, sampler)
    near, ahead = likeness(own, other), likeness(own, after)
    return [
        {"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "own": a.astype(">u2").tobytes(), "edited": b.astype(">u2").tobytes(), "near_edited": float(x), "near_next": float(y)}
        for i, t, e, a, b, x, y in zip(ids, texts, changed, own, other, near, ahead, strict=True)
    ]


def fingerprint_with_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and what each is like."""
    spark = docs.sparkSession
    cluster.bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    last = F.col("doc_id").desc_nulls_last()
    rows = docs.select("doc_id", cluster.text_or_empty().alias("text"))
    in_order = rows.repartitionByRange(n, last, F.xxhash64("text")).sortWithinPartitions(last, F.xxhash64("text"), "text")
    fields = "n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"
    schema = f"doc_id {kind.simpleString()}, {fields}, part int, head string, tail string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = Sampler(), TaskContext.get().partitionId()
        head = pending = None
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for a, b in ta.slices(batch.column(1)):
                ids, texts = batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()
                if pending is None:
                    head = texts[0]
                else:
                    ids, texts = [pending[0], *ids], [pending[1], *texts]
                if len(ids) > 1:
                    yield _batch(_resolve(ids[:-1], texts[:-1], texts[1:], sampler), id_type)
                pending = ids[-1], texts[-1]
        if pending is not None:
            yield _batch([{"doc_id": pending[0], "part": part, "head": head, "tail": pending[1]}], id_type)

    done = cluster.written(in_order.mapInArrow(walk, schema))
    edges = done.where("part is not null")
    follow = edges.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    follow = follow.withColumn("next", F.coalesce("next", F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("follows"))
    last_rows = edges.select("doc_id", "tail", "part").join(follow, "part").join(heads, "next").select("doc_id", "tail", "follows")

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        return _batch(_resolve(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), Sampler()), b.schema.field(0).type)

    rest = cluster.map_batches(last_rows, finish, schema)
    result = done.where("part is null").unionByName(rest)
    return result.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema(
        [("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()), ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())]
    )
    return pa.RecordBatch.from_pylist(rows, schema)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document, without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        found = signatures(b.column(1).to_pylist(), Sampler())
        return pa.table({"doc_id": b.column(0), "fingerprint": pa.array([x.astype(">u2").tobytes().hex() for x in found], pa.string())})

    return cluster.map_batches(docs.select("doc_id", cluster.text_or_empty().alias("text")), batch, f"doc_id {kind}, fingerprint string")
