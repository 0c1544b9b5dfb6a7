"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

A document is its token ids and an end id; only those longer than a sequence
are cut. Pieces go, longest first, into the open sequence with the least room
that still takes them, found by a segment tree over remaining capacities.

Pieces of one length are alike, so the packing runs over how many there are of
each length (at most `capacity` counts, whatever the corpus) and yields rules:
the pieces of a length with ranks from a to b go, q to a sequence, into those
from s on, at an offset. That is the very packing that placing single pieces
in turn gives. Each piece then finds its rule by its length and its rank.

Scale: texts are read once and not shuffled; ranks come from counts by length
and hash bucket, so that a length that many documents share is split; the
rules are bounded by the square of the capacity.

Edge cases: a null or empty text is its end id alone; an empty table gives an
empty result; repeated rows are packed as often as they occur; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked together, about.
_RANKED = 2_000
#: Words and parts of words whose ids a worker remembers.
_REMEMBERED = 400_000
#: The tokenizer's own split, fixed value.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of ASCII and precomposed Latin letters: lower-casing and normalising them needs no context.
_PLAIN = regex.compile(r"[\x21-\x7eÀ-įı-ſ]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones stand for themselves."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(others)) for b in range(256)]


class Tokens:
    """Ids of texts by a tokenizer file whose words do not depend on each other.

    Distinct words of a batch are tokenised once and remembered. What is not
    plainly Latin, or may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            spelled = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
            found = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
            if len(self.parts) >= _REMEMBERED:
                self.parts.clear()
            self.parts[text] = found
        return found

    def word(self, raw: bytes) -> bytes:
        found = self.words.get(raw)
        if found is None:
            text = raw.decode()
            if raw.isalpha():
                found = self.part(text.lower())
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                found = b"".join([self.part(p) for p in _SPLIT.findall(text.lower())])
            else:
                found = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            self.words[raw] = found
        return found

    def ids(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and where each text's begin (n + 1 bounds)."""
        starts, ends, bounds = ta.words(texts)
        _, first, of = np.unique(ta.hash_runs(texts.buf, starts, ends), return_index=True, return_inverse=True)
        raw = texts.buf.tobytes()
        found = [self.word(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        size = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        each = size[of]
        upto = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(begin[of] - upto[:-1], each) + np.arange(upto[-1])] if len(flat) else flat, upto[bounds]


@lru_cache(2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        tokens, out = _tokens(tokenizer), {k: [] for k in ("of", "piece", "start", "length", "crc", "ids")}
        for a, z in ta.slices(b.column(1)):
            flat, bounds = tokens.ids(ta.from_arrow(b.column(1)[a:z]))
            for i in range(z - a):
                ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for k, v in (("of", a + i), ("piece", piece), ("start", start), ("length", len(part)), ("crc", zlib.crc32(part.tobytes()))):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(part.tolist())
        columns = {"doc_id": b.column(0).take(pa.array(out["of"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
        columns |= {n: pa.array(out[k], pa.int64()) for n, k in (("start", "start"), ("length", "length"), ("ids_crc32", "crc"))}
        return pa.table(columns | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {}))

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return cluster.map_batches(docs.select("doc_id", cluster.text_or_empty().alias("text")), batch, schema)


class TightestFit:
    """A segment tree over capacities: which is the least, from some length on, that any open sequence has left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at //= 2

    def first(self, least: int) -> int | None:
        at = least + self.leaves
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.leaves:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, rank after the last, first sequence, pieces a sequence, offset).

    `counts` has how many pieces there are of each length. Sequences of like
    history are kept as ranges of numbers, by the room that they have left.
    """
    fit, room, rules, opened = TightestFit(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n:
            room.setdefault(left, []).append((first, n))
            fit.add(left, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = fit.first(length)
            if space is None:
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                space = capacity
            first, n = room[space].pop()
            fit.add(space, -n)
            q = space // length
            full = min(n, left // q)
            rest = min(left - full * q, q - 1) if full < n else 0
            offset = capacity - space
            if full:
                rules.append((length, rank, rank + full * q, first, q, offset))
                put(space - q * length, first, full)
            if rest:
                rules.append((length, rank + full * q, rank + full * q + rest, first + full, rest, offset))
                put(space - rest * length, first + full, 1)
            put(space, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * q + rest, left - full * q - rest
    return rules


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """`rows` with `rank`, gapless from 0 within each length; lengths of many pieces are ranked by buckets."""
    spark = rows.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // _RANKED)) for k, n in counts.items()], "length long, buckets long")
    # By the number of the written row, as many rows may share an id.
    rows = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("rid"), F.col("buckets")))
    sizes = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "rid"))
    rows = rows.withColumn("place", place - 1).join(sizes, ["length", "bucket"])
    return rows.withColumn("rank", F.col("place") + F.col("before"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    parts = cluster.written(pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("rid", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    rules = spark.createDataFrame(
        best_fit_decreasing(counts, capacity), "length long, first_rank long, end_rank long, first_sequence long, each long, first_offset long"
    )
    at = F.col("rank") - F.col("first_rank")
    placed = ranked(parts, counts).join(F.broadcast(rules), "length").where("rank >= first_rank and rank < end_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("each") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []),
    )
