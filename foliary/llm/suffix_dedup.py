"""Removal of passages that an earlier document has, by prefix-free parsing.

Texts are bytes. A rolling hash of TRIGGER bytes sets triggers: in every stretch
of MATCH bytes the place of least hash (the leftmost of equals). The stretches
with one trigger place form a phrase, so consecutive phrases overlap by
MATCH - 1 bytes, cover each text, and none contains another's trigger as its
own. Equal stretches have equal triggers at equal offsets. Hence all that
equals a stretch lies in phrases of the same trigger bytes:

* If a phrase as a whole occurs in a document of smaller id, all its stretches do.
* Otherwise, its document is the phrase's first, and a stretch of it may still be
  part of another phrase of that trigger, whose first document is smaller.

So the parse is compared by phrases, and the dictionary, that is each distinct
phrase once, for its first document, by its suffixes: those of MATCH bytes and
more, sorted, bring equal stretches together (the suffix array of the
dictionary). Only triggers whose phrases differ have to go into it.

Scale: three passes over the texts send, in packed batches by hash bucket,
triggers (5 bytes each), phrases of triggers that two documents share, and the
bytes of phrases whose triggers are ambiguous; each batch is reduced to
distinct entries before it is sent, so a passage that a third of all documents
share costs an entry a batch. Bit tables of bounded size say what to send;
false bits cost traffic, not results. At last only documents with something to
remove are shuffled. Hashes have 64 bits; equal hashes count as equal phrases.

Edge cases: null texts are empty; texts shorter than MATCH lose nothing; null
doc_ids count as greater than all others and rows with equal doc_ids as one
document, which does not match itself; other columns are ignored; an empty
table gives an empty result. doc_id must be an integer.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from foliary.llm import cluster
from foliary.llm import textarrays as ta

MATCH = 50
TRIGGER = 24
#: Bytes of text a batch of messages comes from, and that a bucket gets, about.
_BATCH = 1 << 20
_BUCKET = 16 << 20
_LEAST_BITS, _MOST_BITS = 20, 31
#: Buckets are at least 2 to the power of this, so that a small table's work is spread too.
_LEAST_BUCKETS = 6
_NULL = np.iinfo(np.int64).max
_MIX = ta.U64(0xD6E8FEB86659FD93)


@dataclass
class Phrases:
    """text, start and end (of the phrase's bytes in the buffer), trigger and phrase hashes, trigger's place in the phrase."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray
    place: np.ndarray


def parse(texts: ta.Texts, match: int = MATCH, width: int = TRIGGER) -> Phrases:
    """The phrases of all texts, in order."""
    buf, offsets = texts.buf, texts.offsets
    n = len(buf) - match + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none.view(ta.U64), none.view(ta.U64), none)
    power, inverse = ta._power(1, len(buf)), ta._power(-1, len(buf) + 1)
    total = np.zeros(len(buf) + 1, ta.U64)
    np.cumsum(ta._BYTE_VALUE[buf] * power, out=total[1:])
    gram = ta.mix64((total[width:] - total[:-width]) * inverse[: len(total) - width])
    # Hash above, place below: the minimum is the leftmost least.
    least = (gram >> ta.U64(32) << ta.U64(32)) | np.arange(len(gram), dtype=ta.U64)
    span, step = match - width + 1, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    at = (least & ta.U64(0xFFFFFFFF)).astype(np.int64)[:n]
    valid = np.zeros(len(buf) + 1, np.int8)  # stretches that stay within their text
    sizes = np.diff(offsets)
    long = sizes >= match
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - match + 1, -1)
    valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    new[offsets[:-1][long]] = True
    first = np.flatnonzero(valid & new)
    following = np.ones(n, bool)
    following[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(valid & following)
    end = last + match
    phrase = ta.mix64((total[end] - total[first]) * inverse[first] + (end - first).astype(ta.U64) * _MIX)
    # Least hashes are small numbers; mixed again they fill buckets and tables evenly.
    return Phrases(np.searchsorted(offsets, first, "right") - 1, first, end, ta.mix64(gram[at[first]]), phrase, at[first] - first)


def _parsed(batch: pa.RecordBatch):
    """(doc ids with null as the greatest, texts, phrases) of a batch with doc_id and text, by slices."""
    ids = batch.column(0).cast(pa.int64()).fill_null(_NULL).to_numpy()
    for i, j in ta.slices(batch.column(1), _BATCH):
        texts = ta.from_arrow(batch.column(1)[i:j])
        yield ids[i:j], texts, parse(texts)


def _spread(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """The columns by bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(bucket))
    return [(int(bucket[i]), [c[order[i:j]] for c in columns]) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]


def _messages(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"bucket": pa.int64(), "kind": pa.int32()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds.get(n, pa.binary())) for k, n in enumerate(names)})


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


class BitTable:
    """Bits set at the top bits of 64-bit hashes."""

    def __init__(self, bits: int) -> None:
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> ta.U64(64 - self.bits)
        return (self.data[at >> ta.U64(3)] >> (at & ta.U64(7)).astype(np.uint8) & 1).astype(bool)


def _collect_bits(rows: DataFrame, bits: int) -> BitTable:
    """A table from its parts: first byte, bytes."""
    table = BitTable(bits)
    for at, part in rows.toLocalIterator():
        table.data[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return table


#: Bytes of a BitTable that one task puts together.
_PART = 1 << 15


def _bit_places(h: np.ndarray, bits: int) -> pa.Table:
    """What a part of a BitTable is made of: first byte of the part, places of bits in it as packed 32-bit numbers."""
    at = np.unique(h >> ta.U64(64 - bits)).astype(np.int64)
    parts = _spread(at // (8 * _PART), at % (8 * _PART))
    return pa.table({"at": pa.array([k * _PART for k, _ in parts], pa.int64()), "places": pa.array([x.astype("<u4").tobytes() for _, (x,) in parts], pa.binary())})


def _bit_table(places: DataFrame, bits: int) -> BitTable:
    """The table of all places; parts are put together by tasks, and the driver gets each once."""

    def group(t: pa.Table) -> pa.Table:
        data = np.zeros(min(8 * _PART, 1 << bits), np.uint8)
        for x in t["places"].to_pylist():
            data[np.frombuffer(x, "<u4")] = 1
        return pa.table({"at": t["at"][:1], "part": pa.array([np.packbits(data, bitorder="little").tobytes()], pa.binary())})

    return _collect_bits(places.repartition(1 << max(0, bits - 24), "at").groupBy("at").applyInArrow(group, "at long, part binary"), bits)


def _shared_triggers(rows: DataFrame, bits: int, log_buckets: int) -> BitTable:
    """Bits of triggers that occur in two documents."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        out = []
        for ids, _, p in _parsed(b):
            doc = ids[p.text]
            order = np.lexsort((doc, p.trigger))
            t, d = p.trigger[order], doc[order]
            same = t[1:] == t[:-1]
            twice = np.unique(t[1:][same & (d[1:] != d[:-1])])
            once = t[np.concatenate([[True], ~same])] if len(t) else t
            for kind, h in ((0, once), (1, twice)):
                bucket = (h >> ta.U64(64 - log_buckets)).astype(np.int64)
                out += [(k, kind, _pack5(x)) for k, (x,) in _spread(bucket, h << ta.U64(log_buckets) >> ta.U64(24))]
        return _messages(out, ["bucket", "kind", "triggers"])

    def group(t: pa.Table) -> pa.Table:
        kind, raw = t["kind"].to_numpy(), t["triggers"].to_pylist()
        once = np.sort(np.concatenate([np.zeros(0, "<u8"), *(_unpack5(x) for k, x in zip(kind, raw, strict=True) if not k)]))
        twice = [_unpack5(x) for k, x in zip(kind, raw, strict=True) if k]
        found = np.concatenate([once[1:][once[1:] == once[:-1]], *twice])
        top = ta.U64(t["bucket"][0].as_py()) << ta.U64(64 - log_buckets)
        return _bit_places(top | found << ta.U64(24) >> ta.U64(log_buckets), bits)

    sent = cluster.map_batches(rows, batch, "bucket long, kind int, triggers binary")
    return _bit_table(sent.repartition(1 << log_buckets, "bucket").groupBy("bucket").applyInArrow(group, "at long, places binary"), bits)


def _join(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).astype("<u8").tobytes() for c in columns)


def _split(raw: bytes, n: int) -> list[np.ndarray]:
    return np.array_split(np.frombuffer(raw, "<u8"), n)


def _u(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.int64).view(ta.U64)


def _owned(phrase: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return ta.mix64(phrase + ta.mix64(_u(doc)) * _MIX)


def _compare_phrases(rows: DataFrame, shared, log_buckets: int) -> DataFrame:
    """kind 0: documents and phrases of theirs that a smaller document has; kind 1: phrases to look into, and their first documents."""
    n_buckets = 1 << log_buckets

    def batch(b: pa.RecordBatch) -> pa.Table:
        out = []
        for ids, _, p in _parsed(b):
            hit = shared.value.has(p.trigger)
            t, s, d = p.trigger[hit], p.phrase[hit], ids[p.text[hit]]
            order = np.lexsort((d, s, t))
            t, s, d = t[order], s[order], d[order]
            head = np.ones(len(s), bool)
            head[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            lead = d[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(d) else d
            later = np.flatnonzero(d > lead)  # known here; need not be compared again
            later = later[np.unique(_owned(s[later], d[later]), return_index=True)[1]]
            for k, (dd, ss) in _spread((ta.mix64(s[later]) >> ta.U64(64 - log_buckets)).astype(np.int64), _u(d[later]), s[later]):
                out.append((n_buckets + k, _join(dd, ss)))
            for k, (tt, ss, dd) in _spread((t[head] >> ta.U64(64 - log_buckets)).astype(np.int64), t[head], s[head], _u(d[head])):
                out.append((k, _join(tt, ss, dd)))
        return _messages(out, ["bucket", "packed"])

    def group(table: pa.Table) -> pa.Table:
        bucket, packed = table["bucket"][0].as_py(), table["packed"].to_pylist()
        if bucket >= n_buckets:
            return pa.table({"kind": pa.array([0] * len(packed), pa.int32()), "packed": pa.array(packed, pa.binary())})
        t, s, d = (np.concatenate(x) for x in zip(*(_split(x, 3) for x in packed), strict=True))
        d = d.view(np.int64)
        order = np.lexsort((d, s, t))
        t, s, d = t[order], s[order], d[order]
        head = np.ones(len(s), bool)
        head[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        later = d > d[np.flatnonzero(head)[np.cumsum(head) - 1]]
        out = [(0, _join(_u(d[later]), s[later]))]
        t, s, d = t[head], s[head], d[head]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        of, where = np.cumsum(new) - 1, np.flatnonzero(new)
        if len(d):
            differs = np.minimum.reduceat(d, where) < np.maximum.reduceat(d, where)
            out.append((1, _join(s[differs[of]], _u(d[differs[of]]))))
        return pa.table({"kind": pa.array([k for k, _ in out], pa.int32()), "packed": pa.array([x for _, x in out], pa.binary())})

    sent = cluster.map_batches(rows, batch, "bucket long, packed binary")
    return cluster.written(sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(group, "kind int, packed binary"))


#: Suffixes that are sorted at once, about.
_SORTED = 1 << 18


def equal_stretches(phrases: list[bytes], first: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Of a dictionary of phrases and their first documents: the phrase and offset of each stretch that a smaller document has.

    The suffixes of at least `match` bytes are sorted by their first `match`;
    equal neighbours form runs, whose least first document decides. They are
    sorted in parts of about _SORTED, told by their first and last bytes, so
    that a phrase-rich trigger takes no more memory than its phrases do.
    """
    size = np.array([len(x) for x in phrases], np.int64)
    n = np.maximum(size - match + 1, 0)
    text = np.frombuffer(b"".join(phrases), np.uint8)
    of = np.repeat(np.arange(len(phrases), dtype=np.int32), n)
    if not len(of):
        return of, of
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    offset, place = place.astype(np.int32), place + np.repeat(np.cumsum(size) - size, n)
    suffix = np.lib.stride_tricks.sliding_window_view(text, match)
    n_parts = -(-len(of) // _SORTED)
    part = np.zeros(len(of), np.int16)
    if n_parts > 1:
        eight = np.lib.stride_tricks.sliding_window_view(text, 8)
        key = np.ascontiguousarray(eight[place]).view("<u8").reshape(-1)
        key = ta.mix64(key) ^ np.ascontiguousarray(eight[place + match - 8]).view("<u8").reshape(-1)
        part = (ta.mix64(key) % ta.U64(n_parts)).astype(np.int16)
        del key
    found = []
    for k in range(n_parts):
        mine = np.flatnonzero(part == k) if n_parts > 1 else np.arange(len(of))
        if not len(mine):
            continue
        some = np.ascontiguousarray(suffix[place[mine]]).view(f"S{match}").reshape(-1)
        order = np.argsort(some, kind="stable")
        ranked = some[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        doc = first[of[mine[order]]]
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        found.append(mine[order[doc > least]])
    found = np.concatenate([np.zeros(0, np.int64), *found])
    return of[found], offset[found]


def _compare_stretches(rows: DataFrame, owners, log_buckets: int) -> DataFrame:
    """Packed documents, phrases, and bits of their stretches that a smaller document has in another phrase."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        out = []
        for ids, texts, p in _parsed(b):
            key = _owned(p.phrase, ids[p.text])
            hit = np.flatnonzero(owners.value.has(key))
            hit = hit[np.unique(key[hit], return_index=True)[1]]
            bucket = (p.trigger[hit] >> ta.U64(64 - log_buckets)).astype(np.int64)
            for k, (x,) in _spread(bucket, hit):
                raw = b"".join([texts.buf[i:j].tobytes() for i, j in zip(p.start[x].tolist(), p.end[x].tolist(), strict=True)])
                out.append((k, _join(p.phrase[x], _u(ids[p.text[x]]), (p.end[x] - p.start[x]).astype(ta.U64)), raw))
        return _messages(out, ["bucket", "packed", "raw"])

    def group(table: pa.Table) -> pa.Table:
        s, d, n = (np.concatenate(x) for x in zip(*(_split(x, 3) for x in table["packed"].to_pylist()), strict=True))
        raw, n, d = b"".join(table["raw"].to_pylist()), n.astype(np.int64), d.view(np.int64)
        start = np.cumsum(n) - n
        order = np.lexsort((d, s))
        order = order[np.concatenate([[True], s[order][1:] != s[order][:-1]])]  # the first document of each phrase
        of, offset = equal_stretches([raw[start[i] : start[i] + n[i]] for i in order], d[order])
        mask = np.zeros(len(order), ta.U64)
        np.bitwise_or.at(mask, of, ta.U64(1) << offset.astype(ta.U64))
        some = np.flatnonzero(mask)
        return pa.table({"packed": pa.array([_join(_u(d[order[some]]), s[order[some]], mask[some])], pa.binary())})

    sent = cluster.map_batches(rows, batch, "bucket long, packed binary, raw binary")
    return cluster.written(sent.repartition(1 << log_buckets, "bucket").groupBy("bucket").applyInArrow(group, "packed binary"))


def _bits_for(n: int) -> int:
    """Bits of a table for n hashes: at least 32 for each, up to the bound."""
    return min(_MOST_BITS, max(_LEAST_BITS, (32 * n).bit_length()))


def _bits_of(packed: DataFrame, bits: int, hashes) -> BitTable:
    def batch(b: pa.RecordBatch) -> pa.Table:
        return _bit_places(np.concatenate([np.zeros(0, ta.U64), *(hashes(x) for x in b.column(0).to_pylist())]), bits)

    return _bit_table(cluster.map_batches(packed, batch, "at long, places binary"), bits)


def _result(doc_id: pa.Array, texts: ta.Texts, covered: np.ndarray | None) -> pa.Table:
    n = np.diff(texts.offsets)
    if covered is None:
        removed = spans = np.zeros(len(n), np.int64)
    else:
        removed = texts.per_text(covered)
        spans = np.diff(np.searchsorted(texts.edges(covered)[0], texts.offsets))
    digests = []
    for i, j in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
        kept = texts.buf[i:j] if covered is None else texts.buf[i:j][~covered[i:j]]
        digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
    return pa.table({"doc_id": doc_id, "n_bytes": pa.array(n), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests, pa.string())})


def cover(ids: np.ndarray, texts: ta.Texts, whole: np.ndarray, part: np.ndarray, mask: np.ndarray, match: int = MATCH) -> np.ndarray:
    """Which bytes go: `whole` and `part` are sorted `_owned` hashes of phrases that go as a whole or by stretches."""
    p = parse(texts, match)
    key = _owned(p.phrase, ids[p.text])
    marks = np.zeros(len(texts.buf) + 1, np.int64)

    def found(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        return at, keys[at] == key if len(keys) else np.zeros(len(key), bool)

    _, all_of = found(whole)
    np.add.at(marks, p.start[all_of], 1)
    np.add.at(marks, p.end[all_of], -1)
    at, some = found(part)
    some = np.flatnonzero(some & ~all_of)
    for k in range(match - TRIGGER + 1 if len(some) else 0):
        x = some[(mask[at[some]] >> ta.U64(k) & ta.U64(1)).astype(bool)]
        np.add.at(marks, p.start[x] + k, 1)
        np.add.at(marks, p.start[x] + k + match, -1)
    return np.cumsum(marks[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer, as its order says which document keeps a passage")
    cluster.bounded_batches(spark)
    rows = docs.select("doc_id", cluster.text_or_empty().alias("text"))
    total, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (total // 8).bit_length()))
    log_buckets = max(_LEAST_BUCKETS, (total // _BUCKET).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()

    shared = spark.sparkContext.broadcast(_shared_triggers(rows, bits, log_buckets))  # 2**bits bits
    found = _compare_phrases(rows, shared, log_buckets)
    # Entries have two or three numbers of 8 bytes; tables are as large as what they hold asks for.
    n_owners = found.where("kind = 1").agg(F.coalesce(F.sum(F.octet_length("packed")), F.lit(0))).first()[0] // 16
    owners = _bits_of(found.where("kind = 1").select("packed"), _bits_for(n_owners), lambda x: _owned(*_split(x, 2)))
    owners = spark.sparkContext.broadcast(owners)
    parts = _compare_stretches(rows, owners, log_buckets + 3)  # stretches take far more memory than what is sent

    whole, part = found.where("kind = 0").select("packed"), parts
    bits = _bits_for(n_rows)
    changed = _bits_of(whole, bits, lambda x: ta.mix64(np.unique(_split(x, 2)[0])))
    changed.data |= _bits_of(part, bits, lambda x: ta.mix64(np.unique(_split(x, 3)[0]))).data
    changed = spark.sparkContext.broadcast(changed)
    groups = max(8, total // (4 * _BATCH))

    def mark_of(ids: np.ndarray) -> np.ndarray:
        return (ta.mix64(_u(ids) * _MIX) % ta.U64(groups)).astype(np.int64)

    def address(n: int):
        def batch(b: pa.RecordBatch) -> pa.Table:
            columns = [np.concatenate(x) for x in zip(*(_split(x, n) for x in b.column(0).to_pylist()), strict=True)]
            key = _owned(columns[1], columns[0].view(np.int64))
            rest = [columns[2]] if n == 3 else []
            sent = _spread(mark_of(columns[0].view(np.int64)), key, *rest)
            return pa.table({"group": pa.array([k for k, _ in sent], pa.int64()), "n": pa.array([n] * len(sent), pa.int32()), "packed": pa.array([_join(*x) for _, x in sent], pa.binary())})

        return batch

    schema = "group long, n int, packed binary"
    messages = cluster.map_batches(whole, address(2), schema).unionByName(cluster.map_batches(part, address(3), schema))

    def sort_out(wanted: bool):
        def batch(b: pa.RecordBatch) -> pa.Table:
            ids = b.column(0).cast(pa.int64()).fill_null(_NULL).to_numpy()
            hit = changed.value.has(ta.mix64(_u(ids)))
            if wanted:
                at = pa.array(np.flatnonzero(hit))
                return pa.table({"doc_id": b.column(0).take(at), "text": b.column(1).take(at), "group": pa.array(mark_of(ids[hit]), pa.int64())})
            at = pa.array(np.flatnonzero(~hit))
            return _result(b.column(0).take(at), ta.from_arrow(b.column(1).take(at)), None)

        return batch

    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    same = cluster.map_batches(rows, sort_out(False), fields)
    others = cluster.map_batches(rows, sort_out(True), f"doc_id {kind}, text string, group long")

    def finish(texts: pa.Table, marks: pa.Table) -> pa.Table:
        n, packed = marks["n"].to_pylist(), marks["packed"].to_pylist()
        none = [np.zeros(0, ta.U64)]
        whole_ = np.unique(np.concatenate(none + [np.frombuffer(x, "<u8") for k, x in zip(n, packed, strict=True) if k == 2]))
        some = [_split(x, 2) for k, x in zip(n, packed, strict=True) if k == 3]
        key, mask = np.concatenate(none + [x[0] for x in some]), np.concatenate(none + [x[1] for x in some])
        order = np.argsort(key)
        column, out = texts["text"].combine_chunks(), []
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        doc = texts["doc_id"].combine_chunks()
        ids = texts["doc_id"].cast(pa.int64()).fill_null(_NULL).to_numpy()
        for i, j in ta.slices(column):
            part_ = ta.from_arrow(column[i:j])
            out.append(_result(doc[i:j], part_, cover(ids[i:j], part_, whole_, key[order], mask[order])))
        empty = _result(doc[:0], ta.from_arrow(column[:0]), None)
        return pa.concat_tables([empty, *out])

    n = 1 << log_buckets
    done = others.repartition(n, "group").groupBy("group").cogroup(messages.repartition(n, "group").groupBy("group")).applyInArrow(finish, fields)
    return same.unionByName(done)
