"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of word 5-grams. A forest of tries holds, for every distinct
text, one label of LABEL minimum hashes for each tree. Labels are sorted, so
texts that share a prefix stand together. Matched prefixes are shortened from
the whole label on, text by text, until pairs at the threshold are found with
the target recall: prefixes of length p in L trees find a pair of similarity s
with 1 - (1 - s^p)^L, and s is at least what a set of that many n-grams can
have at the threshold or above (sets of few n-grams stop early, as 4 of 5 is
the next below 5 of 6). Texts under a common prefix that both still go by are
compared by 128-bit sketches, those already in one cluster by a longer prefix
not again, and those that may be similar link into candidate clusters. Within
each cluster all pairs are then verified exactly, in blocks, on the sets themselves.

Scale: equal texts are one node from the start, so copies cost nothing. What is
shuffled is a label a tree and the sets of texts in candidate clusters, which a
bit table of fixed size picks in a second pass over the texts. Pairs are never
rows: blocks give counts of links and a spanning forest, linear in their size.
A task holds at most BUCKET texts of a shortest prefix; more are passed on in
blocks and dealt out by pairs of blocks, as large clusters are for verification.
Joins on what many rows may share split off the hot keys (cluster.split_join).
Components come from joins; no links or labels reach the driver.

Edge cases: a text of one to four words is a single n-gram; null and empty
texts and those without words have none and are linked to no text but are of
one class with their equals (null counts as empty); class_id is the least
doc_id of its class (null if all are null); repeated rows are copies, of which
`keep_one` keeps one; `join` ignores other columns, `keep_one` returns them,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta
from foliary.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TREES = 32
LABEL = 10
RECALL = 0.9999
#: Texts of one block; two blocks at most meet in a task.
BLOCK = 400
#: Texts of a shortest prefix, or of a block of them, that a task holds.
BUCKET = 4096
#: Buckets up to this size are compared all at once.
_SMALL = 16
#: Sets up to this size have their own least similarity.
_FEW = 100
#: Estimates may fall short of the threshold by this much before a pair is dropped unverified.
SLACK = 0.3
_BITS = 1 << 24
_SKETCH = 128


def sketch_loss(similarity: float) -> float:
    """The part of pairs at `similarity` whose sketches fall short of it by more than SLACK: a tail of the binomial law."""
    differ = (1 - similarity) / 2
    most = math.floor((1 - similarity + SLACK) * _SKETCH / 2 + 1e-9)
    return sum(math.comb(_SKETCH, k) * differ**k * (1 - differ) ** (_SKETCH - k) for k in range(most + 1, _SKETCH + 1))


def depth_for(recall: float, similarity: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix whose recall at `similarity`, less what sketches lose, reaches `recall`; 1 if none does."""
    p, lost = label, sketch_loss(similarity)
    while p > 1 and 1 - (1 - similarity**p) ** trees - lost < recall:
        p -= 1
    return p


def least_similarity(n: int, similarity: float) -> float:
    """The least similarity, from `similarity` on, that a set of n can have to any other set; 1 if there is none below."""
    found = 1.0
    for m in range(1, math.floor(n / similarity + 1e-9) + 1):
        common = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)  # c / (n + m - c) reaches the threshold from here on
        if common <= min(n, m):
            found = min(found, common / (n + m - common))
    return found


def depths(recall: float, similarity: float, trees: int = TREES, label: int = LABEL) -> np.ndarray:
    """By size of a set, up to _FEW (that stands for all above): the prefix length to which it is shortened."""
    own = [label, *(depth_for(recall, least_similarity(n, similarity), trees, label) for n in range(1, _FEW))]
    return np.array([*own, depth_for(recall, similarity, trees, label)], np.int64)


class Forest:
    """Labels of all trees and sketches of sets of shingles. A label is its shortest prefix (head) and the digits after it (tail)."""

    def __init__(self, trees: int, floor: int, label: int, seed: int = 97) -> None:
        self.trees, self.floor, self.label = trees, floor, label
        n = max(trees * label, _SKETCH)
        draw = np.random.default_rng(seed)
        self.times = draw.integers(0, 1 << 63, n, dtype=np.uint64) * ta.U64(2) + ta.U64(1)
        self.plus = draw.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(shingles), 1024):
            part = (shingles[i : i + 1024, None] * self.times + self.plus).min(0)
            low = part if low is None else np.minimum(low, part)
        return low

    def describe(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Head (a hash of tree and digits) and tail (digits of a byte, the first uppermost) of each tree's label, and the sketch as two words."""
        low = ta.mix64(self.minima(shingles))
        digits = low[: self.trees * self.label].reshape(self.trees, self.label)
        head = np.arange(1, self.trees + 1, dtype=ta.U64)
        for i in range(self.floor):
            head = head * ta.U64(0x9E3779B97F4A7C15) + digits[:, i]
        tail = np.zeros(self.trees, np.int64)
        for i in range(self.floor, self.label):
            tail = tail << 8 | (digits[:, i] >> ta.U64(56)).astype(np.int64)
        bits = (low[:_SKETCH] & ta.U64(1)).astype(np.uint8)
        return ta.mix64(head).view(np.int64), tail, np.packbits(bits).view(np.int64)


def shape(recall: float, similarity: float) -> tuple[int, int]:
    """(shortest prefix of any text, length of labels); tails hold seven digits at most."""
    floor = depth_for(recall, similarity)
    return floor, min(LABEL, floor + 7)


def _key(text):
    return F.unhex(F.md5(text))


def describe(docs: DataFrame, floor: int, label: int, trees: int = TREES) -> DataFrame:
    """doc_id, key of the text, n (its shingles), heads and tails of its labels, sketch words s1 and s2; n = 0 has none of these."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        forest, n, heads, tails, sketches = Forest(trees, floor, label), [], [], [], []
        none = np.zeros(0, np.int64)
        for i, j in ta.slices(b.column(2)):
            for s in ta.shingle_sets(ta.from_arrow(b.column(2)[i:j]), WORDS):
                n.append(len(s))
                h, t, k = forest.describe(s) if len(s) else (none, none, np.zeros(2, np.int64))
                heads.append(h)
                tails.append(t)
                sketches.append(k)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in heads])]).astype(np.int32))
        sketch = np.array(sketches, np.int64).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (heads, tails)]
        return pa.table({"doc_id": b.column(0), "key": b.column(1), "n": pa.array(n, pa.int64()), "heads": lists[0], "tails": lists[1], "s1": pa.array(sketch[:, 0]), "s2": pa.array(sketch[:, 1])})

    text = cluster.text_or_empty()
    rows = docs.select("doc_id", _key(text).alias("key"), text.alias("text"))
    return cluster.map_batches(rows, batch, f"doc_id {kind}, key binary, n long, heads array<long>, tails array<long>, s1 long, s2 long")


def _alike(s: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts a and b (indices that broadcast) may be similar, by sketch and by size."""
    differ = np.bitwise_count(s[a] ^ s[b]).sum(-1, dtype=np.int64)
    estimate = 1 - 2 * differ / _SKETCH  # bits agree with probability (1 + similarity) / 2
    return (estimate >= similarity - SLACK - 1e-9) & (np.minimum(n[a], n[b]) >= (similarity - 1e-9) * np.maximum(n[a], n[b]))


def may_match(s: np.ndarray, n: np.ndarray, at: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of `others` may be as similar to each of `at`, by sketch and by size."""
    return _alike(s.astype(np.uint64), n, at[:, None], others[None, :], similarity)  # of signed numbers the bits of absolute values would count


def _merge(label: np.ndarray, members: np.ndarray, s: np.ndarray, n: np.ndarray, similarity: float) -> None:
    """Merges the clusters in `label` (each the index of a member of it) of `members` that a link of `may_match` joins.

    A member of the largest cluster is held against all others first, so a
    bucket of near copies takes one pass; then the smaller clusters against the rest.
    """
    tried: set[int] = set()
    while True:
        heads, size = np.unique(label[members], return_counts=True)
        open_ = [h for h in heads[np.argsort(-size, kind="stable")].tolist() if h not in tried]
        if not open_ or len(heads) == 1:
            break
        first = members[np.flatnonzero(label[members] == open_[0])[:1]]
        tried.add(open_[0])
        others = members[label[members] != open_[0]]
        met = np.unique(label[others[may_match(s, n, first, others, similarity)[0]]])
        label[np.isin(label, met)] = open_[0]
        if size.max() == 1 and not len(met) and len(tried) > 64:  # nothing is alike here; the rest is compared below anyway
            break
    heads, size = np.unique(label[members], return_counts=True)
    for head in heads[np.argsort(size, kind="stable")][:-1]:
        mine = label[members] == label[head]
        own, others = members[mine], members[~mine]
        for i in range(0, len(own), 64):
            for j in range(0, len(others), 4096):
                met = others[j : j + 4096][may_match(s, n, own[i : i + 64], others[j : j + 4096], similarity).any(0)]
                met = np.unique(label[met])
                label[np.isin(label, met)] = label[head]


def trie_clusters(tail: np.ndarray, stop: np.ndarray, s: np.ndarray, n: np.ndarray, similarity: float, floor: int, label: int) -> np.ndarray:
    """For each text of a bucket (texts of one head) the index of one of its cluster.

    Prefixes are shortened from the whole label to `floor`; at each length the
    texts that go by it and share it are held against those of other clusters.
    """
    cluster_of = np.arange(len(n))
    for p in range(label, floor - 1, -1):
        on = np.flatnonzero(stop <= p)
        prefix = tail[on] >> (8 * (label - p))
        on = on[np.argsort(prefix, kind="stable")]
        prefix = tail[on] >> (8 * (label - p))
        cut = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(on)]])
        for k in np.flatnonzero(np.diff(cut) > 1):
            members = on[cut[k] : cut[k + 1]]
            if (cluster_of[members] != cluster_of[members[0]]).any():
                _merge(cluster_of, members, s, n, similarity)
    return cluster_of


def small_clusters(head: np.ndarray, tail: np.ndarray, stop: np.ndarray, s: np.ndarray, n: np.ndarray, similarity: float, floor: int, label: int) -> np.ndarray:
    """The same for many buckets of at most _SMALL texts at once; `head` is sorted."""
    a, b = [], []
    for step in range(1, _SMALL):
        at = np.flatnonzero(head[step:] == head[:-step])
        if not len(at):
            break
        a.append(at)
        b.append(at + step)
    out = np.arange(len(head))
    if not a:
        return out
    a, b = np.concatenate(a), np.concatenate(b)
    common = np.full(len(a), floor)
    for p in range(floor + 1, label + 1):
        common[tail[a] >> (8 * (label - p)) == tail[b] >> (8 * (label - p))] = p
    hit = (common >= np.maximum(stop[a], stop[b])) & _alike(s.astype(np.uint64), n, a, b, similarity)
    a, b = a[hit], b[hit]
    while True:
        low = np.minimum(out[a], out[b])
        before = out.copy()
        np.minimum.at(out, a, low)
        np.minimum.at(out, b, low)
        out = out[out]
        if (out == before).all():
            return out


_WALKED = "a long, b long, n long, s1 long, s2 long, head long, tail long, block long"


def candidate_edges(nodes: DataFrame, recall: float, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b between texts under a common prefix that may be similar: a spanning forest of each bucket."""
    floor, label = shape(recall, similarity)
    stops = depths(recall, similarity, label=label)
    rows = nodes.where("n > 0").select("node", "n", "s1", "s2", F.explode(F.arrays_zip("heads", "tails")).alias("x"))
    rows = rows.select("node", "n", "s1", "s2", F.col("x.heads").alias("head"), F.col("x.tails").alias("tail"))
    rows = rows.repartition("head").sortWithinPartitions("head", "tail", "node")

    def stop_of(x: np.ndarray) -> np.ndarray:
        return stops[np.minimum(x[:, 1], _FEW)]

    def linked(x: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.flatnonzero(clusters != np.arange(len(x)))
        return x[far, 0], x[clusters[far], 0]

    def edges_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return linked(x, trie_clusters(x[:, 5], stop_of(x), x[:, 2:4], x[:, 1], similarity, floor, label))

    def made(a: list[np.ndarray], b: list[np.ndarray], rest: np.ndarray | None = None, block: int = 0) -> pa.RecordBatch:
        """Edges, and rows of a bucket that is too large, in a block."""
        rest = np.zeros((0, 6), np.int64) if rest is None else rest
        first, second = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        blank = [None] * len(first)
        columns = [np.concatenate([first, rest[:, 0]]), pa.array([*second.tolist(), *[None] * len(rest)], pa.int64())]
        columns += [pa.array([*blank, *rest[:, k].tolist()], pa.int64()) for k in range(1, 6)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array([*blank, *[block] * len(rest)], pa.int64())], ["a", "b", "n", "s1", "s2", "head", "tail", "block"])

    def walk(batches):
        held, block = np.zeros((0, 6), np.int64), 0  # rows of the last head; blocks of it that were passed on

        def whole(x: np.ndarray):
            """Edges of complete buckets."""
            cut = np.concatenate([[0], np.flatnonzero(x[1:, 4] != x[:-1, 4]) + 1, [len(x)]])
            size = np.diff(cut)
            few = np.repeat((size > 1) & (size <= _SMALL), size)
            y = x[few]
            a, b = linked(y, small_clusters(y[:, 4], y[:, 5], stop_of(y), y[:, 2:4], y[:, 1], similarity, floor, label))
            more = [edges_of(x[cut[i] : cut[i + 1]]) for i in np.flatnonzero(size > _SMALL)]
            return made([a, *(e[0] for e in more)], [b, *(e[1] for e in more)])

        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns])
            while len(x):
                last = int(np.searchsorted(x[:, 4], x[-1, 4]))
                if len(held) and held[-1, 4] != x[0, 4]:
                    yield made([], [], held, block) if block else whole(held)
                    held, block = x[:0], 0
                if last and not len(held):
                    yield whole(x[:last])
                    x = x[last:]
                    continue
                own = int(np.searchsorted(x[:, 4], x[0, 4], "right"))
                held, x = np.concatenate([held, x[:own]]), x[own:]
                while len(held) > bucket:
                    yield made([], [], held[:bucket], block)
                    held, block = held[bucket:], block + 1
        if len(held):
            yield made([], [], held, block) if block else whole(held)

    walked = cluster.written(rows.mapInArrow(walk, _WALKED))
    edges = walked.where("block is null").select("a", "b")
    large = walked.where("block is not null")
    blocks = large.groupBy("head").agg((F.max("block") + 1).alias("blocks"))
    if not blocks.head(1):
        return edges
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))).alias("pair")
    met = large.join(blocks, "head").select("a", "n", "s1", "s2", "head", "tail", pair).select("a", "n", "s1", "s2", "head", "tail", "pair.i", "pair.j")

    def group(t: pa.Table) -> pa.Table:
        x = np.column_stack([t[c].to_numpy() for c in ("a", "n", "s1", "s2", "head", "tail")])
        a, b = edges_of(x[np.unique(x[:, 0], return_index=True)[1]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges.unionByName(met.groupBy("head", "i", "j").applyInArrow(group, "a long, b long"))


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits set at column h modulo _BITS, as bytes; at most _BITS / 64 rows come to the driver."""
    at = F.pmod("h", F.lit(_BITS))
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {_BITS}) % 64 as int))")).alias("v")).toArrow()
    table = np.zeros(_BITS // 64, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    return table


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """`members` (node, key, rep and others) with their shingles, from a second pass over the texts."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_bit_table(members.select(F.xxhash64("key", "rep").alias("h"))))  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table | None:
        h = b.column(3).to_numpy() % _BITS
        hit = np.flatnonzero((table.value[h >> 6] >> (h & 63)) & 1)
        if not len(hit):
            return None
        b = b.take(pa.array(hit))
        sets = [s.tobytes() for i, j in ta.slices(b.column(2)) for s in ta.shingle_sets(ta.from_arrow(b.column(2)[i:j]), WORDS)]
        return pa.table({"rep": b.column(0), "key": b.column(1), "shingles": pa.array(sets, pa.binary())})

    text = cluster.text_or_empty()
    rows = docs.select("doc_id", _key(text).alias("key"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("key", "doc_id"))
    found = cluster.map_batches(rows, batch, f"rep {kind}, key binary, shingles binary").withColumnRenamed("rep", "rep_").withColumnRenamed("key", "key_")
    return members.join(found, (F.col("key") == F.col("key_")) & F.col("rep").eqNullSafe(F.col("rep_"))).drop("key_", "rep_")


def similar_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each of `left` (indices of sets) is at least as similar as asked to each of `right`, exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    _, term, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[term] > 1
    of, term = of[shared], np.cumsum(n > 1)[term[shared]] - 1
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(term, kind="stable")
    of, term = of[order], term[order]
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for begin in range(0, int(term[-1]) + 1 if len(term) else 0, 4096):
        i, j = np.searchsorted(term, [begin, begin + 4096])
        wide = min(4096, int(term[-1]) + 1 - begin)
        a, b = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        for place, m in ((place_l, a), (place_r, b)):
            row = place[of[i:j]]
            m[row[row >= 0], term[i:j][row >= 0] - begin] = 1
        common += a @ b.T
    union = size[left][:, None] + size[right][None, :] - common
    return common >= (similarity - 1e-9) * union


def verify(members: DataFrame, similarity: float) -> DataFrame:
    """Rows node, links and rows node, other: exact numbers of links and a spanning forest, by blocks of clusters.

    `members` has node, component, block, blocks and shingles.
    """
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = members.select("node", "component", "block", "shingles", F.explode(pair).alias("pair")).select("node", "component", "block", "shingles", "pair.i", "pair.j")

    def group(table: pa.Table) -> pa.Table:
        node, first = np.unique(table["node"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = {"node": [], "other": [], "links": []}
        if len(left) and len(right):
            alike = similar_counts(sets, left, right, similarity)
            if i == j:
                np.fill_diagonal(alike, False)
            counts = np.zeros(len(node), np.int64)
            counts[left] += alike.sum(1)
            if i != j:
                counts[right] += alike.sum(0)
            some = np.flatnonzero(counts)
            # A forest: the first link of each text on either side, then links between what is still apart.
            root = np.arange(len(node))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            a, b = [], []
            for x in range(len(left)):
                for y in np.flatnonzero(alike[x]):
                    p, q = find(left[x]), find(right[y])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(left[x])
                        b.append(right[y])
            out["node"] = np.concatenate([node[some], node[np.array(a, int)]])
            out["other"] = pa.array([*[None] * len(some), *node[np.array(b, int)].tolist()], pa.int64())
            out["links"] = np.concatenate([counts[some], np.zeros(len(a), np.int64)])
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return rows.groupBy("component", "i", "j").applyInArrow(group, "node long, other long, links long")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key; texts: key, rep, copies, class_id, links, class_texts, component)."""
    cluster.bounded_batches(docs.sparkSession)
    described = cluster.written(describe(docs, *shape(recall, similarity)))
    same = F.any_value
    texts = described.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(same(c).alias(c) for c in ("n", "heads", "tails", "s1", "s2")))
    texts = cluster.written(texts.withColumn("node", F.monotonically_increasing_id()))
    loose = cluster.written(components(candidate_edges(texts, recall, similarity, bucket)))
    blocks = loose.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = cluster.split_join(loose, blocks, ["component"], "size", loose.count()).drop("size")
    members = texts.select("node", "key", "rep").join(dealt, "node")
    members = cluster.written(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    checked = cluster.written(verify(_sets(docs, members), similarity))
    linked = checked.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    grouped = cluster.written(components(checked.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    named = texts.select("node", "rep").join(grouped, "node")
    names = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("class_texts"))
    inside = cluster.split_join(grouped, names, ["component"], "class_texts", grouped.count())
    inside = inside.join(linked, "node", "left").select("node", "component", "class_id", "links", "class_texts")
    out = texts.select("node", "key", "rep", "copies").join(inside, "node", "left")
    out = out.select(
        "key", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_texts", F.lit(1)).alias("class_texts"),
        F.coalesce("component", "node").alias("component"),
    )
    return described.select("doc_id", "key"), cluster.written(out)


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row per document: doc_id, class_id, n_links (different texts as similar), n_copies and n_texts of its class."""
    rows, texts = classes(docs, similarity, recall)
    return cluster.split_join(rows, texts, ["key"], "copies", rows.count()).select(
        "doc_id", "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"), F.col("class_texts").alias("n_texts")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The document of least doc_id of each class, with all its columns.

    Classes are told by component, as class_id may be null or that of another
    class too. Columns travel in a struct, so their names clash with none used
    here. Of rows that share id and text the one of least hash stays, whatever
    the partitions; only those are compared as a whole.
    """
    rows, texts = classes(docs, similarity, recall)
    chosen = texts.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min(F.struct("rep", "key")).alias("x"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = chosen.select(F.col("x.key").alias("key"), name("x.rep").alias("rep"))
    repeated = rows.groupBy("key", name("doc_id").alias("rep")).agg(F.count("*").alias("n")).where("n > 1")
    chosen = cluster.written(chosen.join(repeated, ["key", "rep"], "left").withColumn("repeated", F.col("n").isNotNull()).drop("n"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    packed = docs.select(own, _key(cluster.text_or_empty()).alias("key"), name("doc_id").alias("rep"))
    once = packed.join(chosen.where("not repeated"), ["key", "rep"], "left_semi").select("own")
    first = packed.join(chosen.where("repeated"), ["key", "rep"], "left_semi").groupBy("key", "rep").agg(F.min_by("own", F.struct(F.xxhash64(F.to_json("own")), F.to_json("own"))).alias("own")).select("own")
    return once.unionByName(first).select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns))
