"""Lexical search, collocations and vector search against plain versions, on ordinary and on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliary.llm import collocations, lexical_search, queries, vector_search
from foliary.llm import textarrays as ta
from tests.llm import brute
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    df, rows = brute.awkward(spark)
    return df.repartition(3).cache(), rows


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "embeddings")}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs) and len(ours)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the definition."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "one two THREE four"), (2, "w3x3 w4x4 one"), (3, None), (4, ""), (5, "nowhere"), (6, "café 日本語 É"), (1, "one two THREE four"), (1, "line"), (None, "two words a"), (7, "one one one line line 503")]


def test_search_of_awkward_documents(spark, odd):
    benchmark = spark.createDataFrame([(i, t, 9, 8) for i, t in ITEMS], "item_id long, text string, score int, n int")
    got = sorted((tuple(r) for r in lexical_search.rank(odd[0], benchmark).collect()), key=repr)
    assert got == ranked(odd[1], ITEMS)


def test_search_of_empty_tables(spark, odd):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.rank(odd[0].limit(0), benchmark).count() == 0
    assert lexical_search.rank(odd[0], benchmark.limit(0)).count() == 0
    assert lexical_search.rank(odd[0].where("text is null"), benchmark).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_many_blocks(spark, tables, monkeypatch):
    docs, benchmark = tables["documents"].select("doc_id", "text"), tables["benchmark"]
    whole = sorted(tuple(r) for r in lexical_search.rank(docs, benchmark).collect())
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 500)
    assert sorted(tuple(r) for r in lexical_search.rank(docs.repartition(5), benchmark).collect()) == whole


def test_stopping_early_loses_nothing(monkeypatch):
    """Shards of many sizes against complete scores, in rounds so short that items stop before their last posting."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(lexical_search, "FIRST_ROUND", 4)
    monkeypatch.setattr(lexical_search, "COMPLETED", 12)
    for _ in range(60):
        docs, size = int(rng.integers(1, 400)), int(rng.integers(1, 30))
        sets = [np.unique(np.minimum(rng.zipf(1.3, int(rng.integers(0, 20))) - 1, size - 1)) for _ in range(docs)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        held = np.concatenate(sets).astype(np.int64)
        tfs = rng.integers(1, 9, len(held)).astype(np.int64)
        shard = lexical_search.Shard(rng.integers(1, 300, docs).astype(np.int64), bounds, held, tfs, size, docs, 100 * docs)
        weight = np.zeros(size, np.int64)
        asked = np.unique(rng.integers(0, size, 6))
        weight[asked] = rng.integers(0, 9000, len(asked))
        exact = shard.completed(np.arange(docs), weight)
        for least in (1, int(exact.max(initial=1))):
            found, score = shard.best(asked, weight[asked], weight, 3, least)
            wanted = sorted((x for x in exact.tolist() if x >= least), reverse=True)[:3]
            assert (score == exact[found]).all() and sorted(score.tolist(), reverse=True)[: len(wanted)] == wanted
            assert set(np.flatnonzero((exact >= least) & (exact >= (wanted[-1] if wanted else 1)))) <= set(found.tolist())


def mined(docs, max_words=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    own = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows, longer = defaultdict(list), Counter()
    for (lang, q), b in own.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                longer[lang, q[i : i + k]] = max(longer[lang, q[i : i + k]], b)
    for (lang, p), a in own.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def test_collocations_of_awkward_documents(spark, odd):
    texts = [(None, "A b\tc  D, a B c d; x\x0by z"), (None, None), ("und", "a b c d" * 3), ("en", ""), ("en", "É é b É"), ("fr", "one two three four five. " * 12), ("fr", "three four\x00 one two " * 11)]
    rows = [(lang, text, 1) for lang, text in texts * 6] + [(r.lang, r.text, 2) for r in odd[0].collect()]
    df = spark.createDataFrame([(r[0], r[1], 3, "x", 1.0) for r in rows], "lang string, text string, f int, phrase string, n double").repartition(3)
    for options in ({}, {"max_words": 4, "least": 3, "share": 80, "top": 7}):
        got = sorted(tuple(r) for r in collocations.mine(df, **options).collect())
        assert got == mined([r[:2] for r in rows], **options)


def test_collocations_of_empty_tables(spark, odd):
    assert collocations.mine(odd[0].limit(0)).count() == 0
    assert collocations.mine(odd[0].where("text is null")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_numbers_past_64_bits(spark):
    df = spark.createDataFrame([("en", "p q r", 3_000_000_007), ("en", "p", 4_000_000_000), ("en", "q r", 3_500_000_000), ("en", "q", 4 * 10**9), ("en", "r", 4 * 10**9), ("en", "p q", 3_000_000_008)], "lang string, phrase string, a long")
    exact = {r.phrase: r.a for r in df.collect()}
    got = df.where("phrase = 'p q r'").selectExpr(f"{collocations.score('a', '4000000000', '3500000000')} as s").first().s
    assert got == 1_000_000 * exact["p q r"] ** 2 // (exact["p"] * exact["q r"])


def nearest(rows, k=5, every=50):
    held = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in held if i is not None and i % every == 0}:
        others = list(held)
        others.remove((i, list(v)))
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for j, w in others)[:k]
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(found, 1)]
    return sorted(out, key=repr)


def test_vectors_of_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, rng.gauss(0, 1))) for _ in range(6)]) for i in range(160)]
    rows += [(50, rows[50][1]), (50, rows[7][1]), (None, rows[50][1]), (None, None), (300, None), (301, [1.0, None]), (302, [float("nan")]), (350, [float("inf"), 1.0]), (400, []), (450, [0.5]), (451, [9.0] * 9), (500, [0.0] * 6), (-50, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, number int, v string").repartition(4)
    got = sorted((tuple(r) for r in vector_search.top(df).collect()), key=repr)
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == nearest(single)
    assert vector_search.top(df.limit(0)).count() == 0 and vector_search.top(df.where("vec_id = 301")).count() == 0
    few = vector_search.top(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_vectors_in_blocks(spark, tables, monkeypatch):
    whole = sorted(tuple(r) for r in vector_search.top(tables["embeddings"]).collect())
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 64 * 8 * 3)
    monkeypatch.setattr(vector_search, "SEED_ROWS", 20)
    assert sorted(tuple(r) for r in vector_search.top(tables["embeddings"].repartition(7)).collect()) == whole


def test_bounds_leave_nothing_out():
    """Shards against all products, in every number type."""
    rng = np.random.default_rng(11)
    for scale, dims in ((40, 64), (1 << 20, 7), (1 << 27, 5), (3, 1)):
        rows, asked = rng.integers(-scale, scale + 1, (500, dims)), rng.integers(-scale, scale + 1, (40, dims))
        rows[:20] = asked[:20]
        exact = asked @ rows.T
        reached = np.sort(exact, axis=1)[:, -4].astype(float)
        found = {n: dict(zip(at.tolist(), s.tolist(), strict=True)) for n, at, s in vector_search._best_of_shard(vector_search.Queries(asked), rows, reached)}
        for n in range(len(asked)):
            assert found[n] == {j: int(exact[n, j]) for j in np.flatnonzero(exact[n] >= reached[n])}


def test_products_past_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        vector_search._kind(2.0**64)


def test_terms_are_told_by_bytes():
    hashes, bounds = lexical_search.term_hashes(ta.from_strings(["Ab-c9 é", None, "ab É"]))
    assert bounds.tolist() == [0, 3, 3, 5] and hashes[0] == hashes[3] and hashes[2] != hashes[4]
