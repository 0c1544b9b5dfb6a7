"""The corpus pipeline, stage by stage, against plain versions; on awkward and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliary.llm import cluster, textstats, weak_rules
from foliary.llm import textarrays as ta
from tests.llm import brute

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key_ string, rep_ long, `__may` long, own string, copies int, size long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose, near and exact copies, junk, personal data, awkward documents; extra columns with names the operators use."""
    draw, texts = random.Random(31), []
    filler = [f"{a}{b}en" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "ai")]
    for g in range(60):
        base = [draw.choice(filler) for _ in range(draw.randint(30, 200))]
        texts.append(" ".join(base))
        if g % 3 == 0:
            texts += [texts[-1], " ".join([*base, f"end{g}"])]
        if g % 4 == 0:
            texts.append(" ".join([draw.choice(filler) for _ in range(40)]) + f" a{g}@b.co 1.2.3.{g} +1 (499) 555-65{g:02d} 4381893557741609")
        if g % 5 == 0:
            texts.append(" ".join(draw.choice(filler) + "###" for _ in range(50)))
    rows = [(i, t, "en", f"s{i % 3}", len(t), "k", i, 7, "o", 3, 9) for i, t in enumerate(texts)]
    rows += [(i and i + 1000, t, "en", None, len(t or ""), "k", 0, 7, "o", 3, 9) for i, t in brute.awkward(spark)[1]]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows that go into each stage and out of the last."""
    docs, out = cluster.documents(spark, folder), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs.collect())
        docs = cluster.written(stage(spark, docs, folder))
    return [*out, docs.collect()]


def test_stages_keep_the_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars", "key_", "rep_", "__may", "own", "copies", "size"]
        assert all(r["__may"] == 7 and r.own == "o" and r.copies == 3 and r.size == 9 for r in rows)


def test_quality_rules(stages):
    counts = textstats.count_arrow(ta.pa.array([r.text for r in stages[0]], ta.pa.string()))
    votes = weak_rules.votes(counts)
    seen = Counter(map(tuple, votes.tolist()))
    model = weak_rules.fit(np.array(sorted(seen), float), np.array([seen[k] for k in sorted(seen)], float))
    good = model.posterior(votes.astype(float)) >= 0.5
    want = Counter()
    for r, ok in zip(stages[0], good, strict=True):
        n, *_, repeated = brute.base_counts(r.text)
        if ok and n >= 10 and 100 * repeated <= 20 * n:
            want[tuple(r)] += 1
    assert Counter(map(tuple, stages[1])) == want
    assert 0 < len(stages[1]) < len(stages[0]) and not any("###" in r.text for r in stages[1])


def test_near_duplicates(stages):
    classes = brute.near_classes([(r.doc_id, r.text) for r in stages[1]])
    least = {classes[r.text][1] for r in stages[1]}
    assert Counter(r.doc_id for r in stages[2]) == Counter(least)
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in stages[1]}


def test_personal_data(stages):
    before, after = {r.doc_id: r for r in stages[2]}, {r.doc_id: r for r in stages[3]}
    assert before.keys() == after.keys() and any(brute.base_spans(r.text) for r in stages[2])
    for i, r in before.items():
        text, at = "", 0
        for a, z, kind in sorted((a, -z, k) for k, a, z in brute.base_spans(r.text)):
            if a >= at:
                text += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, -z)
        assert after[i].text == text + r.text[at:] and after[i].n_chars == len(after[i].text)


def test_source_mix(stages):
    own, times = {r.doc_id: r for r in stages[3]}, Counter(r.doc_id for r in stages[4])
    assert all(n <= 2 for n in times.values()) and {tuple(r) for r in stages[4]} <= {tuple(r) for r in stages[3]}
    size, taken = Counter(), Counter()
    for i, r in own.items():
        size[r.source] += len(brute.words(r.text))
        taken[r.source] += times[i] * len(brute.words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[n] for n in capped)
        want = {n: 2 * size[n] if n in capped else rest * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if want[n] > 2 * size[n]} - capped
        if not over:
            break
        capped |= over
    largest = max(len(brute.words(r.text)) for r in own.values())
    assert all(abs(taken[n] - want[n]) <= max(0.05 * want[n], min(largest, 200)) for n in names)


def test_packed(stages):
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(TOKENIZER), Counter()
    for r in stages[4]:
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[5]) == want
    bins = defaultdict(list)
    for r in stages[5]:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_run_is_its_stages(spark, folder, stages):
    rows = corpus_pipeline.run(spark, folder).collect()
    plain = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert plain(rows) == plain(stages[5]) and len({r.sequence_id for r in rows}) == len({r.sequence_id for r in stages[5]})


def test_empty_tables(spark, folder):
    docs = cluster.documents(spark, folder).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_stage_bears_awkward_documents(spark):
    df, rows = brute.awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "").collect()
        if name == "personal_data":
            assert len(out) == len(rows)
        if name in ("near_duplicates", "packed"):
            assert {r.doc_id for r in out} >= {1, 3, 4, 5, 6, 9} if name == "packed" else {4, 5, 6, 9}
