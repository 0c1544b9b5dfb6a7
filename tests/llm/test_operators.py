"""The ten operators: awkward documents, empty tables, brute force, held-out accuracy, exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import fingerprints, licenses, mixing, ngram_join, packing, pairwise_quality, pii, sharding, suffix_dedup, weak_rules
from foliary.llm import textarrays as ta
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    df, rows = brute.awkward(spark)
    return df.repartition(3).cache(), rows


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


OPERATORS = {
    1: mixing.mix, 3: pii.find, 4: weak_rules.judge, 5: licenses.scan, 6: fingerprints.fingerprint_with_edits, 7: ngram_join.join,
    8: sharding.shard, 9: suffix_dedup.remove_repeats, 10: lambda d: packing.pack(d, TOKENIZER),
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_empty_table(odd, n):
    assert OPERATORS[n](odd[0].limit(0)).count() == 0


def test_mix(odd):
    rows = mixing.mix(odd[0]).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len(brute.words(t))) for i, t in odd[1])
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(odd[0]).collect()), key=repr)


def test_mix_meets_targets(corpus):
    rows = mixing.mix(corpus[0]).collect()
    own, taken, goal = Counter(), Counter(), {}
    for r in rows:
        own[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    names = sorted(own)
    weight, total, capped = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(own.values()), set()
    while True:
        rest = total - sum(2 * own[n] for n in capped)
        free = sum(weight[n] for n in names if n not in capped)
        want = {n: 2 * own[n] if n in capped else rest * weight[n] / free for n in names}
        over = {n for n in names if want[n] > 2 * own[n]} - capped
        if not over:
            break
        capped |= over
    assert all(abs(goal[n] - want[n]) < 1e-6 * want[n] for n in names)
    assert all(abs(taken[n] - want[n]) <= 0.05 * want[n] for n in names)
    assert mixing.take(corpus[0]).count() == sum(r.copies for r in rows)


def test_mix_solves_the_dual(corpus):
    """Rates against those that bisection in plain Python finds for each source."""
    rows = mixing.mix(corpus[0]).collect()
    sizes, goal, rates = defaultdict(list), {}, {}
    for r in rows:
        sizes[r.source].append(r.size)
        goal[r.source] = r.target
        rates[r.source, r.size] = r.rate
    for name, own in sizes.items():
        mean = max(1.0, float(np.mean(own)))
        x, low, high = np.array(own, float), -1e4, 1e4
        if goal[name] >= 2 * x.sum() * (1 - 1e-12):
            assert all(rates[name, n] == 2 for n in own)
            continue
        for _ in range(200):
            middle = (low + high) / 2
            got = (np.minimum(2, np.exp(np.minimum(middle * x / mean, 50))) * x).sum()
            low, high = (middle, high) if got < goal[name] else (low, middle)
        want = np.minimum(2, np.exp(np.minimum(low * x / mean, 50)))
        assert np.abs(want - [rates[name, n] for n in own]).max() < 1e-4
        assert abs(sum(rates[name, n] * n for n in own) - goal[name]) <= 2e-6 * max(goal[name], 1)


def test_targets_in_ranges(spark):
    """Weights by code point, null last, and capped targets, whatever the number of ranges that sources are sorted in."""
    draw = random.Random(17)
    own = {f"{chr(0x41 + i % 7)}{i}é"[: draw.randint(2, 4)]: draw.randint(0, 10_000) for i in range(300)} | {None: 77, "": 5, "\U0001F600": 9, "\uffff": 3}
    df = spark.createDataFrame(list(own.items()), "source string, source_size long")
    names = sorted(own, key=lambda n: (n is None, (n or "").encode()))
    weight, capped = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, set()
    while True:
        rest = 1.5 * sum(own.values()) - sum(2 * own[n] for n in capped)
        want = {n: 2 * own[n] if n in capped else rest * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if want[n] > 2 * own[n]} - capped
        if not over:
            break
        capped |= over
    for parts in (1, 7):
        got = {r.source: r.target for r in mixing.targets(df, parts=parts).collect()}
        assert got.keys() == own.keys() and all(abs(got[n] - want[n]) <= 1e-9 * max(want[n], 1) for n in names)


def test_mix_takes_awkward_documents(odd):
    rows, taken = mixing.mix(odd[0]).collect(), Counter(r.doc_id for r in mixing.take(odd[0]).collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert taken == +want and mixing.take(odd[0]).columns == odd[0].columns


def test_mix_of_a_source_far_above_its_target(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 3 + 3000 * (i % 50 == 0))), "hot") for i in range(2000)] + [(5000 + i, "a b c", f"s{i % 40}") for i in range(80)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    hot = [r for r in rows if r.source == "hot"]
    assert abs(sum(r.rate * r.size for r in hot) - hot[0].target) <= 2e-6 * hot[0].target


def test_quality_ranking(spark, corpus):
    rows = pairwise_quality.rank_quality(corpus[0], labels(spark)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels(spark).collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) >= 0.85


def test_pairwise_fit_against_plain_ascent():
    """The weights that plain gradient ascent on the pairwise logistic likelihood comes to, and the cut at its quantile."""
    draw = np.random.default_rng(9)
    good = draw.random(120) < 0.6
    x = draw.normal(size=(120, 4)) + good[:, None] * np.array([1.0, -0.5, 0.3, 0])
    model = pairwise_quality.fit(x, good, pairs=10**6, ridge=1.0)
    z = (x - x.mean(0)) / x.std(0)
    wins, losses = np.flatnonzero(good), np.flatnonzero(~good)
    choose = np.random.default_rng(7)
    n = len(wins) * len(losses)
    first, second = np.resize(choose.permutation(wins), n), np.resize(choose.permutation(losses), n)
    choose.shuffle(second)
    w = [0.0] * 4
    for _ in range(4000):
        d = z[first] - z[second]
        p = 1 / (1 + np.exp(-(d @ np.array(w))))
        w = [w[k] + 1e-3 * (((1 - p) * d[:, k]).sum() - w[k]) / 5 for k in range(4)]
    assert np.abs(model.weight - w).max() < 1e-3
    s = z @ model.weight
    assert abs(np.mean(s < model.cut) - np.mean(~good)) < 0.02
    assert abs(model.score(x[[int(np.argmin(np.abs(s - model.cut)))]])[0] - 0.3) < 0.1


def test_quality_labels_of_held_out_documents_do_not_matter(spark, corpus):
    told = labels(spark)
    other = told.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (pairwise_quality.training_rows(corpus[0], x) for x in (told, other))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(a[0])


def test_quality_training_is_bounded_by_its_sample(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("some words here").alias("text"))
    told = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality long")
    assert len(pairwise_quality.training_rows(docs, told, 10)[0]) <= 10


def test_quality_ranking_of_awkward_documents(spark, odd):
    none = labels(spark).limit(0)
    assert pairwise_quality.rank_quality(odd[0].limit(0), labels(spark)).count() == 0
    assert {r.score for r in pairwise_quality.rank_quality(odd[0], none).collect()} == {0.5}
    model = pairwise_quality.fit(*pairwise_quality.training_rows(spark.read.parquet(f"{SF}/documents.parquet"), labels(spark)))
    rows = pairwise_quality.score(odd[0], model).collect()
    assert len(rows) == len(odd[1]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert pairwise_quality.above_quantile(pairwise_quality.score(odd[0], model), 0.5).count() >= len(rows) // 2


def test_personal_data(odd, corpus):
    for df, docs in (odd, corpus):
        want = Counter((i, hashlib.sha256(brute.joined(brute.base_spans(t)).encode()).hexdigest()) for i, t in docs)
        rows = pii.find(df).collect()
        assert Counter((r.doc_id, r.base_sha256) for r in rows) == want


def test_personal_data_patterns(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab1@.-_ +0()92é\n%45") for _ in range(draw.randint(0, 60))) for _ in range(800)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.02.255.0256", "4610568901970798 4610568901970798", "1 " * 5000, "1." * 5000, "a1@b.c " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).where("n_added = 0").collect()}
    assert all(got[i] == brute.joined(brute.base_spans(t)) for i, t in enumerate(texts) if i in got)
    assert len(got) > 700


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"please call phone: +1 (499) 555-{6000 + i} today") for i in range(40)]
    unseen = [(100, "please call phone: 499 555 1234 today"), (101, "in 1999 we saw 2001 stars")]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()}
    assert rows[100].spans == "phone:19:31" and rows[100].n_phone == 0
    assert rows[101].spans == "" and rows[0].spans == "phone:19:36"


def test_bootstrap_finds_held_out_identifiers(spark):
    """Identifiers in forms that no base pattern takes, beside words that stand beside those it takes, and numbers beside others."""
    draw, docs, truth = random.Random(12), [], {}
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    forms = {
        "phone": ("dial", lambda: f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}", lambda: f"{draw.randint(200, 999)} 555 {draw.randint(1000, 9999)}"),
        "email": ("write", lambda: f"{draw.choice(filler)}{draw.randint(1, 99)}@mail.example.com", lambda: f"{draw.choice(filler)}{draw.randint(1, 99)}@localhost"),
        "ip": ("host", lambda: f"10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.{draw.randint(0, 255)}", lambda: f"10-{draw.randint(0, 255)}-{draw.randint(0, 255)}-{draw.randint(0, 255)}"),
    }
    for i in range(1500):
        words, kind = [draw.choice(filler) for _ in range(20)], draw.choice(list(forms))
        cue, seen, unseen = forms[kind]
        at = draw.randint(2, 18)
        if i % 10 == 0:
            value = unseen()
            text = " ".join([*words[:at], cue + ":", value])
            truth[i] = f"{kind}:{len(text) - len(value)}:{len(text)}"
            docs.append((i, " ".join([text, *words[at:]])))
        elif i % 10 < 6:
            docs.append((i, " ".join([*words[:at], cue + ":", seen(), *words[at:]])))
        else:  # numbers beside other words
            docs.append((i, " ".join([*words[:at], draw.choice(["in", "page"]), unseen() if i % 10 == 6 else str(draw.randint(1, 2024)), *words[at:]])))
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {i: r.spans for i, r in rows.items() if r.n_added}
    assert sum(found.get(i) == x for i, x in truth.items()) >= 0.95 * len(truth)
    assert all(i in truth for i in found)


def test_seeds_bound_the_patterns(spark):
    flat = [(f"c{i % 5000}", f"d{i % 7}") for i in range(20_000)]
    docs = [(i, f"{a} +1 (499) 555-{1000 + i % 9000} {b}") for i, (a, b) in enumerate(flat)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.instances(pii.with_candidates(pii.with_base_spans(df)).select("doc_id", "base", "candidates"), ["doc_id"])
    assert 0 < pii.learn_patterns(found).count() <= 1 / pii.SEED_SHARE


def test_identifiers_beside_base_spans(spark):
    docs = [(i, f"please call phone: +1 (499) 555-{6000 + i} today") for i in range(40)] + [(100, "phone: 499 555 1234 a@b.co x")]
    rows = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[100] == "email:20:26,phone:7:19"


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "__may", "__key", "__body", "base", "own", "key", "body", "spans", "added", "may"]
    df = spark.createDataFrame([(1, "a@b.co here", *range(10)), (None, None, *range(10))], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == names and tuple(rows[1])[2:] == tuple(range(10)) and rows[1].text == "[EMAIL] here" and rows[None].text is None


def test_redaction(spark, odd):
    rows = {r.doc_id: r for r in pii.redact(odd[0]).collect()}
    assert rows[12].text == "[EMAIL] [IP] [PHONE] or [CARD]" and pii.redact(odd[0]).columns == odd[0].columns
    assert pii.redact(odd[0]).count() == len(odd[1])


def test_rules(odd, corpus):
    for df, docs in (odd, corpus):
        want = Counter((i, *brute.base_counts(t)) for i, t in docs)
        rows = weak_rules.judge(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
        assert weak_rules.keep(df).count() == sum(r.kept for r in rows)


def test_rules_agree_with_labels(spark, corpus):
    truth = {r.doc_id: r.quality for r in labels(spark).collect()}
    rows = [r for r in weak_rules.judge(corpus[0]).collect() if r.doc_id in truth and not r.base_failed]
    assert all(r.kept for r in rows if truth[r.doc_id])
    assert np.mean([not r.kept for r in rows if not truth[r.doc_id]] or [1]) > 0.7


def test_expectation_maximisation_raises_the_likelihood():
    draw = np.random.default_rng(1)
    votes = draw.random((64, len(weak_rules.RULES))) < 0.3
    history = weak_rules.fit(votes, draw.integers(1, 100, 64), strength=0.001).history
    assert history[-1] > history[0]


def test_expectation_maximisation_finds_the_rates():
    """Votes drawn by known rates: the fit comes back to them, without labels."""
    draw = np.random.default_rng(4)
    sound = np.array([r.vote > 0 for r in weak_rules.RULES])
    on_good, on_bad = np.where(sound, draw.uniform(0.8, 0.98, 10), draw.uniform(0.005, 0.1, 10)), np.where(sound, draw.uniform(0.1, 0.6, 10), draw.uniform(0.2, 0.9, 10))
    good = draw.random(50_000) < 0.8
    votes = draw.random((50_000, 10)) < np.where(good[:, None], on_good, on_bad)
    seen = Counter(map(tuple, votes.tolist()))
    model = weak_rules.fit(np.array(sorted(seen), float), np.array([seen[k] for k in sorted(seen)], float))
    assert np.abs(np.array(model.on_good) - on_good).max() < 0.02 and np.abs(np.array(model.on_bad) - on_bad).max() < 0.03 and abs(model.prior - 0.8) < 0.02
    assert np.mean((model.posterior(votes.astype(float)) >= 0.5) == good) > 0.97


def test_licences(spark, corpus):
    rows = {r.doc_id: r for r in licenses.scan(corpus[0]).collect()}
    told = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General", "cc": "CC BY"}
    for i, t in corpus[1]:
        assert rows[i].families == ",".join(sorted(k for k, v in told.items() if v in (t or "")))


def test_licences_of_awkward_documents(odd):
    rows = licenses.scan(odd[0]).collect()
    want = Counter((i, sum(1 for x in (t or "").split("\n") if x)) for i, t in odd[1])
    assert Counter((r.doc_id, r.n_paragraphs) for r in rows) == want and not any(r.n_licensed for r in rows)


def test_licence_training_is_held_out():
    model = licenses.train(["the cat sat on the mat", "le chat est là", "ein Haus am See"])
    texts, of = licenses._made(99, 6)
    best, _, state, _ = model.scan(ta.from_strings(texts))
    assert np.mean((best == of) & (state == 2)) > 0.9
    assert not model.scan(ta.from_strings(list(licenses.OTHER_SENSES)))[2].any()
    assert model.scan(ta.from_strings(["Licensed under the Foo Public License, version 9."]))[2].tolist() == [1]


def test_licence_windows_against_plain_python(odd, corpus):
    model = licenses.train(["the cat sat on the mat", "le chat est là", "ein Haus am See"])
    texts = [t or "" for _, t in odd[1]] + [t for _, t in corpus[1][:60]] + [" ".join(f"w{i}" for i in range(n)) + " Released under the MIT License. " + "z " * n for n in (0, 5, 12, 24, 25, 40)]
    for text in texts:
        units = brute.licence_units(text, licenses.WINDOW)
        best, sure, state, f = model.scan(ta.from_strings([text]))
        assert [(a, z) for a, z in zip(f.start.tolist(), f.end.tolist(), strict=True)] == [(a, z) for a, z, _ in units]
        for k, (_, _, piece) in list(enumerate(units))[:40]:
            alone = licenses.featurise(ta.from_strings([piece.decode()]), whole_lines=True)
            assert abs(model.probabilities(alone, len(alone.start))[0].max() - sure[k]) < 1e-6 if alone.start.size else True
            assert Counter(alone.pair.tolist()) == Counter(f.pair[f.pair_of == k].tolist())


def test_licence_training_reads_every_line(spark):
    header = "the very same header line"
    docs = [(i, f"{header}\nown words of {i}\n{header}") for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = licenses.plain_paragraphs(df, 500)
    assert len(found) == len(set(found)) == 500 and found == licenses.plain_paragraphs(df.repartition(3), 500)
    few = spark.createDataFrame(docs[:100], "doc_id long, text string")
    assert set(licenses.plain_paragraphs(few, 500)) == {header} | {f"own words of {i}" for i in range(100)}
    assert licenses.plain_paragraphs(df.select(F.lit(header).alias("text")), 500) == [header]
    assert licenses.plain_paragraphs(df.select(F.lit("Licensed to all").alias("text")), 500) == []


def test_fingerprints(odd, corpus):
    for df, docs in (odd, corpus):
        rows = fingerprints.fingerprint_with_edits(df).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
        plain = defaultdict(set)
        for r in fingerprints.fingerprint(df).collect():
            plain[r.doc_id].add(r.fingerprint)
        assert all(r.fingerprint in plain[r.doc_id] for r in rows)
    docs = sorted(docs, reverse=True)
    after = dict(zip([i for i, _ in docs], [t for _, t in docs[1:] + docs[:1]], strict=True))
    texts = dict(docs)
    assert all(r.edited_sha256 == hashlib.sha256(fingerprints.edited(texts[r.doc_id], after[r.doc_id]).encode()).hexdigest() for r in rows)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.97


def test_collision_rate_is_generalised_jaccard():
    sampler, draw = fingerprints.Sampler(4096), np.random.default_rng(5)
    term = np.sort(draw.integers(0, 1 << 63, 300, dtype=np.uint64))
    a, b = draw.integers(1, 40, 300), draw.integers(1, 40, 300)
    keep = draw.random(300) < 0.7
    got = fingerprints.likeness(sampler.signature(term, a), sampler.signature(term[keep], b[keep]))
    b = b * keep
    assert abs(got - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_join(odd, corpus):
    for df, docs in (odd, corpus):
        want = brute.near_classes(docs)
        rows = ngram_join.join(df).collect()
        assert Counter((r.doc_id, r.n_links, r.class_id, r.n_copies) for r in rows) == Counter((i, *want[t or ""]) for i, t in docs)
        kept = ngram_join.keep_one(df).collect()
        assert len(kept) == len({want[t or ""][1] for _, t in docs}) and len({r.doc_id for r in kept}) == len(kept)


def test_sketches_lose_far_less_than_the_recall_asked():
    assert ngram_join.sketch_loss(ngram_join.SIMILARITY) < 0.1 * (1 - ngram_join.RECALL)
    # Pairs at the threshold, their sketches by the binomial law: 3.6e-4 of them were dropped with a slack of 0.2.
    draw = np.random.default_rng(6)
    flips = np.packbits(draw.random((200_000, 128)) < (1 - ngram_join.SIMILARITY) / 2, axis=1).view(np.int64)
    s, n = np.concatenate([np.zeros((1, 2), np.int64), flips]), np.full(200_001, 100)
    assert ngram_join.may_match(s, n, np.array([0]), np.arange(1, 200_001), ngram_join.SIMILARITY).mean() > ngram_join.RECALL


def test_join_in_blocks(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        w[draw.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(w)))
    want = brute.near_classes(docs)
    rows, texts = ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string"), block=7)
    got = {r.doc_id: (r.links, r.class_id) for r in rows.join(texts, "key").collect()}
    assert got == {i: want[t][:2] for i, t in docs}


def test_join_keeps_classes_that_share_an_id(spark):
    def text(name, last="end"):
        return " ".join([*(f"{name}{i}" for i in range(40)), last])

    docs = [(None, text("a")), (None, text("b")), (None, text("b", "other")), (None, text("c")), (None, text("c")), (None, "")]
    docs += [(5, text("d")), (5, text("e")), (5, text("f")), (6, text("f", "other")), (7, text("e")), (5, text("d"))]
    kept = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.text.split(" ")[0] for r in kept) == ["", "a0", "b0", "c0", "d0", "e0", "f0"]
    assert all(r.doc_id == (5 if r.text[:1] in tuple("def") else None) for r in kept)


def test_shards(odd, corpus):
    for df, docs in (odd, corpus):
        rows = sharding.shard(df).collect()
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    loads, where = Counter(), defaultdict(set)
    texts = dict(docs)
    for r in rows:
        loads[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    # The largest documents go to the emptiest shards; bins of the others even out what is left.
    assert max(loads.values()) - min(loads.values()) <= max(max(r.size for r in rows), 0.02 * sum(loads.values()) / 40)
    assert np.mean([len(x) == 1 for x in where.values()]) > 0.9


def test_shards_of_a_large_group(spark):
    texts = ["x" * 84] * 1600 + [f"{i % 600:084d}" for i in range(1200)] + [f"single {i:077d}" for i in range(2000)]
    draw = random.Random(4)
    docs = list(enumerate(draw.sample(texts, len(texts))))
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text, held = dict(docs), defaultdict(Counter)
    for r in rows:
        held[text[r.doc_id]][r.shard] += 1
    # A shard holds 120 documents: 13 of the group's shards are full of it, but for what was there before it.
    group = sorted(held["x" * 84].values(), reverse=True)
    assert sum(group) == 1600 and len(group) <= 20 and sum(group[:16]) >= 0.95 * 1600
    assert np.mean([len(x) == 1 for t, x in held.items() if sum(x.values()) == 2]) > 0.9
    loads = Counter(r.shard for r in rows)
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 1


def test_shards_are_never_overfilled(spark):
    docs = [(i, f"{i % 7}" * (50 * (i % 7) + 34)) for i in range(400)]
    nodes = sharding.nodes(spark.createDataFrame(docs, "doc_id long, text string"))
    total = nodes.agg(F.sum("size")).first()[0]
    begun, loads = Counter(), Counter()
    for r in nodes.select("size", F.pmod(F.xxhash64(F.lit("start"), "rid"), F.lit(8)).alias("shard")).collect():
        begun[r.shard] += r.size
    rows = sharding.propagate(nodes, 8, total // 8).collect()
    for r in rows:
        loads[r.shard] += r.size
    assert sorted(r.doc_id for r in rows) == list(range(400)) and all(loads[s] <= max(begun[s], total // 8) for s in range(8))
    # Nothing asks to move: no shard has room for a piece of which it holds more.
    held = Counter((r.size, r.shard) for r in rows)
    for (size, s), n in held.items():
        assert not any(z == size and q != s and (m, -q) > (n, -s) and total // 8 - loads[q] >= size for (z, q), m in held.items())


def test_repeats(odd, corpus):
    for df, docs in (odd, corpus):
        want = brute.without_repeats(docs)
        rows = suffix_dedup.remove_repeats(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == Counter((docs[k][0], *v) for k, v in want.items())


def test_repeats_of_random_bytes(spark):
    draw = random.Random(8)
    pool = ["".join(draw.choice("ab") for _ in range(draw.randint(20, 90))) for _ in range(12)]
    docs = [(draw.randint(0, 25), "".join(draw.choice(pool) for _ in range(draw.randint(0, 8)))) for _ in range(60)]
    want = brute.without_repeats(docs)
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == Counter((docs[k][0], *v[1:]) for k, v in want.items())


def test_stretches_sorted_in_parts(monkeypatch):
    draw = random.Random(5)
    base = "".join(draw.choice("abc") for _ in range(76))
    phrases = [(base[: draw.randint(0, 30)] + "".join(draw.choice("ab") for _ in range(draw.randint(0, 3))) + base[draw.randint(0, 30) :]).encode()[:76] for _ in range(300)]
    first = np.array([draw.randint(0, 50) for _ in phrases])
    least = {}
    for x, d in zip(phrases, first.tolist(), strict=True):
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(least.get(x[k : k + 50], d), d)
    want = {(i, k) for i, x in enumerate(phrases) for k in range(len(x) - 49) if first[i] > least[x[k : k + 50]]}
    for n in (1 << 18, 100):
        monkeypatch.setattr(suffix_dedup, "_SORTED", n)
        of, offset = suffix_dedup.equal_stretches(phrases, first)
        assert want and set(zip(of.tolist(), offset.tolist(), strict=True)) == want


def test_repeats_ask_for_integer_ids(spark):
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_packing(odd, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for df, docs in (odd, corpus):
        want = Counter()
        for i, t in docs:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
            for piece, start in enumerate(range(0, len(ids), 2048)):
                part = ids[start : start + 2048]
                want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        rows = packing.pack(df, TOKENIZER).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048


@pytest.mark.parametrize("seed", range(20))
def test_packing_by_counts_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 37, 2048])
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 500))]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    used = defaultdict(int)
    for n, a, b, first, each, _ in packing.best_fit_decreasing(dict(Counter(lengths)), capacity):
        for rank in range(a, b):
            used[first + (rank - a) // each] += n
    assert sorted(capacity - x for x in used.values()) == sorted(rooms)


def test_tables_go_to_the_named_folder(spark):
    from foliary.llm import cluster

    assert cluster.written(spark.range(5)).count() == 5
    assert spark.range(1).select(F.lit(1)).count() == 1


def _near_copies(draw, groups, each, words=120):
    """Documents in groups around a text of their own, each with some words put in place of others."""
    docs = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(each):
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


def test_join_recall_on_many_near_pairs(spark):
    """All links of over 1,000 near pairs around the threshold, against brute force."""
    docs = _near_copies(random.Random(21), 180, 8)
    want = brute.near_classes(docs)
    assert sum(x[0] for x in want.values()) / 2 > 1000
    rows = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sum(r.n_links for r in rows) >= 0.999 * sum(want[t][0] for _, t in docs)
    assert np.mean([r.class_id == want[docs[r.doc_id][1]][1] for r in rows]) > 0.999


def test_join_of_large_buckets_in_blocks(spark):
    docs = _near_copies(random.Random(22), 3, 60)
    want = brute.near_classes(docs)
    rows, texts = ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string"), bucket=10)
    got = {r.doc_id: (r.links, r.class_id) for r in rows.join(texts, "key").collect()}
    assert got == {i: want[t][:2] for i, t in docs}


def test_buckets_of_any_size_give_the_same_clusters():
    draw = np.random.default_rng(23)
    for m in (2, 5, 16, 60):
        base = draw.integers(0, 1 << 62, (3, 2))
        s = base[draw.integers(0, 3, m)] ^ (np.int64(1) << draw.integers(0, 60, (m, 2)))
        n, stop, tail = draw.integers(90, 110, m), draw.integers(6, 9, m), draw.integers(0, 2, (m, 4)) @ (1 << np.array([24, 16, 8, 0]))
        same = lambda a, b: all((a[i] == a[j]) == (b[i] == b[j]) for i in range(m) for j in range(m))
        common = lambda i, j: next((p for p in (10, 9, 8, 7) if tail[i] >> 8 * (10 - p) == tail[j] >> 8 * (10 - p)), 6)
        root = list(range(m))
        for i in range(m):
            for j in range(i):
                if common(i, j) >= max(stop[i], stop[j]) and ngram_join.may_match(s, n, np.array([i]), np.array([j]), 0.8)[0, 0]:
                    root = [root[j] if r == root[i] else r for r in root]
        assert same(ngram_join.trie_clusters(tail, stop, s, n, 0.8, 6, 10), root)
        if m <= 16:
            assert same(ngram_join.small_clusters(np.zeros(m, int), tail, stop, s, n, 0.8, 6, 10), root)


def test_least_similarity_of_small_sets():
    for n in range(1, 40):
        own = [c / (n + m - c) for m in range(1, 60) for c in range(1, min(n, m) + 1)]
        assert abs(ngram_join.least_similarity(n, 0.8) - min(x for x in own if x >= 0.8 - 1e-12)) < 1e-12


def test_components_of_hubs_and_paths(spark):
    from foliary.llm import components

    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(7, 7)] + [(9000, 9001), (9001, 9000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5201)} | {9000: 9000, 9001: 9000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_joins_are_joins(spark):
    from foliary.llm import cluster

    left = spark.range(6000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 700)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0")
    assert sorted(map(tuple, cluster.split_join(left, right, ["k"], "n", 6000).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, cluster.split_anti_join(left, right, ["k"], "n", 6000).collect())) == sorted(map(tuple, left.join(right, "k", "left_anti").collect()))


def test_keep_one_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "key_", "rep_", "key", "rep", "own", "repeated", "n"]
    docs = [(1, "a b c d e f", *range(7)), (1, "a b c d e f", *range(7)), (2, "other words of its own here", *range(7)), (3, None, *range(7))]
    df = spark.createDataFrame(docs, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    kept = ngram_join.keep_one(df)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(set(docs))


def test_mix_of_shared_ids(spark):
    """A third of the rows without id, another third repeated as a whole: each source within two documents of its target."""
    rows = [(None, f"w{i} " * 10, "a") for i in range(1000)] + [(7, "x " * 10, "b") for _ in range(1000)] + [(i, f"w{i} " * 10, "c") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    got = mixing.mix(df).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert len(got) == 3000 and all(abs(taken[s] - goal[s]) <= 20 for s in goal)
    kept = Counter(r.source for r in mixing.take(df).collect())
    assert {s: 10 * n for s, n in kept.items()} == dict(taken)


def test_shared_ids_do_not_crowd_a_bucket(spark):
    rows = [(None if i % 3 else 5, 0, 0, 9, 1) for i in range(9000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(6)
    parts = parts.withColumn("rid", F.monotonically_increasing_id())
    ranks = packing.ranked(parts, {9: 9000}).select("bucket", "rank").collect()
    assert sorted(r.rank for r in ranks) == list(range(9000))
    assert max(Counter(r.bucket for r in ranks).values()) < 2 * 9000 / -(-9000 // packing._RANKED)


def test_keep_one_takes_the_same_row_whatever_the_partitions(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, f"s{i}", i) for i in range(30)] + [(2, text + " x", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = {tuple(ngram_join.keep_one(df.repartition(n, *c)).collect()) for n, c in ((1, ()), (5, ()), (7, ("source",)))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
