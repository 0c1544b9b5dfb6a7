"""Licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text; lines of more than WINDOW words are scored
by windows of so many, which overlap by half. Their features are hashed words
and pairs of neighbouring words, their classes licence families and `none`, and
their model is a multinomial logistic regression with sparse inputs, trained
here on paragraphs made from short templates (whole, cut, with words put in,
and within other text) and on paragraphs that are no licences: a bounded sample
of the corpus that holds none of the templates' tell-tale words, and the same
words in other senses. Two confidences are set on paragraphs that were not
trained on: that of a family, from made ones, and that of any licence at all,
from the corpus; what has the second but not the first is `unknown`. A family
only counts if the paragraph shares enough word pairs with its templates.

Scale: two passes over the texts find the sample: the SAMPLE least hashes of
all pieces of at most WINDOW words and PIECE_BYTES bytes, whatever line of
whatever document they are in, each distinct piece counted once; tasks send
hashes alone, which are merged in two steps, and then the pieces chosen. A
third pass scans. Texts are never shuffled.

Edge cases: null and empty texts have no paragraph; lines without words count
as paragraphs of no class; repeated rows get equal results, and equal pieces
are one piece of the sample; columns besides doc_id and text are ignored; an
empty table gives an empty result and the model of the templates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

#: Templates of licence families, fixed values: how notices of well-known public licences are worded.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Sentences with licences' words that grant none, fixed values.
OTHER_SENSES = (
    "The driver renewed a license at the office.",
    "Permission to enter was granted to every person.",
    "The general public may use the software in the library free of charge.",
    "They released a version under another name.",
    "A copy of the file is at the source.",
    "Creative people work in common rooms.",
    "The Apache are a people of the plains.",
    "All terms and conditions of the lease are met.",
)
NONE = "none"
FAMILIES = (*TEMPLATES, NONE)
#: Pieces of the corpus to train on, at most, and how long they may be.
SAMPLE = 2_000
PIECE_BYTES = 4_096
#: Words up to which a line is scored as a whole, and of a window of a longer one.
WINDOW = 24
_BUCKETS = 1 << 18
_TELLTALE = re.compile(rb"licen|copyright|permission|redistribut|warrant", re.IGNORECASE)
#: Bytes as they count for words: letters and digits in lower case, all else a space.
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalnum():
        _FOLD[_b] = ord(_c.lower()) if _b < 128 else _b


@dataclass
class Features:
    """Feature buckets end to end, their unit (a line, or a window of a long one), and each unit's start, end, text and line."""

    bucket: np.ndarray
    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    line: np.ndarray
    line_text: np.ndarray  # the text of each line
    pair: np.ndarray  # hash of each pair of words
    pair_of: np.ndarray


def _lines(texts: ta.Texts):
    """Starts and ends of lines and words, each word's line and place in it, hashes of words."""
    start, end = texts.edges(texts.buf != 10)
    folded = ta.Texts(_FOLD[texts.buf], texts.offsets)
    ws, we, _ = ta.words(folded)
    line = np.searchsorted(start, ws, "right") - 1 if len(start) else np.zeros(0, np.int64)
    n_words = np.bincount(line, minlength=len(start))
    place = np.arange(len(ws)) - (np.cumsum(n_words) - n_words)[line]
    return start, end, ws, we, line, place, n_words, ta.hash_runs(folded.buf, ws, we)


def featurise(texts: ta.Texts, whole_lines: bool = False) -> Features:
    """Words and word pairs of all lines, or of the windows of long ones."""
    start, end, ws, we, line, place, n_words, h = _lines(texts)
    window = max(WINDOW, int(n_words.max(initial=0))) if whole_lines else WINDOW
    half = -(-window // 2)
    units = np.where(n_words > window, -(-(n_words - window) // half) + 1, 1)
    base = np.cumsum(units) - units
    of_line = np.repeat(np.arange(len(start)), units)
    # A word is in the window that begins in its half of WINDOW words, and in the one before.
    late, early = place // half, place // half - 1
    in_late, in_early = late < units[line], early >= 0
    pair = ta.mix64(h[:-1] * ta.U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    together = np.flatnonzero(line[1:] == line[:-1]) if len(h) else np.zeros(0, np.int64)
    pair, at = pair[together], together + 1
    whole = in_late[at] & (place[at] % half > 0)  # its first word is in that window too
    pair_of = np.concatenate([(base[line] + late)[at][whole], (base[line] + early)[at][in_early[at]]])
    pair = np.concatenate([pair[whole], pair[in_early[at]]])
    of = np.concatenate([(base[line] + late)[in_late], (base[line] + early)[in_early]])
    bucket = np.concatenate([h[in_late], h[in_early], pair]) >> ta.U64(46)
    # A window goes from its first word to its last; a line is taken whole.
    first = (np.cumsum(n_words) - n_words)[of_line] + (np.arange(len(of_line)) - base[of_line]) * half
    last = np.minimum(first + window, np.cumsum(n_words)[of_line]) - 1
    long = units[of_line] > 1
    begins, ends = start[of_line], end[of_line]
    begins[long], ends[long] = ws[first[long]], we[last[long]]
    line_text = np.searchsorted(texts.offsets, start, "right") - 1
    return Features(bucket.astype(np.int64), np.concatenate([of, pair_of]), begins, ends, line_text[of_line], of_line, line_text, pair, pair_of)


@dataclass
class Scanner:
    weight: np.ndarray  # buckets by families
    bias: np.ndarray
    threshold: float  # confidence in a family
    licensed: float  # confidence in any licence
    overlap: float
    pairs: dict[str, list[np.ndarray]]  # of each template

    def probabilities(self, f: Features, n: int) -> np.ndarray:
        """Paragraphs by families. The score is a mean over features, so length does not sway it."""
        score = np.column_stack([np.bincount(f.of, self.weight[f.bucket, k], n) for k in range(len(FAMILIES))])
        score = score / np.sqrt(np.maximum(np.bincount(f.of, minlength=n), 1))[:, None] + self.bias
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def confirmed(self, family: str, f: Features, n: int) -> np.ndarray:
        """Which units share much with a template: a good part of the unit, five pairs, or nearly the whole template."""
        templates = self.pairs[family]
        mine = np.flatnonzero(np.isin(f.pair, np.concatenate(templates)))
        pair, of = f.pair[mine], f.pair_of[mine]
        known = np.bincount(of, minlength=n)
        found = (known >= self.overlap * np.maximum(np.bincount(f.pair_of, minlength=n), 1)) & (known > 0) | (known >= 5)
        for t in templates:
            at = np.searchsorted(t, pair)
            at[at == len(t)] = 0
            hit = t[at] == pair
            held = np.unique(of[hit] * np.int64(len(t)) + at[hit]) // len(t)
            found |= np.bincount(held, minlength=n) >= max(3, 0.75 * len(t))
        return found

    def scan(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, Features]:
        """For each unit its likeliest family, confidence, and state: 0 none, 1 unknown, 2 confirmed."""
        f = featurise(texts)
        n = len(f.start)
        if not n:
            none = np.zeros(0, np.int64)
            return none, np.zeros(0), none, f
        p = self.probabilities(f, n)
        best = p.argmax(1)
        sure = p[np.arange(n), best]
        state = (1 - p[:, -1] >= self.licensed).astype(np.int64)
        for k, family in enumerate(TEMPLATES):
            if (best == k).any():
                state[(best == k) & (sure >= self.threshold) & self.confirmed(family, f, n)] = 2
        return best, sure, state, f


def _made(seed: int, copies: int, plain: Sequence[str] = ()) -> tuple[list[str], list[int]]:
    """Paragraphs from the templates: whole, cut at either end, with other words put in; if there are plain ones, each third within one."""
    draw = np.random.default_rng(seed)
    texts, of = [], []
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = template.split()
            for c in range(copies):
                w = list(words)
                if c % 3 == 1 and len(w) > 5:
                    a = int(draw.integers(0, max(1, len(w) // 4)))
                    w = w[a : len(w) - int(draw.integers(0, max(1, len(w) // 4)))]
                if c % 3 == 2:
                    for _ in range(max(1, len(w) // 8)):
                        w.insert(int(draw.integers(0, len(w))), ["this", "file", "here", "code", "2024", "work"][int(draw.integers(0, 6))])
                if len(plain) and c % 9 in (0, 4, 8):
                    other = plain[int(draw.integers(0, len(plain)))].split()
                    room, cut = max(0, WINDOW - len(w)), int(draw.integers(0, len(other) + 1))
                    w = (other[:cut] + w + other[cut:])[max(0, cut - room) :][:WINDOW]
                texts.append(" ".join(w))
                of.append(k)
    return texts, of


def train(plain: list[str], overlap: float = 0.4, steps: int = 150, seed: int = 11) -> Scanner:
    """Logistic regression on made paragraphs and on `plain`, those of the corpus that are no licences; a fifth of these calibrates."""
    kept, plain = plain[::5], [t for i, t in enumerate(plain) if i % 5]
    made, of = _made(seed, 27, plain)
    others = [*OTHER_SENSES * 12, *plain]
    texts, label = made + others, np.array(of + [len(FAMILIES) - 1] * len(others))
    f = featurise(ta.from_strings([" ".join(t.split()) or "-" for t in texts]), whole_lines=True)
    n, scale = len(texts), 1 / np.sqrt(np.maximum(np.bincount(f.of, minlength=len(texts)), 1))
    used, at = np.unique(f.bucket, return_inverse=True)
    value = scale[f.of]
    w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    cost = np.where(label == len(FAMILIES) - 1, len(made) / max(1, len(others)), 1.0)[:, None]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    target = np.eye(len(FAMILIES))[label]
    for _ in range(steps):
        score = np.column_stack([np.bincount(f.of, w[at, k] * value, n) for k in range(w.shape[1])]) + b
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (target - p) * cost / cost.sum()
        g = np.column_stack([np.bincount(at, d[f.of, k] * value, len(used)) for k in range(w.shape[1])]) - 1e-5 * w
        speed_w, speed_b = 0.9 * speed_w + g, 0.9 * speed_b + d.sum(0)
        w, b = w + 10 * speed_w, b + speed_b
    weight = np.zeros((_BUCKETS, len(FAMILIES)), np.float32)
    weight[used] = w
    pairs = {k: [np.unique(featurise(ta.from_strings([t]), whole_lines=True).pair) for t in v] for k, v in TEMPLATES.items()}
    scanner = Scanner(weight, b, 0.5, 0.5, overlap, pairs)

    def unseen(texts: list[str]) -> np.ndarray:
        g = featurise(ta.from_strings([" ".join(t.split()) or "-" for t in texts]), whole_lines=True)
        return scanner.probabilities(g, len(texts))

    # Calibration: the confidence that 98 % of unseen made paragraphs reach in their own family,
    fresh, of = _made(seed + 1, 9, kept)
    p = unseen(fresh)
    own = p[np.arange(len(fresh)), of][p.argmax(1) == np.array(of)]
    scanner.threshold = float(np.clip(np.quantile(own, 0.02), 0.3, 0.9))
    # and the confidence in any licence that 0.2 % of unseen plain paragraphs reach.
    scanner.licensed = float(np.clip(np.quantile(1 - unseen(kept)[:, -1], 0.998), 0.5, 0.95)) if kept else 0.5
    return scanner


def _pieces(texts: ta.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of pieces of at most WINDOW words of all lines; those with tell-tale words or too long are left out."""
    start, end, ws, we, line, place, _, h = _lines(texts)
    if not len(ws):
        return h, ws, we
    head = np.flatnonzero(place % WINDOW == 0)
    begins, ends = ws[head], we[np.append(head[1:], len(ws)) - 1]
    told = np.zeros(len(head), bool)
    at = np.array([m.start() for m in _TELLTALE.finditer(texts.buf.tobytes())], np.int64)
    told[np.maximum(np.searchsorted(begins, at, "right") - 1, 0)] = True  # one in a gap tells the piece ahead of it, which does no harm
    good = ~told & (ends - begins <= PIECE_BYTES)
    begins, ends = begins[good], ends[good]
    return ta.hash_runs(texts.buf, begins, ends), begins, ends


def plain_paragraphs(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The `sample` distinct pieces of least hash of the whole corpus that hold no tell-tale word, or all if there are fewer."""
    rows = docs.select(cluster.text_or_empty().alias("text"))

    def least(x: np.ndarray) -> np.ndarray:
        return np.unique(x)[:sample]

    def task(batches):
        best = np.zeros(0, ta.U64)
        for b in batches:
            for i, j in ta.slices(b.column(0)):
                h = _pieces(ta.from_arrow(b.column(0)[i:j]))[0]
                best = least(np.concatenate([best, h[h < best[-1]] if len(best) == sample else h]))
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["hashes"])

    def merge(t: pa.Table) -> pa.Table:
        found = least(np.concatenate([np.frombuffer(x, ta.U64) for x in t["hashes"].to_pylist()]))
        return pa.table({"hashes": pa.array([found.tobytes()], pa.binary())})

    cluster.bounded_batches(docs.sparkSession)
    # Of each task `sample` hashes at most; 256 tasks merge them, then one the 256.
    some = rows.mapInArrow(task, "hashes binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(256)).alias("part")).applyInArrow(merge, "hashes binary")
    one = some.groupBy().applyInArrow(merge, "hashes binary").collect()
    chosen = np.frombuffer(one[0][0], ta.U64) if one else np.zeros(0, ta.U64)
    if not len(chosen):
        return []

    def fetch(b: pa.RecordBatch) -> pa.Table:
        hashes, pieces = [], []
        for i, j in ta.slices(b.column(0)):
            texts = ta.from_arrow(b.column(0)[i:j])
            h, begins, ends = _pieces(texts)
            some_ = np.flatnonzero((h <= chosen[-1]) & np.isin(h, chosen))
            some_ = some_[np.unique(h[some_], return_index=True)[1]]
            hashes += h[some_].view(np.int64).tolist()
            pieces += [texts.buf[a:z].tobytes().decode() for a, z in zip(begins[some_].tolist(), ends[some_].tolist(), strict=True)]
        return pa.table({"hash": pa.array(hashes, pa.int64()), "piece": pa.array(pieces, pa.string())})

    found = cluster.map_batches(rows, fetch, "hash long, piece string").groupBy("hash").agg(F.min("piece").alias("piece")).collect()
    return [r.piece for r in sorted(found, key=lambda r: r.hash & (1 << 64) - 1)]


def scan(docs: DataFrame, scanner: Scanner | None = None, overlap: float = 0.4) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unknown, family (of the surest confirmed paragraph), families and spans.

    `spans` are family:start:end of confirmed lines, or of the confirmed windows of a long line, in bytes of UTF-8, end exclusive.
    """
    spark = docs.sparkSession
    cluster.bounded_batches(spark)
    model = spark.sparkContext.broadcast(scanner or train(plain_paragraphs(docs), overlap))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.Table:
        out = {k: [] for k in ("n_paragraphs", "n_licensed", "n_unknown", "family", "families", "spans")}
        for i, j in ta.slices(b.column(1)):
            texts = ta.from_arrow(b.column(1)[i:j])
            best, sure, state, f = model.value.scan(texts)
            of_line = np.zeros(len(f.line_text), np.int64)  # a line is what its best window is
            np.maximum.at(of_line, f.line, state)
            out["n_paragraphs"] += np.bincount(f.line_text, minlength=j - i).tolist()
            out["n_licensed"] += np.bincount(f.line_text[of_line == 2], minlength=j - i).tolist()
            out["n_unknown"] += np.bincount(f.line_text[of_line == 1], minlength=j - i).tolist()
            found: dict[int, list] = {}
            for x in np.flatnonzero(state == 2).tolist():
                t = int(f.text[x])
                at = int(texts.offsets[t])
                spans = found.setdefault(t, [])
                span = (float(sure[x]), FAMILIES[best[x]], int(f.start[x]) - at, int(f.end[x]) - at)
                if spans and spans[-1][1] == span[1] and span[2] < spans[-1][3]:  # windows that overlap are one span
                    spans[-1] = (max(spans[-1][0], span[0]), span[1], spans[-1][2], span[3])
                else:
                    spans.append(span)
            for t in range(j - i):
                spans = found.get(t, [])
                out["family"].append(max(spans, key=lambda s: (s[0], -s[2]))[1] if spans else None)
                out["families"].append(",".join(sorted({s[1] for s in spans})))
                out["spans"].append(",".join(f"{s[1]}:{s[2]}:{s[3]}" for s in spans))
        kinds = {k: pa.string() if k in ("family", "families", "spans") else pa.int64() for k in out}
        return pa.table({"doc_id": b.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    schema = f"doc_id {kind}, n_paragraphs long, n_licensed long, n_unknown long, family string, families string, spans string"
    return cluster.map_batches(docs.select("doc_id", cluster.text_or_empty().alias("text")), batch, schema)
