"""Plain versions that the operators are held against, and awkward documents."""

import hashlib
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin int, shard int, key string, rid long"


def awkward(spark):
    """Nulls, empties, ties, repeated rows, very long texts, odd characters; extra columns with names the operators use."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = base.replace("twenty", "twentyone")
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "two words"), (6, base), (7, base), (8, near), (8, near), (None, base), (None, None), (9, long), (10, long + " end"),
        (11, "naïve café 日本語   𝒳 é"), (12, "a@b.co 1.2.3.4 +1 (499) 555-6503 or 4381893557741609"), (13, "x\x00y <|endoftext|> it's"), (14, "\n\n\n"), (15, "Line\n" * 30),
    ]
    rows = [(i, t, "en", [None, "s1", "s2"][k % 3], len(t or ""), 1, 2, "k", 5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), [(i, t) for i, t in texts]


def words(text):
    return (text or "").encode().split()


def base_counts(text):
    w = words(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(five), set()
    for i, x in enumerate(five):
        if times[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in PII for m in re.finditer(PII[k], text or "") if _holds(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_classes(docs, similarity=0.8):
    """By text: links to other texts and the doc_ids of its class."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[t or ""].append(i)
    texts = list(ids)
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= (similarity - 1e-9) * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, t in enumerate(texts):
        members[find(k)] += [i for i in ids[t] if i is not None]
    return {t: (links[k], min(members[find(k)], default=None), len(ids[t])) for k, t in enumerate(texts)}


def without_repeats(docs, match=50):
    """By place in `docs`: n_bytes, n_removed, n_spans, kept_sha256."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    first, out = {}, {}
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    for k in order:
        raw = (docs[k][1] or "").encode()
        for q in range(len(raw) - match + 1):
            w = raw[q : q + match]
            first[w] = min(first.get(w, key(k)), key(k))
    for k in order:
        raw = (docs[k][1] or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - match + 1):
            if first[raw[q : q + match]] < key(k):
                gone[q : q + match] = b"\x01" * match
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()
    return out


def licence_units(text, window):
    """(start, end, bytes) of each line, or of the half-overlapping windows of one with more than `window` words."""
    out, at = [], 0
    for line in text.encode().split(b"\n"):
        found = list(re.finditer(rb"[A-Za-z0-9\x80-\xff]+", line))
        if line and len(found) <= window:
            out.append((at, at + len(line), line))
        elif line:
            k = 0
            while True:
                part = found[k : k + window]
                a, z = part[0].start(), part[-1].end()
                out.append((at + a, at + z, line[a:z]))
                if k + window >= len(found):
                    break
                k += window // 2
        at += len(line) + 1
    return out
