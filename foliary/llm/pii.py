"""Personal data by patterns and by bootstrapped contextual extraction.

Base spans match the fixed patterns of four kinds. They are the seeds of a
bootstrap: every identifier-like stretch of a text (words that hold a digit or
an @, cut where base spans begin and end) is an instance, known by its shape,
and the words around it are lexical patterns. A pattern's confidence in a kind
is the part of its instances that are of the kind, seeds counting in full,
other instances of a shape that the kind allows by their own belief, all others
not at all. A shape's belief is the mean confidence of its patterns that are
trusted at all, damped by DAMPING, so that what no seed stands behind cannot
raise itself to certainty. Both are found in turn over the graph until no
confidence changes by SETTLED. Stretches that no base pattern matched become
spans where a pattern of high confidence stands beside them.

A pattern counts from SUPPORT uses on, of which SEEDED at least are seeds, or
SEED_SHARE of the kind's seeds if that is more: small tables can reach it, and
in large ones at most 1 / SEED_SHARE patterns of a kind do. Of the words beside
a stretch _CONTEXT characters count.

All of it is DataFrame expressions. Scale: texts are scanned once for base
spans and candidates and never shuffled; the graph holds only identifier-like
stretches, summed before each shuffle. Patterns that count are at most 1,000 a
kind by their seeds, so they are broadcast, and no shape has more rows than that. Patterns run possessively, so long runs
of like characters take linear time.

Edge cases: null texts are empty; matches of one kind do not overlap, those of
different kinds may; repeated rows get equal spans; `find` ignores columns
besides doc_id and text, `redact` returns all of them, whatever their names; an
empty table gives an empty result, as do tables without a seed add no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster

#: Base patterns, fixed values, written so that they take what the plain forms take without backtracking.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that hold a digit or an @, with single blanks between them.
_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD})*+"
CONFIDENT = 0.9
SUPPORT = 5
SEEDED = 3
SEED_SHARE = 1e-3
DAMPING = 0.95
SETTLED = 1e-3
#: Rounds after which it is an error that confidences still change; damping settles them far earlier.
_MOST_ROUNDS = 500
_CONTEXT = 80


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn test: every second from the right doubled, less 9 if over 9."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Lengths are summed in blocks of so many, so that places of n matches take far fewer than n * n steps.
_SUMMED = 128


def _located(text: Column, pattern: str) -> Column:
    """All matches as structs of match, start and end in code points: what stands between them tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, between, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.length(m).alias("size")))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def placed(pair: Column, lengths: Column, before: Column) -> Column:
        def place(p, i):
            block = F.floor(i / _SUMMED).cast("int")
            begin = F.element_at(before, block + 1) + total(F.slice(lengths, block * _SUMMED + 1, i % _SUMMED)) + p["gap"]
            return F.struct(p["match"].alias("match"), begin.alias("start"), (begin + p["size"]).alias("end"))

        return F.transform(pair, place)

    def by_block(pair: Column, lengths: Column) -> Column:
        ordinals = F.sequence(F.lit(0), F.floor(F.size(lengths) / _SUMMED).cast("int"))
        sums = F.transform(ordinals, lambda j: total(F.slice(lengths, j * _SUMMED + 1, F.lit(_SUMMED))))
        before = _let(F.struct(sums.alias("sums"), ordinals.alias("ordinals")), lambda s: F.transform(s["ordinals"], lambda j: total(F.slice(s["sums"], F.lit(1), j))))
        return _let(before, lambda b: placed(pair, lengths, b))

    def known(pair: Column) -> Column:
        lengths = F.transform(pair, lambda p: p["gap"] + p["size"])
        return _let(lengths, lambda n: by_block(pair, n))

    matches = F.filter(pairs, lambda p: p["match"].isNotNull())  # one more stretch follows the last match
    return _let(matches, known)


#: What a text must hold for a pattern to be tried.
_HINT = {"email": "@", "phone": "+"}


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base`: an array of kind, start and end, by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))

    def spans(kind: str) -> Column:
        hint = body.contains(_HINT[kind]) if kind in _HINT else body.rlike(PATTERNS[kind] if kind == "ip" else "[0-9]")
        valid = F.filter(_located(body, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
        found = F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(hint, found).otherwise(_none())

    return docs.withColumn("base", F.concat(*map(spans, KINDS)))


def with_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` (with `base`) with `candidates`: identifier-like stretches with match, start, end, the words before and after, and the kind of a base span.

    Base spans are candidates themselves; what they leave of a stretch is cut off at their borders.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def cut(x: Column) -> Column:
        """The parts of a stretch between the base spans that meet it."""
        met = F.array_sort(F.transform(F.filter("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
        start = F.struct(x["start"].cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(a, b):
            gap = F.when(b["start"] > a["at"], F.array(F.struct(a["at"].alias("start"), b["start"].cast("int").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct(F.greatest(a["at"], b["end"].cast("int")).alias("at"), F.concat(a["out"], gap).alias("out"))

        def finish(a):
            return F.when(a["at"] < x["end"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), x["end"].cast("int").alias("end"))))).otherwise(a["out"])

        return F.aggregate(met, start, step, finish)

    none = F.lit(None).cast("string")
    rest = F.flatten(F.transform(_located(body, CANDIDATE), cut))
    rest = F.transform(rest, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), none.alias("kind")))
    seeds = F.transform("base", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["kind"].alias("kind")))

    def around(x: Column) -> Column:
        before = F.substring(body, F.greatest(x["start"] - _CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(_CONTEXT)))
        after = F.substring(body, x["end"] + 1, F.lit(_CONTEXT))
        return F.struct(
            F.substring(body, x["start"] + 1, x["end"] - x["start"]).alias("match"), x["start"].alias("start"), x["end"].alias("end"),
            F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)).alias("left"),
            F.lower(F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)).alias("right"), x["kind"].alias("kind"),
        )

    located = F.when(body.rlike("[0-9@]"), F.transform(F.concat(seeds, rest), around))
    return rows.withColumn("candidates", F.coalesce(located, F.array().cast("array<struct<match:string,start:int,end:int,left:string,right:string,kind:string>>")))


def instances(rows: DataFrame, key: list[str]) -> DataFrame:
    """A row per candidate: `key`, start and end without the punctuation around it, stretch, shape, kind if it is a base span, left and right."""
    flat = rows.where(F.size("candidates") > 0).select(*key, F.explode("candidates").alias("x"))
    lead = F.when(F.col("x.kind").isNull(), F.length(F.regexp_extract("x.match", r"^[^0-9A-Za-z@+(]*", 0))).otherwise(0)
    tail = F.when(F.col("x.kind").isNull(), F.length(F.regexp_extract("x.match", r"[^0-9A-Za-z]*$", 0))).otherwise(0)
    trimmed = F.col("x.match").substr(lead + 1, F.length("x.match") - lead - tail).alias("stretch")
    flat = flat.select(*key, (F.col("x.start") + lead).alias("start"), (F.col("x.end") - tail).alias("end"), trimmed, "x.left", "x.right", "x.kind").where("start < end and stretch rlike '[0-9@]'")
    # Runs of digits and letters count by how long they are, up to twenty: so long shapes stay apart without being cut.
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("stretch", "[0-9]", "9"), "9{20,}", "99999999999999999999"), r"[\p{L}]+", "a")
    return flat.select(*key, "start", "end", "left", "right", "stretch", shape.alias("shape"), "kind")


def _sides() -> Column:
    return F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"))).alias("pattern")


def learn_patterns(found: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT, seeded: int = SEEDED) -> DataFrame:
    """pattern, kind: lexical patterns that stand around one kind with confidence and enough support.

    Only patterns beside a seed can ever be trusted, so all others are left out
    of the graph. It has a row for each pattern, shape and kind with how often
    they meet; a round is two sums over it.
    """
    graph = cluster.written(found.select("shape", "kind", "stretch", _sides()).where("length(pattern) > 1").select(
        "pattern", F.concat("shape", F.coalesce(F.concat(F.lit(" "), _may_be()), F.lit(""))).alias("shape"), "kind", _may_be().alias("may")
    ).groupBy("pattern", "shape", "kind", "may").agg(F.count("*").alias("n")))
    seeds = graph.where("kind is not null").groupBy("pattern", F.col("kind").alias("of")).agg(F.sum("n").alias("seeded"))
    least = F.broadcast(seeds.groupBy("of").agg(F.greatest(F.lit(seeded), F.ceil(F.sum("seeded") * SEED_SHARE)).alias("least")))  # a row a kind
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    score = seeds.join(least, "of").where(F.col("seeded") >= F.col("least")).drop("least").join(total, "pattern").where(F.col("total") >= support)
    score = cluster.written(score.withColumn("confidence", F.col("seeded") / F.col("total")))
    # Instances without a kind beside trusted patterns, of a shape that the kind allows.
    open_ = graph.where("kind is null and may is not null").select("pattern", "shape", F.explode(F.split("may", ",")).alias("of"), "n")
    open_ = cluster.written(open_.join(F.broadcast(score.select("pattern", "of")), ["pattern", "of"]))
    for _ in range(_MOST_ROUNDS):
        weighed = open_.join(F.broadcast(score.select("pattern", "of", "confidence")), ["pattern", "of"])
        belief = weighed.groupBy("shape", "of").agg((F.lit(DAMPING) * F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("belief"))
        added = open_.join(belief, ["shape", "of"]).groupBy("pattern", "of").agg(F.sum(F.col("n") * F.col("belief")).alias("added"))
        now = score.withColumnRenamed("confidence", "before").join(added, ["pattern", "of"], "left")
        now = now.withColumn("confidence", (F.col("seeded") + F.coalesce("added", F.lit(0.0))) / F.col("total")).drop("added")
        now = cluster.written(now)
        change = now.agg(F.max(F.abs(F.col("confidence") - F.col("before")))).first()[0] or 0.0
        score = now.drop("before")
        if change <= SETTLED:
            return score.where(F.col("confidence") >= confident).select("pattern", "of")
    raise RuntimeError(f"confidences still change by {change} after {_MOST_ROUNDS} rounds")


#: What a stretch must be like to be taken for a kind on context alone.
_LIKE = {
    "email": r"@|(?i)\bat\b",
    "ip": r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[ .-]{0,2}[0-9]){12,18}$",
    "phone": r"^[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}


def _may_be() -> Column:
    """The kinds that a stretch is like, comma-joined; null if none."""
    return F.nullif(F.concat_ws(",", *(F.when(F.col("stretch").rlike(v), F.lit(k)) for k, v in _LIKE.items())), F.lit(""))


def discovered(found: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """`key` and `added`, an array of kind, start and end: candidates that are no base span beside confident patterns."""
    like = F.coalesce(*(F.when(F.col("of") == k, F.col("stretch").rlike(v)) for k, v in _LIKE.items()))
    met = found.where("kind is null").where(_may_be().isNotNull()).select(*key, "start", "end", "stretch", _sides()).join(F.broadcast(patterns), "pattern").where(like)
    met = met.select(*key, F.struct(F.col("of").alias("kind"), "start", "end").alias("x"))
    return met.groupBy(*key).agg(F.sort_array(F.collect_set("x")).alias("added"))


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int>>")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each document."""
    scanned = with_candidates(with_base_spans(docs.select("doc_id", "text"))).select(
        "doc_id", "base", "candidates", F.monotonically_increasing_id().alias("rid")
    )
    scanned = cluster.written(scanned)
    found = cluster.written(instances(scanned, ["rid"]))
    added = discovered(found, learn_patterns(found), ["rid"])
    rows = scanned.select("doc_id", "rid", "base").join(added, "rid", "left")
    rows = rows.withColumn("added", F.coalesce("added", _none()))
    return rows.select(
        "doc_id", *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; spans that overlap become one, of the kind that starts first.

    Only texts with a candidate meet the discovered spans in a join; all others
    pass. Columns travel in a struct, so their names clash with none used here.
    Null texts stay null; repeated rows are redacted alike; an empty table stays empty.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(f"`{text}`").alias("text"), F.col("doc_id").cast("string").alias("key"))
    rows = rows.withColumns({"body": F.xxhash64("text"), "may": body.rlike("[0-9@]")})
    key = ["key", "body"]
    scanned = with_candidates(with_base_spans(rows.where("may").select(*key, "text"))).select(*key, "base", "candidates")
    found = cluster.written(instances(scanned, key))
    added = discovered(found, learn_patterns(found), key).withColumnsRenamed({"key": "key_", "body": "body_"})
    met = F.col("key").eqNullSafe(F.col("key_")) & (F.col("body") == F.col("body_"))
    some = with_base_spans(rows.where("may")).join(added, met, "left").withColumn("spans", F.array_sort(F.transform(
        F.concat("base", F.coalesce("added", _none())), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))
    )))

    def step(a, x):
        new, end = x["start"] >= a["at"], -x["back"]
        piece = F.concat(F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(new, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    some = some.select("own", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))
    both = some.unionByName(rows.where(~F.col("may")).select("own", "text"))
    return both.select(*(F.col("text").alias(c) if c == text else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by kind as listed, then start, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
