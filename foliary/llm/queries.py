"""Queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliary.llm import cluster, collocations, fingerprints, lexical_search, licenses, mixing, ngram_join, packing, pairwise_quality, pii, sharding, suffix_dedup, vector_search, weak_rules
from foliary.llm.cluster import documents


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.rank_quality(documents(spark, sf_dir), cluster.table(spark, sf_dir, "labels"))


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(documents(spark, sf_dir))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(documents(spark, sf_dir), cluster.table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top(cluster.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_entropy_mix, op2_bradley_terry, op3_contextual_pii, op4_weak_rules, op5_licence_scan, op6_weighted_sampling, op7_ngram_join, op8_label_propagation, op9_suffix_dedup, op10_best_fit,
        op11_impact_search, op12_collocations, op13_maxscore,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

#: DuckDB SQL where SQL can express a query whole; the others have brute-force tests.
ORACLE_SQL: dict[str, str] = {
    "op11_impact_search": f"""WITH t AS (SELECT doc_id, {_TERMS} FROM documents), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
      q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
      p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
      s AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
      SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
      g AS MATERIALIZED (SELECT lang, phrase, words, count(*) AS f FROM (
        SELECT lang, 1 AS words, unnest(words) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) FROM w WHERE len(words) > 1
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) FROM w WHERE len(words) > 2) GROUP BY ALL),
      n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE words = 1 GROUP BY lang), c AS (SELECT * FROM g WHERE f >= 10 AND words > 1),
      cut AS (SELECT *, array_to_string(parts[:k], ' ') AS head, array_to_string(parts[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS parts FROM c)),
      scored AS (SELECT cut.lang, cut.phrase, cut.f AS a, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * cut.f * cut.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, k FROM cut
        JOIN g x ON x.lang = cut.lang AND x.phrase = head JOIN g y ON y.lang = cut.lang AND y.phrase = tail),
      one AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
      longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
      free AS (SELECT one.* FROM one LEFT JOIN longer o ON o.lang = one.lang AND o.phrase = one.phrase WHERE nth = 1 AND coalesce(100 * o.f < 50 * one.a, true)),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
      SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_maxscore": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
      SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
