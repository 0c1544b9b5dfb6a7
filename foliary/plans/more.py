"""Further queries: small operators of jobs, uploads, notes, names and findings, and job events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import blocks, diff, integrity, jobs, runs, versions
from foliary.plans.queries import _FINDINGS, _JOBS, _LATEST, _LINES, _events, _findings, _read, job_latest, query
from foliary.sources import packages, store
from foliary.streaming import jobs as stream
from foliary.streaming import state

# Uploads: an event is a file of a batch.
_NAME = "'f' || CAST(event_id AS VARCHAR(20)) || CASE event_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.zip' ELSE '.docx.txt' END"
_UPLOADS = f"SELECT event_id, event_id // 8 - event_id // 80 AS batch, {_NAME} AS name, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 13 AS INT) END AS priority FROM events"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor(F.col("event_id") / 8) - F.floor(F.col("event_id") / 80)
    return _read(spark, sf_dir, "events").select("event_id", batch.cast("long").alias("batch"), F.expr(_NAME).alias("name"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 13).alias("priority"))


@query(f"WITH u AS ({_UPLOADS}) SELECT event_id, name FROM u WHERE (lower(name) LIKE '%.docx' OR lower(name) LIKE '%.zip') AND coalesce(priority, 5) BETWEEN 1 AND 10 AND batch IN (SELECT batch FROM u GROUP BY batch HAVING count(*) <= 10)")
def accepted_uploads(spark, sf_dir):
    """Files with an extension that is taken, of a priority in range, in batches of at most ten."""
    return jobs.accepted(_uploads(spark, sf_dir), (".docx", ".zip")).select("event_id", "name")


# Files as bytes: every document's text, with zero bytes, broken characters and characters cut at byte 8192 put in by rule.
_BYTES = "CASE doc_id % 5 WHEN 0 THEN encode('0' || chr(10)) || '\\x00'::BLOB || encode(text) WHEN 1 THEN '\\xFF'::BLOB || encode(text) WHEN 2 THEN encode(repeat('a', 8191) || 'é' || text) ELSE encode(text) END"


@query("SELECT doc_id, doc_id % 5 NOT IN (0, 1) AS is_text FROM documents")
def text_files(spark, sf_dir):
    """Files that count as text."""
    fifth, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    content = (
        F.when(fifth == 0, F.concat(F.unhex(F.lit("300A00")), F.encode(text, "utf-8"))).when(fifth == 1, F.concat(F.unhex(F.lit("FF")), F.encode(text, "utf-8")))
        .when(fifth == 2, F.encode(F.concat(F.repeat(F.lit("a"), F.lit(8191)), F.lit("é"), text), "utf-8")).otherwise(F.encode(text, "utf-8"))
    )
    return _read(spark, sf_dir, "documents").select("doc_id", diff.is_text(content).alias("is_text"))


_PATH = "'out/' || source || CASE doc_id % 3 WHEN 0 THEN '/a.b/' ELSE '/' END || 'n' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.zip' WHEN 2 THEN '' ELSE '.' END"


@query(f"SELECT doc_id, 'n' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.zip' WHEN 2 THEN '' ELSE '.' END AS base, 'n' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '.tar' ELSE '' END AS stem, CASE doc_id % 4 WHEN 0 THEN 'gz' WHEN 1 THEN 'zip' ELSE '' END AS extension, substr({_PATH}, 5) AS relative FROM documents")
def path_parts(spark, sf_dir):
    path = F.expr(_PATH)
    return _read(spark, sf_dir, "documents").select("doc_id", T.basename(path).alias("base"), T.stem(path).alias("stem"), T.extension(path).alias("extension"), T.relative(path, F.lit("out")).alias("relative"))


@query(f"SELECT path, size FROM (SELECT {_PATH} AS path, n_chars AS size, doc_id FROM documents) ORDER BY path")
def sorted_paths(spark, sf_dir):
    """Files in order of their paths."""
    return _read(spark, sf_dir, "documents").select(F.expr(_PATH).alias("path"), F.col("n_chars").alias("size")).orderBy("path")


_AGED = "CASE doc_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.epub' ELSE '.txt' END"


@query(f"SELECT 'r' || CAST(doc_id AS VARCHAR) || {_AGED} AS path FROM documents WHERE doc_id % 3 < 2 AND doc_id % 50 > 24")
def outdated_results(spark, sf_dir):
    """Result archives older than a day."""
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = _read(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.expr(_AGED)).alias("path"), (as_of - F.make_interval(hours=(F.col("doc_id") % 50).cast("int"))).alias("modified"))
    return packages.outdated(rows, as_of).select("path")


_LISTED = "CASE doc_id % 6 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'b.svg' WHEN 2 THEN 'images/c.png' WHEN 3 THEN 'd.tiff' WHEN 4 THEN 'jpeg' ELSE 'e.jpeg' END"


@query(f"SELECT doc_id, {_LISTED} AS path FROM documents WHERE doc_id % 6 IN (0, 1, 5)")
def top_images(spark, sf_dir):
    return packages.images_in(_read(spark, sf_dir, "documents").select("doc_id", F.expr(_LISTED).alias("path")))


@query(f"{_LINES} SELECT doc_id, i, 'images/' || CAST(i AS VARCHAR) || '.png' AS src FROM lines WHERE i % 4 = 1 AND i % 3 = 0")
def existing_images(spark, sf_dir):
    """Images that the content points to and that exist: a semi join."""
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("src", F.concat(F.lit("images/"), F.col("i").cast("string"), F.lit(".png")))
    return rows.where("i % 4 = 1").select("doc_id", "i", "src").join(rows.where("i % 3 = 0").select("doc_id", F.col("src")), ["doc_id", "src"], "left_semi").select("doc_id", "i", "src")


_TITLES = "CASE i % 6 WHEN 0 THEN '[표 ' || CAST(i AS VARCHAR(20)) || ']' WHEN 1 THEN '표' || CAST(i AS VARCHAR(20)) || '.2 x' WHEN 2 THEN '표 ' ELSE line END"


@query(f"{_LINES} SELECT doc_id, i FROM lines WHERE i % 6 < 2 OR i % 6 > 2 AND regexp_matches(line, '표\\s*[0-9]')")
def table_titles(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.where(T.is_table_title(F.expr(_TITLES))).select("doc_id", "i")


# Notes, formulas and links.
_NOTED = "CASE i % 5 WHEN 0 THEN 'a (각주' || CAST(i AS VARCHAR(20)) || ') (각주99)' WHEN 1 THEN '(정답7) (난외주석' || CAST(i AS VARCHAR(20)) || ')' WHEN 2 THEN '(정답' || CAST(i AS VARCHAR(20)) || ')' ELSE '' END"


@query(f"""{_LINES}, n AS (SELECT doc_id, i, 0 AS k, '(각주' || CAST(i AS VARCHAR) || ')' AS note FROM lines WHERE i % 5 = 0 UNION ALL SELECT doc_id, i, 1, '(난외주석' || CAST(i AS VARCHAR) || ')' FROM lines WHERE i % 5 = 1
    UNION ALL SELECT doc_id, i, 2, CASE WHEN i % 5 = 1 THEN '(정답7)' ELSE '(정답' || CAST(i AS VARCHAR) || ')' END FROM lines WHERE i % 5 IN (1, 2))
  SELECT doc_id, i, CASE k WHEN 0 THEN 'fn_' || CAST(count(*) FILTER (WHERE k = 0) OVER w AS VARCHAR) WHEN 1 THEN 'marg_' || CAST(row_number() OVER w AS VARCHAR) ELSE 'ans_' || CAST(row_number() OVER w AS VARCHAR) END AS note_id, note,
    note || CASE k WHEN 2 THEN '에 대한 정답' ELSE '에 대한 설명' END AS content FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def notes_union(spark, sf_dir):
    """Footnotes, marginal notes and answers as one numbered list."""
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.notes(rows.withColumn("text", F.expr(_NOTED)), ["doc_id"], "i")


_MATH = r"CASE i % 4 WHEN 0 THEN '\\\\x^' || CAST(i AS VARCHAR(20)) || '\\\\ and \\\\y\\\\' WHEN 1 THEN 'see http://a.example/' || CAST(i AS VARCHAR(20)) || repeat('x', 60) || ' https://b.example' ELSE '' END"
_MATH_SQL = _MATH.replace("\\\\", "\\")


@query(rf"""{_LINES}, v AS (SELECT doc_id, i, 0 AS place, 'x^' || CAST(i AS VARCHAR) AS value FROM lines WHERE i % 4 = 0 UNION ALL SELECT doc_id, i, 1, 'y' FROM lines WHERE i % 4 = 0)
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, place) AS k, '수식 ' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, place) AS VARCHAR) || ': ' || value AS label FROM v""")
def formula_list(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.numbered(rows, ["doc_id"], "i", T.formulas(F.expr(_MATH)), "수식")


@query(f"""{_LINES}, v AS (SELECT doc_id, i, 0 AS place, left('http://a.example/' || CAST(i AS VARCHAR) || repeat('x', 60), 50) AS value FROM lines WHERE i % 4 = 1 UNION ALL SELECT doc_id, i, 1, 'https://b.example' FROM lines WHERE i % 4 = 1)
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, place) AS k, '링크 ' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, place) AS VARCHAR) || ': ' || value AS label FROM v""")
def link_list(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.numbered(rows, ["doc_id"], "i", T.links(F.expr(_MATH)), "링크")


@query(f"""{_LINES} SELECT doc_id, i, CASE i % 4 WHEN 0 THEN '<math xmlns="http://www.w3.org/1998/Math/MathML" alttext="x^' || CAST(i AS VARCHAR) || '"><mtext>x^' || CAST(i AS VARCHAR) || '</mtext></math> and <math xmlns="http://www.w3.org/1998/Math/MathML" alttext="y"><mtext>y</mtext></math>'
  ELSE 'a <svg xmlns="http://www.w3.org/2000/svg" role="img" aria-label="c' || CAST(i AS VARCHAR) || '"><title>c' || CAST(i AS VARCHAR) || '</title></svg>' END AS html FROM lines WHERE i % 4 < 2""")
def formula_markup(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).where("i % 4 < 2")
    text = F.when(F.col("i") % 4 == 0, F.expr(_MATH)).otherwise(F.concat(F.lit("a \\svg\\c"), F.col("i").cast("string"), F.lit("\\")))
    return rows.select("doc_id", "i", T.with_formulas(text).alias("html"))


# Findings.
@query(f"""{_FINDINGS}, per AS (SELECT doc_id, category, count(*) AS n FROM f GROUP BY ALL)
  SELECT d.doc_id, coalesce((SELECT string_agg(message, '|' ORDER BY message) FROM f WHERE f.doc_id = d.doc_id AND severity = 'error'), '') AS errors, coalesce((SELECT string_agg(message, '|' ORDER BY message) FROM f WHERE f.doc_id = d.doc_id AND severity = 'warning'), '') AS warnings,
    coalesce((SELECT string_agg(category || '=' || CAST(n AS VARCHAR), ',' ORDER BY category) FROM per WHERE per.doc_id = d.doc_id), '') AS details FROM documents d""")
def finding_details(spark, sf_dir):
    """Findings of each document as lists, and how many of each category."""
    rows = integrity.details(_read(spark, sf_dir, "documents"), _findings(spark, sf_dir))
    counts = F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("doc_id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), F.array_join(counts, ",").alias("details"))


@query("SELECT doc_id, 'system' AS category, 'error' AS severity, 'validation failed: e' || CAST(doc_id AS VARCHAR) AS message FROM documents WHERE doc_id % 9 = 4")
def validator_crashes(spark, sf_dir):
    return integrity.crashed(_read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("failure")))


@query(f"""{_LINES}, m AS (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN 'dc:Title' WHEN 1 THEN 'dc:Creator' ELSE 'other' END AS name, 'v' || CAST(i AS VARCHAR) AS v FROM lines)
  SELECT doc_id, max_by(v, i) FILTER (WHERE name = 'dc:Title') AS title, max_by(v, i) FILTER (WHERE name = 'dc:Creator') AS author FROM m GROUP BY doc_id""")
def last_metadata(spark, sf_dir):
    """Of metadata given twice the last stands."""
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.when(F.col("i") % 3 == 0, "dc:Title").when(F.col("i") % 3 == 1, "dc:Creator").otherwise("other")
    meta = rows.select("doc_id", F.col("i").alias("ord"), name.alias("name"), F.concat(F.lit("v"), F.col("i").cast("string")).alias("content"))
    return integrity.last_meta(meta, {"title": "dc:Title", "author": "dc:Creator"})


@query(f"""{_LINES} SELECT doc_id, count(*) FILTER (WHERE i % 8 = 3) AS images, count(DISTINCT i % 5) FILTER (WHERE i % 8 = 3) AS relations, count(*) FILTER (WHERE i % 6 = 5) AS tables, count(*) AS elements FROM lines GROUP BY doc_id""")
def content_counts(spark, sf_dir):
    """How many images, image relations, tables and elements each document has."""
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    image = F.col("i") % 8 == 3
    return rows.groupBy("doc_id").agg(F.count_if(image).alias("images"), F.count_distinct(F.when(image, F.col("i") % 5)).alias("relations"), F.count_if(F.col("i") % 6 == 5).alias("tables"), F.count("*").alias("elements"))


@query("""SELECT user_id, first(event_type ORDER BY place) AS first, string_agg(event_type, '|' ORDER BY place) AS values FROM (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL) GROUP BY user_id""")
def first_distinct(spark, sf_dir):
    return jobs.first_distinct(_read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


# Jobs: states are told by their progress.
_STATE = "CASE progress % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'failed' WHEN 2 THEN 'started' ELSE 'queued' END"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_latest(spark, sf_dir).select("job_id", "ts", F.expr(_STATE).alias("status"))


@query(f"SELECT count(*) FILTER (WHERE s = 'queued') AS waiting, count(*) FILTER (WHERE s = 'started') AS running, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT {_STATE} AS s FROM ({_LATEST}))")
def queue_counts(spark, sf_dir):
    return jobs.queue_counts(_states(spark, sf_dir))


@query(f"SELECT job_id FROM ({_LATEST}) WHERE {_STATE} = 'failed' ORDER BY job_id LIMIT 10")
def failed_jobs(spark, sf_dir):
    """Ten failed jobs, as the report of the queue shows; the limit is the feature."""
    return jobs.failed_jobs(_states(spark, sf_dir))


@query(f"""WITH s AS (SELECT job_id, CAST(string_split(job_id, ':')[2] AS BIGINT) AS n FROM ({_LATEST}) WHERE {_STATE} = 'finished')
  SELECT job_id, CASE WHEN n % 2 = 0 THEN 'both' WHEN n % 3 = 0 THEN 'epub' WHEN n % 5 = 0 THEN 'zip' END AS format, CASE WHEN n % 2 = 0 THEN 'both/' WHEN n % 3 = 0 THEN 'epub/' WHEN n % 5 = 0 THEN 'zip/' END || job_id AS path FROM s""")
def job_results(spark, sf_dir):
    """What a finished job offers: both formats, else one of them."""
    states = _states(spark, sf_dir)
    n = F.element_at(F.split("job_id", ":"), 2).cast("long")
    kinds = F.array_compact(F.array(*(F.when(n % k == 0, F.lit(kind)) for k, kind in ((2, "both"), (3, "epub"), (5, "zip")))))
    files = states.select("job_id", F.explode(kinds).alias("kind")).withColumn("path", F.concat_ws("/", "kind", "job_id"))
    return jobs.with_results(states, files)


_FIRST = "SELECT event_id, 'job:' || CAST(user_id AS VARCHAR(20)) AS job_id, ts, event_type AS status, event_id % 2 = 0 AS old FROM events"


@query(f"""WITH e AS ({_FIRST}), ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY old DESC, ts, event_id) AS r FROM e), lim AS (SELECT max(ts) - INTERVAL 7 DAY AS t FROM events)
  SELECT job_id, max(ts) AS ts, arg_max(status, r) AS status, arg_max(event_id, r) FILTER (WHERE event_id % 3 = 0) AS third FROM ranked, lim GROUP BY job_id, t HAVING max(ts) >= t""")
def job_store(spark, sf_dir):
    """A store of jobs brought up to date: maps are merged, later values stand, and jobs of which nothing was heard for seven days are gone."""
    rows = _events(spark, sf_dir)
    meta = F.map_filter(F.create_map(F.lit("status"), F.col("status"), F.lit("third"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))), lambda _, v: v.isNotNull())
    changes = rows.select("job_id", "ts", "event_id", meta.alias("meta"))
    as_of = rows.agg(F.max("ts").alias("as_of"))  # one row
    empty = changes.limit(0).select("job_id", "ts", "meta")
    far = F.lit("2999-01-01").cast("timestamp")
    old = jobs.upserted(empty, changes.where("event_id % 2 = 0"), far, 86_400 * 1_000_000)
    both = jobs.upserted(old, changes.where("event_id % 2 = 1"), far, 86_400 * 1_000_000).crossJoin(F.broadcast(as_of))
    kept = jobs.expired(both, F.col("as_of"), 7 * 86_400).select(F.col("job_id").alias("gone"))
    out = both.join(kept, F.col("job_id") == F.col("gone"), "left_anti")
    return out.select("job_id", "ts", F.col("meta")["status"].alias("status"), F.col("meta")["third"].cast("long").alias("third"))


@query(f"SELECT job_id, '{{\"status\":\"' || status || '\",\"progress\":' || CAST(progress AS VARCHAR) || '}}' AS json FROM ({_LATEST})")
def job_json(spark, sf_dir):
    """A job's state as it is published."""
    return job_latest(spark, sf_dir).select("job_id", F.to_json(F.struct("status", "progress")).alias("json"))


@query(f"SELECT job_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM ({_LATEST})")
def job_times(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return job_latest(spark, sf_dir).select("job_id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.unix_seconds(at).alias("seconds"))


# Streams: what is there is run to its end; results are tables in a folder of the query's own.
def _folder(spark: SparkSession) -> str:
    return store.new_folder(spark, "stream")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read(spark, f"{sf_dir}/events.parquet*", _read(spark, sf_dir, "events").limit(0))
    return rows.select("event_id", F.concat(F.lit("job:"), F.col("user_id").cast("string")).alias("job_id"), "ts", F.col("event_type").alias("status"), (F.col("event_id") % 101).alias("progress"))


@query(_LATEST)
def job_latest_stream(spark, sf_dir):
    """The same state as job_latest, kept by job in the state store and written out by batches."""
    return stream.store(stream.last_states(_event_stream(spark, sf_dir)), _folder(spark), ["job_id"])


@query(f"SELECT l.*, c_name AS filename FROM ({_JOBS}) l LEFT JOIN (SELECT 'job:' || CAST(c_custkey AS VARCHAR) AS job_id, c_name FROM customer WHERE c_custkey % 3 = 0) USING (job_id)")
def enriched_stream(spark, sf_dir):
    """Every event with what is known of its job, by a stream-static join."""
    dim = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("job:"), F.col("c_custkey").cast("string")).alias("job_id"), F.col("c_name").alias("filename"))
    return stream.store(stream.enriched(_event_stream(spark, sf_dir), dim), _folder(spark), ["event_id"])


@query("SELECT event_id, 'job:' || CAST(user_id AS VARCHAR) AS job_id FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 1")
def channel_stream(spark, sf_dir):
    """Messages of a key's channel: only those that set a key under the prefix, by the job they are of."""
    event = F.when(F.col("event_id") % 3 == 0, "set").otherwise("expire")
    channel = F.concat(F.when(F.col("event_id") % 4 == 1, "other:").otherwise("task:status:"), F.substring_index("job_id", ":", -1))
    found = stream.from_channel(_event_stream(spark, sf_dir).select("event_id", channel.alias("channel"), event.alias("event")), "task:status:")
    return stream.store(found.select("event_id", F.concat(F.lit("job:"), "job_id").alias("job_id")), _folder(spark), ["event_id"])


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, status, count(*) AS n FROM ({_JOBS}) GROUP BY ALL")
def hourly_stream(spark, sf_dir):
    """Events by hour and status; all files of the table come in one batch, so no event is late."""
    return stream.store(stream.by_window(_event_stream(spark, sf_dir)), _folder(spark), ["start", "status"])


# Jobs in the state store: silent for six hours they stall, for a day they expire.
_STALL, _EXPIRY = 6 * 3600, 24 * 3600
_SESSIONS = f"""WITH e AS (SELECT 'job:' || CAST(user_id AS VARCHAR) AS job_id, event_id, epoch_us(ts) AS us, event_type AS status FROM events), lim AS (SELECT max(us) AS upto FROM e),
  g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {_EXPIRY}000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY us, event_id) AS run FROM g),
  cur AS (SELECT n.* FROM n JOIN (SELECT job_id, max(run) AS run, max(us) AS last FROM n GROUP BY job_id) m USING (job_id, run), lim WHERE last + {_EXPIRY}000000 > upto)"""


def _job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row that the state processor sent of each job."""
    rows = _event_stream(spark, sf_dir)
    pairs = F.create_map(F.lit("status"), F.col("status"), F.concat(F.lit("part"), (F.col("event_id") % 5).cast("string")), F.col("event_id").cast("string"))
    pairs = rows.select("event_id", "job_id", "ts", "status", F.explode(pairs).alias("k", "v"))
    with state.state_store(spark):
        return stream.store(state.job_states(pairs, "signup", ("purchase", "error"), _STALL, _EXPIRY), _folder(spark), ["job_id"])


@query(f"""{_SESSIONS}, kv AS (SELECT job_id, us, event_id, 'status' AS k, status AS v FROM cur UNION ALL SELECT job_id, us, event_id, 'part' || event_id % 5, CAST(event_id AS VARCHAR) FROM cur),
  l AS (SELECT job_id, k, arg_max(v, (us, event_id)) AS v FROM kv GROUP BY ALL), t AS (SELECT job_id, max(us) AS last FROM cur GROUP BY job_id) SELECT job_id, last, string_agg(k || '=' || v, '|' ORDER BY k) AS meta FROM l JOIN t USING (job_id) GROUP BY ALL""")
def job_store_stream(spark, sf_dir):
    """Metas of live jobs, merged key by key in the state store; a job that was silent for a day is gone, or has begun anew."""
    rows = _job_states(spark, sf_dir).where("live")
    pairs = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("job_id", "last", F.array_join(pairs, "|").alias("meta"))


@query(f"""{_SESSIONS}, b AS (SELECT job_id, max(us) AS last, min(us) FILTER (WHERE status = 'signup') AS started FROM cur GROUP BY job_id), f AS (SELECT job_id, min(us) AS ended FROM cur JOIN b USING (job_id) WHERE status IN ('purchase', 'error') AND us >= started GROUP BY job_id),
  r AS (SELECT job_id, started, ended, last, ended IS NULL AND last + {_STALL}000000 <= upto AS stalled FROM b LEFT JOIN f USING (job_id), lim)
  SELECT job_id, started, ended, coalesce(ended, CASE WHEN stalled THEN last + {_STALL}000000 ELSE last END) - started AS elapsed, stalled FROM r""")
def job_elapsed_stream(spark, sf_dir):
    """How long live jobs took from their start: frozen at their end, told by a timer where they fell silent."""
    return _job_states(spark, sf_dir).where("live").select("job_id", "started", "ended", "elapsed", "stalled")


# Subscriptions: a signup opens one to its job, for 1 to 48 hours.
@query("""WITH e AS (SELECT event_id, 'job:' || CAST(user_id AS VARCHAR) AS job_id, ts, event_type FROM events), s AS (SELECT 's' || CAST(event_id AS VARCHAR) AS subscriber, job_id, ts AS begins, ts + to_hours(1 + event_id % 48) AS ends FROM e WHERE event_type = 'signup'),
  m AS (SELECT * FROM e WHERE event_type <> 'signup'), lim AS (SELECT least((SELECT max(ts) FROM m), (SELECT max(begins) FROM s)) AS upto), j AS (SELECT event_id, m.job_id, m.ts, subscriber FROM m LEFT JOIN s ON s.job_id = m.job_id AND ts >= begins AND ts < ends)
  SELECT event_id, job_id, subscriber FROM j, lim WHERE subscriber IS NOT NULL OR ts < upto""")
def subscriber_messages(spark, sf_dir):
    """Messages of jobs by subscriber, by a join of two streams; those that nobody hears come with none, as far as the watermark tells."""
    rows = _event_stream(spark, sf_dir)
    opened = _event_stream(spark, sf_dir).where("status = 'signup'").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("subscriber"), "job_id", F.col("ts").alias("begins"), (F.col("ts") + F.make_interval(hours=(1 + F.col("event_id") % 48).cast("int"))).alias("ends"))
    found = stream.heard(rows.where("status <> 'signup'"), opened)
    return stream.appended(found.select("event_id", "job_id", "subscriber"), _folder(spark))


# Metas of any shape: objects, arrays, numbers, strings and broken text, by rule.
_SHAPES = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || CAST(event_id AS VARCHAR(20)) || '", "tags": ["a", "b' || CAST(event_id % 3 AS VARCHAR(20)) || '"]}' WHEN 2 THEN '[' || props || ', {"k": ' || CAST(event_id AS VARCHAR(20)) || '.5}]' WHEN 3 THEN '{"k": {"deep": [1, 2, ' || CAST(event_id AS VARCHAR(20)) || ']}}' WHEN 4 THEN '{"k": ' || CAST(event_id AS VARCHAR(20)) ELSE '{"k": null, "title": true}' END"""


@query(f"""WITH m AS (SELECT event_id, {_SHAPES} AS meta FROM events), j AS (SELECT event_id, TRY_CAST(CASE WHEN json_valid(meta) THEN meta END AS JSON) AS v FROM m)
  SELECT event_id, CASE WHEN v IS NULL THEN 'malformed' ELSE lower(json_type(v)) END AS shape, TRY_CAST(json_extract_string(v, '$.k') AS BIGINT) AS number, json_extract_string(v, '$.tags[1]') AS tag, TRY_CAST(json_extract_string(v, '$.k.deep[2]') AS BIGINT) AS deep,
    TRY_CAST(json_extract_string(v, '$[1].k') AS DOUBLE) AS second, CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) END AS BIGINT) AS entries FROM j""")
def any_metas(spark, sf_dir):
    """Fields of metas whose shape differs by row; those that cannot be read are told as malformed."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.expr(_SHAPES).alias("meta"))
    return jobs.any_meta(rows, "meta", {"number": ("$.k", "bigint"), "tag": ("$.tags[1]", "string"), "deep": ("$.k.deep[2]", "bigint"), "second": ("$[1].k", "double")}).select("event_id", "shape", "number", "tag", "deep", "second", "entries")


@query("""WITH c AS (SELECT 'job:' || CAST(user_id AS VARCHAR) AS job_id, k, v, ts, event_id FROM (SELECT *, 'status' AS k, event_type AS v FROM events UNION ALL SELECT *, 'part' || event_id % 5, CAST(event_id AS VARCHAR) FROM events))
  SELECT job_id, k, arg_max(v, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS event_id FROM c GROUP BY ALL""")
def durable_jobs(spark, sf_dir):
    """Metas of jobs in a table with versions: three batches are merged, and one that was written but never committed is not seen."""
    rows = _events(spark, sf_dir).select("job_id", "ts", "event_id", F.explode(F.create_map(F.lit("status"), F.col("status"), F.concat(F.lit("part"), (F.col("event_id") % 5).cast("string")), F.col("event_id").cast("string"))).alias("k", "v"))
    folder, key, order = store.new_folder(spark, "versions"), ["job_id", "k"], ["ts", "event_id"]
    for n in (2, 0, 1):
        batch = rows.where(F.col("event_id") % 3 == n)
        versions.merge(folder, batch, key, order)
        versions.prepared(folder, batch.withColumns({"v": F.lit("lost"), "event_id": F.col("event_id") + 1_000_000_000}), key, order)
    return versions.current(spark, folder, rows.schema).select("job_id", "k", "v", "event_id")
