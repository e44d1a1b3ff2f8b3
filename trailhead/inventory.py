"""More registered queries: sources, stores, parsers, filters and functions, each through its library function.

What a store has to hold is written to the session's shared folder first and read back from there.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _DRAFTS, _GREEDY, _LEMMA, _TOKENS, CHUNK_TREE, CHUNKS, ORACLE_SQL, QUERIES, _docs, _drafts, _earlier, _n, _query, _table, plain_chunks, tree_sql
from .functions import hashing as H
from .functions import languages as L
from .functions import russian
from .functions import text as X
from .functions import vectors as V
from .operators import filters as FI
from .operators import pack as K
from .operators import parse as P
from .operators import ranking as RK
from .operators import retrieve as R
from .operators import snapshot as S
from .plans import language as Q
from .plans import seek as SK
from .plans.compile import compile_query
from .plans.engine import Engine
from .sources import connector as CN
from .sources import files as SF
from .sources import postings as PO
from .sources import tables as TB
from .streaming import identity as SI

__all__ = ["ORACLE_SQL", "QUERIES"]


_MADE: list[str] = []


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for a store: under spark.checkpoint.dir, or in a local session without one the warehouse.

    It is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not _MADE:
        atexit.register(_delete_all, spark)
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _delete_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
            for path in _MADE:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# --- files and events


_PLACES = ["", "vendor/", "src/vendor/", "build/a/", "notes.build/", "a/.git/", "vendored/"]


@_query(r"""
    WITH p AS (SELECT doc_id, (['', 'vendor/', 'src/vendor/', 'build/a/', 'notes.build/', 'a/.git/', 'vendored/'])[1 + doc_id % 7] || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.tmp' ELSE '.txt' END AS path FROM documents)
    SELECT doc_id, path FROM p WHERE NOT regexp_matches(path, '(^|/)(\.git|\.trailhead|vendor|node_modules|dist|build|target|bin)/') AND NOT regexp_matches(path, '(^|/)[^/]*\.tmp(/|$)')
""")
def ignored_paths(spark, sf_dir):
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (1 + F.col("doc_id") % 7).cast("int"))
    path = F.concat(place, F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".tmp").otherwise(".txt"))
    patterns = SF.ignore_patterns(["# temporary files", "", "*.tmp"])
    return _docs(spark, sf_dir).select("doc_id", path.alias("path")).where(~F.col("path").rlike(SF.ignore_regex(patterns)))


@_query(r"""SELECT doc_id, regexp_replace(replace('.\\' || source || '\' || doc_id || '.txt', '\', '/'), '^(\./|/)+', '') AS path FROM documents""")
def relative_paths(spark, sf_dir):
    given = F.concat(F.lit(".\\\\"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _docs(spark, sf_dir).select("doc_id", X.relative_path(given).alias("path"))


_SUFFIXES = [".md", ".MARKDOWN", ".txt", ".Text", ".htm", ".html", ".pdf", ".ndjson", ".jsonl", ".exe", ""]


@_query("""
    WITH p AS (SELECT page_id, lower((['.md', '.MARKDOWN', '.txt', '.Text', '.htm', '.html', '.pdf', '.ndjson', '.jsonl', '.exe', ''])[1 + page_id % 11]) AS s FROM pages)
    SELECT page_id, CASE WHEN s IN ('.md', '.markdown') THEN 'text/markdown' WHEN s IN ('.txt', '.text') THEN 'text/plain' WHEN s IN ('.htm', '.html') THEN 'text/html'
           WHEN s = '.pdf' THEN 'application/pdf' WHEN s IN ('.ndjson', '.jsonl') THEN 'application/x-ndjson' END AS media_type FROM p
""")
def media_types(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (1 + F.col("page_id") % 11).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", X.media_type(F.concat(F.lit("a/b"), suffix)).alias("media_type"))


def _event_lines(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit(' {"event_id":"e'), F.col("event_id").cast("string"), F.lit('","message":"'), "event_type", F.lit('"}\r')).alias("value"))


_EVENT_LINE = """'{"event_id":"e' || event_id || '","message":"' || event_type || '"}'"""


@_query(f"SELECT 'e' || event_id AS event_id, event_type AS message, sha256({_EVENT_LINE}) AS payload_checksum FROM events")
def event_lines(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    return SF.event_lines(lines.unionByName(lines.select(F.lit("  ").alias("value")))).select("event_id", "message", "payload_checksum")


@_query(f"SELECT 'e' || event_id AS event_id, sha256({_EVENT_LINE}) AS payload_checksum FROM events")
def event_files(spark, sf_dir):
    return SF.events(spark, _event_folder(spark, sf_dir)).select("event_id", "payload_checksum")


def _event_folder(spark, sf_dir) -> str:
    root = _folder(spark, "event-files")
    for suffix, odd in (("ndjson", 0), ("jsonl", 1)):
        some = _event_lines(spark, sf_dir).withColumn("odd", F.pmod(F.xxhash64("value"), F.lit(2))).where(F.col("odd") == odd).select("value")
        some.write.option("compression", "none").text(f"{root}/day/{suffix}")
    # Spark writes .txt; the listing is by suffix
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for suffix in ("ndjson", "jsonl"):
        for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day/{suffix}")):
            path = status.getPath()
            if path.getName().endswith(".txt"):
                fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(str(path.toString())[:-3] + suffix))
    return root


@_query(f"SELECT 'e' || event_id AS event_id, sha256({_EVENT_LINE}) AS payload_checksum FROM events")
def event_source(spark, sf_dir):
    """The same files as a stream of the source trailhead_events, which ends when it has all."""
    CN.register(spark)
    root, made = _event_folder(spark, sf_dir), _folder(spark, "event-source")
    lines = spark.readStream.format("trailhead_events").option("settle", 0).load(root)
    SI.run_available(spark, SF.event_lines(lines).select("event_id", "payload_checksum"), f"{made}/out", f"{made}/checkpoint")
    return spark.read.parquet(f"{made}/out")


@_query("SELECT 'text/plain' AS media_type, 'file' AS source_type, CAST(sum(strlen(source) + 1) AS BIGINT) AS n_bytes FROM documents")
def document_source(spark, sf_dir):
    """Files read by the source trailhead_documents; its filters leave out those of another suffix and of vendor/."""
    CN.register(spark)
    root = _folder(spark, "document-source")
    for folder in ("notes", "vendor", "other"):
        _docs(spark, sf_dir).select("source").write.option("compression", "none").text(f"{root}/{folder}")
    found = spark.read.format("trailhead_documents").load(root).where("relative_path LIKE '%.txt' AND relative_path LIKE 'notes/%'")
    return found.groupBy("media_type", "source_type").agg(F.sum("length").alias("n_bytes"))




@_query("""
    WITH p AS (SELECT CAST(user_id AS VARCHAR) AS event_id, sha256(event_type || ':' || CAST(user_id % 3 AS VARCHAR)) AS payload_checksum, min(ts) AS first_at FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
    v AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY first_at, payload_checksum) AS version FROM p)
    SELECT event_id, payload_checksum, version, version > 1 AS conflict, false AS late FROM v
""")
def stream_identities(spark, sf_dir):
    """Events by user as a stream in three runs, a range of time after another, each going on at the checkpoint."""
    root = _folder(spark, "event-stream")
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), H.sha256(F.concat("event_type", F.lit(":"), (F.col("user_id") % 3).cast("string"))).alias("payload_checksum"), F.col("ts").cast("timestamp").alias("ingested_at"))
    low, high = e.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    for k in range(3):
        third = F.coalesce(F.floor(3 * (F.unix_micros("ingested_at") - F.unix_micros(F.lit(low))) / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)), F.lit(0))
        e.where(third == k).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        SI.run_available(spark, SI.stream_versions(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@_query("SELECT 'text/plain' AS media_type, 'file' AS source_type, CAST(sum(strlen(source) + 1) AS BIGINT) AS n_bytes FROM documents")
def document_files(spark, sf_dir):
    root = _folder(spark, "document-files")
    _docs(spark, sf_dir).select("source").write.option("compression", "none").text(f"{root}/notes")
    _docs(spark, sf_dir).select("source").write.option("compression", "none").text(f"{root}/vendor/notes")
    return SF.documents(spark, root).groupBy("media_type", "source_type").agg(F.sum("length").alias("n_bytes"))


# --- parsers


_MARKDOWN = r"'# About ' || doc_id || chr(10) || regexp_replace(text, '[\n#]', ' ', 'g') || chr(10) || '## More' || chr(10) || 'tail of ' || source"


@_query(rf"""
    WITH m AS (SELECT doc_id, {_MARKDOWN} AS t FROM documents),
    s AS (SELECT doc_id, t, strlen('# About ' || doc_id) + 1 AS one, strlen(split_part(t, chr(10) || '## More' || chr(10), 1)) + 9 AS two FROM m),
    c AS (
        SELECT doc_id, CAST(one AS BIGINT) AS span_start, CAST(strlen(t) AS BIGINT) AS span_end, 'About ' || doc_id AS titles FROM s
        UNION ALL SELECT doc_id, CAST(two AS BIGINT), CAST(strlen(t) AS BIGINT), 'About ' || doc_id || ' / More' FROM s
    )
    SELECT * FROM c
""")
def markdown_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir)
    body = F.concat(
        F.lit("# About "), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", "[\n#]", " "), F.lit("\n## More\ntail of "), "source",
    )
    files = d.select("doc_id", "relative_path", body.cast("binary").alias("content"), F.lit("text/markdown").alias("media_type"))
    parsed = P.parse(files).select("doc_id", "relative_path", "text", "media_type")
    return P.chunk(parsed, "p", "s1").select("doc_id", "span_start", "span_end", F.array_join("titles", " / ").alias("titles"))


@_query(r"""SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') || ' (end)' AS text, 0.4::DOUBLE AS confidence, true AS low_confidence FROM documents""")
def pdf_strings(spark, sf_dir):
    d = _docs(spark, sf_dir)
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    body = F.concat(F.lit("%PDF-1.4\nBT ("), plain, F.lit(") Tj 0 0 (\\(end\\)) Tj (hidden) ET"))
    files = d.select("doc_id", body.cast("binary").alias("content"), F.lit("application/pdf").alias("media_type"))
    return P.parse(files).select("doc_id", "text", F.col("confidence").cast("double").alias("confidence"), "low_confidence")


# --- filters and scopes


@_query(f"WITH {CHUNKS} SELECT source, CAST(count(*) AS BIGINT) AS n FROM chunk WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 GROUP BY source")
def scoped_chunks(spark, sf_dir):
    c = plain_chunks(spark, sf_dir)
    two = c.withColumns({"snapshot_id": F.when(F.col("doc_id") % 4 == 0, "s0").otherwise("s1"), "tombstoned": F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)})
    return FI.scope(two, "p", "s1").groupBy(F.col("source_authority").alias("source")).agg(F.count("*").alias("n"))


def _marked(spark, sf_dir) -> DataFrame:
    """Chunks with lexical marks made of their document's id."""
    c = plain_chunks(spark, sf_dir)
    mark = lambda letter, n: F.concat(F.lit(letter), (F.col("doc_id") % n).cast("string"))
    return c.withColumns(
        {
            "sense_ids": F.array(mark("s", 3), mark("s", 5)), "concept_ids": F.array(mark("c", 2)), "attestation_ids": F.when(F.col("doc_id") % 7 > 0, F.array(mark("a", 4))),
            "register": F.when(F.col("doc_id") % 2 == 0, "formal").otherwise("plain"), "region": mark("r", 6), "time_period": mark("t", 3), "lexicon_source_id": mark("l", 2),
            "temporal": F.lit(None).cast("struct<start:timestamp,end:timestamp,basis:string>"),
        }
    )


@_query(f"""WITH {CHUNKS} SELECT chunk_id, 'attestation_filter,concept_filter,exact_phrase,sense_filter' AS reasons FROM chunk
    WHERE contains(text, 'the') AND (doc_id % 3 = 2 OR doc_id % 5 = 2) AND doc_id % 2 = 1 AND doc_id % 7 > 0 AND doc_id % 4 = 3""")
def identity_filters(spark, sf_dir):
    found = R.exact(_marked(spark, sf_dir), "the", FI.Filters(sense_id="s2", concept_id="c1", attestation_id="a3"))
    return found.select("chunk_id", F.array_join(F.array_sort(F.col("contributions")[0]["reasons"]), ",").alias("reasons"))


@_query(f"WITH {CHUNKS} SELECT chunk_id FROM chunk WHERE doc_id % 2 = 0 AND doc_id % 6 = 4 AND doc_id % 3 = 1 AND source <> 'src1' AND lang = 'en'")
def all_equality_filters(spark, sf_dir):
    f = FI.Filters(register="formal", region="r4", time_period="t1", lexicon_source_id="l0", language="en", graph_node_id="ignored")
    return _marked(spark, sf_dir).where(FI.condition(f)).where("source_authority <> 'src1'").select("chunk_id")


# --- stores


@_query(f"WITH {CHUNKS} SELECT chunk_id, doc_id FROM chunk WHERE doc_id % 5 <> 0")
def stored_scan(spark, sf_dir):
    path = _folder(spark, "chunk-store")
    c = plain_chunks(spark, sf_dir).withColumn("tombstoned", F.col("doc_id") % 5 == 0)
    TB.put(c.unionByName(c.withColumn("snapshot_id", F.lit("s0"))), path)
    # the partitions of s1 again: replaced, not doubled
    TB.put(c, path)
    return TB.scan(spark, path, "p", "s1").select("chunk_id", "doc_id")


@_query(f"WITH {CHUNKS} SELECT chunk_id, doc_id FROM chunk WHERE doc_id % 11 = 3")
def stored_lookup(spark, sf_dir):
    path = _folder(spark, "chunk-store")
    c = plain_chunks(spark, sf_dir).withColumn("tombstoned", F.col("doc_id") % 2 == 0)
    TB.put(c, path)
    keys = c.where("doc_id % 11 = 3").select("chunk_id")
    return TB.get(spark, path, keys, ["chunk_id"]).select("chunk_id", "doc_id")


@_query("SELECT 'v1' AS embedding_version, CAST(max(len(embedding)) AS INTEGER) AS dimension, CAST(count(*) AS BIGINT) AS n FROM embeddings")
def stored_vectors(spark, sf_dir):
    path = _folder(spark, "vector-store")
    v = _table(spark, sf_dir, "embeddings").select(F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    TB.put_vectors(v, path, "v0")
    TB.put_vectors(v, path, "v1")
    TB.put_vectors(v, path, "v1")
    some = TB.scan(spark, path, "p", "s1").where("embedding_version = 'v1'")
    return some.groupBy("embedding_version").agg(F.max("dimension").cast("int").alias("dimension"), F.count("*").alias("n"))


@_query(r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+') AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM t),
    p AS (SELECT doc_id, token, count(*) AS tf, any_value(n) AS n FROM e WHERE token IN ('the', 'of', 'and') GROUP BY doc_id, token),
    s AS (SELECT doc_id, sum(tf / (1 + ln(n))) AS raw FROM p GROUP BY doc_id HAVING count(*) = 3)
    SELECT doc_id, round(raw, 6) AS raw FROM s ORDER BY raw DESC, doc_id LIMIT 20
""")
def full_text_stored(spark, sf_dir):
    path = _folder(spark, "postings")
    d = _docs(spark, sf_dir).select(F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.col("doc_id").alias("chunk_id"), "text")
    TB.put_postings(d, path)
    best = R.full_text(TB.scan(spark, path, "p", "s1"), "The of AND", 20)
    return best.select(F.col("chunk_id").alias("doc_id"), F.round("raw", 6).alias("raw"))


@_query(f"WITH {CHUNKS}, {CHUNK_TREE}, {tree_sql("'trailhead/chunk-set/v2'", 'chunk_set_hash')} SELECT chunk_set_hash, n FROM tree_root")
def snapshot_bundle(spark, sf_dir):
    store, bundle, other = (_folder(spark, n) for n in ("chunk-store", "bundle", "chunk-store"))
    TB.put(plain_chunks(spark, sf_dir), store)
    TB.export_snapshot(spark, store, "p", "s1", bundle)
    project, snapshot = TB.import_snapshot(spark, bundle, other)
    back = TB.scan(spark, other, project, snapshot)
    return S.chunk_set(back).withColumn("n", F.lit(back.count()))


@_query("SELECT 'q' AS project_id, CAST(count(*) AS BIGINT) AS n FROM documents")
def project_dropped(spark, sf_dir):
    path = _folder(spark, "rows")
    d = _docs(spark, sf_dir).select(F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), "doc_id")
    TB.put(d.unionByName(d.withColumn("project_id", F.lit("q"))), path)
    TB.drop_project(spark, [path], "p", "p")
    return spark.read.parquet(path).groupBy("project_id").agg(F.count("*").alias("n"))


@_query("SELECT * FROM (VALUES ('a', '{\"v\": 2}'), ('c', '{\"v\": 4}')) t(key, payload)")
def metadata_last(spark, sf_dir):
    store = TB.Metadata(spark, _folder(spark, "metadata"))
    for key, document in (("a", {"v": 1}), ("b", {"v": 3}), ("c", {"v": 4}), ("a", {"v": 2})):
        store.put("note", "p", key, document)
    store.put("other", "p", "d", {"v": 5})
    store.delete("note", "p", "b")
    return store.list("note", "p")


@_query("SELECT 's' || doc_id AS id, lang AS lemma, 'c' || source AS concept FROM documents")
def lexicon_senses(spark, sf_dir):
    path = _folder(spark, "lexicon")
    sense = F.struct(F.concat(F.lit("s"), "doc_id").alias("id"), F.col("lang").alias("lemma"), F.array(F.concat(F.lit("c"), "source")).alias("concept_ids"))
    concept = F.struct(F.concat(F.lit("c"), "source").alias("id"), F.col("source").alias("label"))
    d = _docs(spark, sf_dir)
    # a resource is one document in one file; here one for each source
    each = d.groupBy("source").agg(F.collect_list(sense).alias("senses"), F.array_distinct(F.collect_list(concept)).alias("concepts"))
    each.drop("source").write.option("maxRecordsPerFile", 1).json(path)
    tables = TB.lexicon(spark, path)
    concepts = tables["concepts"].distinct().withColumnRenamed("id", "concept")
    return tables["senses"].withColumn("concept", F.explode("concept_ids")).join(concepts, "concept").select("id", "lemma", "concept")


@_query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def history_newest(spark, sf_dir):
    path = _folder(spark, "history")
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    # the order needs no ties
    e = e.withColumn("at", F.struct(F.col("ts"), (-F.col("event_id")).alias("n")))
    TB.append_history(e.where("event_id % 2 = 0"), path)
    TB.append_history(e.where("event_id % 2 = 1"), path)
    return TB.history(spark, path).select("event_id", "ts")


@_query("""
    WITH a AS (SELECT source AS s, doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source AS s, doc_id FROM documents WHERE doc_id % 4 <> 0)
    SELECT 'added' AS status, CAST(count(*) AS BIGINT) AS n FROM b ANTI JOIN a USING (doc_id)
    UNION ALL SELECT 'removed', count(*) FROM a ANTI JOIN b USING (doc_id)
    UNION ALL SELECT 'unchanged', count(*) FROM a SEMI JOIN b USING (doc_id)
""")
def ingest_changes(spark, sf_dir):
    engine = _engine(spark)
    files = _docs(spark, sf_dir).select("doc_id", "relative_path", F.col("text").cast("binary").alias("content"), "media_type", F.lit("file").alias("source_type"))
    engine.ingest(files.where("doc_id % 3 <> 0").drop("doc_id"), "p", "s1")
    counts = engine.ingest(files.where("doc_id % 4 <> 0").drop("doc_id"), "p", "s2")
    return spark.createDataFrame(sorted(counts.items()), "status string, n long")


@_query(f"""
    WITH {CHUNKS}, n AS (SELECT count_if(doc_id % 3 = 0 OR doc_id % 7 = 0) AS n_parsed FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL)
    SELECT 's2' AS snapshot_id, chunk_id, span_start, span_end, text_checksum, n_parsed FROM chunk, n WHERE doc_id % 4 <> 0
""")
def ingest_incremental(spark, sf_dir):
    """A snapshot whose unchanged files' chunks are copied: two thirds are known, a seventh of them had another text."""
    engine = _engine(spark)
    engine.ingest(_files(spark, sf_dir, F.col("doc_id") % 3 != 0, F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))), "p", "s1")
    engine.ingest(_files(spark, sf_dir, (F.col("doc_id") % 4 != 0) & F.col("text").isNotNull()), "p", "s2")
    found = engine.chunks("p").select("snapshot_id", "chunk_id", "span_start", "span_end", "text_checksum")
    return found.withColumn("n_parsed", F.lit(engine.state("p", "s2")["parsed"]).cast("long"))


# --- functions


@_query("""
    WITH c AS (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages),
    b AS (SELECT page_id, strlen(url[1:i - 1]) % 8 AS slot, (unicode(url[i]) % 31) / 31.0 AS x FROM c),
    s AS (SELECT page_id, slot, sum(x) AS x FROM b GROUP BY ALL)
    SELECT page_id, CAST(slot AS BIGINT) AS slot, round(x, 3) AS value FROM s
""")
def rune_embeddings(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.length("url").alias("n"), F.posexplode(V.embed(F.col("url"), "rune")).alias("slot", "value"))
    # slots that no byte falls into aren't listed
    return p.where("slot < n").select("page_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 3).alias("value"))


@_query("""
    WITH RECURSIVE b AS (
        SELECT doc_id, 0 AS k, sha256(coalesce(text, '')) AS h FROM documents
        UNION ALL SELECT doc_id, k + 1, sha256(unhex(h)) FROM b WHERE k < 3
    ), w AS (
        SELECT doc_id, 8 * k + i AS place, CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) AS u FROM (SELECT *, unnest(range(0, 8)) AS i FROM b)
    ), v AS (
        SELECT doc_id, place, CAST((CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) / 2147483648.0::DOUBLE AS FLOAT) AS x FROM w
    ), n AS (
        SELECT doc_id, CAST(1 / sqrt(sum(x::DOUBLE * x::DOUBLE)) AS FLOAT) AS s FROM v GROUP BY doc_id
    )
    SELECT doc_id, CAST(place AS BIGINT) AS place, round((x * s)::DOUBLE, 6) AS value FROM v JOIN n USING (doc_id)
""")
def digest_embeddings(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(V.embed(F.col("text"))).alias("place", "value"))
    return d.select("doc_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@_query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS n_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", V.tokens_estimate(F.length("text")).alias("n_tokens"))


_RUSSIAN = ["Ёлка", "ёж", "МЁД", "Книга", "учёный", "все", "всё", "й", "Йод", "hello", ""]


@_query("SELECT word, replace(lower(nfc_normalize(word)), 'ё', 'е') AS folded FROM (VALUES ('Ёлка'), ('ёж'), ('МЁД'), ('Книга'), ('учёный'), ('все'), ('всё'), ('й'), ('Йод'), ('hello'), ('')) t(word)")
def russian_fold(spark, sf_dir):
    return spark.createDataFrame([(w, russian.fold(w)) for w in _RUSSIAN], "word string, folded string")


_TAGS = ["en", "EN-us", "en_GB", "ru", "ru-RU", "de", "", "english"]


@_query("SELECT given, CASE WHEN base IN ('en', 'ru') THEN base ELSE '' END AS adapter FROM (SELECT given, split_part(replace(lower(given), '_', '-'), '-', 1) AS base FROM (VALUES ('en'), ('EN-us'), ('en_GB'), ('ru'), ('ru-RU'), ('de'), (''), ('english')) t(given))")
def language_registry(spark, sf_dir):
    return spark.createDataFrame([(t, L.adapter(t).tag) for t in _TAGS], "given string, adapter string")


@_query(r"""
    SELECT lang, w AS word, CASE WHEN lang = 'en' AND ends_with(w, 's') AND strlen(w) > 3 AND NOT ends_with(w, 'ss') THEN w || ',' || w[1:length(w) - 1] ELSE w END AS lemmas
    FROM (SELECT DISTINCT lang, lower(unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_-]+'))) AS w FROM documents)
""")
def simple_lemmas(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    none, english = L.adapter("xx"), L.adapter("en")
    lemmas = F.when(F.col("lang") == "en", english.lemmas(F.col("word"))).otherwise(none.lemmas(F.col("word")))
    return d.select("lang", none.norm(F.col("word")).alias("word"), F.array_join(lemmas, ",").alias("lemmas"))


_QUERIES = {
    "alpha beta": "(AND alpha beta)",
    "alpha OR beta gamma": "(OR alpha (AND beta gamma))",
    "alpha -beta": "(AND alpha (NOT beta))",
    '"green field" -(red OR blue)': '(AND "green field" (NOT (OR red blue)))',
    "~walks lang:en": "~walks",
    "-alpha": "rejected",
    "alpha OR -beta": "rejected",
    "(alpha": "rejected",
    '"open': "rejected",
    "alpha --beta": "rejected",
    "": "rejected",
}


@_query("SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + "', '" + c + "')" for q, c in _QUERIES.items()) + ") t(query, canonical)")
def query_forms(spark, sf_dir):
    def form(text: str) -> str:
        try:
            return Q.canonical(Q.parse(text).root)
        except Q.QueryError:
            return "rejected"

    return spark.createDataFrame([(q, form(q)) for q in _QUERIES], "query string, canonical string")


# --- packs


@_query(_GREEDY % _DRAFTS + """
    , taken AS (SELECT pack_id, doc_id FROM pick WHERE doc_id IS NOT NULL)
    SELECT r.pack_id, CAST(r.doc_id AS VARCHAR) AS id, 'budget_trim' AS reason FROM ranked r ANTI JOIN taken t USING (pack_id, doc_id) WHERE r.score >= 0.9
""")
def pack_rejections(spark, sf_dir):
    return K.rejections(_drafts(spark, sf_dir), K.Budget(max_items=8, max_chars=4000, reject_floor=0.9)).select("pack_id", "id", "reason")


_CLASSES = ["source_text", "sense_claim", "concept_mapping", "model_inference", "tool_output", "attestation"]


@_query("""
    WITH e AS (SELECT doc_id, (['source_text', 'sense_claim', 'concept_mapping', 'model_inference', 'tool_output', 'attestation'])[1 + doc_id % 6] AS class FROM documents),
    c AS (
        SELECT doc_id, 'pack_checksum_mismatch' AS code FROM e WHERE doc_id % 10 = 0
        UNION ALL SELECT doc_id, 'unsupported_sense_as_fact' FROM e WHERE class = 'sense_claim' AND doc_id % 4 <> 1
        UNION ALL SELECT doc_id, 'unsupported_concept_as_fact' FROM e WHERE class = 'concept_mapping'
        UNION ALL SELECT doc_id, 'unsupported_model_inference_as_fact' FROM e WHERE class = 'model_inference' OR class = 'tool_output' AND doc_id % 4 <> 0
        UNION ALL SELECT doc_id, 'missing_source_ref' FROM e WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id, 'missing_checksum' FROM e WHERE doc_id % 7 = 1
    )
    SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes FROM c GROUP BY doc_id
""")
def verify_codes(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _CLASSES)), (1 + F.col("doc_id") % 6).cast("int"))
    name = F.col("doc_id").cast("string")
    item = F.struct(
        name.alias("id"), kind.alias("class"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("s").alias("source_id"), F.lit(0).alias("span_start"),
        F.lit(5).alias("span_end"), F.when(F.col("doc_id") % 7 != 1, "c").alias("checksum"),
    )
    some = lambda on: F.when(on, F.array(name))
    given: Column = F.when(F.col("doc_id") % 10 == 0, "x").otherwise("y")
    found = K.flags(F.array(item), given, F.lit("y"), F.array(name), some((kind == "sense_claim") & (F.col("doc_id") % 4 == 1)), some((kind == "tool_output") & (F.col("doc_id") % 4 == 0)))
    codes = F.array_join(F.array_sort(F.transform(found, lambda x: x["code"])), ",")
    return _docs(spark, sf_dir).select("doc_id", codes.alias("codes")).where("codes <> ''")


@_query("SELECT source, CASE WHEN n >= 52 OR longest >= 9000 THEN 'deny' WHEN n >= 41 OR longest >= 7200 THEN 'ask' ELSE 'allow' END AS decision FROM (SELECT source, count(*) AS n, max(length(text)) AS longest FROM documents GROUP BY source)")
def quota_decisions(spark, sf_dir):
    u = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    both = F.array(S.quota(F.col("n"), F.lit(52)), S.quota(F.col("longest"), F.lit(9000)), S.quota(F.lit(5), F.lit(0)))
    return u.select("source", S.decide(both).alias("decision"))



# --- the engine


def _files(spark, sf_dir, keep: Column, text: Column | None = None) -> DataFrame:
    d = _docs(spark, sf_dir).where(keep)
    return d.select("relative_path", (F.col("text") if text is None else text).cast("binary").alias("content"), "media_type", F.lit("file").alias("source_type"))


def _engine(spark) -> Engine:
    return Engine(spark, _folder(spark, "engine"))


@_query("SELECT * FROM (VALUES ('s1', 'superseded', true, ''), ('s2', 'ready', true, ''), ('s3', 'failed', false, 'broken')) t(snapshot_id, status, sealed, reason)")
def snapshot_states(spark, sf_dir):
    def broken(c: DataFrame) -> DataFrame:
        raise RuntimeError("broken")

    engine = _engine(spark)
    for snapshot, n in (("s1", 3), ("s2", 4)):
        engine.ingest(_files(spark, sf_dir, F.col("doc_id") % n != 0), "p", snapshot)
    try:
        engine.ingest(_files(spark, sf_dir, F.lit(True)), "p", "s3", enrich=broken)
    except RuntimeError:
        pass
    rows = [(k, engine.state("p", k)) for k in ("s1", "s2", "s3")]
    found = [(k, x["status"], bool(x.get("source_root") and x.get("chunk_set_hash")), x.get("reason", "").rpartition(": ")[2]) for k, x in rows]
    return spark.createDataFrame(found, "snapshot_id string, status string, sealed boolean, reason string")


@_query("""
    SELECT sha256('p' || chr(0) || source || '/' || doc_id || '.txt')[1:16] AS source_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 's2' ELSE 'requested' END AS why
    FROM documents WHERE (doc_id % 3 <> 0 AND doc_id % 4 = 0) OR (doc_id % 4 <> 0 AND doc_id % 5 = 1)
""")
def tombstones(spark, sf_dir):
    engine = _engine(spark)
    for snapshot, n in (("s0", 4), ("s1", 3), ("s2", 4)):
        # what s1 drops is back in s2, and what s2 drops was back in s1
        engine.ingest(_files(spark, sf_dir, F.col("doc_id") % n != 0), "p", snapshot)
    d = _docs(spark, sf_dir).where("doc_id % 4 <> 0 AND doc_id % 5 = 1")
    engine.remove(d.select(F.substring(H.path_key("p", F.col("relative_path")), 1, 16).alias("source_id")), "p")
    return engine.tombstones("p").select("source_id", "why")


@_query(f"""WITH {CHUNKS} SELECT chunk_id FROM chunk WHERE contains(text, 'of the') AND doc_id % 4 <> 0 AND doc_id % 5 <> 1 ORDER BY chunk_id LIMIT 20""")
def tombstone_search(spark, sf_dir):
    engine = _engine(spark)
    engine.ingest(_files(spark, sf_dir, F.col("doc_id") % 4 != 0), "p", "s1")
    d = _docs(spark, sf_dir).where("doc_id % 5 = 1")
    engine.remove(d.select(F.substring(H.path_key("p", F.col("relative_path")), 1, 16).alias("source_id")), "p")
    return engine.search("p", "of the", "exact").select("chunk_id")


@_query(f"""
    WITH {CHUNKS}, t AS (SELECT chunk_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_-]+') AS w FROM chunk),
    e AS (SELECT chunk_id, text, len(w) AS n, len(list_filter(w, lambda x: x = 'of')) AS f, len(list_filter(w, lambda x: x = 'the')) AS g FROM t),
    s AS (SELECT chunk_id, text, f / (1 + ln(n)) + g / (1 + ln(n)) AS raw FROM e WHERE f > 0 AND g > 0 ORDER BY raw DESC, chunk_id LIMIT 20)
    SELECT chunk_id, (strlen(text) + CASE WHEN contains(lower(text), 'the of') THEN 100 ELSE 0 END)::DOUBLE AS score FROM s
""")
def full_text_reranked(spark, sf_dir):
    engine = _engine(spark)
    engine.ingest(_files(spark, sf_dir, F.lit(True)), "p", "s1")
    return engine.search("p", "the of", "full-text", rerank=True).select("chunk_id", F.col("merged_score").alias("score"))


@_query(f"""WITH {CHUNKS} SELECT chunk_id, 'sparse,term' AS retrievers FROM (
        SELECT chunk_id FROM chunk WHERE list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_-]+'), 'und') ORDER BY chunk_id LIMIT 20)""")
def sparse_reinforced(spark, sf_dir):
    engine = _engine(spark)
    engine.ingest(_files(spark, sf_dir, F.lit(True)), "p", "s1")
    found = engine.search("p", "und", "query")
    return found.select("chunk_id", F.array_join(F.array_sort(F.transform("contributions", lambda c: c["retriever"])), ",").alias("retrievers"))


# --- the positional index


def _whole(spark, sf_dir) -> DataFrame:
    """Documents as chunks of their own, named by their id."""
    d = _docs(spark, sf_dir)
    return d.select(
        F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("relative_path").alias("source_id"),
        F.lit(0).cast("long").alias("span_start"), F.octet_length("text").cast("long").alias("span_end"), "text", F.lit("").alias("text_checksum"), F.lit("external").alias("trust_level"), "doc_id",
    )


def _index(spark, sf_dir, *languages: str) -> PO.Index:
    path = _folder(spark, "index")
    PO.put(_whole(spark, sf_dir), path, languages)
    return PO.Index(spark, path, "p", "s1")


#: Queries, what they match in SQL, the score that a match adds up to, and its priority.
_ASKED = [
    ("License the", f"{_n('license')} > 0 AND {_n('the')} > 0", "1.9", 1),
    ("password | License", f"{_n('password')} > 0 OR {_n('license')} > 0", f"CASE WHEN {_n('password')} > 0 THEN 0.95 ELSE 0 END + CASE WHEN {_n('license')} > 0 THEN 0.95 ELSE 0 END", 1),
    ("the -of", f"{_n('the')} > 0 AND {_n('of')} = 0", "0.95", 1),
    ('(the OR la) AND "and of" NOT hein', f"({_n('the')} > 0 OR {_n('la')} > 0) AND contains(text, 'and of') AND {_n('hein')} = 0", f"CASE WHEN {_n('the')} > 0 THEN 0.95 ELSE 0 END + CASE WHEN {_n('la')} > 0 THEN 0.95 ELSE 0 END + 1.0", 0),
    ('"icense of"', "contains(text, 'icense of')", "1.0", 0),
    ("lang:en that AND (running OR that)", f"{_n('that')} > 0", f"1.9 + CASE WHEN {_n('running', 'run')} > 0 THEN 0.95 ELSE 0 END", 1),
]


@_query(
    f"WITH {_TOKENS}, e AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM tok), l AS (SELECT doc_id, i, t, {_LEMMA.format(x='t')} AS lemma FROM e) "
    + " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id, CAST(round({score}, 6) AS DOUBLE) AS merged_score, {p} AS priority FROM tok WHERE {where}" for q, where, score, p in _ASKED)
    + """ UNION ALL SELECT DISTINCT '~"rights reserved"', a.doc_id, 0.9::DOUBLE, 1 FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    WHERE (a.t IN ('rights', 'right') OR a.lemma IN ('rights', 'right')) AND (b.t = 'reserved' OR b.lemma = 'reserved')"""
)
def index_queries(spark, sf_dir):
    index, c, out = _index(spark, sf_dir, "en"), _whole(spark, sf_dir), None
    for query, language in [*((q, "") for q, *_ in _ASKED), ('~"rights reserved"', "en")]:
        found = compile_query(c, query, language, index=index).candidates
        rows = found.select(F.lit(query).alias("query"), F.col("chunk_id").cast("long").alias("doc_id"), F.round("merged_score", 6).alias("merged_score"), "priority")
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+') AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM t),
    p AS (SELECT doc_id, token, count(*) AS tf, any_value(n) AS n FROM e WHERE token IN ('the', 'of', 'and') GROUP BY doc_id, token),
    s AS (SELECT doc_id, round(sum(tf / (1 + ln(n))), 9) AS raw FROM p GROUP BY doc_id HAVING count(*) = 3)
    SELECT doc_id, raw FROM s ORDER BY raw DESC, CAST(doc_id AS VARCHAR) LIMIT 20
""")
def index_top(spark, sf_dir):
    best = RK.top(_index(spark, sf_dir), "The of AND", 20)
    return best.select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("raw", 9).alias("raw"))


@_query(r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+') AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM t),
    last AS (
        SELECT doc_id, i, max(i) FILTER (token = 'the') OVER o AS a, max(i) FILTER (token = 'of') OVER o AS b, max(i) FILTER (token = 'and') OVER o AS c
        FROM e WHERE token IN ('the', 'of', 'and') WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ), cover AS (
        SELECT doc_id, least(a, b, c) AS s, min(i) AS e FROM last WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL
    )
    SELECT doc_id, CAST(count(*) AS INTEGER) AS covers, round(sum(3 / (e - s + 1)), 6) AS raw FROM cover GROUP BY doc_id
""")
def index_cover_density(spark, sf_dir):
    found = RK.cover_density(_index(spark, sf_dir), "The of AND")
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"), "covers", F.round("raw", 6).alias("raw"))


@_query("""
    SELECT 'exact' AS kind, doc_id, 1.0::DOUBLE AS raw FROM documents WHERE contains(text, 'of the')
    UNION ALL SELECT 'folded', doc_id, 1.0 FROM documents WHERE contains(lower(text), 'e of t')
    UNION ALL SELECT 'overlap', doc_id, raw FROM (
        SELECT doc_id, CAST(contains(lower(text), 'thing')::INT + contains(lower(text), 'ander')::INT + contains(lower(text), '@exa')::INT AS DOUBLE) AS raw FROM documents) WHERE raw > 0
""")
def index_substrings(spark, sf_dir):
    index, c = _index(spark, sf_dir), _whole(spark, sf_dir)
    exact = R.exact(SK.narrow(index, c, ["of the"]), "of the", extra=["doc_id"]).select("doc_id", F.lit(1.0).alias("raw"))
    folded = R.folded(SK.narrow(index, c, ["E of T"]), "E of T").select("doc_id", F.lit(1.0).alias("raw"))
    query = "thing Ander @exa"
    some = SK.narrow(index, c, query.lower().split())
    overlap = some.select("doc_id", R.overlap(F.col("text"), query).alias("raw")).where("raw > 0")
    out = None
    for kind, rows in (("exact", exact), ("folded", folded), ("overlap", overlap)):
        rows = rows.select(F.lit(kind).alias("kind"), "doc_id", "raw")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- trees over manifests


@_query(ORACLE_SQL["manifest_diff"].replace("SELECT coalesce(b.path_key", "SELECT * FROM (SELECT coalesce(b.path_key") + ") WHERE status <> 'unchanged'")
def manifest_tree_diff(spark, sf_dir):
    path = _folder(spark, "manifests")
    docs = _docs(spark, sf_dir).withColumn("source_type", F.lit("file"))
    for snapshot, files in (("s1", _earlier(docs)), ("s2", docs)):
        leaves = S.source_leaves(files, "p", content="text").withColumns({"project_id": F.lit("p"), "snapshot_id": F.lit(snapshot)})
        TB.put_leaves(leaves, f"{path}/leaves", f"{path}/trees")
    old, new = ((TB.scan(spark, f"{path}/leaves", "p", s), TB.scan(spark, f"{path}/trees", "p", s)) for s in ("s1", "s2"))
    return S.tree_changes(old[0], new[0], old[1], new[1])
