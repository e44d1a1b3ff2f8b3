"""Registered queries of the retrieval engine, and their SQL.

Documents become chunks of project p, snapshot s1: one file <source>/<doc_id>.txt each, cut into paragraphs. Trust
follows the labels: toxic is quarantined, good is project, other labelled ones are untrusted, the rest external.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions import text as X
from .functions import vectors as V
from .operators import filters as FI
from .operators import merge as M
from .operators import pack as K
from .operators import parse as P
from .operators import retrieve as R
from .operators import snapshot as S
from .plans.compile import compile_query
from .sources import files as SF
from .sources import tables as TB
from .streaming import events as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = TB.spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", "text", "lang", "source", path.alias("relative_path"), F.lit("text/plain").alias("media_type"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table that the queries search."""
    c = P.chunk(_docs(spark, sf_dir), "p", "s1")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    trust = F.when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 1, "project").when(F.col("quality").isNotNull(), "untrusted").otherwise("external")
    return c.join(labels, "doc_id", "left").select(
        "project_id", "snapshot_id", "chunk_id", "chunk_hash", "source_id", "path_key", "span_start", "span_end", "text",
        "text_checksum", trust.alias("trust_level"), F.col("lang").alias("language"), F.col("source").alias("source_authority"),
        F.lit(None).cast("timestamp").alias("temporal"), F.lit(False).alias("tombstoned"), "doc_id",
    )


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the labels: trust is external."""
    c = P.chunk(_docs(spark, sf_dir), "p", "s1")
    return c.select(
        "project_id", "snapshot_id", "chunk_id", "chunk_hash", "source_id", "path_key", "span_start", "span_end", "text", "text_checksum",
        F.lit("external").alias("trust_level"), F.col("lang").alias("language"), F.col("source").alias("source_authority"), "doc_id",
    )


#: The chunk table in SQL.
CHUNKS = r"""
    file AS (
        SELECT doc_id, text AS doc_text, lang, source, sha256('p' || chr(0) || source || '/' || doc_id || '.txt') AS path_key
        FROM documents WHERE text IS NOT NULL
    ), part AS (
        SELECT *, string_split(doc_text, chr(10) || chr(10)) AS parts FROM file
    ), piece AS (
        SELECT * EXCLUDE (parts, i), parts[i] AS p, coalesce(list_sum(list_transform(parts[1:i-1], lambda x: strlen(x) + 2)), 0) AS base
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM part)
    ), body AS (
        SELECT doc_id, lang, source, path_key, trim(p, chr(10) || ' ' || chr(9)) AS text,
               CAST(base + length(p) - length(ltrim(p, chr(10) || ' ' || chr(9))) AS BIGINT) AS span_start
        FROM piece WHERE trim(p, chr(10) || ' ' || chr(9)) <> ''
        UNION ALL
        SELECT doc_id, lang, source, path_key, doc_text, CAST(0 AS BIGINT) FROM file
        WHERE doc_text <> '' AND trim(doc_text, chr(10) || ' ' || chr(9)) = ''
    ), hashed AS (
        SELECT *, span_start + strlen(text) AS span_end, sha256(text) AS text_checksum, path_key[1:16] AS source_id,
               sha256(encode('trailhead/chunk/v1') || '\x00'::BLOB || encode('paragraph-v1') || '\x00'::BLOB || encode(path_key) || '\x00'::BLOB
                      || unhex(printf('%016x', span_start)) || unhex(printf('%016x', CAST(span_start + strlen(text) AS BIGINT))) || '\x00'::BLOB
                      || unhex(sha256(text))) AS chunk_hash
        FROM body
    ), chunk AS (
        SELECT *, 'chk_p_' || chunk_hash[1:16] AS chunk_id FROM hashed
    )
"""


def _trusted(sql: str) -> str:
    return f"""{CHUNKS}, chunk_t AS (
        SELECT c.*, CASE WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 1 THEN 'project' WHEN l.quality IS NOT NULL THEN 'untrusted'
                    ELSE 'external' END AS trust_level
        FROM chunk c LEFT JOIN labels l USING (doc_id)
    ) {sql}"""


# --- chunks, hashes, manifests


@_query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, source_id, span_start, CAST(span_end AS BIGINT) AS span_end, CAST(length(text) AS BIGINT) AS n_chars FROM chunk")
def paragraph_chunks(spark, sf_dir):
    return plain_chunks(spark, sf_dir).select("doc_id", "chunk_id", "source_id", "span_start", "span_end", F.length("text").cast("long").alias("n_chars"))


@_query(f"WITH {CHUNKS} SELECT doc_id, path_key, chunk_hash, text_checksum FROM chunk")
def chunk_hash(spark, sf_dir):
    return plain_chunks(spark, sf_dir).select("doc_id", "path_key", "chunk_hash", "text_checksum")


def tree_sql(head: str, out: str, by: str = "") -> str:
    """The root over rows (by, k: the key in hexadecimal, o: what orders rows, line) of a table tree_rows, in SQL."""
    also = f"{by}, " if by else ""
    return f"""tree_leaf AS (
        SELECT {also}k[1:3] AS p, sha256('trailhead/tree-leaf/v1' || chr(0) || string_agg(line, '' ORDER BY o)) AS d, count(*) AS n FROM tree_rows GROUP BY {also}k[1:3]
    ), tree_node AS (
        SELECT {also}p[1:1] AS p, sha256('trailhead/tree-node/v1' || chr(0) || string_agg(p || chr(0) || d || chr(0), '' ORDER BY p)) AS d, sum(n) AS n FROM tree_leaf GROUP BY {also}p[1:1]
    ), tree_root AS (
        SELECT {also}sha256({head} || chr(0) || string_agg(p || chr(0) || d || chr(0), '' ORDER BY p)) AS {out}, CAST(sum(n) AS BIGINT) AS n FROM tree_node GROUP BY {by or "ALL"}
    )"""


CHUNK_TREE = "tree_rows AS (SELECT *, chunk_hash AS k, chunk_hash AS o, chunk_hash || chr(0) AS line FROM chunk)"


@_query(f"WITH {CHUNKS}, {CHUNK_TREE}, {tree_sql("'trailhead/chunk-set/v2'", 'chunk_set_hash', 'source')} SELECT source, chunk_set_hash FROM tree_root")
def chunk_set_hash(spark, sf_dir):
    return S.chunk_set(plain_chunks(spark, sf_dir).withColumnRenamed("source_authority", "source"), ["source"])


_LEAVES = """leaf AS (
        SELECT source, sha256('p' || chr(0) || source || '/' || doc_id || '.txt') AS path_key, text FROM documents
    ), leaves AS (
        SELECT source, path_key, sha256('trailhead/source-leaf/v1' || chr(0) || path_key || chr(0) || 'file' || chr(0) || sha256(text)) AS leaf FROM leaf
    )"""


@_query(f"WITH {_LEAVES} SELECT path_key, leaf FROM leaves")
def source_leaf(spark, sf_dir):
    return S.source_leaves(_docs(spark, sf_dir).withColumn("source_type", F.lit("file")), "p", content="text")


_LEAF_TREE = "tree_rows AS (SELECT path_key AS k, path_key AS o, path_key || chr(0) || leaf || chr(0) AS line FROM leaves)"


@_query(f"WITH {_LEAVES}, {_LEAF_TREE}, {tree_sql("'trailhead/source-root/v2'", 'source_root')} SELECT source_root FROM tree_root")
def source_root(spark, sf_dir):
    return S.source_root(source_leaf(spark, sf_dir))


def _earlier(docs: DataFrame) -> DataFrame:
    """A former state: every tenth document is missing, every seventh had one more word, one has gone since."""
    gone = docs.where("doc_id = 3").withColumns({"relative_path": F.lit("gone/3.txt")})
    old = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    return old.unionByName(gone)


@_query("""
    WITH now AS (SELECT sha256('p' || chr(0) || source || '/' || doc_id || '.txt') AS path_key, sha256(text) AS leaf FROM documents),
    before AS (
        SELECT sha256('p' || chr(0) || source || '/' || doc_id || '.txt') AS path_key, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' old' ELSE text END) AS leaf
        FROM documents WHERE doc_id % 10 <> 0
        UNION ALL SELECT sha256('p' || chr(0) || 'gone/3.txt'), sha256(text) FROM documents WHERE doc_id = 3
    )
    SELECT coalesce(b.path_key, n.path_key) AS path_key,
           CASE WHEN b.leaf IS NULL THEN 'added' WHEN n.leaf IS NULL THEN 'removed' WHEN b.leaf <> n.leaf THEN 'changed' ELSE 'unchanged' END AS status
    FROM before b FULL OUTER JOIN now n USING (path_key)
""")
def manifest_diff(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("source_type", F.lit("file"))
    return S.diff_sources(S.source_leaves(_earlier(docs), "p", content="text"), S.source_leaves(docs, "p", content="text"))


@_query("""
    WITH now AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), before AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(b.h, n.h) AS chunk_hash, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'unchanged' END AS status
    FROM before b FULL OUTER JOIN now n ON b.h = n.h
""")
def chunk_diff(spark, sf_dir):
    texts = _docs(spark, sf_dir).withColumn("chunk_hash", H.sha256(F.col("text")))
    return S.diff_chunks(texts.where("doc_id % 3 <> 0"), texts.where("doc_id % 5 <> 0"))


@_query("SELECT sha256(text) AS text_checksum, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def near_dup_key(spark, sf_dir):
    d = _docs(spark, sf_dir).groupBy(H.sha256(F.col("text")).alias("text_checksum"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# --- predicates


@_query("SELECT doc_id, 1.0::DOUBLE AS merged_score FROM documents WHERE contains(text, 'of the')")
def exact_phrase(spark, sf_dir):
    c = plain_chunks(spark, sf_dir)
    return M.scored(R.exact(c, "of the", extra=["doc_id"])).select("doc_id", "merged_score")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the of')")
def folded_phrase(spark, sf_dir):
    return R.folded(plain_chunks(spark, sf_dir), "THE of").select("doc_id")


@_query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source = 'src1'")
def meta_filter(spark, sf_dir):
    f = FI.Filters(language="fr", source_authority="src1")
    return plain_chunks(spark, sf_dir).where(FI.condition(f)).select("doc_id", F.col("language").alias("lang"), F.col("source_authority").alias("source"))


@_query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def tombstone_anti(spark, sf_dir):
    gone = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))
    docs = _docs(spark, sf_dir).withColumn("source_id", F.col("doc_id"))
    return FI.without_tombstones(docs, gone).select("doc_id")


@_query("WITH " + _trusted("SELECT doc_id, trust_level FROM chunk_t WHERE trust_level = 'project'"))
def trust_gate(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.where(FI.trusted(F.col("trust_level"), "project")).select("doc_id", "trust_level")


# --- sparse, hybrid, order


@_query("""
    SELECT doc_id, CAST(contains(lower(text), 'thing')::INT + contains(lower(text), 'ander')::INT + contains(lower(text), 'nation')::INT AS DOUBLE) AS raw
    FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(text), 'ander') OR contains(lower(text), 'nation')
""")
def sparse_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", R.overlap(F.col("text"), "thing Ander nation").alias("raw")).where("raw > 0")


_SPARSE = """hit AS (
        SELECT chunk_id, doc_id, lang, CAST(contains(lower(text), 'thing')::INT + contains(lower(text), 'ander')::INT + contains(lower(text), 'password')::INT AS DOUBLE) AS raw
        FROM chunk
    ), best AS (SELECT * FROM hit WHERE raw > 0 ORDER BY raw DESC, chunk_id LIMIT 20)"""
_NORM = "CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END"


def _sparse_hits(spark, sf_dir, f=FI.Filters()):
    return R.sparse(plain_chunks(spark, sf_dir), "thing ander password", 20, f)


@_query(f"WITH {CHUNKS}, {_SPARSE} SELECT chunk_id, raw, CAST({_NORM} AS DOUBLE) AS norm FROM best")
def sparse_topk_norm(spark, sf_dir):
    c = F.element_at("contributions", 1)
    return _sparse_hits(spark, sf_dir).select("chunk_id", c["raw"].alias("raw"), c["norm"].alias("norm"))


@_query(f"WITH {CHUNKS}, {_SPARSE} SELECT chunk_id, raw, CAST({_NORM} AS DOUBLE) AS norm FROM best WHERE lang = 'en'")
def limit_then_filter(spark, sf_dir):
    c = F.element_at("contributions", 1)
    return _sparse_hits(spark, sf_dir, FI.Filters(language="en")).select("chunk_id", c["raw"].alias("raw"), c["norm"].alias("norm"))


@_query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_-]+') AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM t),
    p AS (SELECT doc_id, token, count(*) AS tf, any_value(n) AS n FROM e WHERE token IN ('the', 'of', 'and') GROUP BY doc_id, token)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS tf, round(sum(tf / (1 + ln(n))), 6) AS raw FROM p GROUP BY doc_id HAVING count(*) = 3
""")
def full_text(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.col("doc_id").alias("chunk_id"), "text")
    hits = R.postings(d).where(F.col("token").isin("the", "of", "and")).withColumn("part", F.col("tf") / (1 + F.log(F.col("n_tokens").cast("double"))))
    out = hits.groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tf"), F.round(F.sum("part"), 6).alias("raw"))
    return out.where("n_terms = 3")


@_query(f"""
    WITH {CHUNKS}, {_SPARSE}, s AS (
        SELECT chunk_id, raw, {_NORM} AS norm FROM best
    ), c AS (
        SELECT chunk_id, 1.0 * 1.0 AS part, 0 AS priority, 'exact' AS retriever FROM chunk WHERE contains(text, 'thing ander password')
        UNION ALL SELECT chunk_id, 0.75 * norm, 2, 'sparse' FROM s
        UNION ALL SELECT chunk_id, 1.0, 0, 'exact' FROM chunk WHERE contains(text, 'password')
        UNION ALL SELECT chunk_id, 0.75 * CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 2, 'sparse'
        FROM (SELECT chunk_id, 1.0 AS raw FROM chunk WHERE contains(lower(text), 'password') ORDER BY chunk_id LIMIT 20)
    )
    SELECT chunk_id, round(CAST(sum(part) AS DOUBLE), 6) AS merged_score, CAST(min(priority) AS INTEGER) AS priority, CAST(count(*) AS BIGINT) AS n_contributions FROM c GROUP BY chunk_id
""")
def hybrid_merge(spark, sf_dir):
    out = R.hybrid(plain_chunks(spark, sf_dir), ["thing ander password", "password"])
    return out.select("chunk_id", F.round("merged_score", 6).alias("merged_score"), "priority", F.size("contributions").cast("long").alias("n_contributions"))


@_query(f"""
    WITH {CHUNKS} SELECT chunk_id, CAST(row_number() OVER (ORDER BY s DESC, p, chunk_id, source_id, span_start) AS INTEGER) AS rank FROM (
        SELECT *, CASE WHEN contains(text, 'password') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0.0 END AS s, 0 AS p FROM chunk
    ) ORDER BY rank LIMIT 20
""")
def total_order(spark, sf_dir):
    c = plain_chunks(spark, sf_dir)
    s = F.when(F.col("text").contains("password"), 1.0).otherwise(0.0) + F.when(F.lower("text").contains("the"), 0.5).otherwise(0.0)
    best = M.top(c.withColumns({"merged_score": s, "priority": F.lit(0)}), 20)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*M.total_order()))
    return best.select("chunk_id", rank.alias("rank"))


# --- the query language

_TOKENS = r"""tok AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+') AS w FROM documents)"""


def _n(*words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(w, lambda x: x IN ({listed})))"


def _run(spark, sf_dir, query: str, language: str = "") -> DataFrame:
    c = plain_chunks(spark, sf_dir).drop("text_checksum").withColumn("text_checksum", F.lit(""))
    plan = compile_query(c.withColumn("chunk_id", F.col("doc_id")), query, language)
    return plan.candidates.select(F.col("chunk_id").alias("doc_id"), F.round("merged_score", 6).alias("merged_score"), "priority")


@_query(rf"WITH {_TOKENS} SELECT doc_id, CAST({_n('license')} AS BIGINT) AS raw FROM tok WHERE {_n('license')} > 0")
def term_leaf(spark, sf_dir):
    c = plain_chunks(spark, sf_dir).withColumn("chunk_id", F.col("doc_id"))
    plan = compile_query(c, "License")
    return plan.candidates.select(F.col("chunk_id").alias("doc_id"), F.element_at("contributions", 1)["raw"].cast("long").alias("raw"))


@_query(f"WITH {_TOKENS} SELECT doc_id, 1.9::DOUBLE AS merged_score, 1 AS priority FROM tok WHERE {_n('license')} > 0 AND {_n('the')} > 0")
def q_and(spark, sf_dir):
    return _run(spark, sf_dir, "License the")


@_query(f"""WITH {_TOKENS} SELECT doc_id, round(CASE WHEN {_n('password')} > 0 THEN 0.95 ELSE 0.0 END + CASE WHEN {_n('license')} > 0 THEN 0.95 ELSE 0.0 END, 6)::DOUBLE AS merged_score, 1 AS priority
    FROM tok WHERE {_n('password')} > 0 OR {_n('license')} > 0""")
def q_or(spark, sf_dir):
    return _run(spark, sf_dir, "password | License")


@_query(f"WITH {_TOKENS} SELECT doc_id, 0.95::DOUBLE AS merged_score, 1 AS priority FROM tok WHERE {_n('the')} > 0 AND {_n('of')} = 0")
def q_not(spark, sf_dir):
    return _run(spark, sf_dir, "the -of")


@_query(f"""WITH {_TOKENS} SELECT doc_id,
        round(CASE WHEN {_n('the')} > 0 THEN 0.95 ELSE 0.0 END + CASE WHEN {_n('la')} > 0 THEN 0.95 ELSE 0.0 END + 1.0, 6)::DOUBLE AS merged_score, 0 AS priority
    FROM tok WHERE ({_n('the')} > 0 OR {_n('la')} > 0) AND contains(text, 'and of') AND NOT ({_n('hein')} > 0)""")
def q_group(spark, sf_dir):
    return _run(spark, sf_dir, '(the OR la) AND "and of" NOT hein')


@_query(f"WITH {_TOKENS} SELECT doc_id, 1.95::DOUBLE AS merged_score, 0 AS priority FROM tok WHERE {_n('the')} > 0 AND contains(text, 'of the')")
def q_phrase_and_term(spark, sf_dir):
    return _run(spark, sf_dir, '"of the" the')


@_query(f"""WITH {_TOKENS} SELECT 0 AS leaf, 'term' AS kind, 'the' AS text, CAST(count(*) FILTER ({_n('the')} > 0) AS BIGINT) AS matches FROM tok
    UNION ALL SELECT 1, 'phrase', 'of the', count(*) FILTER (contains(text, 'of the')) FROM tok""")
def q_explain(spark, sf_dir):
    c = plain_chunks(spark, sf_dir)
    return compile_query(c, 'the "of the"').explain()


_LEMMA = "CASE WHEN {x} IN ('runners', 'running', 'ran') THEN 'run' WHEN {x} LIKE '%s' AND NOT {x} LIKE '%ss' AND strlen({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"


@_query(
    f"""WITH {_TOKENS}, e AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM tok), l AS (SELECT doc_id, i, t, {_LEMMA.format(x='t')} AS lemma FROM e)
    SELECT DISTINCT a.doc_id, 0.9::DOUBLE AS merged_score, 1 AS priority FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    WHERE (a.t IN ('rights', 'right') OR a.lemma IN ('rights', 'right')) AND (b.t = 'reserved' OR b.lemma = 'reserved')"""
)
def morph_phrase_en(spark, sf_dir):
    return _run(spark, sf_dir, '~"rights reserved"', "en")


@_query(f"WITH {_TOKENS} SELECT doc_id, round(1.9 + CASE WHEN {_n('running', 'run')} > 0 THEN 0.95 ELSE 0.0 END, 6)::DOUBLE AS merged_score, 1 AS priority FROM tok WHERE {_n('that')} > 0")
def term_expansion_en(spark, sf_dir):
    return _run(spark, sf_dir, "lang:en that AND (running OR that)")


@_query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{Nd}_-]+') AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(strlen(split_part(text, w[1], 1)) AS BIGINT) AS first_start,
           CAST(strlen(split_part(text, w[1], 1)) + strlen(w[1]) AS BIGINT) AS first_end
    FROM t WHERE len(w) > 0""")
def token_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("w", X.raw_tokens(F.col("text"))).where(F.size("w") > 0)
    span = X.nth_token_span(F.col("text"), F.lit(0))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), span["start"].alias("first_start"), span["end"].alias("first_end"))


@_query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(strlen(w)) AS BIGINT) AS n_bytes FROM t GROUP BY doc_id""")
def index_tokens(spark, sf_dir):
    t = P.index_tokens(plain_chunks(spark, sf_dir), ["doc_id"])
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


# --- dense


def _dense(metric: str, sql: str, limit: int = 20):
    body = f"""
        WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round({sql}, 6) AS raw FROM embeddings, q, LATERAL (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v)
        ORDER BY {sql} DESC, vec_id LIMIT {limit}
    """

    def run(spark, sf_dir):
        e = _table(spark, sf_dir, "embeddings")
        q = e.where("vec_id = 0").select("embedding").first()[0]
        return R.dense(e, q, limit, metric, key="vec_id").select("vec_id", F.round("raw", 6).alias("raw"))

    run.__name__ = f"dense_{metric}"
    return _query(body)(run)


dense_cosine = _dense("cosine", "list_cosine_similarity(v, q)")
dense_l2 = _dense("l2", "1 - list_distance(v, q)")
dense_ip = _dense("ip", "list_inner_product(v, q)")


@_query("""
    WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
    best AS (
        SELECT vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) AS raw FROM embeddings, q
        ORDER BY raw DESC, vec_id LIMIT 50
    ), f AS (SELECT * FROM best WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0))
    SELECT vec_id, label, round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 6) AS norm FROM f
""")
def dense_filtered(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding", "label").first()
    hits = R.dense(e, q[0], 50, key="vec_id")
    # labels stand for languages, which a filter knows
    name = F.col("vec_id").cast("string")
    place = [name.alias("source_id"), F.lit(0).alias("span_start"), F.lit(1).alias("span_end"), name.alias("text_checksum"), F.lit("external").alias("trust_level")]
    rows = e.select(F.col("vec_id").alias("chunk_id"), *place, F.col("label").cast("string").alias("language"))
    found = R.of_hits(rows, hits.withColumnRenamed("vec_id", "chunk_id"), "dense", ["dense_similarity"], FI.Filters(language=str(q[1])))
    return found.select(F.col("chunk_id").alias("vec_id"), F.lit(q[1]).cast(e.schema["label"].dataType).alias("label"), F.round(F.element_at("contributions", 1)["norm"], 6).alias("norm"))


@_query("SELECT doc_id, CAST(strlen(text) + 100 * contains(lower(text), 'of the')::INT AS DOUBLE) AS score FROM documents")
def rerank_fake(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", V.overlap_score(F.col("text"), "of the").alias("score"))


# --- snippets, redaction, checks


@_query("""
    WITH m AS (SELECT doc_id, text, strlen(split_part(text, 'of the', 1)) AS s FROM documents WHERE contains(text, 'of the'))
    SELECT doc_id, CAST(greatest(s - 40, 0) AS BIGINT) AS span_start, CAST(least(s + 6 + 40, strlen(text)) AS BIGINT) AS span_end, CAST(s AS BIGINT) AS match_start FROM m
""")
def snippet_span(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("s", X.byte_position(F.col("text"), "of the")).where("s >= 0")
    span = X.snippet_span(F.col("text"), F.col("s"), F.col("s") + 6)
    return d.select("doc_id", span["start"].alias("span_start"), span["end"].alias("span_end"), F.col("s").alias("match_start"))


_REDACT = r"""
    r1 AS (SELECT *, regexp_replace(text, '(?i)\b(bearer\s+)([a-z0-9._\-+=/]{8,})', '\1[REDACTED]', 'g') AS t1 FROM src),
    r2 AS (SELECT *, regexp_replace(t1, '(?i)(api[_-]?key|access[_-]?token|secret[_-]?key|auth[_-]?token)(\s*[=:]\s*)([^\s"''\\]{8,})', '\1\2[REDACTED]', 'g') AS t2 FROM r1),
    r3 AS (SELECT *, regexp_replace(t2, '(?i)(^|[^A-Za-z0-9_])(password|passwd|token|secret)(\s*[=:]\s*)([^\s"''\\]{4,})', '\1\2\3[REDACTED]', 'g') AS t3 FROM r2),
    r4 AS (SELECT *, regexp_replace(t3, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g') AS t4 FROM r3)
"""


@_query(f"WITH src AS (SELECT doc_id, text FROM documents), {_REDACT} SELECT doc_id, sha256(t4) AS redacted_sha256 FROM r4")
def redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", H.sha256(X.redact(F.col("text"))["text"]).alias("redacted_sha256"))


@_query(f"WITH src AS (SELECT conv_id, turn, text FROM conversations), {_REDACT} SELECT conv_id, CAST(sum((length(t4) - length(replace(t4, '[REDACTED]', ''))) // 10) AS BIGINT) AS n_redacted FROM r4 GROUP BY conv_id")
def redact_counts(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").withColumn("n", X.redact(F.coalesce("text", F.lit("")))["count"])
    return c.groupBy("conv_id").agg(F.sum("n").alias("n_redacted"))


@_query("""SELECT conv_id, turn, contains(lower(text), 'ignore all prior') OR contains(lower(text), 'grant tool') OR contains(lower(text), 'decisionallow')
    OR contains(lower(text), 'approve all tools') OR contains(lower(text), 'new policy:') AS flagged FROM conversations""")
def injection_flags(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.injected(F.col("text")).alias("flagged"))


@_query("SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS shown FROM documents")
def truncated(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.truncate(F.col("text")).alias("shown"))


@_query()
def html_text(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").withColumn("text", P.html_column(F.col("html")))
    return p.select("page_id", F.length("text").alias("n_chars"), H.sha256(F.col("text")).alias("text_sha256"))


@_query("SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS normal_sha256 FROM documents")
def normal_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", H.sha256(X.for_hashing(F.col("text").cast("binary"))).alias("normal_sha256"))


# --- time


@_query("""
    WITH w AS (SELECT i, TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL 6 HOUR AS s, TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL 6 HOUR + INTERVAL 90 MINUTE AS t FROM range(0, 120) r(i))
    SELECT w.i AS window_id, CAST(count(*) AS BIGINT) AS n_events, min(event_id) AS first_event FROM events e JOIN w ON e.ts < w.t AND w.s < e.ts + INTERVAL 1 HOUR GROUP BY w.i
""")
def temporal_overlap(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("start"))
    e = e.withColumn("end", F.col("start") + F.expr("INTERVAL 1 HOUR"))
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    w = spark.range(120).select(F.col("id").alias("window_id"), (first + F.col("id") * F.expr("INTERVAL 6 HOUR")).alias("start"))
    w = w.withColumn("end", F.col("start") + F.expr("INTERVAL 90 MINUTE"))
    both = FI.overlap_join(e, w)
    return both.groupBy(F.col("r_window_id").alias("window_id")).agg(F.count("*").alias("n_events"), F.min("l_event_id").alias("first_event"))


_EVENT_IDS = "ids AS (SELECT DISTINCT event_type, 'e' || event_id AS id, sha256(event_type || ':' || coalesce(props, '')) AS c, ts FROM events)"


def _event_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_type", F.concat(F.lit("e"), "event_id").alias("event_id"), H.sha256(F.concat("event_type", F.lit(":"), F.coalesce("props", F.lit("")))).alias("payload_checksum"), F.col("ts").cast("timestamp").alias("ts"))


@_query(f"WITH {_EVENT_IDS} SELECT id, c AS checksum FROM ids")
def event_identity(spark, sf_dir):
    e = _event_rows(spark, sf_dir)
    return SF.identities(e.unionByName(e))


_EVENT_TREE = "tree_rows AS (SELECT event_type, sha256(id) AS k, id AS o, chr(0) || id || chr(0) || c AS line FROM ids{})"


@_query(f"WITH {_EVENT_IDS}, {_EVENT_TREE.format('')}, {tree_sql("'trailhead/event-batch/v2'", 'checksum')} SELECT checksum, n AS n_events FROM tree_root")
def event_batch_checksum(spark, sf_dir):
    return SF.batch_checksum(SF.identities(_event_rows(spark, sf_dir)))


_WINDOW = " WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15 12:30:00.25'"
_WINDOW_HEAD = "'trailhead/event-window/v2' || chr(0) || '2024-01-01T00:00:00Z' || chr(0) || '2024-01-15T12:30:00.25Z' || chr(0) || 'occurred'"


@_query(f"WITH {_EVENT_IDS}, {_EVENT_TREE.format(_WINDOW)}, {tree_sql(_WINDOW_HEAD, 'checksum', 'event_type')} SELECT event_type, checksum, n AS n_events FROM tree_root")
def event_window_checksum(spark, sf_dir):
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-15 12:30:00.25"))
    e = _event_rows(spark, sf_dir).where((F.col("ts") >= start) & (F.col("ts") < end))
    ids = e.select("event_type", F.col("event_id").alias("id"), F.col("payload_checksum").alias("checksum"))
    return SF.window_checksum(ids, start, end, by=("event_type",))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY ALL")
def stream_events_window(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.window_counts(e, "at", by=("event_type",))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


# --- packs

_DRAFTS = """drafts AS (
        SELECT lang AS pack_id, doc_id, strlen(text) AS size, text, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS score,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place
        FROM documents
    )"""


def _drafts(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select(
        F.col("lang").alias("pack_id"), F.col("doc_id").cast("string").alias("id"), F.lit("source_text").alias("class"), F.lit("project").alias("trust_level"),
        F.concat(F.lit("s"), "doc_id").alias("source_id"), F.lit(0).cast("long").alias("span_start"), F.octet_length("text").cast("long").alias("span_end"),
        H.sha256(F.col("text")).alias("checksum"), F.col("text").alias("surface"), (((F.col("doc_id") * 7919) % 1000).cast("double") / 1000).alias("score"),
        F.lit(False).alias("required"), F.col("doc_id").alias("place"),
    )


_GREEDY = """WITH RECURSIVE %s, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY score DESC, doc_id) AS n FROM drafts
    ), pick AS (
        SELECT pack_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT pack_id FROM drafts)
        UNION ALL
        SELECT p.pack_id, r.n, CASE WHEN p.taken < 8 AND p.used + r.size <= 4000 THEN p.used + r.size ELSE p.used END,
               CASE WHEN p.taken < 8 AND p.used + r.size <= 4000 THEN p.taken + 1 ELSE p.taken END,
               CASE WHEN p.taken < 8 AND p.used + r.size <= 4000 THEN r.doc_id END
        FROM pick p JOIN ranked r ON r.pack_id = p.pack_id AND r.n = p.n + 1
    )"""


@_query(_GREEDY % _DRAFTS + " SELECT pack_id, CAST(doc_id AS VARCHAR) AS id, used AS used_after FROM pick WHERE doc_id IS NOT NULL")
def pack_greedy(spark, sf_dir):
    packs = K.select(_drafts(spark, sf_dir), K.Budget(max_items=8, max_chars=4000), rejects=False)
    each = packs.select("pack_id", F.posexplode("evidence").alias("i", "x"))
    used = F.sum(F.octet_length("x.surface")).over(Window.partitionBy("pack_id").orderBy("i"))
    return each.select("pack_id", F.col("x.id").alias("id"), used.alias("used_after"))


def _packed(spark, sf_dir):
    packs = K.select(_drafts(spark, sf_dir), K.Budget(max_items=8, max_chars=4000, reject_floor=2.0))
    return packs.withColumn("checksum", K.checksum(F.col("evidence"), F.col("rejected"), F.col("pack_id"), "p", "plan1"))


@_query(_GREEDY % _DRAFTS + """
    SELECT p.pack_id, sha256('trailhead/evidence-pack/v1' || chr(0) || p.pack_id || chr(0) || 'p' || chr(0) || '' || chr(0) || 'plan1' || chr(0) || '' || chr(0) || 'chars-div4-v1' || chr(0)
        || string_agg(d.doc_id || chr(0) || 'source_text' || chr(0) || 'project' || chr(0) || 's' || d.doc_id || chr(0) || '0:' || d.size || chr(0) || sha256(d.text) || chr(0) || d.text || chr(0), '' ORDER BY p.n)) AS checksum
    FROM pick p JOIN drafts d ON d.doc_id = p.doc_id GROUP BY p.pack_id
""")
def pack_checksum(spark, sf_dir):
    return _packed(spark, sf_dir).where(F.size("evidence") > 0).select("pack_id", "checksum")


@_query(_GREEDY % _DRAFTS + " SELECT pack_id, 'pack_checksum_mismatch' AS code, CAST(0 AS BIGINT) AS n_ok FROM (SELECT DISTINCT pack_id FROM drafts)")
def verify_flags(spark, sf_dir):
    packs = _packed(spark, sf_dir)
    spoiled = packs.withColumn("given", F.concat(F.lit("0"), F.substring("checksum", 2, 63)))
    bad = K.flags(F.col("evidence"), F.concat(F.lit("x"), "given"), F.col("checksum"))
    good = K.flags(F.col("evidence"), F.col("checksum"), F.col("checksum"))
    return spoiled.select("pack_id", F.element_at(bad, 1)["code"].alias("code"), F.size(good).cast("long").alias("n_ok"))


@_query(_GREEDY % _DRAFTS + " SELECT pack_id, CAST(count(doc_id) AS BIGINT) AS n_ok FROM pick GROUP BY pack_id HAVING count(doc_id) > 0")
def pack_replay(spark, sf_dir):
    d = _docs(spark, sf_dir)
    store = d.select(F.concat(F.lit("s"), "doc_id").alias("source_id"), H.sha256(F.col("text")).alias("checksum"), F.col("text").alias("surface"))
    return K.replay(_packed(spark, sf_dir), store).where("ok").groupBy("pack_id").agg(F.count("*").alias("n_ok"))


# --- states and counters


@_query("""
    WITH u AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT source, CASE WHEN n >= 52 THEN 'deny' WHEN n >= 41 THEN 'ask' ELSE 'allow' END AS decision FROM u
""")
def quota_status(spark, sf_dir):
    u = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return u.select("source", S.quota(F.col("n"), F.lit(52)).alias("decision"))


@_query("""
    WITH u AS (
        SELECT d.source, count(*) AS n, count(*) FILTER (l.toxic = 1) AS gone FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source
    )
    SELECT source, CASE WHEN source = 'src1' THEN 'failed' WHEN gone > 0 THEN 'degraded' ELSE 'ready' END AS phase, source <> 'src1' AS search_available,
           CASE WHEN source = 'src1' THEN 'snapshot_not_ready,search_unavailable' WHEN gone > 0 THEN 'tombstoned_sources_present,search_available' ELSE 'search_available' END AS reasons
    FROM u
""")
def lifecycle_phase(spark, sf_dir):
    d = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    u = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("gone"))
    status = F.when(F.col("source") == "src1", "building").otherwise("ready")
    r = S.lifecycle(status, F.col("n"), F.col("gone"), F.lit(False), F.lit(False), F.lit("s1"))
    return u.select("source", r["phase"].alias("phase"), r["search_available"].alias("search_available"), F.array_join(r["reasons"], ",").alias("reasons"))


@_query("""SELECT CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, CAST(sum(length(text)) AS BIGINT) AS n_chars,
    CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS n_english FROM documents""")
def metrics_counts(spark, sf_dir):
    found = S.counters(_docs(spark, sf_dir), "source", n_english=F.col("lang") == "en")
    return found.select(F.col("chunks").alias("n_chunks"), F.col("sources").alias("n_sources"), F.col("chars").alias("n_chars"), "n_english")


@_query("""WITH r AS (
        SELECT source, unnest(['exact_phrase', CASE WHEN contains(text, 'password') THEN 'token_term' ELSE 'exact_phrase' END]) AS reason FROM documents WHERE contains(text, 'the')
    ) SELECT source, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT DISTINCT source, reason FROM r) GROUP BY source""")
def eval_reasons(spark, sf_dir):
    d = _docs(spark, sf_dir).where(F.col("text").contains("the"))
    why = F.array(F.when(F.col("text").contains("password"), "token_term").otherwise("exact_phrase"))
    found = F.array(M.contribution("exact", F.lit(1.0), F.lit(1.0), ["exact_phrase"]), M.contribution("term", F.lit(1.0), F.lit(1.0), why))
    each = d.select("source", F.explode(M.reasons(found)).alias("reason"))
    return each.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


# --- more of the inventory


@_query("SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-10 12:00:00' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-10'")
def temporal_filter(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("start", F.col("ts").cast("timestamp"))
    t = F.struct("start", (F.col("start") + F.expr("INTERVAL 1 HOUR")).alias("end"), F.lit("occurred").alias("basis"))
    w = FI.Window(datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 10, 12, tzinfo=UTC))
    return e.where(FI.in_window(t, w)).select("event_id", "user_id")


@_query("""
    WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, n
""")
def stream_sessions(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = ST.sessions(e, "at", "6 hours", by=("user_id",))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n_events")


@_query("""
    WITH w AS (SELECT event_type, ts, unnest([0, 1]) AS k FROM events)
    SELECT date_trunc('hour', ts) - (INTERVAL 1 HOUR) * k AS window_start, event_type, CAST(count(*) AS BIGINT) AS n_events FROM w GROUP BY ALL
""")
def stream_sliding_windows(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = ST.window_counts(e, "at", "2 hours", "1 hour", by=("event_type",))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


@_query("""
    WITH d AS (SELECT lang AS pack_id, sha256(text) AS checksum, doc_id, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS score, doc_id % 13 = 0 AS required FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY pack_id, checksum ORDER BY required DESC, score DESC, doc_id) AS n, min(doc_id) OVER (PARTITION BY pack_id, checksum) AS place FROM d)
    SELECT pack_id, doc_id, place FROM r WHERE n = 1
""")
def pack_dedup(spark, sf_dir):
    d = _docs(spark, sf_dir).select(
        F.col("lang").alias("pack_id"), F.lit("s").alias("source_id"), F.lit(0).alias("span_start"), F.lit(1).alias("span_end"), H.sha256(F.col("text")).alias("checksum"),
        "doc_id", (((F.col("doc_id") * 7919) % 1000).cast("double") / 1000).alias("score"), (F.col("doc_id") % 13 == 0).alias("required"), F.col("doc_id").alias("place"),
    )
    return K.dedup(d).select("pack_id", "doc_id", "place")


@_query("""SELECT doc_id, CAST(row_number() OVER (ORDER BY strlen(text) + 100 * contains(lower(text), 'license')::INT DESC, doc_id) AS INTEGER) AS rank
    FROM documents WHERE contains(text, 'of the') ORDER BY rank LIMIT 20""")
def rerank_order(spark, sf_dir):
    c = plain_chunks(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")).where(F.col("text").contains("of the"))
    best = M.rerank(c.select("chunk_id", "text"), V.overlap_score(F.col("text"), "license")).limit(20)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("merged_score"), "chunk_id"))
    return best.select(F.col("chunk_id").alias("doc_id"), rank.alias("rank"))


@_query(r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_-]+')) AS token, doc_id FROM documents),
    p AS (SELECT token, doc_id, count(*) AS tf FROM t GROUP BY ALL)
    SELECT token, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY token""")
def posting_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.lit("p").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.col("doc_id").alias("chunk_id"), "text")
    return R.postings(d).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages")
def safe_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.safe_id(F.col("url")).alias("safe"))


@_query("""WITH m AS (SELECT doc_id, text, strlen(split_part(text, 'de la', 1)) AS s, length(split_part(text, 'de la', 1)) AS c FROM documents WHERE contains(text, 'de la'))
    SELECT doc_id, CAST(s AS BIGINT) AS byte_start, CAST(c AS BIGINT) AS rune_start FROM m""")
def rune_spans(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("s", X.byte_position(F.col("text"), "de la")).where("s >= 0")
    return d.select("doc_id", F.col("s").alias("byte_start"), X.rune_span(F.col("text"), F.col("s"), F.col("s"))["start"].alias("rune_start"))


@_query("SELECT conv_id, max_by(text, turn) AS last_text, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def last_wins(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    counts = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return M.last_wins(c, ["conv_id"], ["turn"], ["text"]).withColumnRenamed("text", "last_text").join(counts, "conv_id").select("conv_id", "last_text", "n")


@_query("""SELECT path_key, status FROM (
        SELECT sha256('p' || chr(0) || source || '/' || doc_id || '.txt') AS path_key, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' END AS status FROM documents
    ) WHERE status IS NOT NULL""")
def changed_sources(spark, sf_dir):
    d = manifest_diff(spark, sf_dir)
    return d.join(S.to_process(d), "path_key", "left_semi")
