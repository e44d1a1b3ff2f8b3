"""The registered query of each operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import bpe, chat, codes, common, decontaminate, langid, periodic, pii, quality, secrets, simhash, substrings, tokenfiles, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select(*columns))


def tokenizer_file() -> str:
    """The place of the 50k byte-level vocabulary, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    got = quality.score(docs, model, keep=["doc_id"])
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", quality.predicted(F.col("score")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return found.select("doc_id", *secrets.digests(), *secrets.findings())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    got = bpe.encode(docs, tokenizer_file(), decoded="decoded", keep=["doc_id"])
    return got.select("doc_id", *bpe.digests())


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    got = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", *decontaminate.digests())


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs)
    got = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.cluster(_documents(spark, sf_dir, "doc_id", "text"))
    return got.select("doc_id", simhash.hex_digits(F.col("fp0")).alias("fingerprint"), "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"), length=100)
    return got.select("doc_id", *substrings.digests())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    )
    own = own.select("conv_id", "t.turn", "t.role", F.lit(says).alias("text"))
    return chat.digests(chat.read_back(chat.format_chat(rows.unionByName(own))))


PII_KEY = "surrogates-1"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.pseudonymize(_documents(spark, sf_dir, "doc_id", "text"), PII_KEY)
    return got.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = codes.blocks(spread(_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))
    books = codes.train(packed)
    got = codes.with_label_errors(codes.encode(packed, books))
    return got.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.folder(spark, "token-files")
    tokenfiles.write(_documents(spark, sf_dir, "doc_id", "text"), path, tokenizer_file(), end_id=2)
    return tokenfiles.checksums(tokenfiles.read(spark, path))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, which for one id in ten goes over to repeating a part of itself: from word a on, with period p.

    A row without an id stays as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def periodic_tail(s: Column) -> Column:
        n, g = F.size(s["w"]), s["g"]
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: s["w"][F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")]), " ")

    # a value that is bound once
    bound = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda s: F.when(F.size(s["w"]) > 0, periodic_tail(s)).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), bound).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    got = periodic.find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), keep=["doc_id"])
    return got.select("doc_id", *periodic.digests())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_topk": op4_topk,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_substrings": op8_substrings,
    "op9_chat": op9_chat,
    "op10_pii": op10_pii,
    "op11_codes": op11_codes,
    "op12_token_files": op12_token_files,
    "op13_runs": op13_runs,
}

_WORDS = (
    r"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL: dict[str, str] = {
    "op11_codes": """
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), part AS (
            SELECT vec_id, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS x FROM (SELECT vec_id, q, unnest(range(16)) AS p FROM v)
        ), b0 AS (
            SELECT p, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS y FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
        )
        , a0 AS (
            SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) * 64 + e) AS best FROM part JOIN b0 USING (p) GROUP BY vec_id, p
        ), s0 AS (
            SELECT p, best % 64 AS e, i, sum(x[i]) AS s, count(*) AS c FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a0) GROUP BY ALL
        ), m0 AS (
            SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS y FROM s0 GROUP BY p, e
        ), b1 AS (
            SELECT p, e, coalesce(m0.y, b0.y) AS y FROM b0 LEFT JOIN m0 USING (p, e)
        )
        , a1 AS (
            SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) * 64 + e) AS best FROM part JOIN b1 USING (p) GROUP BY vec_id, p
        ), s1 AS (
            SELECT p, best % 64 AS e, i, sum(x[i]) AS s, count(*) AS c FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a1) GROUP BY ALL
        ), m1 AS (
            SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS y FROM s1 GROUP BY p, e
        ), b2 AS (
            SELECT p, e, coalesce(m1.y, b1.y) AS y FROM b1 LEFT JOIN m1 USING (p, e)
        )
        , a2 AS (
            SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) * 64 + e) AS best FROM part JOIN b2 USING (p) GROUP BY vec_id, p
        )
        , coded AS (
            SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id
        ), book AS (
            SELECT sha256(string_agg(v, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(1, len(y) + 1)) AS i, CAST(unnest(y) AS VARCHAR) AS v FROM b2)
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), book
    """,
    "op13_runs": r"""
        WITH tab AS (
            SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), crc AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM documents, tab
        ), cut AS (
            SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM crc
        ), d AS (
            SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) ELSE w END AS w FROM cut
        ), g AS (
            SELECT rid, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT rid, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12)
        ), pair AS (
            SELECT x.rid, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.rid = y.rid AND x.s = y.s AND x.i < y.i
        ), stretch AS (
            SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair) GROUP BY rid, q, k
        ), run AS (
            SELECT rid, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length
        ), per AS (
            SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                   min({'l': -length, 's': start, 'p': period}) AS top FROM run GROUP BY rid
        ), word AS (
            SELECT rid, w, unnest(range(n)) AS i FROM d
        ), gone AS (
            SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run
        ), kept AS (
            SELECT rid, string_agg(w[i + 1], ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid
        )
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(-top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period,
               CAST(-1000 * top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM d LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)
    """,
    "op5_decontaminate": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format(x="text")} AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS.format(x="text")} AS w FROM benchmark WHERE item_id IS NOT NULL
        ), b2 AS (
            SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0
        ), b3 AS (
            SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b2
        ), win AS (
            SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM b3
        ), d2 AS (
            SELECT d.rid, d.w, z.n, unnest(range(1, len(d.w) - z.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) z WHERE len(d.w) >= z.n
        ), d3 AS (
            SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d2
        ), hit AS (
            SELECT rid, i, n, id FROM d3 JOIN win USING (n, s)
        ), word AS (
            SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
        ), item AS (
            SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hit) GROUP BY rid
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN word USING (rid) LEFT JOIN item USING (rid)
    """,
    "op8_substrings": """
        WITH d AS (
            SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, encode(coalesce(text, '')) AS b FROM documents
        ), w AS (
            SELECT rid, i, b[i:i + 99] AS s FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)
        ), again AS (
            SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY s ORDER BY rid, i) AS n FROM w) WHERE n > 1
        ), opens AS (
            SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 100, true) AS new FROM again
        ), runs AS (
            SELECT rid, i, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM opens
        ), spans AS (
            SELECT rid, run, min(i) AS s, max(i) + 99 AS e FROM runs GROUP BY rid, run
        ), edges AS (
            SELECT rid, s, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before, e FROM spans
        ), parts AS (
            SELECT rid, s AS pos, b[before + 1:s - 1] AS piece FROM edges JOIN d USING (rid) WHERE s > before + 1
            UNION ALL
            SELECT rid, octet_length(b) + 1, b[last + 1:octet_length(b)] FROM d JOIN (SELECT rid, max(e) AS last FROM spans GROUP BY rid) USING (rid) WHERE last < octet_length(b)
        ), kept AS (
            SELECT rid, unhex(string_agg(hex(piece), '' ORDER BY pos)) AS k FROM parts GROUP BY rid
        ), gone AS (
            SELECT rid, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid
        )
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(k, ''::BLOB) END) AS kept_sha256
        FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
    """,
    "op9_chat": r"""
        WITH own AS (
            SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM own
        ), e AS (
            SELECT *, regexp_replace(regexp_replace(text,
                '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'), '(\[)(\\*)(INST\]|/INST\])', '\1\\\2\3', 'g') AS body FROM t
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + length(url_encode(role)) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
