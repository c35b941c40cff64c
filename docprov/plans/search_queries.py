"""Named queries over the driver's tables, each with the SQL that gives the same rows.

What the tables lack (statuses, tiers, organizations) comes from their keys by the same
arithmetic on both sides. Floats are rounded to six digits; ties are broken by keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions import text, vectors, watermark
from docprov.operators import audit, chunk, cleanup, fulltext, neighbours, postings, retrieval, store, views
from docprov.session import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "1996-01-01 00:00:00"
TERMS = "thes OR des"
EXCLUDED = ["that", "pour", "und"]
SECRET = "my-secret"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out) if name == "documents" else out  # whole texts: a small table may lie in one row group


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that searches start from: one row."""
    return [float(x) for x in t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def markdown(docs: DataFrame) -> DataFrame:
    """Every line of a document as a section of its own, two third-level ones below each second-level one."""
    headed = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.lit("## ")).otherwise(F.lit("### ")), x))
    return docs.select("doc_id", F.array_join(headed, "\n\n").alias("body"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))


COSINE = "(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))"
QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]"


def trimmed_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


FOLDED = trimmed_sql(f"regexp_replace(x, '{WS}+', ' ', 'g')")


def words_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WS.replace("[", "[^", 1)}+'))"


def lexemes_sql(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3))"



@query(f"""SELECT e.vec_id, round({COSINE}, 6) AS similarity FROM embeddings e, {QUERY_VECTOR}
WHERE round({COSINE}, 6) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 20""")
def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.semantic(t(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), threshold=0.1, count=20, key="vec_id", digits=6)
    return found.select("vec_id", "similarity")


@query(f"""WITH c AS (SELECT e.vec_id AS doc_id, e.label, e.embedding, d.lang, CASE e.vec_id % 5 WHEN 0 THEN ['*'] WHEN 1 THEN ['finance', 'health'] WHEN 2 THEN ['law'] ELSE ['finance'] END AS industries,
  CASE WHEN e.vec_id % 3 = 0 THEN NULL ELSE 'org' || (e.vec_id % 3) END AS org, e.vec_id % 7 <> 0 AS is_active
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)
SELECT e.doc_id, round({COSINE}, 6) AS similarity FROM c e, {QUERY_VECTOR}
WHERE is_active AND (list_has_any(industries, ['finance', 'law']) OR list_contains(industries, '*')) AND label IN (0, 1, 2, 3, 4) AND lang = 'en' AND (org IS NULL OR org = 'org1') AND round({COSINE}, 6) >= 0
ORDER BY 2 DESC, 1 LIMIT 30""")
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    industries = F.when(i % 5 == 0, F.array(F.lit("*"))).when(i % 5 == 1, F.array(F.lit("finance"), F.lit("health"))).when(i % 5 == 2, F.array(F.lit("law"))).otherwise(F.array(F.lit("finance")))
    org = F.when(i % 3 != 0, F.concat(F.lit("org"), (i % 3).cast("string")))
    rows = t(spark, sf_dir, "embeddings").join(t(spark, sf_dir, "documents").select("doc_id", "lang"), i == F.col("doc_id"))
    rows = rows.withColumn("industries", industries).withColumn("org", org).withColumn("is_active", i % 7 != 0)
    filters = retrieval.Filters({"industries": ["finance", "law"]}, {"lang": "en", "is_active": True}, {"label": [0, 1, 2, 3, 4]}, "org1")
    found = retrieval.semantic(rows.where(filters.column("org")), first_vector(spark, sf_dir), threshold=0.0, count=30, key="doc_id", digits=6)
    return found.select("doc_id", "similarity")


INDEXED: dict[tuple, postings.Postings] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """The index of the documents' texts: made by the first query of an application that searches these files."""
    docs = t(spark, sf_dir, "documents")
    tell = lambda name: (lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path))(spark._jvm.org.apache.hadoop.fs.Path(name))
    files = tuple((name, s.getLen(), s.getModificationTime()) for name in sorted(docs.inputFiles()) for s in (tell(name),))
    key = (spark.sparkContext.applicationId, files)
    if key not in INDEXED:
        own = postings.Postings(spark, f"{shared_folder(spark)}/postings-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", beyond=float("nan"))
        own.append(docs, "text", key="doc_id")
        INDEXED[key] = own
    return INDEXED[key]


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)?')"
#: Each occurrence of either term covers the query alone, with the weight of contents.
HITS = f"SELECT doc_id, 0.4::DOUBLE * count(DISTINCT least(i, 16383)) AS s FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) WHERE x IN ('thes', 'des') GROUP BY 1"


@query(f"""WITH w AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
hits AS (SELECT doc_id, x = 'thes' AS a, least(i, 16383) AS p FROM w WHERE x IN ('thes', 'ble', 'bleing', 'bleingly')),
n AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY p) AS b, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hits),
r AS (SELECT doc_id, sum(0.4::DOUBLE / (q - p)) AS r FROM n WHERE a <> b GROUP BY 1)
SELECT doc_id, round(r / (r + 1), 6) AS text_score FROM r ORDER BY round(r / (r + 1), 9) DESC, doc_id LIMIT 25""")
def fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both words: the nearer they stand, the higher the rank. Ranked by nine digits, and told with six of the rank itself.
    Where both lie beyond the last place that is counted, the SQL divides by a distance of 0, and the rank is NaN on both sides."""
    found = documents_index(spark, sf_dir).search("thes bleing", "doc_id").withColumn("score", F.round("text_score", 9))
    return retrieval.ranked(found, "score", "rank", "doc_id", 25).select("doc_id", r6(F.col("text_score")).alias("text_score"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE list_contains(w, 'des') AND NOT list_has_any(w, ['thes', 'vi']) OR list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ['onré thes', 'des réles', 'des le', 'des des'])")
def fulltext_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that must not occur, phrases, and alternatives."""
    asked = 'des -thes -vi OR "onré thes" OR "des réles" or "des le" OR "des des"'
    return documents_index(spark, sf_dir).search(asked, "doc_id").select("doc_id")


@query(f"SELECT doc_id, round(s / (s + 1), 6) AS text_score FROM ({HITS}) WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3")
def fulltext_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that grew by two commits, lost documents and got some of them back, its lists merged half way."""
    docs = t(spark, sf_dir, "documents")
    own = postings.Postings(spark, f"{shared_folder(spark)}/postings-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    own.append(docs.where("doc_id % 2 = 0"), "text", key="doc_id")
    own.append(docs.where("doc_id % 2 = 1"), "text", key="doc_id")
    own.remove(docs.where("doc_id % 10 = 3").select(F.col("doc_id").alias("key")))
    own.merge()
    own.append(docs.where("doc_id % 20 = 3"), "text", key="doc_id")
    return own.search(TERMS, "doc_id").select("doc_id", r6(F.col("text_score")).alias("text_score"))


@query(f"""SELECT doc_id, len({TOKENS}) + 1 AS places, len(list_distinct(list_append({TOKENS}, lower(source)))) AS lexemes FROM documents WHERE len({TOKENS}) > 0 AND regexp_full_match(source, '[A-Za-z0-9]+')""")
def fulltext_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents as weighted places of lexemes, without stop words or stems."""
    docs = t(spark, sf_dir, "documents").where(F.col("source").rlike(r"\A[A-Za-z0-9]+\z"))
    found = fulltext.vectors(docs, "text", "source", F.lit("simple"), "doc_id").where("size(lexemes) > 1")
    return found.select("doc_id", F.size("lexemes").cast("long").alias("places"), F.size(F.array_distinct(F.transform("lexemes", lambda x: x.lexeme))).cast("long").alias("lexemes"))


HYBRID = f"""WITH near AS (SELECT vec_id AS doc_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS vr FROM (SELECT e.vec_id, {COSINE} AS s FROM embeddings e, {QUERY_VECTOR} WHERE e.vec_id IN (SELECT doc_id FROM documents)) ORDER BY vr LIMIT 200),
told AS (SELECT doc_id, s / (s + 1) AS ts, row_number() OVER (ORDER BY s / (s + 1) DESC, doc_id) AS tr FROM ({HITS}) WHERE s > 0 ORDER BY tr LIMIT 200),
both_ AS (SELECT coalesce(near.doc_id, told.doc_id) AS doc_id, s, ts, vr, tr, 0.7 / (20 + coalesce(vr, 1000)) + 0.3 / (20 + coalesce(tr, 1000)) AS c FROM near FULL JOIN told ON near.doc_id = told.doc_id),
top AS (SELECT * FROM both_ WHERE c >= 0.005 ORDER BY c DESC, doc_id LIMIT 50)
"""


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return retrieval.hybrid(chunks, first_vector(spark, sf_dir), TERMS, count=50, key="doc_id", text="text", index=documents_index(spark, sf_dir))


@query(HYBRID + "SELECT doc_id, round(coalesce(s, 0), 6) AS similarity, round(coalesce(ts, 0), 6) AS text_score, vr::BIGINT AS vector_rank, tr::BIGINT AS text_rank, round(c, 6) AS combined_score FROM top")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_hits(spark, sf_dir).select("doc_id", r6(F.col("similarity")).alias("similarity"), r6(F.col("text_score")).alias("text_score"), F.col("vector_rank").cast("long"), F.col("text_rank").cast("long"), r6(F.col("combined_score")).alias("combined_score"))


@query(HYBRID + r"SELECT top.doc_id, round(c, 6) AS combined_score FROM top JOIN documents d ON d.doc_id = top.doc_id WHERE NOT regexp_matches(text, '(?i)\b(that|pour|und)\b')")
def hybrid_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: fused search behind the exclusion gate; texts are joined to at most 50 hits."""
    hits = hybrid_hits(spark, sf_dir).select("doc_id", "combined_score")
    texts = t(spark, sf_dir, "documents").join(F.broadcast(hits), "doc_id")
    passed = retrieval.excluded(texts, "text", F.array(*[F.lit(x) for x in EXCLUDED])).where("passed")
    return passed.select("doc_id", r6(F.col("combined_score")).alias("combined_score"))


GATE = r"list_filter(['that', 'pour', 'und'], lambda x: regexp_matches(text, '(?i)\b' || x || '\b'))"


@query(f"SELECT doc_id FROM documents WHERE len({GATE}) = 0")
def sire_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.excluded(t(spark, sf_dir, "documents"), "text", F.array(*[F.lit(x) for x in EXCLUDED])).where("passed").select("doc_id")


@query(f"SELECT doc_id, {GATE}[1] AS first_match, len({GATE})::INT AS matches FROM documents WHERE len({GATE}) > 0")
def sire_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.excluded(t(spark, sf_dir, "documents"), "text", F.array(*[F.lit(x) for x in EXCLUDED])).where("not passed")
    return out.select("doc_id", F.get("matches", F.lit(0)).alias("first_match"), F.size("matches").alias("matches"))


def subject_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select("vec_id", vectors.cosine_to(first_vector(spark, sf_dir), F.col("embedding")).alias("similarity"))
    return t(spark, sf_dir, "documents").join(e, F.col("doc_id") == F.col("vec_id")).withColumnRenamed("source", "sire_subject")


HIT_SQL = f"SELECT d.source AS sire_subject, d.text, {COSINE} AS similarity FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, {QUERY_VECTOR}"


@query()
def ann_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by an index of cells and codes: tested against comparing with all."""
    rows = t(spark, sf_dir, "embeddings")
    own = neighbours.Neighbours(rows, f"{shared_folder(spark)}/cells-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", "vec_id")
    found = own.search_all(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"))
    return found.select("query", "vec_id", "rank", r6(F.col("similarity")).alias("similarity"))


@query(f"SELECT sire_subject, count(*) AS hits, round(avg(similarity), 6) AS mean_similarity FROM ({HIT_SQL}) GROUP BY 1")
def sire_identity_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.identity_collapse(subject_hits(spark, sf_dir)).withColumn("mean_similarity", r6(F.col("mean_similarity")))


@query(f"SELECT sire_subject, count(*) AS hits, count(*) FILTER (len({GATE}) = 0) AS passed, count(*) FILTER (len({GATE}) > 0) AS purged, count(*) FILTER (len({GATE}) = 0) = 0 AS suspicious_purge FROM ({HIT_SQL}) WHERE similarity > 0.25 GROUP BY 1")
def sire_suspicious_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = subject_hits(spark, sf_dir).where("similarity > 0.25")
    return retrieval.suspicious_purge(retrieval.excluded(hits, "text", F.array(*[F.lit(x) for x in EXCLUDED])))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {words_sql('text')}::BIGINT AS words, ceil({words_sql('text')} / 0.75)::BIGINT AS tokens FROM documents")
def word_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.token_estimate(F.col("text")).alias("tokens"))


SECTIONS = f"""WITH lines AS (SELECT doc_id, {trimmed_sql('x')} AS title, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
sections AS (SELECT doc_id, pos - 1 AS sequence, title, CASE WHEN (pos - 1) % 3 = 0 THEN '##' ELSE '###' END AS mark, last_value(CASE WHEN (pos - 1) % 3 = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM lines),
told AS (SELECT *, mark || ' ' || title AS content, CASE WHEN mark = '##' THEN title ELSE second || ' > ' || title END AS path FROM sections)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.heading_chunks(markdown(t(spark, sf_dir, "documents")), title=F.col("title"))


@query(SECTIONS + f"SELECT doc_id, sequence::INT AS sequence, title AS section_title, len(mark)::INT AS heading_level, sha256(content) AS content_hash, ceil({words_sql('content')} / 0.75)::BIGINT AS token_count, 'Doc ' || doc_id || ' > ' || path AS heading_path FROM told")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "sequence", "section_title", "heading_level", "content_hash", "token_count", F.array_join("heading_path", " > ").alias("heading_path"))


@query(SECTIONS + "SELECT doc_id, sequence::INT AS sequence, title AS section_title, 'Crosswalk > ' || path AS heading_path, length(content)::INT AS n_chars FROM told")
def crosswalk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.crosswalk_chunks(markdown(t(spark, sf_dir, "documents")))
    return out.select("doc_id", "sequence", "section_title", F.array_join("heading_path", " > ").alias("heading_path"), F.length("content").alias("n_chars"))


def marked(spark: SparkSession, sf_dir: str, secret: str | None = None) -> DataFrame:
    """Documents as chunks with a mark: their trimmed text, sequence the id modulo 10."""
    c = text.trimmed_end(F.col("text"))
    out = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "source").alias("corpus_id"), (F.col("doc_id") % 10).alias("sequence"), c.alias("content"))
    return out.withColumn("content_hash", text.sha256(F.col("content"))).withColumn("marked", watermark.injected(F.col("content"), F.col("corpus_id"), F.col("sequence"), F.col("content_hash"), secret))


MARKED = f"""WITH base AS (SELECT doc_id, 'doc-' || source AS corpus_id, doc_id % 10 AS sequence, regexp_replace(text, '{WS}+$', '') AS content FROM documents),
signed AS (SELECT *, sha256(corpus_id || '|' || sequence || '|' || sha256(content))[1:16] AS signature FROM base),
marked AS (SELECT *, content || chr(10) || '<!-- corpus-watermark:v1:' || corpus_id || ':' || sequence || ':' || signature || ' -->' AS marked FROM signed)
"""


@query(MARKED + "SELECT doc_id, sha256(marked) AS marked_hash, length(marked)::INT AS n_chars, true AS is_marked FROM marked")
def watermark_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(spark, sf_dir)
    again = watermark.injected(F.col("marked"), F.col("corpus_id"), F.col("sequence"), F.col("content_hash"))
    return m.select("doc_id", text.sha256(again).alias("marked_hash"), F.length("marked").alias("n_chars"), watermark.marked(F.col("marked")).alias("is_marked"))


@query(MARKED + "SELECT doc_id, sha256(content) AS bare_hash, sha256(content) AS strict_hash FROM marked")
def watermark_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(spark, sf_dir)
    return m.select("doc_id", text.sha256(watermark.stripped(F.col("marked"))).alias("bare_hash"), text.sha256(watermark.stripped_strict(F.col("marked"))).alias("strict_hash"))


@query(MARKED + "SELECT doc_id, true AS valid, 'v1' AS version, corpus_id, sequence, signature FROM marked")
def watermark_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", watermark.verified(F.col("marked")).alias("v")).select("doc_id", "v.valid", "v.version", "v.corpus_id", "v.sequence", "v.signature")


@query("""SELECT doc_id, doc_id % 3 = 1 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 OR doc_id % 3 = 2 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid,
CASE WHEN doc_id % 5 = 0 THEN 'No watermark found in content' WHEN doc_id % 7 = 0 THEN 'Unsupported watermark version: v9' WHEN doc_id % 3 = 0 THEN 'Signature mismatch — content may have been tampered with' END AS reason FROM documents""")
def watermark_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    bad = F.when(i % 5 == 0, F.col("content")).when(i % 7 == 0, F.replace("marked", F.lit("watermark:v1"), F.lit("watermark:v9"))).when(i % 3 == 0, F.concat(F.lit("X"), "marked")).otherwise(F.col("marked"))
    return marked(spark, sf_dir).select("doc_id", watermark.verified(bad).alias("v")).select("doc_id", "v.valid", "v.reason")


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


@query(MARKED + f"SELECT doc_id, sha256(unhex('{_pads(SECRET)[1]}') || unhex(sha256(unhex('{_pads(SECRET)[0]}') || encode(corpus_id || '|' || sequence || '|' || sha256(content)))))[1:16] AS signature, true AS valid, false AS plain_valid FROM marked")
def watermark_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(spark, sf_dir, SECRET)
    return m.select("doc_id", watermark.verified(F.col("marked"), SECRET).alias("v"), watermark.verified(F.col("marked")).alias("p")).select("doc_id", "v.signature", "v.valid", F.col("p.valid").alias("plain_valid"))


@query("SELECT source, count(*) AS chunks, bool_and(doc_id % 11 <> 0) AS all_valid, bool_or(doc_id % 11 <> 0) AS any_valid, bool_and(doc_id % 13 <> 0) AS looks_marked FROM documents GROUP BY 1")
def doc_watermark_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    # One in eleven was changed after marking; one in thirteen of the others is cut off and so has no mark, which is not valid either.
    broken = F.when(i % 11 == 0, F.concat(F.lit("!"), "marked")).otherwise(F.col("marked"))
    m = marked(spark, sf_dir).withColumn("content", broken)
    told = views.watermark_summary(m).select(F.substring("corpus_id", 5, 100).alias("source"), "chunks", "all_valid", "any_valid")
    cut = m.withColumn("content", F.when(i % 13 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return told.join(views.watermark_summary(cut).select(F.substring("corpus_id", 5, 100).alias("source"), "looks_marked"), "source")


AUDIT = f"""WITH halves AS (SELECT doc_id, source, text AS src, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1), chr(10)) AS ai FROM documents),
lex AS (SELECT *, {lexemes_sql('src')} AS a, {lexemes_sql('ai')} AS b FROM halves),
ratios AS (SELECT *, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS cov, CASE WHEN length(src) = 0 THEN 1.0 ELSE length(ai)::DOUBLE / length(src) END AS lr FROM lex)
"""


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.col("text"), "\n")
    half = F.array_join(F.filter(lines, lambda x, i: i % 2 == 0), "\n")
    rows = t(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("sequence"), F.col("text").alias("source_text"), half.alias("ai_text"))
    return audit.audited(rows)


@query(AUDIT + "SELECT doc_id AS sequence, round(cov, 6) AS coverage_ratio, round(lr, 6) AS length_ratio, cov < 0.82 OR lr < 0.55 AS omission_detected, (cov < 0.82)::INT + (lr < 0.55)::INT AS n_warnings, length(CASE WHEN cov < 0.82 OR lr < 0.55 THEN src ELSE ai END)::INT AS recovered_chars FROM ratios")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(spark, sf_dir).select("sequence", r6(F.col("coverage_ratio")).alias("coverage_ratio"), r6(F.col("length_ratio")).alias("length_ratio"), "omission_detected", F.size("warnings").alias("n_warnings"), F.length("recovered_text").alias("recovered_chars"))


PARTS = f"""WITH parts AS (SELECT doc_id, l, unnest(range(0, (len(l) + 4) // 5)) AS sequence FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
halves AS (SELECT doc_id AS document_id, sequence, array_to_string(l[sequence * 5 + 1:sequence * 5 + 5], chr(10)) AS src, array_to_string(list_filter(l[sequence * 5 + 1:sequence * 5 + 5], lambda x, i: (i + document_id) % 3 <> 0), chr(10)) AS ai FROM parts),
lex AS (SELECT *, {lexemes_sql('src')} AS a, {lexemes_sql('ai')} AS b FROM halves),
ratios AS (SELECT *, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS cov, CASE WHEN length(src) = 0 THEN 1.0 ELSE length(ai)::DOUBLE / length(src) END AS lr FROM lex)
"""


def part_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines of a document as a chunk, rewritten without every third line."""
    # Split once a document, not once a part.
    parts = text.let(F.split(F.col("text"), "\n"), lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 5).cast("int")), lambda i: F.slice(lines, i * 5 + 1, 5)))
    rows = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode_outer(parts).alias("sequence", "part"))
    kept = F.filter("part", lambda x, i: (i + 1 + F.col("document_id")) % 3 != 0)
    return audit.audited(rows.select("document_id", "sequence", F.array_join("part", "\n").alias("source_text"), F.array_join(kept, "\n").alias("ai_text")))


@query(PARTS + "SELECT document_id, count(*) AS chunks, count(*) FILTER (cov < 0.82 OR lr < 0.55) AS omissions, sha256(string_agg(CASE WHEN cov < 0.82 OR lr < 0.55 THEN src ELSE ai END, chr(10) || chr(10) ORDER BY sequence)) AS text_hash FROM ratios GROUP BY 1")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rollup(part_audits(spark, sf_dir)).select("document_id", "chunks", "omissions", text.sha256(F.col("recovered_text")).alias("text_hash"))


@query(PARTS + "SELECT document_id, sum(greatest((cov < 0.82)::INT + (lr < 0.55)::INT, 1))::BIGINT AS warning_count FROM ratios WHERE cov < 0.82 OR lr < 0.55 GROUP BY 1")
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.warning_summary(part_audits(spark, sf_dir)).select("document_id", "warning_count")


@query()
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs, packed to 600 characters and 900 at most."""
    docs = t(spark, sf_dir, "documents").withColumn("chunks", chunk.source_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 600, 900))
    return docs.select("doc_id", F.posexplode_outer("chunks").alias("sequence", "content")).select("doc_id", "sequence", F.length("content").alias("n_chars"), text.sha256(F.col("content")).alias("content_hash"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = "\n12\nContents  Page\nScope ..... 7\nEmail: x@y.z\n" + "All rights reserved\n" * 3
    return t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(more))).otherwise(F.col("text")).alias("text"))


def _rule_sql() -> str:
    """The rules of `cleanup`, one SQL condition each."""
    quoted = lambda patterns, flags="(?i)": f"regexp_matches(b, '{flags}" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"
    contents = f"{quoted(cleanup.CONTENTS[::2])} OR {quoted(cleanup.CONTENTS[1:2], '')}"
    often = " OR ".join(f"contains(f, '{p}')" for p in cleanup.REPEATED)
    tests = (quoted(cleanup.STRUCTURAL), quoted(cleanup.NOISE), quoted(cleanup.PAGE), contents, f"k >= {cleanup.OFTEN} AND ({often})")
    return "CASE WHEN b = '' THEN NULL " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in zip(cleanup.RULES, tests, strict=True)) + " END"


RULE = _rule_sql()
CLASSIFIED = f"""WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '12' || chr(10) || 'Contents  Page' || chr(10) || 'Scope ..... 7' || chr(10) || 'Email: x@y.z' || chr(10) || repeat('All rights reserved' || chr(10), 3) ELSE text END AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM raw),
bare AS (SELECT doc_id, {trimmed_sql('x')} AS b, lower({FOLDED}) AS f FROM lines),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, f) AS k FROM bare), ruled AS (SELECT doc_id, {RULE} AS rule FROM counted)
"""


@query(CLASSIFIED + "SELECT rule, count(*) AS lines FROM ruled GROUP BY 1")
def line_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.classified(noisy(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("lines"))


@query(CLASSIFIED + "SELECT doc_id, count(*) AS original_lines, " + ", ".join(f"count(*) FILTER (rule = '{r}') AS {r}" for r in cleanup.RULES) + " FROM ruled GROUP BY 1")
def line_cleanup_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.cleaned(noisy(spark, sf_dir)).select("doc_id", "original_lines", *cleanup.RULES)


@query()
def line_cleanup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.cleaned(noisy(spark, sf_dir)).select("doc_id", text.sha256(F.col("cleaned_text")).alias("text_hash"), "cleaned_chars", "cleaned_lines", "removed_chars", r6(F.col("removed_char_ratio")).alias("removed_char_ratio"))


@query(f"SELECT doc_id, lower({FOLDED}) AS line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE {trimmed_sql('x')} <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.repeated_lines(t(spark, sf_dir, "documents"), least=2)


def corpus_rows(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Documents as versions of corpora; the incoming ones differ where the id says so."""
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if changed else F.col("text")
    version = F.when(i % 10 == 9, "v2").otherwise("v1") if changed else F.lit("v1")
    tags = F.array(F.lit("b"), F.lit("a")) if changed else F.array(F.lit("a"), F.lit("b"))
    title = F.when(i % 4 == 1, "other").otherwise("title") if changed else F.lit("title")
    rows = t(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), i.cast("string")).alias("corpus_id"), version.alias("version"), F.when(i % 2 == 0, F.concat(F.lit("org"), (i % 4).cast("string"))).alias("organization_id"), text.sha256(body).alias("content_hash"),
        title.alias("title"), F.lit("tier_1").alias("tier"), F.lit("prose").alias("content_type"), F.lit(None).cast("string").alias("source_url"), F.col("source").alias("source_publisher"), F.lit("2024-01-01").alias("last_verified"),
        tags.alias("frameworks"), F.array(F.lit("*")).alias("industries"), F.array(F.lit("*")).alias("segments"), F.lit(True).alias("is_active"), i.alias("doc_id"),
    )
    return rows.where(i % 6 != 5) if not changed else rows


@query("SELECT doc_id, doc_id % 6 = 5 OR doc_id % 3 = 0 OR doc_id % 10 = 9 OR doc_id % 4 = 1 AS changed FROM documents")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = corpus_rows(spark, sf_dir, True).alias("n"), corpus_rows(spark, sf_dir, False).alias("o")
    both = new.join(old, (F.col("n.corpus_id") == F.col("o.corpus_id")) & F.col("n.organization_id").eqNullSafe(F.col("o.organization_id")), "left")
    return both.select("n.doc_id", store.substantive_change("n", "o").alias("changed"))


@query("SELECT CASE WHEN doc_id % 6 = 5 OR doc_id % 10 = 9 THEN 'inserted' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS documents FROM documents GROUP BY 1")
def doc_upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = store.upsert_actions(corpus_rows(spark, sf_dir, True).drop("is_active"), corpus_rows(spark, sf_dir, False))
    return acted.groupBy("action").agg(F.count("*").alias("documents"))


@query("""WITH old AS (SELECT doc_id, 'v1' AS version, doc_id % 10 <> 9 AS is_active, sha256(text) AS content_hash FROM documents WHERE doc_id % 6 <> 5), new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'v2' ELSE 'v1' END AS version, true AS is_active, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id % 10 = 9""")
def active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upserted(corpus_rows(spark, sf_dir, True), corpus_rows(spark, sf_dir, False)).select("doc_id", "version", "is_active", "content_hash")
