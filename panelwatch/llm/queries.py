"""One registered query per operator, over its whole table, with the result columns agreed for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.llm import covertree, langid, lexical, onebit, packing, pii, repeats, resampling, secret_scan, simhash, tiling, vafile, warc
from panelwatch.plans.inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op5_bestfit_packing")
def bestfit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_simhash_links")
def simhash_links(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_warc_dictionary", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS DISTINCT FROM NULL AND f.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def warc_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    paths = [r[0] for r in warc.archive(table(spark, sf, "pages")).select("path").collect()]
    return warc.read_archive(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_maximal_repeats")
def maximal_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"), with_text=False).drop("kept")


@query("op8_string_tiling")
def string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_importance_resampling")
def importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_language_centroids")
def language_centroids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.classify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "_lang.*")


@query("op2_markov_secrets")
def markov_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find(table(spark, sf, "documents"))


@query("op3_weak_supervision_pii")
def weak_supervision_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


@query("op4_onebit_search")
def onebit_search(spark: SparkSession, sf: str) -> DataFrame:
    return onebit.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_cover_tree_links", """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT links.a, reach.other FROM reach JOIN links ON links.b = reach.id),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
sums AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, coalesce(sums.n, 0) AS n_links, coalesce(least.component_id, m.vec_id) AS component_id, coalesce(least.component_id, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN sums ON sums.a = m.vec_id LEFT JOIN least ON least.id = m.vec_id""")
def cover_tree_links(spark: SparkSession, sf: str) -> DataFrame:
    return covertree.link(table(spark, sf, "embeddings"))


def _rounds_sql(k: int = 40, rounds: int = 5) -> str:
    """The same clustering in plain SQL, every round a step."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, sha256('2:' || vec_id) AS h, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, h, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM kept),
c0 AS MATERIALIZED (SELECT n AS cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM (SELECT e, row_number() OVER (ORDER BY h, vec_id) - 1 AS n FROM kept) WHERE n < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (s, cluster)) AS cluster, min(s) AS distance FROM (SELECT vec_id, cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS s FROM v JOIN c{r} c USING (d) GROUP BY vec_id, cluster) GROUP BY vec_id)")
        if r < rounds:
            mean = "(CAST(sum(v.x) AS BIGINT) - ((CAST(sum(v.x) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"n{r} AS MATERIALIZED (SELECT cluster, d, {mean} AS x FROM v JOIN a{r} USING (vec_id) GROUP BY cluster, d)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.d, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n USING (cluster, d))")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)"""


@query("op12_va_file_clusters", _rounds_sql())
def va_file_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return vafile.cluster(table(spark, sf, "embeddings"))


_TERMS = f"unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.UPPER.lower()}'), '{lexical.TERM}'))"


@query("op13_hybrid_search", f"""
WITH t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY doc_id, term),
l AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN l USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
