"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anomalies, centroids, exact, incidence, language, leaks, licenses, near, pieces, privacy, repeats, suffixes, toxicity
from .common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_exact_dedup", sql=f"""
    WITH d AS (SELECT doc_id, {FOLDED} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(documents(spark, sf_dir)).drop("keep_locator")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs)).withColumn("held_out", held_out())


TOKENIZERS = "/opt/tokenizers"


@query("op10_sentencepiece_dropout")
def op10_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = pieces.read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = pieces.encode(documents(spark, sf_dir), vocab)
    return rows.select("doc_id", "n_pieces", F.sha2("pieces", 256).alias("pieces_sha256"), "lossless")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op1_personal_data")
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = privacy.find(docs, privacy.fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in privacy.KINDS], F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"),
                        privacy.listed(F.col("spans")).alias("spans"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir), licenses.NOTICES)
    return found.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(licenses.names(F.col("notices")), ",").alias("names"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["name"], n["first_word"], n["end_word"])), ",").alias("places"))


@query("op6_benchmark_leaks")
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hits = leaks.by_document(leaks.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_bytes=1))
    return docs.select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(leaks.listed(F.col("items")), F.lit("")).alias("items"), "least_distance",
        F.col("n_items").isNotNull().alias("contaminated"))


@query("op3_near_dedup", sql="""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
    e AS (SELECT doc_id, unnest(sh) AS x FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
        WHERE 100 * n >= 80 * (len(p.sh) + len(q.sh) - n)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN c ON c.a = s.doc_id""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components_of(documents(spark, sf_dir), size=4)


@query("op2_substring_dedup", sql="""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
        FROM documents),
    k AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS s, ws FROM w WHERE len(ws) >= 13),
    g AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 12], ' ')) AS x FROM k),
    f AS (SELECT x, min(doc_id) AS first FROM g GROUP BY x),
    r AS (SELECT DISTINCT doc_id, s + unnest(range(0, 13)) AS p FROM g JOIN f USING (x) WHERE first < doc_id),
    l AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id),
    n AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN l USING (doc_id)),
    t AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, ws, ps FROM n),
    u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    v AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.p = u.p
        WHERE r.p IS NULL GROUP BY u.doc_id)
    SELECT t.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN v ON v.doc_id = t.doc_id""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assigning and moving, written out one after the other."""
    def assigned(i: int) -> str:
        return f"""d{i} AS MATERIALIZED (
        SELECT v.n, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS far
        FROM v, c{i} c),
    a{i} AS MATERIALIZED (SELECT n, min({{'far': far, 'c': c}}).c AS c, min(far) AS far FROM d{i} GROUP BY n)"""

    def moved(i: int) -> str:
        return f"""s{i} AS MATERIALIZED (
        SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS p
            FROM a{i} a JOIN v USING (n)) GROUP BY c, p),
    c{i + 1} AS MATERIALIZED (
        SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM s{i} GROUP BY c) m ON m.c = c.c)"""

    steps = ",\n    ".join(f"{assigned(i)},\n    {moved(i)}" for i in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS n, vec_id,
            list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v
        QUALIFY c < {k}),
    {steps},
    {assigned(rounds)},
    i AS (SELECT c, sum(far) AS far FROM a{rounds} GROUP BY c)
    SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.far AS BIGINT) AS distance, CAST(i.far AS BIGINT) AS cluster_inertia,
        CAST((SELECT sum(far) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM v JOIN a{rounds} a USING (n) JOIN i ON i.c = a.c JOIN c{rounds} c ON c.c = a.c"""


@query("op13_centroid_clusters", sql=_centroid_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return made.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"),
                       F.col("inertia").cast("long").alias("inertia"), centroids.digest(F.col("centroid")).alias("centroid_sha256"))


@query("op12_token_links")
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = incidence.byte_level(f"{TOKENIZERS}/byte_bpe_50k.json")
    second = incidence.sentence_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    rows = incidence.align_documents(documents(spark, sf_dir), first, second).withColumn("groups_sha256", digest).drop("groups")
    return incidence.count_links(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomalies.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", *anomalies.COUNTS, "base_failed", "kept", "score")
