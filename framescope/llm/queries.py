"""The operators as queries over the given tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm import pii_sanitise, quality_crf, secret_scan
from framescope.llm.equal_average_codes import equal_average_codes
from framescope.llm.interval_ranking import interval_ranking
from framescope.llm.jaccard_join import jaccard_join
from framescope.llm.latent_decontamination import latent_decontamination
from framescope.llm.soft_mixing import soft_mixing
from framescope.llm.stable_knn import stable_knn
from framescope.llm.substring_dedup import substring_dedup
from framescope.llm.suffix_dedup import suffix_dedup
from framescope.llm.token_output import token_output
from framescope.llm.topk_search import topk_search


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    return soft_mixing(docs, labelled, weights=0.5).drop("th")


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("th")


def op3_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitise.digest(pii_sanitise.pii_sanitise(_documents(spark, sf_dir)))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality_crf.quality_crf(docs.select("doc_id", "text"), quality_crf.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii_sanitise.digest(secret_scan.secret_scan(docs, secret_scan.train(docs)), secret_scan.KINDS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), length=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir), size=5, percent=80)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite).select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    return topk_search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_stable_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return stable_knn(vectors, F.col("vec_id") % 20 == 0, k=20)


def op12_interval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_ranking(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite)
    return equal_average_codes(vectors.select("vec_id", "label", F.transform(x, lambda c: F.floor(c * 1024)).alias("v")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_pii_sanitise": op3_pii_sanitise,
    "op4_quality_crf": op4_quality_crf,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_output": op9_token_output,
    "op10_topk_search": op10_topk_search,
    "op11_stable_knn": op11_stable_knn,
    "op12_interval_ranking": op12_interval_ranking,
    "op13_equal_average_codes": op13_equal_average_codes,
}


def _codes_sql(rounds: int = 4) -> str:
    """Four rounds of assignment and means, written out; distances of integers in doubles are exact."""
    steps = [
        """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, vec_id, e[p * (len(e) // 4) + 1:(p + 1) * (len(e) // 4)] AS e FROM v, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, c, e FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, r) - 1 AS c, e FROM x) WHERE c < 256)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT r, p, min(list_value(d, c)) AS best FROM (SELECT x.r, p, b.c,
 list_inner_product(x.e, x.e) - 2 * list_inner_product(x.e, b.e) + list_inner_product(b.e, b.e) AS d FROM x JOIN b{k} b USING (p)) GROUP BY r, p)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT p, c, list(m ORDER BY j) AS e FROM (SELECT p, c, j, floor(sum(y) / count(*)) AS m FROM
 (SELECT p, best[2] AS c, unnest(e) AS y, unnest(range(1, len(e) + 1)) AS j FROM a{k} JOIN x USING (r, p)) GROUP BY p, c, j) GROUP BY p, c),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.e, b.e) AS e FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.c = b.c)"""
            )
    steps.append(
        f"""o AS (SELECT r, string_agg(format('{{:02x}}', CAST(best[2] AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, c, j)) AS codebooks_sha256
 FROM (SELECT p, c, unnest(e) AS y, unnest(range(1, len(e) + 1)) AS j FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"""
    )
    return ",\n".join(steps)


ORACLE: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM win JOIN least USING (h) WHERE lo < doc_id GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM kept)),
cut AS (SELECT doc_id, unnest(g) AS p FROM kept),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT kept.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN left_over USING (doc_id)
""",
    "op7_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pos AS (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS i FROM d),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM pos WHERE 2 * i + 400 <= length(x)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (h)),
opens AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 200, true) AS o FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(o::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM opens),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM runs),
agg AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS stop, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS k
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
""",
    "op10_topk_search": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
""",
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
""",
    "op12_interval_ranking": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, CAST(any_value(n) AS BIGINT) AS nt FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN i USING (t) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * nt * nd) // nl))) AS v FROM p JOIN f USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM i JOIN x USING (t) GROUP BY item_id, doc_id HAVING sum(v) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op13_equal_average_codes": _codes_sql(),
}
