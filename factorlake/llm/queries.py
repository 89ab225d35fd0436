"""The thin queries of the operators: whole tables in, the contracts' columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(_t(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(_t(spark, sf_dir, "documents")).drop("spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_t(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    from pyspark.sql import functions as F

    from .sentencepiece_sa import encode

    e = encode(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_t(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_t(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a first edition of each (the first half of its text), a third deleted and put back, and a
    revision of every row to its whole text; each batch is committed twice, which changes nothing, and all are compacted."""
    from pyspark.sql import functions as F

    from .common import crc_mod, new_path
    from .token_counts import Rollup, changes, revised, with_tokens

    version = "byte_bpe_50k"
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    first = docs.withColumn("text", F.expr("left(text, int(char_length(text) / 2))"))
    third = first.where(crc_mod("doc_id", 3) == 0)
    counts = docs.select("source", "lang", "text", F.expr("left(text, int(char_length(text) / 2))").alias("old"))
    counts = with_tokens(with_tokens(counts, text="old").withColumnRenamed("n_tokens", "old_tokens")).withColumnRenamed("n_tokens", "new_tokens")
    counts = counts.withColumn("old_chars", F.char_length("old")).withColumn("new_chars", F.char_length("text"))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    batches = {"load": changes(first, 1, version), "delete": changes(third, -1, version), "put back": changes(third, 1, version), "revise": revised(counts, version)}
    for name, signed in batches.items():
        rollup.commit(name, signed)
        rollup.commit(name, signed)
    rollup.compact()
    return rollup.totals()


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_texts

    return main_texts(_t(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d),
w AS MATERIALIZED (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM p),
x AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
s AS (SELECT r, p, sum(CASE WHEN p <= q + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM x)),
a AS (SELECT r, min(p) AS lo, max(p) + 400 AS hi FROM s GROUP BY r, run),
g AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM a),
k AS (SELECT r, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS front FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
        "op5_jaccard_join": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda p: array_to_string(w[p:p + 3], ' ')))) END AS s FROM w),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS c, s, min(doc_id) AS m, CAST(len(s) AS BIGINT) AS n FROM f GROUP BY s),
t AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM c),
r AS MATERIALIZED (SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY k, g) AS p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM t)),
q AS (SELECT c, n, g FROM r WHERE 100 * (p - 1) <= 15 * n),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM q a JOIN q b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, x.s AS xs, y.s AS ys, x.n AS xn, y.n AS yn FROM cand JOIN c x ON x.c = a JOIN c y ON y.c = b) WHERE 185 * len(list_intersect(xs, ys)) >= 85 * (xn + yn)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
u AS (SELECT c AS a, c AS b FROM c WHERE c IN (SELECT a FROM e) UNION SELECT u.a, e.b FROM u JOIN e ON u.b = e.a),
k AS (SELECT a, min(m) AS m FROM u JOIN c ON c.c = u.b GROUP BY a)
SELECT f.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN f.doc_id ELSE coalesce(k.m, c.m) END AS component_id
FROM f JOIN c ON f.s = c.s LEFT JOIN k ON k.a = c.c""",
        "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
        "op8_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p0 FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[p0:p0 + l - 1], ' ') AS k FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS k FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.l = bw.l),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    }
