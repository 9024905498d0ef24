"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, licenses, merkle, neardup, pieces, quality, spotsigs, substring, tokens, toxicity, urls
from .common import read, shared_dir


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read(spark, sf_dir, "documents"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(read(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokens.write_ids(read(spark, sf_dir, "documents"), path, end_id=1)
    return tokens.Reader(spark, path).index()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.report(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(read(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "embeddings"), k=16, dim=64, scale=64, rounds=3)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


_ALL = (
    op1_chat_format, op2_sentencepiece, op3_substring_dedup, op4_quality_rules, op5_minhash_neardup, op6_token_files, op7_url_filter, op8_spotsigs, op9_license_scan, op10_best_fit_packing,
    op11_centroid_clusters, op12_toxicity, op13_merkle_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Words of whole texts, their place and number.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SUBSTRING_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS pos FROM win JOIN first USING (k) WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d) p ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
_NEAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) r USING (doc_id)"""


def _cluster_sql(k: int, dim: int, scale: int, rounds: int) -> str:
    """Lloyd's rounds one after the other, every vector against every centroid."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min((d, c))[2] AS c, min(d) AS d FROM (SELECT r, c, {gap} AS d FROM v CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            sums = f"SELECT c, p, sum(y) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS y, unnest(range({dim})) AS p FROM a{i} a JOIN v USING (r)) GROUP BY ALL"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM ({sums}) GROUP BY c) m USING (c))")
    a, c = f"a{rounds}", f"c{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.x, ',')) AS centroid_sha256
FROM {a} a JOIN v USING (r) JOIN {c} o ON o.c = a.c"""


_LETTERS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 by its polynomial, byte by byte and bit by bit, of decimal numbers.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({}, ''), lambda s: ascii(s)::BIGINT),
lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _merkle_sql(fan: int = 16) -> str:
    """Each level of the trees of the sources, then of the tree above them, then the folding of each leaf's path upwards."""

    def field(x):
        return f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    # A tree's nodes of all levels: (tree, level, place, h, m), m the nodes of the level.
    def grown(name, begun):
        return f"""{name} AS (SELECT t, 0 AS l, p, h, m FROM {begun}
UNION ALL SELECT t, l + 1, p // {fan}, sha256(string_agg(h, '' ORDER BY p)), any_value((m + {fan - 1}) // {fan}) FROM {name} WHERE m > 1 GROUP BY t, l, p // {fan})"""

    # Runs: the digests below a parent, in order.
    def runs(name, of):
        return f"{name} AS MATERIALIZED (SELECT t, l, p // {fan} AS q, list(h ORDER BY p) AS hs FROM {of} WHERE m > 1 GROUP BY ALL)"

    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, {leaf("text")} AS h, {_CRC.format("doc_id::VARCHAR")} % 5 = 0 AS hit, {leaf(_LETTERS.format("text"))} AS h2 FROM documents),
leaves AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id, h) AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id, h) - 1 AS p,
count(*) OVER (PARTITION BY source) AS m, doc_id, h, CASE WHEN hit THEN h2 ELSE h END AS h2 FROM d),
{grown("low", "leaves")},
subs AS MATERIALIZED (SELECT -1 AS t, t AS p, h, (SELECT count(*) FROM low WHERE m = 1) AS m FROM low WHERE m = 1),
{grown("high", "subs")},
{runs("below", "low")}, {runs("above", "high")},
walk AS (SELECT r, t, 0 AS l, p, m, h2 AS h, '' AS seen, false AS up FROM leaves
UNION ALL SELECT r, n.t, n.l, n.p, n.m, n.h, n.seen, n.up FROM (
SELECT w.r, CASE WHEN w.m > 1 THEN w.t ELSE -1 END AS t, CASE WHEN w.m > 1 THEN w.l + 1 ELSE 0 END AS l, CASE WHEN w.m > 1 THEN w.p // {fan} ELSE w.t END AS p,
CASE WHEN w.m > 1 THEN (w.m + {fan - 1}) // {fan} ELSE (SELECT any_value(m) FROM subs) END AS m, w.up OR w.m = 1 AS up,
CASE WHEN w.m > 1 THEN sha256(array_to_string(list_transform(b.hs, lambda x, i: CASE WHEN i = w.p % {fan} + 1 THEN w.h ELSE x END), '')) ELSE w.h END AS h,
CASE WHEN w.m > 1 THEN w.seen || array_to_string(list_filter(b.hs, lambda x, i: i <> w.p % {fan} + 1), '') ELSE w.seen END AS seen
FROM walk w LEFT JOIN (SELECT * FROM below UNION ALL SELECT * FROM above) b ON b.t = w.t AND b.l = w.l AND b.q = w.p // {fan} WHERE w.m > 1 OR NOT w.up) n),
root AS (SELECT any_value(h) AS root FROM high WHERE m = 1)
SELECT x.doc_id, x.h AS leaf, s.h AS subroot, root, sha256(w.seen) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM leaves x JOIN (SELECT * FROM walk WHERE up AND m = 1) w USING (r) JOIN subs s ON s.p = x.t CROSS JOIN root"""


#: The others hold trained cutoffs, tokenizers or digests that DuckDB cannot express: tests hold them against brute force.
ORACLE = {"op3_substring_dedup": _SUBSTRING_SQL, "op5_minhash_neardup": _NEAR_SQL, "op11_centroid_clusters": _cluster_sql(16, 64, 64, 3), "op13_merkle_manifest": _merkle_sql()}
