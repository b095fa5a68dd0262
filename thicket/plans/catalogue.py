"""The library's queries over the test tables, each with the SQL that gives the same rows.

Items are the rows of `embeddings` in the order of vec_id, as sign-bit fingerprints or as vectors; clusters are given by
its labels, with label 9 as noise.  Computed values are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import metrics
from ..model import NAN, NOISE, PairFrame, members_of
from ..operators import butina as bt
from ..operators import dbscan as db
from ..operators import hierarchy, pairs, report, representatives
from ..operators.ranking import dense_index
from ..sources.staging import staged

BITS = 64
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- frames ----------------------------------------------------------------------------------------------------------

FP = """
fp AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, label AS cls, embedding AS e,
    CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS b
  FROM embeddings)"""
PAIRS = FP + """,
p AS (SELECT x.idx AS i, y.idx AS j, bit_count(x.b & y.b) AS c, bit_count(x.b) AS px, bit_count(y.b) AS py
  FROM fp x JOIN fp y ON x.idx < y.idx),
pairs AS (SELECT i, j, CASE WHEN px + py - c = 0 THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE - c::DOUBLE / (px + py - c) END AS d FROM p)"""
SYM = PAIRS + """,
sym AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs)"""
LAB = SYM + """,
lab AS (SELECT idx, CASE WHEN cls = 9 THEN -1 ELSE cls END AS label FROM fp),
m AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos FROM lab WHERE label >= 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.fingerprints(table(spark, sf_dir, "embeddings"), "embedding", BITS, "vec_id", "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return dense_index(e, "idx", "vec_id").select("idx", "vector")


def tanimoto(spark: SparkSession, sf_dir: str, cutoff: float | None = None) -> PairFrame:
    return pairs.pdist(items(spark, sf_dir), metrics.fingerprint("tanimoto"), "fingerprint", cutoff=cutoff)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("idx", F.when(F.col("label") == 9, NOISE).otherwise(F.col("label")).cast("int").alias("label"))


def near(threshold: float, name: str = "e") -> str:
    return f"{name} AS (SELECT i AS src, j AS dst FROM sym WHERE d <= {threshold})"


# --- pairs -------------------------------------------------------------------------------------------------------------


def _metric(metric: str, similarity: bool = False) -> Query:
    return lambda spark, d: pairs.pdist(items(spark, d), metrics.fingerprint(metric, similarity), "fingerprint", "similarity" if similarity else "distance").rounded(9)


@query(f"WITH {PAIRS} SELECT i, j, round(d, 9) AS d FROM pairs")
def pdist_tanimoto(spark, sf_dir):
    return _metric("tanimoto")(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT i, j, round(CASE WHEN px + py = 0 THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE - 2 * c::DOUBLE / (px + py) END, 9) AS d FROM p")
def pdist_dice(spark, sf_dir):
    return _metric("dice")(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT i, j, (px + py - 2 * c)::DOUBLE AS d FROM p")
def pdist_manhattan(spark, sf_dir):
    return _metric("manhattan")(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT i, j, round(CASE WHEN px + py - c = 0 THEN 'nan'::DOUBLE ELSE c::DOUBLE / (px + py - c) END, 9) AS d FROM p")
def pdist_similarity(spark, sf_dir):
    return _metric("tanimoto", True)(spark, sf_dir)


VEC = """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT x.idx AS i, y.idx AS j, x.e AS a, y.e AS b FROM v x JOIN v y ON x.idx < y.idx)"""


@query(VEC + " SELECT i, j, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: (a[k] - b[k]) * (a[k] - b[k])))), 6) AS d FROM q")
def pdist_euclidean(spark, sf_dir):
    return pairs.pdist(vectors(spark, sf_dir), metrics.vector("euclidean", BITS), "vector").rounded(6)


@query(
    VEC
    + """ SELECT i, j, round(1.0::DOUBLE - list_sum(list_transform(range(1, 65), lambda k: a[k] * b[k]))
  / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 6) AS d FROM q"""
)
def pdist_cosine(spark, sf_dir):
    return pairs.pdist(vectors(spark, sf_dir), metrics.vector("cosine", BITS), "vector").rounded(6)


@query(f"WITH {PAIRS} SELECT i, j, round(d, 9) AS d FROM pairs WHERE d <= 0.5")
def pdist_cutoff(spark, sf_dir):
    return tanimoto(spark, sf_dir, 0.5).df.select("i", "j", F.round("d", 9).alias("d"))


@query(f"WITH {PAIRS} SELECT i, j, round(d, 9) AS d FROM pairs WHERE d <= 0.5")
def similarity_join(spark, sf_dir):
    return pairs.similarity_join(items(spark, sf_dir), 0.5, BITS).df.select("i", "j", F.round("d", 9).alias("d"))


@query(f"WITH {SYM} SELECT i, j, round(d, 9) AS d FROM sym UNION ALL SELECT idx, idx, 0.0 FROM fp")
def squareform(spark, sf_dir):
    return tanimoto(spark, sf_dir).squareform().select("i", "j", F.round("d", 9).alias("d"))


@query(f"WITH {PAIRS}, n AS (SELECT count(*) AS n FROM fp) SELECT n * i - i * (i + 1) // 2 + j - i - 1 AS k, round(d, 9) AS d FROM pairs, n")
def condensed_index(spark, sf_dir):
    p = tanimoto(spark, sf_dir)
    return replace(p, df=p.rounded(9)).condensed().select("k", "d")


CROSS = f"""WITH {FP}, a AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS i, b FROM fp WHERE cls < 5),
c AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS j, b FROM fp WHERE cls >= 5 OR cls IS NULL),
x AS (SELECT i, j, 1.0::DOUBLE - bit_count(a.b & c.b)::DOUBLE / bit_count(a.b | c.b) AS d FROM a, c)"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return tuple(fp.fingerprints(e.where(c), "embedding", BITS, "vec_id") for c in ("label < 5", "label >= 5 or label is null"))


@query(CROSS + " SELECT i, j, round(d, 9) AS d FROM x")
def cdist_tanimoto(spark, sf_dir):
    return pairs.cdist(*_halves(spark, sf_dir), metrics.fingerprint("tanimoto")).select("i", "j", F.round("d", 9).alias("d"))


@query(CROSS + " SELECT i, j, CASE WHEN d <= 0.55 THEN round(d, 9) ELSE 0.0 END AS d FROM x")
def cdist_cutoff_zero(spark, sf_dir):
    return pairs.cdist_zeroed(*_halves(spark, sf_dir), metrics.fingerprint("tanimoto"), 0.55).select("i", "j", F.round("d", 9).alias("d"))


@query(
    r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS tok FROM documents),
u AS (SELECT doc_id, len(tok) AS n, unnest(tok) AS w FROM t),
c AS (SELECT x.doc_id AS i, y.doc_id AS j, x.n AS a, y.n AS b, count(*) AS k FROM u x JOIN u y ON x.w = y.w AND x.doc_id < y.doc_id AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n GROUP BY ALL),
f AS (SELECT i, j FROM c WHERE k / (a + b - k) >= 0.8),
l AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM f UNION ALL SELECT j FROM f) GROUP BY id)
SELECT doc_id, CASE WHEN len(tok) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY tok) END AS class_id, coalesce(l.n, 0) AS n_links FROM t LEFT JOIN l ON doc_id = l.id"""
)
def doc_jaccard_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    links, members = pairs.token_jaccard(docs.select("doc_id", tokens.alias("tok")), "doc_id", "tok", 0.8)
    return pairs.link_counts(links, members).withColumnRenamed("idx", "doc_id")


# --- fingerprints and their sums -------------------------------------------------------------------------------------


@query(f"WITH {FP} SELECT idx, bit_count(b)::INT AS popcount FROM fp")
def fingerprint_popcount(spark, sf_dir):
    return items(spark, sf_dir).select("idx", "popcount")


SUMS = f"""WITH {FP}, s AS (SELECT cls AS label, k AS bit, sum(CASE WHEN e[k + 1] > 0 THEN 1 ELSE 0 END)::BIGINT AS s, count(*) AS n
  FROM fp, (SELECT unnest(range(64)) AS k) GROUP BY ALL)"""


@query(SUMS + " SELECT label, bit::INT AS bit, s AS sum, n FROM s")
def linear_sum_by_label(spark, sf_dir):
    return fp.linear_sums(items(spark, sf_dir), BITS, "label")


@query(SUMS + " SELECT label, bit::INT AS bit, (CASE WHEN 2 * s >= n THEN 1 ELSE 0 END)::INT AS bit_set FROM s")
def binary_centroid_by_label(spark, sf_dir):
    return fp.binary_centroids(fp.linear_sums(items(spark, sf_dir), BITS, "label")).select("label", "bit", "bit_set")


@query(
    SUMS
    + """, g AS (SELECT label, min(n) AS n, sum(s)::DOUBLE AS k, sum(s * s)::DOUBLE AS k2 FROM s GROUP BY label)
SELECT label, n, round(CASE WHEN (k2 - k) / 2 + n * k - k2 = 0 THEN 'nan'::DOUBLE ELSE ((k2 - k) / 2) / ((k2 - k) / 2 + n * k - k2) END, 9) AS isim FROM g"""
)
def isim_by_label(spark, sf_dir):
    return fp.isim(fp.linear_sums(items(spark, sf_dir), BITS, "label"), "label").select("label", "n", F.round("isim", 9).alias("isim"))


# --- neighbourhoods --------------------------------------------------------------------------------------------------


@query(f"WITH {SYM} SELECT idx, (SELECT count(*) FROM sym WHERE i = idx AND d <= 0.5) + 1 AS count FROM fp")
def threshold_degree(spark, sf_dir):
    return pairs.degree(tanimoto(spark, sf_dir), 0.5)


RANKED = f"WITH {SYM}, r AS (SELECT i AS idx, j AS neighbour, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM sym)"


@query(RANKED + " SELECT idx, rank::INT AS rank, neighbour, round(d, 9) AS d FROM r WHERE rank <= 5")
def knn(spark, sf_dir):
    return pairs.nearest(tanimoto(spark, sf_dir), 5).select("idx", "rank", "neighbour", F.round("d", 9).alias("d"))


@query(RANKED + " SELECT idx, round(d, 9) AS core FROM r WHERE rank = 4")
def core_distance(spark, sf_dir):
    return pairs.core_distances(tanimoto(spark, sf_dir), 5).select("idx", F.round("core", 9).alias("core"))


@query(
    f"""WITH {PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (")}, sym AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs),
c AS MATERIALIZED (SELECT i AS idx, list_sort(list(d))[4] AS core FROM sym GROUP BY i)
SELECT i, j, round(greatest(a.core, b.core, d), 9) AS d FROM pairs JOIN c a ON i = a.idx JOIN c b ON j = b.idx"""
)
def mutual_reachability(spark, sf_dir):
    return pairs.mutual_reachability(tanimoto(spark, sf_dir), 5, 9)


# --- graph clusterings -----------------------------------------------------------------------------------------------


def _components_sql(threshold: float, where: str = "") -> str:
    return f"""WITH RECURSIVE {SYM}, {near(threshold)},
r AS (SELECT idx AS src, idx AS dst FROM fp UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT src AS idx, min(dst) AS root FROM r GROUP BY src)"""


@query(_components_sql(0.45) + " SELECT idx, root AS component FROM c")
def connected_components(spark, sf_dir):
    from ..operators.graph import components

    p = tanimoto(spark, sf_dir, 0.45)
    found, every = components(p.within(0.45)), p.items()
    return every.join(found, every.idx == found.node, "left").select("idx", F.coalesce("component", "idx").alias("component"))


@query(_components_sql(0.48) + " SELECT idx, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM c")
def single_linkage_cut(spark, sf_dir):
    return db.threshold_components(tanimoto(spark, sf_dir, 0.48), 0.48).assignments.select("idx", "label")


DBSCAN = f"""WITH RECURSIVE {SYM}, {near(0.5)},
core AS (SELECT idx FROM fp LEFT JOIN e ON idx = src GROUP BY idx HAVING count(src) + 1 >= 8),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT idx FROM core) AND dst IN (SELECT idx FROM core)),
r AS (SELECT idx AS src, idx AS dst FROM core UNION SELECT r.src, ce.dst FROM r JOIN ce ON r.dst = ce.src),
c AS (SELECT src AS idx, dense_rank() OVER (ORDER BY min(dst)) - 1 AS label FROM r GROUP BY src),
b AS (SELECT src AS idx, min(label) AS label FROM e JOIN c ON dst = c.idx GROUP BY src)"""


@query(DBSCAN + " SELECT fp.idx, coalesce(c.label, b.label, -1)::INT AS label FROM fp LEFT JOIN c ON fp.idx = c.idx LEFT JOIN b ON fp.idx = b.idx")
def dbscan_labels(spark, sf_dir):
    return db.dbscan(tanimoto(spark, sf_dir, 0.5), 0.5, 8).assignments


@query(DBSCAN + " SELECT idx FROM core")
def dbscan_core(spark, sf_dir):
    return db.dbscan(tanimoto(spark, sf_dir, 0.5), 0.5, 8).extra["core"]


BUTINA = f"""WITH RECURSIVE {SYM}, {near(0.5)},
deg AS (SELECT idx, count(src) + 1 AS n, list(dst) FILTER (WHERE dst IS NOT NULL) AS nb FROM fp LEFT JOIN e ON idx = src GROUP BY idx),
o AS (SELECT idx, nb, row_number() OVER (ORDER BY n DESC, idx DESC) AS k FROM deg),
s AS (SELECT 0::BIGINT AS k, -1::BIGINT AS centre, []::BIGINT[] AS taken
  UNION ALL
  SELECT o.k, CASE WHEN list_contains(s.taken, o.idx) THEN -1 ELSE o.idx END,
    CASE WHEN list_contains(s.taken, o.idx) THEN s.taken ELSE list_concat(list_append(s.taken, o.idx), coalesce(o.nb, [])) END
  FROM s JOIN o ON o.k = s.k + 1),
cen AS (SELECT centre AS idx, row_number() OVER (ORDER BY k) - 1 AS label FROM s WHERE centre >= 0)"""


@query(
    BUTINA
    + """, own AS (SELECT src AS idx, min(label) AS label FROM e JOIN cen ON dst = cen.idx GROUP BY src)
SELECT fp.idx, coalesce(cen.label, own.label)::INT AS label FROM fp LEFT JOIN cen ON fp.idx = cen.idx LEFT JOIN own ON fp.idx = own.idx"""
)
def butina_labels(spark, sf_dir):
    return bt.butina(tanimoto(spark, sf_dir, 0.5), 0.5).assignments


@query(BUTINA + " SELECT label::INT AS label, idx AS first FROM cen")
def butina_centers(spark, sf_dir):
    return bt.butina(tanimoto(spark, sf_dir, 0.5), 0.5).extra["centres"]


@query(
    f"""WITH RECURSIVE {SYM.replace("pairs AS (", "pairs AS MATERIALIZED (")}, e AS MATERIALIZED (SELECT i AS src, j AS dst FROM sym WHERE d <= 0.5),
s AS (
  SELECT -1::BIGINT AS step, idx, -1::BIGINT AS place FROM fp
  UNION ALL
  (WITH w AS (SELECT step, idx FROM s WHERE place < 0),
   g AS (SELECT x.idx, count(y.idx) AS n FROM w x LEFT JOIN e ON e.src = x.idx LEFT JOIN w y ON y.idx = e.dst GROUP BY x.idx),
   c AS (SELECT idx FROM g ORDER BY n DESC, idx DESC LIMIT 1),
   k AS (SELECT w.step + 1 AS step, w.idx, CASE WHEN w.idx IN (SELECT idx FROM c) THEN 0 WHEN w.idx IN (SELECT dst FROM e WHERE src IN (SELECT idx FROM c)) THEN 1 ELSE -1 END AS place FROM w)
   SELECT step, idx, place::BIGINT FROM k))
SELECT step::INT AS label, (row_number() OVER (PARTITION BY step ORDER BY place, idx) - 1)::INT AS pos, idx FROM s WHERE place >= 0"""
)
def butina_reordered(spark, sf_dir):
    return bt.butina(tanimoto(spark, sf_dir, 0.5), 0.5, reordering=True).members


# --- scorecard -------------------------------------------------------------------------------------------------------

PROFILE = """, sz AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*), label) AS r FROM m GROUP BY label),
a AS (SELECT count(*) AS num_samples, count(*) FILTER (WHERE label < 0) AS num_noise FROM lab),
z AS (SELECT count(*) AS k, count(*) FILTER (WHERE n = 1) AS one, max(n) AS top, quantile_cont(n, 0.5) AS med, quantile_cont(n, 0.9) AS p90,
  sum(n)::DOUBLE AS t, sum(r * n)::DOUBLE AS w, sum(n * log2(n)) AS sl FROM sz)"""
PROFILE_COLUMNS = """num_samples, k AS num_clusters, num_noise, one AS num_singletons, round(num_noise / num_samples, 6) AS noise_fraction,
  round(top / num_samples, 6) AS largest_cluster_fraction, round((one + num_noise) / (k + num_noise), 6) AS singleton_fraction,
  round(med, 6) AS cluster_size_median, round(p90, 6) AS cluster_size_p90, round(2 * w / (k * t) - (k + 1) / k, 6) AS size_gini, round(log2(t) - sl / t, 6) AS size_entropy"""
CARD = LAB + """,
lp AS (SELECT i, j, d, x.label AS la, y.label AS lb FROM pairs JOIN m x ON i = x.idx JOIN m y ON j = y.idx),
pc AS (SELECT s.i AS idx, x.label AS own, y.label AS other, avg(d) AS mean, max(d) AS mx FROM sym s JOIN m x ON s.i = x.idx JOIN m y ON s.j = y.idx GROUP BY ALL),
me AS (SELECT m.idx, m.label, m.pos, coalesce(pc.mean, 0) AS mean, coalesce(pc.mx, 0) AS mx FROM m LEFT JOIN pc ON m.idx = pc.idx AND pc.own = m.label AND pc.other = m.label),
med AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean, pos) AS r FROM me) WHERE r = 1)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _frames(spark: SparkSession, sf_dir: str) -> report.Frames:
    return report.frames(labelled(spark, sf_dir), tanimoto(spark, sf_dir))


@query(f"WITH {LAB}{PROFILE} SELECT {PROFILE_COLUMNS} FROM a, z")
def cluster_profile(spark, sf_dir):
    return rounded(report.profile(labelled(spark, sf_dir)))


@query(
    f"""WITH {CARD}, dia AS (SELECT x.label, coalesce(max(d), 0) AS dia FROM (SELECT DISTINCT label FROM m) x LEFT JOIN lp ON la = x.label AND lb = x.label GROUP BY x.label),
q1 AS (SELECT round(avg(d), 6) AS mean_intra_distance, round(quantile_cont(d, 0.5), 6) AS median_intra_distance FROM lp WHERE la = lb),
q2 AS (SELECT round(quantile_cont(dia, 0.95), 6) AS p95_diameter FROM dia),
q3 AS (SELECT round(quantile_cont(mx, 0.5), 6) AS median_radius, round(quantile_cont(mean, 0.5), 6) AS median_medoid_member_distance FROM med)
SELECT * FROM q1, q2, q3"""
)
def cluster_compactness(spark, sf_dir):
    return rounded(report.compactness(_frames(spark, sf_dir)))


@query(
    f"""WITH {CARD}, b AS (SELECT idx, min(mean) AS b FROM pc WHERE own <> other GROUP BY idx)
SELECT round(avg(CASE WHEN greatest(mean, b) = 0 THEN 0 ELSE (b - mean) / greatest(mean, b) END), 6) AS silhouette FROM me JOIN b USING (idx)"""
)
def cluster_silhouette(spark, sf_dir):
    return rounded(report.silhouette(_frames(spark, sf_dir)))


@query(f"WITH {CARD} SELECT round(min(d) FILTER (WHERE la <> lb) / max(d) FILTER (WHERE la = lb), 6) AS dunn_index FROM lp")
def cluster_dunn(spark, sf_dir):
    return rounded(report.dunn(_frames(spark, sf_dir)))


@query(f"WITH {CARD} SELECT count(*) AS boundary_violations FROM lp WHERE la <> lb AND d <= 0.5")
def cluster_boundary(spark, sf_dir):
    return report.boundary(_frames(spark, sf_dir), 0.5)


COVER = """, nd AS (SELECT fp.idx, CASE WHEN fp.idx IN (SELECT idx FROM med) THEN 0 ELSE min(d) END AS d FROM fp LEFT JOIN sym ON sym.i = fp.idx AND sym.j IN (SELECT idx FROM med) GROUP BY fp.idx)"""


@query(f"WITH {CARD}{COVER} SELECT t AS threshold, round(avg(CASE WHEN d <= t THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM nd, (SELECT unnest([0.4, 0.5, 0.6])::DOUBLE AS t) GROUP BY t")
def cluster_coverage(spark, sf_dir):
    thresholds = (0.4, 0.5, 0.6)
    found = report.coverage(_frames(spark, sf_dir), thresholds)
    return found.select(F.posexplode("coverage_at").alias("k", "c")).select(F.array(*map(F.lit, thresholds))[F.col("k")].alias("threshold"), F.round("c", 6).alias("coverage"))


@query(
    f"WITH {CARD} SELECT round(quantile_cont(d, 0.5), 6) AS representative_redundancy FROM (SELECT i, min(d) AS d FROM sym WHERE i IN (SELECT idx FROM med) AND j IN (SELECT idx FROM med) GROUP BY i)"
)
def cluster_redundancy(spark, sf_dir):
    return rounded(report.redundancy(_frames(spark, sf_dir)))


@query(
    f"""WITH {CARD}{COVER}{PROFILE}, w AS (SELECT {PROFILE_COLUMNS} FROM a, z), c AS (SELECT t, avg(CASE WHEN d <= t THEN 1.0 ELSE 0.0 END) AS v FROM nd, (SELECT unnest([0.25, 0.35, 0.45])::DOUBLE AS t) GROUP BY t),
dia AS (SELECT x.label, coalesce(max(d), 0) AS dia FROM (SELECT DISTINCT label FROM m) x LEFT JOIN lp ON la = x.label AND lb = x.label GROUP BY x.label),
bb AS (SELECT idx, min(mean) AS b FROM pc WHERE own <> other GROUP BY idx),
profile AS (SELECT name AS metric, value AS v FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM w) UNPIVOT (value FOR name IN (COLUMNS(*)))),
every AS (
  SELECT metric, v FROM profile
  UNION ALL SELECT 'boundary_violations', count(*) FROM lp WHERE la <> lb AND d <= 0.3
  UNION ALL SELECT 'mean_intra_distance', avg(d) FROM lp WHERE la = lb
  UNION ALL SELECT 'median_intra_distance', quantile_cont(d, 0.5) FROM lp WHERE la = lb
  UNION ALL SELECT 'p95_diameter', quantile_cont(dia, 0.95) FROM dia
  UNION ALL SELECT 'median_radius', quantile_cont(mx, 0.5) FROM med
  UNION ALL SELECT 'median_medoid_member_distance', quantile_cont(mean, 0.5) FROM med
  UNION ALL SELECT 'silhouette', avg(CASE WHEN greatest(mean, b) = 0 THEN 0 ELSE (b - mean) / greatest(mean, b) END) FROM me JOIN bb USING (idx)
  UNION ALL SELECT 'dunn_index', min(d) FILTER (WHERE la <> lb) / max(d) FILTER (WHERE la = lb) FROM lp
  UNION ALL SELECT 'representative_redundancy', quantile_cont(d, 0.5) FROM (SELECT i, min(d) AS d FROM sym WHERE i IN (SELECT idx FROM med) AND j IN (SELECT idx FROM med) GROUP BY i)
  UNION ALL SELECT 'coverage_at[' || t || ']', v FROM c)
SELECT metric, round(v, 6) AS labels, round(CASE WHEN metric = 'coverage_at[0.25]' THEN v WHEN metric LIKE 'coverage%' THEN 'nan'::DOUBLE ELSE v END, 6) AS again FROM every"""
)
def report_compare(spark, sf_dir):
    labels, p = staged(labelled(spark, sf_dir), "labels"), tanimoto(spark, sf_dir)
    both = {"labels": report.report(labels, p), "again": report.report(labels, p, coverage_thresholds=(0.25,))}
    return rounded(report.compare(both))


# --- representatives -------------------------------------------------------------------------------------------------

REP = LAB + """,
g AS (SELECT m.label, m.idx, m.pos, x.idx IS NOT NULL AS inside, d FROM m JOIN sym ON sym.i = m.idx LEFT JOIN m x ON x.idx = sym.j AND x.label = m.label),
size AS (SELECT label, count(*) AS n FROM m GROUP BY label),
r AS (SELECT g.label, idx, pos, n, coalesce(avg(d) FILTER (WHERE inside), 0) AS mean, coalesce(max(d) FILTER (WHERE inside), 0) AS mx,
  coalesce(quantile_cont(d, 0.5) FILTER (WHERE inside), 0) AS med, (count(*) FILTER (WHERE inside AND d <= 0.6) + 1) / n AS frac, coalesce(min(d) FILTER (WHERE NOT inside), 'inf'::DOUBLE) AS ext
  FROM g JOIN size USING (label) GROUP BY g.label, idx, pos, n)"""


def _ranked(method: str, columns: list[str], **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        clusters = members_of(labelled(spark, sf_dir))
        out = representatives.rank(clusters, tanimoto(spark, sf_dir), method, threshold=0.6, digits=9, **options)
        return rounded(out.select("label", "idx", "score", F.col("rank").cast("int").alias("rank"), *columns))

    return run


@query(
    f"""WITH {REP} SELECT label, idx, round(mean, 6) AS score, (row_number() OVER (PARTITION BY label ORDER BY round(mean, 9), pos))::INT AS rank,
  round(mean, 6) AS mean, round(mx, 6) AS max, round(med, 6) AS median, round(frac, 6) AS neighbor_fraction, round(ext, 6) AS nearest_external, round(mx, 6) AS radius,
  round(max(mx) OVER (PARTITION BY label), 6) AS diameter, round(CASE WHEN greatest(ext, mean) = 0 THEN 0 ELSE (ext - mean) / greatest(ext, mean) END, 6) AS silhouette_like FROM r"""
)
def rep_rank_medoid(spark, sf_dir):
    return _ranked("medoid", ["mean", "max", "median", "neighbor_fraction", "nearest_external", "radius", "diameter", "silhouette_like"])(spark, sf_dir)


@query(f"WITH {REP} SELECT label, idx, round(mx, 6) AS score, (row_number() OVER (PARTITION BY label ORDER BY round(mx, 9), pos))::INT AS rank FROM r")
def rep_minimax(spark, sf_dir):
    return _ranked("minimax", [])(spark, sf_dir)


@query(f"WITH {REP} SELECT label, idx, round(-frac, 6) AS score, (row_number() OVER (PARTITION BY label ORDER BY round(-frac, 9), pos))::INT AS rank FROM r")
def rep_highest_neighborhood(spark, sf_dir):
    return _ranked("highest_neighborhood", [])(spark, sf_dir)


@query(
    f"""WITH {REP}, w AS (SELECT label, r.idx, pos, mean + 0.5 * coalesce(l.toxic, 0) - 0.2 * coalesce(l.quality, 0) AS score FROM r LEFT JOIN labels l ON l.doc_id = r.idx)
SELECT label, idx, round(score, 6) AS score, (row_number() OVER (PARTITION BY label ORDER BY round(score, 9), pos))::INT AS rank FROM w"""
)
def rep_weighted(spark, sf_dir):
    meta = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("toxic").cast("double").alias("liability"), F.col("quality").cast("double").alias("priority"))
    meta = meta.join(items(spark, sf_dir).select("idx"), "idx", "left_semi")
    return _ranked("weighted", [], beta=0.5, gamma=0.2, metadata=meta)(spark, sf_dir)


@query(f"WITH {REP} SELECT label, idx, rank FROM (SELECT label, idx, (row_number() OVER (PARTITION BY label ORDER BY round(mean, 9), pos))::INT AS rank FROM r) WHERE rank <= 3")
def rep_topk(spark, sf_dir):
    found = representatives.representatives(members_of(labelled(spark, sf_dir)), tanimoto(spark, sf_dir), 3, digits=9)
    return found.select("label", "idx", F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH {REP}, k AS (SELECT label, idx, row_number() OVER (PARTITION BY label ORDER BY round(mean, 9), pos) AS rank FROM r),
f AS (SELECT k.label, k.idx, k.rank, row_number() OVER (PARTITION BY k.label ORDER BY d DESC, k.rank) AS far FROM k JOIN k top ON top.label = k.label AND top.rank = 1 AND k.rank > 1 JOIN sym ON sym.i = k.idx AND sym.j = top.idx)
SELECT label, idx, rank::INT AS rank FROM k WHERE rank = 1 UNION ALL SELECT label, idx, rank::INT FROM f WHERE far = 1"""
)
def rep_diversity_k2(spark, sf_dir):
    found = representatives.representatives(members_of(labelled(spark, sf_dir)), tanimoto(spark, sf_dir), 2, "diversity", digits=9)
    return found.select("label", "idx", F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH {FP}, sz AS (SELECT cls, count(*) AS n FROM fp GROUP BY cls ORDER BY n DESC, cls LIMIT 4),
bits AS (SELECT idx, cls, k FROM fp, (SELECT unnest(range(64)) AS k) WHERE e[k + 1] > 0),
cen AS (SELECT b.cls AS label, sz.n AS n, k FROM bits b JOIN sz ON b.cls = sz.cls GROUP BY b.cls, sz.n, k HAVING 2 * count(*) >= sz.n),
cp AS (SELECT label, n, count(*) AS cp FROM cen GROUP BY ALL),
s AS (SELECT f.idx, c.label, c.n, count(*) AS k, bit_count(f.b) AS p FROM fp f JOIN bits b ON f.idx = b.idx JOIN cen c ON c.k = b.k WHERE f.cls IN (SELECT cls FROM sz) GROUP BY ALL),
t AS (SELECT idx, s.label, s.n, s.k / (s.p + cp.cp - s.k) AS sim FROM s JOIN cp ON s.label = cp.label)
SELECT idx, label, round(sim, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, n DESC, label) AS r FROM t) WHERE r = 1"""
)
def reassign_top_clusters(spark, sf_dir):
    x = staged(items(spark, sf_dir), "items")
    return hierarchy.reassign_top(x, x.select("label", "idx"), BITS, 4).select("idx", "label", F.round("similarity", 9).alias("similarity"))


# --- sequential clusterings ------------------------------------------------------------------------------------------


def _merges_sql(rule: str, clusters: int) -> str:
    """Merges (step, a, b, d, size) until so many clusters are left; x and y are the distances of the two parts to
    another cluster, na and nb their sizes."""
    return f"""WITH RECURSIVE {PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (")}, total AS (SELECT count(*) AS n FROM fp),
s AS (
  SELECT 0::BIGINT AS step, i AS a, j AS b, d, 1::BIGINT AS sa, 1::BIGINT AS sb, false AS merged FROM pairs
  UNION ALL
  (WITH w AS (SELECT * FROM s WHERE NOT merged),
   best AS (SELECT step, a, b, d, sa, sb, (SELECT n FROM total) + step AS id FROM w WHERE step < (SELECT n FROM total) - {clusters} ORDER BY d, a, b LIMIT 1),
   x AS (SELECT CASE WHEN w.a = best.a THEN w.b ELSE w.a END AS c, CASE WHEN w.a = best.a THEN w.sb ELSE w.sa END AS sc, w.d AS x FROM w, best WHERE (w.a = best.a) <> (w.b = best.a) AND w.a <> best.b AND w.b <> best.b),
   y AS (SELECT CASE WHEN w.a = best.b THEN w.b ELSE w.a END AS c, w.d AS y FROM w, best WHERE (w.a = best.b) <> (w.b = best.b) AND w.a <> best.a AND w.b <> best.a)
   SELECT step, a, b, d, sa, sb, true FROM best
   UNION ALL
   SELECT w.step + 1, w.a, w.b, w.d, w.sa, w.sb, false FROM w, best WHERE w.a NOT IN (best.a, best.b) AND w.b NOT IN (best.a, best.b)
   UNION ALL
   SELECT best.step + 1, x.c, best.id, {rule}, x.sc, best.sa + best.sb, false FROM x JOIN y ON x.c = y.c, best)),
merges AS MATERIALIZED (SELECT step, a, b, d, sa + sb AS size FROM s WHERE merged)"""


CUT = """, up AS (SELECT a AS node, (SELECT n FROM total) + step AS parent FROM merges UNION ALL SELECT b, (SELECT n FROM total) + step FROM merges),
t AS (SELECT idx, idx AS node FROM fp UNION ALL SELECT t.idx, up.parent FROM t JOIN up ON up.node = t.node),
top AS (SELECT idx, max(node) AS root FROM t GROUP BY idx),
own AS (SELECT root, min(idx) AS first FROM top GROUP BY root)
SELECT idx, (dense_rank() OVER (ORDER BY first) - 1)::INT AS label FROM top JOIN own USING (root)"""
AVERAGE = "(best.sa * x.x + best.sb * y.y) / (best.sa + best.sb)"


@query(_merges_sql(AVERAGE, 10) + CUT)
def agglomerative_average(spark, sf_dir):
    return hierarchy.agglomerative(tanimoto(spark, sf_dir), 10).assignments


@query(_merges_sql("greatest(x.x, y.y)", 10) + CUT)
def agglomerative_complete(spark, sf_dir):
    return hierarchy.agglomerative(tanimoto(spark, sf_dir), 10, linkage="complete").assignments


@query(_merges_sql("(x.x + y.y) / 2", 1) + ' SELECT step::INT AS step, a AS "left", b AS "right", round(d, 9) AS distance, size FROM merges')
def agglomerative_weighted(spark, sf_dir):
    found = hierarchy.agglomerative(tanimoto(spark, sf_dir), 10, linkage="weighted").extra["merges"]
    return found.withColumn("distance", F.round("distance", 9))


@query(_components_sql(0.48) + " SELECT idx, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM c")
def agglomerative_single(spark, sf_dir):
    return hierarchy.agglomerative(tanimoto(spark, sf_dir), None, 0.48, "single").assignments


@query()
def hdbscan_eom(spark, sf_dir):
    found = hierarchy.hdbscan(tanimoto(spark, sf_dir), 5, 5)
    return found.assignments.join(found.extra["probabilities"], "idx")


@query()
def hdbscan_leaf(spark, sf_dir):
    return hierarchy.hdbscan(tanimoto(spark, sf_dir), 5, 5, method="leaf").assignments


@query()
def bitbirch(spark, sf_dir):
    return hierarchy.bitbirch(items(spark, sf_dir), BITS, 0.5).members


@query()
def bitbirch_recluster(spark, sf_dir):
    return hierarchy.bitbirch_recluster(items(spark, sf_dir), BITS, 0.5, 0.55).members


@query()
def bitbirch_refine(spark, sf_dir):
    return hierarchy.bitbirch_refine(items(spark, sf_dir), BITS, 0.5, redistribute_largest_cluster=True, reassign_top_clusters=4, clean=True).members


@query()
def bitbirch_parallel(spark, sf_dir):
    return hierarchy.bitbirch_parallel(items(spark, sf_dir), BITS, 0.5, parts=4).members


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["NAN", "oracle_sql", "queries"]
