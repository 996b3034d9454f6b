"""DuckDB SQL oracles for the registered queries (shared CTE fragments).

The SQL mirrors the semantics of each operator independently of the Spark
implementation: it is what the driver compares against at sf0.01.
"""

from __future__ import annotations

from reviewlens.operators.prepare import NUMERIC_FEATURES
from reviewlens.plans.bindings import BOOKS_SQL, REVIEWS_SQL

# reviews joined to books, helpfulness ratio (P1), imputation (A1), F1
JOINED_CTE = f"""
r AS ({REVIEWS_SQL}),
bk AS ({BOOKS_SQL}),
m0 AS (
  SELECT r.title, r.user_id, r.review_time, coalesce(r.review_text, '') AS review_text, r.order_key,
         r.line_number, r.supp_key, r.quantity, r.price, r.discount, r.tax, r.is_returned, r.helpfulness,
         r.score, bk.ratings_count, coalesce(bk.categories, '') AS categories,
         TRY_CAST(split_part(r.helpfulness, '/', 1) AS DOUBLE)
           / NULLIF(TRY_CAST(split_part(r.helpfulness, '/', 2) AS DOUBLE), 0) AS helpfulness_ratio
  FROM r JOIN bk ON r.title IS NOT DISTINCT FROM bk.title),
mm AS (SELECT avg(score) AS ms, avg(helpfulness_ratio) AS mh, avg(ratings_count) AS mr FROM m0),
m AS (
  SELECT m0.title, m0.user_id, m0.review_time, m0.review_text, m0.order_key, m0.categories,
         m0.line_number, m0.supp_key, m0.quantity, m0.price, m0.discount, m0.tax, m0.is_returned,
         m0.helpfulness,
         coalesce(m0.score, mm.ms) AS score,
         coalesce(m0.helpfulness_ratio, mm.mh) AS helpfulness_ratio,
         coalesce(m0.ratings_count, mm.mr) AS ratings_count
  FROM m0 CROSS JOIN mm
  WHERE coalesce(m0.score, mm.ms) IS NOT NULL AND coalesce(m0.helpfulness_ratio, mm.mh) IS NOT NULL
    AND coalesce(m0.ratings_count, mm.mr) IS NOT NULL)
"""

# six numeric features (P11 with J2, A4, P4, P5)
FEATURES_CTE = JOINED_CTE + """,
uc AS (SELECT user_id, count(*) AS c FROM m WHERE user_id IS NOT NULL GROUP BY user_id),
t0 AS (SELECT min(review_time) AS t0 FROM m),
f AS (
  SELECT m.*, CAST(length(m.review_text) AS DOUBLE) AS review_length,
         CAST(coalesce(uc.c, 0) AS DOUBLE) AS user_review_count,
         CAST(epoch_us(m.review_time) - epoch_us(t0.t0) AS DOUBLE) / 86400000000.0 AS days_since_first
  FROM m LEFT JOIN uc ON m.user_id = uc.user_id CROSS JOIN t0)
"""


def hbos_scores_cte(feats: list[str] = NUMERIC_FEATURES, n_bins: int = 10, alpha: float = 0.1,
                    contamination: float = 0.1, src: str = "f") -> str:
    """CTEs ``st``, ``hb``, ``ht``, ``hs`` (row scores) and ``hf`` (flags) over ``src``."""
    d = len(feats)
    st_cols = ", ".join(
        f"min({c}) AS lo{j}, max({c}) AS hi{j}, var_pop({c}) AS v{j}" for j, c in enumerate(feats))
    bins = ", ".join(
        f"CAST(least(floor(({c} - st.lo{j}) / ((st.hi{j} - st.lo{j}) / {n_bins}.0)), {n_bins - 1}) AS INTEGER) AS b{j}"
        for j, c in enumerate(feats))
    counts = " UNION ALL ".join(
        f"SELECT {j} AS j, b{j} AS b, count(*) AS c FROM hb GROUP BY b{j}" for j in range(d))
    widths = " UNION ALL ".join(
        f"SELECT {j} AS j, (hi{j} - lo{j}) / {n_bins}.0 AS w, v{j} AS v, n FROM st" for j in range(d))
    joins = " ".join(f"LEFT JOIN ht t{j} ON t{j}.j = {j} AND t{j}.b = hb.b{j}" for j in range(d))
    total = " + ".join(f"(CASE WHEN st.v{j} > 0 THEN t{j}.term ELSE 0.0 END)" for j in range(d))
    return f"""
st AS (SELECT count(*) AS n, {st_cols} FROM {src}),
hb AS (SELECT {src}.*, {bins} FROM {src} CROSS JOIN st),
hc AS ({counts}),
hw AS ({widths}),
ht AS (SELECT hc.j, hc.b, -log2(hc.c / (hw.n * (hw.w / sqrt(hw.v))) + {alpha}) AS term
       FROM hc JOIN hw ON hc.j = hw.j WHERE hw.v > 0),
hs AS (SELECT hb.*, {total} AS hbos_score FROM hb CROSS JOIN st {joins}),
hq AS (SELECT quantile_cont(hbos_score, {1.0 - contamination}) AS thr FROM hs),
hf AS (SELECT hs.*, hs.hbos_score > hq.thr AS is_anomaly FROM hs CROSS JOIN hq)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes)


# standardised embeddings (D0 on a vector column) and all pair distances
EMB_CTE = """
e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
es AS (SELECT i, avg(v) AS m, var_pop(v) AS s2 FROM e GROUP BY i),
z AS (SELECT e.vec_id, e.i, (e.v - es.m) / sqrt(es.s2) AS z FROM e JOIN es USING (i) WHERE es.s2 > 0),
pd AS (SELECT a.vec_id AS id, b.vec_id AS nid, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS dist
       FROM z a JOIN z b ON a.i = b.i GROUP BY 1, 2)
"""


def knn_cte(k: int) -> str:
    return f"""
kn AS (SELECT id, nid, dist, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS r
                                   FROM pd WHERE id <> nid) WHERE r <= {k})
"""


def lof_cte(k: int, contamination: float) -> str:
    return knn_cte(k) + f""",
kd AS (SELECT id, max(dist) AS kdist FROM kn GROUP BY id),
lrd AS (SELECT kn.id, 1.0 / (avg(greatest(kd.kdist, kn.dist)) + 1e-10) AS lrd
        FROM kn JOIN kd ON kn.nid = kd.id GROUP BY kn.id),
lof AS (SELECT kn.id, avg(l2.lrd) / any_value(l1.lrd) AS lof
        FROM kn JOIN lrd l2 ON kn.nid = l2.id JOIN lrd l1 ON kn.id = l1.id GROUP BY kn.id),
lthr AS (SELECT quantile_cont(lof, {1.0 - contamination}) AS t FROM lof)
"""


def dbscan_sql(eps: float, min_samples: int) -> str:
    return "WITH RECURSIVE " + EMB_CTE.strip() + f""",
nw AS (SELECT id, count(*) AS n_within FROM pd WHERE dist <= {eps} GROUP BY id),
core AS (SELECT id, n_within, n_within >= {min_samples} AS is_core FROM nw),
nc AS (SELECT p.id, count_if(c.is_core) AS n_core FROM pd p JOIN core c ON p.nid = c.id
       WHERE p.dist <= {eps} GROUP BY p.id),
edges AS (SELECT p.id AS a, p.nid AS b FROM pd p JOIN core ca ON p.id = ca.id JOIN core cb ON p.nid = cb.id
          WHERE p.dist <= {eps} AND ca.is_core AND cb.is_core),
reach(id, lbl) AS (SELECT a, a FROM edges WHERE a = b
                   UNION SELECT e.b, r.lbl FROM reach r JOIN edges e ON r.id = e.a),
clab AS (SELECT id, min(lbl) AS label FROM reach GROUP BY id),
blab AS (SELECT p.id, min(cl.label) AS label FROM pd p JOIN core c ON p.id = c.id JOIN clab cl ON p.nid = cl.id
         WHERE p.dist <= {eps} AND NOT c.is_core GROUP BY p.id)
SELECT core.id AS vec_id, core.n_within, core.is_core, coalesce(clab.label, blab.label) AS cluster,
       (NOT core.is_core AND nc.n_core = 0) AS is_anomaly
FROM core JOIN nc ON core.id = nc.id LEFT JOIN clab ON core.id = clab.id LEFT JOIN blab ON core.id = blab.id"""
