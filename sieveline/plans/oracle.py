"""DuckDB SQL for the registered queries: an independent statement of the same rows."""

from __future__ import annotations


def split_sql(key: str) -> str:
    digit = f"substr(md5(CAST({key} AS varchar)), 1, 1)"
    return f"CASE WHEN {digit} IN ('a', 'b', 'c') THEN 'validation' WHEN {digit} IN ('d', 'e', 'f') THEN 'test' ELSE 'train' END"


EMB = f"emb AS (SELECT vec_id AS id, CASE WHEN label <= 2 THEN 0 ELSE 1 END AS label, CAST(embedding AS double[]) AS x, {split_sql('vec_id')} AS split FROM embeddings)"
ORD = f"""
    o0 AS (SELECT o_orderkey AS id, {split_sql('o_orderkey')} AS split, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS label, o_totalprice,
                  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, c_mktsegment, n_name AS nation
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    ord AS (SELECT * EXCLUDE (c_mktsegment), CASE WHEN split = 'test' AND c_mktsegment = 'MACHINERY' THEN 'ROBOTICS' ELSE c_mktsegment END AS segment FROM o0)
"""
LBL = """
    lbl AS (SELECT d.doc_id AS id, quality AS label, CAST(n_chars AS double) AS n_chars, CAST(length(coalesce(text, '')) AS double) AS n_code_points,
                   CAST(len(string_split(coalesce(text, ''), chr(10))) AS double) AS n_lines, lang FROM documents d JOIN labels USING (doc_id))
"""
CODES = f"""{ORD},
    long AS (SELECT id, split, col, category FROM (SELECT id, split, priority, segment, nation FROM ord)
             UNPIVOT INCLUDE NULLS (category FOR col IN (priority, segment, nation))),
    codes AS (SELECT col, category, row_number() OVER (PARTITION BY col ORDER BY category) - 1 AS code
              FROM (SELECT DISTINCT col, category FROM long WHERE split = 'train' AND category IS NOT NULL))
"""


def probes_sql(k: int = 5) -> str:
    return f"""{EMB}, probes AS (
        SELECT k, id, label, x FROM (
            SELECT k, id, label, x, row_number() OVER (PARTITION BY k, label = 0 ORDER BY md5('42-' || k || '-' || id), id) AS o
            FROM emb, range({k}) t(k) WHERE split = 'train') WHERE o <= 25)"""


def vote(queries: str, contexts: str = "probes", by: str = "k") -> str:
    return f"""SELECT q.id, c.{by}, sum(CASE WHEN c.label = 1 THEN w ELSE 0 END) / sum(w) AS p
        FROM (SELECT q.id, c.{by}, c.label, exp(list_dot_product(q.x, c.x) / 0.1::double) AS w FROM {queries} q, {contexts} c) z, (SELECT 1) o
        """.replace("q.id, c.", "z.id, z.", 1).replace("c.label = 1", "z.label = 1") + "GROUP BY ALL"


def predicted(where: str) -> str:
    return f"{probes_sql()}, q AS (SELECT * FROM emb WHERE {where}), pred AS ({vote('q')})"


NOISY = "split = 'train' AND label = 1"
MOMENTS = """
    mom AS (SELECT id, list(p ORDER BY k) AS v, avg(p) AS mu, least(greatest(stddev_pop(p) / 0.5::double, 0), 1) AS sigma FROM pred GROUP BY id),
    ent AS (SELECT *, least(greatest(mu, 1e-7), 1 - 1e-7) AS c, -(c * log2(c) + (1 - c) * log2(1 - c)) AS entropy FROM mom)
"""


def nearest(rows: str, v: str, k: int = 15) -> str:
    return f"""
    unit AS (SELECT id, [a / sqrt(list_dot_product({v}, {v})) for a in {v}] AS u FROM {rows}),
    near AS (SELECT a.id, b.id AS nid, round(1 - list_dot_product(a.u, b.u), 10) AS dist FROM unit a JOIN unit b ON a.id <> b.id),
    knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM near QUALIFY rank <= {k})
"""


SCORED = f"""{MOMENTS}, {nearest('mom', 'v')},
    nb AS (SELECT knn.id, avg(CASE WHEN mu > 0.5 THEN 1::double ELSE 0 END) AS agreement, 1::double / (avg(dist) + 1e-8) AS raw FROM knn JOIN mom ON nid = mom.id GROUP BY knn.id),
    den AS (SELECT id, agreement, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-8) AS density FROM nb),
    sc AS (SELECT id, v, mu, sigma, entropy, agreement, density,
                  0.3::double * mu + 0.2::double * (1 - sigma) + 0.15::double * (1 - entropy) + 0.2::double * agreement + 0.15::double * density AS reliability_score
           FROM ent JOIN den USING (id))
"""
THRESHOLDS = "th AS (SELECT quantile_cont(reliability_score, 0.7) AS hi, quantile_cont(reliability_score, 0.3) AS lo FROM sc)"
CLASS = "CASE WHEN reliability_score >= hi THEN 'reliable' WHEN reliability_score >= lo THEN 'uncertain' ELSE 'suspect' END AS classification"
SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("mu", "sigma", "entropy", "agreement", "density", "reliability_score"))
ALL_SCORED = f"WITH {predicted(NOISY)}, {SCORED}, {THRESHOLDS}"
JOINT = f"""WITH {predicted('true')}, {SCORED}, l AS (SELECT sc.*, split, label FROM sc JOIN emb USING (id)),
    th AS (SELECT quantile_cont(reliability_score, 0.7) AS hi, quantile_cont(reliability_score, 0.3) AS lo FROM l WHERE label = 1),
    j AS (SELECT l.*, {CLASS} FROM l, th)"""
MEAN, VAR = "list_sum(v) / len(v)", "list_sum([(a - list_sum(v) / len(v)) * (a - list_sum(v) / len(v)) for a in v]) / len(v)"
POOL = f"""{ALL_SCORED}, pool AS (SELECT id, v, reliability_score, {MEAN} AS m, {VAR} AS var FROM sc, th WHERE reliability_score >= lo)"""
INFORMED = """inf AS (SELECT id, reliability_score * (1 + 0.25::double * least(greatest((var - q5) / (q95 - q5 + 1e-8), 0), 1)) AS r
    FROM pool, (SELECT quantile_cont(var, 0.05) AS q5, quantile_cont(var, 0.95) AS q95 FROM pool))"""
BOUNDARY = """bnd AS (SELECT id, 0.6::double * (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER () + 1e-10)
    + 0.4::double * (var - min(var) OVER ()) / (max(var) OVER () - min(var) OVER () + 1e-10) AS r FROM pool)"""


def first(rows: str, rank: str, n: int, extra: str = "") -> str:
    return f"SELECT id, row_number() OVER (ORDER BY round({rank}, 10) DESC, id) AS ord{extra} FROM {rows} QUALIFY ord <= {n}"


def lloyd(rows: str, n: int, name: str = "medoid") -> str:
    """One step from hash-drawn rows; ``rows`` has id and v."""
    return f"""
    seeds AS (SELECT row_number() OVER (ORDER BY md5('42-' || id), id) - 1 AS cluster, v FROM {rows} QUALIFY cluster < {n}),
    assigned AS (SELECT r.id, r.v, s.cluster FROM {rows} r, seeds s
                 QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY round(list_distance(r.v, s.v), 10), s.cluster) = 1),
    means AS (SELECT cluster, list(x ORDER BY i) AS c FROM (
        SELECT cluster, i, avg(v[i]) AS x FROM assigned, unnest(range(1, len(v) + 1)) u(i) GROUP BY cluster, i) GROUP BY cluster),
    {name} AS (SELECT cluster, id FROM assigned JOIN means USING (cluster)
               QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(list_distance(v, c), 10), id) = 1)
"""


CURVE = f"""{ORD}, d AS (SELECT round(o_totalprice / 1000) AS s, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM ord)"""


def steps(by: str = "", rows: str = "d") -> str:
    """Curve steps, for each value of the columns ``by``."""
    part, lead = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""
    g AS (SELECT {lead}s, sum(y) AS np, count(*) AS n FROM {rows} GROUP BY ALL),
    c AS (SELECT *, sum(np) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part}ORDER BY s DESC) AS pp,
                 sum(np) OVER ({part.strip()}) AS tot_p, sum(n) OVER ({part.strip()}) AS tot_n FROM g)
"""


AP = "sum(np::double / tot_p * tp / pp)"
AUC = "sum((n - np) * (tp - np) + 0.5::double * np * (n - np)) / max(tot_p * (tot_n - tot_p))"
F1 = "round(2 * (tp::double / pp) * (tp::double / tot_p) / (tp::double / pp + tp::double / tot_p + 1e-8), 12)"


def measured(keys: str) -> str:
    """From pred(keys, id, p): validation metrics with their threshold, and test metrics at it, by keys."""
    lead = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    on = keys
    return f"""
    d AS (SELECT {keys}, split, round(1 - p, 12) AS s, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM pred JOIN emb USING (id)),
    {steps(keys + ', split')},
    area AS (SELECT {keys}, split, {AP} AS pr_auc, {AUC} AS roc_auc FROM c GROUP BY ALL),
    best AS (SELECT {keys}, s AS threshold FROM c WHERE split = 'validation' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {F1} DESC, s) = 1),
    point AS (
        SELECT {keys}, split, threshold, count(*) FILTER (WHERE s >= threshold AND y = 1)::double AS tp,
               count(*) FILTER (WHERE s >= threshold AND y = 0)::double AS fp, count(*) FILTER (WHERE s < threshold AND y = 1)::double AS fn
        FROM d JOIN best USING ({on}) GROUP BY ALL),
    e AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
                 coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM point JOIN area USING ({on}, split)),
    res AS (SELECT {lead}, v.roc_auc AS val_roc_auc, v.pr_auc AS val_pr_auc, v.f1 AS val_f1, v.precision AS val_precision, v.recall AS val_recall,
                   e.roc_auc AS test_roc_auc, e.pr_auc AS test_pr_auc, e.f1 AS test_f1, e.precision AS test_precision, e.recall AS test_recall, e.threshold
            FROM e JOIN (SELECT * FROM e WHERE split = 'validation') v USING ({on}) WHERE e.split = 'test')
"""


def reported(keys: str) -> str:
    """From pred(keys, id, p): the figures of metric files by keys and split, the threshold of each fitted on itself."""
    return f"""
    d AS (SELECT {keys}, split, round(1 - p, 12) AS s, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM pred JOIN emb USING (id)),
    {steps(keys + ', split')},
    area AS (SELECT {keys}, split, {AP} AS pr_auc, {AUC} AS roc_auc FROM c GROUP BY ALL),
    best AS (SELECT {keys}, split, s AS optimal_threshold FROM c QUALIFY row_number() OVER (PARTITION BY {keys}, split ORDER BY {F1} DESC, s) = 1),
    point AS (SELECT {keys}, split, optimal_threshold, count(*) FILTER (WHERE s >= optimal_threshold AND y = 1)::double AS tp,
                     count(*) FILTER (WHERE s >= optimal_threshold AND y = 0) AS fp, count(*) FILTER (WHERE s < optimal_threshold AND y = 1) AS fn
              FROM d JOIN best USING ({keys}, split) GROUP BY ALL),
    rep AS (SELECT {keys}, split, roc_auc, pr_auc, 2 * tp / (2 * tp + fp + fn) AS f1, optimal_threshold, (tp + fp)::bigint AS n_predicted_bogus
            FROM point JOIN area USING ({keys}, split))
"""


MIXED = ("o_totalprice", "c_acctbal", "priority", "segment", "nation")
VALUES = [f"{s}_{m}" for s in ("val", "test") for m in ("roc_auc", "pr_auc", "f1", "precision", "recall")]
EVAL = "q AS (SELECT * FROM emb WHERE split <> 'train')"
BASELINE_CONTEXT = """
    drawn AS (SELECT run, id, label, x FROM (SELECT run, id, label, x, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || '-' || id), id) AS o
              FROM emb, range({runs}) t(run) WHERE split = 'train' AND label = 1) WHERE o <= {n})
"""
BASELINE = f"""WITH {EMB}, {BASELINE_CONTEXT.format(runs=3, n=100)}, ctx AS (
    SELECT * FROM drawn UNION ALL SELECT run, id, label, x FROM emb, range(3) t(run) WHERE split = 'train' AND label = 0),
    {EVAL}, pred AS ({vote('q', 'ctx', 'run')}), {reported('run')}, val AS (SELECT * FROM rep WHERE split = 'validation')"""


def diverse(rows: str, sizes: dict[int, int], tries: int = 3, most: int = 300) -> str:
    """kept(target_size, id): each size's medoids of k-means, or all of ``rows`` (id, x) if there are no more; for WITH RECURSIVE.

    Each try starts from different rows drawn by hash and moves its centres to the means of their rows until they stay;
    those without rows move to the rows that are farthest from their centres. The cheapest try counts.
    """
    near = "min({{'d': round(list_distance(x, c), 10), 'k': cluster}}) AS near FROM {0}, {1} GROUP BY target_size, try, id"
    return f"""
    want(target_size, n) AS (VALUES {', '.join(f'({s}, {n})' for s, n in sizes.items())}),
    fits AS (
        SELECT 0 AS step, target_size, try, row_number() OVER (PARTITION BY target_size, try ORDER BY md5((42 + try) || '-' || id), id) AS cluster, x AS c, n
        FROM (SELECT min(id) AS id, x FROM {rows} GROUP BY x), want, range({tries}) t(try) WHERE (SELECT count(*) FROM {rows}) > n QUALIFY cluster <= n
        UNION ALL (
        WITH met AS MATERIALIZED (SELECT target_size, try, id, {near.format(rows, 'fits')}),
        middle AS (SELECT target_size, try, cluster, list(a ORDER BY i) AS mean FROM (
            SELECT target_size, try, near.k AS cluster, i, avg(x[i]) AS a FROM met JOIN {rows} USING (id), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY ALL),
        far AS (SELECT target_size, try, id, row_number() OVER (PARTITION BY target_size, try ORDER BY near.d DESC, id) AS gap FROM met WHERE near.d > 0),
        meant AS (SELECT *, CASE WHEN mean IS NULL THEN count(*) FILTER (WHERE mean IS NULL) OVER (PARTITION BY target_size, try ORDER BY cluster) END AS gap
                  FROM fits LEFT JOIN middle USING (target_size, try, cluster)),
        moves AS (SELECT step, target_size, try, cluster, c, n, coalesce(mean, x, c) AS dest
                  FROM meant LEFT JOIN far USING (target_size, try, gap) LEFT JOIN {rows} ON {rows}.id = far.id)
        SELECT step + 1, target_size, try, cluster, dest, n FROM moves WHERE step < {most} QUALIFY max(list_distance(dest, c)) OVER (PARTITION BY target_size, try) > 1e-12)),
    ends AS MATERIALIZED (SELECT * FROM fits QUALIFY step = max(step) OVER (PARTITION BY target_size, try)),
    held AS MATERIALIZED (SELECT target_size, try, id, {near.format(rows, 'ends')}),
    cheap AS (SELECT target_size, try FROM (SELECT target_size, try, round(sum(near.d * near.d), 6) AS cost FROM held GROUP BY target_size, try)
              QUALIFY row_number() OVER (PARTITION BY target_size ORDER BY cost, try) = 1),
    kept AS (SELECT target_size, id FROM held JOIN cheap USING (target_size, try) QUALIFY row_number() OVER (PARTITION BY target_size, near.k ORDER BY near.d, id) = 1
             UNION ALL SELECT target_size, id FROM {rows}, want WHERE (SELECT count(*) FROM {rows}) <= n)"""


def ablation(trusted: str | None = None) -> str:
    """``trusted`` states kept(target_size, id), the trusted rows of a size's sets; without it they are all."""
    contexts = []
    for size in (200, 240):
        n = size // 2
        contexts.append(f"SELECT {size} AS target_size, 'baseline_random' AS method, run + 1 AS run, id, label, x FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || '-' || id), id) AS o FROM emb, range(2) t(run) WHERE split = 'train' AND label = 1) WHERE o <= {n}")
        for method, rows in (("random", f"SELECT id, row_number() OVER (ORDER BY md5('42-' || id), id) AS ord FROM pool QUALIFY ord <= {n}"), ("reliable", first("pool", "reliability_score", n)), ("informed", first("inf", "r", n)), ("boundary", first("bnd", "r", n))):
            contexts.append(f"SELECT {size}, '{method}', 1, id, label, x FROM ({rows}) JOIN emb USING (id)")
    chosen = " UNION ALL ".join(contexts)
    keep = "FROM emb, cfg WHERE split = 'train' AND label = 0" if trusted is None else "FROM kept JOIN emb USING (id) JOIN cfg USING (target_size)"
    # The scoring CTEs have names that the metrics use again, so the pool stands in a query of its own.
    return f"""WITH {'' if trusted is None else 'RECURSIVE '}{EMB}, {'' if trusted is None else f'{trusted}, '}pool AS MATERIALIZED ({POOL} SELECT * FROM pool), {INFORMED}, {BOUNDARY},
    neg AS ({chosen}), cfg AS (SELECT DISTINCT target_size, method, run, target_size || method || run AS cfg FROM neg),
    ctx AS (SELECT target_size || method || run AS cfg, id, label, x FROM neg UNION ALL SELECT cfg, id, label, x {keep}),
    {EVAL}, pred AS ({vote('q', 'ctx', 'cfg')}), {measured('cfg')}, named AS (SELECT cfg.* EXCLUDE (cfg), res.* EXCLUDE (cfg) FROM res JOIN cfg USING (cfg))"""


#: The trusted rows of the ablation's sets: half of a target, as diverse as can be.
DIVERSE = f"""pos AS MATERIALIZED (SELECT id, x FROM emb WHERE split = 'train' AND label = 0), {diverse('pos', {200: 100, 240: 120})}"""


def six(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


FLOPS = """WITH s AS (SELECT unnest([100, 200, 500, 1000, 2000, 5000])::bigint AS n, 302::bigint AS l, 8::bigint AS e, 10000::bigint AS q),
    p AS (SELECT *, l * (2*3*128 + 3 * (4*128*128 + 4*128*128 + 4*128*256)) AS col,
        2 * (8*l*128*128 + 4*l*l*128 + 4*l*128*256) + (16*128*128 + 4*l*128*128 + 16*l*128 + 16*128*256) AS rw,
        12 * (4*512*512 + 4*512*1024 + 4*64*512) + 12*4*512*n AS icl, 2*512*1024 + 2*1024*10 AS dec,
        l * (2*10*128 + 3 * (4*128*128 + 4*128*128)) + 12*4*512*512 + 2*10*512 AS kv,
        l * 3 * (4*128*128*128 + 4*128*128*256 + 4*128*64*128 + 4*128*128*128) AS ind FROM s),
    f AS (SELECT *, col + rw + icl + dec AS one FROM p),
    t AS (SELECT n AS target_size, 298::bigint AS n_features, e AS n_estimators, q AS n_query, e * one AS per_query_flops, e * col AS per_query_col, e * rw AS per_query_row,
        e * icl AS per_query_icl, e * dec AS per_query_decoder, e * ((n + 1) * one + n * kv + ind) AS single_query_uncached_flops, e * (n * one + n * kv + ind) AS fit_flops,
        q * e * one AS call_flops_cached, e * ((n + q) * one + n * kv + ind) AS call_flops_uncached FROM f)"""

#: The closed forms for one member, on the shapes of the check.
CHECKED = FLOPS.replace("SELECT unnest([100, 200, 500, 1000, 2000, 5000])::bigint AS n, 302::bigint AS l, 8::bigint AS e, 10000::bigint AS q", """
    SELECT n::bigint AS n, h::bigint AS h, (h + 4)::bigint AS l, 1::bigint AS e, q::bigint AS q FROM (VALUES (100, 50, 10), (300, 100, 40), (600, 100, 100)) x(n, q, h)""") + """,
    checked AS (SELECT 'fit' AS phase, n, q, h, n * one + n * kv + ind AS flops FROM f UNION ALL SELECT 'predict_cached', n, q, h, q * one FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "scan_split": f"WITH {ORD} SELECT split, label, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ord GROUP BY ALL",
    "feature_topn": "SELECT unnest(['o_totalprice', 'c_acctbal', 'priority', 'segment', 'nation']) AS feature",
    "fit_encoding": f"WITH {CODES} SELECT col, category, code FROM codes",
    "apply_encoding": f"""WITH {CODES} SELECT id, split, coalesce(p.code, -1) AS priority, coalesce(s.code, -1) AS segment, coalesce(n.code, -1) AS nation FROM ord
        LEFT JOIN codes p ON p.col = 'priority' AND p.category = priority LEFT JOIN codes s ON s.col = 'segment' AND s.category = segment
        LEFT JOIN codes n ON n.col = 'nation' AND n.category = nation""",
    "unseen_counts": f"""WITH {CODES} SELECT split, col, count(*) FILTER (WHERE category IS NOT NULL AND code IS NULL) AS n_unseen
        FROM long LEFT JOIN codes USING (col, category) GROUP BY ALL""",
    "cardinality_flag": f"WITH {CODES} SELECT col, count(*) AS n_categories, count(*) > 20 AS high FROM codes GROUP BY col",
    "class_filter": f"WITH {LBL} SELECT id, n_chars, n_lines, lang FROM lbl WHERE label = 0",
    "not_positive": f"WITH {LBL} SELECT id, label, n_code_points FROM lbl WHERE label <> 0",
    "split_union": f"WITH {EMB} SELECT id, split, label FROM emb",
    "probe_sets": f"WITH {probes_sql()} SELECT k, id, label FROM probes",
    "probe_predict": f"WITH {predicted(NOISY)} SELECT id, k, round(p, 6) AS p FROM pred",
    "single_support_predict": f"""WITH {probes_sql(1)}, q AS (SELECT * FROM emb WHERE split = 'validation'), pred AS ({vote('q')})
        SELECT id, round(1 - p, 6) AS p_trusted, round(p, 6) AS p_noisy FROM pred""",
    "mu_sigma_entropy": f"WITH {predicted(NOISY)}, {MOMENTS} SELECT id, {six(['mu', 'sigma', 'entropy'])} FROM ent",
    "knn15": f"WITH {EMB}, {nearest('emb', 'x')} SELECT id, rank, nid, round(dist, 8) AS dist FROM knn",
    "agreement": f"{ALL_SCORED} SELECT id, round(agreement, 6) AS agreement FROM sc",
    "density": f"{ALL_SCORED} SELECT id, round(density, 6) AS density FROM sc",
    "reliability_score": f"{ALL_SCORED} SELECT id, {SIX} FROM sc",
    "percentile_thresholds": f"{ALL_SCORED} SELECT round(hi, 6) AS reliable, round(lo, 6) AS suspect FROM th",
    "classify_percentile": f"{ALL_SCORED} SELECT id, {CLASS} FROM sc, th",
    "classify_fixed": f"{ALL_SCORED} SELECT id, {CLASS} FROM sc, (SELECT 0.55::double AS hi, 0.35::double AS lo)",
    "joint_scoring": f"{JOINT} SELECT id, split, label, {SIX}, classification FROM j",
    "split_class_counts": f"""{JOINT} SELECT split, {', '.join(f"count(*) FILTER (WHERE classification = '{c}') AS n_{c}" for c in ('reliable', 'uncertain', 'suspect'))}
        FROM j WHERE label = 1 GROUP BY split""",
    "impute_median": f"WITH {ORD} SELECT id, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM ord), 0) AS c_acctbal, o_totalprice FROM ord",
    "l2_normalize": f"""WITH {EMB}, t AS (SELECT id, [3 * a for a in x] AS x FROM emb), u AS (SELECT id, sqrt(list_dot_product(x, x)) AS l, [a / sqrt(list_dot_product(x, x)) for a in x] AS u FROM t)
        SELECT id, round(l, 6) AS length, round(u[1], 6) AS first, round(sqrt(list_dot_product(u, u)), 6) AS unit FROM u""",
    "cosine_pairs": f"WITH {EMB} SELECT a.id, round(1 - list_cosine_similarity(a.x, b.x), 6) AS dist FROM emb a JOIN emb b ON b.id = a.id + 1",
    "neg_random": f"{POOL} SELECT id, row_number() OVER (ORDER BY md5('42-' || id), id) AS ord FROM pool QUALIFY ord <= 60",
    "neg_reliable": f"{POOL} {first('pool', 'reliability_score', 60)}",
    "neg_informed": f"{POOL}, {INFORMED} {first('inf', 'r', 60)}",
    "neg_boundary": f"{POOL}, {BOUNDARY} {first('bnd', 'r', 60)}",
    "neg_hybrid": f"""{POOL.replace('pool AS (', 'pool AS MATERIALIZED (')}, nv AS (SELECT id, [a / sqrt(list_dot_product(v, v)) for a in v] AS v FROM pool), {lloyd('nv', 24)},
        s1 AS (SELECT id FROM medoid), k1 AS (SELECT count(*) AS n FROM s1),
        s2 AS (SELECT id FROM pool ANTI JOIN s1 USING (id) QUALIFY row_number() OVER (ORDER BY round(m, 10) DESC, id) <= 36 - (SELECT n FROM k1)),
        u2 AS (SELECT * FROM s1 UNION SELECT * FROM s2),
        s3 AS (SELECT id FROM pool ANTI JOIN u2 USING (id) QUALIFY row_number() OVER (ORDER BY round(var, 10) DESC, id) <= 48 - (SELECT count(*) FROM u2)),
        u3 AS (SELECT * FROM u2 UNION SELECT * FROM s3),
        s4 AS (SELECT id FROM pool ANTI JOIN u3 USING (id) QUALIFY row_number() OVER (ORDER BY md5('42-' || id), id) <= 60 - (SELECT count(*) FROM u3))
        SELECT id, row_number() OVER (ORDER BY id) AS ord FROM (SELECT * FROM u3 UNION SELECT * FROM s4)""",
    "lloyd_medoids": f"WITH {EMB}, r AS (SELECT id, x AS v FROM emb), {lloyd('r', 12)} SELECT cluster, id FROM medoid",
    "support_set": f"{POOL} SELECT id, 0 AS label, 0::bigint AS ord FROM emb WHERE split = 'train' AND label = 0 UNION ALL (SELECT id, 1 AS label, ord FROM ({first('pool', 'reliability_score', 60)}))",
    "support_sets": f"""{POOL} SELECT k, id, 0 AS label FROM emb, range(2) t(k) WHERE split = 'train' AND label = 0
        UNION ALL (SELECT k, id, 1 AS label FROM pool, range(2) t(k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5((42 + k) || '-' || id), id) <= 60)""",
    "saved_set": f"""WITH {CODES}, enc AS (SELECT id, split, label, o_totalprice::double AS o_totalprice, c_acctbal::double AS c_acctbal,
            coalesce(p.code, -1)::double AS priority, coalesce(s.code, -1)::double AS segment, coalesce(n.code, -1)::double AS nation FROM ord
            LEFT JOIN codes p ON p.col = 'priority' AND p.category = priority LEFT JOIN codes s ON s.col = 'segment' AND s.category = segment
            LEFT JOIN codes n ON n.col = 'nation' AND n.category = nation),
        span AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) - min({c}) + 1e-8 AS {c}_by' for c in MIXED)} FROM enc WHERE split = 'train'),
        chosen AS (SELECT * FROM enc WHERE split = 'train' AND label = 0 UNION ALL
            (SELECT * FROM enc WHERE split = 'train' AND label = 1 QUALIFY row_number() OVER (ORDER BY md5('42-' || id), id) <= 60))
        SELECT id, {', '.join(MIXED)}, label, round({' + '.join(f'coalesce(({c} - {c}_lo) / {c}_by, 0)' for c in MIXED)}, 6) AS sum_x FROM chosen, span""",
    "boundary_top": f"{ALL_SCORED} {first('sc', 'reliability_score', 25)}",
    "roc_auc": f"WITH {CURVE}, {steps()} SELECT round({AUC}, 6) AS roc_auc FROM c",
    "average_precision": f"WITH {CURVE}, {steps()} SELECT round({AP}, 6) AS pr_auc FROM c",
    "pr_curve": f"""WITH {CURVE}, {steps()} SELECT s AS threshold, round(tp::double / pp, 6) AS precision, round(tp::double / tot_p, 6) AS recall FROM c
        UNION ALL SELECT NULL, 1, 0""",
    "best_f1_threshold": f"WITH {CURVE}, {steps()} SELECT s AS threshold, round({F1}, 6) AS best_f1 FROM c ORDER BY {F1} DESC, s LIMIT 1",
    "hard_prediction": f"""WITH {CURVE}, k AS (SELECT count(*) FILTER (WHERE s >= 120 AND y = 1)::double AS tp, count(*) FILTER (WHERE s >= 120 AND y = 0) AS fp, count(*) FILTER (WHERE s < 120 AND y = 1) AS fn FROM d)
        SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, (tp + fp)::bigint AS n_predicted FROM k""",
    "metrics_val_to_test": f"""WITH {probes_sql(1)}, {EVAL}, pred AS ({vote('q')}), {measured('k')}
        SELECT split, {six(['roc_auc', 'pr_auc', 'f1', 'precision', 'recall', 'threshold'])}, (tp + fp)::bigint AS n_predicted FROM e""",
    "baseline_runs": f"{BASELINE} SELECT run + 1 AS run, split, {six(['roc_auc', 'pr_auc', 'f1', 'optimal_threshold'])}, n_predicted_bogus FROM rep",
    "baseline_best_set": f"{BASELINE} SELECT id, label FROM ctx WHERE run = (SELECT run FROM val ORDER BY pr_auc DESC, run LIMIT 1)",
    "baseline_summary": f"""{BASELINE} SELECT {', '.join(f"round(avg({m}) FILTER (WHERE split = '{s}'), 6) AS {n}_{m}_mean" for n, s in (('val', 'validation'), ('test', 'test')) for m in ('pr_auc', 'roc_auc', 'f1'))},
        {', '.join(f"round(stddev_samp(pr_auc) FILTER (WHERE split = '{s}'), 6) AS {n}_pr_auc_std" for n, s in (('val', 'validation'), ('test', 'test')))} FROM rep""",
    "ablation_results": f"{ablation()} SELECT target_size::bigint AS target_size, method, run::bigint AS run, {six([*VALUES, 'threshold'])} FROM named",
    "ablation_summary": f"""{ablation(DIVERSE)} SELECT target_size::bigint AS target_size, method, {', '.join(f'round(avg({c}), 6) AS {c}_mean' for c in VALUES)},
        {', '.join(f'round(coalesce(stddev_samp({s}_pr_auc), 0), 6) AS {s}_pr_auc_std' for s in ('val', 'test'))} FROM named GROUP BY target_size, method""",
    "convergence_lag": f"""{BASELINE}, h AS (SELECT run + 1 AS iteration, round(pr_auc, 10) AS metric, lag(round(pr_auc, 10)) OVER (ORDER BY run) AS previous FROM val)
        SELECT iteration, round(metric, 6) AS metric, round(previous, 6) AS previous, round(metric - previous, 6) AS gain, coalesce(metric - previous < 0.005, false) AS stops FROM h""",
    "best_run": f"{BASELINE} SELECT run + 1 AS iteration, round(round(pr_auc, 10), 6) AS metric FROM val WHERE pr_auc > 0 ORDER BY round(pr_auc, 10) DESC, run LIMIT 1",
    "prediction_vectors_wide": f"WITH {predicted(NOISY)}, {MOMENTS} SELECT id, {', '.join(f'round(v[{k + 1}], 6) AS p_fraud_probe_{k}' for k in range(5))} FROM mom",
    "flops_table": f"""{FLOPS} SELECT * EXCLUDE (n_query), round(fit_flops / n_query, 6) AS fit_amortized_per_query,
        round(per_query_flops / first(per_query_flops) OVER (ORDER BY target_size), 6) AS per_query_vs_smallest,
        round(single_query_uncached_flops / first(single_query_uncached_flops) OVER (ORDER BY target_size), 6) AS single_query_uncached_vs_smallest,
        round(call_flops_uncached / call_flops_cached, 6) AS cache_speedup FROM t""",
    "flops_linear_coeffs": "SELECT 4408397824::bigint AS intercept, 196608::bigint AS slope",
    "cost_validation": f"""{CHECKED} SELECT phase, n AS n_support, q AS n_query, h AS n_features, flops AS measured, flops AS analytical, 0::double AS err_pct FROM checked""",
    "cost_error": "SELECT 0::double AS max_abs_err_pct",
    "chunk_estimate": """SELECT s AS n_support, h AS n_features, e AS n_estimators,
        least(50000, greatest(100, trunc((16384 * 0.7::double - 138.54::double - 2.27e-4 * h) / (e * (-2.07e-5 + 5.37e-3 * h)))::bigint - s))::bigint AS chunk
        FROM (VALUES (500::bigint, 150::bigint, 8::bigint), (1000, 150, 8), (5000, 150, 8), (500, 298, 8), (100, 10, 1)) t(s, h, e)""",
}
