"""The same results as SQL, computed by other means: long tables, and matrices as nested lists."""

from __future__ import annotations

X = "x AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
LONG = "l AS (SELECT row_id, label, unnest(generate_series(0, len(e)-1))::INT AS dim, unnest(e) AS v FROM x)"
PAIRS = """s AS (SELECT row_id // 2 AS pair_id, row_id % 2 + 1 AS side, label, e FROM x),
p AS (SELECT a.pair_id, a.e AS e1, b.e AS e2, 5e0 - abs(a.label - b.label) * 5e0 / 9 AS score,
             (a.label = b.label)::INT AS label
      FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.side = 1 AND b.side = 2)"""
DOCS = """d AS (SELECT d.doc_id AS row_id, d.text, l.quality AS label,
  CASE WHEN substr(md5(d.doc_id::VARCHAR), 32, 1) IN ('0','1','2') THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN labels l USING (doc_id))"""
ALL_DOCS = DOCS.replace("documents d JOIN", "documents d LEFT JOIN")
COV = """cv AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS v
  FROM l a JOIN l b USING (row_id) GROUP BY ALL),
mu AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY dim),
ml AS (SELECT list(m ORDER BY dim) AS m, list(s ORDER BY dim) AS s FROM mu),
cc AS (SELECT cv.i, cv.j, cv.v / (a.s * b.s) AS v FROM cv JOIN mu a ON a.dim = i JOIN mu b ON b.dim = j)"""


def r6(expression: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0"


def listed(name: str, source: str, ridge: str = "0.0") -> str:
    """Matrix of ``(i, j, v)`` rows as a nested list, with a number added to the diagonal."""
    return f"""{name} AS (SELECT list(r ORDER BY i) AS a FROM
      (SELECT i, list(v + CASE WHEN i = j THEN {ridge} ELSE 0.0 END ORDER BY j) AS r FROM {source} GROUP BY i))"""


def product(p: str, q: str) -> str:
    """p times q for a symmetric q."""
    return f"list_transform({p}, lambda pr: list_transform({q}, lambda qr: list_inner_product(pr, qr)))"


def inverse_root(name: str, matrix: str, steps: int = 14) -> str:
    """Inverse square root of a symmetric positive matrix by a coupled Newton iteration.

    It converges to 1e-13 within 12 steps here; many more steps only gather rounding errors.
    """
    return f"""{name}_s AS (SELECT a, len(a) AS d,
   sqrt(list_sum(list_transform(a, lambda r: list_inner_product(r, r)))) AS f FROM {matrix}),
{name}_it AS (
  SELECT 0 AS k, d, f, list_transform(a, lambda r: list_transform(r, lambda v: v / f)) AS y,
         list_transform(range(d), lambda i: list_transform(range(d), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END)) AS z
  FROM {name}_s
  UNION ALL
  SELECT k + 1, d, f, {product('y', 't')}, {product('t', 'z')}
  FROM (SELECT k, d, f, y, z, list_transform(zy, lambda r, i: list_transform(r, lambda v, j:
               (CASE WHEN i = j THEN 3.0::DOUBLE ELSE 0.0 END - v) / 2)) AS t
        FROM (SELECT *, {product('z', 'y')} AS zy FROM {name}_it WHERE k < {steps}))
),
{name} AS (SELECT list_transform(z, lambda r: list_transform(r, lambda v: v / sqrt(f))) AS a FROM {name}_it WHERE k = {steps})"""


def sphered(root: str, scaled: bool) -> str:
    """Rows times the symmetric inverse root; ``scaled`` divides by the deviations first."""
    unit = "list_transform(list_zip(e, m, s), lambda t: (t[1] - t[2])" + (" / t[3])" if scaled else " + 0 * t[3])")
    return f"""w AS (SELECT row_id, list_transform(a, lambda r: list_inner_product(r, c)) AS z
      FROM (SELECT row_id, {unit} AS c FROM x, ml), {root})"""


ENTRIES = f"""SELECT row_id, unnest(generate_series(0, len(z)-1))::INT AS dim, {r6('unnest(z)')} AS value FROM w"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


# ------------------------------------------------------------------ folds and naive Bayes


def folds(source: str, k: int = 5, seed: int = 0, key: str = "row_id", name: str = "f") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (r, n), len(list_filter(range(1, {k}), lambda t: r > (t * n) // {k}))::INT AS fold
   FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || {key}), {key}) AS r,
                count(*) OVER (PARTITION BY label) AS n FROM {source}))"""


NB_ROWS = "nx AS (SELECT row_id, label, e FROM x)"


def naive_bayes_parts(smoothing=(1e-9,)) -> list[str]:
    """Out-of-fold predictions ``pr`` and joint log likelihoods ``j`` for the rows of ``nx``."""
    grid = ", ".join(f"({s!r}::DOUBLE)" for s in smoothing)
    return [
        "nl AS (SELECT row_id, label, unnest(generate_series(0, len(e)-1))::INT AS dim, unnest(e) AS v FROM nx)",
        folds("nx"),
        f"g(reg) AS (VALUES {grid})",
        "o AS (SELECT unnest(range(5)) AS outer_fold)",
        """t AS (SELECT o.outer_fold, nl.label, nl.dim, avg(v) AS m, var_pop(v) AS s2, count(*) AS n
               FROM nl JOIN f USING (row_id) JOIN o ON f.fold <> o.outer_fold GROUP BY ALL)""",
        """wide AS (SELECT outer_fold, max(s2) AS top FROM (SELECT o.outer_fold, nl.dim, var_pop(v) AS s2
               FROM nl JOIN f USING (row_id) JOIN o ON f.fold <> o.outer_fold GROUP BY ALL) GROUP BY ALL)""",
        """n AS (SELECT outer_fold, label, max(n) AS n, sum(max(n)) OVER (PARTITION BY outer_fold) AS total
               FROM t GROUP BY outer_fold, label)""",
        """j AS (SELECT nl.row_id, f.fold, g.reg, f.label, t.label AS class,
               any_value(ln(n.n / n.total)) - 0.5 * sum(ln(2 * pi() * (t.s2 + g.reg * wide.top))
                 + (nl.v - t.m) * (nl.v - t.m) / (t.s2 + g.reg * wide.top)) AS joint
               FROM nl JOIN f USING (row_id) JOIN t ON t.outer_fold = f.fold AND t.dim = nl.dim
               JOIN wide ON wide.outer_fold = f.fold JOIN n ON n.outer_fold = f.fold AND n.label = t.label
               CROSS JOIN g GROUP BY ALL)""",
        "pr AS (SELECT row_id, fold, reg, label, arg_max(class, joint) AS pred FROM j GROUP BY ALL)",
    ]


def naive_bayes(smoothing=(1e-9,)) -> str:
    return with_(X, NB_ROWS, *naive_bayes_parts(smoothing))


ACCURACY = "round_even(100 * avg((label = pred)::INT), 2)"
F1 = """cf AS (SELECT fold, label, pred, count(*) AS n FROM pr GROUP BY ALL),
tr AS (SELECT fold, label, sum(n) AS support, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS tp FROM cf GROUP BY ALL),
gs AS (SELECT fold, pred AS label, sum(n) AS guessed FROM cf GROUP BY ALL),
f1 AS (SELECT fold, round_even(100 * sum(support * (2.0 * tp / (support + coalesce(guessed, 0)))) / sum(support), 0)
         AS f1_weighted FROM tr LEFT JOIN gs USING (fold, label) GROUP BY fold)"""


AUC = """rk AS (SELECT fold, class, label = class AS hit, rank() OVER (PARTITION BY fold, class ORDER BY joint)
     + (count(*) OVER (PARTITION BY fold, class, joint) - 1) / 2.0 AS r FROM j),
au AS (SELECT fold, class, count_if(hit)::DOUBLE AS p, count_if(NOT hit)::DOUBLE AS n, sum(r) FILTER (hit) AS sr
     FROM rk GROUP BY ALL),
ra AS (SELECT fold, 100 * sum(p * ((sr - p * (p + 1) / 2) / (p * n))) / sum(p) AS rocauc_weighted
     FROM au WHERE p > 0 AND n > 0 GROUP BY fold)"""


def classification(before: list[str], rows: str, method: str, shape: str) -> str:
    """Report of naive Bayes on ``rows``; ``shape`` is the covariance as ``(i, j, v)`` rows."""
    return with_(
        *before,
        rows,
        *naive_bayes_parts(),
        F1,
        AUC,
        f"""fg AS (SELECT fold, 'accuracy' AS metric, {ACCURACY} AS value FROM pr GROUP BY fold
            UNION ALL SELECT fold, 'f1_weighted', f1_weighted FROM f1
            UNION ALL SELECT fold, 'rocauc_weighted', rocauc_weighted FROM ra)""",
        recursive=True,
    ) + f"""SELECT '{method}' AS whitening, metric, fold, {r6('value')} AS value FROM fg
      UNION ALL SELECT '{method}', metric, NULL, round_even(avg(value), 2) FROM fg GROUP BY metric
      UNION ALL SELECT '{method}', 'isoscore', NULL, {r6('((t * t) / q - 1) / (d - 1)')} FROM (
        SELECT sum(CASE WHEN i = j THEN v END) AS t, sum(v * v) AS q, max(i) + 1 AS d FROM {shape})"""


# ------------------------------------------------------------------ pooling and encoding

TOKENS = r"""tk AS (SELECT row_id, unnest(generate_series(0, len(ts)-1))::INT AS token_pos, unnest(ts) AS token FROM
   (SELECT doc_id AS row_id, string_split_regex(t, '[ \t\r\n]+') AS ts FROM
      (SELECT doc_id, regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents) WHERE t <> ''))"""
STATES = """h AS (SELECT row_id, layer, token_pos, length(token) > 2 AS attended, dim,
   sqrt(((bits >> (7 * dim)) & 127)::DOUBLE + 1) / 6 - 1 AS v
   FROM (SELECT row_id, layer, token_pos, token,
           ('0x' || substr(md5(layer || ':' || token), 1, 15))::BIGINT AS bits FROM tk, (SELECT unnest(range(4)) AS layer)),
        (SELECT unnest(range(8))::INT AS dim))"""


def pooled(where: str, value: str = "avg(v)") -> str:
    return with_(TOKENS, STATES) + f"SELECT row_id, dim, {r6(value)} AS value FROM h WHERE {where} GROUP BY row_id, dim"


HASHED = with_(
    r"""ts AS (SELECT doc_id AS row_id, CASE WHEN t = '' THEN [] ELSE string_split_regex(t, '[ \t\r\n]+') END AS ts FROM
      (SELECT doc_id, regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents))""",
    """gr AS (SELECT row_id, md5(unnest(list_concat(ts,
          list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])))) AS h FROM ts)""",
    """ce AS (SELECT row_id, (('0x' || substr(h, 1, 8))::BIGINT % 32)::INT AS dim,
          sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS c FROM gr GROUP BY ALL)""",
    "no AS (SELECT row_id, sqrt(sum(c * c)) AS norm FROM ce GROUP BY ALL)",
) + f"""SELECT ts.row_id, k.dim, {r6('CASE WHEN norm > 0 THEN coalesce(c, 0) / norm ELSE 0e0 END')} AS value
FROM ts CROSS JOIN (SELECT unnest(range(32))::INT AS dim) k LEFT JOIN ce ON ce.row_id = ts.row_id AND ce.dim = k.dim
LEFT JOIN no ON no.row_id = ts.row_id"""


# ------------------------------------------------------------------ pair scores under whitening

METRIC_COS = """cs AS (
  SELECT pair_id, score, unnest(ms) AS whitening, xy / sqrt(xx * yy) AS cos_sim FROM (
    SELECT pair_id, score, ms, list_inner_product(list_transform(a, lambda r: list_inner_product(r, u)), v) AS xy,
           list_inner_product(list_transform(a, lambda r: list_inner_product(r, u)), u) AS xx,
           list_inner_product(list_transform(a, lambda r: list_inner_product(r, v)), v) AS yy
    FROM (SELECT pair_id, score, ['pca', 'zca', 'cholesky'] AS ms, iv.a,
                 list_transform(list_zip(e1, m), lambda t: t[1] - t[2]) AS u,
                 list_transform(list_zip(e2, m), lambda t: t[1] - t[2]) AS v FROM p, ml, iv
          UNION ALL
          SELECT pair_id, score, ['pca-cor', 'zca-cor'], ivc.a,
                 list_transform(list_zip(e1, m, s), lambda t: (t[1] - t[2]) / t[3]),
                 list_transform(list_zip(e2, m, s), lambda t: (t[1] - t[2]) / t[3]) FROM p, ml, ivc))
  UNION ALL
  SELECT pair_id, score, 'none', list_cosine_similarity(e1, e2) FROM p)"""
WHITENED_PAIRS = with_(
    X,
    LONG,
    PAIRS,
    COV,
    listed("ridge", "cv", "1e-5"),
    inverse_root("ir", "ridge"),
    listed("ridgec", "cc", "1e-5"),
    inverse_root("irc", "ridgec"),
    f"iv AS (SELECT {product('a', 'a')} AS a FROM ir)",
    f"ivc AS (SELECT {product('a', 'a')} AS a FROM irc)",
    METRIC_COS,
    recursive=True,
)
STS = WHITENED_PAIRS + f"""SELECT whitening, metric, {r6('value')} AS value FROM (
  SELECT whitening, unnest(['pearson', 'spearman', 'anisotropy']) AS metric,
         unnest([100 * corr(cos_sim, score), 100 * corr(ra, rb), avg(cos_sim)]) AS value
  FROM (SELECT *, rank() OVER (PARTITION BY whitening ORDER BY cos_sim)
                   + (count(*) OVER (PARTITION BY whitening, cos_sim) - 1) / 2.0 AS ra,
               rank() OVER (PARTITION BY whitening ORDER BY score)
                   + (count(*) OVER (PARTITION BY whitening, score) - 1) / 2.0 AS rb FROM cs) GROUP BY whitening)"""


def lloyd(k: int, iterations: int, seed: int = 0) -> str:
    parts = [
        X,
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, row_id) - 1 AS c, e FROM
          (SELECT row_id, e, md5('{seed}:' || row_id) AS h FROM x ORDER BY h, row_id LIMIT {k}))""",
    ]
    for step in range(1, iterations + 1):
        parts.append(
            f"""a{step} AS (SELECT row_id, any_value(x.e) AS e, arg_min(c, list_distance(x.e, c{step-1}.e)) AS c
              FROM x, c{step-1} GROUP BY row_id)"""
        )
        parts.append(
            f"""c{step} AS (SELECT c, coalesce(n.e, o.e) AS e FROM c{step-1} o LEFT JOIN (
              SELECT c, list(v ORDER BY dim) AS e FROM (SELECT c, dim, avg(v) AS v FROM
                (SELECT c, unnest(generate_series(0, len(e)-1)) AS dim, unnest(e) AS v FROM a{step}) GROUP BY c, dim)
              GROUP BY c) n USING (c))"""
        )
    return with_(*parts) + f"""SELECT row_id, arg_min(c, list_distance(x.e, c{iterations}.e))::INT AS cluster
FROM x, c{iterations} GROUP BY row_id"""



def leading_axes(matrix: str, count: int) -> str:
    """``ax(axes, lams)``: the first eigenvectors and eigenvalues of a symmetric matrix.

    Squaring the matrix again and again leaves its leading axis; the next follows after deflation.
    """
    diagonal = "list_transform({}, lambda r, i: r[i])".format
    return f"""sq AS (SELECT 0 AS k, 1 AS axis, a AS c, a AS q, []::DOUBLE[][] AS axes, []::DOUBLE[] AS lams FROM {matrix}
       UNION ALL
       SELECT CASE WHEN k = 30 THEN 0 ELSE k + 1 END, CASE WHEN k = 30 THEN axis + 1 ELSE axis END,
              CASE WHEN k = 30 THEN left_over ELSE c END, CASE WHEN k = 30 THEN left_over ELSE squared END,
              CASE WHEN k = 30 THEN list_append(axes, u) ELSE axes END,
              CASE WHEN k = 30 THEN list_append(lams, lam) ELSE lams END
       FROM (SELECT *, list_transform(c, lambda r, i: list_transform(r, lambda v, j: v - lam * u[i] * u[j])) AS left_over
             FROM (SELECT *, list_inner_product(list_transform(c, lambda r: list_inner_product(r, u)), u) AS lam
                   FROM (SELECT *, list_transform(col, lambda v: v / sqrt(list_inner_product(col, col))) AS u,
                                list_transform(qq, lambda r: list_transform(r, lambda v: v / tr)) AS squared
                         FROM (SELECT *, list_sum({diagonal('qq')}) AS tr,
                                      q[list_position({diagonal('q')}, list_max({diagonal('q')}))] AS col
                               FROM (SELECT *, {product('q', 'q')} AS qq FROM sq WHERE axis <= {count})))))),
    ax AS (SELECT axes, lams FROM sq WHERE axis = {count} + 1)"""


PCA = with_(
    X,
    LONG,
    COV,
    listed("cm", "cv"),
    leading_axes("cm", 2),
    """sg AS (SELECT list_transform(axes, lambda u: list_transform(u, lambda v:
          v * sign(u[list_position(list_transform(u, lambda w: abs(w)), list_max(list_transform(u, lambda w: abs(w))))]))) AS u FROM ax)""",
    recursive=True,
) + f"""SELECT row_id, {r6('list_inner_product(c, u[1])')} AS x, {r6('list_inner_product(c, u[2])')} AS y
FROM (SELECT row_id, list_transform(list_zip(e, m), lambda t: t[1] - t[2]) AS c FROM x, ml), sg"""


def principal_whitening(source: str, scaled: bool, width: int = 64) -> list[str]:
    """Rows on all axes over the root of the eigenvalue; an axis has a diagonal entry >= 0."""
    return [
        X,
        LONG,
        COV,
        listed("cm", source),
        leading_axes("cm", width),
        """pw AS (SELECT list_transform(axes, lambda u, j: list_transform(u, lambda v:
              v * CASE WHEN u[j] < 0 THEN -1 ELSE 1 END / sqrt(lams[j] + 1e-5))) AS a FROM ax)""",
        sphered("pw", scaled),
    ]


def symmetric_whitening(source: str, scaled: bool) -> list[str]:
    return [X, LONG, COV, listed("ridge", source, "1e-5"), inverse_root("ir", "ridge"), sphered("ir", scaled)]


CHOLESKY = [
    X,
    LONG,
    COV,
    listed("ridge", "cv", "1e-5"),
    inverse_root("ir", "ridge"),
    f"iv AS (SELECT {product('a', 'a')} AS a FROM ir)",
    """ch AS (SELECT 1 AS k, a AS left_over, []::DOUBLE[][] AS cols FROM iv
       UNION ALL
       SELECT k + 1, list_transform(left_over, lambda r, i: list_transform(r, lambda v, j: v - col[i] * col[j])),
              list_append(cols, col)
       FROM (SELECT *, list_transform(left_over[k], lambda v, i:
                CASE WHEN i < k THEN 0.0 ELSE v / sqrt(left_over[k][k]) END) AS col
             FROM ch WHERE k <= len(left_over)))""",
    "lo AS (SELECT cols AS a FROM ch WHERE k = len(left_over) + 1)",
    sphered("lo", False),
]
WHITENED = {
    "pca": principal_whitening("cv", False),
    "zca": symmetric_whitening("cv", False),
    "pca_cor": principal_whitening("cc", True),
    "zca_cor": symmetric_whitening("cc", True),
    "cholesky": CHOLESKY,
}


def whitened_shape(z: str = "w") -> str:
    """Covariance of the whitened rows as ``(i, j, v)``."""
    return f"""wl AS (SELECT row_id, unnest(generate_series(0, len(z)-1))::INT AS dim, unnest(z) AS v FROM {z}),
wc AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS v FROM wl a JOIN wl b USING (row_id) GROUP BY ALL)"""


def sql() -> dict[str, str]:
    base = with_(X, LONG)
    pairs = with_(X, PAIRS)
    moments = with_(X, LONG, COV)
    bayes = naive_bayes()
    out = {
        "src_dataset": with_(DOCS) + "SELECT 'docs' AS dataset, split, row_id, md5(text) AS text_md5, label FROM d",
        "src_embeddings": with_(X) + f"""SELECT row_id, label, len(e)::INT AS width, {r6('list_sum(e)')} AS total,
            {r6('sqrt(list_inner_product(e, e))')} AS norm FROM x""",
        "src_union_splits": with_(DOCS) + """SELECT split, label, count(*) AS n, sum(length(text))::BIGINT AS chars
            FROM d GROUP BY ALL""",
        "sts_pairs": pairs + f"""SELECT pair_id, unnest(generate_series(0, len(e1)-1))::INT AS dim,
            {r6('unnest(e1)')} AS v1, {r6('unnest(e2)')} AS v2 FROM p""",
        "pair_labels": pairs + """SELECT pair_id, CASE WHEN substr(md5(pair_id::VARCHAR), 32, 1) IN ('0','1','2')
            THEN 'test' ELSE 'train' END AS split, label FROM p""",
        "sts_scores": pairs + f"""SELECT pair_id, {r6('list_cosine_similarity(e1, e2)')} AS cos_sim,
            {r6('score')} AS score FROM p""",
        "contract": with_(DOCS) + "SELECT row_id, md5(text) AS text_md5, label FROM d",
        "assemble": base + f"SELECT row_id, label, dim, {r6('v')} AS value FROM l",
        "class_count": """SELECT 'vectors' AS dataset, count(DISTINCT label) AS n_classes FROM embeddings
            UNION ALL SELECT 'docs', count(DISTINCT quality) FROM documents JOIN labels USING (doc_id)""",
        "text_clean": """WITH tx AS (
            SELECT b.text FROM conversations a LEFT JOIN conversations b
              ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'
            UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents),
          cl AS (SELECT unnest(['keep', 'blank_to_space', 'null_to_blank', 'null_to_space']) AS rule,
            unnest([text, CASE WHEN text = '' THEN ' ' ELSE text END, coalesce(text, ''), coalesce(text, ' ')]) AS t FROM tx)
          SELECT rule, count(*) AS n, count(*) - count(t) AS n_null, count_if(t = '')::BIGINT AS n_blank,
            count_if(t = ' ')::BIGINT AS n_space, sum(length(t))::BIGINT AS chars FROM cl GROUP BY rule""",
        "prompt": """SELECT doc_id AS row_id, md5('Sentence: "' || text || '" means in one word:') AS prompt_md5
            FROM documents""",
        "cosine": pairs + f"SELECT pair_id, {r6('list_cosine_similarity(e1, e2)')} AS cos_sim FROM p",
        "pairwise_l2": pairs + f"SELECT pair_id, {r6('list_distance(e1, e2)')} AS distance FROM p",
        "pair_features": pairs + f"""SELECT pair_id, label, unnest(generate_series(0, len(v)-1))::INT AS dim,
            {r6('unnest(v)')} AS value FROM (SELECT pair_id, label, list_concat(
              list_transform(list_zip(e1, e2), lambda t: abs(t[1] - t[2])),
              list_transform(list_zip(e1, e2), lambda t: t[1] * t[2])) AS v FROM p)""",
        "pair_integrity": """SELECT count(d.doc_id) AS side_1, count(l.doc_id) AS side_2,
            count_if(d.doc_id IS NULL OR l.doc_id IS NULL)::BIGINT AS unmatched
            FROM documents d FULL JOIN labels l USING (doc_id)""",
        "center": moments + f"SELECT row_id, dim, {r6('v - m')} AS value FROM l JOIN mu USING (dim)",
        "dim_mean": moments + f"SELECT dim, {r6('m')} AS value FROM mu",
        "dim_std": moments + f"SELECT dim, {r6('s')} AS value FROM mu",
        "cov": moments + f"SELECT i, j, {r6('v', 8)} AS value FROM cv",
        "cor_matrix": moments + f"SELECT i, j, {r6('v')} AS value FROM cc",
        "isoscore": moments + f"""SELECT {r6('((t * t) / f - 1) / (d - 1)')} AS isoscore FROM (
            SELECT sum(CASE WHEN i = j THEN v END) AS t, sum(v * v) AS f, max(i) + 1 AS d FROM cv)""",
        "anisotropy": pairs + f"SELECT {r6('avg(list_cosine_similarity(e1, e2))')} AS anisotropy FROM p",
        "pearson": pairs + f"SELECT {r6('corr(list_cosine_similarity(e1, e2), score)')} AS pearson FROM p",
        "spearman": pairs + f"""SELECT {r6('corr(ra, rb)')} AS spearman FROM (
            SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS ra,
                   rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rb
            FROM (SELECT list_cosine_similarity(e1, e2) AS c, score FROM p))""",
        "eval_sts": STS,
        "sts_whitened": WHITENED_PAIRS + f"SELECT pair_id, whitening, {r6('cos_sim')} AS cos_sim FROM cs WHERE whitening <> 'none'",
        "dewhiten": base + f"""SELECT whitening, row_id, dim, {r6('v')} AS value
            FROM l, (SELECT unnest(['pca', 'zca', 'pca_cor', 'zca_cor']) AS whitening)""",
        "src_dataset_all": with_(ALL_DOCS) + "SELECT 'docs' AS dataset, split, row_id, md5(text) AS text_md5, label FROM d",
        "src_union_splits_all": with_(ALL_DOCS) + """SELECT split, label, count(*) AS n, sum(length(text))::BIGINT AS chars
            FROM d GROUP BY ALL""",
        "contract_all": with_(ALL_DOCS) + "SELECT row_id, md5(text) AS text_md5, label FROM d",
        "pca2d": PCA,
        "standardize": moments + f"SELECT row_id, dim, {r6('(v - m) / s')} AS value FROM l JOIN mu USING (dim)",
        "truncate": with_(TOKENS) + """SELECT row_id, count(*) AS n_tokens, sum(length(token))::BIGINT AS chars,
            arg_max(token, token_pos) AS last_token FROM tk WHERE token_pos < 64 GROUP BY row_id""",
        "pool_mean": pooled("layer = 3"),
        "pool_masked": pooled("layer = 3 AND attended"),
        "pool_layer": pooled("layer = 2"),
        "pool_range": pooled("layer > 3 - 2"),
        "pool_pair": pooled("layer IN (0, 3)", "avg(v) FILTER (layer = 0) + avg(v) FILTER (layer = 3)"),
        "pool_last": pooled("layer = 3", "arg_max(v, token_pos)"),
        "encode_hash": HASHED,
        "encode_job": HASHED,
        "stratified_folds": with_(X, folds("x")) + "SELECT row_id, label, fold FROM f",
        "holdout": """SELECT doc_id AS row_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id)
            <= floor(count(*) OVER () * 0.05::DOUBLE) AS dev FROM documents""",
        "nested_folds": with_(
            X, folds("x"),
            "fx AS (SELECT row_id, f.fold AS outer_of, label, unnest(range(5))::INT AS held_out FROM f)",
            """n AS (SELECT *, row_number() OVER (PARTITION BY held_out, label ORDER BY md5('1:' || row_id), row_id) AS r,
                 count(*) OVER (PARTITION BY held_out, label) AS n FROM fx WHERE outer_of <> held_out)""",
        ) + """SELECT row_id, outer_of AS fold, held_out,
            len(list_filter(range(1, 5), lambda t: r > (t * n) // 5))::INT AS inner_fold FROM n""",
        "clf_nb": bayes + "SELECT row_id, fold, label, pred FROM pr",
        "accuracy": bayes + f"SELECT fold, {ACCURACY} AS accuracy FROM pr GROUP BY fold",
        "confusion": bayes + "SELECT label, pred, count(*) AS n FROM pr GROUP BY ALL",
        "f1_weighted": bayes + f", {F1} SELECT fold, f1_weighted FROM f1",
        "rocauc_weighted": bayes + f", {AUC} SELECT fold, {r6('rocauc_weighted')} AS rocauc_weighted FROM ra",
        "fold_summary": bayes + f""", {F1}, ac AS (SELECT fold, {ACCURACY} AS accuracy FROM pr GROUP BY fold)
            SELECT 'accuracy' AS metric, round_even(avg(accuracy), 2) AS value FROM ac
            UNION ALL SELECT 'f1_weighted', round_even(avg(f1_weighted), 2) FROM f1""",
        "best_reg": naive_bayes((1e-3, 1e-2, 1e-1, 1.0)) + f""", ac AS (SELECT fold, reg, {ACCURACY} AS a FROM pr GROUP BY ALL),
            me AS (SELECT reg, round_even(avg(a), 2) AS m FROM ac GROUP BY reg)
            SELECT reg AS best_reg, m AS best_score FROM me ORDER BY m DESC, reg LIMIT 1""",
        "silhouette": with_(
            X,
            """ds AS (SELECT a.row_id, a.label AS own, b.label, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
                 FROM x a, x b GROUP BY ALL)""",
            """ab AS (SELECT row_id, own, max(s / nullif(n - 1, 0)) FILTER (label = own) AS a,
                 min(s / n) FILTER (label <> own) AS b FROM ds GROUP BY ALL)""",
        ) + f"SELECT row_id, own AS cluster, {r6('CASE WHEN a IS NULL THEN 0e0 ELSE (b - a) / greatest(a, b) END')} AS silhouette FROM ab",
        "kmeans_lloyd": lloyd(10, 3),
    }
    for method, parts in WHITENED.items():
        out[f"whiten_{method}"] = with_(*parts, recursive=True) + ENTRIES
    out["isoscore_whitened"] = " UNION ALL ".join(
        f"""SELECT * FROM ({with_(*parts, whitened_shape(), recursive=True)}
        SELECT '{method}' AS whitening, {r6('((t * t) / q - 1) / (d - 1)')} AS isoscore FROM (
          SELECT sum(CASE WHEN i = j THEN v END) AS t, sum(v * v) AS q, max(i) + 1 AS d FROM wc))"""
        for method, parts in WHITENED.items()
    )
    out["eval_classify_nb"] = classification([X, LONG, COV], NB_ROWS, "none", "cv")
    out["eval_classify_whitened"] = " UNION ALL ".join(
        f"""SELECT * FROM ({classification([*parts, whitened_shape()],
            "nx AS (SELECT row_id, label, z AS e FROM w JOIN x USING (row_id))", method, "wc")})"""
        for method, parts in WHITENED.items()
    )
    out["eval_classify_pairs"] = classification(
        [
            X,
            PAIRS,
            """pf AS (SELECT pair_id AS row_id, label, list_concat(
                list_transform(list_zip(e1, e2), lambda t: abs(t[1] - t[2])),
                list_transform(list_zip(e1, e2), lambda t: t[1] * t[2])) AS e FROM p)""",
            "pl AS (SELECT row_id, unnest(generate_series(0, len(e)-1))::INT AS dim, unnest(e) AS v FROM pf)",
            "pc AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS v FROM pl a JOIN pl b USING (row_id) GROUP BY ALL)",
        ],
        "nx AS (SELECT row_id, label, e FROM pf)",
        "none",
        "pc",
    )
    out["encode_classify"] = with_(
        f"hs AS ({HASHED})",
        """nx AS (SELECT row_id, any_value(l.quality) AS label, list(value ORDER BY dim) AS e
             FROM hs JOIN labels l ON l.doc_id = row_id GROUP BY row_id)""",
        *naive_bayes_parts(),
    ) + f"SELECT fold, {ACCURACY} AS accuracy FROM pr GROUP BY fold"
    return out
