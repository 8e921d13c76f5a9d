"""The results of the queries that SQL can express, for DuckDB."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({LOWER.format(f"coalesce({column}, '')")}, '{pattern}')"


SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _shingles(n: int) -> str:
    return f"""CASE WHEN len(w) >= {n}
      THEN list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""


OP1 = f"""WITH RECURSIVE
d AS (SELECT doc_id, {_words("text", SPACED)} AS w FROM documents),
g AS (SELECT doc_id, {_shingles(4)} AS s FROM d),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (n + m - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT l.y, r.seen FROM r JOIN l ON l.x = r.node)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, c.component_id
FROM g JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = g.doc_id"""

OP3 = f"""WITH
d AS (SELECT doc_id, {_words("text", ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
  lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM k),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2),
  lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS s
  FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.s.i AS i, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = dw.s.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

_DIGEST = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def op4(shards: list[str], slots: int) -> str:
    names = ", ".join(f"'{s}'" for s in sorted(shards))
    n = len(shards)
    return f"""WITH RECURSIVE
c AS (SELECT list_transform([{names}], lambda s: {_DIGEST.format("s || ':offset'")} % {slots}) AS o,
  list_transform([{names}], lambda s: {_DIGEST.format("s || ':skip'")} % {slots - 1} + 1) AS k),
t AS (SELECT 0 AS turn, list_transform(range({slots}), lambda x: -1::BIGINT) AS tab, o, k FROM c
  UNION ALL SELECT turn + 1, tab[1:p] || [(turn % {n})::BIGINT] || tab[p + 2:], o, k
  FROM (SELECT turn, tab, o, k, list_filter(list_transform(range({slots}),
      lambda j: (o[turn % {n} + 1] + j * k[turn % {n} + 1]) % {slots}), lambda x: tab[x + 1] = -1)[1] AS p
    FROM t WHERE turn < {slots})),
f AS (SELECT tab FROM t WHERE turn = {slots})
SELECT doc_id, slot::INT AS slot, ([{names}])[tab[slot + 1] + 1] AS shard
FROM (SELECT doc_id, {_DIGEST.format("coalesce(doc_id::VARCHAR, '')")} % {slots} AS slot FROM documents), f"""


def op5(assign: str, access: str, hexadecimal: str, loose: str, least: int, copied: int) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def found(kind, number, pattern, value, keep):
        return f"""SELECT doc_id, source, {number} AS o, '{kind}' AS kind, {value} AS value, e - length(m) AS s, e
          FROM (SELECT doc_id, source, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (SELECT doc_id, source, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i
              FROM (SELECT doc_id, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), {quoted(pattern)}) AS ms,
                  string_split_regex(coalesce(text, ''), {quoted(pattern)}) AS ps FROM documents)))
          WHERE {keep}"""

    group = f"regexp_extract(m, {quoted(assign)}, 2)"
    mixed = "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
    return f"""WITH
base AS ({found("assign", 0, assign, group, f"length({group}) >= {least}")}
  UNION ALL {found("access", 1, access, "m", "true")} UNION ALL {found("hex", 2, hexadecimal, "m", "true")}),
loose AS (SELECT * FROM ({found("owned", 3, loose, "m", mixed)}) l WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.s < l.e AND l.s < b.e)),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
held AS (SELECT value, count(DISTINCT source) AS owners FROM both_ GROUP BY 1),
judged AS (SELECT b.*, owners, kind || ':' || s || ':' || e AS said FROM both_ b JOIN held USING (value)),
per AS (SELECT doc_id, count_if(o = 0) AS n_assign, count_if(o = 1) AS n_access, count_if(o = 2) AS n_hex,
    string_agg(said, ',' ORDER BY s, o) FILTER (o < 3) AS base,
    string_agg(said, ',' ORDER BY s, o) FILTER (o < 3 OR owners = 1) AS spans,
    count_if(owners >= {copied}) AS n_copied, count_if(owners = 1) AS n_live FROM judged GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live
FROM documents LEFT JOIN per USING (doc_id)"""


OP7 = f"""WITH
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, {_words("line", SPACED)} AS w FROM l),
g AS (SELECT doc_id, i, line, list_sort({_shingles(5)}) AS s FROM w),
u AS (SELECT s, len(s) AS n, min((doc_id, i)) AS first FROM g WHERE len(s) > 0 GROUP BY s),
t AS (SELECT first, n, unnest(s) AS t FROM u),
p AS (SELECT a.first AS x, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM t a JOIN t b ON a.t = b.t AND b.first < a.first GROUP BY a.first, b.first),
gone AS (SELECT DISTINCT x FROM p WHERE 100 * c >= 80 * (n + m - c)),
k AS (SELECT g.doc_id, g.i, g.line, len(g.s) = 0 OR (u.first = (g.doc_id, g.i) AND gone.x IS NULL) AS keep
  FROM g LEFT JOIN u ON u.s = g.s LEFT JOIN gone ON gone.x = u.first),
r AS (SELECT doc_id, count(*) AS n_lines, count_if(NOT keep) AS n_removed,
  string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)"""


OP11 = rf"""WITH own AS (
  SELECT coalesce(lang, 'und') AS lang,
         {LOWER.format("coalesce(text, '')")} AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM own
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang
), sizes AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS m
), grams AS (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, sizes WHERE len(w) >= m
), f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 100
), parts AS (
  SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f
), inner_ AS (
  SELECT DISTINCT lang, f, array_to_string(w[a : b], ' ') AS phrase
  FROM (SELECT lang, m, f, w, a, unnest(range(a + 1, m + 1)) AS b
        FROM (SELECT lang, m, f, w, unnest(range(1, m)) AS a FROM parts WHERE m >= 3))
  WHERE b - a + 1 < m
), cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, k, array_to_string(w[1 : k], ' ') AS first_, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT lang, m, phrase, f, w, unnest(range(1, m)) AS k FROM parts WHERE m >= 2) p
  ANTI JOIN inner_ i ON p.lang = i.lang AND p.phrase = i.phrase AND p.f = i.f
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000"""
