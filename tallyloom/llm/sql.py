"""DuckDB SQL for the rows of those queries that SQL can express."""

_GAP = r"'[ \t\n\x0B\f\r]+'"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_GAP}), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
either AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM words UNION SELECT either.v, reach.c FROM reach JOIN either ON either.u = reach.d),
least AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT d AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d = c AS kept
FROM least LEFT JOIN sizes ON sizes.doc_id = d
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS m FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN m IS NULL OR m IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM f
"""

URL_FILTER = r"""
WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS u FROM pages),
h AS (SELECT page_id, regexp_extract(u, '^[^/?#]*') AS a, u FROM s),
p AS (
  SELECT page_id, translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u[length(a) + 1:], '^[^?#]*') AS path FROM h),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(rules.p) DESC) AS k, h || rules.p AS rule, verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND k = 1
"""

_LOWER = f"list_filter(regexp_split_to_array(lower(text), {_GAP}), lambda x: x <> '')"
_SHINGLES = """unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s"""

DECONTAMINATION = f"""
WITH d AS (SELECT DISTINCT doc_id, {_SHINGLES} FROM (SELECT doc_id, {_LOWER} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
i AS (SELECT DISTINCT item_id, {_SHINGLES} FROM (SELECT item_id, {_LOWER} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""


def _centroids(clusters: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """Exact k-means: every distance of each round."""
    parts = [
        f"""e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(x, lambda y: floor(256 * y)::BIGINT) AS v FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM v ORDER BY sha256('2:' || vec_id), v LIMIT {clusters})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT rid, min(d * {clusters} + k) AS x FROM (SELECT rid, k, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid),
a{r} AS MATERIALIZED (SELECT rid, x % {clusters} AS k, x // {clusters} AS d FROM d{r})""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT k, i, sum(v.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (rid), range(1, {dimensions + 1}) t(i) GROUP BY k, i),
m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} a JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.k"""


CENTROIDS = _centroids()

# every run of up to five words of every piece, counted
COLLOCATIONS = r"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(p) AS piece FROM t)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
cut AS (SELECT lang, k, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM often, range(1, 5) r(c) WHERE k > c),
scored AS (SELECT cut.*, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f * y.f) AS score FROM cut JOIN often x ON x.lang = cut.lang AND x.phrase = cut.x JOIN often y ON y.lang = cut.lang AND y.phrase = cut.y JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sub AS (SELECT lang, f, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM often, range(2, 5) s(z), range(1, 5) r(i) WHERE z < k AND i + z - 1 <= k),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.lang = b.lang AND s.phrase = b.phrase AND s.f >= b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""
