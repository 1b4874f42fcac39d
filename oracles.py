"""DuckDB statements that give the same result as the queries of the entry module."""

from __future__ import annotations

from coterie.sources.catalog import PREFER_WORDS, SKIP_WORDS

X = """x AS (SELECT vec_id AS sample_id, label AS y,
  CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS gene,
  unnest(CAST(embedding AS DOUBLE[])) AS value FROM embeddings)"""
GAP = X + """, gap AS (SELECT sample_id, y, gene, CASE WHEN abs(value) >= 0.01 THEN value END AS value FROM x)"""
E3 = """e3 AS (SELECT l_returnflag AS dataset, l_suppkey AS sample_id, p_type || '_' || p_size AS gene,
  l_extendedprice AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
d3 AS (SELECT dataset, sample_id, gene, avg(value) AS value FROM e3 GROUP BY ALL)"""
FINE = """f3 AS (SELECT l_returnflag AS dataset, l_suppkey AS sample_id, p_brand || '_' || p_type || '_' || p_size AS gene,
  avg(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
QC = E3 + """, ng AS (SELECT dataset, count(DISTINCT gene) AS g FROM d3 GROUP BY 1),
ks AS (SELECT dataset, sample_id FROM d3 JOIN ng USING (dataset) GROUP BY dataset, sample_id, g
  HAVING 1 - count(value) / g <= 0.5),
k3 AS (SELECT d3.* FROM d3 SEMI JOIN ks USING (dataset, sample_id)),
ns AS (SELECT dataset, count(*) AS n FROM ks GROUP BY 1),
kg AS (SELECT dataset, gene FROM k3 JOIN ns USING (dataset) GROUP BY dataset, gene, n
  HAVING 1 - count(value) / n <= 0.8 AND stddev_samp(value) > 0),
q3 AS (SELECT k3.* FROM k3 SEMI JOIN kg USING (dataset, gene))"""


def scored(source: str) -> str:
    return f"""z3 AS (SELECT dataset, sample_id, gene, (value - avg(value) OVER w)
  / CASE WHEN stddev_samp(value) OVER w = 0 THEN 1 ELSE stddev_samp(value) OVER w END AS value
  FROM {source} WINDOW w AS (PARTITION BY dataset, gene))"""


PLANTED = """pl AS (SELECT vec_id AS sample_id, label % 3 AS y, CAST(k AS INTEGER) AS cluster FROM embeddings
  JOIN (SELECT label % 3 AS m, row_number() OVER (ORDER BY min(vec_id)) - 1 AS k FROM embeddings GROUP BY 1) ON m = label % 3)"""
LOADED = QC + ", " + scored("q3") + """,
shared AS (SELECT gene FROM z3 GROUP BY gene HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM z3)),
l3 AS (SELECT z3.* FROM z3 SEMI JOIN shared USING (gene))"""
LAB = """lab AS (SELECT CAST(r AS INTEGER) AS run, vec_id AS sample_id,
  CAST(list_position(embedding[3*r+1:3*r+3], list_max(embedding[3*r+1:3*r+3])) - 1 AS INTEGER) AS cluster
  FROM embeddings, range(3) t(r))"""
LAB1 = """lab AS (SELECT 0 AS run, vec_id AS sample_id,
  CAST(list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS INTEGER) AS cluster FROM embeddings)"""
KLAB = """lab AS (SELECT CAST(k AS INTEGER) AS run, vec_id AS sample_id,
  CAST(list_position(embedding[1:k], list_max(embedding[1:k])) - 1 AS INTEGER) AS cluster
  FROM embeddings, range(2, 5) t(k))"""
PAIRS = """pr AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt(sum((a.value - b.value) ^ 2)) AS d
  FROM x a JOIN x b USING (gene) GROUP BY 1, 2)"""
SIL = PAIRS + """, sz AS (SELECT run, cluster, count(*) AS n FROM lab GROUP BY ALL),
ms AS (SELECT la.run, i AS sample_id, la.cluster AS own, lb.cluster AS c, sum(d) AS s
  FROM pr JOIN lab la ON la.sample_id = i JOIN lab lb ON lb.sample_id = j AND lb.run = la.run GROUP BY ALL),
ab AS (SELECT ms.run, sample_id, own AS cluster, max(CASE WHEN own = c THEN n END) AS n,
  max(CASE WHEN own = c THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b
  FROM ms JOIN sz ON sz.run = ms.run AND sz.cluster = c GROUP BY ALL),
sil AS (SELECT run, sample_id, cluster,
  CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""
SQSIL = SIL.replace("sqrt(sum((a.value - b.value) ^ 2)) AS d", "sum((a.value - b.value) ^ 2) AS d")
DB = """cen AS (SELECT run, cluster, gene, avg(value) AS c FROM x JOIN lab USING (sample_id) GROUP BY ALL),
sp AS (SELECT run, cluster, avg(d) AS s FROM (SELECT lab.run, lab.cluster, x.sample_id, sqrt(sum((value - c) ^ 2)) AS d
  FROM x JOIN lab USING (sample_id) JOIN cen ON cen.run = lab.run AND cen.cluster = lab.cluster AND cen.gene = x.gene
  GROUP BY ALL) GROUP BY ALL),
gp AS (SELECT a.run, a.cluster AS ca, b.cluster AS cb, sqrt(sum((a.c - b.c) ^ 2)) AS d FROM cen a
  JOIN cen b ON a.run = b.run AND a.gene = b.gene AND a.cluster <> b.cluster GROUP BY ALL),
db AS (SELECT run, avg(r) AS davies_bouldin FROM (SELECT gp.run, ca, max((p.s + q.s) / d) AS r FROM gp
  JOIN sp p ON p.run = gp.run AND p.cluster = ca JOIN sp q ON q.run = gp.run AND q.cluster = cb GROUP BY ALL) GROUP BY ALL)"""
ARI = """ct AS (SELECT run, label AS y, cluster, count(*)::DOUBLE AS n FROM lab JOIN embeddings ON sample_id = vec_id GROUP BY ALL),
pa AS (SELECT run, sum(n * (n - 1) / 2) AS p, sum(n) AS t FROM ct GROUP BY run),
py AS (SELECT run, sum(n * (n - 1) / 2) AS a FROM (SELECT run, y, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY run),
pc AS (SELECT run, sum(n * (n - 1) / 2) AS b FROM (SELECT run, cluster, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY run),
ari AS (SELECT run, (p - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)) AS ari
  FROM pa JOIN py USING (run) JOIN pc USING (run))"""
NEAR = """sq AS (SELECT a.sample_id AS i, b.sample_id AS j, sum((a.value - b.value) ^ 2) AS d2
  FROM x a JOIN x b USING (gene) WHERE a.sample_id <> b.sample_id GROUP BY 1, 2),
nn AS (SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM sq)"""
SIG = LAB + """, sg AS (SELECT sample_id, list(cluster ORDER BY run) AS l,
  string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY run) AS sig FROM lab GROUP BY 1),
ss AS (SELECT sig, l, count(*) AS n FROM sg GROUP BY ALL),
co AS (SELECT a.sig AS sig_i, b.sig AS sig_j, a.n AS n_i, b.n AS n_j,
  list_sum(list_transform(generate_series(1, 3), lambda r: CASE WHEN a.l[r] = b.l[r] THEN 1 ELSE 0 END)) / 3 AS co
  FROM ss a, ss b)"""
FCM1 = X + """, c0 AS (SELECT y % 3 AS c, gene, avg(value) AS v FROM x GROUP BY 1, 2),
d0 AS (SELECT sample_id, c, sum((value - v) ^ 2) AS d2 FROM x JOIN c0 USING (gene) GROUP BY 1, 2),
u0 AS (SELECT sample_id, c, (1 / d2) / sum(1 / d2) OVER (PARTITION BY sample_id) AS u FROM d0)"""
FCM2 = FCM1 + """, c1 AS (SELECT c, gene, sum(u * u * value) / sum(u * u) AS v FROM u0 JOIN x USING (sample_id) GROUP BY 1, 2),
d1 AS (SELECT sample_id, c, sum((value - v) ^ 2) AS d2 FROM x JOIN c1 USING (gene) GROUP BY 1, 2),
u1 AS (SELECT sample_id, c, (1 / d2) / sum(1 / d2) OVER (PARTITION BY sample_id) AS u FROM d1)"""
SPLIT = """sp AS (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY md5(vec_id || ':42'))
  <= ceil(0.3 * count(*) OVER ()) AS is_test FROM embeddings)"""
PROBES = """SELECT l_returnflag AS dataset, l_suppkey AS sample_id, l_partkey,
  'ENSG' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS ens, CAST(l_partkey AS VARCHAR) AS probe,
  l_extendedprice AS value FROM lineitem"""
MIXED = """m AS (SELECT l_returnflag AS dataset, l_suppkey AS sample_id, l_extendedprice AS value,
  l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'A' OR l_partkey % 3 = 0
    THEN 'ENSG' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') ELSE 'AFFX-' || l_partkey END AS gene FROM lineitem)"""
ORDER_LABELS = """c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS label,
  CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS y
  FROM orders GROUP BY 1, 2)"""
CODES = """codes AS (SELECT dataset, s_suppkey AS sample_id, s_nationkey AS y,
  CAST(s_nationkey + place * (SELECT max(s_nationkey) + 1 FROM supplier) AS INTEGER) AS shifted
  FROM supplier, (VALUES ('A', 0), ('N', 1), ('R', 2)) t(dataset, place))"""
ITEMS = """it AS (SELECT l_partkey AS key, l_orderkey * 16 + l_linenumber AS ord, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1, 2)"""
RANKS = LAB1 + """, rk AS (SELECT sample_id, cluster,
  row_number() OVER (ORDER BY cluster, md5(CAST(sample_id AS VARCHAR))) - 1 AS rank FROM lab)"""
WORDS = """e AS (SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b,
  CASE WHEN event_type <> 'error' THEN value END AS c FROM events)"""
PREFIX = "'ftp://ftp.ncbi.nlm.nih.gov/geo/' || string_split(url, '/')[4] || '/'"
HTTPS = "'https://ftp.ncbi.nlm.nih.gov/geo/' || string_split(url, '/')[4] || '/'"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def imputed(source: str) -> str:
    """Fills the NULLs of (sample_id, gene, value) from the five nearest samples."""
    return f"""pd AS (SELECT a.sample_id AS i, b.sample_id AS j,
  sum((a.value - b.value) ^ 2) * (SELECT count(DISTINCT gene) FROM {source}) / count(*) AS d2
  FROM {source} a JOIN {source} b USING (gene) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
dn AS (SELECT m.sample_id, m.gene, b.value, row_number() OVER (PARTITION BY m.sample_id, m.gene ORDER BY d2, j) AS r
  FROM {source} m JOIN pd ON i = m.sample_id JOIN {source} b ON b.sample_id = j AND b.gene = m.gene
  WHERE m.value IS NULL AND b.value IS NOT NULL),
im AS (SELECT sample_id, gene, avg(value) AS v FROM dn WHERE r <= 5 GROUP BY 1, 2),
filled AS (SELECT s.sample_id, s.gene, coalesce(s.value, im.v, avg(s.value) OVER (PARTITION BY s.gene)) AS value
  FROM {source} s LEFT JOIN im ON im.sample_id = s.sample_id AND im.gene = s.gene)"""


def anova(source: str) -> str:
    return f"""pc AS (SELECT gene, y, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM {source}
  WHERE value IS NOT NULL GROUP BY 1, 2),
gm AS (SELECT gene, sum(n * m) / sum(n) AS g FROM pc GROUP BY 1),
af AS (SELECT gene, (sum(n * (m - g) ^ 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
  FROM pc JOIN gm USING (gene) GROUP BY 1)"""


def any_word(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def standardized(source: str) -> str:
    return f"""st AS (SELECT *, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1
  ELSE stddev_pop(value) OVER w END AS z FROM {source} WINDOW w AS (PARTITION BY gene))"""


def statements() -> dict[str, str]:
    long = "sample_id, gene, y"
    return {
        "read_matrix": f"WITH {X} SELECT 's' || gene AS sample_id, 'g' || y AS gene, {r('avg(value)')} AS value FROM x GROUP BY 1, 2",
        "load_series": f"""WITH {X}, pm AS (SELECT trim(p_name) AS id, trim(split_part(CASE WHEN p_type = 'ECONOMY' THEN '---'
              WHEN p_type = 'SMALL' THEN ' ' || p_brand || ' // x' ELSE p_brand || ' /// ' || p_type END, '//', 1)) AS symbol, p_partkey
              FROM part), pr AS (SELECT id, arg_max(symbol, p_partkey) AS symbol FROM pm WHERE lower(symbol) NOT IN ('', '---', 'nan') GROUP BY 1)
            , c AS (SELECT printf('s%02d', gene) AS sample_id, p_name, avg(value) AS value
              FROM x JOIN part ON sample_id = p_partkey AND p_type <> 'ECONOMY' GROUP BY 1, 2)
            SELECT sample_id, coalesce(symbol, p_name) AS gene, {r('avg(value)')} AS value
            FROM c LEFT JOIN pr ON id = trim(p_name) GROUP BY 1, 2""",
        "load_series_labels": f"""WITH {X}, s AS (SELECT DISTINCT gene, printf('s%02d', gene) AS sample_id FROM x),
              t AS (SELECT s.*, coalesce(lower(c_mktsegment), 'unknown') AS label FROM s LEFT JOIN customer ON printf('s%02d', c_custkey) = s.sample_id),
              f AS (SELECT label, row_number() OVER (ORDER BY min(sample_id)) - 1 AS y FROM t GROUP BY 1)
            SELECT sample_id, label, CAST(y AS INTEGER) AS y FROM t JOIN f USING (label)""",
        "load_series_trace": """SELECT CAST(o AS INTEGER) AS ord, source, name, o = 4 AS used, outcome FROM (VALUES
              (0, 'tables', 'S1', 'no table with an identifier and a value column'), (1, 'file', 'https://h/gone_matrix.txt', 'not there'),
              (2, 'file', 'https://h/texts_matrix.txt', 'no usable matrix'), (3, 'file', 'https://h/few_matrix.txt', 'no usable matrix'),
              (4, 'file', 'https://h/good.txt', 'matrix')) t(o, source, name, outcome) WHERE (SELECT count(*) FROM embeddings) > 10""",
        "load_labelled": f"""WITH {X}, p AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM (SELECT DISTINCT sample_id FROM x)),
              n AS (SELECT n_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey),
              l AS (SELECT DISTINCT gene, gene % 7 AS label FROM x),
              f AS (SELECT label, row_number() OVER (ORDER BY min(-gene)) - 1 AS y FROM l GROUP BY 1)
            SELECT printf('d%02d', x.gene) AS sample_id, coalesce(n_name, 'gene_' || p.i) AS gene, {r('avg(value)')} AS value,
              CAST(f.y AS INTEGER) AS y
            FROM x JOIN p USING (sample_id) LEFT JOIN n USING (i) JOIN l ON l.gene = x.gene JOIN f USING (label) GROUP BY 1, 2, 4""",
        "accept_matrix": f"WITH {E3} SELECT count(DISTINCT gene) AS n_genes, count(DISTINCT sample_id) AS n_samples, "
                         "count(DISTINCT gene) > 10 AND count(DISTINCT sample_id) >= 1 AS accepted FROM e3",
        "coerce_numeric": f"WITH {WORDS} SELECT event_id, a, b, c FROM e",
        "keep_mostly_numeric": f"WITH {WORDS} SELECT event_id, a, c FROM e",
        "read_gene_info": """WITH k AS (SELECT p_partkey, p_brand,
              unnest(['ENSG' || lpad(CAST(p_size AS VARCHAR), 11, '0'), 'ENSG9' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')]) AS id
              FROM part WHERE p_type NOT IN ('SMALL', 'PROMO'))
            SELECT id, arg_max(p_brand, p_partkey) AS symbol FROM k GROUP BY id""",
        "read_probe_map": """SELECT p_name AS id, arg_max(p_brand, p_partkey) AS symbol, min(p_partkey) AS ord
            FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1""",
        "pivot_samples": f"SELECT user_id AS sample_id, event_type AS gene, {r('avg(value)')} AS value FROM events GROUP BY 1, 2",
        "detect_columns": """WITH s AS (SELECT unnest([{'c': 'event_type', 'v': event_type}, {'c': 'value', 'v': CAST(value AS VARCHAR)},
              {'c': 'props', 'v': props}]) AS k FROM events)
            SELECT k.c AS "column", round(avg(CASE WHEN TRY_CAST(k.v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share,
              'event_id' AS id_col, k.c = 'value' AS is_value FROM s GROUP BY k.c""",
        "load_labelled_matrix": f"WITH {X} SELECT sample_id, 'g' || gene AS gene, value, y FROM x",
        "rank_candidate_files": f"""WITH m AS (SELECT page_id, unnest([{PREFIX} || page_id || '_raw_count.txt.gz', {PREFIX} || 'filelist.txt',
              ' none ', {PREFIX} || page_id || '.A3SS.txt', url, {PREFIX} || 'series.txt.gz']) AS u, unnest(generate_series(0, 5)) AS i FROM pages),
            l AS (SELECT page_id, unnest([{HTTPS} || 'series.txt.gz', {HTTPS} || page_id || '.tsv',
              'https://www.hhs.gov/policy/index.html']) AS u, unnest(generate_series(0, 2)) AS i FROM pages),
            b AS (SELECT replace(trim(u), 'ftp://ftp.ncbi.nlm.nih.gov', 'https://ftp.ncbi.nlm.nih.gov') AS url, 'metadata' AS source,
                page_id * 10 + i AS ord, 0 AS place FROM m WHERE lower(trim(u)) NOT IN ('', 'none')
              UNION ALL SELECT u, 'listing', page_id * 10 + i, 1 FROM l),
            k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY place, ord) AS r FROM b
              WHERE url LIKE 'http%' AND NOT contains(url, 'hhs.gov') AND NOT {any_word("lower(string_split(url, '/')[-1])", SKIP_WORDS)})
            SELECT url, source, ord, {any_word('lower(url)', PREFER_WORDS)} AS preferred FROM k WHERE r = 1""",
        "extract_file_links": """WITH h AS (SELECT page_id, 'GSE' || (page_id + 100000) AS accession, regexp_extract_all(html || '<a href="p' || page_id
                || '_matrix.txt.gz">' || '<a href="' || url || '">' || '<A HREF="http:x.gz"><A HREF="Readme.txt">',
                'href="([^"?/<>]+\\.[a-zA-Z0-9]{1,6})"', 1, 'i') AS m FROM pages),
            u AS (SELECT page_id, accession, unnest(m) AS name, unnest(generate_series(0, len(m) - 1)) AS pos FROM h)
            SELECT page_id, accession, CAST(pos AS INTEGER) AS pos, 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || left(accession, length(accession) - 3)
              || 'nnn/' || accession || '/suppl/' || name AS url FROM u WHERE NOT contains(name, '://') AND NOT starts_with(lower(name), 'http')""",
        "load_datasets": f"WITH {LOADED} SELECT dataset, dataset || '/' || sample_id AS sample_id, gene, {r('value')} AS value FROM l3",
        "load_report": f"""WITH {LOADED} SELECT dataset, true AS loaded, count(value) AS n_cells FROM l3 GROUP BY 1
            UNION ALL SELECT 'missing', false, 0""",
        "write_result": f"WITH {E3} SELECT dataset, sample_id, gene, {r('value')} AS value FROM d3",
        "qc_filter": f"WITH {QC} SELECT dataset, sample_id, gene, {r('value')} AS value FROM q3",
        "drop_null_columns": """SELECT vec_id AS vec, CAST(embedding[1] AS DOUBLE) AS g0,
            CASE WHEN abs(CAST(embedding[1] AS DOUBLE)) >= 0.01 THEN CAST(embedding[1] AS DOUBLE) END AS gaps FROM embeddings""",
        "select_numeric": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
        "filter_prefix_id": f"""WITH p AS ({PROBES}) SELECT dataset,
            starts_with(min(CASE WHEN dataset = 'A' THEN ens ELSE probe END), 'ENSG') AS has_prefix FROM p GROUP BY 1""",
        "sample_label_text": """SELECT s_suppkey AS sample_id, lower(CASE WHEN s_acctbal > 5000 THEN r_name || '|Grade: ' || n_name
            WHEN s_acctbal > 2000 THEN n_name WHEN s_acctbal > 0 THEN s_name ELSE 'unknown' END) AS label
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "orient": f"WITH {X} SELECT gene AS sample_id, sample_id AS gene, value FROM x",
        "shift_nonneg": f"WITH {X} SELECT {long}, {r('value - least((SELECT min(value) FROM x), 0)')} AS value FROM x",
        "log1p": f"WITH {X} SELECT {long}, {r('ln(1 + value - least((SELECT min(value) FROM x), 0))')} AS value FROM x",
        "convert_ids": f"""WITH p AS ({PROBES}) SELECT dataset, sample_id, p_brand AS gene, {r('avg(value)')} AS value
            FROM p JOIN part ON l_partkey = p_partkey AND p_type <> 'ECONOMY' GROUP BY 1, 2, 3""",
        "convert_prefixed_ids": f"""WITH p AS ({PROBES}) SELECT dataset, sample_id, CASE WHEN dataset = 'A' THEN p_brand ELSE probe END AS gene,
            {r('avg(value)')} AS value FROM p LEFT JOIN part ON l_partkey = p_partkey AND p_type <> 'ECONOMY'
            WHERE dataset <> 'A' OR p_brand IS NOT NULL GROUP BY 1, 2, 3""",
        "filter_prefix_id_by_row": f"""WITH {MIXED} SELECT dataset, starts_with(arg_min(gene, ord), 'ENSG') AS has_prefix FROM m GROUP BY 1""",
        "convert_prefixed_ids_by_row": f"""WITH {MIXED}, has AS (SELECT dataset, starts_with(arg_min(gene, ord), 'ENSG') AS has_prefix FROM m GROUP BY 1)
            SELECT m.dataset, sample_id, CASE WHEN has_prefix THEN p_brand ELSE gene END AS gene, {r('avg(value)')} AS value
            FROM m JOIN has USING (dataset)
            LEFT JOIN part ON gene = 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AND p_type <> 'ECONOMY'
            WHERE NOT has_prefix OR p_brand IS NOT NULL GROUP BY 1, 2, 3""",
        "detect_columns_gaps": f"""SELECT 'all' AS sample_id, event_type AS gene, {r('avg(CASE WHEN event_id % 7 <> 0 THEN value END)')} AS value,
            'VALUE' AS value_col FROM events GROUP BY 2""",
        "unmapped_ids": f"""WITH p AS ({PROBES}) SELECT DISTINCT ens AS gene FROM p
            LEFT JOIN part ON l_partkey = p_partkey AND p_type <> 'ECONOMY' WHERE p_brand IS NULL""",
        "map_probes": f"""WITH p AS ({PROBES}) SELECT dataset, sample_id, coalesce(p_brand, probe) AS gene, {r('avg(value)')} AS value
            FROM p LEFT JOIN part ON l_partkey = p_partkey AND p_type <> 'ECONOMY' GROUP BY 1, 2, 3""",
        "map_by_position": f"""WITH g AS (SELECT l_suppkey AS sample_id, l_extendedprice AS value,
              dense_rank() OVER (ORDER BY l_partkey) - 1 AS idx FROM lineitem),
            s AS (SELECT n_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier JOIN nation ON s_nationkey = n_nationkey)
            SELECT sample_id, coalesce(n_name, 'golub_' || idx) AS gene, {r('avg(value)')} AS value FROM g LEFT JOIN s USING (idx) GROUP BY 1, 2""",
        "intersect_genes": f"""WITH {FINE} SELECT dataset, sample_id, gene, {r('value')} AS value FROM f3 SEMI JOIN
            (SELECT gene FROM f3 GROUP BY 1 HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM f3)) g USING (gene)""",
        "align_labels": f"""WITH {CODES}, here AS (SELECT DISTINCT l_returnflag AS dataset, l_suppkey AS sample_id
              FROM lineitem JOIN part ON l_partkey = p_partkey)
            SELECT dataset, sample_id, y FROM codes JOIN here USING (dataset, sample_id) WHERE dataset <> 'R'
            UNION ALL SELECT 'R', h.sample_id, c.y FROM
              (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS i FROM here WHERE dataset = 'R') h JOIN
              (SELECT y, row_number() OVER (ORDER BY sample_id) AS i FROM codes WHERE dataset = 'R') c USING (i)""",
        "coassociation_pairs": f"""WITH {X}, {NEAR}, {SIG} SELECT i, j, {r('''list_sum(list_transform(generate_series(1, 3),
            lambda r: CASE WHEN a.l[r] = b.l[r] THEN 1 ELSE 0 END)) / 3''')} AS co
            FROM nn JOIN sg a ON a.sample_id = i JOIN sg b ON b.sample_id = j WHERE nn.r <= 3""",
        "knn": f"""WITH {X}, {NEAR} SELECT i AS sample_id, j AS neighbor_id, {r('sqrt(d2)')} AS dist,
            CAST(r AS INTEGER) AS rank FROM nn WHERE r <= 5""",
        "dedup_mean": f"WITH {E3} SELECT dataset, sample_id, gene, {r('value')} AS value FROM d3",
        "dedup_report": f"""WITH {E3}, c AS (SELECT dataset, sample_id, gene, count(*) AS n FROM e3 GROUP BY 1, 2, 3),
            g AS (SELECT dataset, gene, max(n) AS n FROM c GROUP BY 1, 2)
            SELECT dataset, CAST(sum(n) AS BIGINT) AS n_before, count(*) AS n_after FROM g GROUP BY 1""",
        "missing_rate_samples": f"""WITH {E3}, w AS (SELECT dataset, count(DISTINCT gene) AS w FROM d3 GROUP BY 1)
            SELECT dataset, sample_id, {r('1 - count(value) / w')} AS missing FROM d3 JOIN w USING (dataset) GROUP BY dataset, sample_id, w""",
        "missing_rate_genes": f"""WITH {E3}, w AS (SELECT dataset, count(DISTINCT sample_id) AS w FROM d3 GROUP BY 1)
            SELECT dataset, gene, {r('1 - count(value) / w')} AS missing FROM d3 JOIN w USING (dataset) GROUP BY dataset, gene, w""",
        "batch_zscore": f"WITH {E3}, {scored('d3')} SELECT dataset, sample_id, gene, {r('value')} AS value FROM z3",
        "merge_datasets": f"""WITH {FINE}, {CODES} SELECT dataset, sample_id, gene, {r('value')} AS value, shifted AS y FROM f3 SEMI JOIN
            (SELECT gene FROM f3 GROUP BY 1 HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM f3)) g USING (gene)
            JOIN codes USING (dataset, sample_id)""",
        "label_counts": f"WITH {CODES} SELECT shifted AS y, count(*) AS n_samples FROM codes GROUP BY 1",
        "shape_report": f"""WITH {E3} SELECT dataset, 'loaded' AS stage, count(DISTINCT gene) AS n_genes,
            count(DISTINCT sample_id) AS n_samples FROM e3 GROUP BY 1""",
        "merge_diagnosis": f"""WITH {FINE}, g AS (SELECT DISTINCT dataset, gene FROM f3),
            k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY gene) AS r FROM g)
            SELECT dataset, count(*) AS n_genes, string_agg(gene, ',' ORDER BY gene) FILTER (WHERE r <= 5) AS first_genes FROM k GROUP BY 1""",
        "duplicate_cells": f"WITH {E3} SELECT dataset, sample_id, gene, count(*) AS n FROM e3 GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "encode_labels": f"""WITH {ORDER_LABELS} SELECT o_orderstatus AS dataset, o_orderkey AS sample_id, label, o_orderkey AS ord, y
            FROM orders JOIN c ON dataset = o_orderstatus AND label = o_orderpriority""",
        "offset_labels": f"""WITH {ORDER_LABELS}, t AS (SELECT dataset, max(y) + 1 AS n FROM c GROUP BY 1)
            SELECT o_orderstatus AS dataset, o_orderkey AS sample_id, label, o_orderkey AS ord,
              CAST(y + coalesce((SELECT sum(n) FROM t WHERE t.dataset < c.dataset), 0) AS INTEGER) AS y
            FROM orders JOIN c ON dataset = o_orderstatus AND label = o_orderpriority""",
        "defuzzify": """SELECT vec_id AS sample_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cluster
            FROM embeddings""",
        "first_per_key": f"WITH {ITEMS} SELECT key, min(ord) AS ord, arg_min(supplier, ord) AS supplier FROM it GROUP BY 1",
        "last_per_key": f"WITH {ITEMS} SELECT key, arg_max(supplier, ord) AS supplier FROM it GROUP BY 1",
        "sort_by_cluster": f"WITH {LAB1} SELECT sample_id, cluster FROM lab",
        "cluster_ranks": f"WITH {RANKS} SELECT sample_id, cluster, rank FROM rk",
        "anova_f": f"WITH {X}, {anova('x')} SELECT gene, {r('f')} AS f FROM af",
        "anova_f_gaps": f"WITH {GAP}, {anova('gap')} SELECT gene, {r('f')} AS f FROM af",
        "top_k_features": f"WITH {X}, {anova('x')} SELECT gene, {r('f')} AS f FROM (SELECT * FROM af ORDER BY f DESC, gene DESC LIMIT 10)",
        "select_genes": f"""WITH {X}, {anova('x')} SELECT {long}, {r('value')} AS value FROM x
            SEMI JOIN (SELECT gene FROM af ORDER BY f DESC, gene DESC LIMIT 10) t USING (gene)""",
        "knn_impute": f"WITH {GAP}, {imputed('gap')} SELECT sample_id, gene, {r('value')} AS value FROM filled",
        "standardize": f"WITH {X}, {standardized('x')} SELECT {long}, {r('z')} AS value FROM st",
        "variance_threshold": f"""WITH {X} SELECT {long}, {r('value')} AS value FROM x
            SEMI JOIN (SELECT gene FROM x GROUP BY 1 HAVING var_pop(value) > 0.0155) t USING (gene)""",
        "minmax_scale": """SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part))
              / (SELECT max(p_size) - min(p_size) FROM part), 6) AS p_size,
            round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6)
              AS p_retailprice, 0.0::DOUBLE AS flat FROM part""",
        "preprocess": f"""WITH {GAP}, lg AS (SELECT sample_id, gene, ln(1 + value - least((SELECT min(value) FROM gap), 0)) AS value FROM gap),
            {imputed('lg')}, {standardized('filled')}, ok AS (SELECT gene FROM st GROUP BY 1 HAVING var_pop(z) > 0.01)
            SELECT sample_id, gene, {r('z')} AS value FROM st SEMI JOIN ok USING (gene)""",
        "nearest_centre": f"WITH {FCM1} SELECT sample_id, CAST(arg_min(c, d2) AS INTEGER) AS cluster FROM d0 GROUP BY 1",
        "knn_affinity": f"""WITH {X}, {NEAR}, e AS (SELECT i, j FROM nn WHERE r <= 9)
            SELECT i, j, CAST(count(*) * 0.5 AS DOUBLE) AS w FROM (SELECT i, j FROM e UNION ALL SELECT j, i FROM e) GROUP BY 1, 2""",
        "fuzzy_cmeans_one_pass": f"WITH {FCM1} SELECT sample_id, CAST(c AS INTEGER) AS cluster, {r('u')} AS u FROM u0",
        "fuzzy_cmeans_two_passes": f"WITH {FCM2} SELECT sample_id, CAST(c AS INTEGER) AS cluster, {r('u')} AS u FROM u1",
        "coassociation": f"WITH {SIG} SELECT sig_i, sig_j, n_i, n_j, {r('co')} AS co FROM co WHERE co > 0",
        "coassociation_degree": f"""WITH {LAB}, sz AS (SELECT run, cluster, count(*) AS n FROM lab GROUP BY 1, 2)
            SELECT sample_id, {r('sum(n) / 3')} AS degree FROM lab JOIN sz USING (run, cluster) GROUP BY 1""",
        "scaled_coassociation": f"""WITH {SIG}, lo AS (SELECT sig_j, min(co) AS lo FROM co GROUP BY 1)
            SELECT sig_i, sig_j, {r('CASE WHEN lo < 1 THEN (co - lo) / (1 - lo) ELSE 0 END')} AS co FROM co JOIN lo USING (sig_j) WHERE co > 0""",
        "silhouette_samples": f"WITH {X}, {LAB1}, {SIL} SELECT sample_id, cluster, {r('silhouette')} AS silhouette FROM sil",
        "silhouette": f"WITH {X}, {LAB1}, {SIL} SELECT {r('avg(silhouette)')} AS silhouette FROM sil",
        "silhouette_samples_sqeuclidean": f"WITH {X}, {LAB1}, {SQSIL} SELECT sample_id, cluster, {r('silhouette')} AS silhouette FROM sil",
        "silhouette_sqeuclidean": f"WITH {X}, {LAB}, {SQSIL} SELECT run, {r('avg(silhouette)')} AS silhouette FROM sil GROUP BY run",
        "knn_hashed": "SELECT 5 * count(*) AS n, true AS at_least_half FROM embeddings",
        "davies_bouldin": f"WITH {X}, {LAB1}, {DB} SELECT {r('davies_bouldin')} AS davies_bouldin FROM db",
        "adjusted_rand": f"WITH {LAB1}, {ARI} SELECT {r('ari')} AS ari FROM ari",
        "evaluate": f"""WITH {X}, {LAB}, {SIL}, {DB}, {ARI} SELECT run, {r('avg(silhouette)')} AS silhouette,
            {r('any_value(davies_bouldin)')} AS davies_bouldin, {r('any_value(ari)')} AS ari
            FROM sil JOIN db USING (run) JOIN ari USING (run) GROUP BY run""",
        "choose_k": f"""WITH {X}, {KLAB}, {SIL}, s AS (SELECT run AS k, avg(silhouette) AS silhouette FROM sil GROUP BY 1)
            SELECT k, {r('silhouette')} AS silhouette FROM s ORDER BY silhouette DESC, k LIMIT 1""",
        **{f"planted_{m}": f"WITH {PLANTED} SELECT sample_id, cluster FROM pl" for m in (
            "kmeans", "ward", "ward_summaries", "spectral", "fuzzy_cmeans", "hard_ensemble", "fuzzy_ensemble")},
        **{f"planted_classify_{m}": f"""WITH {SPLIT}, {PLANTED} SELECT sample_id, CAST(y AS INTEGER) AS cluster,
            CAST(y AS INTEGER) AS predicted FROM pl JOIN sp USING (sample_id) WHERE is_test""" for m in ("rf", "svm")},
        "planted_classifier_test": f"""WITH {SPLIT} SELECT m AS model, 1.0::DOUBLE AS accuracy, n AS n_correct, n AS n_test
            FROM (SELECT count(*) AS n FROM sp WHERE is_test) CROSS JOIN (VALUES ('RandomForest'), ('SVM'), ('KNN')) t(m)""",
        "pca_all": f"""WITH {X}, v AS (SELECT gene, var_samp(value) AS v FROM x GROUP BY 1)
            SELECT count(*) AS n, 0.0::DOUBLE AS mean, {r('sum(v)')} AS variance, 0.0::DOUBLE AS covariance FROM v""",
        "planted_ablation": """SELECT CAST(ord AS INTEGER) AS ord, method, 1.0 AS ari FROM (VALUES (0, 'KMeans'),
            (1, 'Fuzzy C-Means'), (2, 'Ensemble (no Fuzzy)'), (3, 'Fuzzy Ensemble')) t(ord, method)
            WHERE (SELECT count(DISTINCT label % 3) FROM embeddings) = 3""",
        "planted_best_k": "SELECT CAST(count(DISTINCT label % 3) AS INTEGER) AS k FROM embeddings",
        "planted_run_single": f"""WITH {SPLIT}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings)
            SELECT 'ari' AS name, 1.0::DOUBLE AS value
            UNION ALL SELECT 'correct ' || m, CAST((SELECT count(*) FROM sp WHERE is_test) AS DOUBLE)
              FROM (VALUES ('RandomForest'), ('SVM'), ('KNN')) t(m)
            UNION ALL SELECT 'rows of ' || t, n FROM n, (VALUES ('samples'), ('labels'), ('plane'), ('silhouettes')) v(t)
            UNION ALL SELECT 'rows of ' || t, 4.0 FROM (VALUES ('ablation'), ('ablation_bars')) v(t)""",
        "train_test_split": f"WITH {SPLIT} SELECT sample_id, is_test FROM sp",
        "classify_knn": f"""WITH {X}, {LAB1}, {SPLIT}, sq AS (SELECT a.sample_id AS i, b.sample_id AS j, sum((a.value - b.value) ^ 2) AS d2
              FROM x a JOIN x b USING (gene) JOIN sp p ON p.sample_id = a.sample_id AND p.is_test
              JOIN sp q ON q.sample_id = b.sample_id AND NOT q.is_test GROUP BY 1, 2),
            nn AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM sq),
            v AS (SELECT i, cluster, count(*) AS n FROM nn JOIN lab ON sample_id = j WHERE r <= 5 GROUP BY 1, 2),
            w AS (SELECT i, cluster AS predicted, row_number() OVER (PARTITION BY i ORDER BY n DESC, cluster) AS r FROM v)
            SELECT sample_id, cluster, predicted FROM w JOIN lab ON sample_id = i WHERE r = 1""",
        "ablation_bars": f"""WITH {X}, {LAB}, {SIL}, s AS (SELECT run, avg(silhouette) AS silhouette FROM sil GROUP BY 1)
            SELECT 'run ' || run AS method, {r('silhouette')} AS silhouette, printf('%.3f', silhouette) AS text FROM s""",
        "heatmap_cells": f"""WITH {X}, {RANKS}, t AS (SELECT sample_id, CAST(floor(rank * least((SELECT count(*) FROM lab), 200)
              / (SELECT count(*) FROM lab)) AS INTEGER) AS tile FROM rk)
            SELECT tile, gene AS component, {r('avg(value)')} AS value FROM x JOIN t USING (sample_id) GROUP BY 1, 2""",
        "silhouette_histogram": f"""WITH {X}, {LAB1}, {SIL}, m AS (SELECT min(silhouette) AS a, max(silhouette) AS b, avg(silhouette) AS mean FROM sil),
            w AS (SELECT *, (b - a) / 20 AS w FROM m),
            h AS (SELECT CAST(least(floor((silhouette - a) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM sil, w GROUP BY 1)
            SELECT CAST(i AS INTEGER) AS bin, {r('a + i * w')} AS lo, {r('a + (i + 1) * w')} AS hi, coalesce(n, 0) AS n, {r('mean')} AS mean
            FROM range(20) t(i) CROSS JOIN w LEFT JOIN h ON h.bin = i""",
    }
