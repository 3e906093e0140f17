"""The same queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

from labelspark.functions.stopwords import ENGLISH
from labelspark.operators.traffic import BUCKETS, OPEN_BUCKET
from labelspark.plans.inputs import DOCUMENT_LABELS

SQL: dict[str, str] = {}


def _values(rows) -> str:
    return ", ".join(str(tuple(r)) if len(r) > 1 else f"({r[0]!r})" for r in rows)


GENRES = f"v_genres AS (SELECT * FROM (VALUES {_values(DOCUMENT_LABELS)}) AS t(id, name))"

DOC = "v_doc AS (SELECT doc_id AS instance_id, lang AS title, text AS overview FROM documents)"

DOC_LABEL = """v_doc_label AS (
  SELECT doc_id AS instance_id,
         CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS label_id
  FROM documents
  UNION ALL SELECT doc_id, 5 FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 6 FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 7 FROM documents WHERE n_chars > 1500)"""

BASKET = """v_basket AS (
  SELECT l_orderkey AS instance_id, s_nationkey AS label_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

RAW = """v_parsed AS (
  SELECT doc_id AS instance_id, lang AS title, text AS overview,
         CASE doc_id % 8 WHEN 0 THEN [1, 5] WHEN 1 THEN [2, 6] WHEN 2 THEN [3, 99]
                         WHEN 3 THEN [7] ELSE [] END AS parsed,
         CASE doc_id % 8 WHEN 0 THEN [1, 5] WHEN 1 THEN [2, 6] WHEN 2 THEN [3]
                         WHEN 3 THEN [7] ELSE [] END AS known
  FROM documents)"""

SCORE = f"""{GENRES}, {DOC_LABEL}, v_score AS (
  SELECT d.doc_id AS instance_id, g.id AS label_id, g.name,
         ((d.doc_id * 7919 + g.id * 104729) % 1000) / CAST(1000 AS DOUBLE) AS score,
         CASE WHEN l.label_id IS NULL THEN 0 ELSE 1 END AS y
  FROM documents d CROSS JOIN v_genres g
  LEFT JOIN v_doc_label l ON l.instance_id = d.doc_id AND l.label_id = g.id)"""

LOG = """v_log AS (
  SELECT event_id, ts, 'POST' AS method,
         CASE WHEN user_id % 2 = 0 THEN 'transformation' ELSE 'adaptation' END AS model_type,
         CASE WHEN user_id % 2 = 0 THEN '/predict/transformation'
              ELSE '/predict/adaptation' END AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value / CAST(1000 AS DOUBLE) AS latency_sec, event_type AS genre,
         CASE WHEN value > 500 THEN CAST(1 AS DOUBLE)
              ELSE value / CAST(500 AS DOUBLE) END AS confidence
  FROM events)"""


def _ids(column: str) -> str:
    return f"array_to_string({column}, ',')"


# Cleaning and contracts

SQL["clean_parse_labels"] = (
    f"WITH {RAW} SELECT instance_id, {_ids('parsed')} AS parsed_ids FROM v_parsed"
)
SQL["clean_valid_labels"] = (
    f"WITH {RAW} SELECT instance_id, {_ids('known')} AS known_ids FROM v_parsed"
)
SQL["clean_rows"] = f"""WITH {RAW}
SELECT instance_id, title, length(overview) AS n_chars, {_ids('known')} AS genre_ids
FROM v_parsed WHERE length(overview) > 5 AND len(known) > 0"""
SQL["clean_counts"] = f"""WITH {RAW}, ok AS (
  SELECT coalesce(length(overview) > 5 AND len(known) > 0, false) AS ok FROM v_parsed)
SELECT count(*) AS loaded, count(*) FILTER (ok) AS retained, count(*) FILTER (NOT ok) AS removed
FROM ok"""
SQL["dedup_exact"] = f"""WITH {DOC}
SELECT min(instance_id) AS instance_id, title, md5(overview) AS digest
FROM v_doc GROUP BY title, overview"""
SQL["contract_instances"] = f"""WITH {RAW}
SELECT instance_id, {_ids('list_sort(list_distinct(known))')} AS genre_ids,
       CASE WHEN length(title) >= 1 AND len(known) >= 1 THEN 1 ELSE 0 END AS is_valid
FROM v_parsed"""
SQL["contract_catalogue"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
       CASE WHEN n_nationkey IS NOT NULL AND length(n_name) >= 1 THEN 1 ELSE 0 END AS is_valid
FROM nation"""
SQL["contract_requests"] = rf"""WITH {DOC}, cut AS (
  SELECT instance_id, overview,
         regexp_replace(overview, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS stripped FROM v_doc),
judged AS (
  SELECT instance_id, stripped,
         CASE WHEN overview IS NULL THEN 'missing' WHEN length(overview) < 10 THEN 'too_short'
              WHEN length(overview) > 10000 THEN 'too_long' WHEN stripped = '' THEN 'blank'
              ELSE 'accepted' END AS reject_reason FROM cut)
SELECT instance_id, reject_reason,
       CASE WHEN reject_reason = 'accepted' THEN length(stripped) ELSE 0 END AS clean_chars
FROM judged"""

# Profile of texts and label sets

SQL["table_counts"] = f"""
SELECT count(*) AS n_instances, CAST({len(DOCUMENT_LABELS)} AS BIGINT) AS n_labels FROM documents"""
SQL["text_length_stats"] = """
SELECT round(avg(length(text)), 6) AS avg_chars,
       round(CAST(quantile_cont(length(text), 0.5) AS DOUBLE), 6) AS median_chars,
       round(CAST(quantile_cont(length(text), 0.95) AS DOUBLE), 6) AS p95_chars
FROM documents"""

BASKET_SIZES = f"{BASKET}, sizes AS (SELECT instance_id, count(*) AS n FROM v_basket GROUP BY 1)"

SQL["label_density"] = f"""WITH {BASKET_SIZES}
SELECT round(avg(n), 6) AS label_density, max(n) AS max_labels FROM sizes"""

BASKET_SETS = f"""{BASKET}, held AS (
  SELECT instance_id, label_id, count(*) AS copies FROM v_basket GROUP BY 1, 2),
sets AS (
  SELECT instance_id, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS label_ids,
         string_agg(CAST(copies AS VARCHAR), ',' ORDER BY label_id) AS copies
  FROM held GROUP BY 1)"""

SQL["label_combinations"] = f"""WITH {BASKET_SETS}
SELECT label_ids, copies, count(*) AS n_instances FROM sets GROUP BY 1, 2"""
SQL["label_cardinality"] = f"""WITH {BASKET_SETS}
SELECT count(*) AS label_cardinality FROM (SELECT DISTINCT label_ids, copies FROM sets)"""


def _distribution(source: str, rows: str, catalogue: str) -> str:
    return f"""{source}, counted AS (SELECT label_id, count(*) AS "count" FROM {rows} GROUP BY 1),
total AS (SELECT count(DISTINCT instance_id) AS n FROM {rows}),
distribution AS (
  SELECT CAST(label_id AS BIGINT) AS label_id, name, "count",
         100.0 * "count" / CAST(n AS DOUBLE) AS support,
         row_number() OVER (ORDER BY "count" DESC, label_id) AS position
  FROM counted JOIN {catalogue} ON id = label_id, total)"""


NATIONS = "(SELECT n_nationkey AS id, n_name AS name FROM nation) c"
DISTRIBUTION = _distribution(BASKET, "v_basket", NATIONS)

SQL["label_distribution"] = f"""WITH {DISTRIBUTION}
SELECT label_id, name, "count", round(support, 6) AS support, position FROM distribution"""
SQL["label_distribution_documents"] = f"""
WITH {_distribution(f"{GENRES}, {DOC_LABEL}", "v_doc_label", "v_genres")}
SELECT label_id, name, "count", round(support, 6) AS support, position FROM distribution"""
SQL["label_gini"] = f"""WITH {DISTRIBUTION}, up AS (
  SELECT "count" AS x, row_number() OVER (ORDER BY "count", label_id) AS i FROM distribution)
SELECT round(2.0 * sum(i * x) / CAST(count(*) * sum(x) AS DOUBLE)
             - (count(*) + 1) / CAST(count(*) AS DOUBLE), 6) AS gini FROM up"""
SQL["label_head_tail"] = f"""WITH {DISTRIBUTION}
SELECT round(sum("count") FILTER (position <= 3) / CAST(sum("count") AS DOUBLE), 6) AS head_ratio,
       count(*) FILTER (support < 1.0) AS tail_labels,
       CAST(sum("count") AS BIGINT) AS label_instances FROM distribution"""

COOCCURRENCE = f"""{BASKET}, numbered AS (
  SELECT instance_id, label_id,
         row_number() OVER (PARTITION BY instance_id ORDER BY label_id) AS at FROM v_basket),
pairs AS (
  SELECT x.label_id AS a, y.label_id AS b, count(*) AS "count"
  FROM numbered x JOIN numbered y ON x.instance_id = y.instance_id AND x.at < y.at GROUP BY 1, 2)"""

SQL["label_cooccurrence_all"] = f"""WITH {COOCCURRENCE}
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, "count" FROM pairs"""
SQL["label_cooccurrence"] = f"""WITH {COOCCURRENCE}
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, p.n_name AS name_a, q.n_name AS name_b, "count"
FROM pairs JOIN nation p ON p.n_nationkey = a JOIN nation q ON q.n_nationkey = b
ORDER BY "count" DESC, a, b LIMIT 10"""


def _pair_tables(source: str, rows: str, catalogue: str) -> str:
    return f"""{source}, labels_ AS (SELECT id, name FROM {catalogue}),
held AS (SELECT DISTINCT instance_id, label_id FROM {rows}),
total AS (SELECT CAST(count(DISTINCT instance_id) AS DOUBLE) AS n FROM {rows}),
single AS (SELECT label_id, count(*) AS n FROM held GROUP BY 1),
both_ AS (
  SELECT x.label_id AS a, y.label_id AS b, count(*) AS n
  FROM held x JOIN held y ON x.instance_id = y.instance_id AND x.label_id < y.label_id GROUP BY 1, 2),
tables_ AS (
  SELECT p.id AS a, q.id AS b, p.name AS name_a, q.name AS name_b, total.n AS n,
         CAST(coalesce(both_.n, 0) AS DOUBLE) AS n11, CAST(coalesce(sa.n, 0) AS DOUBLE) AS n1,
         CAST(coalesce(sb.n, 0) AS DOUBLE) AS n2
  FROM labels_ p JOIN labels_ q ON p.id < q.id CROSS JOIN total
  LEFT JOIN single sa ON sa.label_id = p.id LEFT JOIN single sb ON sb.label_id = q.id
  LEFT JOIN both_ ON both_.a = p.id AND both_.b = q.id),
cells AS (
  SELECT *, n1 - n11 AS n10, n2 - n11 AS n01, n - n1 - n2 + n11 AS n00 FROM tables_),
nmi AS (
  SELECT a, b, name_a, name_b,
         CASE WHEN n11 > 0 THEN n11 / n * ln(n * n11 / (n1 * n2)) ELSE 0 END
         + CASE WHEN n10 > 0 THEN n10 / n * ln(n * n10 / (n1 * (n - n2))) ELSE 0 END
         + CASE WHEN n01 > 0 THEN n01 / n * ln(n * n01 / ((n - n1) * n2)) ELSE 0 END
         + CASE WHEN n00 > 0 THEN n00 / n * ln(n * n00 / ((n - n1) * (n - n2))) ELSE 0 END AS mi,
         CASE WHEN n1 > 0 AND n1 < n
              THEN -(n1 / n * ln(n1 / n)) - (n - n1) / n * ln((n - n1) / n) ELSE 0 END AS h1,
         CASE WHEN n2 > 0 AND n2 < n
              THEN -(n2 / n * ln(n2 / n)) - (n - n2) / n * ln((n - n2) / n) ELSE 0 END AS h2
  FROM cells),
nmi_scores AS (
  SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, name_a, name_b,
         CASE WHEN h1 = 0 AND h2 = 0 THEN 1.0 WHEN mi <= 2.220446049250313e-16 THEN 0.0
              ELSE least(1.0, greatest(0.0, mi / ((h1 + h2) / 2))) END AS nmi FROM nmi),
expected AS (
  SELECT *, n1 * n2 / n AS e11, n1 * (n - n2) / n AS e10, (n - n1) * n2 / n AS e01,
         (n - n1) * (n - n2) / n AS e00 FROM cells),
phi AS (
  SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, name_a, name_b,
         CASE WHEN n1 > 0 AND n1 < n AND n2 > 0 AND n2 < n THEN
           sqrt((power(greatest(abs(n11 - e11) - 0.5, 0), 2) / e11
                 + power(greatest(abs(n10 - e10) - 0.5, 0), 2) / e10
                 + power(greatest(abs(n01 - e01) - 0.5, 0), 2) / e01
                 + power(greatest(abs(n00 - e00) - 0.5, 0), 2) / e00) / n) END AS phi,
         CASE WHEN n1 > 0 AND n1 < n AND n2 > 0 AND n2 < n THEN
           (n * n11 - n1 * n2) / sqrt(n1 * n2 * (n - n1) * (n - n2)) END AS phi_signed
  FROM expected)"""


BASKET_TABLES = _pair_tables(BASKET, "v_basket", NATIONS)
DOC_TABLES = _pair_tables(f"{GENRES}, {DOC_LABEL}", "v_doc_label", "v_genres")

SQL["label_nmi"] = f"""WITH {BASKET_TABLES}
SELECT a, b, name_a, name_b, round(nmi, 6) AS nmi FROM nmi_scores"""
SQL["label_nmi_top"] = f"""WITH {DOC_TABLES}
SELECT a, b, name_a, name_b, round(nmi, 6) AS nmi FROM nmi_scores
ORDER BY round(nmi_scores.nmi, 12) DESC, a, b LIMIT 10"""
PHI = "SELECT a, b, name_a, name_b, round(phi, 6) AS phi, round(phi_signed, 6) AS phi_signed FROM phi"
SQL["label_phi"] = f"WITH {BASKET_TABLES} {PHI}"
SQL["label_phi_documents"] = f"WITH {DOC_TABLES} {PHI}"

# Text and TF-IDF

PATTERN = r"[\p{L}\p{N}_]{2,}"
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
FOLDED = f"regexp_extract_all(strip_accents(lower(overview)), '{PATTERN}')"
PLAIN = f"regexp_extract_all(lower(overview), '{PATTERN}')"
NO_STOP = f"list_filter({FOLDED}, lambda w: w NOT IN ({STOP}))"


def _terms(rows: str, tokens: str, lengths: tuple[int, ...], prefix: str = "") -> str:
    """CTEs up to (instance_id, term, tf)."""
    grams = []
    for n in lengths:
        word = " || ' ' || ".join(f"t[i + {o}]" for o in range(n))
        grams.append(
            f"SELECT instance_id, {word} AS term FROM (SELECT instance_id, t, "
            f"unnest(range(1, len(t) - {n - 2})) AS i FROM {prefix}toks)"
        )
    return (
        f"{prefix}toks AS (SELECT instance_id, {tokens} AS t FROM {rows}), "
        f"{prefix}grams AS ({' UNION ALL '.join(grams)}), "
        f"{prefix}counts AS (SELECT instance_id, term, count(*) AS tf FROM {prefix}grams GROUP BY 1, 2)"
    )


def _vocabulary(rows: str, counts: str, top: int, limits: str) -> str:
    return f"""vocabulary AS (
  SELECT term, df, cf, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {counts} GROUP BY 1),
       (SELECT count(*) AS n FROM {rows})
  WHERE {limits} ORDER BY cf DESC, term LIMIT {top})"""


FEATURE_LIMITS = "df >= 2 AND df <= 0.95 * n"


def _weights(name: str, counts: str, tf: str) -> str:
    return f"""{name} AS (
  SELECT instance_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY instance_id)) AS weight
  FROM (SELECT instance_id, term, tf, ({tf}) * idf AS raw FROM {counts} JOIN vocabulary USING (term)))"""


SUBLINEAR = "1 + ln(tf)"

TOKEN_TABLE = """SELECT token, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_instances FROM (
  SELECT instance_id, token, count(*) AS tf
  FROM (SELECT instance_id, unnest(t) AS token FROM toks) GROUP BY 1, 2) GROUP BY 1"""
SQL["tokens"] = f"WITH {DOC}, toks AS (SELECT instance_id, {FOLDED} AS t FROM v_doc) {TOKEN_TABLE}"
SQL["tokens_no_stop"] = (
    f"WITH {DOC}, toks AS (SELECT instance_id, {NO_STOP} AS t FROM v_doc) {TOKEN_TABLE}"
)
SQL["ngrams"] = f"""WITH {DOC}, {_terms("v_doc", PLAIN, (2, 3))}
SELECT instance_id, CAST(sum(tf) AS BIGINT) AS n_grams, count(*) AS n_distinct,
       min(term) AS first_gram, max(term) AS last_gram FROM counts GROUP BY 1"""

ALL_FEATURES = (
    f"{DOC}, {_terms('v_doc', NO_STOP, (1, 2))}, "
    f"{_vocabulary('v_doc', 'counts', 20000, FEATURE_LIMITS)}"
)
SQL["vocabulary"] = (
    f"WITH {ALL_FEATURES} SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary"
)
SQL["tfidf_weights"] = f"""WITH {ALL_FEATURES}, {_weights("weighted", "counts", SUBLINEAR)}
SELECT instance_id, term, round(weight, 6) AS weight FROM weighted"""

SPLIT = f"""{DOC}, {GENRES}, {DOC_LABEL}, label_sets AS (
  SELECT instance_id, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS set_key
  FROM v_doc_label GROUP BY 1),
lined AS (
  SELECT instance_id, set_key,
         row_number() OVER (ORDER BY md5(set_key), set_key,
                                     md5(CAST(instance_id AS VARCHAR)), instance_id) AS p
  FROM label_sets),
split AS (SELECT instance_id, set_key, p // 5 > (p - 1) // 5 AS is_validation FROM lined)"""
SQL["stratified_split"] = f"""WITH {SPLIT}
SELECT instance_id, set_key, CAST(is_validation AS INTEGER) AS is_validation FROM split"""

SQL["pair_split_shares"] = f"""WITH {DOC}, {GENRES}, {DOC_LABEL}
SELECT CAST(x.label_id AS BIGINT) AS label_a, CAST(y.label_id AS BIGINT) AS label_b, count(*) AS n,
       true AS within_one
FROM v_doc_label x JOIN v_doc_label y ON x.instance_id = y.instance_id AND x.label_id <= y.label_id
GROUP BY 1, 2"""

FITTED = f"""{SPLIT},
train AS (SELECT v_doc.* FROM v_doc JOIN split USING (instance_id) WHERE NOT is_validation),
validation AS (SELECT v_doc.* FROM v_doc JOIN split USING (instance_id) WHERE is_validation),
{_terms("train", NO_STOP, (1, 2), "train_")}, {_terms("validation", NO_STOP, (1, 2), "validation_")},
{_vocabulary("train", "train_counts", 20000, FEATURE_LIMITS)},
{_weights("train_weights", "train_counts", SUBLINEAR)},
{_weights("validation_weights", "validation_counts", SUBLINEAR)}"""
SQL["tfidf_unseen"] = f"""WITH {FITTED}
SELECT instance_id, term, round(weight, 6) AS weight FROM validation_weights"""
SQL["feature_shape"] = f"""WITH {FITTED}
SELECT (SELECT count(*) FROM vocabulary) AS n_terms, (SELECT count(*) FROM train) AS n_train,
       (SELECT count(*) FROM validation) AS n_validation,
       (SELECT count(DISTINCT label_id) FROM v_doc_label) AS n_labels"""

# Near-duplicates

NEAR = f"""{DOC}, {_terms("v_doc", PLAIN, (2, 3))},
{_vocabulary("v_doc", "counts", 1000, "true")}, {_weights("weighted", "counts", "tf")},
vectors AS (
  SELECT instance_id, string_agg(term || ':' || tf, ',' ORDER BY term) AS vector
  FROM weighted GROUP BY 1),
groups AS (
  SELECT instance_id, min(instance_id) OVER (PARTITION BY vector) AS rep FROM vectors),
near_sizes AS (SELECT rep, count(*) AS n FROM groups GROUP BY 1),
kept AS (SELECT weighted.* FROM weighted JOIN near_sizes ON rep = instance_id),
near_pairs AS (
  SELECT rep AS instance_a, rep AS instance_b, CAST(1 AS DOUBLE) AS similarity,
         n * (n - 1) // 2 AS n_pairs FROM near_sizes WHERE n > 1
  UNION ALL
  SELECT a, b, similarity, p.n * q.n FROM (
    SELECT x.instance_id AS a, y.instance_id AS b, round(sum(x.weight * y.weight), 9) AS similarity
    FROM kept x JOIN kept y ON x.term = y.term AND x.instance_id < y.instance_id GROUP BY 1, 2)
  JOIN near_sizes p ON p.rep = a JOIN near_sizes q ON q.rep = b WHERE similarity >= 0.9)"""
SQL["near_duplicates"] = f"""WITH {NEAR}
SELECT instance_a, instance_b, round(similarity, 6) AS similarity, CAST(n_pairs AS BIGINT) AS n_pairs
FROM near_pairs"""
SQL["near_duplicates_by_bands"] = f"""WITH {NEAR}
SELECT threshold, count(*) FILTER (similarity >= threshold) AS n_exact, CAST(0 AS BIGINT) AS n_wrong,
       true AS enough
FROM near_pairs, (SELECT unnest([CAST(0.9 AS DOUBLE), 0.95, 1.0]) AS threshold) GROUP BY threshold"""
SQL["near_duplicate_members"] = f"WITH {NEAR} SELECT rep, instance_id FROM groups"

DUPLICATES = "(SELECT count(*) FROM v_doc) - (SELECT count(*) FROM (SELECT DISTINCT title, overview FROM v_doc))"
SQL["anomaly_counts"] = f"""WITH {DOC}, {BASKET_SIZES}
SELECT {DUPLICATES} AS duplicates,
       (SELECT count(*) FROM v_doc WHERE length(overview) < 10) AS short_texts,
       (SELECT count(*) FROM sizes WHERE n > 7) AS over_labelled"""

WARNING_FIGURES = f"""
{_distribution(f"{GENRES}, {DOC_LABEL}", "v_doc_label", "v_genres")}, {NEAR},
doc_sets AS (
  SELECT string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id) AS k
  FROM v_doc_label GROUP BY instance_id),
figures AS (
  SELECT (SELECT sum("count") FILTER (position <= 3) / CAST(sum("count") AS DOUBLE)
          FROM distribution) AS head_ratio,
         (SELECT count(*) FILTER (support < 1.0) FROM distribution) AS tail_labels,
         {DUPLICATES} AS duplicates,
         (SELECT coalesce(CAST(sum(n_pairs) AS BIGINT), 0) FROM near_pairs) AS near_pairs,
         (SELECT count(*) FROM v_doc WHERE length(overview) < 10) AS short_texts,
         (SELECT count(DISTINCT k) FROM doc_sets) AS cardinality,
         (SELECT count(*) FROM v_doc) AS n),
listed AS (
  SELECT unnest(list_filter([
    CASE WHEN head_ratio > 0.6 THEN 'Imbalanced labels: the top 3 hold '
      || printf('%.1f', head_ratio * 100) || '% of all label occurrences.' END,
    CASE WHEN tail_labels > 5 THEN 'Rare labels: ' || tail_labels || ' have less than 1% support.' END,
    CASE WHEN duplicates > 0 THEN 'Exact duplicates: ' || duplicates
      || ' rows repeat a title and text.' END,
    CASE WHEN near_pairs > 10 THEN 'Near duplicates: ' || near_pairs
      || ' pairs of very similar texts.' END,
    CASE WHEN short_texts > 50 THEN 'Short texts: ' || short_texts
      || ' have less than 10 characters.' END,
    CASE WHEN cardinality > 0.5 * n THEN 'Many label combinations: ' || cardinality || ' in ' || n
      || ' instances (' || printf('%.1f', 100.0 * cardinality / n) || '%).' END
  ], lambda w: w IS NOT NULL)) AS warning FROM figures)"""
SQL["profile_warnings"] = f"""WITH {WARNING_FIGURES}
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, warning FROM listed"""

DOC_DISTRIBUTION = _distribution(f"{GENRES}, {DOC_LABEL}", "v_doc_label", "v_genres")
DOC_SIZES = f"{DOC_LABEL}, sizes AS (SELECT instance_id, count(*) AS n FROM v_doc_label GROUP BY 1)"


def _figures(query: str, *names: str) -> str:
    """One row of SQL as rows of the report."""
    return " UNION ALL ".join(
        f"SELECT 'figure' AS section, 0 AS position, '{n}' AS name, "
        f"round(CAST({n} AS DOUBLE), 6) AS value FROM ({query})"
        for n in names
    )


SQL["profile_report_rows"] = " UNION ALL ".join([
    _figures(SQL["table_counts"], "n_instances", "n_labels"),
    _figures(SQL["text_length_stats"], "avg_chars", "median_chars", "p95_chars"),
    _figures(
        f"WITH {DOC_SIZES} SELECT avg(n) AS label_density, max(n) AS max_labels_per_instance, "
        "count(*) FILTER (n > 7) AS over_labelled FROM sizes",
        "label_density", "max_labels_per_instance", "over_labelled",
    ),
    _figures(
        f"WITH {WARNING_FIGURES} SELECT head_ratio, tail_labels, duplicates, short_texts, "
        "near_pairs AS near_duplicate_pairs, cardinality AS label_cardinality FROM figures",
        "head_ratio", "tail_labels", "duplicates", "short_texts", "near_duplicate_pairs",
        "label_cardinality",
    ),
    _figures(SQL["label_gini"].replace(DISTRIBUTION, DOC_DISTRIBUTION), "gini"),
    f"""SELECT 'label' AS section, CAST(position AS INTEGER) AS position, name,
       CAST("count" AS DOUBLE) AS value FROM (WITH {DOC_DISTRIBUTION} SELECT * FROM distribution)""",
    f"""SELECT 'support', CAST(position AS INTEGER), name, round(support, 6)
FROM (WITH {DOC_DISTRIBUTION} SELECT * FROM distribution)""",
    f"""SELECT 'co_occurrence', CAST(row_number() OVER (ORDER BY n DESC, a, b) AS INTEGER),
       name_a || '/' || name_b, CAST(n AS DOUBLE) FROM (
  WITH {GENRES}, {DOC_LABEL} SELECT x.label_id AS a, y.label_id AS b, p.name AS name_a,
       q.name AS name_b, count(*) AS n
  FROM v_doc_label x JOIN v_doc_label y ON x.instance_id = y.instance_id AND x.label_id < y.label_id
  JOIN v_genres p ON p.id = x.label_id JOIN v_genres q ON q.id = y.label_id
  GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10)""",
    f"""SELECT 'mutual_info', CAST(row_number() OVER (ORDER BY r12 DESC, a, b) AS INTEGER),
       name_a || '/' || name_b, round(nmi, 6) FROM (
  WITH {DOC_TABLES} SELECT a, b, name_a, name_b, nmi, round(nmi_scores.nmi, 12) AS r12
  FROM nmi_scores ORDER BY r12 DESC, a, b LIMIT 10)""",
    f"""SELECT 'warning', CAST(position AS INTEGER) + 1, warning, CAST(length(warning) AS DOUBLE)
FROM ({SQL["profile_warnings"]})""",
])

SQL["label_count_histogram"] = f"""WITH {BASKET_SIZES}
SELECT n AS n_labels, count(*) AS n_instances FROM sizes GROUP BY 1"""
SQL["cooccurrence_matrix"] = f"""WITH {DISTRIBUTION},
top AS (SELECT label_id FROM distribution WHERE position <= 15),
held AS (SELECT DISTINCT instance_id, CAST(label_id AS BIGINT) AS label_id FROM v_basket),
inside AS (SELECT held.* FROM held JOIN top USING (label_id)),
counted_pairs AS (
  SELECT x.label_id AS a, y.label_id AS b, count(*) AS n
  FROM inside x JOIN inside y ON x.instance_id = y.instance_id GROUP BY 1, 2)
SELECT p.label_id AS a, q.label_id AS b, coalesce(n, 0) AS n_both
FROM top p CROSS JOIN top q LEFT JOIN counted_pairs ON a = p.label_id AND b = q.label_id"""
SQL["label_matrix"] = f"""WITH {GENRES}, {DOC_LABEL},
seen AS (SELECT label_id, row_number() OVER (ORDER BY label_id) - 1 AS column_no
         FROM (SELECT DISTINCT label_id FROM v_doc_label))
SELECT DISTINCT instance_id, CAST(l.label_id AS BIGINT) AS label_id, name,
       CAST(column_no AS INTEGER) AS column_no
FROM v_doc_label l JOIN seen ON seen.label_id = l.label_id JOIN v_genres ON id = l.label_id"""
SQL["label_matrix_density"] = f"""WITH {BASKET},
held AS (SELECT DISTINCT instance_id, label_id FROM v_basket),
n AS (SELECT count(*) AS ones, count(DISTINCT instance_id) AS n, count(DISTINCT label_id) AS l FROM held)
SELECT round(ones / CAST(n * l AS DOUBLE), 6) AS density,
       round(ones / CAST(n AS DOUBLE), 6) AS labels_per_instance FROM n"""

# Models

SQL["hard_decision"] = f"""WITH {SCORE}
SELECT instance_id, label_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM v_score"""
SQL["one_class_scores"] = f"""WITH {GENRES}, {DOC_LABEL},
held AS (SELECT label_id, count(DISTINCT instance_id) AS n FROM v_doc_label GROUP BY 1),
total AS (SELECT count(*) AS n FROM documents),
rows_ AS (SELECT id, coalesce(held.n, 0) AS n_label, total.n AS n
          FROM v_genres LEFT JOIN held ON label_id = id CROSS JOIN total)
SELECT CAST(id AS BIGINT) AS label_id, n_label,
       CASE WHEN n_label IN (0, n) THEN 1 ELSE 0 END AS is_constant,
       CASE WHEN n_label IN (0, n) THEN n_label / CAST(n AS DOUBLE) END AS constant_score
FROM rows_"""


def _neighbours(name: str, queries: str, weights: str) -> str:
    """Brute force: every query against every training row."""
    return f"""{name} AS (
  SELECT instance_id, neighbour_id, CAST(rank AS INTEGER) AS rank, distance2 FROM (
    SELECT q.instance_id, t.instance_id AS neighbour_id,
           round(CASE WHEN q.unit AND t.unit THEN 2 - 2 * coalesce(dot, 0)
                      WHEN q.unit OR t.unit THEN 1 ELSE 0 END, 9) AS distance2,
           row_number() OVER (PARTITION BY q.instance_id ORDER BY
             round(CASE WHEN q.unit AND t.unit THEN 2 - 2 * coalesce(dot, 0)
                        WHEN q.unit OR t.unit THEN 1 ELSE 0 END, 9), t.instance_id) AS rank
    FROM (SELECT instance_id, instance_id IN (SELECT instance_id FROM {weights}) AS unit
          FROM {queries}) q
    CROSS JOIN (SELECT instance_id, instance_id IN (SELECT instance_id FROM train_weights) AS unit
                FROM train) t
    LEFT JOIN (
      SELECT x.instance_id AS a, y.instance_id AS b, sum(x.weight * y.weight) AS dot
      FROM {weights} x JOIN train_weights y ON x.term = y.term GROUP BY 1, 2)
    ON a = q.instance_id AND b = t.instance_id)
  WHERE rank <= 10)"""


OWN = _neighbours("own", "train", "train_weights")
NEAREST = _neighbours("nearest", "validation", "validation_weights")
NEIGHBOUR_COLUMNS = "instance_id, neighbour_id, rank, round(distance2, 6) AS distance2"
SQL["mlknn_neighbours"] = f"WITH {FITTED}, {NEAREST} SELECT {NEIGHBOUR_COLUMNS} FROM nearest"
SQL["mlknn_train_neighbours"] = f"WITH {FITTED}, {OWN} SELECT {NEIGHBOUR_COLUMNS} FROM own"

SQL["mlknn_neighbours_by_lists"] = f"""WITH {FITTED}, {NEAREST}
SELECT count(*) AS n_neighbours, CAST(0 AS BIGINT) AS n_too_near, true AS enough FROM nearest"""

SQL["embedding_neighbours"] = """WITH unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, t.vec_id AS neighbour_id,
         round(2 - 2 * CASE WHEN q.size > 0 AND t.size > 0
                            THEN list_dot_product(q.v, t.v) / (q.size * t.size) ELSE 0 END, 9) AS distance2
  FROM unit q CROSS JOIN unit t WHERE q.vec_id % 50 = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance2, neighbour_id) AS rank FROM pairs)
SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(distance2, 6) AS distance2
FROM placed WHERE rank <= 10"""

PRIORS = """train_label AS (
  SELECT DISTINCT instance_id, label_id FROM v_doc_label JOIN train USING (instance_id)),
observed AS (SELECT DISTINCT label_id FROM v_doc_label),
priors AS (
  SELECT o.label_id, (1.0 + count(t.instance_id)) / (2.0 + (SELECT count(*) FROM train)) AS prior
  FROM observed o LEFT JOIN train_label t USING (label_id) GROUP BY 1)"""
CONDITIONALS = f"""{OWN}, j_train AS (
  SELECT t.instance_id, o.label_id, count(l.label_id) AS j, max(CASE WHEN y.label_id IS NULL THEN 0 ELSE 1 END) AS y
  FROM train t CROSS JOIN observed o
  JOIN own ON own.instance_id = t.instance_id
  LEFT JOIN train_label l ON l.instance_id = own.neighbour_id AND l.label_id = o.label_id
  LEFT JOIN train_label y ON y.instance_id = t.instance_id AND y.label_id = o.label_id
  GROUP BY 1, 2),
grid AS (SELECT label_id, j FROM observed, (SELECT unnest(range(0, 11)) AS j)),
conditionals AS (
  SELECT g.label_id, g.j,
         (1.0 + count(*) FILTER (t.y = 1 AND t.j = g.j)) / (11.0 + count(*) FILTER (t.y = 1)) AS cond1,
         (1.0 + count(*) FILTER (t.y = 0 AND t.j = g.j)) / (11.0 + count(*) FILTER (t.y = 0)) AS cond0
  FROM grid g LEFT JOIN j_train t ON t.label_id = g.label_id GROUP BY 1, 2)"""
SQL["mlknn_priors"] = f"""WITH {FITTED}, {PRIORS}
SELECT CAST(label_id AS BIGINT) AS label_id, round(prior, 6) AS prior FROM priors"""
SQL["mlknn_conditionals"] = f"""WITH {FITTED}, {PRIORS}, {CONDITIONALS}
SELECT CAST(label_id AS BIGINT) AS label_id, CAST(j AS INTEGER) AS j, round(cond1, 6) AS cond1,
       round(cond0, 6) AS cond0 FROM conditionals"""
POSTERIOR = f"""{PRIORS}, {CONDITIONALS}, {NEAREST}, j_query AS (
  SELECT v.instance_id, o.label_id, count(l.label_id) AS j
  FROM validation v CROSS JOIN observed o
  JOIN nearest ON nearest.instance_id = v.instance_id
  LEFT JOIN train_label l ON l.instance_id = nearest.neighbour_id AND l.label_id = o.label_id
  GROUP BY 1, 2),
posterior AS (
  SELECT instance_id, q.label_id, prior * cond1 / (prior * cond1 + (1 - prior) * cond0) AS score,
         CASE WHEN prior * cond1 >= (1 - prior) * cond0 THEN 1 ELSE 0 END AS predicted
  FROM j_query q JOIN priors USING (label_id)
  JOIN conditionals c ON c.label_id = q.label_id AND c.j = q.j)"""
SQL["mlknn_posterior"] = f"""WITH {FITTED}, {POSTERIOR}
SELECT instance_id, CAST(label_id AS BIGINT) AS label_id, round(score, 6) AS score, predicted
FROM posterior"""
SQL["predict_batch"] = f"""WITH {FITTED}, {POSTERIOR}, best AS (
  SELECT instance_id, p.label_id, name, score,
         row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, p.label_id) AS rank
  FROM posterior p JOIN v_genres ON id = p.label_id)
SELECT instance_id,
       coalesce(string_agg(name, ',' ORDER BY rank) FILTER (score >= 0.1), '') AS labels,
       CAST(count(*) FILTER (score >= 0.1) AS INTEGER) AS n_labels
FROM best WHERE rank <= 3 GROUP BY 1"""

SQL["br_optimum"] = f"""WITH {FITTED}, {PRIORS}
SELECT CAST(label_id AS BIGINT) AS label_id, 1 AS at_optimum FROM train_label
GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM train)"""
SQL["br_joint_optimum"] = SQL["br_optimum"]
SQL["br_stored_model"] = f"""WITH {FITTED}, {PRIORS}
SELECT (SELECT count(*) FROM observed) AS n_labels, 'binary_relevance' AS model_type,
       (SELECT count(*) FROM observed) * (SELECT count(*) FROM validation) AS n_scores,
       (SELECT count(*) FROM validation) AS n_texts"""
SQL["mlknn_figures"] = f"""WITH {FITTED}, {POSTERIOR}, judged AS (
  SELECT p.instance_id, p.label_id, predicted, CASE WHEN l.label_id IS NULL THEN 0 ELSE 1 END AS y,
         row_number() OVER (PARTITION BY p.instance_id ORDER BY score DESC, p.label_id) AS rank
  FROM posterior p LEFT JOIN (SELECT DISTINCT instance_id, label_id FROM v_doc_label) l
    ON l.instance_id = p.instance_id AND l.label_id = p.label_id),
each AS (
  SELECT instance_id, sum(CASE WHEN y <> predicted THEN 1 ELSE 0 END) AS wrong, count(*) AS n,
         sum(y * predicted) AS n_both, sum(y) AS n_true, count(*) FILTER (rank <= 3 AND y = 1) AS hits
  FROM judged GROUP BY 1),
per_label AS (
  SELECT label_id, sum(y * predicted) AS n_both, sum(CASE WHEN y <> predicted THEN 1 ELSE 0 END) AS wrong
  FROM judged GROUP BY 1)
SELECT round(avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END), 6) AS subset_accuracy,
       round(sum(wrong) / CAST(sum(n) AS DOUBLE), 6) AS hamming_loss,
       round(2 * sum(n_both) / CAST(2 * sum(n_both) + sum(wrong) AS DOUBLE), 6) AS f1_micro,
       (SELECT round(avg(CASE WHEN 2 * n_both + wrong > 0
                              THEN 2 * n_both / CAST(2 * n_both + wrong AS DOUBLE) ELSE 0.0 END), 6)
        FROM per_label) AS f1_macro,
       round(avg(hits / CAST(least(3, n) AS DOUBLE)), 6) AS precision_at_3,
       round(avg(CASE WHEN n_true > 0 THEN hits / CAST(n_true AS DOUBLE) ELSE 1.0 END), 6) AS recall_at_3
FROM each"""

# Evaluation

DECIDED = f"""{SCORE}, decided AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM v_score)"""
RANKED = f"""{SCORE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, label_id) AS rank
  FROM v_score),
per_instance AS (
  SELECT instance_id, count(*) FILTER (rank <= 3 AND y = 1) AS hits, sum(y) AS n_true,
         count(*) AS n_labels,
         sum(CASE WHEN rank <= 3 AND y = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM ranked GROUP BY 1)"""
F1 = """CASE WHEN 2 * sum(y * predicted) + sum(CASE WHEN y <> predicted THEN 1 ELSE 0 END) > 0
  THEN 2 * sum(y * predicted) / CAST(2 * sum(y * predicted)
       + sum(CASE WHEN y <> predicted THEN 1 ELSE 0 END) AS DOUBLE) ELSE 0.0 END"""
HAMMING = "avg(CASE WHEN y <> predicted THEN 1.0 ELSE 0.0 END)"
SQL["hamming_loss"] = f"WITH {DECIDED} SELECT round({HAMMING}, 6) AS hamming_loss FROM decided"
SQL["subset_accuracy"] = f"""WITH {DECIDED}
SELECT round(avg(ok), 6) AS subset_accuracy FROM (
  SELECT CAST(min(CASE WHEN y = predicted THEN 1 ELSE 0 END) AS DOUBLE) AS ok
  FROM decided GROUP BY instance_id)"""
SQL["f1_micro"] = f"WITH {DECIDED} SELECT round({F1}, 6) AS f1_micro FROM decided"
SQL["f1_macro"] = f"""WITH {DECIDED}
SELECT round(avg(f1), 6) AS f1_macro FROM (SELECT {F1} AS f1 FROM decided GROUP BY label_id)"""
SQL["precision_at_k"] = f"""WITH {RANKED}
SELECT round(avg(hits / CAST(least(3, n_labels) AS DOUBLE)), 6) AS precision_at_k FROM per_instance"""
RECALL = "avg(CASE WHEN n_true > 0 THEN hits / CAST(n_true AS DOUBLE) ELSE 1.0 END)"
SQL["recall_at_k"] = f"WITH {RANKED} SELECT round({RECALL}, 6) AS recall_at_k FROM per_instance"
SQL["ndcg_at_k"] = f"""WITH {RANKED}
SELECT round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE dcg / CASE least(n_true, 3, n_labels)
  WHEN 1 THEN 1.0 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1 + 1 / log2(3) + 1 / log2(4) END END), 6)
  AS ndcg_at_k FROM per_instance"""
SQL["model_comparison"] = f"""WITH {SCORE}, both_models AS (
  SELECT 'binary_relevance' AS model, instance_id, label_id, score, y FROM v_score
  UNION ALL SELECT 'ml_knn', instance_id, label_id, 1 - score, y FROM v_score),
decided AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted,
         row_number() OVER (PARTITION BY model, instance_id ORDER BY score DESC, label_id) AS rank
  FROM both_models),
per_instance AS (
  SELECT model, instance_id, min(CASE WHEN y = predicted THEN 1.0 ELSE 0.0 END) AS ok,
         count(*) FILTER (rank <= 3 AND y = 1) AS hits, sum(y) AS n_true FROM decided GROUP BY 1, 2),
per_label AS (SELECT model, {F1} AS f1 FROM decided GROUP BY model, label_id),
figures AS (
  SELECT model, 2 AS position, 'hamming_loss' AS metric, {HAMMING} AS v FROM decided GROUP BY model
  UNION ALL SELECT model, 3, 'f1_micro', {F1} FROM decided GROUP BY model
  UNION ALL SELECT model, 4, 'f1_macro', avg(f1) FROM per_label GROUP BY model
  UNION ALL SELECT model, 1, 'subset_accuracy', avg(ok) FROM per_instance GROUP BY model
  UNION ALL SELECT model, 5, 'precision_at_3', avg(hits / CAST(3 AS DOUBLE)) FROM per_instance GROUP BY model
  UNION ALL SELECT model, 6, 'recall_at_3', {RECALL} FROM per_instance GROUP BY model),
wide AS (
  SELECT position, metric, max(v) FILTER (model = 'binary_relevance') AS br,
         max(v) FILTER (model = 'ml_knn') AS knn FROM figures GROUP BY 1, 2)
SELECT position, metric, round(br, 6) AS binary_relevance, round(knn, 6) AS ml_knn,
       CASE WHEN CASE WHEN metric = 'hamming_loss' THEN br <= knn ELSE br >= knn END
            THEN 'binary_relevance' ELSE 'ml_knn' END AS best_model,
       round(CASE WHEN metric = 'hamming_loss' THEN least(br, knn) ELSE greatest(br, knn) END, 6)
         AS best_value
FROM wide"""

# Prediction

SCORES_TEXT = "printf('%.3f', score)"
SQL["predict_topk"] = f"""WITH {RANKED}
SELECT instance_id,
  coalesce(string_agg(name, ',' ORDER BY rank) FILTER (score >= 0.1), '') AS labels,
  coalesce(string_agg({SCORES_TEXT}, ',' ORDER BY rank) FILTER (score >= 0.1), '') AS confidences
FROM ranked WHERE rank <= 3 GROUP BY 1"""
SQL["predict_response"] = f"""WITH {RANKED}
SELECT instance_id,
  coalesce(string_agg(name, ',' ORDER BY rank) FILTER (score >= 0.1), '') AS predicted_labels,
  string_agg({SCORES_TEXT}, ',' ORDER BY rank) AS confidence_scores
FROM ranked WHERE rank <= 3 GROUP BY 1"""
SQL["label_confidence"] = f"""WITH {SCORE}
SELECT instance_id, round(score, 6) AS confidence FROM v_score WHERE name = 'toxic'"""
SQL["prediction_log_records"] = f"""WITH {RANKED}, answers AS (
  SELECT instance_id, count(*) FILTER (score >= 0.1) AS n_labels FROM ranked WHERE rank <= 3 GROUP BY 1)
SELECT 'binary_relevance' AS model_type, n_labels, count(*) AS n, CAST(20 AS DOUBLE) AS latency_ms
FROM answers GROUP BY n_labels"""

# Sources and sinks

SQL["source_instances_csv"] = f"""WITH {RAW}
SELECT instance_id, title, md5(overview) AS digest, {_ids('parsed')} AS parsed_ids FROM v_parsed"""
SQL["source_catalogue_csv"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"
SQL["report_json"] = f"""WITH {DISTRIBUTION}, up AS (
  SELECT "count" AS x, row_number() OVER (ORDER BY "count", label_id) AS i FROM distribution)
SELECT (SELECT round(2.0 * sum(i * x) / CAST(count(*) * sum(x) AS DOUBLE)
               - (count(*) + 1) / CAST(count(*) AS DOUBLE), 6) FROM up) AS gini,
       round(sum("count") FILTER (position <= 3) / CAST(sum("count") AS DOUBLE), 6) AS head_ratio,
       count(*) FILTER (support < 1.0) AS tail_labels,
       CAST(sum("count") AS BIGINT) AS label_instances FROM distribution"""

# Prediction traffic

SQL["request_count"] = f"""WITH {LOG}
SELECT method, endpoint, status, count(*) AS "count" FROM v_log GROUP BY 1, 2, 3"""
SQL["prediction_volume"] = f"""WITH {LOG}
SELECT model_type, count(*) AS "count" FROM v_log GROUP BY 1"""

BOUNDS = (
    "bounds AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{le!r}', CAST({le!r} AS DOUBLE))" for le in BUCKETS)
    + f", ('{OPEN_BUCKET}', CAST('inf' AS DOUBLE))) AS t(le, upto))"
)


def _histogram(rows: str, value: str, by: list[str], where: str) -> str:
    keys = ", ".join(by)
    return f"""SELECT {keys}, le, count(*) FILTER ({value} <= upto) AS cumulative, count(*) AS total,
       round(sum({value}), 6) AS "sum" FROM {rows}, bounds WHERE {where} GROUP BY {keys}, le"""


SQL["latency_histogram"] = (
    f"WITH {LOG}, {BOUNDS} " + _histogram("v_log", "latency_sec", ["endpoint"], "true")
)
SQL["inference_histogram"] = (
    f"WITH {LOG}, {BOUNDS} "
    + _histogram("v_log", "latency_sec", ["model_type"], "status < 400")
)
SQL["confidence_histogram"] = (
    f"WITH {RANKED}, {BOUNDS}, seen AS (SELECT 'transformation' AS model_type, name AS genre, "
    "score AS confidence FROM ranked WHERE rank <= 3 AND score > 0.1) "
    + _histogram("seen", "confidence", ["model_type", "genre"], "true")
)


def _windows(aggregates: str, by: list[str], where: str = "true") -> str:
    keys = ", ".join(by)
    return f"""WITH {LOG}, placed AS (
  SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS back,
         CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS slot FROM v_log WHERE {where})
SELECT slot - back * 600 AS window_start, {keys}, {aggregates} FROM placed GROUP BY 1, {keys}"""


PER_SECOND = "round(count(*) / CAST(3600 AS DOUBLE), 9) AS rate"
SQL["request_rate"] = _windows(PER_SECOND, ["method", "endpoint", "status"])
SQL["volume_rate"] = _windows(PER_SECOND, ["model_type"])
SQL["mean_inference_time"] = _windows(
    "round(avg(latency_sec), 12) AS mean_sec", ["model_type"], "status < 400"
)


def _minute_windows(aggregates: str, by: list[str], where: str = "true") -> str:
    """Windows of a minute every ten seconds."""
    keys = ", ".join(by)
    return f"""WITH {LOG}, placed AS (
  SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS back,
         CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 AS slot FROM v_log WHERE {where})
SELECT slot - back * 10 AS window_start, {keys}, {aggregates} FROM placed GROUP BY 1, {keys}"""


PER_SECOND_OF_MINUTE = "round(count(*) / CAST(60 AS DOUBLE), 9) AS rate"
SQL["request_rate_minute"] = _minute_windows(
    PER_SECOND_OF_MINUTE, ["method", "endpoint", "status"]
)
SQL["volume_rate_minute"] = _minute_windows(PER_SECOND_OF_MINUTE, ["model_type"])
SQL["mean_inference_time_minute"] = _minute_windows(
    "round(avg(latency_sec), 12) AS mean_sec", ["model_type"], "status < 400"
)
SQL["mean_confidence"] = f"""WITH {LOG}
SELECT round(avg(confidence), 6) AS mean_confidence FROM v_log WHERE status < 400 AND confidence > 0.1"""


def _series(metric: str, value: str, by: list[str], where: str) -> str:
    labels = " || ',' || ".join(f"'{n}=' || {n}" for n in sorted(by))
    keys = ", ".join(by)
    return f"""
SELECT '{metric}_bucket' AS metric, {labels} AS labels, le,
       CAST(count(*) FILTER ({value} <= upto) AS DOUBLE) AS value
FROM v_log, bounds WHERE {where} GROUP BY {keys}, le
UNION ALL SELECT '{metric}_sum', {labels}, '', round(sum({value}), 6) FROM v_log WHERE {where} GROUP BY {keys}
UNION ALL SELECT '{metric}_count', {labels}, '', CAST(count(*) AS DOUBLE) FROM v_log WHERE {where} GROUP BY {keys}"""


SQL["metrics_snapshot"] = (
    f"WITH {LOG}, {BOUNDS} "
    "SELECT 'http_requests_total' AS metric, 'endpoint=' || endpoint || ',method=' || method "
    "|| ',status=' || status AS labels, '' AS le, CAST(count(*) AS DOUBLE) AS value "
    "FROM v_log GROUP BY endpoint, method, status "
    "UNION ALL SELECT 'model_requests_total', 'model_type=' || model_type, '', "
    "CAST(count(*) AS DOUBLE) FROM v_log GROUP BY model_type UNION ALL "
    + _series("http_request_duration_seconds", "latency_sec", ["endpoint"], "true")
    + " UNION ALL "
    + _series("model_inference_duration_seconds", "latency_sec", ["model_type"], "status < 400")
    + " UNION ALL "
    + _series(
        "model_prediction_confidence", "confidence", ["model_type", "genre"],
        "status < 400 AND confidence > 0.1",
    )
)

# Streams give what the batch gives

SQL["stream_request_count"] = SQL["request_count"]
SQL["stream_latency_histogram"] = SQL["latency_histogram"]
SQL["stream_request_rate"] = SQL["request_rate"]
SQL["stream_mean_inference_time"] = SQL["mean_inference_time"]
SQL["stream_inference_histogram"] = SQL["inference_histogram"]
SQL["stream_prediction_volume"] = SQL["prediction_volume"]
SQL["stream_volume_rate"] = SQL["volume_rate"]
SQL["stream_mean_confidence"] = SQL["mean_confidence"]
SQL["stream_metrics_snapshot"] = SQL["metrics_snapshot"]

SQL["stream_current_snapshot"] = SQL["metrics_snapshot"]
SQL["stream_predictions"] = """SELECT 'POST' AS method, '/predict/transformation' AS endpoint,
  CASE WHEN text IS NULL OR length(text) < 10 OR length(text) > 10000 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''
       THEN 422 ELSE 200 END AS status, count(*) AS count
FROM documents GROUP BY 1, 2, 3"""
