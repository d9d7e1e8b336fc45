"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB with the test tables registered as views. The fixture
views are inlined as CTEs so every statement is self-contained.
"""

from __future__ import annotations

COMPLAINTS_CTE = """
complaints AS (
  SELECT o.o_orderkey AS row_id,
    CAST(o.o_orderkey AS VARCHAR) AS NU_REGISTRO,
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED'
         THEN CASE o.o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' Outros ' ELSE 'OUTRO' END
         ELSE o.o_orderpriority END AS DS_ASSUNTO,
    CAST(o.o_custkey AS VARCHAR) AS CD_USUARIO,
    CASE WHEN o.o_orderstatus <> 'P' THEN c.c_mktsegment
         WHEN o.o_orderkey % 3 = 0 THEN 'OUTROS (DETALHAR)'
         WHEN o.o_orderkey % 3 = 1 THEN NULL ELSE '  ' END AS SUB_ASSUNTO,
    'pedido ' || o.o_orderpriority || ' situacao ' || o.o_orderstatus AS DS_OBSERVACAO,
    CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE o.o_orderdate END AS DT_REGISTRO_ATENDIMENTO,
    n.n_name AS DS_FILIAL, r.r_name AS OPERADORA,
    o.o_orderdate AS _orderdate, c.c_mktsegment AS _segment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

# strip(): python str.strip on whitespace
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


NEEDS_CAT = "({c} IS NULL OR upper(" + _strip("{c}") + ") IN ('', 'OUTROS', 'OUTRO'))"
NEEDS_SUB = "({c} IS NULL OR " + _strip("{c}") + " = '' OR contains(upper({c}), 'OUTRO'))"
IS_BLANK = "({c} IS NULL OR " + _strip("{c}") + " = '')"
HAS_OUTRO = "coalesce(contains(lower({c}), 'outro'), false)"


def needs_cat(c: str) -> str:
    return NEEDS_CAT.format(c=c)


def needs_sub(c: str) -> str:
    return NEEDS_SUB.format(c=c)


def is_blank(c: str) -> str:
    return IS_BLANK.format(c=c)


def has_outro(c: str) -> str:
    return HAS_OUTRO.format(c=c)


def with_complaints(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([COMPLAINTS_CTE, *extra_ctes])
    return f"WITH {ctes}\n{body}"


WEEK = "CAST(date_trunc('week', DT_REGISTRO_ATENDIMENTO) AS DATE)"
MONTH = "CAST(date_trunc('month', DT_REGISTRO_ATENDIMENTO) AS DATE)"

MONTHLY_CTE = f"""
monthly AS (
  SELECT {MONTH} AS month, strftime({MONTH}, '%Y-%m') AS month_key,
         strftime({MONTH}, '%b/%Y') AS month_label, count(*) AS n
  FROM complaints WHERE DT_REGISTRO_ATENDIMENTO IS NOT NULL GROUP BY ALL)"""

WEEKLY_CTE = f"""
weekly AS (
  SELECT {WEEK} AS week_start, {WEEK} + 6 AS week_end,
         strftime({WEEK}, '%d/%m') || '-' || strftime({WEEK} + 6, '%d/%m') AS week_label,
         count(*) AS n
  FROM complaints WHERE DT_REGISTRO_ATENDIMENTO IS NOT NULL GROUP BY ALL)"""


def pct(new: str, old: str) -> str:
    return (f"CASE WHEN {old} <> 0 THEN (CAST({new} AS DOUBLE) - CAST({old} AS DOUBLE))"
            f" / CAST({old} AS DOUBLE) * 100.0 END")


def trend(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN 'AUMENTO' WHEN {p} < 0 THEN 'REDUÇÃO' ELSE 'ESTÁVEL' END"


def last_two(counts_cte_name: str, period: str, label: str) -> str:
    p = pct("count_2", "count_1")
    return f"""
SELECT period_1, period_2, label_1, label_2, count_1, count_2,
       round({p}, 4) AS pct_change, count_2 - count_1 AS abs_change, {trend(p)} AS trend
FROM (SELECT min({period}) AS period_1, max({period}) AS period_2,
             arg_min({label}, {period}) AS label_1, arg_max({label}, {period}) AS label_2,
             arg_min(n, {period}) AS count_1, arg_max(n, {period}) AS count_2
      FROM (SELECT * FROM {counts_cte_name} ORDER BY {period} DESC LIMIT 2)) t
WHERE period_2 IS NOT NULL"""


def top_per_period(period_expr: str, k: int = 5) -> str:
    return f"""
top AS (
  SELECT * FROM (
    SELECT period, label, n,
           row_number() OVER (PARTITION BY period ORDER BY n DESC, label) AS rank
    FROM (SELECT {period_expr} AS period, DS_ASSUNTO AS label, count(*) AS n
          FROM complaints
          WHERE DT_REGISTRO_ATENDIMENTO IS NOT NULL AND DS_ASSUNTO IS NOT NULL
          GROUP BY ALL)) WHERE rank <= {k})"""


def ranking_sql(col: str, where: str = "TRUE", top: int | None = None) -> str:
    lim = f" WHERE rank <= {top}" if top else ""
    return with_complaints(f"""
SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, n,
         round(n * 100.0 / sum(n) OVER (), 2) AS share_pct
  FROM (SELECT {col} AS label, count(*) AS n FROM complaints
        WHERE {col} IS NOT NULL AND ({where}) GROUP BY ALL)){lim}""")


F2 = f"(NOT upper(DS_ASSUNTO) IN ('OUTROS', 'OUTRO') AND DS_ASSUNTO IS NOT NULL AND {_strip('DS_ASSUNTO')} <> '')"
F3 = (f"(NOT coalesce(contains(upper(SUB_ASSUNTO), 'OUTRO'), false) AND SUB_ASSUNTO IS NOT NULL"
      f" AND {_strip('SUB_ASSUNTO')} <> '')")

KPI_FILTER_START = "1996-01-01"
KPI_FILTER_END = "1998-12-31"
KPI_FILTER_BRANCHES = ("NATION_1", "NATION_7", "NATION_13", "NATION_24")


def kpi_sql(where: str = "TRUE") -> str:
    return with_complaints(f"""
SELECT count(*) AS total, count(DISTINCT DS_ASSUNTO) AS n_categories,
       count(DISTINCT DS_FILIAL) AS n_branches,
       CAST(floor((epoch_us(max(DT_REGISTRO_ATENDIMENTO)) - epoch_us(min(DT_REGISTRO_ATENDIMENTO)))
                  / 86400000000) AS BIGINT) AS period_days
FROM complaints WHERE {where}""")


def _branches_in() -> str:
    return ", ".join(f"'{b}'" for b in KPI_FILTER_BRANCHES)


SQL: dict[str, str] = {
    "monthly_counts": with_complaints("SELECT * FROM monthly", MONTHLY_CTE),
    "monthly_counts_report": with_complaints(f"""
SELECT {MONTH} AS month, strftime({MONTH}, '%Y-%m') AS month_key,
       strftime({MONTH}, '%b/%Y') AS month_label, count(*) AS n
FROM complaints GROUP BY ALL"""),
    "weekly_counts": with_complaints("SELECT * FROM weekly", WEEKLY_CTE),
    "monthly_change": with_complaints(f"""
SELECT month, month_label, n, prev_n, round({pct('n', 'prev_n')}, 4) AS pct_change,
       (n + prev_n) / 2.0 AS midpoint,
       coalesce({pct('n', 'prev_n')} <> 0, false) AS annotated
FROM (SELECT *, lag(n) OVER (ORDER BY month) AS prev_n FROM monthly)""", MONTHLY_CTE),
    "last_two_months": with_complaints(last_two("monthly", "month", "month_key"), MONTHLY_CTE),
    "last_two_weeks": with_complaints(last_two("weekly", "week_start", "week_label"), WEEKLY_CTE),
    "top5_weekly": with_complaints(
        "SELECT period AS week_start, CAST(rank AS INTEGER) AS rank, label, n FROM top",
        top_per_period(WEEK)),
    "top5_monthly_steps": with_complaints(f"""
SELECT period AS month, CAST(rank AS INTEGER) AS rank, label, n,
       round({pct('n', 'lag(n) OVER (PARTITION BY period ORDER BY rank)')}, 4) AS step_pct
FROM top""", top_per_period(MONTH)),
    "period_top5_nested": with_complaints("""
SELECT w.week_start, w.week_label, w.n, t.top5
FROM weekly w LEFT JOIN (
  SELECT period AS week_start,
         string_agg(label || ': ' || CAST(n AS VARCHAR), '; ' ORDER BY rank) AS top5
  FROM top GROUP BY period) t ON w.week_start = t.week_start""", WEEKLY_CTE, top_per_period(WEEK)),
    "peak_weeks": with_complaints("""
SELECT week_start, week_label, n, round(mean_n, 4) AS mean_n, round(std_n, 4) AS std_n
FROM (SELECT *, avg(n) OVER () AS mean_n, stddev_samp(n) OVER () AS std_n FROM weekly)
WHERE n > mean_n + std_n""", WEEKLY_CTE),
    "category_ranking": ranking_sql("DS_ASSUNTO"),
    "category_ranking_specific": ranking_sql("DS_ASSUNTO", F2),
    "subcategory_ranking": ranking_sql("SUB_ASSUNTO"),
    "subcategory_ranking_specific": ranking_sql("SUB_ASSUNTO", F3),
    "subcategory_top10": ranking_sql("SUB_ASSUNTO", "TRUE", 10),
    "branch_ranking": ranking_sql("DS_FILIAL"),
    "operator_ranking": ranking_sql("OPERADORA"),
    "kpi_row": kpi_sql(),
    "kpi_row_filtered": kpi_sql(
        f"DT_REGISTRO_ATENDIMENTO >= TIMESTAMP '{KPI_FILTER_START}' "
        f"AND DT_REGISTRO_ATENDIMENTO <= TIMESTAMP '{KPI_FILTER_END}' "
        f"AND DS_FILIAL IN ({_branches_in()})"),
    "kpi_row_partitioned": kpi_sql(
        f"DT_REGISTRO_ATENDIMENTO >= TIMESTAMP '{KPI_FILTER_START}' "
        f"AND DT_REGISTRO_ATENDIMENTO <= TIMESTAMP '{KPI_FILTER_END}'"),
    "unclassified_counters": with_complaints(f"""
SELECT count_if({needs_cat('DS_ASSUNTO')}) AS categories_unclassified,
       count_if({needs_sub('SUB_ASSUNTO')}) AS subcategories_unclassified,
       count_if({is_blank('DS_ASSUNTO')}) + count_if({is_blank('SUB_ASSUNTO')}) AS blank_fields
FROM complaints"""),
    "classification_stats": with_complaints(f"""
SELECT count(*) AS total, count_if({needs_cat('DS_ASSUNTO')}) AS unclassified,
       count(DISTINCT DS_ASSUNTO) AS distinct_labels FROM complaints"""),
}

CANON = ("row_id, NU_REGISTRO, DS_ASSUNTO, CD_USUARIO, SUB_ASSUNTO, DS_OBSERVACAO, "
         "DT_REGISTRO_ATENDIMENTO, DS_FILIAL")
SOURCES_CTE = f"""
src AS (
  SELECT {CANON}, OPERADORA, 0 AS source_ord, 'source0' AS source_name
  FROM complaints WHERE _orderdate < TIMESTAMP '2000-01-01'
  UNION ALL
  SELECT {CANON}, NULL AS OPERADORA, 1 AS source_ord, 'source1' AS source_name
  FROM complaints WHERE _orderdate >= TIMESTAMP '1999-01-01')"""

REQUIRED = ["NU_REGISTRO", "DS_ASSUNTO", "CD_USUARIO", "SUB_ASSUNTO", "DS_OBSERVACAO",
            "DT_REGISTRO_ATENDIMENTO", "DS_FILIAL"]

SQL.update({
    "dedupe_keep_first": with_complaints("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY NU_REGISTRO ORDER BY source_ord, row_id) AS rn FROM src)
WHERE rn = 1""", SOURCES_CTE),
    "ingest_stats": with_complaints("""
SELECT 'rows' AS metric, 'source0' AS source_name, CAST(s0 AS BIGINT) AS n FROM tot
UNION ALL SELECT 'rows', 'source1', CAST(s1 AS BIGINT) FROM tot
UNION ALL SELECT 'total_before', NULL, CAST(before AS BIGINT) FROM tot
UNION ALL SELECT 'duplicates_removed', NULL, CAST(before - after AS BIGINT) FROM tot
UNION ALL SELECT 'total_after', NULL, CAST(after AS BIGINT) FROM tot""", SOURCES_CTE, """
tot AS (
  SELECT sum(copies) AS before, count(*) AS after, sum(s0) AS s0, sum(s1) AS s1
  FROM (SELECT NU_REGISTRO, count(*) AS copies, count_if(source_ord = 0) AS s0,
               count_if(source_ord = 1) AS s1 FROM src GROUP BY 1))"""),
    "quality_issues": with_complaints(f"""
SELECT 'error' AS severity, 'duplicate_key' AS rule, 'NU_REGISTRO' AS "column", n, sample
FROM (SELECT (SELECT count(*) FROM dups) AS n,
             (SELECT string_agg(NU_REGISTRO, ', ' ORDER BY NU_REGISTRO NULLS FIRST)
              FROM (SELECT NU_REGISTRO FROM dups ORDER BY NU_REGISTRO NULLS FIRST LIMIT 10)) AS sample)
WHERE n > 0
UNION ALL
SELECT 'error', 'null_values', "column", CAST(n AS BIGINT), NULL FROM (
  UNPIVOT (SELECT {', '.join(f'count_if({c} IS NULL) AS {c}' for c in REQUIRED)} FROM src)
  ON {', '.join(REQUIRED)} INTO NAME "column" VALUE n) WHERE n > 0
UNION ALL
SELECT 'warning', 'null_dates', 'DT_REGISTRO_ATENDIMENTO', n, NULL
FROM (SELECT count_if(DT_REGISTRO_ATENDIMENTO IS NULL) AS n FROM src) WHERE n > 0""",
        SOURCES_CTE,
        "dups AS (SELECT NU_REGISTRO FROM src GROUP BY 1 HAVING count(*) > 1)"),
    "training_profile": with_complaints("""
SELECT metric, CAST(n AS BIGINT) AS n,
       CASE WHEN metric = 'distinct_labels' THEN NULL ELSE round(n * 100.0 / total, 2) END AS pct
FROM (
  SELECT total, unnest(['valid', 'blank', 'outros', 'distinct_labels', 'cov_DS_OBSERVACAO']) AS metric,
         unnest([total - blank - outros, blank, outros, distinct_labels, cov]) AS n
  FROM (SELECT count(*) AS total, count_if(DS_ASSUNTO IS NULL) AS blank,
               count_if(coalesce(upper(DS_ASSUNTO) IN ('OUTROS', 'OUTRO'), false)) AS outros,
               count(DISTINCT DS_ASSUNTO) AS distinct_labels, count(DS_OBSERVACAO) AS cov
        FROM complaints))"""),
    "date_coercion": """
SELECT NU_REGISTRO, raw,
       coalesce(try_strptime(raw, '%d/%m/%Y %H:%M:%S'), try_strptime(raw, '%d/%m/%Y %H:%M'),
                try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%Y-%m-%d %H:%M:%S'),
                try_strptime(raw, '%Y-%m-%dT%H:%M:%S'), try_strptime(raw, '%Y-%m-%d'))
         AS DT_REGISTRO_ATENDIMENTO
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS NU_REGISTRO,
             CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
                                 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS raw
      FROM orders)""",
})

# ---- vectors / kNN -----------------------------------------------------------------
VECTORS_CTES = ["""
sv AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'))
           <= ceil(count(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE)) AS is_test
  FROM embeddings)""", """
nv AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM sv)"""]


def knn_ctes(k: int = 5) -> list[str]:
    return VECTORS_CTES + [f"""
top AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS INTEGER) AS rank
    FROM (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label AS ref_label,
                 CASE WHEN q.nrm = 0 OR r.nrm = 0 THEN 0.0
                      ELSE list_dot_product(q.e, r.e) / (q.nrm * r.nrm) END AS similarity
          FROM nv q JOIN nv r ON q.is_test AND NOT r.is_test))
  WHERE rank <= {k})"""]


def vote_cte(threshold: float) -> str:
    return f"""
vote AS (
  SELECT query_id, ref_label AS predicted, score, votes, score / votes AS confidence,
         score / votes >= {threshold} AS accepted,
         CASE WHEN score / votes >= {threshold} THEN 'auto' ELSE 'manual_review' END AS method
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank) AS w
        FROM (SELECT query_id, ref_label, sum(similarity) AS score, count(*) AS votes,
                     min(rank) AS best_rank FROM top GROUP BY ALL))
  WHERE w = 1)"""


def with_ctes(body: str, ctes: list[str]) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


SWEEP = [0.26, 0.30, 0.33, 0.35, 0.38, 0.40, 0.45]
FILL = 0.35
PRED_CTE = """
pred AS (SELECT s.vec_id AS query_id, s.label AS truth, v.predicted, v.confidence
         FROM sv s LEFT JOIN vote v ON s.vec_id = v.query_id WHERE s.is_test)"""


def _acc_sql() -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) AS total, "
        f"count_if(confidence >= {t} AND predicted IS NOT NULL) AS classified, "
        f"count_if(confidence >= {t} AND CAST(predicted AS VARCHAR) = CAST(truth AS VARCHAR)) AS correct FROM pred"
        for t in SWEEP)
    return f"""
acc AS (
  SELECT threshold, total, classified, correct,
         round(classified * 100.0 / total, 4) AS coverage_pct,
         round(CASE WHEN classified > 0 THEN correct * 100.0 / classified ELSE 0.0 END, 4) AS accuracy_classified_pct,
         round(correct * 100.0 / total, 4) AS accuracy_total_pct
  FROM ({rows}))"""


SQL.update({
    "knn_topk": with_ctes("SELECT query_id, rank, ref_id, ref_label, round(similarity, 6) AS similarity FROM top",
                          knn_ctes()),
    "knn_vote": with_ctes("""
SELECT query_id, predicted, round(score, 6) AS score, votes, round(confidence, 6) AS confidence,
       accepted, method FROM vote""", knn_ctes() + [vote_cte(FILL)]),
    "knn_fill": with_ctes("""
SELECT s.vec_id,
       CASE WHEN NOT s.is_test THEN s.label WHEN coalesce(v.accepted, false) THEN v.predicted END AS label,
       CASE WHEN s.is_test THEN v.confidence END AS label_confidence,
       CASE WHEN s.is_test THEN CASE WHEN coalesce(v.accepted, false) THEN 'auto' ELSE 'manual_review' END END
         AS label_method,
       CASE WHEN s.is_test THEN NOT coalesce(v.accepted, false) ELSE false END AS needs_review
FROM sv s LEFT JOIN vote v ON s.vec_id = v.query_id""", knn_ctes() + [vote_cte(FILL)]),
    "knn_nearest": with_ctes(f"""
SELECT query_id, ref_label AS predicted, round(similarity, 6) AS confidence,
       similarity >= {FILL} AS accepted FROM top""", knn_ctes(1)),
    "knn_run_counts": with_ctes("SELECT method, count(*) AS n FROM vote GROUP BY 1",
                                knn_ctes() + [vote_cte(FILL)]),
    "threshold_accuracy": with_ctes("SELECT * FROM acc",
                                    knn_ctes() + [vote_cte(FILL), PRED_CTE, _acc_sql()]),
    "confusion_pairs": with_ctes(f"""
SELECT CAST(truth AS VARCHAR) AS real, CAST(predicted AS VARCHAR) AS predicted, count(*) AS n
FROM pred WHERE confidence >= {FILL} AND predicted IS NOT NULL
  AND CAST(truth AS VARCHAR) <> CAST(predicted AS VARCHAR) GROUP BY ALL""",
                                 knn_ctes() + [vote_cte(FILL), PRED_CTE]),
    "best_threshold": with_ctes("SELECT * FROM acc ORDER BY accuracy_total_pct DESC, threshold LIMIT 1",
                                knn_ctes() + [vote_cte(FILL), PRED_CTE, _acc_sql()]),
    "split_80_20": with_ctes("SELECT vec_id, label, is_test FROM sv", VECTORS_CTES[:1]),
})

PARTIAL_N = 40


def _partial(order: str, k: int = 5, accepted: bool = False) -> str:
    return with_ctes(f"""
SELECT s.vec_id, coalesce(p.predicted, CASE WHEN s.is_test THEN NULL ELSE s.label END) AS label,
       p.confidence AS relabel_confidence
FROM sv s LEFT JOIN (SELECT * FROM (
  SELECT query_id, predicted, round(confidence, 6) AS confidence, accepted FROM vote
  ORDER BY {order} LIMIT {PARTIAL_N}) {"WHERE accepted" if accepted else ""}) p ON s.vec_id = p.query_id""",
        knn_ctes(k) + [vote_cte(FILL)])


AFTER_CTE = """
after AS (
  SELECT NU_REGISTRO,
         CASE WHEN coalesce(contains(upper(SUB_ASSUNTO), 'OUTRO'), false) AND row_id % 10 = 0 THEN SUB_ASSUNTO
              WHEN coalesce(contains(upper(SUB_ASSUNTO), 'OUTRO'), false) AND row_id % 10 = 5 THEN 'NEW'
              WHEN coalesce(contains(upper(SUB_ASSUNTO), 'OUTRO'), false) THEN _segment
              ELSE SUB_ASSUNTO END AS SUB_ASSUNTO
  FROM complaints)"""
BA_CTE = f"""
ba AS (
  SELECT label, coalesce(b.before, 0) AS before, coalesce(a.after, 0) AS after,
         coalesce(a.after, 0) - coalesce(b.before, 0) AS difference,
         CASE WHEN coalesce(b.before, 0) > 0
              THEN round((coalesce(a.after, 0) - coalesce(b.before, 0)) * 100.0 / b.before, 4) END AS growth_pct,
         coalesce(b.before, 0) = 0 AS is_new
  FROM (SELECT SUB_ASSUNTO AS label, count(*) AS before FROM complaints
        WHERE NOT {has_outro('SUB_ASSUNTO')} AND SUB_ASSUNTO IS NOT NULL GROUP BY 1) b
  FULL OUTER JOIN (SELECT SUB_ASSUNTO AS label, count(*) AS after FROM after
                   WHERE SUB_ASSUNTO IS NOT NULL GROUP BY 1) a USING (label))"""

COMPLAINT_TEXTS_CTE = """
ct AS (
  SELECT d.doc_id AS row_id, CAST(d.doc_id AS VARCHAR) AS NU_REGISTRO,
         CASE l.toxic WHEN 1 THEN 'TOXIC' WHEN 0 THEN 'CLEAN' END AS DS_ASSUNTO,
         CASE l.quality WHEN 1 THEN 'GOOD' WHEN 0 THEN 'POOR' ELSE 'OUTROS' END AS SUB_ASSUNTO,
         d.text AS DS_OBSERVACAO, d.lang AS DS_MOTIVO, d.source AS DS_FILIAL
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _strip_sql(x: str) -> str:
    return _strip(x)


NGRAMS = ("w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')) "
          "ELSE [] END || CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), "
          "lambda i: array_to_string(w[i:i+2], ' ')) ELSE [] END")

SQL.update({
    "partial_relabel_topn": _partial("confidence DESC, query_id"),
    "partial_relabel_firstn": _partial("query_id", 3, True),
    "before_after": with_complaints("SELECT * FROM ba", AFTER_CTE, BA_CTE),
    "before_after_totals": with_complaints("""
SELECT sum(before) AS total_before, sum(after) AS total_after, sum(after) - sum(before) AS reclassified,
       count_if(difference > 0) AS labels_gaining,
       arg_max(label, (after, label)) AS largest_after_label,
       arg_max(label, (difference, label)) AS largest_gain_label, max(difference) AS largest_gain
FROM ba""", AFTER_CTE, BA_CTE),
    "reclassified_distribution": with_complaints(f"""
SELECT a.SUB_ASSUNTO AS label, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM complaints WHERE {has_outro('SUB_ASSUNTO')}), 2) AS pct
FROM complaints b JOIN after a ON b.NU_REGISTRO = a.NU_REGISTRO
WHERE {has_outro('b.SUB_ASSUNTO')} AND a.SUB_ASSUNTO IS NOT NULL GROUP BY 1""", AFTER_CTE),
    "remaining_outros": with_complaints(f"""
SELECT 'before' AS snapshot, count(*) AS total, count_if({has_outro('SUB_ASSUNTO')}) AS remaining,
       count(*) - count_if({has_outro('SUB_ASSUNTO')}) AS classified FROM complaints
UNION ALL
SELECT 'after', count(*), count_if({has_outro('SUB_ASSUNTO')}),
       count(*) - count_if({has_outro('SUB_ASSUNTO')}) FROM after""", AFTER_CTE),
    "outros_variants": with_complaints("""
SELECT SUB_ASSUNTO AS variant, count(*) AS n FROM complaints
WHERE coalesce(contains(upper(SUB_ASSUNTO), 'OUTRO'), false) GROUP BY 1"""),
    "composite_text": with_ctes(f"""
SELECT NU_REGISTRO, texto, coalesce(length({_strip('texto')}) >= 10, false) AS enough_text
FROM (SELECT NU_REGISTRO,
             substring(array_to_string(list_filter(
               [{_strip('DS_OBSERVACAO')}, {_strip('DS_MOTIVO')}, {_strip('SUB_ASSUNTO')}],
               lambda x: x IS NOT NULL AND length(x) > 5), ' '), 1, 2000) AS texto
      FROM ct)""", [COMPLAINT_TEXTS_CTE]),
    "label_normalised": with_complaints(f"""
SELECT NU_REGISTRO, DS_ASSUNTO, {_strip("translate(upper(DS_ASSUNTO), 'ÉÍÓ', 'EIO')")} AS normalised
FROM complaints"""),
    "needs_flags": with_complaints(f"""
SELECT NU_REGISTRO, DS_ASSUNTO, SUB_ASSUNTO, {needs_cat('DS_ASSUNTO')} AS needs_category,
       {needs_sub('SUB_ASSUNTO')} AS needs_subcategory, {has_outro('SUB_ASSUNTO')} AS has_outro
FROM complaints"""),
    "tfidf_terms": with_ctes(f"""
SELECT term, df, tf, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf
FROM (SELECT term, count(*) AS df, sum(c) AS tf FROM (
        SELECT term, doc, count(*) AS c FROM (
          SELECT doc, unnest({NGRAMS}) AS term FROM (
            SELECT row_id AS doc, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM train))
        GROUP BY ALL) GROUP BY term),
     (SELECT CAST(count(*) AS DOUBLE) AS n FROM train)
WHERE df >= 2 AND df <= 0.95 * n
ORDER BY tf DESC, term LIMIT 5000""", [COMPLAINT_TEXTS_CTE, f"""
train AS (SELECT row_id, concat_ws(' ', DS_ASSUNTO, DS_OBSERVACAO, DS_MOTIVO) AS t FROM ct
          WHERE NOT {has_outro('SUB_ASSUNTO')} AND SUB_ASSUNTO IS NOT NULL)"""]),
})

SAMPLE_TOTAL = 5000
AUDIT_HOURS = 24


def _strat(where: str, label: str, min_expr: str) -> str:
    return with_complaints(f"""
SELECT row_id, NU_REGISTRO, {label} FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST(row_id AS VARCHAR) || ':42')) AS rn,
         count(*) OVER (PARTITION BY {label}) AS c, count(*) OVER () AS n_all
  FROM complaints WHERE {where} AND {label} IS NOT NULL)
WHERE rn <= CASE WHEN n_all > {SAMPLE_TOTAL} THEN least(c, {min_expr}) ELSE c END""")


QA_CTE = f"""
qa AS (
  SELECT event_type AS query_type, value AS response_time_ms, ts AS executed_at FROM events
  WHERE ts > (SELECT max(ts) FROM events) - INTERVAL {AUDIT_HOURS} HOURS)"""

SQL.update({
    "stratified_sample": _strat(f"NOT {needs_cat('DS_ASSUNTO')}", "DS_ASSUNTO",
                                f"greatest(floor(c * {SAMPLE_TOTAL} / n_all), 10)"),
    "stratified_sample_b": _strat(f"NOT {needs_sub('SUB_ASSUNTO')}", "SUB_ASSUNTO",
                                  f"greatest(1, floor({SAMPLE_TOTAL} * c / n_all))"),
    "sample_200": with_complaints("""
SELECT row_id, NU_REGISTRO, DS_ASSUNTO FROM complaints
ORDER BY md5(CAST(row_id AS VARCHAR) || ':42') LIMIT 200"""),
    "sample_coverage": with_complaints(f"""
SELECT o.label, o.original, coalesce(s.sampled, 0) AS sampled,
       round(coalesce(s.sampled, 0) * 100.0 / o.original, 2) AS sampled_pct
FROM (SELECT DS_ASSUNTO AS label, count(*) AS original FROM complaints
      WHERE NOT {needs_cat('DS_ASSUNTO')} GROUP BY 1) o
LEFT JOIN (SELECT DS_ASSUNTO AS label, count(*) AS sampled FROM smp GROUP BY 1) s USING (label)""",
        "smp AS (" + _strat(f"NOT {needs_cat('DS_ASSUNTO')}", "DS_ASSUNTO",
                            f"greatest(floor(c * {SAMPLE_TOTAL} / n_all), 10)").split(COMPLAINTS_CTE, 1)[1]
        .lstrip() + ")"),
    "query_type_stats": with_ctes("""
SELECT query_type, count(*) AS n, round(avg(response_time_ms), 6) AS avg_response_time_ms
FROM qa GROUP BY 1""", [QA_CTE]),
    "query_stats": with_ctes("""
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_queries,
       round(coalesce(sum(CASE WHEN m IS NOT NULL AND m <> 0 THEN m ELSE 0.0 END) / count(*), 0.0), 6)
         AS avg_response_time_ms,
       count(*) AS n_types
FROM (SELECT query_type, count(*) AS n, avg(response_time_ms) AS m FROM qa GROUP BY 1)""", [QA_CTE]),
    "upload_history": """
SELECT 'orders_' || strftime(d, '%Y%m%d') || '.csv' AS filename, num_records, 'loader' AS "user",
       CAST(d + 1 AS TIMESTAMP) AS uploaded_at
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS num_records FROM orders GROUP BY 1)
ORDER BY uploaded_at DESC, filename LIMIT 10""",
    "stream_weekly_counts": """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n
FROM events GROUP BY ALL""",
    "stream_dedupe": with_complaints("""
SELECT NU_REGISTRO, DS_ASSUNTO, CD_USUARIO, SUB_ASSUNTO, DT_REGISTRO_ATENDIMENTO, DS_FILIAL
FROM complaints"""),
})

SQL["csv_ingest"] = with_complaints("""
SELECT * EXCLUDE (rn, row_id) REPLACE (CASE WHEN source_ord <> 0 THEN DS_OBSERVACAO ELSE
  'obs "' || CAST(row_id AS VARCHAR) || '"; a,b' || CASE WHEN row_id % 7 = 0 THEN chr(10) || 'segunda linha' ELSE '' END
  END AS DS_OBSERVACAO) FROM (
  SELECT *, row_number() OVER (PARTITION BY NU_REGISTRO ORDER BY source_ord, row_id) AS rn FROM src)
WHERE rn = 1""", SOURCES_CTE)

SQL["distinct_categories"] = with_complaints(
    "SELECT DISTINCT DS_ASSUNTO FROM complaints WHERE DS_ASSUNTO IS NOT NULL")


# ---- encoders, reference sets, labelling -------------------------------------------------
MD5_DIMS, REFERENCE_ROWS, LABEL = 384, 5000, 0.5


def _needs(c: str, sub: bool) -> str:
    return needs_sub(c) if sub else needs_cat(c)


TEXTS_CTE = f"""
tx AS (SELECT *, array_to_string(list_filter(
         [{_strip('DS_OBSERVACAO')}, {_strip('DS_MOTIVO')}, {_strip('SUB_ASSUNTO')}],
         lambda x: x IS NOT NULL AND length(x) > 5), ' ') AS texto FROM ct)"""


def _buckets(text: str) -> str:
    return (f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {MD5_DIMS})")


def vectors_cte(name: str, rows: str, fit: str) -> str:
    """(id, b, w): unit md5-bucket weights of ``rows`` (id, t), with idf from ``fit`` (id, t)."""
    return f"""
{name}_tf AS (SELECT id, b, count(*) AS c FROM (SELECT id, unnest({_buckets('t')}) AS b FROM {rows}) GROUP BY ALL),
{name}_idf AS (SELECT d.b, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) AS idf
  FROM (SELECT unnest(range({MD5_DIMS})) AS b) d
  LEFT JOIN (SELECT b, count(DISTINCT id) AS df FROM (SELECT id, unnest({_buckets('t')}) AS b FROM {fit})
             GROUP BY b) f USING (b), (SELECT count(*) AS n FROM {fit})),
{name}_w AS (SELECT id, b, c * idf AS w FROM {name}_tf JOIN {name}_idf USING (b)),
{name} AS (SELECT id, b, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0) AS w FROM {name}_w)"""


def drawn_cte(name: str, label: str, sub: bool) -> str:
    """(id, label, t): the stratified draw of valid references."""
    enough = "" if sub else f"AND coalesce(length({_strip('texto')}) >= 10, false)"
    least = f"greatest(1, floor(c * {REFERENCE_ROWS} / n))" if sub else f"greatest(floor(c * {REFERENCE_ROWS} / n), 10)"
    return f"""
{name}_valid AS (SELECT NU_REGISTRO AS id, {label} AS label, texto AS t FROM tx
  WHERE {label} IS NOT NULL AND NOT {_needs(label, sub)} {enough}),
{name} AS (SELECT id, label, t FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42')) AS r,
         count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM {name}_valid)
  WHERE r <= CASE WHEN n > {REFERENCE_ROWS} THEN least(c, {least}) ELSE c END)"""


def labelled_ctes(name: str, refs: str, queries: str, k: int = 5) -> list[str]:
    """{name}_vote (id, predicted, confidence, near): the vote of ``queries`` (id, t) by ``refs``."""
    return [vectors_cte(f"{name}_r", refs, refs), vectors_cte(f"{name}_q", queries, refs), f"""
{name}_top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) AS rank FROM (
  SELECT q.id AS qid, r.id AS rid, r.label, r.t, coalesce(s.s, 0.0) AS s
  FROM {queries} q CROSS JOIN {refs} r LEFT JOIN (
    SELECT a.id AS qid, b.id AS rid, sum(a.w * b.w) AS s FROM {name}_q a JOIN {name}_r b USING (b) GROUP BY ALL) s
    ON s.qid = q.id AND s.rid = r.id)),
{name}_near AS (SELECT qid, string_agg(substr(t, 1, 100) || '...', '|' ORDER BY rank) AS near
  FROM {name}_top WHERE rank <= 3 GROUP BY qid),
{name}_vote AS (SELECT qid AS id, label AS predicted, score / votes AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best) AS w FROM (
    SELECT qid, label, sum(s) AS score, count(*) AS votes, min(rank) AS best FROM {name}_top
    WHERE rank <= {k} GROUP BY ALL)) WHERE w = 1)"""]


def _labelled_columns(name: str, label: str, sub: bool) -> str:
    need, v = _needs(label, sub), f"{name}_v"
    return f"""
  CASE WHEN {need} AND coalesce({v}.confidence >= {LABEL}, false) THEN {v}.predicted ELSE {label} END AS {label},
  round({v}.confidence, 6) AS {name}_confidence,
  CASE WHEN {need} THEN CASE WHEN coalesce({v}.confidence >= {LABEL}, false) THEN 'auto' ELSE 'manual_review' END END
    AS {name}_method,
  {need} AND NOT coalesce({v}.confidence >= {LABEL}, false) AS {name}_needs_review"""


def _need_rows(name: str, label: str, sub: bool) -> str:
    return f"{name} AS (SELECT NU_REGISTRO AS id, texto AS t FROM tx WHERE {_needs(label, sub)})"


SQL.update({
    "hashed_embeddings": with_ctes("""
SELECT id AS NU_REGISTRO, CAST(b AS INTEGER) AS bucket, round(w, 6) AS weight FROM v WHERE w <> 0""",
        [COMPLAINT_TEXTS_CTE, TEXTS_CTE, "rows_ AS (SELECT NU_REGISTRO AS id, texto AS t FROM tx)",
         vectors_cte("v", "rows_", "rows_")]),
    "reference_set": with_ctes("""
SELECT id AS ref_id, label, t AS texto, CAST(b AS INTEGER) AS bucket, round(w, 6) AS weight
FROM v JOIN refs USING (id) WHERE w <> 0""",
        [COMPLAINT_TEXTS_CTE, TEXTS_CTE, drawn_cte("refs", "DS_ASSUNTO", False), vectors_cte("v", "refs", "refs")]),
    "reference_metadata": with_ctes(f"""
SELECT 'DS_ASSUNTO' AS label_column, (SELECT count(*) FROM refs) AS total_records, m.n AS original_dataset_size,
       m.n > {REFERENCE_ROWS} AS used_stratified_sample, 'md5-tf-idf' AS embedding_model,
       {MD5_DIMS} AS embedding_dimension, label, count(*) AS n
FROM refs, (SELECT count(*) AS n FROM refs_valid) m GROUP BY ALL""",
        [COMPLAINT_TEXTS_CTE, TEXTS_CTE, drawn_cte("refs", "DS_ASSUNTO", False)]),
    "autolabel_texts": with_ctes(f"""
SELECT NU_REGISTRO,{_labelled_columns('category', 'DS_ASSUNTO', False)},{_labelled_columns('subcategory', 'SUB_ASSUNTO', True)}
FROM tx LEFT JOIN category_vote category_v ON category_v.id = NU_REGISTRO
LEFT JOIN subcategory_vote subcategory_v ON subcategory_v.id = NU_REGISTRO""",
        [COMPLAINT_TEXTS_CTE, TEXTS_CTE, drawn_cte("c_refs", "DS_ASSUNTO", False), drawn_cte("s_refs", "SUB_ASSUNTO", True),
         _need_rows("c_need", "DS_ASSUNTO", False), _need_rows("s_need", "SUB_ASSUNTO", True),
         *labelled_ctes("category", "c_refs", "c_need"), *labelled_ctes("subcategory", "s_refs", "s_need")]),
    "probe_classify": with_ctes(f"""
SELECT p.item_id, CASE WHEN v.confidence >= {LABEL} THEN v.predicted END AS categoria,
       coalesce(round(v.confidence, 6), 0.0) AS confianca,
       CASE WHEN coalesce(v.confidence >= {LABEL}, false) THEN 'auto' ELSE 'manual_review' END AS metodo,
       coalesce(n.near, '') AS top_similares
FROM benchmark p LEFT JOIN probe_vote v ON v.id = p.item_id LEFT JOIN probe_near n ON n.qid = p.item_id""",
        [COMPLAINT_TEXTS_CTE, TEXTS_CTE, drawn_cte("refs", "DS_ASSUNTO", False),
         f"probes AS (SELECT item_id AS id, text AS t FROM benchmark WHERE coalesce(length({_strip('text')}) >= 10, false))",
         *labelled_ctes("probe", "refs", "probes")]),
    "forest_invariants": with_ctes(f"""
SELECT count(*) AS n_rows, count_if({has_outro('SUB_ASSUNTO')}) AS n_outros, 0 AS changed_others, 0 AS foreign_labels,
       count_if({has_outro('SUB_ASSUNTO')}) AS confident, count_if({has_outro('SUB_ASSUNTO')}) AS n_predicted,
       true AS min_below_mean, true AS mean_below_max, least(50, count_if({has_outro('SUB_ASSUNTO')})) AS written_partial
FROM ct""", [COMPLAINT_TEXTS_CTE]),
    "label_distribution": with_complaints("""
SELECT DS_ASSUNTO AS label, count(*) AS n FROM complaints WHERE DS_ASSUNTO IS NOT NULL GROUP BY 1"""),
    "valid_label_counts": with_complaints("""
SELECT SUB_ASSUNTO AS label, count(*) AS n, count(*) OVER () AS distinct_labels FROM complaints
WHERE SUB_ASSUNTO IS NOT NULL AND trim(SUB_ASSUNTO) <> '' AND NOT contains(upper(SUB_ASSUNTO), 'OUTRO') GROUP BY 1"""),
    "sample_fixed_n": with_complaints("""
SELECT row_id, NU_REGISTRO, DS_ASSUNTO FROM (
  SELECT *, row_number() OVER (PARTITION BY DS_ASSUNTO ORDER BY md5(CAST(row_id AS VARCHAR) || ':42')) AS r
  FROM complaints WHERE DS_ASSUNTO IS NOT NULL) WHERE r <= 25"""),
})
_VOC = SQL["tfidf_terms"]
_at = _VOC.index("\nSELECT term, df, tf, round(")
SQL["tfidf_vectors"] = _VOC[:_at] + ",\nvoc AS (" + _VOC[_at:].replace(
    "round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf", "ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf") + """),
tf AS (SELECT row_id, term, count(*) * any_value(idf) AS w FROM (
  SELECT row_id, unnest(""" + NGRAMS + """) AS term FROM (
    SELECT row_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]{2,}') AS w FROM train))
  JOIN voc USING (term) GROUP BY ALL)
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM tf"""

SQL.update({
    "upload_log": """
SELECT 'orders_' || strftime(d, '%Y%m%d') || '_' || o_orderstatus AS filename, num_records, 'loader' AS "user",
       CAST(d + 1 AS TIMESTAMP) AS uploaded_at
FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus, count(*) AS num_records FROM orders GROUP BY ALL)""",
    "query_log": """
SELECT event_type AS query_type, count(*) AS n, round(avg(c), 6) AS avg_response_time_ms
FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*)::DOUBLE AS c FROM events GROUP BY ALL) GROUP BY 1""",
    "csv_mixed_headers": with_complaints("""
SELECT NU_REGISTRO, DS_ASSUNTO, CASE WHEN row_id % 3 <> 2 THEN DS_FILIAL END AS DS_FILIAL FROM complaints"""),
    "csv_bad_rows": """
WITH k AS (SELECT *, o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS bad FROM orders)
SELECT CASE WHEN NOT bad THEN CAST(o_orderkey AS VARCHAR) END AS id,
       CASE WHEN NOT bad THEN CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'nota; com "aspas"' ELSE 'nota' END END AS nota,
       CASE WHEN NOT bad AND o_orderkey % 7 <> 0 THEN o_orderstatus END AS situacao,
       CASE WHEN bad THEN o_orderkey || ';nota;' || o_orderstatus || ';sobra' END AS raw_line,
       CASE WHEN bad THEN '4 fields, 3 expected' END AS reason FROM k""",
    "knn_pruned": SQL["knn_topk"],
    "stream_monthly_counts": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS n
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL""",
    "stream_dedupe_watermark": """
SELECT event_id, event_type, CASE WHEN day(ts) <= 5 THEN 2 ELSE 1 END::BIGINT AS n FROM events""",
    "export_json": with_complaints("""
SELECT NU_REGISTRO, DS_ASSUNTO, strftime(DT_REGISTRO_ATENDIMENTO, '%Y-%m-%dT%H:%M:%S') AS DT_REGISTRO_ATENDIMENTO
FROM complaints"""),
    "report_export": SQL["category_ranking"],
})
