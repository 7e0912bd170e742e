"""DuckDB SQL fragments for the oracle: the FIXTURES adapters as CTEs.

These mirror ``scorelake.sources.testdata`` column for column so that each
oracle query can be written as plain SQL over the driver's views.
"""

from __future__ import annotations

from ..functions import fixed

USERS = """users AS (
  SELECT c.c_custkey AS usuario_id, c.c_name AS nombre, 10 + c.c_custkey % 80 AS edad,
         n.n_name AS distrito, c.c_mktsegment AS nivel_educativo
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

EVALUATIONS = """evaluations AS (
  SELECT o_orderkey AS evaluacion_id, o_custkey AS usuario_id, o_orderdate AS fecha FROM orders)"""

PREDICTIONS = """predictions AS (
  SELECT l_orderkey AS evaluacion_id,
         CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (10.0 * COUNT(*)) AS p_default
  FROM lineitem GROUP BY l_orderkey)"""

LINE_PREDICTIONS = """line_predictions AS (
  SELECT l_orderkey AS evaluacion_id, l_linenumber AS linea,
         CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10.0 AS p
  FROM lineitem)"""

ANSWERS = """answer_events AS (
  SELECT l_suppkey * 6 + l_orderkey % 6 AS applicant,
         'q' || lpad(CAST(CAST(l_partkey % 30 + 1 AS INTEGER) AS VARCHAR), 2, '0') AS item,
         CAST(l_quantity % 5 + 1 AS INTEGER) AS level,
         l_shipdate, l_linenumber, l_quantity, l_partkey, l_orderkey
  FROM lineitem),
answers AS (
  SELECT applicant, item, level, l_shipdate AS answered_at FROM answer_events
  QUALIFY row_number() OVER (PARTITION BY applicant, item
          ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC,
                   l_orderkey DESC) = 1)"""

TRAINING = """training AS (
  SELECT d.doc_id AS id, d.source AS distrito, d.lang AS nivel,
         CAST(length(bin(d.n_chars)) AS BIGINT) AS tamano,
         CASE WHEN l.quality = 0 THEN 'Sí' ELSE 'No' END AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_items() -> str:
    rows = []
    for i, (q, pillar, subdim, rev, intensity) in enumerate(fixed.ITEMS):
        rows.append(f"({sql_str(fixed.item_code(i + 1))}, {sql_str(q)}, {sql_str(pillar)}, "
                    f"{sql_str(subdim)}, {'TRUE' if rev else 'FALSE'}, {sql_str(intensity)})")
    return ("items(item, question, pillar, subdim, reverse, intensity) AS (VALUES "
            + ", ".join(rows) + ")")



def policy_case(p: str, field: str) -> str:
    idx = {"estado": 1, "tramo": 2, "monto": 3}[field]
    parts = []
    for rule in fixed.POLICY[:-1]:
        v = rule[idx]
        val = f"CAST({v} AS DOUBLE)" if field == "monto" else sql_str(v)
        parts.append(f"WHEN {p} < CAST({rule[0]!r} AS DOUBLE) THEN {val}")
    last = fixed.POLICY[-1][idx]
    last_sql = f"CAST({last} AS DOUBLE)" if field == "monto" else sql_str(last)
    return "CASE " + " ".join(parts) + f" ELSE {last_sql} END"


def policy_cols(p: str) -> str:
    return (f"{policy_case(p, 'estado')} AS estado, {policy_case(p, 'tramo')} AS tramo, "
            f"{policy_case(p, 'monto')} AS monto")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def level_name_sql(level: str) -> str:
    return f"{sql_list(fixed.LIKERT_LEVELS)}[{level}]"


def qid(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def export_cte() -> str:
    """Raw questionnaire export (needs the ANSWERS CTE)."""
    from ..operators.prepare import QUESTION_HEADERS
    cols = [
        "applicant",
        "strftime(max(answered_at), '%Y/%m/%d %H:%M:%S') AS \"Marca temporal\"",
        "'Acepto' AS \"Consentimiento\"",
        "10 + applicant % 80 AS \"EDAD\"",
        f"{sql_list(fixed.TRAIN_JOBS)}[applicant % {len(fixed.TRAIN_JOBS)} + 1] AS \"SITUACION LABORAL\"",
        f"{sql_list(fixed.TRAIN_DISTRICTS)}[applicant % {len(fixed.TRAIN_DISTRICTS)} + 1] AS \"DISTRITO DE RESIDENCIA\"",
        f"{sql_list(fixed.TRAIN_EDUCATION)}[applicant % {len(fixed.TRAIN_EDUCATION)} + 1] AS \"NIVEL EDUCATIVO\"",
    ]
    for code, header in zip(fixed.ITEM_CODES, QUESTION_HEADERS):
        cols.append(f"max(CASE WHEN item = '{code}' THEN {level_name_sql('level')} END) AS {qid(header)}")
    cols.append(f"CAST(NULL AS VARCHAR) AS {qid(fixed.PAYMENT_QUESTION)}")
    return "export AS (SELECT " + ",\n  ".join(cols) + "\nFROM answers GROUP BY applicant)"


def r6(x: str) -> str:
    """round to 6 decimals; ``+ 0.0`` turns DuckDB's -0.0 into 0.0 like Spark."""
    return f"(round({x}, 6) + 0.0)"
