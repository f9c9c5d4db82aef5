"""The test-table views of ``seatwise.sources.testdata`` written as SQL for the DuckDB oracle.

Each oracle statement is ``WITH <needed views> <query>``; ``with_views`` adds the views a query
names (and what they depend on) in dependency order.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "dept": """
        SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name,
               upper(substr(name, 1, 4)) AS code
        FROM (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL) s""",
    "member": """
        SELECT CAST(c.c_custkey + 1 AS BIGINT) AS id, c.c_name AS usn,
               concat('ID', CAST(c.c_custkey + 1 AS VARCHAR)) AS student_id,
               CAST(NULL AS VARCHAR) AS student_number,
               concat('Member ', CAST(c.c_custkey AS VARCHAR)) AS full_name,
               CASE c.c_nationkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS gender,
               CASE WHEN c.c_acctbal < -800 THEN 'Inactive' ELSE 'Active' END AS status,
               d.id AS department_id, CAST(c.c_nationkey AS BIGINT) AS program_id,
               CAST(CASE WHEN c.c_custkey % 4 = 1 THEN c.c_custkey % 97 END AS BIGINT) AS import_id,
               CASE WHEN c.c_custkey % 10 = 0 THEN 'Group A' END AS group_name,
               CAST(CASE WHEN c.c_custkey % 7 = 3 THEN c.c_custkey % 10 + 1 END AS BIGINT) AS bin_id,
               CAST(CASE WHEN c.c_custkey % 7 = 3 THEN c.c_custkey % 5 + 1 END AS BIGINT) AS slot_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.c_custkey * 1723) AS created_at,
               c.c_custkey % 50 = 7 AS is_deleted
        FROM customer c LEFT JOIN dept d ON c.c_mktsegment = d.name""",
    "bin": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, s_name AS name, CAST(3 + s_suppkey % 5 AS BIGINT) AS capacity,
               CAST(NULL AS VARCHAR) AS location, s_suppkey % 10 <> 9 AS is_active
        FROM supplier""",
    "slot": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS slot_name, '09:00 AM' AS start_time,
               '11:00 AM' AS end_time, 1 AS day_number
        FROM region""",
    "program": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_name AS code FROM nation""",
    "event_cfg": """
        SELECT event_type AS event_name, min(event_id) AS first_id FROM events GROUP BY event_type""",
    "facts": """
        SELECT event_id AS id, CAST(user_id + 1 AS BIGINT) AS member_id, event_type AS event_name,
               concat('Hall ', CAST(event_id % 7 AS VARCHAR)) AS bin_name, 'Group A' AS group_name,
               ts AS created_at
        FROM events""",
    "batch": """
        SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS row_no,
               concat(CASE WHEN o_orderkey % 3 = 0 THEN 'New#' ELSE 'Customer#' END, lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS usn,
               o_orderpriority AS department, o_orderstatus AS program
        FROM orders""",
    "messy": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS row_no,
               CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || c_name || chr(9) WHEN 2 THEN 'NaN' WHEN 3 THEN c_name WHEN 4 THEN 'null' WHEN 5 THEN lower(c_name) END AS usn,
               CASE c_custkey % 5 WHEN 0 THEN 'ID' || c_custkey WHEN 1 THEN ' ' WHEN 3 THEN ' x' || c_custkey END AS student_id,
               CASE c_custkey % 4 WHEN 0 THEN '  Member ' || c_custkey WHEN 1 THEN 'None' WHEN 2 THEN '' END AS full_name,
               CASE c_custkey % 6 WHEN 0 THEN c_mktsegment WHEN 1 THEN ' nan ' WHEN 2 THEN c_mktsegment || ' ' END AS department,
               CASE c_custkey % 3 WHEN 0 THEN ' MBA ' WHEN 1 THEN '' END AS program,
               CASE c_custkey % 9 WHEN 0 THEN ' M' WHEN 1 THEN 'female ' WHEN 2 THEN 'Boy' WHEN 3 THEN 'F' WHEN 4 THEN 'WOMAN' WHEN 5 THEN 'o' WHEN 6 THEN 'Other' WHEN 7 THEN c_mktsegment END AS gender,
               CASE c_custkey % 8 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN ' 7 ' END AS student_number
        FROM customer""",
    "ledger": """
        SELECT event_id AS id, concat(event_type, '_', CAST(user_id AS VARCHAR), '.csv') AS file_name,
               sha256(props) AS file_hash, CAST(floor(value) AS BIGINT) AS total_rows,
               CAST(0 AS BIGINT) AS new_records, CAST(0 AS BIGINT) AS updated_records,
               CAST(0 AS BIGINT) AS duplicate_records, ts AS imported_at
        FROM events""",
    "audit": """
        SELECT event_id AS id, upper(event_type) AS action, 'Event' AS entity_type,
               CAST(user_id AS VARCHAR) AS entity_id, props AS details, ts AS created_at
        FROM events""",
    "dim_names": """
        SELECT p_partkey AS row_no, p_name AS name FROM part""",
}

DEPENDS = {"member": ["dept"]}


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(v: str) -> None:
        for d in DEPENDS.get(v, []):
            visit(d)
        if v not in order:
            order.append(v)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            visit(v)
    return order


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it mentions (longest names matched as words)."""
    names = _needed(sql)
    if not names:
        return sql
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
