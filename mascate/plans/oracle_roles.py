"""The report tables of :mod:`mascate.plans.driver_tables` as DuckDB common table expressions."""

from __future__ import annotations

# Name -> (roles it reads, body).
ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "customers": ((), """
        SELECT c_custkey AS customer_id, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS tax_id,
               c_name AS name, CAST(c_nationkey AS VARCHAR) AS area1,
               CAST(c_custkey AS VARCHAR) AS phone1, ' 55 ' AS area2,
               CASE WHEN c_acctbal < 0 THEN '000' ELSE CAST(c_custkey + 1000 AS VARCHAR) END AS phone2,
               c_nationkey AS status, c_custkey - c_custkey % 3 AS parent_id,
               lpad(CAST(c_custkey - c_custkey % 3 AS VARCHAR), 14, '0') AS parent_tax_id
        FROM customer"""),
    "order_span": ((), """
        SELECT o_custkey AS customer_id, CAST(min(o_orderdate) AS DATE) AS first_order,
               CAST(max(o_orderdate) AS DATE) AS last_order
        FROM orders GROUP BY o_custkey"""),
    "customers_with_parent": (("customers", "order_span"), """
        SELECT c.*, p.name AS parent_name, s.first_order AS parent_birth, p.area1 AS parent_area1,
               p.phone1 AS parent_phone1, p.area2 AS parent_area2, p.phone2 AS parent_phone2,
               p.status AS parent_status
        FROM customers c LEFT JOIN customers p ON p.customer_id = c.parent_id
        LEFT JOIN order_span s ON s.customer_id = c.parent_id"""),
    "sellers": ((), """
        SELECT n_nationkey + 100 AS seller_id, n_nationkey AS seller_no, n_name AS name,
               n_regionkey AS store
        FROM nation"""),
    "history": ((), """
        SELECT CAST(o_orderkey % 25 AS INTEGER) AS seller_no,
               lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS tax_id, o_orderdate AS since
        FROM orders"""),
    "sold": ((), """
        SELECT o_orderkey AS document, CAST(o_orderdate AS DATE) AS date,
               CAST(o_orderkey % 25 AS INTEGER) AS seller_no, o_custkey AS customer_id,
               lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS tax_id,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total,
               CASE o_orderstatus WHEN 'P' THEN 'S' WHEN 'O' THEN 'N' END AS cancelled
        FROM orders"""),
    "returned": ((), """
        SELECT l_orderkey AS document, l_partkey AS product, CAST(l_shipdate AS DATE) AS date,
               CAST(l_orderkey % 25 AS INTEGER) AS seller_no, o_custkey AS customer_id,
               lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS tax_id,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
                    AS DECIMAL(12,2)) AS total,
               CASE WHEN o_orderstatus = 'P' THEN 'S' WHEN o_orderstatus = 'O' THEN 'N'
                    WHEN l_linestatus = 'O' THEN 'X' END AS cancelled
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_returnflag = 'R'"""),
    "sales_lines": (("sold", "returned", "customers", "sellers"), """
        SELECT f.*, c.name AS customer_name, c.status, s.name AS seller_name, s.store
        FROM (
            SELECT document, date, customer_id, tax_id, seller_no, 0 AS product, total AS signed_value
            FROM sold WHERE cancelled IS DISTINCT FROM 'S'
            UNION ALL
            SELECT document, date, customer_id, tax_id, seller_no, product, -total
            FROM returned WHERE cancelled IS DISTINCT FROM 'S'
        ) f
        LEFT JOIN customers c USING (customer_id)
        LEFT JOIN sellers s USING (seller_no)"""),
    "roster": (("order_span",), """
        SELECT c_custkey AS member_no, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS tax_id,
               first_order AS entered, CASE WHEN c_acctbal >= 0 THEN 'S' ELSE 'N' END AS active
        FROM customer LEFT JOIN order_span ON customer_id = c_custkey
        WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')"""),
    "members": (("order_span",), """
        SELECT c_nationkey % 4 AS plan_code, c_custkey AS member_no, c_name AS name,
               lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS tax_id, c_mktsegment AS plan,
               nullif(c_nationkey, 0) AS stars, c_nationkey * 2 AS exchange_days,
               CAST(c_nationkey AS DOUBLE) * CAST(0.25 AS DOUBLE) AS discount_pct, c_acctbal AS points,
               c_acctbal * CAST(0.5 AS DOUBLE) AS purchases_7m,
               CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS DOUBLE) END AS current_month,
               first_order AS birth, first_order AS plan_start,
               CASE WHEN c_acctbal >= 100 THEN last_order END AS plan_end, last_order AS changed
        FROM customer LEFT JOIN order_span ON customer_id = c_custkey
        WHERE c_mktsegment <> 'FURNITURE'"""),
    "ranking": (("sold",), """
        SELECT customer_id AS member_no, sum(total) AS value,
               CASE WHEN sum(total) >= 100000
                    THEN CAST(2000000000 - floor(sum(total)) AS INTEGER) END AS position
        FROM sold WHERE cancelled IS DISTINCT FROM 'S' GROUP BY customer_id"""),
    "race_purchases": (("sold",), """
        SELECT customer_id AS member_no, CAST(date_trunc('quarter', date) AS DATE) AS start,
               CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS stop,
               CAST(sum(total) AS DECIMAL(12,2)) AS total
        FROM sold WHERE cancelled IS DISTINCT FROM 'S' GROUP BY ALL"""),
    "race_goals": (("race_purchases",), """
        SELECT *, CAST(goal * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS star_value FROM (
            SELECT start, stop,
                   CAST(max(total) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS goal
            FROM race_purchases GROUP BY start, stop)"""),
    "race_prizes": (("race_purchases", "race_goals"), """
        SELECT p.member_no, p.start, p.stop
        FROM race_purchases p JOIN race_goals g ON g.start = p.start AND g.stop = p.stop
        WHERE p.total >= g.goal"""),
    "day_purchases": ((), """
        SELECT user_id AS member_no, CAST(ts AS DATE) AS period,
               CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS total
        FROM events GROUP BY ALL"""),
    "day_goals": ((), """
        SELECT DISTINCT CAST(ts AS DATE) AS period, CAST(50 AS DECIMAL(12,2)) AS goal
        FROM events WHERE day(CAST(ts AS DATE)) <> 10"""),
    "targets": ((), """
        SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS tax_id FROM customer
        UNION ALL
        SELECT '9' || lpad(CAST(s_suppkey AS VARCHAR), 13, '0') FROM supplier"""),
    "users": ((), """
        SELECT c_custkey AS user_id, upper(c_name) AS login, md5(c_name) AS password_md5,
               lower(c_name) || '@example.com' AS email,
               CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS active, DATE '2000-01-01' AS created,
               CAST(NULL AS DATE) AS changed, CAST(NULL AS INTEGER) AS created_by,
               CAST(NULL AS INTEGER) AS changed_by, c_custkey AS person_id,
               c_nationkey + 3 AS seller_no, 1 AS type, CAST(c_nationkey % 5 AS VARCHAR) AS store
        FROM customer"""),
    "user_targets": ((), """
        SELECT s_suppkey AS user_id FROM supplier UNION ALL SELECT -s_suppkey - 1 FROM supplier"""),
    "changes": ((), """
        SELECT s_suppkey * 4 AS seq, 'update' AS op, s_suppkey AS user_id,
               CASE WHEN s_acctbal >= 5000 THEN upper(trim('  ' || lower(s_name) || ' ')) END AS login,
               md5(trim(s_name)) AS password_md5, CAST(NULL AS VARCHAR) AS email,
               s_nationkey AS seller_no
        FROM supplier
        UNION ALL
        SELECT s_suppkey * 4 + 1, 'update', s_suppkey, NULL, NULL, s_name || '@example.org', NULL
        FROM supplier
        UNION ALL
        SELECT s_suppkey * 4 + 2, 'create', -s_suppkey - 1, upper(s_name), md5(s_name), NULL, NULL
        FROM supplier
        UNION ALL
        SELECT * FROM (
            SELECT s_suppkey * 4 + 3 AS seq, 'update',
                   CASE WHEN s_acctbal < 5000 THEN -s_suppkey - 1 ELSE s_suppkey END AS user_id,
                   CASE WHEN s_acctbal >= 5000 THEN 'CUSTOMER#000000000' END, NULL, NULL, NULL
            FROM supplier) WHERE user_id <> 0"""),
    # What the reports say of people, by the customer's number: tax ids are that number, padded.
    "people": ((), """
        SELECT c_custkey AS id, printf('%014d', c_custkey) AS tax_id, c_custkey // 3 * 3 AS head,
               printf('%014d', c_custkey // 3 * 3) AS head_tax_id, c_custkey % 3 = 0 AS leads,
               c_name AS name, c_nationkey AS status,
               CASE WHEN c_acctbal < 0 THEN c_nationkey || ' ' || c_custkey
                    ELSE '55 ' || (c_custkey + 1000) END AS phone
        FROM customer"""),
    "holder": ((), """
        SELECT id, printf('%014d', id) AS tax_id, n_nationkey AS seller_no, n_name AS seller_name
        FROM (SELECT o_custkey AS id, max({'day': o_orderdate, 'seller': o_orderkey % 25}) AS newest
              FROM orders GROUP BY o_custkey)
        LEFT JOIN nation ON n_nationkey = newest.seller"""),
    "faces": (("people", "holder"), """
        SELECT p.id AS member_no, name, p.tax_id, phone, status, leads, h.seller_no, h.seller_name
        FROM people p JOIN customer ON c_custkey = p.id LEFT JOIN holder h ON h.id = p.head
        WHERE c_mktsegment <> 'FURNITURE'"""),
    "mine": ((), """
        SELECT o_custkey AS id, printf('%014d', o_custkey) AS tax_id
        FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 25 = 7)"""),
    "nobody": ((), "SELECT id, tax_id FROM (SELECT 0 AS id, '' AS tax_id) WHERE false"),
    "gains": (("sold", "returned"), """
        SELECT customer_id AS id, date, seller_no, total AS gain, cancelled, 'order' AS kind FROM sold
        UNION ALL
        SELECT customer_id, date, seller_no, -total, cancelled, 'return' FROM returned"""),
}


def with_roles(names: tuple[str, ...], select: str, **extra: str) -> str:
    """A query over the named roles and, after them, the extra common table expressions."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for inner in ROLES[name][0]:
                need(inner)
            ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({ROLES[n][1]}\n)" for n in ordered]
    parts += [f"{n} AS ({body}\n)" for n, body in extra.items()]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select
