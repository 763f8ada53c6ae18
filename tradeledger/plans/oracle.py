"""The registered queries as SQL text for an independent engine.

``MODEL`` builds the model tables from the test tables as named subqueries;
each query text is put behind the ones it uses.
"""

from __future__ import annotations

import re


MODEL = {
    "m_lines": """
        SELECT doc_id, l_orderkey, receipt, kind, (l_orderkey * 4 + kind - 1) * 3000000 + n AS id, product_id, step,
               product_id * 3 + step AS unit_id,
               CASE step WHEN 0 THEN 'pcs' WHEN 1 THEN 'pak' ELSE 'ls' END AS unit_name,
               qty, content, price, discount, CAST(price * CAST(0.80 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS buy_price,
               tax, rate, supplier_id, l_linenumber AS line_number, l_shipdate AS shipped_at,
               CAST(qty * content AS DECIMAL(18,2)) AS real_qty,
               CAST(qty * (price - discount) AS DECIMAL(18,2)) AS subtotal
        FROM (
            SELECT *, CASE WHEN kind = 4 THEN (l_orderkey * 500000 + receipt - 1) * 16 + 4 ELSE l_orderkey * 16 + kind END AS doc_id,
                   CASE step WHEN 0 THEN CAST(1 AS DECIMAL(8,2)) WHEN 1 THEN CAST(10 AS DECIMAL(8,2))
                        ELSE CAST(12 AS DECIMAL(8,2)) END AS content,
                   CASE WHEN kind IN (1, 4) THEN CAST(price * rate AS DECIMAL(12,2))
                        ELSE CAST(0 AS DECIMAL(12,2)) END AS discount,
                   row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY
                       CASE WHEN kind = 4 THEN l_suppkey END NULLS FIRST, l_linenumber, l_partkey, l_suppkey,
                       l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS n
            FROM (
                SELECT *, dense_rank() OVER (PARTITION BY l_orderkey, kind ORDER BY l_suppkey NULLS FIRST) AS receipt FROM (
                SELECT *, l_partkey AS product_id, l_suppkey AS supplier_id,
                       CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'R' THEN 3
                            WHEN l_linestatus = 'O' THEN 2 ELSE 4 END AS kind,
                       CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END AS step,
                       CAST(l_quantity AS DECIMAL(10,2)) AS qty,
                       CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
                       CAST(l_discount AS DECIMAL(4,2)) AS rate, CAST(l_tax AS DECIMAL(4,2)) AS tax
                FROM lineitem)))""",
    "m_costs": """
        SELECT *, CAST(qty * price AS DECIMAL(18,2)) AS subtotal
        FROM (SELECT doc_id AS grass_id, id, product_id, tax, rate, CAST(1 AS DECIMAL(12,2)) AS qty,
                     'transport' AS memo, 'trip' AS unit, shipped_at AS created_at, shipped_at AS updated_at,
                     CAST(price * tax AS DECIMAL(12,2)) AS price
              FROM m_lines WHERE kind = 3)""",
    "m_sums": """
        SELECT doc_id, sum(subtotal) AS total, sum(real_qty) AS qty
        FROM m_lines GROUP BY doc_id""",
    "m_heads": """
        SELECT o_orderkey AS k, o_custkey AS customer_id, o_orderdate AS day, o_orderstatus AS status,
               o_orderpriority AS priority, kind, o_orderkey * 16 + kind AS id,
               CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS lunas_id,
               coalesce(total, 0) AS total, coalesce(qty, 0) AS qty,
               CASE o_orderstatus WHEN 'F' THEN CAST(coalesce(total, 0) AS DECIMAL(18,2))
                    WHEN 'P' THEN CAST(CAST(coalesce(total, 0) AS DECIMAL(18,2)) * CAST(0.30 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                    ELSE 0 END AS paid
        FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS kinds(kind)
        LEFT JOIN m_sums ON m_sums.doc_id = o_orderkey * 16 + kind""",
    "m_events": """
        SELECT event_id, ts, user_id, event_type, event_id // 3 AS order_key, CAST(value AS DECIMAL(12,2)) AS amount,
               CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS lunas_id
        FROM events""",
    "m_orders": """
        SELECT id, customer_id, day AS order_date, total, paid AS payment, total - paid AS remain_payment,
               'Sale ' || priority AS descriptions, lunas_id
        FROM m_heads WHERE kind = 1""",
    "m_order_details": "SELECT *, doc_id AS order_id FROM m_lines WHERE kind = 1",
    "m_special_details": "SELECT *, doc_id AS order_id FROM m_lines WHERE kind = 2",
    "m_grass_details": "SELECT *, doc_id AS grass_id FROM m_lines WHERE kind = 3",
    "m_stock_details": "SELECT *, doc_id AS stock_id FROM m_lines WHERE kind = 4",
    "m_special_payments": """
        SELECT o_custkey AS customer_id, order_key * 16 + 2 AS order_id, event_id * 16 + 7 AS id,
               CAST(NULL AS VARCHAR) AS descriptions, ts AS payment_at, amount AS nominal, 'W-' || event_id AS pay_num, lunas_id
        FROM m_events JOIN orders ON o_orderkey = order_key WHERE event_type = 'view'""",
    "m_special_orders": """
        SELECT h.id, customer_id, day AS created_at, day AS updated_at, day AS packaged_at, day AS shipped_at,
               'driver' AS driver_name, 'plate' AS police_number, 'street' AS street, 'city' AS city,
               'phone' AS phone, total, paid AS cash, coalesce(p.payments, 0) AS payments,
               total - paid - coalesce(p.payments, 0) AS remain_payment,
               CASE WHEN status <> 'O' THEN 'Wholesale ' || priority END AS descriptions, lunas_id,
               'SJ-' || k AS surat_jalan
        FROM m_heads h LEFT JOIN (SELECT order_id, sum(nominal) AS payments FROM m_special_payments GROUP BY 1) p
             ON p.order_id = h.id
        WHERE kind = 2""",
    "m_receipts": """
        SELECT *, CAST(CAST(total AS DECIMAL(18,2)) * CAST(0.20 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS cash
        FROM (SELECT coalesce(doc_id, o_orderkey * 500000 * 16 + 4) AS id, coalesce(supplier_id, o_orderkey % 10) AS supplier_id,
                     'ST-' || o_orderkey || '-' || coalesce(receipt, 1) AS stock_num, o_orderdate AS stock_date,
                     coalesce(total, 0) AS total, CAST(NULL AS VARCHAR) AS descriptions
              FROM orders LEFT JOIN (
                  SELECT l_orderkey, receipt, doc_id, supplier_id, sum(subtotal) AS total
                  FROM m_lines WHERE kind = 4 GROUP BY ALL) s ON s.l_orderkey = o_orderkey)""",
    "m_instalments": """
        SELECT event_id, event_id * 500000 * 16 + 8 AS id, order_key * 500000 * 16 + 4 AS stock_id, 'S-' || event_id AS pay_num,
               ts AS pay_date, amount AS nominal, lunas_id, CAST(NULL AS VARCHAR) AS descriptions
        FROM m_events WHERE event_type = 'error'""",
    "m_stock_payments": "SELECT * FROM m_instalments WHERE stock_id IN (SELECT id FROM m_receipts)",
    "m_stocks": """
        SELECT r.*, coalesce(p.payments, 0) AS payments, total - (cash + coalesce(p.payments, 0)) AS remain_payment
        FROM m_receipts r LEFT JOIN (SELECT stock_id, sum(nominal) AS payments FROM m_stock_payments GROUP BY 1) p
             ON p.stock_id = r.id""",
    "m_grass": """
        SELECT *, CASE WHEN priority IN ('1-URGENT', '2-HIGH') AND total > 0
                       THEN CAST(CAST(total AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                       ELSE 0 END AS total_div
        FROM (SELECT h.id, customer_id, day AS order_date, 'Purchase ' || priority AS descriptions, priority, qty,
                     total - coalesce(cost, 0) AS total, coalesce(cost, 0) AS cost, lunas_id,
                     customer_id // 2 AS partner_id
              FROM m_heads h LEFT JOIN (SELECT grass_id, sum(subtotal) AS cost FROM m_costs GROUP BY 1) x
                   ON x.grass_id = h.id
              WHERE kind = 3)""",
    "m_kasbons": """
        SELECT event_id * 16 + 5 AS id, user_id AS customer_id, 'Advance' AS descriptions, ts AS kasbon_date,
               ts + INTERVAL 7 DAY AS jatuh_tempo, amount AS total, lunas_id, 0 AS ref_lunas_id
        FROM m_events WHERE event_type IN ('signup', 'click')""",
    "m_payments": """
        SELECT event_id * 16 + 6 AS id, user_id AS customer_id, 'Instalment' AS descriptions, 0 AS ref_id,
               ts AS payment_date, amount AS total, lunas_id
        FROM m_events WHERE event_type = 'purchase'""",
    "m_categories": "SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id, p_brand AS name FROM part",
    "m_products": """
        SELECT p_partkey AS id, p_name || ' #' || p_partkey AS name, p_type AS spec,
               CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(p_size AS DECIMAL(12,2)) AS stock,
               CAST(p_size AS DECIMAL(12,2)) AS first_stock, 'pcs' AS unit, false AS update_notif,
               CAST(split_part(p_brand, '#', 2) AS BIGINT) AS category_id, p_size
        FROM part""",
    "m_units": """
        SELECT p.id AS product_id, p.id * 3 + k AS id, u.name, content, margin,
               CAST(price * content + price * content * margin AS DECIMAL(18,2)) AS price,
               CAST(price * content AS DECIMAL(18,2)) AS buy_price,
               k = CASE WHEN p_size <= 16 THEN 0 WHEN p_size <= 33 THEN 1 ELSE 2 END AS is_default
        FROM m_products p CROSS JOIN (VALUES
            (0, 'pcs', CAST(1 AS DECIMAL(8,2)), CAST(0.3 AS DECIMAL(5,4))),
            (1, 'pak', CAST(10 AS DECIMAL(8,2)), CAST(0.2 AS DECIMAL(5,4))),
            (2, 'ls', CAST(12 AS DECIMAL(8,2)), CAST(0.25 AS DECIMAL(5,4)))) AS u(k, name, content, margin)""",
    "m_customers": """
        SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS street, n_name AS city,
               CAST(NULL AS VARCHAR) AS phone,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'Pabrik' WHEN 'FURNITURE' THEN 'Rumput Laut'
                    ELSE 'Bandeng' END AS customer_type
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "m_suppliers": """
        SELECT s_suppkey AS id, s_name AS name, n_name AS city, CAST(NULL AS VARCHAR) AS sales_name,
               CAST(NULL AS VARCHAR) AS street, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS cell,
               CAST(NULL AS VARCHAR) AS email
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "m_lunas": """
        SELECT c_custkey * 2 + 2 AS id, c_custkey AS customer_id,
               greatest(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS remain_payment, 'settled' AS descriptions,
               TIMESTAMP '2024-02-01' AS created_at, TIMESTAMP '2024-02-01' AS updated_at
        FROM customer WHERE c_mktsegment <> 'FURNITURE'
        UNION ALL
        SELECT c_custkey * 2 + 3, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) - 5000, 'settled',
               TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-01'
        FROM customer WHERE c_mktsegment <> 'FURNITURE' AND CAST(c_acctbal AS DECIMAL(12,2)) > 5000""",
    "m_moves": """
        SELECT product_id, id, CASE WHEN kind IN (3, 4) THEN real_qty ELSE -real_qty END AS moved FROM m_lines""",
    "m_on_hand": """
        SELECT p.id, first_stock + coalesce(sum(moved), 0) AS stock
        FROM m_products p LEFT JOIN m_moves m ON m.product_id = p.id GROUP BY p.id, first_stock""",
    # lines after the registered change set
    "m_after": """
        SELECT *, CAST(qty * content AS DECIMAL(18,2)) AS real_qty,
               CAST(qty * (price - discount) AS DECIMAL(18,2)) AS subtotal
        FROM (SELECT kind, CASE WHEN tax <= 0.05 AND rate >= 0.05
                               THEN product_id * CASE WHEN kind = 4 THEN 500000 ELSE 1 END * 16 + kind ELSE doc_id END AS doc_id,
                     CASE WHEN tax <= 0.05 AND rate <= 0.02 THEN supplier_id ELSE product_id END AS product_id,
                     CASE WHEN tax <= 0.05 THEN qty + 1 ELSE qty END AS qty, content, price, discount
              FROM m_lines WHERE tax > 0.02)""",
    "m_costs_after": """
        SELECT CASE WHEN tax <= 0.05 AND rate >= 0.05 THEN product_id * 16 + 3 ELSE grass_id END AS grass_id,
               CASE WHEN tax <= 0.05 THEN 2 * price ELSE price END AS subtotal
        FROM m_costs WHERE tax > 0.02""",
    # settlements with the customer's next one, and the state after applying them
    "m_next": "SELECT *, lead(id) OVER (PARTITION BY customer_id ORDER BY id) AS next_id FROM m_lunas",
    "m_first": "SELECT customer_id, min(id) AS first_id FROM m_lunas GROUP BY customer_id",
    "m_carried": """
        SELECT id * 16 + 9 AS id, customer_id, TIMESTAMP '2024-02-01' AS kasbon_date,
               TIMESTAMP '2024-02-08' AS jatuh_tempo, remain_payment AS total, coalesce(next_id, 0) AS lunas_id,
               id AS ref_lunas_id
        FROM m_next WHERE remain_payment > 0""",
    "m_stamped": """
        SELECT table_name, x.id, x.customer_id, ref_lunas_id,
               CASE WHEN lunas_id = 0 AND first_id IS NOT NULL THEN first_id ELSE lunas_id END AS lunas_id
        FROM (SELECT 'orders' AS table_name, id, customer_id, lunas_id, 0 AS ref_lunas_id FROM m_orders
              UNION ALL SELECT 'special_orders', id, customer_id, lunas_id, 0 FROM m_special_orders
              UNION ALL SELECT 'payments', id, customer_id, lunas_id, 0 FROM m_payments
              UNION ALL SELECT 'special_payments', id, customer_id, lunas_id, 0 FROM m_special_payments
              UNION ALL SELECT 'kasbons', id, customer_id, lunas_id, 0 FROM m_kasbons
              UNION ALL SELECT 'grass', id, customer_id, lunas_id, 0 FROM m_grass) x
        LEFT JOIN m_first f ON f.customer_id = x.customer_id
        UNION ALL
        SELECT 'kasbons', id, customer_id, ref_lunas_id, lunas_id FROM m_carried""",
}


def _t(expr: str, name: str) -> str:
    return f"CAST({expr} AS DECIMAL(28,2)) AS {name}"


def _m(expr: str, name: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2)) AS {name}"


def _l(expr: str, name: str) -> str:
    return f"CAST({expr} AS DECIMAL(12,2)) AS {name}"


def _i(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _ledger(rows: str, parts: str, order: str, columns: str) -> str:
    over = f"OVER (PARTITION BY {parts} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (f"SELECT {columns}, {_m('debt', 'debt')}, {_m('cred', 'cred')}, "
            f"{_t(f'sum(debt - cred) {over}', 'balance')} FROM ({rows})")


# The line ledger in whole numbers: credits in units of 1e-21, rounded once for
# display and once for the balance.
_E19 = "CAST(10000000000000000000 AS HUGEINT)"
_CENTS = lambda x: f"CAST({x} * 100 AS HUGEINT)"
_BOUGHT = f"""
    SELECT customer_id, lunas_id, doc_id, line_id, trx_date, descriptions, title, qty, unit, price,
           s * {_E19} - s * CASE WHEN d = 0 THEN 0 ELSE (2 * n * {_E19} + d) // (2 * d) END AS cred21
    FROM (SELECT g.customer_id, g.lunas_id, g.id AS doc_id, l.id AS line_id, g.order_date AS trx_date,
                 p.name || CASE WHEN g.total_div > 0 THEN ' *' ELSE '' END AS descriptions,
                 'Pembelian: #' || g.id AS title, l.qty, l.unit_name AS unit, l.price,
                 {_CENTS('l.subtotal')} AS s, {_CENTS('(g.total_div + g.cost)')} AS n,
                 {_CENTS('(g.total + g.cost)')} AS d
          FROM m_grass_details l JOIN m_grass g ON g.id = l.grass_id JOIN m_products p ON p.id = l.product_id)"""
_LINE_LEDGER = f"""
    SELECT {_i('customer_id', 'customer_id')}, {_i('lunas_id', 'lunas_id')},
           row_number() OVER w AS row_no, {_i('doc_id', 'doc_id')}, branch, {_i('line_id', 'line_id')},
           trx_date, descriptions, title, {_l('qty', 'qty')}, unit, {_l('price', 'price')},
           {_m('debt', 'debt')},
           CAST(CAST((cred21 + 5 * ({_E19} // 10)) // {_E19} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS cred,
           CAST(CAST(sign(bal21) * ((abs(bal21) + 5 * ({_E19} // 10)) // {_E19}) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(28,2)) AS balance
    FROM (SELECT *, CAST(sum({_CENTS('debt')} * {_E19} - cred21) OVER w AS HUGEINT) AS bal21 FROM (
            SELECT customer_id, lunas_id, id AS doc_id, 1 AS branch, 0 AS line_id, kasbon_date AS trx_date,
                   descriptions, 'Kasbon #' || id AS title, 0 AS qty, '-' AS unit, 0 AS price, total AS debt,
                   CAST(0 AS HUGEINT) AS cred21 FROM m_kasbons
            UNION ALL
            SELECT o.customer_id, o.lunas_id, o.id, 2, l.id, o.order_date, p.name, 'Piutang Barang #' || o.id,
                   l.qty, l.unit_name, l.price, l.subtotal, 0
            FROM m_order_details l JOIN m_orders o ON o.id = l.order_id JOIN m_products p ON p.id = l.product_id
            UNION ALL
            SELECT customer_id, lunas_id, id, 3, 0, order_date, descriptions, 'DP Piutang Barang: #' || id,
                   0, '-', 0, 0, {_CENTS('payment')} * {_E19} FROM m_orders WHERE payment > 0
            UNION ALL
            SELECT customer_id, lunas_id, doc_id, 4, line_id, trx_date, descriptions, title, qty, unit, price, 0, cred21
            FROM ({_BOUGHT})
            UNION ALL
            SELECT customer_id, lunas_id, id, 5, 0, payment_date, descriptions, 'Angsuran: #' || id,
                   0, '-', 0, 0, {_CENTS('total')} * {_E19} FROM m_payments)
          WINDOW w AS (PARTITION BY customer_id, lunas_id ORDER BY doc_id, branch, line_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WINDOW w AS (PARTITION BY customer_id, lunas_id ORDER BY doc_id, branch, line_id)"""

_PARTY = f"{_i('customer_id', 'customer_id')}, {_i('lunas_id', 'lunas_id')}"
_DOC_ROWS = """
    SELECT customer_id, lunas_id, id, descriptions, order_date AS trx_date, total AS debt, payment AS cred FROM m_orders
    UNION ALL SELECT customer_id, lunas_id, id, descriptions, kasbon_date, total, 0 FROM m_kasbons
    UNION ALL SELECT customer_id, lunas_id, id, descriptions, order_date, 0, total - total_div FROM m_grass
    UNION ALL SELECT customer_id, lunas_id, id, descriptions, payment_date, 0, total FROM m_payments"""


def _summary(keys: str, rows: str, shown: str) -> str:
    return f"""
    SELECT {keys}, {_i('id', 'id')}, descriptions, {_t('debt', 'debt')}, {_t('cred', 'cred')},
           {_t(f'sum(debt - cred) OVER (PARTITION BY {keys} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'balance')}
    FROM (SELECT {keys}, id, descriptions, sum(debt) AS debt, sum(cred) AS cred FROM ({rows})
          GROUP BY {keys}, id, descriptions) WHERE {shown}"""


_SALES = """
    SELECT 0 AS order_type, o.id AS order_id, o.customer_id, o.order_date, l.id, l.product_id, l.qty, l.unit_name,
           l.price, l.buy_price, l.discount
    FROM m_order_details l JOIN m_orders o ON o.id = l.order_id
    UNION ALL
    SELECT 1, o.id, o.customer_id, o.created_at, l.id, l.product_id, l.qty, l.unit_name, l.price, l.buy_price, 0
    FROM m_special_details l JOIN m_special_orders o ON o.id = l.order_id"""


def _profit_lines(where: str) -> str:
    return f"""
    SELECT {_i('order_id', 'id')}, {_i('s.id', 'line_id')}, order_date, name, spec, {_l('buy_price', 'buy_price')},
           {_l('s.price', 'sale_price')}, {_l('discount', 'discount')}, {_m('s.price - buy_price - discount', 'profit')},
           qty, unit_name AS unit, {_m('(s.price - buy_price - discount) * qty', 'subtotal')}
    FROM ({_SALES}) s JOIN m_products p ON p.id = s.product_id WHERE {where}"""


_AMOUNTS = {
    "buy_price": "buy_price * qty", "sale_price": "price * qty", "subtotal": "(price - buy_price) * qty",
    "discount": "discount * qty", "profit": "(price - buy_price - discount) * qty",
}
_SUMMED = ", ".join(_t(f"sum({e})", n) for n, e in _AMOUNTS.items())
_ROUNDED = ", ".join(_t(f"sum(CAST({e} AS DECIMAL(12,2)))", n) for n, e in _AMOUNTS.items())


def _by_day(where: str) -> str:
    return f"""
    SELECT {_i('day(order_date)', 'id')}, strftime(order_date, '%Y-%m-%d') AS order_date, {_ROUNDED}
    FROM ({_SALES}) WHERE {where} GROUP BY 1, 2"""


def _by_month(where: str) -> str:
    return f"""
    SELECT {_i('year(order_date)', 'year')}, {_i('month(order_date)', 'id')}, {_ROUNDED}
    FROM ({_SALES}) WHERE {where} GROUP BY 1, 2"""


def _of_order(order_type: int) -> str:
    return f"""
    SELECT {_i('order_id', 'order_id')}, {_i('s.id', 'id')}, name AS product_name, {_l('buy_price', 'buy_price')},
           {_l('s.price', 'sale_price')}, {_l('discount', 'discount')}, qty, unit_name AS unit,
           {_m('(s.price - buy_price - discount) * qty', 'profit')}
    FROM ({_SALES}) s JOIN m_products p ON p.id = s.product_id WHERE order_type = {order_type}"""


def _totals(parents: str, rows: str, **sums: str) -> str:
    """Sums of ``rows`` (with an ``id``) for every parent."""
    shown = ", ".join(_t(f"coalesce(sum({e}), 0)", n) for n, e in sums.items())
    return f"SELECT {_i('p.id', 'id')}, {shown} FROM {parents} p LEFT JOIN ({rows}) r ON r.id = p.id GROUP BY p.id"


_GROSS_NET = """SELECT doc_id AS id, real_qty AS qty, subtotal AS total FROM {lines} WHERE kind = 3
                UNION ALL SELECT grass_id, 0, -subtotal FROM {costs}"""


def _paid_after(source: str, parent: str, code: str) -> str:
    return f"""
    SELECT CASE WHEN nominal <= 70 AND lunas_id = 0 THEN (event_id // 4) * {code} ELSE {parent} END AS id,
           CASE WHEN nominal <= 70 THEN nominal * 2 ELSE nominal END AS nominal
    FROM ({source}) WHERE nominal > 15"""


def _cascade() -> str:
    """Everything summed anew after the batch."""
    four = lambda *values: ", ".join(f"CAST({v} AS DECIMAL(28,4)) AS value_{k}" for k, v in enumerate(values, 1))
    sums = lambda rows, **named: f"(SELECT id, {', '.join(f'sum({e}) AS {n}' for n, e in named.items())} FROM ({rows}) GROUP BY id)"
    lines = lambda kind: sums(f"SELECT doc_id AS id, subtotal, real_qty FROM m_after WHERE kind = {kind}", total="subtotal", qty="real_qty")
    dear = "CASE WHEN price < 950 THEN CAST(price * 1.07 AS DECIMAL(12,2)) ELSE price END"
    return f"""
    SELECT 'orders' AS table_name, {_i('o.id', 'id')}, {four('coalesce(s.total, 0)', 'payment + 5 * lunas_id', 'coalesce(s.total, 0) - payment - 5 * lunas_id')}
    FROM m_orders o LEFT JOIN {lines(1)} s ON s.id = o.id
    UNION ALL SELECT 'special_orders', o.id, {four('coalesce(s.total, 0)', 'payments', 'coalesce(s.total, 0) - cash - payments')}
    FROM m_special_orders o LEFT JOIN {lines(2)} s ON s.id = o.id
    UNION ALL SELECT 'stocks', o.id, {four('coalesce(s.total, 0)', 'coalesce(p.paid, 0)', 'coalesce(s.total, 0) - cash - coalesce(p.paid, 0)')}
    FROM m_stocks o LEFT JOIN {lines(4)} s ON s.id = o.id
    LEFT JOIN {sums(_paid_after("SELECT * FROM m_instalments", "stock_id", "500000 * 16 + 4"), paid="nominal")} p ON p.id = o.id
    UNION ALL SELECT 'grass', o.id, {four('coalesce(s.total, 0) - coalesce(x.cost, 0)', 'coalesce(s.qty, 0)', 'coalesce(x.cost, 0)')}
    FROM m_grass o LEFT JOIN {lines(3)} s ON s.id = o.id
    LEFT JOIN {sums("SELECT grass_id AS id, subtotal FROM m_costs_after", cost="subtotal")} x ON x.id = o.id
    UNION ALL SELECT 'products', p.id, {four('p.opening', 'p.dear', 'p.opening + coalesce(s.moved, 0)')}
    FROM (SELECT id, {dear} AS dear, CASE WHEN first_stock <= 25 THEN first_stock * 2 ELSE first_stock END AS opening FROM m_products) p
    LEFT JOIN {sums("SELECT product_id AS id, CASE WHEN kind IN (3, 4) THEN real_qty ELSE -real_qty END AS moved FROM m_after", moved="moved")} s ON s.id = p.id
    UNION ALL SELECT 'units', u.id, {four(
        'CASE WHEN p.price < 950 THEN CAST(p.dear * content AS DECIMAL(18,2)) ELSE u.buy_price END',
        'CASE WHEN p.price < 950 THEN CAST(p.dear * content + p.dear * content * margin AS DECIMAL(18,2)) ELSE u.price END', 'margin')}
    FROM m_units u JOIN (SELECT id, price, {dear} AS dear FROM m_products) p ON p.id = u.product_id"""


_STAMPS = f"SELECT table_name, {_i('id', 'id')}, {_PARTY} FROM "

# every table's ids, and the declared references, for the constraint jobs
_TABLES = ["categories", "products", "units", "customers", "suppliers", "orders", "order_details", "special_orders",
           "special_details", "special_payments", "stocks", "stock_details", "stock_payments", "grass",
           "grass_details", "costs", "kasbons", "payments", "lunas"]


def _table_name(name: str) -> str:
    return "grass_costs" if name == "costs" else name


def _dup_keys() -> str:
    return " UNION ALL ".join(
        f"SELECT '{_table_name(n)}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, "
        f"count(*) FILTER (n > 1) AS n_dup_keys FROM (SELECT id, count(*) AS n FROM m_{n} GROUP BY id)" for n in _TABLES)


def _dup_natural() -> str:
    keys = {"categories": "name", "stock_details": "stock_id || '|' || product_id", "customers": "name",
            "order_details": "order_id || '|' || unit_id", "products": "name",
            "units": "product_id || '|' || name", "suppliers": "name"}
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, {k} AS key_text, count(*) AS n FROM m_{n} GROUP BY {k} HAVING count(*) > 1"
        for n, k in keys.items())


_REFERENCES = """
    products category_id categories, grass customer_id customers, kasbons customer_id customers,
    orders customer_id customers, payments customer_id customers, order_details product_id products,
    order_details unit_id units, costs grass_id grass, grass_details product_id products,
    grass_details unit_id units, grass_details grass_id grass, order_details order_id orders,
    units product_id products, stock_details product_id products, stock_details unit_id units,
    special_payments customer_id customers, special_payments order_id special_orders,
    stock_details stock_id stocks, stock_payments stock_id stocks, stocks supplier_id suppliers,
    lunas customer_id customers, special_orders customer_id customers, special_details order_id special_orders,
    special_details product_id products, special_details unit_id units"""


def _orphans() -> str:
    rows = [r.split() for r in _REFERENCES.split(",")]
    return " UNION ALL ".join(
        f"SELECT '{_table_name(a)}.{b}' AS reference, count(*) AS n_rows, "
        f"count(DISTINCT {b}) FILTER (p.id IS NULL) AS n_missing_keys, count(*) FILTER (p.id IS NULL) AS n_orphan_rows "
        f"FROM m_{a} x LEFT JOIN (SELECT id FROM m_{c}) p ON p.id = x.{b}" for a, b, c in rows)


def _blocked() -> str:
    rows = [r.split() for r in _REFERENCES.split(",")]
    return " UNION ALL ".join(
        f"SELECT CAST({b} AS BIGINT) AS id, '{a}.{b}' AS used_by, count(*) AS n_rows FROM m_{a} GROUP BY {b}"
        for a, b, c in rows if c == "customers")


# Columns that must not be null (!) and the greatest length of texts (:n), by table.
_DECLARED = """
    categories id! name!:50,
    products id! name!:50 spec:50 price! stock! first_stock! unit!:6 update_notif! category_id!,
    units product_id! id! name!:50 content! price! buy_price! margin!,
    customers id! name!:50 street:128 city:50 phone:25 customer_type!,
    suppliers id! name!:50 sales_name:50 street:128 city:50 phone:25 cell:25 email:50,
    orders id! customer_id! order_date! total! payment! remain_payment! descriptions!:128 lunas_id!,
    order_details order_id! id! unit_id! qty! content! unit_name!:6 real_qty! price! subtotal! buy_price! product_id!
        discount!,
    special_orders id! customer_id! created_at! updated_at! packaged_at! shipped_at! driver_name!:50 police_number!:15
        street!:128 city!:50 phone!:25 total! cash! payments! remain_payment! descriptions:128 lunas_id!
        surat_jalan!:50,
    special_details order_id! id! product_id! unit_id! qty! unit_name!:6 price! subtotal! content! real_qty!
        buy_price!,
    special_payments customer_id! order_id! id! descriptions:128 payment_at! nominal! pay_num!:50 lunas_id!,
    stocks id! supplier_id! stock_num!:50 stock_date! total! cash! payments! remain_payment! descriptions:128,
    stock_details stock_id! id! product_id! unit_id! qty! content! unit_name!:6 real_qty! price! subtotal! discount!,
    stock_payments id! stock_id! pay_num!:50 pay_date! nominal! descriptions:128,
    grass customer_id! id! descriptions!:128 order_date! total! qty! total_div! lunas_id! partner_id! cost!,
    grass_details grass_id! id! unit_id! qty! content! unit_name!:6 real_qty! price! subtotal! buy_price! product_id!,
    costs grass_id! id! memo!:128 qty! price! subtotal! created_at! updated_at! unit!:6,
    kasbons id! customer_id! descriptions!:128 kasbon_date! jatuh_tempo! total! lunas_id! ref_lunas_id!,
    payments id! customer_id! descriptions!:50 ref_id! payment_date! total! lunas_id!,
    lunas id! customer_id! remain_payment! descriptions:128 created_at! updated_at!"""


def _bad_values() -> str:
    """Forbidden nulls and overlong texts of every declared column."""
    parts = []
    for row in _DECLARED.split(","):
        name, *columns = row.split()
        for column, needed, length in (re.fullmatch(r"(\w+)(!?):?(\d*)", c).groups() for c in columns):
            nulls = f"count(*) FILTER ({column} IS NULL)" if needed else "0"
            long = f"count(*) FILTER (length({column}) > {length})" if length else "0"
            parts.append(f"SELECT '{_table_name(name)}' AS table_name, count(*) AS n_rows, '{column}' AS column_name, "
                         f"{_i(nulls, 'n_null')}, {_i(long, 'n_too_long')} FROM m_{name}")
    return " UNION ALL ".join(parts)


_DEBTS = """
    SELECT customer_id, lunas_id, 1 AS id, 'Piutang Barang' AS descriptions, total AS debt, payment AS cred FROM m_orders
    UNION ALL SELECT customer_id, lunas_id, 2, 'Kasbon', total, 0 FROM m_kasbons
    UNION ALL SELECT customer_id, lunas_id, 3, 'Pembelian', 0, total - total_div FROM m_grass
    UNION ALL SELECT customer_id, lunas_id, 4, 'Cicilan', 0, total FROM m_payments"""

_LINE = (f"{_i('id', 'id')}, {{parent}}, product_id, unit_id, qty, content, unit_name, real_qty, price, subtotal")

QUERIES = {
    # sources, listings, lookups
    "load_tsv": "SELECT id, name, spec, price, stock, first_stock, unit, update_notif, category_id FROM m_products",
    "load_rejects": """SELECT CASE p_size WHEN 2 THEN 'name: length' WHEN 3 THEN 'name: escape' WHEN 4 THEN 'id: null' WHEN 5 THEN 'price: type' WHEN 6 THEN 'fields' ELSE '' END AS reason,
        count(*) AS n FROM m_products GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM m_products""",
    "append_rows": "SELECT id, stock_id, product_id, qty, real_qty, subtotal FROM m_stock_details",
    "camel_products": """SELECT id, name, spec, price, stock, first_stock AS "firstStock", unit,
        update_notif AS "updateNotif", category_id AS "categoryId" FROM m_products""",
    "stock_date_from_epoch": f"SELECT id, {_i('epoch(stock_date)', 'seconds')}, stock_date FROM m_stocks",
    "categories_page": "SELECT id, name FROM m_categories ORDER BY name, id LIMIT 20",
    "products_page": """SELECT id, name, spec, price, stock, first_stock, unit, update_notif, category_id
        FROM m_products ORDER BY name, id LIMIT 20 OFFSET 40""",
    "deep_page": f"""SELECT {_i('id', 'id')}, {_i('customer_id', 'customer_id')}, order_date, {_i('lunas_id', 'lunas_id')}
        FROM m_orders ORDER BY customer_id, id LIMIT 50 OFFSET 10000""",
    "suppliers_page": "SELECT id, name, city FROM m_suppliers ORDER BY name, id LIMIT 20",
    "stocks_page": f"""SELECT id, stock_num, supplier_id, {_m('total', 'total')}, {_m('remain_payment', 'remain_payment')}
        FROM m_stocks ORDER BY stock_num, id LIMIT 20""",
    "category_products": """SELECT c.id, c.name, coalesce(part, 0) AS part,
        coalesce(string_agg(p.id || ':' || p.name || ':' || p.price, ';' ORDER BY p.id), '') AS products
        FROM m_categories c LEFT JOIN (
            SELECT *, CAST(id // 1000 AS BIGINT) AS part FROM m_products) p
        ON p.category_id = c.id GROUP BY 1, 2, 3""",
    "product_units": """SELECT p.id, p.name, coalesce(part, 0) AS part,
        coalesce(string_agg(u.id || ':' || u.name || ':' || u.price, ';' ORDER BY u.id), '') AS units
        FROM m_products p LEFT JOIN (
            SELECT *, CAST(id // 1000 AS BIGINT) AS part FROM m_units) u
        ON u.product_id = p.id GROUP BY 1, 2, 3""",
    "supplier_by_id": "SELECT id, name, city FROM m_suppliers WHERE id IN (SELECT supplier_id FROM m_stocks)",
    "stock_by_id": f"""SELECT id, supplier_id, stock_num, stock_date, {_m('total', 'total')}, {_m('cash', 'cash')},
        {_m('payments', 'payments')}, {_m('remain_payment', 'remain_payment')}
        FROM m_stocks WHERE id IN (SELECT stock_id FROM m_stock_payments)""",
    "stock_lines": f"""SELECT {_LINE.format(parent='stock_id')}, discount FROM m_stock_details
        WHERE stock_id IN (SELECT stock_id FROM m_stock_payments)""",
    "stock_line_by_id": "SELECT id, stock_id, product_id, discount, subtotal FROM m_stock_details WHERE discount > 0",
    "units_of_product": """SELECT id, product_id, name, content, price, buy_price, margin, is_default FROM m_units
        WHERE product_id IN (SELECT product_id FROM m_special_details)""",
    "unit_by_id": """SELECT id, product_id, name, content, price, buy_price, margin, is_default FROM m_units
        WHERE id IN (SELECT unit_id FROM m_special_details)""",
    # ledgers
    "customer_line_ledger": _LINE_LEDGER,
    "customer_doc_ledger": _ledger(
        _DOC_ROWS, "customer_id, lunas_id", "id", f"{_PARTY}, {_i('id', 'id')}, descriptions, trx_date"),
    "special_line_ledger": _ledger("""
        SELECT o.customer_id, o.lunas_id, o.id AS doc_id, 1 AS branch, l.id AS line_id, o.created_at AS trx_date,
               'Order #' || o.id || ', ' || p.name AS descriptions, l.qty, l.unit_name AS unit, l.price,
               l.subtotal AS debt, 0 AS cred
        FROM m_special_details l JOIN m_special_orders o ON o.id = l.order_id JOIN m_products p ON p.id = l.product_id
        UNION ALL
        SELECT customer_id, lunas_id, id, 2, 0, created_at, coalesce(descriptions, 'DP ORDER ID: #' || id),
               0, '-', 0, 0, cash FROM m_special_orders WHERE cash > 0
        UNION ALL
        SELECT customer_id, lunas_id, order_id, 3, id, payment_at, 'Angsuran #' || order_id || ', ' || pay_num,
               0, '-', 0, 0, nominal FROM m_special_payments""",
        "customer_id, lunas_id", "doc_id, branch, line_id",
        f"{_PARTY}, {_i('doc_id', 'doc_id')}, branch, {_i('line_id', 'line_id')}, trx_date, descriptions, "
        f"{_l('qty', 'qty')}, unit, {_l('price', 'price')}"),
    "special_doc_ledger": _ledger("""
        SELECT customer_id, lunas_id, id, coalesce(descriptions, 'ORDER ID#: ' || id) AS descriptions,
               created_at AS trx_date, total AS debt, cash AS cred FROM m_special_orders
        UNION ALL SELECT customer_id, lunas_id, id, pay_num, payment_at, 0, nominal FROM m_special_payments""",
        "customer_id, lunas_id", "id", f"{_PARTY}, {_i('id', 'id')}, descriptions, trx_date"),
    "supplier_ledger": _ledger("""
        SELECT supplier_id, id, stock_num AS trx_ref, CAST(NULL AS VARCHAR) AS descriptions, stock_date AS trx_date,
               total AS debt, cash AS cred FROM m_stocks
        UNION ALL SELECT s.supplier_id, p.id, p.pay_num, NULL, p.pay_date, 0, p.nominal
        FROM m_stock_payments p JOIN m_stocks s ON s.id = p.stock_id""",
        "supplier_id", "id", "supplier_id, id, trx_ref, descriptions, trx_date"),
    "product_stock_card": f"""
        SELECT {_i('product_id', 'product_id')}, {_i('id', 'id')}, trx_date, faktur, name, {_m('real_qty', 'real_qty')},
               unit_name, {_l('debt', 'debt')}, {_l('cred', 'cred')},
               {_t('sum(real_qty) OVER (PARTITION BY product_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'balance')}
        FROM (
            SELECT id AS product_id, 0 AS id, '-' AS trx_date, 'Stock Awal' AS faktur, name, first_stock AS real_qty,
                   unit AS unit_name, first_stock AS debt, 0 AS cred FROM m_products
            UNION ALL
            SELECT l.product_id, l.id, strftime(s.stock_date, '%d-%m-%Y'), s.stock_num, p.name, l.real_qty, l.unit_name, l.qty, 0
            FROM m_stock_details l JOIN m_stocks s ON s.id = l.stock_id JOIN m_suppliers p ON p.id = s.supplier_id
            UNION ALL
            SELECT l.product_id, l.id, strftime(g.order_date, '%d-%m-%Y'), 'PEMBELIAN #' || g.id, c.name, l.real_qty, l.unit_name, l.qty, 0
            FROM m_grass_details l JOIN m_grass g ON g.id = l.grass_id JOIN m_customers c ON c.id = g.customer_id
            UNION ALL
            SELECT l.product_id, l.id, strftime(o.order_date, '%d-%m-%Y'), 'ORDER #' || o.id, c.name, -l.real_qty, l.unit_name, 0, l.qty
            FROM m_order_details l JOIN m_orders o ON o.id = l.order_id JOIN m_customers c ON c.id = o.customer_id
            UNION ALL
            SELECT l.product_id, l.id, strftime(o.created_at, '%d-%m-%Y'), o.surat_jalan, c.name, -l.real_qty, l.unit_name, 0, l.qty
            FROM m_special_details l JOIN m_special_orders o ON o.id = l.order_id JOIN m_customers c ON c.id = o.customer_id)""",
    # balances
    "customer_balance": _summary("customer_id, lunas_id", _DEBTS, "debt > 0 OR cred > 0").replace(
        "SELECT customer_id, lunas_id, CAST(id", f"SELECT {_PARTY}, CAST(id", 1),
    "special_balance": _summary("customer_id, lunas_id", """
        SELECT customer_id, lunas_id, 1 AS id, 'Piutang Dagang' AS descriptions, total AS debt, cash AS cred FROM m_special_orders
        UNION ALL SELECT customer_id, lunas_id, 2, 'Angsuran', 0, nominal FROM m_special_payments
        UNION ALL SELECT customer_id, lunas_id, n, IF(n = 1, 'Piutang Dagang', 'Angsuran'), 0, 0
        FROM (SELECT customer_id, lunas_id FROM m_special_orders
              UNION SELECT customer_id, lunas_id FROM m_special_payments
              UNION SELECT id, 0 FROM m_customers) CROSS JOIN (VALUES (1), (2)) AS v(n)""", "true").replace(
        "SELECT customer_id, lunas_id, CAST(id", f"SELECT {_PARTY}, CAST(id", 1),
    "supplier_balance": _summary("supplier_id", """
        SELECT supplier_id, 1 AS id, 'Piutang Barang' AS descriptions, total AS debt, cash AS cred FROM m_stocks
        UNION ALL SELECT s.supplier_id, 2, 'Angsuran', 0, p.nominal
        FROM m_stock_payments p JOIN m_stocks s ON s.id = p.stock_id""", "debt > 0 OR cred > 0"),
    # profit
    "profit_lines": _profit_lines("true"),
    "profit_lines_retail": _profit_lines(
        "order_type = 0 AND order_date BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1997-02-28 23:59:00'"),
    "profit_lines_wholesale": _profit_lines(
        "order_type = 1 AND order_date BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1997-02-28 23:59:00'"),
    "profit_by_order": f"""
        SELECT strftime(order_date, '%Y-%m-%d') AS order_day, {_i('order_id', 'id')}, {_i('order_type', 'order_type')},
               c.name AS customer_name, {_SUMMED}
        FROM ({_SALES}) s JOIN m_customers c ON c.id = s.customer_id
        WHERE order_date <= date_trunc('day', order_date) + INTERVAL 1439 MINUTE GROUP BY 1, 2, 3, 4""",
    "profit_by_order_of_day": f"""
        SELECT strftime(order_date, '%Y-%m-%d') AS order_day, {_i('order_id', 'id')}, {_i('order_type', 'order_type')},
               c.name AS customer_name, {_SUMMED}
        FROM ({_SALES}) s JOIN m_customers c ON c.id = s.customer_id
        WHERE order_date BETWEEN TIMESTAMP '1996-03-05 00:00:00' AND TIMESTAMP '1996-03-05 23:59:00' GROUP BY 1, 2, 3, 4""",
    "profit_lines_both": _profit_lines("order_date BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1996-03-31 23:59:00'"),
    "profit_by_day_of_month": _by_day("year(order_date) = 1996 AND month(order_date) = 3"),
    "profit_by_month_of_month": _by_month("year(order_date) = 1996 AND month(order_date) = 3"),
    "profit_of_urgent_orders": _of_order(0) + " AND order_id IN (SELECT o_orderkey * 16 + 1 FROM orders WHERE o_orderpriority = '1-URGENT')",
    "profit_by_day": _by_day("true"),
    "profit_by_day_of_year": _by_day("year(order_date) = 1996"),
    "profit_by_month": _by_month("true"),
    "profit_by_month_of_year": _by_month("year(order_date) = 1996"),
    "profit_of_order": _of_order(0),
    "profit_of_special_order": _of_order(1),
    # derived columns
    "order_lines_derived": "SELECT id, real_qty, subtotal FROM m_order_details",
    "stock_lines_derived": "SELECT id, real_qty, subtotal FROM m_stock_details",
    "special_lines_derived": "SELECT id, real_qty, subtotal FROM m_special_details",
    "purchase_lines_derived": "SELECT id, real_qty, subtotal FROM m_grass_details",
    "purchase_costs_derived": "SELECT id, subtotal FROM m_costs",
    "remaining_payment": f"""
        SELECT 'orders' AS table_name, id, {_m('total - payment', 'remain_payment')} FROM m_orders
        UNION ALL SELECT 'stocks', id, {_m('total - (cash + payments)', 'remain_payment')} FROM m_stocks
        UNION ALL SELECT 'special_orders', id, {_m('total - cash - payments', 'remain_payment')} FROM m_special_orders""",
    # rollups
    "order_totals": _totals("m_orders", "SELECT order_id AS id, subtotal FROM m_order_details", total="subtotal"),
    "special_totals": _totals("m_special_orders", "SELECT order_id AS id, subtotal FROM m_special_details", total="subtotal"),
    "stock_totals": _totals("m_stocks", "SELECT stock_id AS id, subtotal FROM m_stock_details", total="subtotal"),
    "purchase_totals": _totals("m_grass", _GROSS_NET.format(lines="m_lines", costs="m_costs"), qty="r.qty", total="r.total"),
    "purchase_costs": _totals("m_grass", "SELECT grass_id AS id, subtotal FROM m_costs", cost="subtotal"),
    "stock_payments_rollup": _totals("m_stocks", "SELECT stock_id AS id, nominal FROM m_stock_payments", payments="nominal"),
    "special_payments_rollup": _totals(
        "m_special_orders", "SELECT order_id AS id, nominal FROM m_special_payments", payments="nominal"),
    "stock_on_hand": f"SELECT id, {_t('stock', 'stock')} FROM m_on_hand",
    "order_totals_delta": _totals("m_orders", "SELECT doc_id AS id, subtotal FROM m_after WHERE kind = 1", total="subtotal"),
    "special_totals_delta": _totals(
        "m_special_orders", "SELECT doc_id AS id, subtotal FROM m_after WHERE kind = 2", total="subtotal"),
    "stock_totals_delta": _totals("m_stocks", "SELECT doc_id AS id, subtotal FROM m_after WHERE kind = 4", total="subtotal"),
    "purchase_totals_delta": _totals(
        "m_grass", _GROSS_NET.format(lines="m_after", costs="m_costs"), qty="r.qty", total="r.total"),
    "purchase_costs_delta": _totals("m_grass", """
        SELECT doc_id AS id, subtotal AS total, 0 AS cost FROM m_lines WHERE kind = 3
        UNION ALL SELECT grass_id, -subtotal, subtotal FROM m_costs_after""", total="r.total", cost="r.cost"),
    "stock_payments_delta": _totals("m_stocks", _paid_after("SELECT * FROM m_instalments", "stock_id", "500000 * 16 + 4"), payments="nominal"),
    "special_payments_delta": _totals("m_special_orders", _paid_after(
        "SELECT event_id, lunas_id, order_key * 16 + 2 AS order_id, amount AS nominal FROM m_events WHERE event_type = 'view'",
        "order_id", "16 + 2"), payments="nominal"),
    "cascade_batch": _cascade(),
    "customer_ledger_of": f"SELECT * FROM ({_LINE_LEDGER}) WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)",
    "keyed_merge": f"""SELECT {_i('id + CASE n WHEN 2 THEN 1000000000 ELSE 0 END', 'id')}, name,
        {_l('CASE WHEN n = 1 AND p_size <= 10 THEN price + 1 ELSE price END', 'price')}, {_l('CASE WHEN n = 2 THEN 0 ELSE first_stock END', 'first_stock')}
        FROM m_products CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE n = 1 AND p_size < 45 OR n = 2 AND p_size = 20""",
    "ledger_delta": _ledger(f"SELECT * FROM ({_DOC_ROWS}) WHERE descriptions <> 'Purchase 5-LOW'",
                            "customer_id, lunas_id", "id", f"{_PARTY}, {_i('id', 'id')}, descriptions, trx_date"),
    "stock_on_hand_delta": f"""
        SELECT p.id, {_t('first_stock + coalesce(sum(CASE WHEN kind IN (3, 4) THEN real_qty ELSE -real_qty END), 0)', 'stock')}
        FROM m_products p LEFT JOIN m_after a ON a.product_id = p.id GROUP BY p.id, first_stock""",
    "opening_stock_shift": f"""
        SELECT p.id, {_m('CASE WHEN p_size <= 25 THEN 2 * first_stock ELSE first_stock END', 'first_stock')},
               {_m('h.stock + CASE WHEN p_size <= 25 THEN first_stock ELSE 0 END', 'stock')}
        FROM m_products p JOIN m_on_hand h ON h.id = p.id""",
    "unit_price_refresh": f"""
        SELECT u.id, product_id,
               {_m('CASE WHEN p.price < 950 THEN base * content ELSE buy_price END', 'buy_price')},
               {_m('CASE WHEN p.price < 950 THEN base * content + base * content * margin ELSE u.price END', 'price')}
        FROM m_units u JOIN (SELECT id, price, CAST(price * CAST(1.07 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS base
                             FROM m_products) p ON p.id = u.product_id""",
    # profit share, settlements
    "profit_share_payments": f"""
        SELECT {_i('id', 'id')}, {_i('customer_id', 'customer_id')}, {_i('ref_id', 'ref_id')}, payment_date,
               {_m('total', 'total')}, {_i('lunas_id', 'lunas_id')}, descriptions
        FROM (SELECT id, customer_id, ref_id, payment_date, total, lunas_id, descriptions FROM m_payments
              UNION ALL
              SELECT (g.id // 16) * 16 + 10, partner_id, g.id, order_date,
                     CASE WHEN total_div = 0 THEN 5 ELSE total_div + 1 END, 0,
                     'Bagi hasil dengan ' || c.name || ' (' || format('{{:,}}', CAST(qty AS BIGINT)) || ' kg )'
              FROM m_grass g JOIN m_customers c ON c.id = g.customer_id WHERE lunas_id = 0 AND priority <> '5-LOW')""",
    "settlement_carried": f"""
        SELECT {_i('id * 16 + 9', 'id')}, {_i('customer_id', 'customer_id')}, 'Saldo piutang pelunasan ID #' || id AS descriptions,
               TIMESTAMP '2024-02-01' AS kasbon_date, TIMESTAMP '2024-02-08' AS jatuh_tempo, {_l('remain_payment', 'total')},
               {_i('coalesce(next_id, 0)', 'lunas_id')}, {_i('id', 'ref_lunas_id')}
        FROM m_next WHERE remain_payment > 0""",
    "settlement_apply": _STAMPS + "m_stamped",
    "settlement_amend": f"""
        SELECT {_i('k.id', 'id')}, {_i('k.customer_id', 'customer_id')}, kasbon_date, jatuh_tempo,
               {_l('k.total', 'total')}, {_i('lunas_id', 'lunas_id')}, {_i('ref_lunas_id', 'ref_lunas_id')}
        FROM (SELECT k.id, k.customer_id, kasbon_date, jatuh_tempo, total, 0 AS ref_lunas_id,
                     CASE WHEN lunas_id = 0 AND first_id IS NOT NULL THEN first_id ELSE lunas_id END AS lunas_id
              FROM m_kasbons k LEFT JOIN m_first f ON f.customer_id = k.customer_id
              UNION ALL
              SELECT id * 16 + 9, customer_id, TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-08',
                     CASE WHEN remain_payment = 0 THEN 250 ELSE remain_payment - 1000 END, id,
                     CASE WHEN remain_payment = 0 THEN 0 ELSE coalesce(next_id, 0) END
              FROM m_next WHERE remain_payment = 0 OR remain_payment > 1000) k""",
    "settlement_revoke": _STAMPS + """(
        SELECT s.table_name, s.id, s.customer_id, CASE WHEN l.id IS NOT NULL THEN 0 ELSE s.lunas_id END AS lunas_id
        FROM m_stamped s LEFT JOIN m_lunas l
             ON l.id = s.lunas_id AND l.customer_id = s.customer_id AND l.remain_payment = 0)""",
    # change application
    "apply_inserts": f"""SELECT id, order_id, product_id, qty, price,
        {_l('CASE WHEN qty > 25 THEN 0 ELSE discount END', 'discount')} FROM m_order_details""",
    "apply_updates": f"""SELECT id, name, CASE WHEN p_size <= 25 THEN NULL ELSE spec END AS spec,
        {_l('CASE WHEN p_size <= 25 THEN price + 1 ELSE price END', 'price')} FROM m_products""",
    "updated_rows": f"""SELECT id, name, CAST(NULL AS VARCHAR) AS spec, {_l('price + 1', 'price')}
        FROM m_products WHERE p_size <= 25""",
    "apply_deletes": f"SELECT id, customer_id, {_m('total', 'total')} FROM m_orders WHERE total <> 0",
    "deleted_ids": "SELECT id FROM m_orders WHERE total = 0",
    "insert_products": f"""SELECT id, category_id, name, spec, price, {_l('0', 'stock')}, first_stock, unit
        FROM m_products WHERE price > 950""",
    "insert_units": "SELECT id, product_id, name, price, is_default AND name <> 'ls' AS is_default FROM m_units",
    "set_default_units": """
        SELECT u.id, u.product_id, CASE WHEN x.unit_id IS NULL THEN is_default ELSE u.id = x.unit_id END AS is_default
        FROM m_units u LEFT JOIN (SELECT product_id, arg_max(unit_id, id) AS unit_id FROM m_special_details GROUP BY 1) x
             ON x.product_id = u.product_id""",
    # data quality
    "dup_keys": _dup_keys(),
    "dup_natural_keys": _dup_natural(),
    "orphans": _orphans(),
    "bad_values": _bad_values(),
    "customer_types": """SELECT customer_type, count(*) AS n_rows,
        customer_type IN ('Bandeng', 'Rumput Laut', 'Pabrik') AS valid FROM m_customers GROUP BY 1""",
    "bad_customer_type": """SELECT c_custkey AS id, c_mktsegment AS customer_type FROM customer WHERE c_acctbal < 0""",
    "repeated_line_numbers": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "orders_nobody_placed": """SELECT event_id * 3 AS id, count(*) AS n FROM events WHERE event_id * 3 NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""",
    "bad_customer_values": """
        SELECT 'customers' AS table_name, count(*) AS n_rows, 'name' AS column_name,
               count(*) FILTER (c_acctbal < 0) AS n_null, count(*) FILTER (c_acctbal > 9000) AS n_too_long FROM customer""",
    "cascade_costs": """SELECT id, grass_id, subtotal FROM m_costs
        WHERE grass_id IN (SELECT id FROM m_grass WHERE lunas_id = 0)""",
    "blocked_deletes": _blocked(),
    "stock_drift": f"""
        SELECT p.id, {_t('p.stock', 'stored')}, {_t('h.stock', 'recomputed')}, {_t('p.stock - h.stock', 'difference')}
        FROM m_products p JOIN m_on_hand h ON h.id = p.id""",
    "total_drift": f"""
        SELECT o.id, {_t('stored', 'stored')}, {_t('o.total', 'recomputed')}, {_t('stored - o.total', 'difference')}
        FROM m_orders o JOIN (SELECT o_orderkey * 16 + 1 AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS stored
                              FROM orders) s ON s.id = o.id""",
    # continuous form: the state after the whole feed
    "stream_stock": f"SELECT product_id, {_t('sum(moved)', 'moved')} FROM m_moves GROUP BY product_id",
    "stream_balance": f"""SELECT {_i('customer_id', 'party_id')}, {_t('sum(debt - cred)', 'balance')}
        FROM ({_DEBTS}) GROUP BY customer_id""",
}


def with_model(body: str) -> str:
    """``body`` behind the model subqueries it needs, in order."""
    needed, queue = set(), [body]
    while queue:
        for name in set(re.findall(r"\bm_\w+", queue.pop())) & set(MODEL) - needed:
            needed.add(name)
            queue.append(MODEL[name])
    parts = [f"{name} AS ({sql})" for name, sql in MODEL.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def sql() -> dict[str, str]:
    return {name: with_model(body) for name, body in QUERIES.items()}
