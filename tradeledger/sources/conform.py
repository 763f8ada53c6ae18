"""The model built from the wide star-schema test tables.

Production data arrives in the model's own shape (``sources.tables``); this
mapping lets every report run over whole ``lineitem``, ``orders``, ``events``,
``part``, ``customer`` and ``supplier`` tables.

* Every lineitem row becomes one document line.  Its flags say which kind:
  ``N`` retail sale, ``R`` purchase from a customer, of the others status ``O``
  wholesale sale and the rest receipts from a supplier.  A purchase line also
  has a cost.
* Every order becomes one document header of each kind, but one receipt per
  supplier of its receipt lines, or without such lines one of a supplier chosen
  by the order.
* Events become advances (sign-ups and clicks), instalments and wholesale or
  supplier instalments.
* Ids never meet: ``key * 16 + code`` for documents, with
  ``key * 500,000 + n`` as the key of an order's n-th receipt, and
  ``(key * 4 + kind) * 3,000,000 + n`` for lines, so entry order is kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tradeledger.functions.money import LINE, MONEY, QTY, nought, rounded
from tradeledger.operators import derive
from tradeledger.sources.sinks import staged
from tradeledger.sources.tables import Tables

c = F.col

# Codes that keep ids of different documents apart.
ORDER, SPECIAL, PURCHASE, RECEIPT = 1, 2, 3, 4
ADVANCE, INSTALMENT, SPECIAL_INSTALMENT, SUPPLIER_INSTALMENT = 5, 6, 7, 8
CARRY_OVER, SHARE = 9, 10

# Columns of the test tables.  Stating them saves a footer read per table.
TEST_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Order keys of 100 TB (6e11) times four kinds leave room for so many lines of a document.
_LINES_PER_DOCUMENT = 3_000_000
# The same for the receipts of an order, one per supplier.
_RECEIPTS_PER_ORDER = 500_000
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# Which lineitem rows are lines of which document.
KINDS = {
    ORDER: "l_returnflag = 'N'",
    SPECIAL: "NOT l_returnflag <=> 'N' AND NOT l_returnflag <=> 'R' AND l_linestatus = 'O'",
    PURCHASE: "l_returnflag = 'R'",
    RECEIPT: "NOT l_returnflag <=> 'N' AND NOT l_returnflag <=> 'R' AND NOT l_linestatus <=> 'O'",
}

_STEP = "CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END"
_PRICE = rounded("l_extendedprice", LINE)
_RATE = rounded("l_discount", "decimal(4,2)")
_COST = rounded("price * tax", LINE)    # of a purchase line
_PAID = (f"CASE o_orderstatus WHEN 'F' THEN coalesce(total, {nought()}) "
         f"WHEN 'P' THEN {rounded('coalesce(total, 0) * 0.30')} ELSE {nought()} END")
_CLOSED = "CAST(IF(o_orderdate < timestamp_ntz '1998-01-01 00:00:00', 1, 0) AS bigint) AS lunas_id"
_NO_TEXT = "CAST(NULL AS string)"

# Line tables: their kind, and the column of their document.
_LINES = {"order_details": (ORDER, "order_id"), "special_details": (SPECIAL, "order_id"),
          "grass_details": (PURCHASE, "grass_id"), "stock_details": (RECEIPT, "stock_id")}

# What headers have without their lines and payments.
_HEADS = {
    "orders": (ORDER, ["o_custkey AS customer_id", "o_orderdate AS order_date",
                       "concat('Sale ', o_orderpriority) AS descriptions", _CLOSED]),
    "special_orders": (SPECIAL, [
        "o_custkey AS customer_id", *[f"o_orderdate AS {n}" for n in ("created_at", "updated_at", "packaged_at", "shipped_at")],
        "IF(o_orderstatus <> 'O', concat('Wholesale ', o_orderpriority), NULL) AS descriptions", _CLOSED,
        "concat('SJ-', o_orderkey) AS surat_jalan"]),
    "grass": (PURCHASE, ["o_custkey AS customer_id", "o_orderdate AS order_date",
                         "concat('Purchase ', o_orderpriority) AS descriptions", _CLOSED, "o_custkey div 2 AS partner_id"]),
}


def doc_id(key: Column, code: int) -> Column:
    """Id of a document; of receipts the order's first."""
    return (key * _RECEIPTS_PER_ORDER if code in (RECEIPT, SUPPLIER_INSTALMENT) else key) * 16 + F.lit(code)


def _doc(key: str, code: int, n: str = "0") -> str:
    key = f"({key} * {_RECEIPTS_PER_ORDER}L + {n})" if code in (RECEIPT, SUPPLIER_INSTALMENT) else key
    return f"{key} * 16 + {code}"


def _line(key: str, code: int) -> str:
    """Below the ids of a document's lines, above those of earlier ones."""
    return f"({key} * 4 + {code - 1}) * {_LINES_PER_DOCUMENT}L"


def _test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


class Conformed(Tables):
    """Model tables over one folder of test tables, plus the raw line frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._lines: dict[int, DataFrame] = {}
        made = ["categories", "products", "units", "customers", "suppliers", "orders", "order_details",
                "special_orders", "special_details", "special_payments", "stocks", "stock_details",
                "stock_payments", "grass", "grass_details", "grass_costs", "kasbons", "payments", "lunas"]
        super().__init__({name: getattr(self, f"_{name}") for name in made})

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = _test_table(self._spark, self._dir, name)
        return self._raw[name]

    # ---- lines ---------------------------------------------------------

    def lines(self, code: int) -> DataFrame:
        """All lines of one kind with derived amounts, the tax rate and the supplier."""
        if code not in self._lines:
            self._lines[code] = self._numbered_lines(code)
        return self._lines[code]

    def _numbered_lines(self, code: int) -> DataFrame:
        # An order has one document of each kind but receipts, so its lines are placed by the document's id:
        # sums by document and joins with its header find them where they lie.
        lines = self.raw("lineitem").where(KINDS[code])
        if code != RECEIPT:
            lines = lines.withColumn("doc_id", F.expr(_doc("l_orderkey", code)))
        order = Window.partitionBy("l_orderkey" if code == RECEIPT else "doc_id")
        first = ["l_suppkey"] if code == RECEIPT else []
        numbered = lines.withColumn("n", F.row_number().over(order.orderBy(*first, *_LINE_ORDER)).cast("bigint"))
        if code == RECEIPT:     # sorted already
            numbered = numbered.withColumn("receipt", F.dense_rank().over(order.orderBy("l_suppkey")).cast("bigint") - 1)
        discounted = code in (ORDER, RECEIPT)
        lines = numbered.selectExpr(
            "l_orderkey AS order_key", f"{_doc('l_orderkey', code, 'receipt')} AS doc_id" if code == RECEIPT else "doc_id",
            f"{_line('l_orderkey', code)} + n AS id",
            "l_partkey AS product_id",
            f"l_partkey * 3 + {_STEP} AS unit_id",
            f"elt({_STEP} + 1, 'pcs', 'pak', 'ls') AS unit_name",
            f"{rounded('l_quantity', QTY)} AS qty",
            f"CAST(CASE {_STEP} WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 12 END AS decimal(8,2)) AS content",
            f"{_PRICE} AS price",
            f"{rounded(f'{_PRICE} * {_RATE}', LINE) if discounted else nought(LINE)} AS discount",
            f"{rounded(f'{_PRICE} * 0.80', LINE)} AS buy_price",
            f"{rounded('l_tax', 'decimal(4,2)')} AS tax",
            f"{_RATE} AS rate",
            "l_suppkey AS supplier_id", "l_linenumber AS line_number", "l_shipdate AS shipped_at",
        )
        return (derive.order_lines if discounted else derive.special_lines)(lines)

    def with_staged_lines(self) -> "Conformed":
        """The same tables over lines that are numbered once and staged, for jobs that each read them."""
        made = Conformed(self._spark, self._dir)
        made._lines = {code: staged(self.lines(code), f"lines-{code}") for code in KINDS}
        return made

    def _details(self, code: int, parent: str, *extra: str) -> DataFrame:
        return self.lines(code).selectExpr(
            f"doc_id AS {parent}", "id", "product_id", "unit_id", "qty", "content", "unit_name",
            "real_qty", "price", "subtotal", *extra)

    def _order_details(self) -> DataFrame:
        return self._details(ORDER, "order_id", "buy_price", "discount")

    def _special_details(self) -> DataFrame:
        return self._details(SPECIAL, "order_id", "buy_price")

    def _stock_details(self) -> DataFrame:
        return self._details(RECEIPT, "stock_id", "discount")

    def _grass_details(self) -> DataFrame:
        return self._details(PURCHASE, "grass_id", "buy_price")

    def cost_lines(self) -> DataFrame:
        """One cost row per purchase line."""
        return derive.purchase_costs(self.lines(PURCHASE).selectExpr(
            "doc_id AS grass_id", "id", "'transport' AS memo", f"CAST(1 AS {LINE}) AS qty", f"{_COST} AS price",
            "'trip' AS unit", "shipped_at AS created_at", "shipped_at AS updated_at", "tax", "rate", "product_id"))

    def _grass_costs(self) -> DataFrame:
        return self.cost_lines().drop("tax", "rate", "product_id")

    def positions(self, name: str, *columns: str) -> DataFrame:
        """Lines stand where their order's lines begin; numbering them would take a shuffle."""
        if name not in _LINES:
            return self.columns(name, *columns)
        code, parent = _LINES[name]
        return self.raw("lineitem").where(KINDS[code]).selectExpr(
            f"{_doc('l_orderkey', code)} AS {parent}", f"{_line('l_orderkey', code)} AS id", "l_partkey AS product_id").select(*columns)

    def positions_of(self, names: Iterable[str], *columns: str) -> DataFrame:
        """Lines of several kinds come from one scan."""
        lines, rest = [n for n in names if n in _LINES], [n for n in names if n not in _LINES]
        if len(lines) < 2 or not {*columns} <= {"id", "product_id"}:
            return super().positions_of(names, *columns)
        kinds = " ".join(f"WHEN {KINDS[code]} THEN {_line('l_orderkey', code)}" for code, _ in map(_LINES.get, lines))
        placed = self.raw("lineitem").where(" OR ".join(f"({KINDS[_LINES[n][0]]})" for n in lines)).selectExpr(
            f"CASE {kinds} END AS id", "l_partkey AS product_id").select(*columns)
        return placed.unionByName(super().positions_of(rest, *columns)) if rest else placed

    # ---- headers -------------------------------------------------------

    def _sums(self, code: int) -> DataFrame:
        """Per document of one kind: value, base quantity, costs."""
        return self.lines(code).groupBy(c("doc_id").alias("id")).agg(
            F.expr(f"CAST(sum(subtotal) AS {MONEY}) AS total"), F.expr(f"CAST(sum(real_qty) AS {MONEY}) AS qty"),
            F.expr(f"CAST(sum({_COST}) AS {MONEY}) AS cost"))

    def _head(self, name: str) -> DataFrame:
        code, columns = _HEADS[name]
        return self.raw("orders").selectExpr(f"{_doc('o_orderkey', code)} AS id", *columns, "o_orderstatus", "o_orderpriority")

    def columns(self, name: str, *columns: str) -> DataFrame:
        """Lines and payments are read only where the columns need them."""
        bare = self._head(name) if name in _HEADS else self.receipts() if name == "stocks" else None
        return bare.select(*columns) if bare is not None and {*columns} <= {*bare.columns} else super().columns(name, *columns)

    def _orders(self) -> DataFrame:
        out = self._head("orders").join(self._sums(ORDER), "id", "left").selectExpr(
            "id", "customer_id", "order_date", f"coalesce(total, {nought()}) AS total", f"{_PAID} AS payment",
            "descriptions", "lunas_id")
        return derive.order_remainder(out)

    def _special_orders(self) -> DataFrame:
        paid = self.special_payments.groupBy(F.col("order_id").alias("id")).agg(
            F.expr(f"CAST(sum(nominal) AS {MONEY}) AS payments"))
        out = self._head("special_orders").join(self._sums(SPECIAL), "id", "left").join(paid, "id", "left").selectExpr(
            "id", "customer_id", "created_at", "updated_at", "packaged_at", "shipped_at",
            "'driver' AS driver_name", "'plate' AS police_number", "'street' AS street", "'city' AS city",
            "'phone' AS phone", f"coalesce(total, {nought()}) AS total", f"{_PAID} AS cash",
            f"coalesce(payments, {nought()}) AS payments", "descriptions", "lunas_id", "surat_jalan")
        return derive.special_remainder(out, stamp=False)

    def receipts(self) -> DataFrame:
        """Receipt headers without their instalments."""
        heads = self.raw("orders").selectExpr("o_orderkey AS order_key", "o_orderdate AS stock_date", "o_orderkey % 10 AS other_supplier")
        # The lines lie by order already, so neither the sums nor the join move them again.
        sums = self.lines(RECEIPT).groupBy("order_key", "doc_id", "supplier_id").agg(F.expr(f"CAST(sum(subtotal) AS {MONEY}) AS total"))
        made = heads.join(sums, "order_key", "left").withColumn("id", F.coalesce("doc_id", F.expr(_doc("order_key", RECEIPT))))
        return made.selectExpr(
            "id", "coalesce(supplier_id, other_supplier) AS supplier_id",
            f"concat_ws('-', 'ST', order_key, id div 16 % {_RECEIPTS_PER_ORDER} + 1) AS stock_num", "stock_date",
            f"coalesce(total, {nought()}) AS total", f"{rounded('coalesce(total, 0) * 0.20')} AS cash", f"{_NO_TEXT} AS descriptions")

    def _stocks(self) -> DataFrame:
        paid = self.stock_payments.groupBy(F.col("stock_id").alias("id")).agg(
            F.expr(f"CAST(sum(nominal) AS {MONEY}) AS paid"))
        out = self.receipts().join(paid, "id", "left").selectExpr(
            "id", "supplier_id", "stock_num", "stock_date", "total", "cash",
            f"coalesce(paid, {nought()}) AS payments", "descriptions")
        return derive.stock_remainder(out)

    def _grass(self) -> DataFrame:
        net = rounded("coalesce(total, 0) - coalesce(cost, 0)")
        share = f"o_orderpriority IN ('1-URGENT', '2-HIGH') AND {net} > 0"
        return self._head("grass").join(self._sums(PURCHASE), "id", "left").selectExpr(
            "customer_id", "id", "descriptions", "order_date", f"{net} AS total", f"coalesce(qty, {nought()}) AS qty",
            f"IF({share}, {rounded(f'{net} * 0.10')}, {nought()}) AS total_div", "lunas_id", "partner_id",
            f"coalesce(cost, {nought()}) AS cost")

    # ---- events --------------------------------------------------------

    def events(self, *kinds: str) -> DataFrame:
        return self.raw("events").where(c("event_type").isin(*kinds)).selectExpr(
            "event_id", "ts", "user_id", "event_id div 3 AS order_key", f"{rounded('value', LINE)} AS amount",
            "CAST(IF(ts < timestamp_ntz '2024-01-16 00:00:00', 1, 0) AS bigint) AS lunas_id")

    def _kasbons(self) -> DataFrame:
        return self.events("signup", "click").selectExpr(
            f"{_doc('event_id', ADVANCE)} AS id", "user_id AS customer_id", "'Advance' AS descriptions",
            "ts AS kasbon_date", "ts + INTERVAL 7 DAYS AS jatuh_tempo", "amount AS total", "lunas_id",
            "0L AS ref_lunas_id")

    def _payments(self) -> DataFrame:
        return self.events("purchase").selectExpr(
            f"{_doc('event_id', INSTALMENT)} AS id", "user_id AS customer_id", "'Instalment' AS descriptions",
            "0L AS ref_id", "ts AS payment_date", "amount AS total", "lunas_id")

    def _special_payments(self) -> DataFrame:
        owner = self.raw("orders").selectExpr("o_orderkey AS order_key", "o_custkey AS customer_id")
        # Neither events nor orders are few because their files are small.
        return self.events("view").join(owner.hint("merge"), "order_key").selectExpr(
            "customer_id", f"{_doc('order_key', SPECIAL)} AS order_id",
            f"{_doc('event_id', SPECIAL_INSTALMENT)} AS id", f"{_NO_TEXT} AS descriptions", "ts AS payment_at",
            "amount AS nominal", "concat('W-', event_id) AS pay_num", "lunas_id")

    def supplier_instalments(self) -> DataFrame:
        """Instalments of an order's first receipt, before the check that it exists."""
        return self.events("error").selectExpr(
            f"{_doc('event_id', SUPPLIER_INSTALMENT)} AS id", f"{_doc('order_key', RECEIPT)} AS stock_id",
            "concat('S-', event_id) AS pay_num", "ts AS pay_date", "amount AS nominal", f"{_NO_TEXT} AS descriptions")

    def _stock_payments(self) -> DataFrame:
        known = self.raw("orders").selectExpr(f"{_doc('o_orderkey', RECEIPT)} AS stock_id")
        return self.supplier_instalments().join(known.hint("merge"), "stock_id", "left_semi")

    # ---- dimensions ----------------------------------------------------

    def _categories(self) -> DataFrame:
        return self.raw("part").selectExpr("p_brand AS name").distinct().selectExpr(
            f"{_brand_id('name')} AS id", "name", "timestamp_ntz '2021-12-01 00:00:00' AS created_at",
            "timestamp_ntz '2021-12-01 00:00:00' AS updated_at")

    def _products(self) -> DataFrame:
        size = rounded("p_size", LINE)
        return self.raw("part").selectExpr(
            "p_partkey AS id", "concat(p_name, ' #', p_partkey) AS name", "p_type AS spec",
            f"{rounded('p_retailprice', LINE)} AS price", f"{size} AS stock", f"{size} AS first_stock",
            "'pcs' AS unit", "false AS update_notif", f"{_brand_id('p_brand')} AS category_id")

    def _units(self) -> DataFrame:
        """Three packs per product."""
        packs = """inline(array(
            named_struct('k', 0L, 'name', 'pcs', 'content', CAST(1 AS decimal(8,2)), 'margin', CAST(0.30 AS decimal(5,4))),
            named_struct('k', 1L, 'name', 'pak', 'content', CAST(10 AS decimal(8,2)), 'margin', CAST(0.20 AS decimal(5,4))),
            named_struct('k', 2L, 'name', 'ls', 'content', CAST(12 AS decimal(8,2)), 'margin', CAST(0.25 AS decimal(5,4)))))"""
        base = self.raw("part").selectExpr("p_partkey", f"{rounded('p_retailprice', LINE)} AS base", "p_size", packs)
        return base.selectExpr(
            "p_partkey AS product_id", "p_partkey * 3 + k AS id", "name", "content",
            f"{rounded('base * content + base * content * margin')} AS price",
            f"{rounded('base * content')} AS buy_price", "margin",
            "k = CASE WHEN p_size <= 16 THEN 0 WHEN p_size <= 33 THEN 1 ELSE 2 END AS is_default")

    def _customers(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS city")
        return self.raw("customer").join(nation, "c_nationkey", "left").selectExpr(
            "c_custkey AS id", "c_name AS name", f"{_NO_TEXT} AS street", "city", f"{_NO_TEXT} AS phone",
            "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Pabrik' WHEN 'FURNITURE' THEN 'Rumput Laut' "
            "ELSE 'Bandeng' END AS customer_type")

    def _suppliers(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey AS s_nationkey", "n_name AS city")
        return self.raw("supplier").join(nation, "s_nationkey", "left").selectExpr(
            "s_suppkey AS id", "s_name AS name", f"{_NO_TEXT} AS sales_name", f"{_NO_TEXT} AS street", "city",
            *[f"{_NO_TEXT} AS {n}" for n in ("phone", "cell", "email")])

    def _lunas(self) -> DataFrame:
        """Settlements to apply: one per customer outside FURNITURE, a second for large balances."""
        some = self.raw("customer").where("c_mktsegment <> 'FURNITURE'").selectExpr(
            "c_custkey", f"{rounded('c_acctbal', LINE)} AS balance")
        first = some.selectExpr("c_custkey * 2 + 2 AS id", "c_custkey AS customer_id",
                                f"greatest(balance, {nought(LINE)}) AS remain_payment")
        second = some.where("balance > 5000").selectExpr(
            "c_custkey * 2 + 3 AS id", "c_custkey AS customer_id", f"{rounded('balance - 5000', LINE)} AS remain_payment")
        return first.unionByName(second).selectExpr(
            "id", "customer_id", "remain_payment", "'settled' AS descriptions",
            "timestamp_ntz '2024-02-01 00:00:00' AS created_at", "timestamp_ntz '2024-02-01 00:00:00' AS updated_at")


def _brand_id(brand: str) -> str:
    """``Brand#17`` is category 17."""
    return f"CAST(substring_index({brand}, '#', -1) AS bigint)"


def load(spark: SparkSession, sf_dir: str) -> Conformed:
    return Conformed(spark, sf_dir)
