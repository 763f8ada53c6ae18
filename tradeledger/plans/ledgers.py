"""Running-balance ledgers, for all parties in one pass.

Every ledger is a union of document streams with signed amounts and a running
sum per party.  Filter the result by party (and settlement): the filter is on
the window's partition columns, so it reaches the file scans.

Rows are ordered inside a party by document id, because ids follow entry order.

Fixed values here are the titles and texts that a ledger shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeledger.functions.dates import day_first
from tradeledger.functions.money import LINE, TOTAL, kept_share, nought, rounded
from tradeledger.operators.running import HOT_ROWS, running

c = F.col


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- customers ---------------------------------------------------------

def _lines_of(details: DataFrame, parent: str, heads: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their document's columns and their product's name."""
    lines = details.selectExpr(f"{parent} AS doc_id", "id AS line_id", "product_id", "qty", "unit_name", "price", "subtotal")
    names = products.selectExpr("id AS product_id", "name AS product")
    return lines.join(heads.withColumnRenamed("id", "doc_id"), "doc_id").join(names, "product_id")


_PARTY = ["customer_id", "lunas_id"]


def _line_keys(t, details: str, parent: str, heads: str, branch: int) -> DataFrame:
    """Where lines stand in a ledger: their document's party and their own id, without names and amounts."""
    held = t.columns(heads, "id", *_PARTY).withColumnRenamed("id", "doc_id")
    lines = t.positions(details, parent, "id").select(c(parent).alias("doc_id"), c("id").alias("line_id"))
    return lines.join(held, "doc_id").selectExpr(*_PARTY, "doc_id", f"{branch} AS branch", "line_id")


def _size(t, *names: str) -> DataFrame:
    """A row per row of the tables."""
    return t.positions_of(names, "id")


_LINE_COLUMNS = ["CAST(line_id AS bigint) AS line_id", f"CAST(qty AS {LINE}) AS qty", "unit_name AS unit",
                 f"CAST(price AS {LINE}) AS price"]
_NO_LINE = ["0L AS line_id", f"{nought(LINE)} AS qty", "'-' AS unit", f"{nought(LINE)} AS price"]


def customer_line_ledger(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customer ledger by line: advances, sale lines, down payments, purchase lines, instalments.

    Purchase lines credit what is left after profit share and costs.  Amounts
    are shown in cents; the balance adds unrounded credits and rounds once.
    """
    def shape(df, branch, day, text, title, debt, cred, line=_NO_LINE, doc="id"):
        return df.selectExpr(
            "customer_id", "lunas_id", f"{doc} AS doc_id", f"{branch} AS branch", f"{day} AS trx_date",
            f"{text} AS descriptions", f"concat_ws('', '{title}', {doc}) AS title", *line,
            f"{rounded(debt)} AS debt", f"{cred} AS exact_cred")

    sales = _lines_of(t.order_details, "order_id",
                      t.columns("orders", "id", "customer_id", "lunas_id", "order_date"), t.products)
    bought = _lines_of(t.grass_details, "grass_id",
                       t.grass.select("id", "customer_id", "lunas_id", "order_date", "total", "total_div", "cost"),
                       t.products)
    rows = _union([
        shape(t.kasbons, 1, "kasbon_date", "descriptions", "Kasbon #", "total", nought()),
        shape(sales, 2, "order_date", "product", "Piutang Barang #", "subtotal", nought(), _LINE_COLUMNS, "doc_id"),
        shape(t.orders.where("payment > 0"), 3, "order_date", "descriptions", "DP Piutang Barang: #", "0", "payment"),
        shape(bought, 4, "order_date", "concat_ws('', product, IF(total_div > 0, ' *', ''))", "Pembelian: #", "0",
              kept_share("subtotal", "total_div", "cost", "total"), _LINE_COLUMNS, "doc_id"),
        shape(t.payments, 5, "payment_date", "descriptions", "Angsuran: #", "0", "total"),
    ])
    keys = _union([_line_keys(t, "order_details", "order_id", "orders", 2), _line_keys(t, "grass_details", "grass_id", "grass", 4)] + [
        t.columns(name, "id", *_PARTY).selectExpr(*_PARTY, "id AS doc_id", f"{branch} AS branch", "0L AS line_id")
        for name, branch in (("kasbons", 1), ("orders", 3), ("payments", 5))])
    ledger = running(rows, ["customer_id", "lunas_id"], ["doc_id", "branch", "line_id"],
                     {"row_no": F.lit(1).cast("bigint"), "exact": c("debt") - c("exact_cred")}, hot_rows, keys,
                     _size(t, "order_details", "grass_details", "kasbons", "orders", "payments"))
    return ledger.selectExpr(
        "customer_id", "lunas_id", "row_no", "doc_id", "branch", "line_id", "trx_date", "descriptions", "title",
        "qty", "unit", "price", "debt", f"{rounded('exact_cred')} AS cred", f"{rounded('exact', TOTAL)} AS balance")


def customer_doc_rows(t) -> DataFrame:
    """What a customer's documents add and take: sales, advances, purchases net of share, instalments."""
    def shape(df, day, debt, cred):
        return df.selectExpr("customer_id", "lunas_id", "id", "descriptions", f"{day} AS trx_date",
                             f"{rounded(debt)} AS debt", f"{rounded(cred)} AS cred")
    return _union([
        shape(t.orders, "order_date", "total", "payment"),
        shape(t.kasbons, "kasbon_date", "total", "0"),
        shape(t.grass, "order_date", "0", "total - total_div"),
        shape(t.payments, "payment_date", "0", "total"),
    ])


def customer_doc_ledger(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customer ledger by document."""
    keys = _union([t.columns(name, *_PARTY, "id") for name in ("orders", "kasbons", "grass", "payments")])
    return _with_balance(customer_doc_rows(t), _PARTY, ["id"], hot_rows, keys, _size(t, "orders", "kasbons", "grass", "payments"))


def special_line_ledger(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Wholesale ledger by line: lines, down payments, instalments (under their order)."""
    def shape(df, branch, day, text, debt, cred, line, doc):
        return df.selectExpr(
            "customer_id", "lunas_id", f"{doc} AS doc_id", f"{branch} AS branch", f"{day} AS trx_date",
            f"{text} AS descriptions", *line, f"{rounded(debt)} AS debt", f"{rounded(cred)} AS cred")

    lines = _lines_of(t.special_details, "order_id",
                      t.columns("special_orders", "id", "customer_id", "lunas_id", "created_at"), t.products)
    rows = _union([
        shape(lines, 1, "created_at", "concat_ws('', 'Order #', doc_id, ', ', product)", "subtotal", "0",
              _LINE_COLUMNS, "doc_id"),
        shape(t.special_orders.where("cash > 0"), 2, "created_at",
              "coalesce(descriptions, concat_ws('', 'DP ORDER ID: #', id))", "0", "cash", _NO_LINE, "id"),
        shape(t.special_payments, 3, "payment_at", "concat_ws('', 'Angsuran #', order_id, ', ', pay_num)", "0",
              "nominal", ["id AS line_id", *_NO_LINE[1:]], "order_id"),
    ])
    keys = _union([
        _line_keys(t, "special_details", "order_id", "special_orders", 1),
        t.columns("special_orders", *_PARTY, "id").selectExpr(*_PARTY, "id AS doc_id", "2 AS branch", "0L AS line_id"),
        t.special_payments.selectExpr(*_PARTY, "order_id AS doc_id", "3 AS branch", "id AS line_id"),
    ])
    return _with_balance(rows, _PARTY, ["doc_id", "branch", "line_id"], hot_rows, keys, _size(t, "special_details", "special_orders", "special_payments"))


def special_doc_ledger(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Wholesale ledger by document: orders against cash, instalments."""
    def shape(df, text, day, debt, cred):
        return df.selectExpr("customer_id", "lunas_id", "id", f"{text} AS descriptions", f"{day} AS trx_date",
                             f"{rounded(debt)} AS debt", f"{rounded(cred)} AS cred")
    rows = _union([
        shape(t.special_orders, "coalesce(descriptions, concat_ws('', 'ORDER ID#: ', id))", "created_at", "total", "cash"),
        shape(t.special_payments, "pay_num", "payment_at", "0", "nominal"),
    ])
    keys = _union([t.columns(name, *_PARTY, "id") for name in ("special_orders", "special_payments")])
    return _with_balance(rows, _PARTY, ["id"], hot_rows, keys, _size(t, "special_orders", "special_payments"))


# ---- suppliers and products -------------------------------------------

def supplier_ledger(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Supplier ledger: receipts against cash, instalments of receipts."""
    def shape(df, reference, day, debt, cred):
        return df.selectExpr("supplier_id", "id", f"{reference} AS trx_ref", "descriptions", f"{day} AS trx_date",
                             f"{rounded(debt)} AS debt", f"{rounded(cred)} AS cred")
    owner = t.columns("stocks", "id", "supplier_id").withColumnRenamed("id", "stock_id")
    rows = _union([
        shape(t.stocks, "stock_num", "stock_date", "total", "cash"),
        shape(t.stock_payments.join(owner, "stock_id"), "pay_num", "pay_date", "0", "nominal"),
    ])
    keys = _union([t.columns("stocks", "supplier_id", "id"), t.columns("stock_payments", "stock_id", "id").join(owner, "stock_id").select("supplier_id", "id")])
    return _with_balance(rows, ["supplier_id"], ["id"], hot_rows, keys, _size(t, "stocks", "stock_payments"))


def product_stock_card(t, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every movement of a product in pack units, with the running stock in base units."""
    def shape(df, day, reference, name, real_qty, unit, debt, cred):
        return df.selectExpr(
            "product_id", "id", f"{day} AS trx_date", f"{reference} AS faktur", f"{name} AS name",
            f"{rounded(real_qty)} AS real_qty", f"{unit} AS unit_name",
            f"CAST({debt} AS {LINE}) AS debt", f"CAST({cred} AS {LINE}) AS cred")

    def moves(details, parent, heads, party, day, reference, parties, incoming):
        """Lines joined to their document and that to its party; the reference is built last."""
        lines = details.selectExpr(f"{parent} AS doc_id", "product_id", "id", "real_qty", "unit_name", "qty")
        held = t.columns(heads, "id", party, day, *reference[1:]).selectExpr("id AS doc_id", f"{party} AS party_id", f"{day} AS day", *reference[1:])
        named = held.join(parties.selectExpr("id AS party_id", "name AS party"), "party_id")
        return shape(lines.join(named, "doc_id"), day_first("day"), reference[0], "party",
                     "real_qty" if incoming else "-real_qty", "unit_name",
                     "qty" if incoming else "0", "0" if incoming else "qty")

    opening = shape(t.products.selectExpr("id AS product_id", "0L AS id", "first_stock", "name", "unit"),
                    "'-'", "'Stock Awal'", "name", "first_stock", "unit", "first_stock", "0")
    rows = _union([
        opening,
        moves(t.stock_details, "stock_id", "stocks", "supplier_id", "stock_date", ["stock_num", "stock_num"],
              t.suppliers, True),
        moves(t.grass_details, "grass_id", "grass", "customer_id", "order_date",
              ["concat_ws('', 'PEMBELIAN #', doc_id)"], t.customers, True),
        moves(t.order_details, "order_id", "orders", "customer_id", "order_date",
              ["concat_ws('', 'ORDER #', doc_id)"], t.customers, False),
        moves(t.special_details, "order_id", "special_orders", "customer_id", "created_at",
              ["surat_jalan", "surat_jalan"], t.customers, False),
    ])
    lines = ("stock_details", "grass_details", "order_details", "special_details")
    keys = t.positions_of(lines, "product_id", "id")
    card = running(rows, ["product_id"], ["id"], {"balance": c("real_qty")}, hot_rows, keys, _size(t, *lines))
    return card.withColumn("balance", c("balance").cast(TOTAL))


def _with_balance(rows: DataFrame, parts: list[str], order: list[str], hot_rows: int, keys: DataFrame, size: DataFrame) -> DataFrame:
    out = running(rows, parts, order, {"balance": c("debt") - c("cred")}, hot_rows, keys, size)
    return out.withColumn("balance", c("balance").cast(TOTAL))
