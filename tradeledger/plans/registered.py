"""Every report and operator as a runnable query over the test tables.

Each query takes ``(spark, sf_dir)`` and runs over whole tables.  Change sets
come from the data itself: lines with a low tax rate are deleted, middle ones
changed (some moved to another document or product), high ones inserted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeledger import schema
from tradeledger.functions.dates import from_epoch
from tradeledger.functions.money import LINE, MONEY, cents
from tradeledger.functions.text import camel_fields
from tradeledger.operators import cascade, catalog, changes, derive, quality, rollups, settle, shares
from tradeledger.plans import balances, kept, ledgers, profit
from tradeledger.session import tune
from tradeledger.sources import buckets, clustered, conform, ranked, sinks, text
from tradeledger.streaming import live

c = F.col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register ``fn(tables)`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(conform.load(tune(spark), sf_dir))
    QUERIES[fn.__name__] = run
    return fn


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


# ---- sources and sinks -------------------------------------------------

@query
def load_tsv(t):
    path = sinks.staging_path(t.products.sparkSession, "products-tsv")
    text.save_tsv(t.products.select(*[f.name for f in schema.declared("products")]), path)
    return text.load_table_tsv(t.products.sparkSession, path, "products")


@query
def load_rejects(t):
    """Products as text lines, some of them spoiled by their size; how many lines are sound, and what is wrong with the others."""
    spark = t.products.sparkSession
    path, shape = sinks.staging_path(spark, "products-odd"), schema.declared("products")
    size = c("first_stock")
    spoiled = t.products.select(*[f.name for f in shape]).withColumns({
        "name": F.when(size == 2, F.repeat("name", 9)).when(size == 3, F.concat("name", F.lit(chr(92)))).otherwise(c("name")),
        "id": F.when(size != 4, c("id")), "price": F.when(size == 5, F.lit("dear")).otherwise(c("price").cast("string"))})
    cells = [F.coalesce(c(f.name).cast("string"), F.lit(text.NULL_MARK)) for f in shape]
    spoiled.select(F.when(size == 6, F.concat_ws("\t", *cells[:-1])).otherwise(F.concat_ws("\t", *cells))).write.text(path)
    return text.load_balance(text.checked_tsv(spark, path, shape))


@query
def append_rows(t):
    """Receipt lines appended in two batches, then read back."""
    path = sinks.staging_path(t.products.sparkSession, "receipt-lines")
    lines = t.stock_details.select("id", "stock_id", "product_id", "qty", "real_qty", "subtotal")
    sinks.append_rows(lines.where(c("qty") <= 25), path)
    sinks.append_rows(lines.where(c("qty") > 25), path)
    return t.products.sparkSession.read.parquet(path)


@query
def camel_products(t):
    return camel_fields(t.products)


@query
def stock_date_from_epoch(t):
    stocks = t.columns("stocks", "id", "stock_date").select("id", F.unix_timestamp(c("stock_date").cast("timestamp")).alias("seconds"))
    return stocks.select("id", "seconds", from_epoch("seconds").cast("timestamp_ntz").alias("stock_date"))


# ---- listings and lookups ----------------------------------------------

@query
def categories_page(t):
    return catalog.page(t.categories, "name").select("id", "name")


@query
def products_page(t):
    return catalog.page(t.products, "name", skip=40)


@query
def deep_page(t):
    """A page of sales by customer behind 10,000 others, read from the ranges that hold it."""
    spark = t.products.sparkSession
    path = sinks.staging_path(spark, "ranked-orders")
    ranked.store(t.columns("orders", "id", "customer_id", "order_date", "lunas_id"), path, ["customer_id"], "id", 32)
    return ranked.page(spark, path, ["customer_id"], "id", 10_000, 50)


@query
def suppliers_page(t):
    return catalog.page(t.suppliers, "name").select("id", "name", "city")


@query
def stocks_page(t):
    return catalog.page(t.stocks, "stock_num").select("id", "stock_num", "supplier_id", "total", "remain_payment")


def _as_text(df, lists, *fields):
    """Nested lists as one text column, so that two engines can compare them."""
    item = lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])
    return df.withColumn(lists, F.array_join(F.transform(F.coalesce(c(lists), F.array()), item), ";"))


@query
def category_products(t):
    nested = catalog.category_products(t.categories.select("id", "name"), t.products)
    return _as_text(nested, "products", "id", "name", "price")


@query
def product_units(t):
    nested = catalog.product_units(t.products.select("id", "name"), t.units)
    return _as_text(nested, "units", "id", "name", "price")


@query
def supplier_by_id(t):
    """Suppliers that delivered something."""
    return catalog.by_keys(t.suppliers, t.columns("stocks", "supplier_id").distinct()).select("id", "name", "city")


@query
def stock_by_id(t):
    """Receipts with instalments."""
    return catalog.by_keys(t.stocks, t.stock_payments.select("stock_id")).select(
        "id", "supplier_id", "stock_num", "stock_date", "total", "cash", "payments", "remain_payment")


@query
def stock_lines(t):
    """Lines of the receipts with instalments."""
    return catalog.by_keys(t.stock_details, t.stock_payments.select("stock_id"), "stock_id")


@query
def stock_line_by_id(t):
    """Receipt lines with a discount, by their ids."""
    keys = t.stock_details.where(c("discount") > 0).select("id")
    return catalog.by_keys(t.stock_details, keys).select("id", "stock_id", "product_id", "discount", "subtotal")


@query
def units_of_product(t):
    """Units of the products sold wholesale."""
    return catalog.by_keys(t.units, t.special_details.select("product_id").distinct(), "product_id")


@query
def unit_by_id(t):
    """Units used in wholesale lines."""
    return catalog.by_keys(t.units, t.special_details.select("unit_id").distinct())


# ---- ledgers and balances ----------------------------------------------

for _fn in (ledgers.customer_line_ledger, ledgers.special_line_ledger, ledgers.customer_doc_ledger,
            ledgers.special_doc_ledger, ledgers.supplier_ledger, ledgers.product_stock_card,
            balances.customer_balance, balances.special_balance, balances.supplier_balance,
            profit.profit_lines, profit.profit_by_order, profit.profit_by_day, profit.profit_by_month,
            profit.profit_of_order):
    query(_fn)


@query
def profit_lines_retail(t):
    return profit.profit_lines(t, "1996-03-01", "1997-02-28", profit.RETAIL)


@query
def profit_lines_wholesale(t):
    return profit.profit_lines(t, "1996-03-01", "1997-02-28", profit.WHOLESALE)


@query
def profit_by_order_of_day(t):
    return profit.profit_by_order(t, "1996-03-05")


@query
def profit_lines_both(t):
    return profit.profit_lines(t, "1996-03-01", "1996-03-31")


@query
def profit_by_day_of_month(t):
    return profit.profit_by_day(t, 1996, 3)


@query
def profit_by_month_of_month(t):
    return profit.profit_by_month(t, 1996, 3)


@query
def profit_of_urgent_orders(t):
    return profit.profit_of_order(t, 0, t.orders.where("descriptions = 'Sale 1-URGENT'").select("id"))


@query
def profit_by_day_of_year(t):
    return profit.profit_by_day(t, 1996)


@query
def profit_by_month_of_year(t):
    return profit.profit_by_month(t, 1996)


@query
def profit_of_special_order(t):
    return profit.profit_of_order(t, 1)


# ---- derived columns ---------------------------------------------------

@query
def order_lines_derived(t):
    return derive.order_lines(t.order_details.drop("real_qty", "subtotal")).select("id", "real_qty", "subtotal")


@query
def stock_lines_derived(t):
    return derive.stock_lines(t.stock_details.drop("real_qty", "subtotal")).select("id", "real_qty", "subtotal")


@query
def special_lines_derived(t):
    return derive.special_lines(t.special_details.drop("real_qty", "subtotal")).select("id", "real_qty", "subtotal")


@query
def purchase_lines_derived(t):
    return derive.purchase_lines(t.grass_details.drop("real_qty", "subtotal")).select("id", "real_qty", "subtotal")


@query
def purchase_costs_derived(t):
    return derive.purchase_costs(t.grass_costs.drop("subtotal")).select("id", "subtotal")


@query
def remaining_payment(t):
    """Remainders of all three payable documents."""
    out = {"orders": derive.order_remainder(t.orders), "stocks": derive.stock_remainder(t.stocks),
           "special_orders": derive.special_remainder(t.special_orders)}
    return _union([df.select(F.lit(n).alias("table_name"), "id", "remain_payment") for n, df in out.items()])


# ---- rollups, full form ------------------------------------------------

@query
def order_totals(t):
    return rollups.order_totals(t.orders, t.order_details)


@query
def special_totals(t):
    return rollups.special_totals(t.special_orders, t.special_details)


@query
def stock_totals(t):
    return rollups.stock_totals(t.stocks, t.stock_details)


@query
def purchase_totals(t):
    return rollups.purchase_totals(t.grass, t.grass_details, t.grass_costs)


@query
def purchase_costs(t):
    return rollups.purchase_costs(t.grass, t.grass_costs)


@query
def stock_payments_rollup(t):
    return rollups.stock_payments(t.stocks, t.stock_payments)


@query
def special_payments_rollup(t):
    return rollups.special_payments(t.special_orders, t.special_payments)


@query
def stock_on_hand(t):
    return rollups.stock_on_hand(t)


# ---- rollups, delta form -----------------------------------------------

def _op(low: str, high: str, column: str = "tax"):
    return F.when(c(column) <= F.lit(low).cast(LINE), "D").when(c(column) <= F.lit(high).cast(LINE), "U").otherwise("I")


def _line_change(t, code: int, parent: str):
    """Lines before the change, and the change set, for one line table."""
    lines = t.lines(code).withColumn("op", _op("0.02", "0.05"))
    shown = ["id", parent, "product_id", "real_qty", "subtotal"]
    before = lines.where(c("op") != "I").withColumnRenamed("doc_id", parent).select(*shown)
    update = c("op") == "U"
    edited = lines.withColumns({
        parent: F.when(update & (c("rate") >= F.lit("0.05").cast(LINE)), conform.doc_id(c("product_id"), code))
        .otherwise(c("doc_id")),
        "product_id": F.when(update & (c("rate") <= F.lit("0.02").cast(LINE)), c("supplier_id"))
        .otherwise(c("product_id")),
        "qty": F.when(update, c("qty") + 1).otherwise(c("qty")).cast("decimal(10,2)"),
    })
    again = derive.order_lines if code in (conform.ORDER, conform.RECEIPT) else derive.special_lines
    edits = again(edited).select("op", *shown)
    return before, changes.change_set(before, edits, "id")


@query
def order_totals_delta(t):
    before, change = _line_change(t, conform.ORDER, "order_id")
    return rollups.order_totals_delta(rollups.order_totals(t.orders, before), change)


@query
def special_totals_delta(t):
    before, change = _line_change(t, conform.SPECIAL, "order_id")
    return rollups.special_totals_delta(rollups.special_totals(t.special_orders, before), change)


@query
def stock_totals_delta(t):
    before, change = _line_change(t, conform.RECEIPT, "stock_id")
    return rollups.stock_totals_delta(rollups.stock_totals(t.receipts(), before), change)


@query
def purchase_totals_delta(t):
    before, change = _line_change(t, conform.PURCHASE, "grass_id")
    return rollups.purchase_totals_delta(rollups.purchase_totals(t.grass, before, t.grass_costs), change)


@query
def purchase_costs_delta(t):
    costs = t.cost_lines().withColumn("op", _op("0.02", "0.05"))
    shown = ["id", "grass_id", "subtotal"]
    before = costs.where(c("op") != "I").select(*shown)
    update = c("op") == "U"
    edited = costs.withColumns({
        "grass_id": F.when(update & (c("rate") >= F.lit("0.05").cast(LINE)),
                           conform.doc_id(c("product_id"), conform.PURCHASE)).otherwise(c("grass_id")),
        "qty": F.when(update, F.lit(2).cast(LINE)).otherwise(c("qty")),
    })
    change = changes.change_set(before, derive.purchase_costs(edited).select("op", *shown), "id")
    stored = rollups.purchase_totals(t.grass, t.grass_details, before).join(
        rollups.purchase_costs(t.grass, before), "id")
    return rollups.purchase_costs_delta(stored, change).select("id", "total", "cost")


def _instalment_change(t, event: str, id_code: int, doc_code: int, parent: str):
    paid = t.events(event).select(
        conform.doc_id(c("event_id"), id_code).alias("id"), "event_id", "lunas_id", "order_key",
        c("amount").alias("nominal")).withColumn("op", _op("15", "70", "nominal"))
    here = conform.doc_id(c("order_key"), doc_code)
    before = paid.where(c("op") != "I").select("id", here.alias(parent), "nominal")
    update = c("op") == "U"
    moved = conform.doc_id(F.expr("event_id div 4"), doc_code)
    edits = paid.select("op", "id", F.when(update & (c("lunas_id") == 0), moved).otherwise(here).alias(parent),
                        F.when(update, c("nominal") * 2).otherwise(c("nominal")).cast(LINE).alias("nominal"))
    return before, changes.change_set(before, edits, "id")


@query
def stock_payments_delta(t):
    before, change = _instalment_change(t, "error", conform.SUPPLIER_INSTALMENT, conform.RECEIPT, "stock_id")
    return rollups.stock_payments_delta(rollups.stock_payments(t.receipts(), before), change)


@query
def special_payments_delta(t):
    before, change = _instalment_change(t, "view", conform.SPECIAL_INSTALMENT, conform.SPECIAL, "order_id")
    return rollups.special_payments_delta(rollups.special_payments(t.special_orders, before), change)


@query
def stock_on_hand_delta(t):
    kinds = {"stock_details": (conform.RECEIPT, "stock_id"), "grass_details": (conform.PURCHASE, "grass_id"),
             "order_details": (conform.ORDER, "order_id"), "special_details": (conform.SPECIAL, "order_id")}
    made = {name: _line_change(t, code, parent) for name, (code, parent) in kinds.items()}
    stored = rollups.stock_on_hand(t.having(**{name: before for name, (before, _) in made.items()}))
    return rollups.stock_on_hand_delta(stored, {name: change for name, (_, change) in made.items()})


@query
def opening_stock_shift(t):
    """Products up to size 25 get twice their opening stock, on top of the stock on hand."""
    products = t.products.drop("stock").join(rollups.stock_on_hand(t), "id")
    openings = t.products.where(c("first_stock") <= 25).select("id", (c("first_stock") * 2).alias("first_stock"))
    return rollups.opening_stock_shift(products, openings).select("id", "first_stock", "stock")


@query
def unit_price_refresh(t):
    """Products below 950.00 get 7% dearer; their units follow, all others stay."""
    prices = t.products.where(c("price") < 950).select("id", cents(c("price") * F.lit("1.07").cast("decimal(3,2)")).alias("price"))
    return rollups.unit_price_refresh(t.units, prices).select("id", "product_id", "buy_price", "price")


# ---- profit share and settlements --------------------------------------

@query
def profit_share_payments(t):
    """Shares are paid out, then changed, added and withdrawn; at last the purchases of low priority are deleted."""
    new_id = conform.doc_id(F.expr("id div 16"), conform.SHARE)
    paid = shares.profit_share_payments(t.payments, t.grass, t.customers, new_id)
    share = c("total_div")
    later = t.grass.withColumn("total_div", F.when(c("lunas_id") == 1, F.lit(0)).when(share == 0, F.lit(5))
                               .otherwise(share + 1).cast(MONEY))
    changed = shares.profit_share_payments(paid, later, t.customers, new_id)
    gone = t.grass.where("descriptions = 'Purchase 5-LOW'").select("id")
    return shares.profit_share_payments(changed, t.grass.limit(0), t.customers, new_id, gone).select(
        "id", "customer_id", "ref_id", "payment_date", "total", "lunas_id", "descriptions")


def _carry_id():
    return conform.doc_id(c("id"), conform.CARRY_OVER)


def _settled(t):
    return settle.apply_settlements(t, t.lunas, _carry_id())


def _stamps(t):
    return _union([getattr(t, n).select(F.lit(n).alias("table_name"), "id", "customer_id", "lunas_id")
                   for n in settle.STAMPED])


@query
def settlement_carried(t):
    """What the settlements leave unpaid, as advances."""
    return _settled(t).kasbons.where("ref_lunas_id <> 0").select(
        "id", "customer_id", "descriptions", "kasbon_date", "jatuh_tempo", c("total").cast(LINE).alias("total"), "lunas_id", "ref_lunas_id")


@query
def settlement_apply(t):
    return _stamps(_settled(t))


@query
def settlement_amend(t):
    """Settlements change by -1000, those without a remainder get one of 250."""
    remain = c("remain_payment")
    changed = t.lunas.withColumn("remain_payment", F.when(remain == 0, F.lit(250)).otherwise(remain - 1000).cast(LINE))
    return settle.amend_settlements(_settled(t).kasbons, changed, _carry_id()).select(
        "id", "customer_id", "kasbon_date", "jatuh_tempo", "total", "lunas_id", "ref_lunas_id")


@query
def settlement_revoke(t):
    """Settlements without a remainder are revoked again."""
    return _stamps(settle.revoke_settlements(_settled(t), t.lunas.where(c("remain_payment") == 0)))


# ---- change application ------------------------------------------------

@query
def apply_inserts(t):
    """Retail lines from 25 units on are inserted after the others, without a given discount."""
    lines = t.order_details.select("id", "order_id", "product_id", "qty", "price", "discount")
    new = lines.where(c("qty") >= 25).drop("discount")
    old = lines.where(c("qty") <= 25)
    return changes.apply_inserts(old, new, "id", schema.DEFAULTS["order_details"])


def _new_prices(t):
    return t.products.where(c("first_stock") <= 25).select(
        "id", (c("price") + 1).cast(LINE).alias("price"), F.lit(None).cast("string").alias("spec"))


@query
def apply_updates(t):
    return changes.apply_updates(t.products.select("id", "name", "spec", "price"), _new_prices(t), "id")


@query
def updated_rows(t):
    return changes.updated_rows(t.products.select("id", "name", "spec", "price"), _new_prices(t), "id")


def _unsold(t):
    """Sales without lines."""
    return t.orders.where(c("total") == 0).select("id")


@query
def apply_deletes(t):
    return changes.apply_deletes(t.orders, _unsold(t), "id").select("id", "customer_id", "total")


@query
def deleted_ids(t):
    return changes.deleted_ids(t.orders, _unsold(t), "id")


@query
def insert_products(t):
    """Products above 950.00 arrive as new rows without stock or notification flag."""
    old = t.products.where(c("price") <= 950)
    new = t.products.where(c("price") > 950).drop("stock", "update_notif")
    return changes.insert_products(old, new)[1]


@query
def insert_units(t):
    """Packs of 12 arrive as new units; none starts as the default one."""
    units = t.units.select("id", "product_id", "name", "content", "price", "buy_price", "margin", "is_default")
    return changes.insert_units(units.where("name <> 'ls'"), units.where("name = 'ls'")).select("id", "product_id", "name", "price", "is_default")


@query
def set_default_units(t):
    """The unit of a product's highest wholesale line id becomes its default."""
    choices = t.special_details.groupBy("product_id").agg(F.max_by("unit_id", "id").alias("unit_id"))
    return changes.set_default_units(t.units, choices).select("id", "product_id", "is_default")


# ---- a batch with everything that follows ------------------------------

def _line_edits(t, code: int, name: str, parent: str):
    """A whole line table before the change of ``_line_change``, and its edits."""
    lines = t.lines(code).withColumn("op", _op("0.02", "0.05")).withColumnRenamed("doc_id", parent)
    shown = [n for n in getattr(t, name).columns if n not in ("real_qty", "subtotal")]
    update = c("op") == "U"
    edits = lines.withColumns({
        parent: F.when(update & (c("rate") >= F.lit("0.05").cast(LINE)), conform.doc_id(c("product_id"), code)).otherwise(c(parent)),
        "product_id": F.when(update & (c("rate") <= F.lit("0.02").cast(LINE)), c("supplier_id")).otherwise(c("product_id")),
        "qty": F.when(update, c("qty") + 1).otherwise(c("qty")).cast("decimal(10,2)"),
    })
    return lines.where("op <> 'I'").select(*getattr(t, name).columns), edits.select("op", *shown)


_KINDS = {"order_details": (conform.ORDER, "order_id"), "special_details": (conform.SPECIAL, "order_id"),
          "grass_details": (conform.PURCHASE, "grass_id"), "stock_details": (conform.RECEIPT, "stock_id")}


def _before_batch(t):
    """The book before a batch, its documents adding up."""
    lines = {name: _line_edits(t, code, name, parent)[0] for name, (code, parent) in _KINDS.items()}
    costs = t.cost_lines().withColumn("op", _op("0.02", "0.05")).where(c("op") != "I").select(*t.grass_costs.columns)
    paid, _ = _instalment_change(t, "error", conform.SUPPLIER_INSTALMENT, conform.RECEIPT, "stock_id")
    before = t.having(**lines, grass_costs=costs, stock_payments=paid)
    ids = lambda name: t.columns(name, "id")
    # Whole tables on both sides, of which none goes through the driver however small its files are.
    summed = lambda heads, sums: heads.drop(*[n for n in sums.columns if n != "id"]).join(sums.hint("merge"), "id").select(*heads.columns)
    bought = rollups.purchase_totals(ids("grass"), before.grass_details, before.grass_costs).join(rollups.purchase_costs(ids("grass"), before.grass_costs), "id")
    return before.having(
        orders=derive.order_remainder(summed(t.orders, rollups.order_totals(ids("orders"), before.order_details))),
        special_orders=derive.special_remainder(summed(t.special_orders, rollups.special_totals(ids("special_orders"), before.special_details)), stamp=False),
        stocks=derive.stock_remainder(summed(summed(t.stocks, rollups.stock_totals(ids("stocks"), before.stock_details)), rollups.stock_payments(ids("stocks"), paid))),
        grass=summed(t.grass, bought),
        products=summed(t.products, rollups.stock_on_hand(before)),
    )


def _batch_edits(t, orders):
    """The edits of a batch: lines of all kinds, costs and instalments come, move and go, down payments of closed
    sales (among ``orders``, as they are before it) grow, and products get new opening stocks and prices."""
    edits = {name: _line_edits(t, code, name, parent)[1] for name, (code, parent) in _KINDS.items()}
    costs = t.cost_lines().withColumn("op", _op("0.02", "0.05"))
    shown = [n for n in t.grass_costs.columns if n != "subtotal"]
    update = c("op") == "U"
    cost_edits = costs.withColumns({
        "grass_id": F.when(update & (c("rate") >= F.lit("0.05").cast(LINE)), conform.doc_id(c("product_id"), conform.PURCHASE)).otherwise(c("grass_id")),
        "qty": F.when(update, F.lit(2)).otherwise(c("qty")).cast(LINE)})
    _, paid_changes = _instalment_change(t, "error", conform.SUPPLIER_INSTALMENT, conform.RECEIPT, "stock_id")
    edits["grass_costs"] = cost_edits.select("op", *shown)
    edits["stock_payments"] = paid_changes.select("op", "id", c("new_stock_id").alias("stock_id"), c("new_nominal").alias("nominal"))
    edits["orders"] = orders.where("lunas_id = 1").select(F.lit("U").alias("op"), "id", (c("payment") + 5).alias("payment"))
    low = F.when(c("first_stock") <= 25, c("first_stock") * 2).otherwise(c("first_stock"))
    dear = F.when(c("price") < 950, cents(c("price") * F.lit("1.07").cast("decimal(3,2)"))).otherwise(c("price"))
    edits["products"] = t.products.select(F.lit("U").alias("op"), "id", low.alias("first_stock"), dear.alias("price"))
    return edits


@query
def cascade_batch(t):
    """Totals, remainders, stock and unit prices after one batch."""
    t = t.with_staged_lines()
    before = _before_batch(t)
    # What takes shuffles to build is staged; lines and their edits are read off the staged lines.
    before = before.having(**{n: sinks.staged(getattr(before, n), n) for n in ("orders", "special_orders", "stocks", "grass", "products")})
    edits = _batch_edits(t, before.orders)
    after = cascade.apply_change_set(before, edits, conform.doc_id(F.expr("id div 16"), conform.SHARE)).tables
    shown = {"orders": ("total", "payment", "remain_payment"), "special_orders": ("total", "payments", "remain_payment"),
             "stocks": ("total", "payments", "remain_payment"), "grass": ("total", "qty", "cost"),
             "products": ("first_stock", "price", "stock"), "units": ("buy_price", "price", "margin")}
    return _union([
        getattr(after, name).select(F.lit(name).alias("table_name"), "id", *[c(n).cast("decimal(28,4)").alias(f"value_{k}") for k, n in enumerate(columns, 1)])
        for name, columns in shown.items()])


@query
def customer_ledger_of(t):
    """The line ledger of customers deep in debt, read from the files that hold their documents."""
    base = sinks.staging_path(t.products.sparkSession, "clustered")
    names = ["orders", "grass", "kasbons", "payments", "order_details", "grass_details"]
    clustered.write(t, base, names, 16)
    some = t.raw("customer").where("c_acctbal < -900").select("c_custkey")
    return ledgers.customer_line_ledger(clustered.tables_of(t, base, names, some))


# ---- tables and ledgers that change in place -----------------------------

@query
def keyed_merge(t):
    """Stored products: large ones go, small ones get dearer, some come again under new ids, in one published change."""
    store = buckets.Store(t.products.sparkSession, sinks.staging_path(t.products.sparkSession, "products"))
    buckets.create(store, {"products": (t.products, ["id"], 16)})
    size, price = c("first_stock"), c("price").cast(LINE).alias("price")
    edits = _union([
        t.products.where(size <= 10).select(F.lit("U").alias("op"), "id", "name", (c("price") + 1).cast(LINE).alias("price")),
        t.products.where(size >= 45).select(F.lit("D").alias("op"), "id", "name", price),
        t.products.where(size == 20).select(F.lit("I").alias("op"), (c("id") + 1_000_000_000).alias("id"), "name", price),
    ])
    buckets.merge(store, {"products": cascade.changes_of("products", store.read("products"), edits)})
    return store.read("products").select("id", "name", "price", "first_stock")


@query
def ledger_delta(t):
    """The customer ledger by document, stored before small advances arrive late, small instalments are put right
    and purchases of low priority are taken back; each change re-sums the chunks it falls in."""
    rows, name = sinks.staged(ledgers.customer_doc_rows(t), "ledger-rows"), c("descriptions")
    late, wrong, gone = (name == "Advance") & (c("debt") < 30), (name == "Instalment") & (c("cred") < 50), name == "Purchase 5-LOW"
    store = buckets.Store(t.products.sparkSession, sinks.staging_path(t.products.sparkSession, "customer-ledger"))
    shape = kept.Shape(("customer_id", "lunas_id"), ("id",), (("balance", "debt - cred"),))
    kept.build(store, rows.where(~F.coalesce(late, F.lit(False))).withColumn("cred", F.when(wrong, c("cred") + 1).otherwise(c("cred")).cast(MONEY)), shape, 16)
    kept.change(store, shape, rows.where(wrong | gone).select("customer_id", "lunas_id", "id"), rows.where(late | wrong))
    return kept.read(store, shape)


# ---- data quality ------------------------------------------------------

query(quality.dup_keys)
query(quality.dup_natural_keys)
query(quality.orphans)
query(quality.bad_values)


@query
def customer_types(t):
    return quality.customer_types(t.customers)


@query
def bad_customer_type(t):
    """Customers in debt carry a market segment for a type."""
    kinds = t.raw("customer").selectExpr("c_custkey AS id", "IF(c_acctbal < 0, c_mktsegment, 'Pabrik') AS customer_type")
    return quality.bad_customer_type(kinds)


@query
def repeated_line_numbers(t):
    """Line numbers are no key of an order's lines."""
    return quality.duplicates(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def orders_nobody_placed(t):
    """Events read as orders, three ids apart; many have none."""
    return quality.orphan_keys(t.raw("events").selectExpr("event_id * 3 AS order_key"), "order_key", t.raw("orders").selectExpr("o_orderkey AS id"))


@query
def bad_customer_values(t):
    """Names of customers in debt are lost, those of the richest far too long."""
    name = F.when(c("c_acctbal") < 0, F.lit(None)).when(c("c_acctbal") > 9000, F.repeat("name", 40)).otherwise(c("name"))
    odd = t.customers.join(t.raw("customer").select(c("c_custkey").alias("id"), "c_acctbal"), "id")
    odd = odd.withColumn("name", name).drop("c_acctbal")
    return quality.bad_values(t.having(customers=odd)).where("table_name = 'customers' AND column_name = 'name'")


@query
def cascade_costs(t):
    """Closed purchases are deleted; costs of open ones stay."""
    return quality.cascade_costs(t.grass_costs, t.grass.where(c("lunas_id") == 0)).select("id", "grass_id", "subtotal")


@query
def blocked_deletes(t):
    """Why customers cannot be deleted."""
    return quality.blocked_deletes(t, "customers", t.customers)


@query
def stock_drift(t):
    return quality.drift(t.products, "stock", rollups.stock_on_hand(t))


@query
def total_drift(t):
    """The price on the order header against the lines of the retail sale."""
    stored = t.raw("orders").select(conform.doc_id(c("o_orderkey"), conform.ORDER).alias("id"),
                                    c("o_totalprice").cast(MONEY).alias("total"))
    return quality.drift(stored, "total", rollups.order_totals(t.orders, t.order_details))


# ---- continuous form ---------------------------------------------------

def _through(t, name, feed, totals, key, value):
    """Write a feed to the shared folder, run the stream over it, read the result."""
    spark = t.products.sparkSession
    base = sinks.staging_path(spark, name)
    feed.write.parquet(f"{base}/feed")
    shape = live.MOVES if name == "stream_stock" else live.DOCUMENTS
    source = live.read_feed(spark, f"{base}/feed", shape)
    run = live.keep(totals(source), f"{base}/out", f"{base}/checkpoint")
    run.awaitTermination()
    return live.latest(spark, f"{base}/out", key, value)


@query
def stream_stock(t):
    feed = _union([
        getattr(t, n).select(c("id").alias("change_id"), F.lit("2024-02-01").cast("timestamp").alias("changed_at"),
                             "product_id", (c("real_qty") * sign).cast(MONEY).alias("moved"))
        for n, sign in rollups.DIRECTION.items()])
    return _through(t, "stream_stock", feed, live.stock, "product_id", "moved")


@query
def stream_balance(t):
    nothing = F.lit(0).cast(MONEY)
    parts = [(t.orders, c("total"), c("payment")), (t.kasbons, c("total"), nothing),
             (t.grass, nothing, c("total") - c("total_div")), (t.payments, nothing, c("total"))]
    feed = _union([
        df.select(c("id").alias("change_id"), F.lit("2024-02-01").cast("timestamp").alias("changed_at"),
                  c("customer_id").alias("party_id"), debt.cast(MONEY).alias("debt"), cred.cast(MONEY).alias("cred"))
        for df, debt, cred in parts])
    return _through(t, "stream_balance", feed, live.balance, "party_id", "balance")
