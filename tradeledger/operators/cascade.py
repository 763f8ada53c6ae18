"""A batch of edits with everything that follows from it.

Rules are edges of a graph over the tables.  A rule takes the change set of its
table and emits a change to the table it feeds; that table's own edits and all
such changes make its change set, which travels on:

    lines, costs, instalments  ->  documents  ->  remainders, profit-share payments
    lines                      ->  products   ->  units
    settlements                ->  open items, carry-overs

Change sets hold whole rows before and after, only of what changes.  Each is
written to the shared folder once, so several rules read it and a lost executor
costs one step; the stored tables are only joined with keys that a batch touches.

Spark tells from the size of files whether a side of a join is small enough to go
through the driver to every task, and compressed files of many rows are small.  So
up to the unit prices stored tables are never that side, and of staged change sets,
whose rows are counted, only those of up to ``SENT`` rows are.

Columns that follow from others (amounts of lines, totals, remainders, stock) are
never taken from edits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeledger import schema
from tradeledger.functions.money import MONEY, TOTAL, nought, rounded
from tradeledger.operators import derive, rollups, settle, shares
from tradeledger.sources.sinks import staged
from tradeledger.sources.tables import Tables

c = F.col


@dataclass(frozen=True)
class Feeds:
    """A rule: rows of a child table add ``sums`` (parent column: value) to the parent named by ``key``."""

    parent: str
    key: str
    sums: dict[str, str]


# What each table derives from its own row (M1-M5), and what it feeds (M6-M10, M13, M14).
DERIVES = {
    "order_details": derive.order_lines, "stock_details": derive.stock_lines, "special_details": derive.special_lines,
    "grass_details": derive.purchase_lines, "grass_costs": derive.purchase_costs,
}
FEEDS = {
    "order_details": Feeds("orders", "order_id", {"total": "subtotal"}),
    "special_details": Feeds("special_orders", "order_id", {"total": "subtotal"}),
    "stock_details": Feeds("stocks", "stock_id", {"total": "subtotal"}),
    "grass_details": Feeds("grass", "grass_id", {"qty": "real_qty", "total": "subtotal"}),
    "grass_costs": Feeds("grass", "grass_id", {"cost": "subtotal", "total": "-subtotal"}),
    "stock_payments": Feeds("stocks", "stock_id", {"payments": "nominal"}),
    "special_payments": Feeds("special_orders", "order_id", {"payments": "nominal"}),
}
# Columns that only rules write, and the remainders (M11).
KEPT = {"orders": ["total"], "special_orders": ["total", "payments"], "stocks": ["total", "payments"],
        "grass": ["total", "qty", "cost"], "products": ["stock"]}
REMAINDERS = {"orders": derive.ORDER_REMAINDER, "stocks": derive.STOCK_REMAINDER, "special_orders": derive.SPECIAL_REMAINDER}

# Fixed value: so many rows at most may go through the driver to every task.
SENT = 50_000


@dataclass
class Batch:
    """The tables after a batch, and the change set ``id, op, old, new`` of each table that it touched."""

    tables: Tables
    changes: dict[str, DataFrame] = field(default_factory=dict)


def changes_of(name: str, table: DataFrame, edits: DataFrame) -> DataFrame:
    """``id, op, old, new`` of the edits that apply; ``old`` and ``new`` are rows of the table, null where there is none.

    ``edits`` has ``op`` (``I``, ``U``, ``D``), ``id`` and any of the other columns:
    an insert gets defaults for the rest, an update keeps them.  An insert of a
    taken key and a change of an absent row do not apply.  Ids are unique in a batch.
    """
    types, defaults, kept = dict(table.dtypes), schema.DEFAULTS.get(name, {}), KEPT.get(name, [])

    def value(n: str) -> Column:
        if n in kept:
            return F.when(c("op") == "I", F.lit(0)).otherwise(c(f"old.{n}"))
        given = c(f"_e.{n}") if n in edits.columns else c(f"old.{n}")
        if n in defaults:
            default = F.current_timestamp() if defaults[n] == schema.NOW else F.lit(defaults[n])
            given = F.when(c("op") == "I", F.coalesce(given, default.cast(types[n]))).otherwise(given)
        return given

    old = table.select("id", F.struct(*table.columns).alias("old"))
    met = edits.select("id", "op", F.struct(*edits.columns).alias("_e")).join(old.hint("merge"), "id", "left").where((c("op") == "I") == c("old").isNull())
    rows = met.select("id", "op", "old", *[value(n).cast(types[n]).alias(n) for n in table.columns if n != "id"])
    if name in DERIVES:
        rows = DERIVES[name](rows)
    if name == "products":          # M15: the stock moves with the opening stock
        rows = rows.withColumn("stock", F.expr("IF(op = 'I', first_stock, old.stock + first_stock - old.first_stock)"))
    return rows.select("id", "op", "old", F.when(c("op") != "D", F.struct(*[c(n).cast(types[n]).alias(n) for n in table.columns])).alias("new"))


def applied(table: DataFrame, changes: DataFrame, rows: int = 0) -> DataFrame:
    """The table after a change set of so many ``rows``; 0: not known."""
    return table.join(_shuffled(changes.select("id"), rows), "id", "left_anti").select(*table.columns).unionByName(
        changes.where("new IS NOT NULL").select("new.*").select(*table.columns))


def _shuffled(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is not sent to every task if it is of more than ``SENT`` rows."""
    return side.hint("merge") if rows > SENT else side


def signed(changes: DataFrame, key: str, sums: Mapping[str, str], sign: int = 1) -> DataFrame:
    """What a change set adds to each parent: rows after it count, rows before it count against; a moved child corrects both."""
    fields = lambda side, way: ", ".join(f"'{name}', IF({side} IS NULL, NULL, {value})" for name, value in (
        ("id", f"{side}.{key}"), *((n, f"CAST({way * sign} * ({_of(side, v)}) AS {MONEY})") for n, v in sums.items())))
    both = changes.selectExpr(f"inline(array(named_struct({fields('old', -1)}), named_struct({fields('new', 1)})))").where("id IS NOT NULL")
    return rollups.child_sums(both, "id", **{n: n for n in sums})


def _of(side: str, value: str) -> str:
    """A value of ``Feeds.sums``, a column or its negative, of one side."""
    return f"-{side}.{value[1:]}" if value.startswith("-") else f"{side}.{value}"


def _moved(name: str, table: DataFrame, own: DataFrame | None, deltas: list[DataFrame], rows: int) -> DataFrame | None:
    """The change set of a table from its own edits and what its children add, to ``rows`` of its rows at most."""
    if not deltas:
        return own
    names = sorted({n for d in deltas for n in d.columns if n != "id"})
    filled = [d.select("id", *[(c(n) if n in d.columns else F.expr(nought(TOTAL))).alias(n) for n in names]) for d in deltas]
    delta = reduce(DataFrame.union, filled).groupBy("id").agg(*[F.sum(n).alias(f"_d_{n}") for n in names])
    types = dict(table.dtypes)

    def row(prefix: str) -> Column:
        added = lambda n: (c(f"{prefix}{n}") + F.coalesce(c(f"_d_{n}"), F.lit(0))).cast(types[n])
        return F.struct(*[(added(n) if n in names else c(f"{prefix}{n}")).alias(n) for n in table.columns])

    # Rows and edits meet what is added to them on their own, so that neither moves twice.
    touched = delta if own is None else delta.join(own.select("id"), "id", "left_anti")
    fed = table.join(touched.hint("broadcast" if rows <= SENT else "merge"), "id").select("id", F.lit("U").alias("op"), F.struct(*table.columns).alias("old"), row("").alias("new"))
    if own is None:
        return fed
    return fed.unionByName(own.join(_shuffled(delta, rows), "id", "left").select("id", "op", "old", F.when(c("new").isNotNull(), row("new.")).alias("new")))


def _with_remainder(name: str, changes: DataFrame, table: DataFrame, stamp: Column | None) -> DataFrame:
    """M11: what is left to pay; wholesale orders note when it was worked out."""
    flat = changes.select("id", "op", "old", c("new").isNull().alias("_gone"), *[c(f"new.{n}").alias(n) for n in table.columns if n != "id"])
    kind = dict(table.dtypes)
    flat = flat.withColumn("remain_payment", F.expr(REMAINDERS[name]).cast(kind["remain_payment"]))
    if stamp is not None and "updated_at" in kind:
        flat = flat.withColumn("updated_at", stamp.cast(kind["updated_at"]))
    return flat.select("id", "op", "old", F.when(~c("_gone"), F.struct(*table.columns)).alias("new"))


def _units_change(units: DataFrame, own: DataFrame | None, products: DataFrame, rows: int) -> DataFrame:
    """M16: units of products whose price changed, of a change set of so many ``rows``, besides their own edits."""
    prices = _shuffled(products.where("op = 'U' AND NOT old.price <=> new.price").select("id", "new.price"), rows)
    after = units if own is None else applied(units, own)
    hit = after.join(prices.select(c("id").alias("product_id")), "product_id", "left_semi").select(*units.columns)
    fresh = rollups.unit_price_refresh(hit, prices).select(*[c(n).cast(t).alias(n) for n, t in units.dtypes])
    new = fresh.select("id", F.struct(*units.columns).alias("new"))
    old = units.select("id", F.struct(*units.columns).alias("old"))
    priced = new.join(old.hint("merge"), "id", "left").select("id", F.when(c("old").isNull(), "I").otherwise("U").alias("op"), "old", "new")
    return priced if own is None else own.join(priced.select("id"), "id", "left_anti").select("id", "op", "old", "new").unionByName(priced)


def apply_change_set(t: Tables, edits: Mapping[str, DataFrame], new_id: Column, stamp: Column | None = None) -> Batch:
    """All tables after the ``edits`` of a batch (by table) and every rule that they set off.

    ``new_id`` gives the id of a payment or advance that a rule adds from the ``id``
    of its purchase or settlement; ``stamp`` is the time of the batch.  Costs of a
    deleted purchase go with it.  Other children of a deleted row must be deleted
    in the same batch (``quality.blocked_deletes`` tells which are not).
    """
    unknown = set(edits) - set(t.names())
    if unknown:
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    changes: dict[str, DataFrame] = {}
    rows: dict[str, int] = {}

    def settled(name: str, found: DataFrame | None) -> None:
        if found is not None:
            changes[name] = staged(found, f"changes-{name}")
            rows[name] = changes[name].count()      # of staged files, which state it

    # A change set adds to two parents a row at most, the one before and the one after.
    fed = lambda children: sum(2 * rows[n] for n in children)

    own = {n: changes_of(n, getattr(t, n), e) for n, e in edits.items() if n != "lunas"}
    if "grass" in own:                          # V6: costs go with their purchase
        child, key, _ = schema.CASCADING
        gone = own["grass"].where("op = 'D'").select(c("id").alias(key))
        costs = getattr(t, child)
        whole = F.struct(*costs.columns)
        lost = costs.join(gone, key, "left_semi").select("id", F.lit("D").alias("op"), whole.alias("old"), F.when(F.lit(False), whole).alias("new"))
        more = own.get(child)
        own[child] = lost if more is None else more.join(lost.select("id"), "id", "left_anti").unionByName(lost)

    # Lines, costs, instalments (M1-M5), then the documents that they add up to (M6-M11, M13, M14).
    for name in FEEDS:
        settled(name, own.get(name))
    for parent in dict.fromkeys(f.parent for f in FEEDS.values()):
        table = getattr(t, parent)
        children = [n for n, f in FEEDS.items() if f.parent == parent and n in changes]
        deltas = [signed(changes[n], FEEDS[n].key, FEEDS[n].sums) for n in children]
        found = _moved(parent, table, own.get(parent), deltas, fed(children))
        if found is not None and parent in REMAINDERS:
            found = _with_remainder(parent, found, table, stamp)
        settled(parent, found)
    # Stock on hand and opening stock (M6-M9, M15), then unit prices (M16).
    children = [n for n in rollups.DIRECTION if n in changes]
    moves = [signed(changes[n], "product_id", {"stock": "real_qty"}, rollups.DIRECTION[n]) for n in children]
    settled("products", _moved("products", t.products, own.get("products"), moves, fed(children)))
    if "products" in own:
        settled("units", _units_change(t.units, own.get("units"), changes["products"], rows["products"]))
    else:
        settled("units", own.get("units"))
    for name in own:
        if name not in changes:
            settled(name, own[name])
    after = t.having(**{n: applied(getattr(t, n), ch, rows[n]) for n, ch in changes.items()})

    # Profit shares (M12): payments of purchases that are new, changed or gone.
    if "grass" in changes:
        moved = changes["grass"].where("new IS NOT NULL").select("new.*")
        gone = changes["grass"].where("op = 'D'").select("id")
        after = after.having(payments=shares.profit_share_payments(after.payments, moved, after.customers, new_id, gone))
    # Settlements (M17-M19) see everything above.
    if "lunas" in edits:
        after = _settlements(after, edits["lunas"], new_id)
    return Batch(after, changes)


def _settlements(t: Tables, edits: DataFrame, new_id: Column) -> Tables:
    changes = staged(changes_of("lunas", t.lunas, edits), "changes-lunas")
    of = lambda op, side: changes.where(c("op") == op).select(f"{side}.*")
    after = settle.revoke_settlements(t, of("D", "old"))
    after = after.having(kasbons=settle.amend_settlements(after.kasbons, of("U", "new"), new_id))
    after = settle.apply_settlements(after, of("I", "new"), new_id)
    return after.having(lunas=applied(t.lunas, changes, changes.count()))
