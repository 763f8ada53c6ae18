"""Table shapes and declared constraints of the trade-ledger model.

Column lists, lengths, keys and references are fixed values: a caller's files
must have exactly these names for the reports to find their columns.  Ids are
``bigint`` so that they do not run out at cluster scale.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Columns, types and nullability per table.
DDL = {
    "categories": """
        id bigint not null, name varchar(50) not null,
        created_at timestamp, updated_at timestamp""",
    "products": """
        id bigint not null, name varchar(50) not null, spec varchar(50),
        price decimal(12,2) not null, stock decimal(12,2) not null,
        first_stock decimal(12,2) not null, unit varchar(6) not null,
        update_notif boolean not null, category_id bigint not null""",
    "units": """
        product_id bigint not null, id bigint not null, name varchar(50) not null,
        content decimal(8,2) not null, price decimal(12,2) not null,
        buy_price decimal(12,2) not null, margin decimal(5,4) not null,
        is_default boolean""",
    "customers": """
        id bigint not null, name varchar(50) not null, street varchar(128),
        city varchar(50), phone varchar(25), customer_type string not null""",
    "suppliers": """
        id bigint not null, name varchar(50) not null, sales_name varchar(50),
        street varchar(128), city varchar(50), phone varchar(25),
        cell varchar(25), email varchar(50)""",
    "orders": """
        id bigint not null, customer_id bigint not null, order_date timestamp not null,
        total decimal(12,2) not null, payment decimal(12,2) not null,
        remain_payment decimal(12,2) not null, descriptions varchar(128) not null,
        lunas_id bigint not null""",
    "order_details": """
        order_id bigint not null, id bigint not null, unit_id bigint not null,
        qty decimal(10,2) not null, content decimal(8,2) not null,
        unit_name varchar(6) not null, real_qty decimal(10,2) not null,
        price decimal(12,2) not null, subtotal decimal(12,2) not null,
        buy_price decimal(12,2) not null, product_id bigint not null,
        discount decimal(12,2) not null""",
    "special_orders": """
        id bigint not null, customer_id bigint not null, created_at timestamp not null,
        updated_at timestamp not null, packaged_at timestamp not null,
        shipped_at timestamp not null, driver_name varchar(50) not null,
        police_number varchar(15) not null, street varchar(128) not null,
        city varchar(50) not null, phone varchar(25) not null,
        total decimal(12,2) not null, cash decimal(12,2) not null,
        payments decimal(12,2) not null, remain_payment decimal(12,2) not null,
        descriptions varchar(128), lunas_id bigint not null,
        surat_jalan varchar(50) not null""",
    "special_details": """
        order_id bigint not null, id bigint not null, product_id bigint not null,
        unit_id bigint not null, qty decimal(10,2) not null,
        unit_name varchar(6) not null, price decimal(12,2) not null,
        subtotal decimal(12,2) not null, content decimal(8,2) not null,
        real_qty decimal(10,2) not null, buy_price decimal(12,2) not null""",
    "special_payments": """
        customer_id bigint not null, order_id bigint not null, id bigint not null,
        descriptions varchar(128), payment_at timestamp not null,
        nominal decimal(12,2) not null, pay_num varchar(50) not null,
        lunas_id bigint not null""",
    "stocks": """
        id bigint not null, supplier_id bigint not null, stock_num varchar(50) not null,
        stock_date timestamp not null, total decimal(12,2) not null,
        cash decimal(12,2) not null, payments decimal(12,2) not null,
        remain_payment decimal(12,2) not null, descriptions varchar(128)""",
    "stock_details": """
        stock_id bigint not null, id bigint not null, product_id bigint not null,
        unit_id bigint not null, qty decimal(10,2) not null,
        content decimal(8,2) not null, unit_name varchar(6) not null,
        real_qty decimal(10,2) not null, price decimal(12,2) not null,
        subtotal decimal(12,2) not null, discount decimal(12,2) not null""",
    "stock_payments": """
        id bigint not null, stock_id bigint not null, pay_num varchar(50) not null,
        pay_date timestamp not null, nominal decimal(12,2) not null,
        descriptions varchar(128)""",
    "grass": """
        customer_id bigint not null, id bigint not null, descriptions varchar(128) not null,
        order_date timestamp not null, total decimal(12,2) not null,
        qty decimal(10,2) not null, total_div decimal(12,2) not null,
        lunas_id bigint not null, partner_id bigint not null,
        cost decimal(12,2) not null""",
    "grass_details": """
        grass_id bigint not null, id bigint not null, unit_id bigint not null,
        qty decimal(10,2) not null, content decimal(8,2) not null,
        unit_name varchar(6) not null, real_qty decimal(10,2) not null,
        price decimal(12,2) not null, subtotal decimal(12,2) not null,
        buy_price decimal(12,2) not null, product_id bigint not null""",
    "grass_costs": """
        grass_id bigint not null, id bigint not null, memo varchar(128) not null,
        qty decimal(12,2) not null, price decimal(12,2) not null,
        subtotal decimal(12,2) not null, created_at timestamp not null,
        updated_at timestamp not null, unit varchar(6) not null""",
    "kasbons": """
        id bigint not null, customer_id bigint not null, descriptions varchar(128) not null,
        kasbon_date timestamp not null, jatuh_tempo timestamp not null,
        total decimal(12,2) not null, lunas_id bigint not null,
        ref_lunas_id bigint not null""",
    "payments": """
        id bigint not null, customer_id bigint not null, descriptions varchar(50) not null,
        ref_id bigint not null, payment_date timestamp not null,
        total decimal(12,2) not null, lunas_id bigint not null""",
    "lunas": """
        id bigint not null, customer_id bigint not null,
        remain_payment decimal(12,2) not null, descriptions varchar(128),
        created_at timestamp not null, updated_at timestamp not null""",
}

# The customer kinds.
CUSTOMER_TYPES = ("Bandeng", "Rumput Laut", "Pabrik")

# Natural keys that must be unique.
NATURAL_KEYS = {
    "categories": ("name",),
    "stock_details": ("stock_id", "product_id"),
    "customers": ("name",),
    "order_details": ("order_id", "unit_id"),
    "products": ("name",),
    "units": ("product_id", "name"),
    "suppliers": ("name",),
}

# Child table, child column, parent table.
FOREIGN_KEYS = (
    ("products", "category_id", "categories"),
    ("grass", "customer_id", "customers"),
    ("kasbons", "customer_id", "customers"),
    ("orders", "customer_id", "customers"),
    ("payments", "customer_id", "customers"),
    ("order_details", "product_id", "products"),
    ("order_details", "unit_id", "units"),
    ("grass_costs", "grass_id", "grass"),
    ("grass_details", "product_id", "products"),
    ("grass_details", "unit_id", "units"),
    ("grass_details", "grass_id", "grass"),
    ("order_details", "order_id", "orders"),
    ("units", "product_id", "products"),
    ("stock_details", "product_id", "products"),
    ("stock_details", "unit_id", "units"),
    ("special_payments", "customer_id", "customers"),
    ("special_payments", "order_id", "special_orders"),
    ("stock_details", "stock_id", "stocks"),
    ("stock_payments", "stock_id", "stocks"),
    ("stocks", "supplier_id", "suppliers"),
    ("lunas", "customer_id", "customers"),
    ("special_orders", "customer_id", "customers"),
    ("special_details", "order_id", "special_orders"),
    ("special_details", "product_id", "products"),
    ("special_details", "unit_id", "units"),
)

# The one reference whose children go with their parent instead of blocking it.
CASCADING = ("grass_costs", "grass_id", "grass")

NOW = "now"    # stands for the time of the insert

# What an omitted column gets on insert.
DEFAULTS = {
    "categories": {"created_at": NOW, "updated_at": NOW},
    "products": {"price": 0, "stock": 0, "first_stock": 0, "update_notif": False, "category_id": 0},
    "units": {"product_id": 0, "content": 0, "price": 0, "buy_price": 0, "margin": 0, "is_default": False},
    "customers": {"customer_type": "Bandeng"},
    "suppliers": {},
    "orders": {"total": 0, "payment": 0, "remain_payment": 0, "lunas_id": 0},
    "order_details": {"qty": 0, "content": 0, "real_qty": 0, "price": 0, "subtotal": 0, "buy_price": 0, "discount": 0},
    "special_orders": {"created_at": NOW, "updated_at": NOW, "packaged_at": NOW, "shipped_at": NOW, "total": 0,
                       "cash": 0, "payments": 0, "remain_payment": 0, "lunas_id": 0, "surat_jalan": "-"},
    "special_details": {"price": 0, "subtotal": 0, "content": 0, "real_qty": 0, "buy_price": 0},
    "special_payments": {"order_id": 0, "nominal": 0, "lunas_id": 0},
    "stocks": {"total": 0, "cash": 0, "payments": 0, "remain_payment": 0},
    "stock_details": {"qty": 0, "content": 0, "real_qty": 0, "price": 0, "subtotal": 0, "discount": 0},
    "stock_payments": {"nominal": 0},
    "grass": {"total": 0, "qty": 0, "total_div": 0, "lunas_id": 0, "partner_id": 0, "cost": 0},
    "grass_details": {"qty": 0, "content": 0, "real_qty": 0, "price": 0, "subtotal": 0, "buy_price": 0},
    "grass_costs": {"qty": 0, "price": 0, "subtotal": 0, "created_at": NOW, "updated_at": NOW},
    "kasbons": {"total": 0, "lunas_id": 0, "ref_lunas_id": 0},
    "payments": {"ref_id": 0, "total": 0, "lunas_id": 0},
    "lunas": {"remain_payment": 0, "created_at": NOW, "updated_at": NOW},
}


def declared(table: str) -> T.StructType:
    """The declared schema, ``varchar`` lengths included."""
    return T.StructType.fromDDL(DDL[table])


def read_schema(table: str) -> T.StructType:
    """The schema to read files with: ``varchar(n)`` becomes plain string."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType,
                      True)
        for f in declared(table)
    ])
