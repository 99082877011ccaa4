"""Table schemas. Every column of a CSV table is read as text; types exist where an operator parses a column."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _text(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# Names and order of the columns of each kind of input file, and of saved results.
TRANSACTIONS = _text(
    "transaction_id", "store_id", "payment_method_id", "voucher_id", "user_id", "original_amount", "discount_applied", "final_amount", "created_at"
)
TRANSACTION_ITEMS = _text("transaction_id", "item_id", "quantity", "unit_price", "subtotal", "created_at")
MENU_ITEMS = _text("item_id", "item_name", "coffee_category", "price", "is_seasonal", "available_from", "available_to")
STORES = _text("store_id", "store_name", "street", "postal_code", "city", "state", "latitude", "longitude")
USERS = _text("user_id", "gender", "birthdate", "registered_at")

# Codes and folder names of the kinds of tables.
#: By the two-letter code of a table kind; payment methods and vouchers are recognised but have no schema.
BY_KIND = {"TR": TRANSACTIONS, "TI": TRANSACTION_ITEMS, "MN": MENU_ITEMS, "ST": STORES, "US": USERS}
#: Folder names by kind, longest first where one contains another.
FOLDERS = {
    "transaction_items": "TI", "payment_methods": "PM", "transactions": "TR", "menu_items": "MN", "vouchers": "VC", "stores": "ST", "users": "US",
}

STORES_GROUPED = StructType(
    [StructField("year", IntegerType()), StructField("semester", IntegerType()), StructField("store_id", StringType()), StructField("total_final_amount", DoubleType()), StructField("count", LongType())]
)
