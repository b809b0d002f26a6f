"""Canonical order, item, menu and customer tables over a folder of star-schema Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comanda.functions.dates import business_date

#: Days from 1998-03-02, a time of orders, to 2024-01-01, where the event stream begins.
WEATHER_SHIFT = 9436


@dataclass
class Shop:
    """Lazy canonical tables; columns that a query does not use never leave the scan."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS INT))").alias("created_on"),
            F.col("o_totalprice").alias("total"), (F.col("o_totalprice") * 0.05).alias("tax_total"), F.col("o_orderpriority").alias("order_from"),
            F.when(F.col("o_orderstatus") == "F", "Success").otherwise("Cancelled").alias("order_status"),
        ).withColumn("business_date", business_date(F.col("created_on")))

    @cached_property
    def success(self) -> DataFrame:
        return self.orders.filter("order_status = 'Success'")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("menu_item_id"), F.col("l_linenumber").alias("line_no"),
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("total_price"), F.col("l_returnflag").alias("flag"),
        )

    @cached_property
    def n_lines(self) -> int:
        """Lines of all kinds, as the files' footers tell."""
        return self.raw("lineitem").count()

    @cached_property
    def n_orders(self) -> int:
        return self.raw("orders").count()

    @cached_property
    def items(self) -> DataFrame:
        return self._lines.filter("flag <> 'R'").drop("flag")

    @cached_property
    def addons(self) -> DataFrame:
        return self._lines.filter("flag = 'R'").drop("flag")

    @cached_property
    def menu(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("menu_item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
            F.element_at(F.array(*map(F.lit, ("COUNT", "g", "kg", "mg"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("unit"),
            F.col("p_size").alias("unit_value"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 7 != 0).alias("is_active"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("is_verified"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))

    @cached_property
    def contacts(self) -> DataFrame:
        """Customers with a phone for every third, shared by two each."""
        phone = F.when(F.col("customer_id") % 3 == 0, F.format_string("+91 98%08d", F.col("customer_id") - F.col("customer_id") % 6))
        return self.customers.select("customer_id", "name", phone.alias("phone"), "is_verified", "nation")

    @cached_property
    def addresses(self) -> DataFrame:
        """Up to three addresses a customer, the second the default where there is one."""
        rows = self.customers.select("customer_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("customer_id") % 4).cast("int")))).alias("k"), "nation").filter("customer_id % 4 > 0")
        return rows.select(
            (F.col("customer_id") * 10 + F.col("k")).alias("address_id"), "customer_id", F.concat(F.lit("House "), (F.col("customer_id") % 90).cast("string")).alias("address_line_1"), F.when(F.col("k") == 3, " ").otherwise(F.concat(F.lit("Flat "), F.col("k").cast("string"))).alias("address_line_2"),
            F.concat(F.lit("City "), F.col("nation").cast("string")).alias("city"), F.when(F.col("k") == 2, True).otherwise(False).alias("is_default"),
        )

    @cached_property
    def mappings(self) -> DataFrame:
        """Point-of-sale ids of the menu: three for each item, of two variants and none."""
        k = F.explode(F.sequence(F.lit(0), F.lit(2)))
        rows = self.menu.select("menu_item_id", "name", "type", k.alias("k"))
        return rows.select((F.col("menu_item_id") * 10 + F.col("k")).alias("pos_id"), "menu_item_id", F.when(F.col("k") > 0, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("variant_id"), ((F.col("menu_item_id") + F.col("k")) % 3 != 0).alias("is_verified"))

    @cached_property
    def variant_lines(self) -> DataFrame:
        """Lines of sales with a variant by quantity, null for some."""
        return self.sold.select("order_id", "menu_item_id", F.when(F.col("quantity") % 4 > 0, F.concat(F.lit("v"), (F.col("quantity") % 4).cast("int").cast("string"))).alias("variant_id"), "quantity", "total_price", "kind")

    @cached_property
    def verified_orders(self) -> DataFrame:
        """Success orders of verified customers, the base of the customer metrics."""
        return self.success.join(self.customers.filter("is_verified").select("customer_id", "name"), "customer_id")

    @cached_property
    def sold(self) -> DataFrame:
        """Main lines and add-ons as one table of sales, never joined with each other."""
        return self.items.withColumn("kind", F.lit("item")).unionByName(self.addons.withColumn("kind", F.lit("addon")))

    @cached_property
    def weather(self) -> DataFrame:
        """One row a day: temperature and rain from the event stream's values, moved to the orders' years."""
        e = self.raw("events").groupBy(F.date_sub(F.to_date("ts"), WEATHER_SHIFT).alias("day"))
        return e.agg(F.round(F.avg("value"), 4).alias("temp_max"), F.round(F.max("value") / 100, 4).alias("rain_sum"))


#: The same tables as DuckDB common table expressions, for the oracle.
ORACLE_TABLES = """WITH o AS (SELECT *, CAST(created_on - INTERVAL 5 HOUR AS DATE) AS bd FROM (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_on, o_totalprice AS total, o_totalprice * 0.05::DOUBLE AS tax_total, o_orderpriority AS order_from, CASE WHEN o_orderstatus = 'F' THEN 'Success' ELSE 'Cancelled' END AS order_status FROM orders)),
ok AS (SELECT * FROM o WHERE order_status = 'Success'),
l AS (SELECT l_orderkey AS order_id, l_partkey AS menu_item_id, l_linenumber AS line_no, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS total_price, l_returnflag AS flag FROM lineitem),
i AS (SELECT * EXCLUDE flag FROM l WHERE flag <> 'R'),
a AS (SELECT * EXCLUDE flag FROM l WHERE flag = 'R'),
m AS (SELECT p_partkey AS menu_item_id, p_name AS name, p_type AS type, ['COUNT', 'g', 'kg', 'mg'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS unit, p_size AS unit_value, p_retailprice AS price, p_partkey % 7 <> 0 AS is_active FROM part),
c AS (SELECT c_custkey AS customer_id, c_name AS name, c_acctbal > 0 AS is_verified, c_mktsegment AS segment, c_nationkey AS nation FROM customer),
vo AS (SELECT ok.*, c.name FROM ok JOIN c USING (customer_id) WHERE c.is_verified),
sold AS (SELECT *, 'item' AS kind FROM i UNION ALL SELECT *, 'addon' AS kind FROM a),
ct AS (SELECT customer_id, name, CASE WHEN customer_id % 3 = 0 THEN '+91 98' || lpad(CAST(customer_id - customer_id % 6 AS VARCHAR), 8, '0') END AS phone, is_verified, nation FROM c),
ads AS (SELECT customer_id * 10 + k AS address_id, customer_id, 'House ' || customer_id % 90 AS address_line_1, CASE WHEN k = 3 THEN ' ' ELSE 'Flat ' || k END AS address_line_2, 'City ' || nation AS city, k = 2 AS is_default FROM c, range(1, 4) t(k) WHERE k <= customer_id % 4),
mp AS (SELECT menu_item_id * 10 + k AS pos_id, menu_item_id, CASE WHEN k > 0 THEN 'v' || k END AS variant_id, (menu_item_id + k) % 3 <> 0 AS is_verified FROM m, range(0, 3) t(k)),
vl AS (SELECT order_id, menu_item_id, CASE WHEN quantity % 4 > 0 THEN 'v' || CAST(quantity % 4 AS INTEGER) END AS variant_id, quantity, total_price, kind FROM sold),
w AS (SELECT CAST(ts AS DATE) - 9436 AS day, round(avg(value), 4) AS temp_max, round(max(value) / 100, 4) AS rain_sum FROM events GROUP BY 1)
"""
