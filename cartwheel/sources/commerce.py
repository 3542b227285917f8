"""Commerce tables derived from the TPC-H-style test tables.

The reference reads shop tables (order, line_item, product, ...) from
Postgres. The driver's data is TPC-H shaped, so this module states one
deterministic mapping from those tables to the shop schema (FIXTURES.md) and
derives every shop table with Spark. Each derivation exists twice: as a
DataFrame (used by the jobs) and as DuckDB SQL (used by the oracle twins in
``cartwheel.plans.registry``). Keep the two in step.

Mapping rules (fixed values of this repo, not of the reference):

* order      = orders; money in integer cents; status keeps the TPC-H code and
               'F' plays the role of the excluded statuses (canceled/draft).
* line_item  = lineitem; variant_id = l_partkey.
* product    = part; tags are the words of p_name.
* variant    = part (one variant per product); sku absent for PROMO parts;
               inventory is p_size; ECONOMY parts are not stock-managed.
* price      = one price per part (eur for SMALL parts, usd otherwise) plus a
               second, 10% lower usd price for PROMO parts (price fan-out).
* customer   = customer; created_at = date of the first order.
* region     = one per nation, named after its TPC-H region, so regions of one
               TPC-H region are duplicates by (name, currency_code).
* country    = nation; shipping_option = supplier; users = supplier staff.
* provider links: fulfilment from suppliers, payment from premium customers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import cents
from cartwheel.session import configure

# Statuses that do not count as sales. The reference excludes
# ('canceled', 'draft'); in the TPC-H mapping 'F' stands for both.
EXCLUDED_STATUS = ("F",)

# Low-stock thresholds on the TPC-H mapping: first matching tag wins, else 10.
# (The reference's own rules are in cartwheel.operators.inventory.)
TEST_THRESHOLDS = (("red", 20), ("blue", 15))


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _ts_plus(base: str, unit: str, amount_col: str):
    return F.expr(f"timestampadd({unit}, {amount_col}, TIMESTAMP_NTZ'{base}')")


class Commerce:
    """Lazily derived shop tables over one test-data folder."""

    excluded_status = EXCLUDED_STATUS
    thresholds = TEST_THRESHOLDS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One read per table and instance."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # ----------------------------------------------------------------- sales
    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"),
            cents("o_totalprice").alias("total"),
            F.col("o_orderdate").alias("created_at"),
            F.lit("usd").alias("currency_code"),
        )

    @cached_property
    def line_items(self) -> DataFrame:
        li = self.raw("lineitem")
        qty = F.col("l_quantity").cast("int")
        return li.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("variant_id"),
            qty.alias("quantity"),
            cents("l_extendedprice").alias("total"),
            F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)")
            .alias("unit_price"),
            (F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) div 100"))
            .alias("tax_total"),
        )

    # --------------------------------------------------------------- catalog
    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        tags = F.transform(
            F.split(F.col("p_name"), " "),
            lambda w: F.struct(F.concat(F.lit("ptag_"), w).alias("id"), w.alias("value")),
        )
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("handle"),
            F.col("p_type").alias("type"),
            tags.alias("tags"),
        )

    @cached_property
    def variants(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("title"),
            F.when(F.col("p_type") != "PROMO",
                   F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string"))).alias("sku"),
            # every tenth size is sold out, so the out-of-stock report has rows
            F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).alias("inventory_quantity"),
            (F.col("p_type") != "ECONOMY").alias("manage_inventory"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        p = self.raw("part")
        base = p.select(
            F.col("p_partkey").alias("variant_id"),
            F.when(F.col("p_type") == "SMALL", "eur").otherwise("usd").alias("currency_code"),
            cents("p_retailprice").alias("amount"),
        )
        promo = p.filter(F.col("p_type") == "PROMO").select(
            F.col("p_partkey").alias("variant_id"),
            F.lit("usd").alias("currency_code"),
            F.expr("CAST(round(p_retailprice * 100) AS BIGINT) * 9 div 10").alias("amount"),
        )
        return base.unionByName(promo)

    # ------------------------------------------------------------- customers
    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        first = (self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey"))
                 .agg(F.min("o_orderdate").alias("created_at")))
        parts = F.split(F.col("c_name"), "#")
        return c.join(first, "c_custkey", "left").select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            parts.getItem(0).alias("first_name"),
            F.element_at(parts, 2).alias("last_name"),
            F.concat(F.lit("+"), (F.col("c_nationkey") + 10).cast("string"), F.lit("-"),
                     F.col("c_custkey").cast("string")).alias("phone"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("created_at"),
        )

    # ------------------------------------------------------------- directory
    @cached_property
    def regions(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
            F.concat(F.lit("reg_"), F.col("n_nationkey").cast("string")).alias("id"),
            F.col("r_name").alias("name"),
            F.lower(F.substring("r_name", 1, 3)).alias("currency_code"),
            (F.col("n_regionkey") * 5).cast("double").alias("tax_rate"),
            F.when(F.col("n_regionkey") == 0, F.lit(""))
            .otherwise(F.concat(F.lit("TX"), F.col("n_regionkey").cast("string"))).alias("tax_code"),
            (F.col("n_regionkey") == 1).alias("gift_cards_taxable"),
            F.lit(False).alias("automatic_taxes"),
            F.lit(None).cast("string").alias("tax_provider_id"),
            F.create_map(F.lit("nation"), F.col("n_name")).alias("metadata"),
            _ts_plus("2020-01-01 00:00:00", "DAY", "n_nationkey").alias("created_at"),
            _ts_plus("2020-01-01 00:00:00", "DAY", "n_nationkey").alias("updated_at"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        )

    @cached_property
    def countries(self) -> DataFrame:
        n = self.raw("nation")
        code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
        return n.select(
            F.concat(F.lit("n"), code).alias("iso_2"),
            F.concat(F.lit("na"), code).alias("iso_3"),
            F.col("n_nationkey").alias("num_code"),
            F.col("n_name").alias("name"),
            F.col("n_name").alias("display_name"),
            F.concat(F.lit("reg_"), F.col("n_nationkey").cast("string")).alias("region_id"),
        )

    @cached_property
    def currencies(self) -> DataFrame:
        from cartwheel.operators.maintain import KNOWN_CURRENCIES
        codes = (self.regions.select("currency_code")
                 .unionByName(self.prices.select("currency_code"))
                 .distinct().withColumnRenamed("currency_code", "code"))
        known = self.spark.createDataFrame(KNOWN_CURRENCIES, CURRENCY_SCHEMA)
        return codes.join(F.broadcast(known), "code", "left")

    @cached_property
    def stores(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            F.concat(F.lit("store_"), F.col("r_regionkey").cast("string")).alias("id"),
            F.when(F.col("r_regionkey") != 0, F.concat(F.col("r_name"), F.lit(" store"))).alias("name"),
            F.lower(F.substring("r_name", 1, 3)).alias("default_currency_code"),
            F.lit(None).cast("string").alias("swap_link_template"),
            F.lit(None).cast("string").alias("payment_link_template"),
            F.lit(None).cast("string").alias("invite_link_template"),
            F.lit(None).cast("string").alias("default_sales_channel_id"),
            F.lit(None).cast("string").alias("default_location_id"),
            F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
            _ts("2020-01-01 00:00:00").alias("created_at"),
            _ts("2020-01-01 00:00:00").alias("updated_at"),
        )

    @cached_property
    def store_currencies(self) -> DataFrame:
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return j.select(
            F.concat(F.lit("store_"), F.col("n_regionkey").cast("string")).alias("store_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("usd"))
            .otherwise(F.lower(F.substring("r_name", 1, 3))).alias("currency_code"),
        ).distinct()

    @cached_property
    def shipping_options(self) -> DataFrame:
        s = self.raw("supplier")
        bal = F.col("s_acctbal")
        return s.select(
            F.concat(F.lit("so_"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("reg_"), F.col("s_nationkey").cast("string")).alias("region_id"),
            F.when(bal < 1000, F.lit(None).cast("string"))
            .when(bal < 6000, "sp_01").otherwise("sp_02").alias("profile_id"),
            F.when(bal < 2000, "").when(bal < 7000, "manual").otherwise("courier").alias("provider_id"),
            F.when(bal < 3000, F.lit(None).cast("string"))
            .when(bal < 8000, "flat_rate").otherwise("calculated").alias("price_type"),
            cents(F.abs(bal)).alias("amount"),
            (bal < 500).alias("is_return"),
            F.lit(None).cast("boolean").alias("is_default"),
            (bal > 9500).alias("admin_only"),
            F.lit(None).cast("boolean").alias("includes_tax"),
            F.lit(0).cast("bigint").alias("min_subtotal"),
            F.lit(None).cast("bigint").alias("max_subtotal"),
            F.lit(None).cast(REQUIREMENTS_TYPE).alias("requirements"),
            F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("data"),
            F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
            _ts("2021-01-01 00:00:00").alias("created_at"),
            _ts("2021-01-01 00:00:00").alias("updated_at"),
            F.when(bal < 0, _ts("2023-01-01 00:00:00")).alias("deleted_at"),
        )

    @cached_property
    def shipping_profiles(self) -> DataFrame:
        ids = self.shipping_options.select(F.col("profile_id").alias("id")).filter(
            F.col("id").isNotNull()).distinct()
        return ids.select(
            "id",
            F.concat(F.lit("Profile "), F.col("id")).alias("name"),
            F.when(F.col("id") == "sp_01", "default").alias("type"),
            F.lit(None).cast(T.ArrayType(T.StringType())).alias("products"),
            F.lit(None).cast(T.ArrayType(T.StringType())).alias("shipping_options"),
            F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
            F.when(F.col("id") == "sp_01", _ts("2021-01-01 00:00:00"))
            .otherwise(_ts("2021-06-01 00:00:00")).alias("created_at"),
            _ts("2021-01-01 00:00:00").alias("updated_at"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        )

    @cached_property
    def region_fulfillment_providers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.concat(F.lit("reg_"), F.col("s_nationkey").cast("string")).alias("region_id"),
            F.when(F.col("s_acctbal") < 5000, "manual").otherwise("courier").alias("provider_id"),
        ).distinct()

    @cached_property
    def region_payment_providers(self) -> DataFrame:
        c = self.raw("customer")
        seg = F.col("c_mktsegment")
        return c.filter(F.col("c_acctbal") > 9900).select(
            F.concat(F.lit("reg_"), F.col("c_nationkey").cast("string")).alias("region_id"),
            F.when(seg == "AUTOMOBILE", "stripe").when(seg == "BUILDING", "paypal")
            .otherwise("manual").alias("provider_id"),
        ).distinct()

    @cached_property
    def fulfillment_providers(self) -> DataFrame:
        return (self.region_fulfillment_providers.select(F.col("provider_id").alias("id")).distinct()
                .withColumn("is_installed", F.col("id") != "courier"))

    @cached_property
    def payment_providers(self) -> DataFrame:
        return (self.region_payment_providers.select(F.col("provider_id").alias("id")).distinct()
                .withColumn("is_installed", F.lit(True)))

    @cached_property
    def users(self) -> DataFrame:
        s = self.raw("supplier")
        parts = F.split(F.col("s_name"), "#")
        bal = F.col("s_acctbal")
        return s.select(
            F.concat(F.lit("usr_"), F.col("s_suppkey").cast("string")).alias("id"),
            F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@staff.example.com")).alias("email"),
            parts.getItem(0).alias("first_name"),
            F.element_at(parts, 2).alias("last_name"),
            F.when(bal > 9000, "admin").when(bal < 0, "").alias("role"),
            _ts_plus("2022-01-01 00:00:00", "MINUTE", "s_suppkey").alias("created_at"),
            _ts_plus("2022-01-01 00:00:00", "MINUTE", "s_suppkey").alias("updated_at"),
        )


CURRENCY_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("symbol_native", T.StringType()),
    T.StructField("name", T.StringType()),
])

REQUIREMENTS_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.LongType()),
]))


# --------------------------------------------------------------------------
# The same derivations as DuckDB SQL (common table expressions). Each entry
# lists the CTEs it depends on; ``with_views`` emits them in order.
# --------------------------------------------------------------------------

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "co_order": ((), """
        SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total,
               o_orderdate AS created_at, 'usd' AS currency_code
        FROM orders"""),
    "co_line_item": ((), """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
               l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS variant_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS total,
               CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_price,
               CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100
                 AS tax_total
        FROM lineitem"""),
    "co_product": ((), """
        SELECT p_partkey AS id, p_name AS title, p_brand AS handle, p_type AS type,
               list_transform(string_split(p_name, ' '),
                              lambda w: {'id': 'ptag_' || w, 'value': w}) AS tags
        FROM part"""),
    "co_variant": ((), """
        SELECT p_partkey AS id, p_partkey AS product_id,
               'Size ' || CAST(p_size AS VARCHAR) AS title,
               CASE WHEN p_type <> 'PROMO' THEN 'SKU-' || CAST(p_partkey AS VARCHAR) END AS sku,
               CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END AS inventory_quantity, (p_type <> 'ECONOMY') AS manage_inventory
        FROM part"""),
    "co_price": ((), """
        SELECT p_partkey AS variant_id,
               CASE WHEN p_type = 'SMALL' THEN 'eur' ELSE 'usd' END AS currency_code,
               CAST(round(p_retailprice * 100) AS BIGINT) AS amount
        FROM part
        UNION ALL
        SELECT p_partkey, 'usd', CAST(round(p_retailprice * 100) AS BIGINT) * 9 // 10
        FROM part WHERE p_type = 'PROMO'"""),
    "co_customer": ((), """
        SELECT c.c_custkey AS id,
               lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
               split_part(c.c_name, '#', 1) AS first_name,
               split_part(c.c_name, '#', 2) AS last_name,
               '+' || CAST(c.c_nationkey + 10 AS VARCHAR) || '-' || CAST(c.c_custkey AS VARCHAR) AS phone,
               c.c_nationkey AS nation_id,
               f.created_at
        FROM customer c
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
          ON c.c_custkey = f.o_custkey"""),
    "co_region": ((), """
        SELECT 'reg_' || CAST(n.n_nationkey AS VARCHAR) AS id, r.r_name AS name,
               lower(substr(r.r_name, 1, 3)) AS currency_code,
               CAST(n.n_regionkey * 5 AS DOUBLE) AS tax_rate,
               CASE WHEN n.n_regionkey = 0 THEN '' ELSE 'TX' || CAST(n.n_regionkey AS VARCHAR) END AS tax_code,
               (n.n_regionkey = 1) AS gift_cards_taxable, false AS automatic_taxes,
               CAST(NULL AS VARCHAR) AS tax_provider_id,
               MAP {'nation': n.n_name} AS metadata,
               TIMESTAMP '2020-01-01' + to_days(n.n_nationkey) AS created_at,
               TIMESTAMP '2020-01-01' + to_days(n.n_nationkey) AS updated_at,
               CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "co_country": ((), """
        SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_2,
               'na' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_3,
               n_nationkey AS num_code, n_name AS name, n_name AS display_name,
               'reg_' || CAST(n_nationkey AS VARCHAR) AS region_id
        FROM nation"""),
    "co_currency": (("co_region", "co_price"), """
        SELECT k.code, c.symbol, c.symbol_native, c.name
        FROM (SELECT DISTINCT code FROM (SELECT currency_code AS code FROM co_region
                                         UNION ALL SELECT currency_code FROM co_price)) k
        LEFT JOIN (VALUES {known_currencies}) c(code, symbol, symbol_native, name) ON k.code = c.code"""),
    "co_store": ((), """
        SELECT 'store_' || CAST(r_regionkey AS VARCHAR) AS id,
               CASE WHEN r_regionkey <> 0 THEN r_name || ' store' END AS name,
               lower(substr(r_name, 1, 3)) AS default_currency_code,
               CAST(NULL AS VARCHAR) AS swap_link_template, CAST(NULL AS VARCHAR) AS payment_link_template,
               CAST(NULL AS VARCHAR) AS invite_link_template, CAST(NULL AS VARCHAR) AS default_sales_channel_id,
               CAST(NULL AS VARCHAR) AS default_location_id,
               CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS metadata,
               TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at
        FROM region"""),
    "co_store_currency": ((), """
        SELECT DISTINCT 'store_' || CAST(n.n_regionkey AS VARCHAR) AS store_id,
               CASE WHEN c.c_acctbal < 0 THEN 'usd' ELSE lower(substr(r.r_name, 1, 3)) END AS currency_code
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "co_option": ((), """
        SELECT 'so_' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
               'reg_' || CAST(s_nationkey AS VARCHAR) AS region_id,
               CASE WHEN s_acctbal < 1000 THEN NULL WHEN s_acctbal < 6000 THEN 'sp_01' ELSE 'sp_02' END AS profile_id,
               CASE WHEN s_acctbal < 2000 THEN '' WHEN s_acctbal < 7000 THEN 'manual' ELSE 'courier' END AS provider_id,
               CASE WHEN s_acctbal < 3000 THEN NULL WHEN s_acctbal < 8000 THEN 'flat_rate' ELSE 'calculated' END
                 AS price_type,
               CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS amount,
               (s_acctbal < 500) AS is_return, CAST(NULL AS BOOLEAN) AS is_default,
               (s_acctbal > 9500) AS admin_only, CAST(NULL AS BOOLEAN) AS includes_tax,
               CAST(0 AS BIGINT) AS min_subtotal, CAST(NULL AS BIGINT) AS max_subtotal,
               CAST(NULL AS STRUCT(type VARCHAR, amount BIGINT)[]) AS requirements,
               CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS data,
               CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS metadata,
               TIMESTAMP '2021-01-01' AS created_at, TIMESTAMP '2021-01-01' AS updated_at,
               CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2023-01-01' END AS deleted_at
        FROM supplier"""),
    "co_profile": (("co_option",), """
        SELECT id, 'Profile ' || id AS name, CASE WHEN id = 'sp_01' THEN 'default' END AS type,
               CAST(NULL AS VARCHAR[]) AS products, CAST(NULL AS VARCHAR[]) AS shipping_options,
               CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS metadata,
               CASE WHEN id = 'sp_01' THEN TIMESTAMP '2021-01-01' ELSE TIMESTAMP '2021-06-01' END AS created_at,
               TIMESTAMP '2021-01-01' AS updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM (SELECT DISTINCT profile_id AS id FROM co_option WHERE profile_id IS NOT NULL)"""),
    "co_rfp": ((), """
        SELECT DISTINCT 'reg_' || CAST(s_nationkey AS VARCHAR) AS region_id,
               CASE WHEN s_acctbal < 5000 THEN 'manual' ELSE 'courier' END AS provider_id
        FROM supplier"""),
    "co_rpp": ((), """
        SELECT DISTINCT 'reg_' || CAST(c_nationkey AS VARCHAR) AS region_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'stripe' WHEN 'BUILDING' THEN 'paypal'
                    ELSE 'manual' END AS provider_id
        FROM customer WHERE c_acctbal > 9900"""),
    "co_fprov": (("co_rfp",), """
        SELECT id, id <> 'courier' AS is_installed
        FROM (SELECT DISTINCT provider_id AS id FROM co_rfp)"""),
    "co_pprov": (("co_rpp",), """
        SELECT id, true AS is_installed FROM (SELECT DISTINCT provider_id AS id FROM co_rpp)"""),
    "co_user": ((), """
        SELECT 'usr_' || CAST(s_suppkey AS VARCHAR) AS id,
               lower(replace(s_name, '#', '.')) || '@staff.example.com' AS email,
               split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
               CASE WHEN s_acctbal > 9000 THEN 'admin' WHEN s_acctbal < 0 THEN '' END AS role,
               TIMESTAMP '2022-01-01' + to_minutes(s_suppkey) AS created_at,
               TIMESTAMP '2022-01-01' + to_minutes(s_suppkey) AS updated_at
        FROM supplier"""),
}


def _known_currencies_sql() -> str:
    from cartwheel.operators.maintain import KNOWN_CURRENCIES

    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in KNOWN_CURRENCIES)


def with_views(sql: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in VIEW_SQL[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        body = VIEW_SQL[name][1]
        if "{known_currencies}" in body:
            body = body.replace("{known_currencies}", _known_currencies_sql())
        parts.append(f"{name} AS ({body}\n)")
    parts.extend(f"{name} AS ({body}\n)" for name, body in extra)
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
