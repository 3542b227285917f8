"""Registered maintenance jobs (M1-M18, W1): each returns the new table
version (or the job's report) computed from the derived shop tables. The
change sets are derived from the same data, so the work grows with it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators import maintain as m
from cartwheel.plans.registry import commerce, register, with_views
from cartwheel.session import checkpoint_dir, scratch_path
from cartwheel.sources import file_versions

NOW = dt.datetime(2024, 6, 1)
NOW_SQL = "TIMESTAMP '2024-06-01 00:00:00'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


KNOWN_SQL = ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in m.KNOWN_CURRENCIES)


# ------------------------------------------------------------- upserts
@register("upsert_currencies", with_views(f"""
    SELECT coalesce(t.code, ch.code) AS code,
           CASE WHEN ch.code IS NOT NULL THEN ch.symbol ELSE t.symbol END AS symbol,
           CASE WHEN ch.code IS NOT NULL THEN ch.symbol_native ELSE t.symbol_native END AS symbol_native,
           CASE WHEN ch.code IS NOT NULL THEN ch.name ELSE t.name END AS name
    FROM co_currency t FULL OUTER JOIN (VALUES {KNOWN_SQL}) ch(code, symbol, symbol_native, name)
      ON t.code = ch.code""", "co_currency"))
def upsert_currencies(spark, sf_dir):
    c = commerce(spark, sf_dir)
    from cartwheel.sources.commerce import CURRENCY_SCHEMA
    changes = spark.createDataFrame(m.KNOWN_CURRENCIES, CURRENCY_SCHEMA)
    return m.upsert(c.currencies, changes, "code")


@register("insert_ignore", with_views("""
    SELECT store_id, currency_code FROM co_store_currency
    UNION ALL
    SELECT s.id, 'usd' FROM co_store s
    WHERE NOT EXISTS (SELECT 1 FROM co_store_currency x WHERE x.store_id = s.id AND x.currency_code = 'usd')""",
    "co_store", "co_store_currency"))
def insert_ignore(spark, sf_dir):
    c = commerce(spark, sf_dir)
    want = c.stores.select(F.col("id").alias("store_id"), F.lit("usd").alias("currency_code"))
    return m.insert_ignore(c.store_currencies, want, ["store_id", "currency_code"])


@register("upsert_providers", with_views("""
    SELECT 'fulfillment' AS kind, coalesce(t.id, 'manual') AS id,
           CASE WHEN t.id = 'manual' OR t.id IS NULL THEN true ELSE t.is_installed END AS is_installed
    FROM co_fprov t FULL OUTER JOIN (SELECT 'manual' AS id) ch ON t.id = ch.id
    UNION ALL
    SELECT 'payment', coalesce(t.id, 'manual'),
           CASE WHEN t.id = 'manual' OR t.id IS NULL THEN true ELSE t.is_installed END
    FROM co_pprov t FULL OUTER JOIN (SELECT 'manual' AS id) ch ON t.id = ch.id""", "co_fprov", "co_pprov"))
def upsert_providers(spark, sf_dir):
    c = commerce(spark, sf_dir)
    f = m.upsert_providers(c.fulfillment_providers).select(F.lit("fulfillment").alias("kind"), "*")
    p = m.upsert_providers(c.payment_providers).select(F.lit("payment").alias("kind"), "*")
    return f.unionByName(p)


@register("ensure_default_links", with_views("""
    SELECT 'fulfillment' AS kind, region_id, provider_id FROM co_rfp
    UNION ALL SELECT 'fulfillment', r.id, 'manual' FROM co_region r
      WHERE NOT EXISTS (SELECT 1 FROM co_rfp l WHERE l.region_id = r.id AND l.provider_id = 'manual')
    UNION ALL SELECT 'payment', region_id, provider_id FROM co_rpp
    UNION ALL SELECT 'payment', r.id, 'manual' FROM co_region r
      WHERE NOT EXISTS (SELECT 1 FROM co_rpp l WHERE l.region_id = r.id AND l.provider_id = 'manual')""",
    "co_region", "co_rfp", "co_rpp"))
def ensure_default_links(spark, sf_dir):
    c = commerce(spark, sf_dir)
    f = m.ensure_default_links(c.regions, c.region_fulfillment_providers).select(
        F.lit("fulfillment").alias("kind"), "*")
    p = m.ensure_default_links(c.regions, c.region_payment_providers).select(F.lit("payment").alias("kind"), "*")
    return f.unionByName(p)


# ----------------------------------------------------------- dedupe
INSTANCES_SQL = """
    inst AS (
      SELECT id, name, currency_code, created_at,
             options * greatest(nations, 1) AS shipping_count, nations * greatest(options, 1) AS country_count
      FROM (SELECT id, name, currency_code, created_at,
                   count(*) OVER (PARTITION BY name, currency_code) AS twins,
                   (SELECT count(o.id) FROM co_option o WHERE o.region_id = reg.id) AS options,
                   (SELECT count(k.iso_2) FROM co_country k WHERE k.region_id = reg.id) AS nations
            FROM co_region reg WHERE name IS NOT NULL AND currency_code IS NOT NULL)
      WHERE twins > 1),
    surv AS (
      SELECT *, first_value(id) OVER w AS survivor_id, row_number() OVER w = 1 AS keep FROM inst
      WINDOW w AS (PARTITION BY name, currency_code
                   ORDER BY shipping_count DESC, created_at ASC NULLS LAST, id ASC))"""


def _with_surv(sql: str, *views: str) -> str:
    base = with_views("SELECT 1", "co_region", "co_option", "co_country", *views)
    head = base[: base.rindex("\nSELECT 1")]
    return head + ",\n" + INSTANCES_SQL + "\n" + sql


@register("region_survivor", _with_surv("SELECT * FROM surv"))
def region_survivor(spark, sf_dir):
    c = commerce(spark, sf_dir)
    return m.region_survivor(m.region_instances(c.regions, c.shipping_options, c.countries))


@register("dedupe_regions", _with_surv("""
    SELECT id, name, currency_code FROM co_region
    WHERE id NOT IN (SELECT id FROM surv WHERE NOT keep)"""))
def dedupe_regions(spark, sf_dir):
    return _dedupe(spark, sf_dir)["region"].select("id", "name", "currency_code")


def _dedupe(spark, sf_dir):
    """M10 outputs with the loser -> survivor mapping computed once and
    checkpointed (reliable checkpoint under spark.checkpoint.dir), so the
    five output tables do not each recompute the survivor ranking."""
    c = commerce(spark, sf_dir)
    checkpoint_dir(spark)
    moves = m.region_moves(c.regions, c.shipping_options, c.countries).checkpoint(eager=True)
    return m.dedupe_regions(c.regions, c.shipping_options, c.countries, c.region_fulfillment_providers,
                            c.region_payment_providers, moves=moves)


@register("dedupe_region_children", _with_surv("""
    SELECT 'shipping_option' AS table_name, so.id AS key,
           coalesce(s.survivor_id, so.region_id) AS region_id
    FROM co_option so LEFT JOIN (SELECT id, survivor_id FROM surv WHERE NOT keep) s ON so.region_id = s.id
    UNION ALL
    SELECT 'country', c.iso_2, coalesce(s.survivor_id, c.region_id)
    FROM co_country c LEFT JOIN (SELECT id, survivor_id FROM surv WHERE NOT keep) s ON c.region_id = s.id
    UNION ALL
    SELECT 'region_fulfillment_providers', provider_id, region_id FROM co_rfp
    WHERE region_id NOT IN (SELECT id FROM surv WHERE NOT keep)
    UNION ALL
    SELECT 'region_payment_providers', provider_id, region_id FROM co_rpp
    WHERE region_id NOT IN (SELECT id FROM surv WHERE NOT keep)""", "co_rfp", "co_rpp"))
def dedupe_region_children(spark, sf_dir):
    out = _dedupe(spark, sf_dir)
    return (out["shipping_option"].select(F.lit("shipping_option").alias("table_name"),
                                          F.col("id").alias("key"), "region_id")
            .unionByName(out["country"].select(F.lit("country").alias("table_name"),
                                               F.col("iso_2").alias("key"), "region_id"))
            .unionByName(out["region_fulfillment_providers"].select(
                F.lit("region_fulfillment_providers").alias("table_name"), F.col("provider_id").alias("key"),
                "region_id"))
            .unionByName(out["region_payment_providers"].select(
                F.lit("region_payment_providers").alias("table_name"), F.col("provider_id").alias("key"),
                "region_id")))


# ----------------------------------------------------------- repairs
@register("fill_missing_fields", with_views("""
    SELECT id,
           CASE WHEN deleted_at IS NULL AND coalesce(provider_id, '') = '' THEN 'manual' ELSE provider_id END
             AS provider_id,
           CASE WHEN deleted_at IS NULL AND coalesce(price_type, '') = '' THEN 'flat_rate' ELSE price_type END
             AS price_type,
           CASE WHEN deleted_at IS NULL AND coalesce(profile_id, '') = '' THEN 'sp_01' ELSE profile_id END
             AS profile_id,
           CAST(deleted_at IS NULL AND coalesce(provider_id, '') = '' AS INTEGER)
           + CAST(deleted_at IS NULL AND coalesce(price_type, '') = '' AS INTEGER)
           + CAST(deleted_at IS NULL AND coalesce(profile_id, '') = '' AS INTEGER) AS fixes
    FROM co_option""", "co_option"))
def fill_missing_fields(spark, sf_dir):
    o = m.fill_missing_fields(commerce(spark, sf_dir).shipping_options)
    return o.select("id", "provider_id", "price_type", "profile_id", "fixes")


@register("ensure_store", with_views("""
    SELECT id,
           CASE WHEN id = (SELECT min(id) FROM co_store) THEN coalesce(name, 'Default Store') ELSE name END AS name,
           CASE WHEN id = (SELECT min(id) FROM co_store) THEN 'usd' ELSE default_currency_code END
             AS default_currency_code,
           swap_link_template, created_at
    FROM co_store""", "co_store"))
def ensure_store(spark, sf_dir):
    c = commerce(spark, sf_dir)
    out = m.ensure_store(c.stores, c.store_currencies, NOW)
    return out["store"].select("id", "name", "default_currency_code", "swap_link_template", "created_at")


@register("add_column_backfill", with_views("""
    SELECT id, name, coalesce(includes_tax, false) AS includes_tax
    FROM co_option WHERE deleted_at IS NULL""", "co_option"))
def add_column_backfill(spark, sf_dir):
    o = m.add_column_backfill(commerce(spark, sf_dir).shipping_options)
    return o.filter(F.col("deleted_at").isNull()).select("id", "name", "includes_tax")


@register("merge_metadata", with_views("""
    SELECT id, to_json(CASE WHEN name = 'AMERICA'
                            THEN map_concat(coalesce(metadata, MAP {}), MAP {'created_via': 'admin'})
                            ELSE metadata END) AS metadata
    FROM co_region""", "co_region"))
def merge_metadata(spark, sf_dir):
    c = commerce(spark, sf_dir)
    ids = c.regions.filter(F.col("name") == "AMERICA").select("id")
    return m.merge_metadata(c.regions, ids).select("id", F.to_json("metadata").alias("metadata"))


@register("repair_links", with_views("""
    SELECT 'fulfillment' AS kind, region_id, provider_id FROM co_rfp
    UNION ALL SELECT 'fulfillment', r.id, 'manual' FROM co_region r
      WHERE NOT EXISTS (SELECT 1 FROM co_rfp l WHERE l.region_id = r.id AND l.provider_id IS NOT NULL)
    UNION ALL SELECT 'payment', region_id, provider_id FROM co_rpp
    UNION ALL SELECT 'payment', r.id, 'stripe' FROM co_region r
      WHERE NOT EXISTS (SELECT 1 FROM co_rpp l WHERE l.region_id = r.id AND l.provider_id IS NOT NULL)""",
    "co_region", "co_rfp", "co_rpp"))
def repair_links(spark, sf_dir):
    c = commerce(spark, sf_dir)
    f = m.repair_links(c.regions, c.region_fulfillment_providers, m.DEFAULT_PROVIDER)
    p = m.repair_links(c.regions, c.region_payment_providers, m.DEFAULT_PAYMENT_REPAIR)
    return (f.select(F.lit("fulfillment").alias("kind"), "*")
            .unionByName(p.select(F.lit("payment").alias("kind"), "*")))


# ----------------------------------------------------------- row writes
@register("insert_with_defaults", with_views(f"""
    SELECT id, name, region_id, provider_id, price_type, amount, is_return, admin_only,
           len(requirements) AS requirements, to_json(data) AS data, to_json(metadata) AS metadata,
           created_at
    FROM co_option
    UNION ALL
    SELECT 'so_' || substr(sha256('return-' || r.id), 1, 16), r.name || ' returns', r.id, 'manual', 'flat_rate',
           CAST(NULL AS BIGINT), true, false, 0, '{{}}', '{{}}', {NOW_SQL}
    FROM co_region r
    WHERE NOT EXISTS (SELECT 1 FROM co_option so WHERE so.region_id = r.id AND so.is_return
                      AND so.deleted_at IS NULL)""", "co_option", "co_region"))
def insert_with_defaults(spark, sf_dir):
    c = commerce(spark, sf_dir)
    o = c.shipping_options
    has_return = o.filter(F.col("is_return") & F.col("deleted_at").isNull()).select(F.col("region_id").alias("id"))
    req = c.regions.join(has_return, "id", "left_anti").select(
        F.concat(F.lit("return-"), F.col("id")).alias("request_id"),
        F.concat(F.col("name"), F.lit(" returns")).alias("name"),
        F.col("id").alias("region_id"),
        F.lit(True).alias("is_return"))
    out = m.insert_with_defaults(o, req, NOW)
    return out.select("id", "name", "region_id", "provider_id", "price_type", "amount", "is_return",
                      "admin_only", F.size("requirements").cast("bigint").alias("requirements"),
                      F.to_json("data").alias("data"), F.to_json("metadata").alias("metadata"), "created_at")


PATCH_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("amount", T.LongType()), T.StructField("fields", T.ArrayType(T.StringType())),
])


def _option_patches(c):
    o = c.shipping_options
    upd = o.filter(F.col("is_return")).select(
        "id", F.upper("name").alias("name"), F.expr("amount div 2").alias("amount"),
        F.array(F.lit("name"), F.lit("amount"), F.lit("created_at")).alias("fields"))
    empty = o.filter(F.col("admin_only") & ~F.col("is_return")).select(
        "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("amount"),
        F.array(F.lit("created_at")).alias("fields"))
    missing = c.raw("nation").select(
        F.concat(F.lit("so_missing_"), F.col("n_nationkey").cast("string")).alias("id"),
        F.lit("x").alias("name"), F.lit(1).cast("bigint").alias("amount"), F.array(F.lit("name")).alias("fields"))
    return upd.unionByName(empty).unionByName(missing)


PATCH_CTE = (("patches", """
    SELECT id, upper(name) AS name, amount // 2 AS amount, 2 AS n FROM co_option WHERE is_return
    UNION ALL SELECT id, NULL, NULL, 0 FROM co_option WHERE admin_only AND NOT is_return
    UNION ALL SELECT 'so_missing_' || CAST(n_nationkey AS VARCHAR), 'x', 1, 1 FROM nation"""),)


@register("patch_rows", with_views(f"""
    SELECT o.id, CASE WHEN p.n = 2 THEN p.name ELSE o.name END AS name,
           CASE WHEN p.n = 2 THEN p.amount ELSE o.amount END AS amount,
           o.price_type, o.is_return,
           CASE WHEN p.n > 0 THEN {NOW_SQL} ELSE o.updated_at END AS updated_at
    FROM co_option o LEFT JOIN patches p ON o.id = p.id""", "co_option", extra=PATCH_CTE))
def patch_rows(spark, sf_dir):
    c = commerce(spark, sf_dir)
    out = m.patch_rows(c.shipping_options, _option_patches(c), "id", m.SHIPPING_OPTION_PATCHABLE, NOW)
    return out.select("id", "name", "amount", "price_type", "is_return", "updated_at")


@register("patch_by_file", with_views(f"""
    SELECT id, total, CASE WHEN total > 40000000 THEN 'reviewed' ELSE status END AS status FROM co_order""", "co_order"))
def patch_by_file(spark, sf_dir):
    """The order table as a table of files, one status patched in the orders of
    400,000 and more; files without such an order are shared by both versions."""
    c = commerce(spark, sf_dir)
    table = file_versions.FileTable(spark, scratch_path(spark, "orders-by-file"))
    table.create(c.orders.select("id", "total", "status").repartitionByRange(16, "total"))
    large = table.read().where("total > 40000000")
    patches = large.select("id", F.lit("reviewed").alias("status"), F.array(F.lit("status")).alias("fields"))
    file_versions.patch(table, patches, "id", ("status",), NOW)
    return table.read()


@register("patch_report", with_views("""
    SELECT p.id, CASE WHEN o.id IS NULL THEN 'not_found' WHEN p.n = 0 THEN 'empty' ELSE 'updated' END AS status
    FROM patches p LEFT JOIN co_option o ON p.id = o.id""", "co_option", extra=PATCH_CTE))
def patch_report(spark, sf_dir):
    c = commerce(spark, sf_dir)
    return m.patch_report(c.shipping_options, _option_patches(c), "id", m.SHIPPING_OPTION_PATCHABLE)


@register("soft_delete", with_views(f"""
    SELECT o.id, CASE WHEN s.s_suppkey IS NOT NULL THEN {NOW_SQL} ELSE o.deleted_at END AS deleted_at
    FROM co_option o
    LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 9000) s
      ON o.id = 'so_' || CAST(s.s_suppkey AS VARCHAR)""", "co_option"))
def soft_delete(spark, sf_dir):
    c = commerce(spark, sf_dir)
    ids = c.raw("supplier").filter(F.col("s_acctbal") > 9000).select(
        F.concat(F.lit("so_"), F.col("s_suppkey").cast("string")).alias("id"))
    return m.soft_delete(c.shipping_options, ids, NOW).select("id", "deleted_at")


@register("patch_regions", with_views(f"""
    SELECT id, name, currency_code,
           CASE WHEN name = 'EUROPE' THEN 20.0 ELSE tax_rate END AS tax_rate,
           CASE WHEN name = 'EUROPE' THEN 'EU-VAT' ELSE tax_code END AS tax_code,
           gift_cards_taxable, automatic_taxes,
           CASE WHEN name = 'EUROPE' THEN {NOW_SQL} ELSE updated_at END AS updated_at
    FROM co_region""", "co_region"))
def patch_regions(spark, sf_dir):
    c = commerce(spark, sf_dir)
    patches = c.regions.filter(F.col("name") == "EUROPE").select(
        "id", F.lit(20.0).alias("tax_rate"), F.lit("EU-VAT").alias("tax_code"),
        F.array(F.lit("tax_rate"), F.lit("tax_code"), F.lit("metadata")).alias("fields"))
    out = m.patch_rows(c.regions, patches, "id", m.REGION_PATCHABLE, NOW)
    return out.select("id", "name", "currency_code", "tax_rate", "tax_code", "gift_cards_taxable",
                      "automatic_taxes", "updated_at")


@register("replace_links", with_views("""
    SELECT region_id, provider_id FROM co_rpp
    WHERE region_id NOT IN (SELECT region_id FROM co_rfp)
    UNION ALL
    SELECT region_id, provider_id FROM co_rfp
    WHERE region_id IN (SELECT region_id FROM co_rpp)""", "co_rfp", "co_rpp"))
def replace_links(spark, sf_dir):
    """Payment links of every region that has fulfilment links are replaced
    by the list of its fulfilment providers."""
    c = commerce(spark, sf_dir)
    changes = (c.region_fulfillment_providers.groupBy("region_id")
               .agg(F.sort_array(F.collect_set("provider_id")).alias("providers")))
    changes = changes.join(c.region_payment_providers.select("region_id").distinct(), "region_id", "left_semi")
    return m.replace_links(c.region_payment_providers, changes)


UPSERT_COUNTRIES_CTE = (
    ("ch", """
      SELECT 'reg_' || CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS VARCHAR) AS region_id,
             'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_2
      FROM nation"""),
    ("base", "SELECT * FROM co_country WHERE region_id NOT IN (SELECT region_id FROM ch)"),
)


@register("upsert_countries", with_views("""
    SELECT coalesce(b.iso_2, ch.iso_2) AS iso_2,
           CASE WHEN b.iso_2 IS NOT NULL THEN b.iso_3 ELSE ch.iso_2 END AS iso_3,
           CASE WHEN b.iso_2 IS NOT NULL THEN b.num_code ELSE 0 END AS num_code,
           CASE WHEN b.iso_2 IS NOT NULL THEN b.name ELSE ch.iso_2 END AS name,
           CASE WHEN b.iso_2 IS NOT NULL THEN b.display_name ELSE ch.iso_2 END AS display_name,
           coalesce(ch.region_id, b.region_id) AS region_id
    FROM base b FULL OUTER JOIN ch ON b.iso_2 = ch.iso_2""", "co_country", extra=UPSERT_COUNTRIES_CTE))
def upsert_countries(spark, sf_dir):
    """Every TPC-H region's nations are assigned to the region row of its
    lowest nation key (country codes given bare, so new rows get defaults)."""
    c = commerce(spark, sf_dir)
    n = c.raw("nation")
    code = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    target = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    entry = F.struct(code.alias("iso_2"), F.lit(None).cast("string").alias("iso_3"),
                     F.lit(None).cast("int").alias("num_code"), F.lit(None).cast("string").alias("name"),
                     F.lit(None).cast("string").alias("display_name"))
    changes = (n.join(target, "n_regionkey")
               .groupBy(F.concat(F.lit("reg_"), F.col("k").cast("string")).alias("region_id"))
               .agg(F.sort_array(F.collect_list(entry)).alias("countries")))
    return m.upsert_countries(c.countries, changes)


# ------------------------------------------------------------ bulk product ops
# Products with a bulk return (a returned line of 50 units).
RETURNED_IDS_SQL = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50"


def _returned_ids(c):
    li = c.raw("lineitem")
    return li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)).select(
        F.col("l_partkey").alias("id"))


@register("bulk_update_products", with_views(f"""
    SELECT q.id, p.id IS NOT NULL AS success, CASE WHEN p.id IS NULL THEN 'Product not found' END AS error
    FROM ({RETURNED_IDS_SQL} UNION SELECT max(id) + 1 FROM co_product) q LEFT JOIN co_product p ON q.id = p.id""",
    "co_product"))
def bulk_update_products(spark, sf_dir):
    c = commerce(spark, sf_dir)
    ids = _returned_ids(c).unionByName(c.products.agg((F.max("id") + 1).alias("id")))
    return m.bulk_update_report(c.products, ids)


@register("bulk_delete_products", with_views(f"""
    SELECT id, title FROM co_product WHERE id NOT IN ({RETURNED_IDS_SQL})""", "co_product"))
def bulk_delete_products(spark, sf_dir):
    c = commerce(spark, sf_dir)
    return m.bulk_delete(c.products, _returned_ids(c))["product"].select("id", "title")


def oracle_for(key: str) -> str:
    from cartwheel.plans.registry import _ORACLE
    return _ORACLE[key]
