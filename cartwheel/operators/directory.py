"""Directory / configuration reads: regions, shipping options, store,
providers, currencies, profiles, staff, image URLs, and region audits.

The reference builds these with a four-way LEFT JOIN and DISTINCT
aggregates, which multiplies the child rows per region before
de-duplicating them. Here every child table is first reduced to one row
per region (distinct sets are bounded by the provider / country domains),
then joined once, which gives the same result without the k1*k2*k3 blow-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import empty_string_array, empty_string_map, js_or, js_or_null, live

# Fixed values of the reference (defaults in its JSON responses).
DEFAULT_SYMBOL = "$"
DEFAULT_CURRENCY_NAME = "US Dollar"
DEFAULT_CURRENCY_CODE = "usd"
DEFAULT_FULFILLMENT_PROVIDER = "manual"
DEFAULT_PAYMENT_PROVIDER_READ = "stripe"    # list and by-id reads
DEFAULT_PAYMENT_PROVIDER_UPDATE = "manual"  # read-back after an update
DEFAULT_REGION_NAME = "Unknown Region"
DEFAULT_PROFILE_NAME = "Default Profile"
DEFAULT_PROFILE_TYPE = "default"
DEFAULT_PRICE_TYPE = "flat_rate"
DEFAULT_ROLE = "member"
# Image delivery variants: name -> URL suffix.
IMAGE_VARIANTS = (
    ("original", "public"),
    ("thumbnail", "w=150,h=150,fit=cover"),
    ("small", "w=400,h=400,fit=cover"),
    ("medium", "w=800,h=800,fit=cover"),
    ("large", "w=1200,h=1200,fit=cover"),
    ("productCard", "w=300,h=400,fit=cover"),
    ("productDetail", "w=600,h=800,fit=cover"),
    ("productZoom", "w=1500,h=2000,fit=cover"),
)

def _provider_list(links: DataFrame, name: str) -> DataFrame:
    """region_id -> sorted distinct [{provider_id}] (NULL ids filtered out)."""
    return (links.filter(F.col("provider_id").isNotNull())
            .groupBy("region_id")
            .agg(F.sort_array(F.collect_set(F.struct("provider_id"))).alias(name)))


def _country_list(countries: DataFrame) -> DataFrame:
    cols = [c for c in countries.columns]
    return (countries.filter(F.col("iso_2").isNotNull())
            .groupBy("region_id")
            .agg(F.sort_array(F.collect_set(F.struct(*cols))).alias("countries")))


def _default_list(value: str) -> Column:
    return F.array(F.struct(F.lit(value).alias("provider_id")))


def region_directory(regions: DataFrame, fulfillment_links: DataFrame, payment_links: DataFrame,
                     countries: DataFrame, currencies: DataFrame,
                     default_payment: str = DEFAULT_PAYMENT_PROVIDER_READ) -> DataFrame:
    """J6 + A11 + F12: every region with its currency, providers and
    countries, shaped like the reference's response (JS ``||`` defaults:
    ``gift_cards_taxable`` and ``automatic_taxes`` are always true, a region
    without providers gets the default provider list)."""
    fp = _provider_list(fulfillment_links, "fulfillment_providers")
    pp = _provider_list(payment_links, "payment_providers")
    cc = _country_list(countries)
    cur = currencies.select(F.col("code").alias("currency_code"),
                            F.col("symbol").alias("currency_symbol"),
                            F.col("name").alias("currency_name"))
    r = (regions.join(fp, regions.id == fp.region_id, "left").drop("region_id")
         .join(pp, regions.id == pp.region_id, "left").drop("region_id")
         .join(cc, regions.id == cc.region_id, "left").drop("region_id")
         .join(cur, "currency_code", "left"))
    return r.select(
        "id", "name", "currency_code",
        F.struct(
            F.col("currency_code").alias("code"),
            js_or("currency_symbol", DEFAULT_SYMBOL, "string").alias("symbol"),
            js_or("currency_symbol", DEFAULT_SYMBOL, "string").alias("symbol_native"),
            js_or("currency_name", DEFAULT_CURRENCY_NAME, "string").alias("name"),
        ).alias("currency"),
        js_or("tax_rate", 0.0, "number").alias("tax_rate"),
        js_or_null("tax_code", "string").alias("tax_code"),
        js_or("gift_cards_taxable", True, "bool").alias("gift_cards_taxable"),
        js_or("automatic_taxes", True, "bool").alias("automatic_taxes"),
        js_or_null("tax_provider_id", "string").alias("tax_provider_id"),
        F.coalesce("fulfillment_providers", _default_list(DEFAULT_FULFILLMENT_PROVIDER))
        .alias("fulfillment_providers"),
        F.coalesce("payment_providers", _default_list(default_payment)).alias("payment_providers"),
        F.coalesce("countries", F.array().cast(cc.schema["countries"].dataType)).alias("countries"),
        "created_at", "updated_at", "deleted_at",
        F.coalesce("metadata", empty_string_map()).alias("metadata"),
    )


def found_or_not(directory: DataFrame, ids: DataFrame) -> DataFrame:
    """F11 as a batch: requested ids left-joined to a directory; ``found`` is
    false for ids that do not exist (the reference answers 404)."""
    req = ids.select(F.col("id").alias("requested_id")).distinct()
    return (req.join(directory, req.requested_id == directory.id, "left")
            .withColumn("found", F.col("id").isNotNull()))


def region_lookup(region_dir: DataFrame, ids: DataFrame) -> DataFrame:
    """F11 for regions."""
    return found_or_not(region_dir, ids)


def region_shipping_options(options: DataFrame, region_id: str | None = None) -> DataFrame:
    """F14 (+F9): live shipping options, optionally of one region, with the
    by-region defaults (``is_return``, ``admin_only`` false; empty
    ``requirements`` / ``data``; ``deleted_at`` and ``metadata`` NULL)."""
    o = live(options)
    if region_id is not None:
        o = o.filter(F.col("region_id") == region_id)
    return o.select(
        "id", "name", "region_id", "profile_id", "provider_id", "price_type", "amount",
        js_or("is_return", False, "bool").alias("is_return"),
        js_or("admin_only", False, "bool").alias("admin_only"),
        F.coalesce("requirements", F.array().cast(options.schema["requirements"].dataType)).alias("requirements"),
        F.coalesce("data", empty_string_map()).alias("data"),
        "created_at", "updated_at",
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
    )


def _option_projection(j: DataFrame, options_schema) -> DataFrame:
    provider = js_or("provider_id", DEFAULT_FULFILLMENT_PROVIDER, "string")
    return j.select(
        "id", "name", "region_id",
        F.struct(F.col("region_id").alias("id"),
                 js_or("region_name", DEFAULT_REGION_NAME, "string").alias("name"),
                 js_or("region_currency", DEFAULT_CURRENCY_CODE, "string").alias("currency_code"))
        .alias("region"),
        "profile_id",
        F.struct(F.col("profile_id").alias("id"),
                 js_or("profile_name", DEFAULT_PROFILE_NAME, "string").alias("name"),
                 js_or("profile_type", DEFAULT_PROFILE_TYPE, "string").alias("type"),
                 F.coalesce("profile_products", empty_string_array()).alias("products"),
                 F.coalesce("profile_shipping_options", empty_string_array()).alias("shipping_options"))
        .alias("profile"),
        provider.alias("provider_id"),
        F.struct(provider.alias("id"), F.lit(True).alias("is_installed")).alias("provider"),
        js_or("price_type", DEFAULT_PRICE_TYPE, "string").alias("price_type"),
        js_or("amount", 0, "number").alias("amount"),
        js_or("is_return", False, "bool").alias("is_return"),
        js_or("is_default", False, "bool").alias("is_default"),
        js_or("admin_only", False, "bool").alias("admin_only"),
        js_or("includes_tax", False, "bool").alias("includes_tax"),
        js_or_null("min_subtotal", "number").alias("min_subtotal"),
        js_or_null("max_subtotal", "number").alias("max_subtotal"),
        F.coalesce("requirements", F.array().cast(options_schema["requirements"].dataType)).alias("requirements"),
        F.coalesce("data", empty_string_map()).alias("data"),
        F.coalesce("metadata", empty_string_map()).alias("metadata"),
        "created_at", "updated_at", "deleted_at",
    )


def _options_joined(options: DataFrame, regions: DataFrame, profiles: DataFrame) -> DataFrame:
    r = regions.select(F.col("id").alias("r_id"), F.col("name").alias("region_name"),
                       F.col("currency_code").alias("region_currency"))
    p = profiles.select(F.col("id").alias("p_id"), F.col("name").alias("profile_name"),
                        F.col("type").alias("profile_type"), F.col("products").alias("profile_products"),
                        F.col("shipping_options").alias("profile_shipping_options"))
    return (options.join(r, options.region_id == r.r_id, "left")
            .join(p, options.profile_id == p.p_id, "left"))


def shipping_option_directory(options: DataFrame, regions: DataFrame, profiles: DataFrame,
                              region_id: str | None = None) -> DataFrame:
    """J7 + F13 (+F8, F9): live shipping options with region, profile and
    provider sub-objects and the reference's defaults."""
    o = live(options)
    if region_id is not None:
        o = o.filter(F.col("region_id") == region_id)
    return _option_projection(_options_joined(o, regions, profiles), options.schema)


def shipping_option_lookup(options: DataFrame, regions: DataFrame, profiles: DataFrame,
                           ids: DataFrame) -> DataFrame:
    """F11 for options: by-id read, which does *not* hide soft-deleted rows
    (S15). Batch form: one row per requested id that exists; see
    :func:`found_or_not` for those that do not."""
    o = options.join(ids.select("id").distinct(), "id", "left_semi")
    return _option_projection(_options_joined(o, regions, profiles), options.schema)


def store_directory(stores: DataFrame, currencies: DataFrame, store_currencies: DataFrame) -> DataFrame:
    """J8 + A12: each store with its default currency (defaults '$' /
    'US Dollar'), the distinct currency codes of its links (``array_agg
    (DISTINCT ...)`` keeps a NULL, so a store without links lists [NULL]),
    and its linked currencies (a usd entry when it has none).

    The reference reads the first store only (``LIMIT 1``); see
    :func:`first_store`.
    """
    cur = currencies.select(F.col("code").alias("default_currency_code"),
                            F.col("symbol").alias("currency_symbol"),
                            F.col("symbol_native").alias("currency_symbol_native"),
                            F.col("name").alias("currency_name"))
    codes = store_currencies.groupBy("store_id").agg(
        F.sort_array(F.collect_set("currency_code")).alias("codes"),
        F.max(F.col("currency_code").isNull()).alias("has_null"))
    linked = (store_currencies.join(currencies, store_currencies.currency_code == currencies.code)
              .groupBy("store_id")
              .agg(F.sort_array(F.collect_set(F.struct("code", "symbol", "symbol_native", "name")))
                   .alias("currencies")))
    null_code = F.array(F.lit(None).cast("string"))
    j = (stores.join(cur, "default_currency_code", "left")
         .join(codes, stores.id == codes.store_id, "left").drop("store_id")
         .join(linked, stores.id == linked.store_id, "left").drop("store_id"))
    usd = F.array(F.struct(F.lit(DEFAULT_CURRENCY_CODE).alias("code"), F.lit(DEFAULT_SYMBOL).alias("symbol"),
                           F.lit(DEFAULT_SYMBOL).alias("symbol_native"),
                           F.lit(DEFAULT_CURRENCY_NAME).alias("name")))
    return j.select(
        "id", "name", "default_currency_code",
        F.struct(F.col("default_currency_code").alias("code"),
                 js_or("currency_symbol", DEFAULT_SYMBOL, "string").alias("symbol"),
                 js_or("currency_symbol_native", DEFAULT_SYMBOL, "string").alias("symbol_native"),
                 js_or("currency_name", DEFAULT_CURRENCY_NAME, "string").alias("name"))
        .alias("default_currency"),
        F.when(F.col("codes").isNull(), null_code)
        .when(F.col("has_null"), F.concat(F.col("codes"), null_code))
        .otherwise(F.col("codes")).alias("currency_codes"),
        F.when(F.size(F.coalesce("currencies", F.array())) > 0, F.col("currencies")).otherwise(usd)
        .alias("currencies"),
        js_or_null("swap_link_template", "string").alias("swap_link_template"),
        js_or_null("payment_link_template", "string").alias("payment_link_template"),
        js_or_null("invite_link_template", "string").alias("invite_link_template"),
        js_or_null("default_sales_channel_id", "string").alias("default_sales_channel_id"),
        js_or_null("default_location_id", "string").alias("default_location_id"),
        F.coalesce("metadata", empty_string_map()).alias("metadata"),
        "created_at", "updated_at",
    )


def store_currency_rows(currencies: DataFrame, store_currencies: DataFrame) -> DataFrame:
    """J8 second read: (store_id, code, symbol, symbol_native, name) for every
    currency linked to a store (inner join)."""
    return (store_currencies.join(currencies, store_currencies.currency_code == currencies.code)
            .select("store_id", "code", "symbol", "symbol_native", "name"))


def first_store(store_dir: DataFrame) -> DataFrame:
    """``LIMIT 1`` without ORDER BY, made deterministic with the id."""
    return store_dir.orderBy(F.col("id").asc_nulls_last()).limit(1)


def installed_providers(providers: DataFrame) -> DataFrame:
    """installed providers (id, is_installed)."""
    return providers.filter(F.col("is_installed") == F.lit(True)).select("id", "is_installed")


def currency_list(currencies: DataFrame) -> DataFrame:
    """O4 + F15: currencies by code with defaults; ``includes_tax`` false."""
    return (currencies.orderBy(F.col("code").asc_nulls_last()).select(
        js_or("code", DEFAULT_CURRENCY_CODE, "string").alias("code"),
        js_or("symbol", DEFAULT_SYMBOL, "string").alias("symbol"),
        js_or("symbol_native", DEFAULT_SYMBOL, "string").alias("symbol_native"),
        js_or("name", DEFAULT_CURRENCY_NAME, "string").alias("name"),
        F.lit(False).alias("includes_tax")))


def shipping_profiles(profiles: DataFrame) -> DataFrame:
    """Live profiles, newest first (NULL dates first, as DESC sorts in
    the database); ``type`` defaults to 'default', ``metadata`` to {}."""
    return (live(profiles)
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc_nulls_last())
            .select("id", "name",
                    js_or("type", DEFAULT_PROFILE_TYPE, "string").alias("type"),
                    F.coalesce("metadata", empty_string_map()).alias("metadata"),
                    "created_at", "updated_at", "deleted_at"))


def staff_directory(users: DataFrame) -> DataFrame:
    """F16: users newest first; names default '', role 'member'. The API
    token column is not read (secrets stay out of results)."""
    return (users.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc_nulls_last())
            .select("id", "email",
                    js_or("first_name", "", "string").alias("first_name"),
                    js_or("last_name", "", "string").alias("last_name"),
                    js_or("role", DEFAULT_ROLE, "string").alias("role"),
                    empty_string_map().alias("metadata"),
                    "created_at", "updated_at"))


def image_variant_urls(images: DataFrame, base_url: str, id_col: str = "image_id") -> DataFrame:
    """one row per (image, variant) with its delivery URL
    ``{base_url}/{image_id}/{suffix}``."""
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("suffix"))
                         for n, s in IMAGE_VARIANTS])
    x = images.select(F.col(id_col).alias("image_id"), F.explode(variants).alias("v"))
    return x.select("image_id", F.col("v.variant").alias("variant"),
                    F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("image_id"), F.lit("/"),
                             F.col("v.suffix")).alias("url"))


# ------------------------------------------------------------------ audits
def region_shipping_counts(regions: DataFrame, options: DataFrame) -> DataFrame:
    """Options per region (soft-deleted ones included), oldest region first."""
    n = options.filter(F.col("id").isNotNull()).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    j = regions.join(n, regions.id == n.region_id, "left")
    return (j.select("id", "name", "currency_code", "created_at",
                     F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("shipping_count"))
            .orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last()))


def duplicate_regions(regions: DataFrame) -> DataFrame:
    """(name, currency_code) groups with more than one region."""
    return (regions.groupBy("name", "currency_code").agg(F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") > 1))


def region_audit(regions: DataFrame, options: DataFrame, countries: DataFrame,
                 fulfillment_links: DataFrame, payment_links: DataFrame) -> DataFrame:
    """Distinct live options, countries, fulfilment and payment
    providers per region. Each child is counted per region first (the
    reference's DISTINCT counts over a four-way join give the same numbers);
    the live-option condition belongs to the join, so regions without live
    options still appear with 0 (J9)."""
    def per_region(df, key, name):
        return (df.filter(F.col(key).isNotNull()).groupBy(F.col("region_id").alias(f"{name}_rid"))
                .agg(F.countDistinct(key).alias(name)))

    so = per_region(live(options), "id", "shipping_count")
    cc = per_region(countries, "iso_2", "country_count")
    fp = per_region(fulfillment_links, "provider_id", "fulfillment_count")
    pp = per_region(payment_links, "provider_id", "payment_count")
    j = regions.select("id", "name", "currency_code")
    for df, name in ((so, "shipping_count"), (cc, "country_count"), (fp, "fulfillment_count"),
                     (pp, "payment_count")):
        j = j.join(df, j.id == df[f"{name}_rid"], "left").drop(f"{name}_rid")
    return j.select("id", "name", "currency_code",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                      for c in ("shipping_count", "country_count", "fulfillment_count", "payment_count")])


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def missing_links(regions: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Regions with no provider link of this kind (all regions at once)."""
    have = links.filter(F.col("provider_id").isNotNull()).select("region_id")
    return (regions.join(have, regions.id == have.region_id, "left_anti")
            .select(F.col("id").alias("region_id"), "name", F.lit(kind).alias("kind")))
