"""Set-based table maintenance: each job maps a table version (plus a change
set) to the next version.

The reference issues one statement per row in loops; here every job is one
plan of joins, aggregations and projections over whole tables, so it scales
with the table and can be re-run: each job is idempotent except the insert
that mints new rows (M1). Per-key reductions use aggregates with map-side
partial aggregation (``max_by`` / ``min_by``) rather than windows, so a key
that holds a large share of the change rows never sorts on one task.

Writing the new version (a new path, then switching readers to it) is the
caller's step; see :func:`write_version`.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import empty_string_map, falsy, js_or, one_row_join

# Fixed values of the reference: the currencies it ensures exist
# (code, symbol, symbol_native, name).
KNOWN_CURRENCIES = [
    ("usd", "$", "$", "US Dollar"),
    ("eur", "€", "€", "Euro"),
    ("gbp", "£", "£", "British Pound"),
    ("cad", "CA$", "$", "Canadian Dollar"),
    ("aud", "A$", "$", "Australian Dollar"),
]
# Fixed values of the reference: updatable columns per table.
SHIPPING_OPTION_PATCHABLE = ("name", "amount", "price_type", "is_return", "admin_only",
                             "requirements", "data", "metadata")
REGION_PATCHABLE = ("name", "currency_code", "tax_rate", "tax_code", "gift_cards_taxable",
                    "automatic_taxes")
# Fixed values of the reference: defaults used by the repair jobs.
DEFAULT_PROVIDER = "manual"
DEFAULT_PAYMENT_REPAIR = "stripe"
DEFAULT_PRICE_TYPE = "flat_rate"
DEFAULT_PROFILE = "sp_01"
DEFAULT_STORE_ID = "store_01"
DEFAULT_STORE_CURRENCY = "usd"
STORE_LINK_TEMPLATES = ("{{cart_id}}", "{{payment_id}}", "{{invite_token}}")
METADATA_PATCH = {"created_via": "admin"}
# Name given to a store created from scratch (the shop sets its own).
DEFAULT_STORE_NAME = "Default Store"


def _ts(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def write_version(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Materialise a job's output as a new table version at ``path`` (a new
    folder per version; readers switch to it once it is complete)."""
    df.write.mode(mode).parquet(path)
    return path


# ------------------------------------------------------------- primitives
def latest_per_key(changes: DataFrame, key: str | list[str], seq: str | None) -> DataFrame:
    """One change per key: the one with the highest ``seq``, via ``max_by`` so
    hot keys reduce map-side. Without a sequence column keys must be unique;
    a second change of a key is an error, since either could be the last."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in changes.columns if c not in keys]
    if seq is None:
        agg = changes.groupBy(*keys).agg(F.first(F.struct(*others)).alias("__c"), F.count(F.lit(1)).alias("__n"))
        error = F.raise_error(F.lit("several changes of one key need a sequence column"))
        agg = agg.withColumn("__c", F.when(F.col("__n") > 1, error.cast(agg.schema["__c"].dataType)).otherwise(F.col("__c")))
    else:
        agg = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("__c"))
    return agg.select(*keys, *[F.col(f"__c.{c}").alias(c) for c in others])


def upsert(target: DataFrame, changes: DataFrame, key: str, update_cols=None,
           seq: str | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO UPDATE SET c = EXCLUDED.c``.

    New keys are inserted with all their columns; existing keys take only
    ``update_cols`` (when None, the columns that the changes have) from the
    change row, so a column absent from the changes keeps its value.
    """
    ch = latest_per_key(changes, key, seq)
    cols = [c for c in target.columns if c != key]
    update = {c for c in (cols if update_cols is None else update_cols) if c in ch.columns}
    t = target.select(key, *[F.col(c).alias(f"t__{c}") for c in cols], F.lit(True).alias("t__hit"))
    c = ch.select(key, *[F.col(x).alias(f"c__{x}") for x in cols if x in ch.columns],
                  F.lit(True).alias("c__hit"))
    j = t.join(c, key, "full_outer")
    out = []
    for x in cols:
        tv = F.col(f"t__{x}")
        cv = F.col(f"c__{x}") if x in ch.columns else F.lit(None).cast(target.schema[x].dataType)
        if x in update:
            out.append(F.when(F.col("c__hit").isNotNull(), cv).otherwise(tv).alias(x))
        else:
            out.append(F.when(F.col("t__hit").isNotNull(), tv).otherwise(cv).alias(x))
    return j.select(key, *out)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """M8: ``INSERT ... ON CONFLICT DO NOTHING`` (composite key)."""
    new = rows.select(*target.columns).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new)


def patch_rows(target: DataFrame, patches: DataFrame, key: str, patchable, now: dt.datetime,
               seq: str | None = None) -> DataFrame:
    """M2/M4: partial update. ``patches`` has the key, one column per
    patchable field and ``fields: array<string>`` naming the fields present
    (so an explicit NULL is a value, not an absence). Fields outside
    ``patchable`` are ignored; a patch with no patchable field is rejected
    (no change, ``updated_at`` kept); matched rows get ``updated_at = now``.
    """
    p = latest_per_key(patches, key, seq)
    allowed = F.array(*[F.lit(f) for f in patchable])
    p = p.withColumn("__fields", F.array_intersect(F.col("fields"), allowed)).filter(F.size("__fields") > 0)
    pcols = [f for f in patchable if f in p.columns]
    pp = p.select(key, "__fields", *[F.col(f).alias(f"p__{f}") for f in pcols])
    j = target.join(pp, key, "left")
    out = []
    for c in target.columns:
        if c in pcols:
            out.append(F.when(F.array_contains("__fields", c), F.col(f"p__{c}")).otherwise(F.col(c))
                       .cast(target.schema[c].dataType).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("__fields").isNotNull(), _ts(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def patch_report(target: DataFrame, patches: DataFrame, key: str, patchable) -> DataFrame:
    """Outcome per requested key: ``updated``, ``not_found`` or ``empty``."""
    allowed = F.array(*[F.lit(f) for f in patchable])
    p = patches.select(key, F.size(F.array_intersect("fields", allowed)).alias("n")).groupBy(key) \
        .agg(F.max("n").alias("n"))
    hit = target.select(key).distinct().withColumn("__hit", F.lit(True))
    j = p.join(hit, key, "left")
    return j.select(key, F.when(F.col("__hit").isNull(), "not_found")
                    .when(F.col("n") == 0, "empty").otherwise("updated").alias("status"))


def soft_delete(target: DataFrame, ids: DataFrame, now: dt.datetime, key: str = "id") -> DataFrame:
    """M3: ``deleted_at = now`` for the given ids (others untouched)."""
    hit = ids.select(key).distinct().withColumn("__del", F.lit(True))
    j = target.join(hit, key, "left")
    return j.select(*[F.when(F.col("__del"), _ts(now)).otherwise(F.col(c)).alias(c) if c == "deleted_at"
                      else F.col(c) for c in target.columns])


def replace_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """M5: for every region in ``changes`` (region_id, providers: an array of
    ids or of structs with ``provider_id``; optional ``seq``), drop its links
    and insert the given list. Of several changes of a region the one with the
    highest ``seq`` counts; without ``seq`` a region may occur once."""
    latest = latest_per_key(changes, "region_id", "seq" if "seq" in changes.columns else None)
    new = latest.select("region_id", F.explode("providers").alias("provider_id"))
    if isinstance(new.schema["provider_id"].dataType, T.StructType):
        new = new.select("region_id", F.col("provider_id.provider_id").alias("provider_id"))
    kept = links.join(changes.select("region_id").distinct(), "region_id", "left_anti")
    return kept.unionByName(new.select(*links.columns))


def upsert_countries(countries: DataFrame, changes: DataFrame) -> DataFrame:
    """M6: ``changes`` (region_id, countries: array<struct<iso_2, iso_3,
    num_code, name, display_name>>). Each listed region loses its countries,
    then the listed ones are inserted; on an ``iso_2`` conflict only
    ``region_id`` changes (other attributes stay); new rows default iso_3,
    name and display_name to the code and num_code to 0. All deletes of a
    batch happen before its inserts, which run in the order of the optional
    ``seq`` column (else of the region id), then of the list.
    """
    batch = F.col("seq") if "seq" in changes.columns else F.col("region_id")
    x = changes.select("region_id", F.posexplode("countries").alias("at", "c"), batch.alias("batch")).withColumn(
        "pos", F.struct("batch", "at"))
    code = F.col("c.iso_2")
    rows = x.select(
        code.alias("iso_2"),
        js_or(F.col("c.iso_3"), code, "string").alias("iso_3"),
        js_or(F.col("c.num_code"), F.lit(0), "number").cast("int").alias("num_code"),
        js_or(F.col("c.name"), code, "string").alias("name"),
        js_or(F.col("c.display_name"), code, "string").alias("display_name"),
        "region_id", "pos")
    # Within a batch the first insert of a code fixes its attributes, the
    # last one its region.
    first = rows.groupBy("iso_2").agg(
        F.min_by(F.struct("iso_3", "num_code", "name", "display_name"), F.col("pos")).alias("a"),
        F.max_by(F.col("region_id"), F.col("pos")).alias("region_id"))
    new = first.select("iso_2", "a.iso_3", "a.num_code", "a.name", "a.display_name", "region_id")
    base = countries.join(changes.select("region_id").distinct(), "region_id", "left_anti")
    b = base.select("iso_2", *[F.col(c).alias(f"b__{c}") for c in countries.columns if c != "iso_2"])
    n = new.select("iso_2", *[F.col(c).alias(f"n__{c}") for c in countries.columns if c != "iso_2"])
    j = b.join(n, "iso_2", "full_outer")
    out = []
    for c in countries.columns:
        if c == "iso_2":
            out.append(F.col("iso_2"))
        elif c == "region_id":
            out.append(F.coalesce(F.col("n__region_id"), F.col("b__region_id")).alias(c))
        else:
            out.append(F.when(F.col("b__region_id").isNotNull(), F.col(f"b__{c}"))
                       .otherwise(F.col(f"n__{c}")).cast(countries.schema[c].dataType).alias(c))
    return j.select(*out)


# ------------------------------------------------------------ region dedupe
def region_instances(regions: DataFrame, options: DataFrame, countries: DataFrame) -> DataFrame:
    """Per region in a duplicate (name, currency_code) group: the
    reference's ``COUNT(so.id)`` and ``COUNT(c.iso_2)`` over the two-way left
    join, i.e. options x max(countries, 1) and countries x max(options, 1)
    (soft-deleted options included, S17). Counted per region, not joined."""
    dup = (regions.groupBy("name", "currency_code").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1).drop("n"))
    r = regions.join(dup, ["name", "currency_code"], "left_semi")
    so = options.filter(F.col("id").isNotNull()).groupBy(F.col("region_id").alias("id")) \
        .agg(F.count(F.lit(1)).alias("n_so"))
    cc = countries.filter(F.col("iso_2").isNotNull()).groupBy(F.col("region_id").alias("id")) \
        .agg(F.count(F.lit(1)).alias("n_c"))
    j = r.join(so, "id", "left").join(cc, "id", "left")
    n_so, n_c = F.coalesce("n_so", F.lit(0)), F.coalesce("n_c", F.lit(0))
    return j.select("id", "name", "currency_code", "created_at",
                    (n_so * F.greatest(n_c, F.lit(1))).cast("bigint").alias("shipping_count"),
                    (n_c * F.greatest(n_so, F.lit(1))).cast("bigint").alias("country_count"))


def region_survivor(instances: DataFrame) -> DataFrame:
    """In each duplicate group the region with the most shipping rows
    survives; ties go to the oldest (NULL dates last), then the lowest id.
    Found with one ``min_by`` per group (partial aggregation), so a huge
    duplicate group is never sorted on a single task."""
    rank_key = F.struct((-F.col("shipping_count")).alias("a"), F.col("created_at").isNull().alias("b"),
                        F.col("created_at").alias("c"), F.col("id").alias("d"))
    surv = instances.groupBy("name", "currency_code").agg(F.min_by("id", rank_key).alias("survivor_id"))
    j = instances.join(surv, ["name", "currency_code"])
    return j.withColumn("keep", F.col("id") == F.col("survivor_id"))


def region_moves(regions: DataFrame, options: DataFrame, countries: DataFrame) -> DataFrame:
    """loser_id -> survivor_id for every non-surviving duplicate region."""
    surv = region_survivor(region_instances(regions, options, countries))
    return surv.filter(~F.col("keep")).select(F.col("id").alias("loser_id"), "survivor_id")


def dedupe_regions(regions: DataFrame, options: DataFrame, countries: DataFrame,
                   fulfillment_links: DataFrame, payment_links: DataFrame,
                   moves: DataFrame | None = None) -> dict[str, DataFrame]:
    """Survivors stay; options and countries of the other duplicates
    move to the survivor; their provider links and region rows go.
    Returns the new version of each of the five tables. ``moves`` may be a
    precomputed (e.g. checkpointed) :func:`region_moves` result."""
    if moves is None:
        moves = region_moves(regions, options, countries)

    def remap(df):
        j = df.join(moves, df.region_id == moves.loser_id, "left")
        return j.select(*[F.coalesce(F.col("survivor_id"), F.col("region_id")).alias("region_id")
                          if c == "region_id" else df[c] for c in df.columns])

    losers = moves.select(F.col("loser_id").alias("region_id"))
    return {
        "region": regions.join(losers.withColumnRenamed("region_id", "id"), "id", "left_anti"),
        "shipping_option": remap(options),
        "country": remap(countries),
        "region_fulfillment_providers": fulfillment_links.join(losers, "region_id", "left_anti"),
        "region_payment_providers": payment_links.join(losers, "region_id", "left_anti"),
    }


# -------------------------------------------------------------- repair jobs
def upsert_providers(providers: DataFrame, provider_id: str = DEFAULT_PROVIDER) -> DataFrame:
    """M9: the provider exists and is installed."""
    row = providers.sparkSession.createDataFrame([(provider_id, True)], "id string, is_installed boolean")
    return upsert(providers, row, "id", ["is_installed"])


def ensure_default_links(regions: DataFrame, links: DataFrame, provider_id: str = DEFAULT_PROVIDER) -> DataFrame:
    """Every region is linked to the default provider."""
    want = regions.select(F.col("id").alias("region_id"), F.lit(provider_id).alias("provider_id"))
    return insert_ignore(links, want, ["region_id", "provider_id"])


def fill_missing_fields(options: DataFrame) -> DataFrame:
    """On live options, falsy provider_id -> 'manual', price_type ->
    'flat_rate', profile_id -> 'sp_01'; ``fixes`` counts the fields fixed
    on each row (the reference's total is their sum)."""
    is_live = F.col("deleted_at").isNull()
    fixes = []
    out = []
    for c in options.columns:
        default = {"provider_id": DEFAULT_PROVIDER, "price_type": DEFAULT_PRICE_TYPE,
                   "profile_id": DEFAULT_PROFILE}.get(c)
        if default is None:
            out.append(F.col(c))
            continue
        missing = is_live & falsy(c, "string").isNull()
        fixes.append(missing.cast("int"))
        out.append(F.when(missing, F.lit(default)).otherwise(F.col(c)).alias(c))
    total = fixes[0]
    for f in fixes[1:]:
        total = total + f
    return options.select(*out, total.alias("fixes"))


def ensure_store(stores: DataFrame, store_currencies: DataFrame, now: dt.datetime,
                 name: str = DEFAULT_STORE_NAME) -> dict[str, DataFrame]:
    """No store -> insert a default one; otherwise the first store (by
    id) gets default currency 'usd' and a name if it had none. Then that
    store is linked to 'usd' (insert-ignore). Emptiness and "first" are
    decided inside the plan with equi-joins, not on the driver."""
    spark = stores.sparkSession
    first = stores.agg(F.min("id").alias("id")).filter(F.col("id").isNotNull()) \
        .withColumn("__is_first", F.lit(True))
    upd = stores.join(first, "id", "left")
    is_first = F.coalesce(F.col("__is_first"), F.lit(False))
    updated = upd.select(*[
        F.when(is_first, F.lit(DEFAULT_STORE_CURRENCY)).otherwise(F.col(c)).alias(c) if c == "default_currency_code"
        else F.when(is_first, F.coalesce(F.col(c), F.lit(name))).otherwise(F.col(c)).alias(c) if c == "name"
        else F.col(c) for c in stores.columns])
    default = spark.range(1).select(*[
        (F.lit(DEFAULT_STORE_ID) if f.name == "id"
         else F.lit(name) if f.name == "name"
         else F.lit(DEFAULT_STORE_CURRENCY) if f.name == "default_currency_code"
         else F.lit(STORE_LINK_TEMPLATES[0]) if f.name == "swap_link_template"
         else F.lit(STORE_LINK_TEMPLATES[1]) if f.name == "payment_link_template"
         else F.lit(STORE_LINK_TEMPLATES[2]) if f.name == "invite_link_template"
         else _ts(now) if f.name in ("created_at", "updated_at")
         else F.lit(None)).cast(f.dataType).alias(f.name) for f in stores.schema.fields])
    # The default row survives only if the table is empty (a one-row count).
    n = stores.agg(F.count(F.lit(1)).alias("__n"))
    inserted = one_row_join(default, n).filter(F.col("__n") == 0).select(*stores.columns)
    new_stores = updated.unionByName(inserted)
    target = new_stores.agg(F.min("id").alias("store_id")).select(
        "store_id", F.lit(DEFAULT_STORE_CURRENCY).alias("currency_code"))
    return {"store": new_stores,
            "store_currencies": insert_ignore(store_currencies, target, ["store_id", "currency_code"])}


def add_column_backfill(df: DataFrame, column: str = "includes_tax", default: bool = False) -> DataFrame:
    """Add a boolean column defaulting to ``default`` if it is missing
    (no-op when present), then replace NULLs with the default."""
    if column not in df.columns:
        df = df.withColumn(column, F.lit(default))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def merge_metadata(regions: DataFrame, ids: DataFrame, patch: dict = METADATA_PATCH) -> DataFrame:
    """``metadata = COALESCE(metadata, '{}') || patch`` on the given
    regions; on a key clash the patch wins (LAST_WIN map dedup). Metadata kept
    as JSON text or VARIANT is merged key by key as VARIANT values, so numbers,
    booleans and nested objects stay what they are; the patch may hold such
    values too. Metadata that is a map of strings takes strings."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    j = regions.join(hit, "id", "left")
    kind = regions.schema["metadata"].dataType
    if isinstance(kind, (T.StringType, T.VariantType)):
        any_map = T.MapType(T.StringType(), T.VariantType())
        values = [F.parse_json(F.lit(json.dumps(v))) for v in patch.values()]
        held = F.from_json("metadata", any_map) if isinstance(kind, T.StringType) else F.col("metadata").cast(any_map)
        pm = F.map_from_arrays(F.array(*[F.lit(k) for k in patch]), F.array(*values))
        merged = F.map_concat(F.coalesce(held, F.from_json(F.lit("{}"), any_map)), pm)
        merged = F.to_json(merged) if isinstance(kind, T.StringType) else F.to_variant_object(merged)
    else:
        pm = F.create_map(*[F.lit(x) for kv in patch.items() for x in kv])
        merged = F.map_concat(F.coalesce(F.col("metadata"), empty_string_map()), pm)
    return j.select(*[F.when(F.col("__hit"), merged).otherwise(F.col(c)).alias(c) if c == "metadata"
                      else F.col(c) for c in regions.columns])


def repair_links(regions: DataFrame, links: DataFrame, provider_id: str) -> DataFrame:
    """Regions without any link get one to ``provider_id``, in place of
    link rows that name no provider."""
    named = links.filter(F.col("provider_id").isNotNull())
    missing = regions.join(named.select(F.col("region_id").alias("id")), "id", "left_anti")
    empty = missing.select(F.col("id").alias("region_id"))
    return links.join(empty, "region_id", "left_anti").select(*links.columns).unionByName(missing.select(F.col("id").alias("region_id"),
                                            F.lit(provider_id).alias("provider_id")))


def insert_with_defaults(options: DataFrame, requests: DataFrame, now: dt.datetime) -> DataFrame:
    """M1: append new shipping options; absent (NULL) request fields get
    the defaults provider 'manual', price type 'flat_rate', is_return and
    admin_only false, requirements [], data and metadata {}; ids are derived
    from a request key (``request_id``) so a replay mints the same ids;
    created_at = updated_at = now."""
    req_type = options.schema["requirements"].dataType
    defaults = {
        "provider_id": F.lit(DEFAULT_PROVIDER), "price_type": F.lit(DEFAULT_PRICE_TYPE),
        "is_return": F.lit(False), "admin_only": F.lit(False),
        "requirements": F.array().cast(req_type), "data": empty_string_map(), "metadata": empty_string_map(),
    }
    cols = []
    for f in options.schema.fields:
        c = f.name
        if c == "id":
            v = F.concat(F.lit("so_"), F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 16))
        elif c in ("created_at", "updated_at"):
            v = _ts(now)
        elif c in requests.columns and c in defaults:
            v = F.coalesce(F.col(c), defaults[c])
        elif c in requests.columns:
            v = F.col(c)
        elif c in defaults:
            v = defaults[c]
        else:
            v = F.lit(None)
        cols.append(v.cast(f.dataType).alias(c))
    return options.unionByName(requests.select(*cols))


def bulk_update_report(products: DataFrame, ids: DataFrame) -> DataFrame:
    """M17 report: per requested id, success when the product exists
    (error text otherwise). Unmatched ids are reported, not fatal."""
    hit = products.select("id").distinct().withColumn("__hit", F.lit(True))
    j = ids.select("id").distinct().join(hit, "id", "left")
    ok = F.col("__hit").isNotNull()
    return j.select("id", ok.alias("success"),
                    F.when(~ok, F.lit("Product not found")).alias("error"))


def bulk_update(products: DataFrame, patches: DataFrame, patchable, now: dt.datetime) -> dict[str, DataFrame]:
    """Apply the patches (see :func:`patch_rows`) and report per requested
    id. An empty request is rejected."""
    if patches.isEmpty():
        raise ValueError("no products given")
    return {"product": patch_rows(products, patches, "id", patchable, now),
            "report": bulk_update_report(products, patches)}


def bulk_delete(products: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Remove the given products; per-id report as for updates."""
    return {"product": products.join(ids.select("id").distinct(), "id", "left_anti"),
            "report": bulk_update_report(products, ids)}

