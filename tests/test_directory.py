from cartwheel.operators import directory as d
from tests.conftest import ts

REGION = ("id string, name string, currency_code string, tax_rate double, tax_code string, "
          "gift_cards_taxable boolean, automatic_taxes boolean, tax_provider_id string, "
          "metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")
LINK = "region_id string, provider_id string"
COUNTRY = "iso_2 string, iso_3 string, num_code int, name string, display_name string, region_id string"
CURRENCY = "code string, symbol string, symbol_native string, name string"


def frames(spark):
    regions = spark.createDataFrame([
        ("r1", "EU", "eur", 0.0, "", False, False, "", None, ts(2020, 1, 1), ts(2020, 1, 1), None),
        ("r2", "US", "xxx", 7.5, "T", True, None, None, {"a": "b"}, ts(2020, 1, 2), ts(2020, 1, 2), None),
    ], REGION)
    rfp = spark.createDataFrame([("r2", "manual"), ("r2", "courier"), ("r2", None)], LINK)
    rpp = spark.createDataFrame([("r2", "stripe"), ("r2", "paypal")], LINK)
    countries = spark.createDataFrame([("de", "deu", 276, "Germany", "Germany", "r2"),
                                       ("us", "usa", 840, "USA", "USA", "r2")], COUNTRY)
    cur = spark.createDataFrame([("eur", "€", "€", "Euro")], CURRENCY)
    return regions, rfp, rpp, countries, cur


def test_region_directory_defaults_and_fanout(spark):
    regions, rfp, rpp, countries, cur = frames(spark)
    rows = {r.id: r for r in d.region_directory(regions, rfp, rpp, countries, cur).collect()}
    r1, r2 = rows["r1"], rows["r2"]
    assert [p.provider_id for p in r1.fulfillment_providers] == ["manual"]
    assert [p.provider_id for p in r1.payment_providers] == ["stripe"]
    assert r1.countries == [] and r1.tax_rate == 0.0 and r1.tax_code is None
    assert r1.gift_cards_taxable is True and r1.automatic_taxes is True   # `x || true` is always true
    assert r1.currency.symbol == "€" and r1.metadata == {}
    # two providers x two payment x two countries: no duplicates after the fan-out
    assert [p.provider_id for p in r2.fulfillment_providers] == ["courier", "manual"]
    assert [p.provider_id for p in r2.payment_providers] == ["paypal", "stripe"]
    assert [c.iso_2 for c in r2.countries] == ["de", "us"]
    assert r2.currency.symbol == "$" and r2.currency.name == "US Dollar"
    # read-back after an update uses 'manual' as default payment provider
    upd = d.region_directory(regions, rfp, rpp, countries, cur, d.DEFAULT_PAYMENT_PROVIDER_UPDATE).collect()
    assert [p.provider_id for p in {r.id: r for r in upd}["r1"].payment_providers] == ["manual"]


def test_store_without_links_lists_null(spark):
    stores = spark.createDataFrame([("s1", None, "usd"), ("s2", "B", "eur")],
                                   "id string, name string, default_currency_code string")
    for c in ("swap_link_template", "payment_link_template", "invite_link_template", "default_sales_channel_id",
              "default_location_id"):
        stores = stores.withColumn(c, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("").cast("string"))
    from pyspark.sql import functions as F
    stores = (stores.withColumn("metadata", F.lit(None).cast("map<string,string>"))
              .withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
              .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")))
    cur = spark.createDataFrame([("eur", "€", "€", "Euro")], CURRENCY)
    sc = spark.createDataFrame([("s2", "eur"), ("s2", "gbp")], "store_id string, currency_code string")
    rows = {r.id: r for r in d.store_directory(stores, cur, sc).collect()}
    assert rows["s1"].currency_codes == [None]
    assert [c.code for c in rows["s1"].currencies] == ["usd"]
    assert rows["s2"].currency_codes == ["eur", "gbp"]
    assert [c.code for c in rows["s2"].currencies] == ["eur"]
    assert rows["s1"].swap_link_template is None


def test_soft_deleted_options(spark):
    from cartwheel.sources.commerce import Commerce
    c = Commerce(spark, "/root/testdata/sf0.01")   # has suppliers with negative balance
    o = c.shipping_options
    deleted = {r.id for r in o.filter("deleted_at IS NOT NULL").collect()}
    assert deleted, "fixture needs a soft-deleted option"
    listed = {r.id for r in d.shipping_option_directory(o, c.regions, c.shipping_profiles).collect()}
    assert not (listed & deleted)
    looked = {r.id for r in d.shipping_option_lookup(o, c.regions, c.shipping_profiles, o.select("id")).collect()}
    assert deleted <= looked
    counts = {r.id: r for r in d.region_audit(c.regions, o, c.countries, c.region_fulfillment_providers,
                                               c.region_payment_providers).collect()}
    assert sum(r.shipping_count for r in counts.values()) == len(listed)


def test_image_variant_urls(spark):
    imgs = spark.createDataFrame([("abc",)], "image_id string")
    rows = {r.variant: r.url for r in d.image_variant_urls(imgs, "https://img.example/x/").collect()}
    assert rows["original"] == "https://img.example/x/abc/public"
    assert rows["productZoom"] == "https://img.example/x/abc/w=1500,h=2000,fit=cover"
    assert len(rows) == 8


def test_region_filter_and_first_store(spark):
    from cartwheel.sources.commerce import Commerce
    c = Commerce(spark, "/root/testdata/sf0.01")
    all_live = d.region_shipping_options(c.shipping_options)
    one = d.region_shipping_options(c.shipping_options, region_id="reg_3")
    assert one.count() == all_live.filter("region_id = 'reg_3'").count() > 0
    opts = d.shipping_option_directory(c.shipping_options, c.regions, c.shipping_profiles, region_id="reg_3")
    assert {r.region_id for r in opts.collect()} == {"reg_3"}
    first = d.first_store(d.store_directory(c.stores, c.currencies, c.store_currencies)).collect()
    assert len(first) == 1 and first[0].id == "store_0"
