import json
import os

from pyspark.sql import functions as F

from cartwheel.operators import inventory as inv
from cartwheel.session import scratch_path
from cartwheel.sources import seed

# Our own rows in the seed document's shape (not the reference's data).
DOC = {
    "store": {"currencies": ["usd", "eur"], "default_currency_code": "usd", "default_region": "reg_a"},
    "regions": [{"id": "reg_a", "name": "North", "currency_code": "usd", "tax_rate": 0,
                 "countries": ["aa", "bb"], "fulfillment_providers": ["manual"], "payment_providers": ["manual"]}],
    "shipping_options": [
        {"id": "so_1", "name": "Standard", "region_id": "reg_a", "provider_id": "manual", "profile_id": "sp_1",
         "price_type": "flat_rate", "amount": 500, "data": {"speed": "slow"},
         "requirements": [{"type": "min_subtotal", "amount": 1000}]},
        {"id": "so_2", "name": "Express", "region_id": "reg_a", "provider_id": "manual", "profile_id": "sp_1",
         "price_type": "flat_rate", "amount": 1500, "data": {}, "requirements": []},
    ],
    "users": [{"id": "u1", "email": "a@example.com", "first_name": "A", "last_name": "B", "role": "admin",
               "password": "never-read"}],
    "product_categories": [{"id": "c1", "name": "Coats", "description": "x", "handle": "coats",
                            "is_active": True, "is_internal": False}],
    "product_collections": [{"id": "k1", "title": "Winter", "handle": "winter", "metadata": {"description": "d"}}],
    "products": [
        {"id": "p1", "title": "Coat", "handle": "coat", "status": "published", "is_giftcard": False,
         "tags": [{"id": "t1", "value": "popular"}], "options": [{"id": "o1", "title": "Size"}],
         "variants": [
             {"id": "v1", "title": "S", "sku": "C-S", "inventory_quantity": 7, "manage_inventory": True,
              "allow_backorder": False, "options": [{"option_id": "o1", "value": '36" chest'}],
              "prices": [{"currency_code": "usd", "amount": 19999}]},
             {"id": "v2", "title": "M", "sku": "C-M", "inventory_quantity": 25, "manage_inventory": True,
              "allow_backorder": False, "options": [{"option_id": "o1", "value": "M"}],
              "prices": [{"currency_code": "usd", "amount": 333}]},
         ]},
        {"id": "p2", "title": "Tie", "handle": "tie", "status": "published", "is_giftcard": False,
         "tags": [{"id": "t2", "value": "suits"}], "options": [],
         "variants": [
             {"id": "v3", "title": "One", "sku": "T-1", "inventory_quantity": 15, "manage_inventory": True,
              "allow_backorder": True, "options": [], "prices": [{"currency_code": "usd", "amount": 1001}]},
         ]},
    ],
}


def write_doc(spark):
    path = scratch_path(spark, "t-seed")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "seed.json"), "w") as f:
        json.dump(DOC, f, indent=2)
    return path


def test_seed_tables(spark):
    t = seed.seed_tables(seed.read_seed(spark, write_doc(spark)))
    counts = {k: v.count() for k, v in t.items()}
    assert counts["region"] == 1 and counts["shipping_option"] == 2 and counts["user"] == 1
    assert counts["product"] == 2 and counts["product_variant"] == 3 and counts["money_amount"] == 3
    assert counts["country"] == 2 and counts["store_currencies"] == 2 and counts["product_tag"] == 2
    assert "password" not in t["user"].columns
    vals = {r.variant_id: r.value for r in t["product_option_value"].collect()}
    assert vals["v1"] == '36" chest'
    so = {r.id: r for r in t["shipping_option"].collect()}
    assert so["so_1"].requirements[0].amount == 1000 and so["so_1"].data == {"speed": "slow"}


def test_seed_inventory_golden(spark):
    t = seed.seed_tables(seed.read_seed(spark, write_doc(spark)))
    variants = t["product_variant"]
    products = t["product"]
    v = inv.inventory_value(variants, t["money_amount"]).collect()[0]
    assert v.total_value == 7 * 19999 // 100 + 25 * 333 // 100 + 15 * 1001 // 100   # 1399 + 83 + 150
    assert v.total_units == 47 and v.total_variants == 3
    low = [r.variant_id for r in inv.low_stock(variants, products).collect()]
    assert low == ["v1", "v3"]     # 7 <= 20 (popular), 15 <= 15 (suits); 25 > 20


def test_product_lines_round_trip(spark):
    t = seed.seed_tables(seed.read_seed(spark, write_doc(spark)))
    docs = seed.product_documents(t["product"].withColumn("type", F.lit(None).cast("string")),
                                  t["product_variant"], t["money_amount"])
    assert docs.count() == 2                                # one document per product
    back = seed.product_tables(seed.parse_products(docs))
    assert back["product"].count() == 2
    assert sorted(r.id for r in back["product_variant"].collect()) == ["v1", "v2", "v3"]
    assert sorted(map(tuple, back["money_amount"].collect())) == sorted(map(tuple, t["money_amount"].collect()))


def test_unknown_keys_survive_the_round_trip(spark):
    import json
    docs = [{"id": "p1", "title": "T", "tags": [{"id": "t", "value": "x"}], "weight": 1.5, "origin": {"land": "PT", "lots": [1, {"n": 2}]}, "flag": True,
             "variants": [{"id": "v1", "sku": "k", "prices": [{"currency_code": "usd", "amount": 5}], "ean": 123}, {"id": "v2", "box": {"w": 1}}]},
            {"id": "p2", "variants": []}, {"id": "p3", "none": None, "variants": [{"id": "v3"}]}]
    path = scratch_path(spark, "t-seed-open")
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").write.text(path)
    rows = seed.open_products(seed.read_documents(spark, path))
    assert rows.count() == 3 and seed.product_tables(rows)["money_amount"].collect()[0].amount == 5
    back = {json.loads(r.value)["id"]: json.loads(r.value) for r in seed.open_documents(rows).collect()}
    assert back["p1"] == docs[0] and back["p2"] == docs[1]
    assert {k: v for k, v in back["p3"].items() if v is not None} == {"id": "p3", "variants": [{"id": "v3"}]}
    one = scratch_path(spark, "t-seed-one")
    spark.createDataFrame([(json.dumps({"store": {"x": 1}, "products": docs}, indent=1),)], "value string").coalesce(1).write.text(one)
    whole = seed.open_products(seed.seed_products(seed.read_documents(spark, one, one_document=True)))
    assert sorted(r.value for r in seed.open_documents(whole).collect()) == sorted(r.value for r in seed.open_documents(rows).collect())
