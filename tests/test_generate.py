"""Rules of the schema-driven generator, and anchors on small tables."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import generate as gen
from quarry.plans.generate import SCHEMA, SETTINGS


def string(name, **meta):
    return T.StructField(name, T.StringType(), False, meta)


@pytest.mark.parametrize("field,rule", [
    (string("iso2", maxlen=2), "short code"), (string("state", maxlen=3), "short code"), (string("email", maxlen=8), "email"),
    (string("title", unique=True), "unique words"), (string("work_email", unique=True), "email"),
    (string("sku", maxlen=20), "long code"), (string("docs_url"), "url"), (string("website"), "url"), (string("team_slug"), "slug"),
    (string("line2"), "street"), (string("phone_number"), "phone"), (string("release_notes"), "sentence"),
    (string("reason_text"), "sentence"), (string("full_name"), "full name"), (string("name"), "company"),
    (string("first_name"), "first name"), (string("city"), "city"), (string("colour"), "word")])
def test_text_rules(field, rule):
    assert gen.text_rule(field) == rule


def test_every_kind_of_column(spark):
    rows = gen.columns(spark.range(3000).withColumnRenamed("id", "k"), "t", SCHEMA, "k", "k", SETTINGS)
    assert [f.dataType for f in rows.schema.fields[1:]] == [f.dataType for f in SCHEMA.fields]
    got = rows.toPandas()
    for f in SCHEMA.fields:
        values = got[f.name]
        assert f.nullable == bool(values.isna().any()), f.name
        if f.metadata.get("unique"):
            assert values.is_unique, f.name
    assert got["contact_uuid"].is_unique and set(got["stage"]) == {"lead", "trial", "customer"}
    assert not got["is_primary"].any() and 0.8 < got["is_active"].mean() < 0.9
    assert got["churn_prob"].between(0, 1).all() and 20 < got["margin_percent"].astype(float).mean() < 80
    assert str(max(got["small_fee"])) == "99.99" and min(got["small_fee"]) >= 0      # clipped to what the type holds
    assert set(got["seats"]) == set(range(1, 12)) and set(got["progress"]) <= set(range(101))
    assert set(got["sort_order"]) == set(range(50)) and set(got["health_score"]) == set(range(1, 6))
    assert got["iso2"].str.fullmatch("[A-Z]{2}").all() and got["ticker"].str.fullmatch("[A-Z]{3}").all()
    assert all(re.fullmatch(r"\+1\d{10}", p) for p in got["phone"].dropna())
    assert all(1 <= int(x) <= 253 for ip in got["last_ip"] for x in ip.split("."))


def test_columns_do_not_depend_on_partitions(spark):
    keys = spark.range(500).withColumnRenamed("id", "k")
    one = gen.columns(keys.repartition(1), "t", SCHEMA, "k", "k", SETTINGS)
    many = gen.columns(keys.repartition(7), "t", SCHEMA, "k", "k", SETTINGS)
    assert one.exceptAll(many).isEmpty() and many.count() == 500


def test_anchor_by_priority_then_name():
    parents = {"b_id": "orders", "a_id": "people", "z_id": "accounts", "t_id": "tenants", "self_id": "me"}
    scoped = {"orders", "people", "accounts", "me"}
    assert gen.pick_anchor(parents, ["accounts", "orders"], scoped, "me") == "z_id"
    assert gen.pick_anchor(parents, ["orders"], scoped, "me") == "b_id"
    assert gen.pick_anchor(parents, [], scoped, "me") == "a_id"
    assert gen.pick_anchor({"t_id": "tenants", "self_id": "me"}, ["me"], scoped, "me") is None


def test_dependency_order(spark):
    table = lambda name, **parents: gen.Table(name, spark.range(1), "id", parents)
    order = gen.dependency_order([table("c", x="b", y="a"), table("b", x="a", own="b"), table("a", t="elsewhere")])
    assert [t.name for t in order] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        gen.dependency_order([table("a", x="b"), table("b", x="a")])


def test_zipf_index_stays_in_range(spark):
    u = spark.range(2001).select((F.col("id") / 2000).alias("u"))
    for n in (1, 2, 1000):
        at = u.select(gen.zipf_index(F.least("u", F.lit(1 - 1e-12)), F.lit(n), 1.3).alias("r"))
        low, high, first = at.agg(F.min("r"), F.max("r"), F.count_if(F.col("r") == 0)).first()
        assert (low, high) == (0, n - 1) and first >= 2001 / n


def test_tenants_follow_their_anchor(spark):
    """A tenant comes down three levels; a unique key takes each parent once; too few parents for
    one each are drawn like any other."""
    keys = lambda n: spark.range(n).select((F.col("id") * 3 + 1).alias("id"))
    tables = [gen.Table("top", keys(40), "id"), gen.Table("mid", keys(200), "id", {"top_id": "top"}),
              gen.Table("leaf", keys(300), "id", {"mid_id": "mid", "top_id": "top"}),
              gen.Table("card", keys(30), "id", {"top_id": "top"}, frozenset({"top_id"})),
              gen.Table("many", keys(90), "id", {"top_id": "top"}, frozenset({"top_id"}))]
    done = {n: {r["key"]: r for r in rows.collect()} for n, rows in gen.anchored(tables, 5, ["mid"], 1).items()}
    assert {n: len(rows) for n, rows in done.items()} == {"top": 40, "mid": 200, "leaf": 300, "card": 30, "many": 90}
    assert {r["tenant"] for r in done["top"].values()} <= set(range(1, 6)) and done["top"][1]["anchor"] is None
    for name, parent, anchor in (("mid", "top", "top_id"), ("leaf", "mid", "mid_id"), ("card", "top", "top_id"), ("many", "top", "top_id")):
        for r in done[name].values():
            assert r["anchor"] == anchor and r["tenant"] == done[parent][r["parent_key"]]["tenant"]
    assert len({r["parent_key"] for r in done["card"].values()}) == 30


def test_columns_of_one_partition_are_made_by_many_tasks(spark):
    """A narrow scan that one task reads; its rows are the same, and are made on all cores."""
    keys = spark.range(2000).selectExpr("id + 7 as k", "id as n").repartition(1)
    schema = T.StructType([f for f in SCHEMA.fields if f.name in ("email", "balance", "phone")])
    made = gen.columns(keys, "t", schema, "k", "n", SETTINGS)
    assert made.columns == ["k", *schema.names]
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    fields = [gen.column(f, "t", F.col("k"), F.col("n"), SETTINGS) for f in schema.fields]
    assert sorted(made.collect(), key=str) == sorted(keys.select("k", *fields).collect(), key=str)
