"""Customers found by what others know of them, and checks of names, sizes and signatures."""

import hashlib
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from comanda.functions.item_names import size_mismatches
from comanda.operators import catalogue, people
from comanda.streaming import tables

PERSON = "customer_id bigint, is_active boolean, identity_key string, name string, phone string, address string"
ASKED = "asked bigint, identity_key string, phone_hash string, name_address_hash string, name string, address string, address_hashes array<string>"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def text(x):
    return " ".join((x or "").lower().split()) or None


def one_by_one(people_, a):
    _, key, phone, both, name, address, hashes = a
    name, address = text(name), text(address)
    n, p = (lambda c: text(c[3])), (lambda c: text(c[5]))
    digits = lambda c: "".join(x for x in c[4] or "" if x.isdigit())[-10:]
    levels = [
        ("identity_key", key, lambda c: c[2] == key), ("phone_hash", phone, lambda c: digits(c) and sha(digits(c)) == phone), ("name_address_hash", both, lambda c: n(c) and p(c) and sha(f"{n(c)}|{p(c)}") == both),
        ("name_address", name and address, lambda c: n(c) == name and p(c) == address), ("address_book", hashes, lambda c: p(c) and sha(p(c)) in hashes and (not name or n(c) == name)), ("name", name and len(name) >= 3, lambda c: n(c) == name),
    ]
    for level, given, fits in levels:
        found = [c for c in people_ if given and fits(c)]
        active = [c for c in found if c[1]]
        if len(found) == 1 or len(active) == 1:
            return (found if len(found) == 1 else active)[0][0], level
    return None, None


def test_located_equals_one_by_one(spark):
    r = random.Random(11)
    pick = lambda *xs: r.choice(xs)
    known = [(i, r.random() < 0.6, f"k{r.randrange(20)}", pick("Ann Lee", "ann  LEE", "Bo", "Cy Young", None, "a|b"), pick("98765 43210", "+91 9876543211", "12", "-", None), pick("Road 1", "road  1", "Hill 2", "c", None, " ")) for i in range(16)]
    asked = [(i, pick(f"k{r.randrange(25)}", None, ""), pick(sha("9876543211"), sha("12"), None), pick(sha("ann lee|road 1"), sha("bo|c"), None), pick("Ann Lee", "bo", "cy young", "A|B", None), pick("ROAD 1", "c", None), pick([sha("hill 2")], [sha("road 1"), sha("c")], [], None)) for i in range(80)]
    got = {x.asked: (x.customer_id, x.level) for x in people.located(spark.createDataFrame(asked, ASKED), spark.createDataFrame(known, PERSON)).collect()}
    assert got == {a[0]: one_by_one(known, a) for a in asked}
    assert {level for _, level in got.values()} > {"identity_key", "phone_hash", "name_address", "address_book", "name"} - {"name"}


def test_a_key_of_many_is_a_row(spark):
    known = spark.range(2000).select(F.col("id").alias("customer_id"), (F.col("id") == 7).alias("is_active"), F.lit(None).cast("string").alias("identity_key"), F.lit("Walk In").alias("name"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("address"))
    asked = spark.createDataFrame([(1, None, None, None, "walk in", None, None), (2, None, None, None, None, None, None)], ASKED)
    assert {(x.asked, x.customer_id, x.level) for x in people.located(asked, known).collect()} == {(1, 7, "name"), (2, None, None)}
    assert people.located(asked.limit(0), known).count() == 0 and people.located(asked, known.limit(0)).filter("customer_id is null").count() == 2


@pytest.mark.parametrize(
    ("raw", "variant", "problem"),
    [
        ("Fig Ice Cream (Junior Scoop (60gms))", "JUNIOR_SCOOP_60GMS", ""), ("Fig 60 g", "REGULAR_SCOOP_120GMS", "60g"), ("Fig 120gms", "MINI_TUB_160GMS", "120g"), ("Fig 500gm", "JUNIOR_SCOOP_60GMS", "500g"), ("Fig 500gm", "FAMILY_TUB_500GMS", ""),
        ("Fig 200 ML", "DUO_200ML_200ML", ""), ("Fig 200ml", "1_PIECE", "200ml"), ("Fig 725ml", "family_tub_700ml", ""), ("Fig 700ml", "REGULAR_TUB_300ML", "700ml"), ("Family Feast 1200 g", "1_PIECE", "family_tub"), ("Mini Tub, small scoop", "X", "junior_scoop, mini_tub"),
        ("Perfect Plenty", "REGULAR_TUB_300ML", ""), ("Fig", None, ""), (None, "X", ""), ("", "", ""),
    ],
)
def test_size_mismatches(spark, raw, variant, problem):
    df = spark.createDataFrame([(raw, variant)], "raw string, variant string")
    assert df.select(size_mismatches(F.col("raw"), F.col("variant"))).first()[0] == problem


def test_suspicious_merges(spark):
    rows = [(1, "Fig Cup", "FIG CUP", "A", "A"), (2, "Fig", "Mango Shake", None, "A"), (3, "Fig", "Figs", "A", "B"), (4, "Fig", "Figs", "UNKNOWN", "B"), (5, "Fig", "Plum", "A", "1_PIECE"), (6, "x", "y", "A", "B")]
    got = {r.merge_id: r.problem for r in catalogue.suspicious_merges(spark.createDataFrame(rows, "merge_id int, source_name string, target_name string, source_variant string, target_variant string")).collect()}
    assert got == {2: "names unlike", 3: "variant shift", 5: "names unlike", 6: "names unlike, variant shift"}
    assert all(SequenceMatcher(None, a.lower(), b.lower()).ratio() < 0.6 for i, a, b, *_ in rows if "names" in got.get(i, ""))


def test_different_rows_sign_differently(spark):
    rows = [(1, "x|b=y", "z", 1), (2, "x", "y|b=z", 1), (3, "x", None, 1), (4, "x", "", 1), (5, None, "x", 1)]
    signed = tables.signed(spark.createDataFrame([(k, a, b, s) for k, a, b, s in rows], "k int, a string, b string, seq int"), ["k"], "seq")
    plain = tables.signed(spark.createDataFrame([("k", a, b, s) for _, a, b, s in rows[:1]] + [("j", *rows[1][1:])], "k string, a string, b string, seq int"), ["k"], "seq")
    assert len({r.signature for r in signed.collect()}) == 5 and len({r.signature for r in plain.collect()}) == 2


def test_pairs_of_a_phone_go_to_its_first(spark):
    from types import SimpleNamespace

    contacts = spark.createDataFrame([(i, "98765 43210") for i in range(5)] + [(9, "+91 9876543210"), (10, None), (11, "1")], "customer_id bigint, phone string")
    pairs = people.same_phone_pairs(SimpleNamespace(contacts=contacts)).collect()
    assert {(r.customer_id, r.other_id) for r in pairs} == {(0, i) for i in (1, 2, 3, 4, 9)}
