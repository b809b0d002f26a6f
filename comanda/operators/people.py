"""Customers as people: search, profiles, snapshots, merges and finding the one that is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from comanda.functions.scalars import closeness
from comanda.functions.text import identity_key, joined_address, normal_phone, normal_text
from comanda.operators.cosine import nearest
from comanda.operators.entities import merge_policy, name_ratio
from comanda.session import spread, written
from comanda.sources.adapter import Shop

#: Nearest texts that are scored for each customer.
NEIGHBOURS = 5
#: Pairs scored first, those that may score most, and how many suggestions they are asked for at most.
FIRST, FEW = 2_000, 1_000


def primary_addresses(shop: Shop) -> DataFrame:
    """customer_id and its primary address: the default one, else the oldest."""
    first = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("is_default"), "address_id"))
    return shop.addresses.withColumn("r", first).filter("r = 1").select("customer_id", "address_id", joined_address(F.col("address_line_1"), F.col("address_line_2"), F.col("city")).alias("address"))


def active_customers(customers: DataFrame, merges: DataFrame) -> DataFrame:
    """Customers that no active merge took away."""
    return customers.join(merges.select(F.col("source").alias("customer_id")), "customer_id", "left_anti")


def search(customers: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Name, phone or number holds the needle, whatever its case (% and _ are wildcards)."""
    hit = F.lit(False)
    for c in ("name", "phone", "customer_id"):
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{needle}%"), F.lit(False))
    return customers.filter(hit).orderBy("customer_id").limit(limit)


def _totals(shop: Shop) -> DataFrame:
    return shop.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"), F.round(F.sum("total"), 2).alias("total_spent"), F.max("created_on").alias("last_order"))


def profiles(shop: Shop, merges: DataFrame) -> DataFrame:
    """Each customer with totals, primary address, number of addresses and whether it was merged away."""
    count = shop.addresses.groupBy("customer_id").agg(F.count(F.lit(1)).alias("address_count"))
    gone = merges.select(F.col("source").alias("customer_id"), F.lit(True).alias("gone")).distinct()
    rows = shop.contacts.join(_totals(shop), "customer_id", "left").join(primary_addresses(shop), "customer_id", "left").join(count, "customer_id", "left").join(gone, "customer_id", "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return rows.select("customer_id", F.coalesce("name", F.concat(F.lit("Customer "), F.col("customer_id").cast("string"))).alias("name"), "phone", "address", zero("total_orders", 0).alias("total_orders"), zero("total_spent", 0.0).alias("total_spent"), F.col("last_order").cast("date").cast("string").alias("last_order"), "is_verified", zero("address_count", 0).alias("address_count"), zero("gone", False).alias("is_merged"))


def recent_orders(shop: Shop, k: int = 6) -> DataFrame:
    """Each customer's last orders with their items by name: ``name`` or ``name xN``."""
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("created_on"), F.desc("order_id")))
    last = spread(shop.orders, shop.n_orders, "customer_id").withColumn("nth", nth).filter(F.col("nth") <= k).select("customer_id", "order_id", "nth", "total")
    lines = spread(shop.items, shop.n_lines, "order_id").join(last.select("order_id"), "order_id").join(shop.menu.select("menu_item_id", "name"), "menu_item_id", "left").filter("trim(name) <> ''")
    each = lines.groupBy("order_id", F.trim("name").alias("name")).agg(F.sum(F.col("quantity").cast("long")).alias("q"))
    text = F.when(F.col("q") > 1, F.concat("name", F.lit(" x"), F.col("q").cast("string"))).otherwise(F.col("name"))
    lists = each.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct(F.lower("name"), "name", text.alias("t")))).alias("l")).select("order_id", F.array_join(F.col("l.t"), ", ").alias("items"))
    return last.join(lists, "order_id", "left").select("customer_id", "nth", "order_id", F.round("total", 2).alias("total"), F.coalesce("items", F.lit("No items")).alias("items"))


def top_items(shop: Shop, k: int = 3) -> DataFrame:
    """Each customer's items of most quantity, then most orders, then name. Every order becomes one row of an item
    where its lines lie together, so that orders are counted without being told apart again."""
    named = shop.items.join(shop.menu.select("menu_item_id", "name"), "menu_item_id")
    rows = spread(named.select("order_id", "name", "quantity"), shop.n_lines, "order_id").groupBy("order_id", "name").agg(F.sum("quantity").alias("quantity"))
    rows = rows.join(shop.orders.select("order_id", "customer_id"), "order_id").select("customer_id", "name", "quantity")
    each = spread(rows, shop.n_lines, "customer_id", "name").groupBy("customer_id", "name").agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("quantity"))
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("quantity"), F.desc("orders"), F.lower("name"), "name"))
    return each.withColumn("nth", nth).filter(F.col("nth") <= k)


def judged_merges(shop: Shop, pairs: DataFrame) -> DataFrame:
    """``pairs(source, target)`` under the merge policy."""
    flag = lambda k: shop.customers.select(F.col("customer_id").alias(k), F.col("is_verified").alias(f"{k}_verified"))
    rows = pairs.join(flag("source"), "source").join(flag("target"), "target")
    rule = merge_policy(F.col("source_verified"), F.col("target_verified"))
    return rows.select("source", "target", rule.alias("rule"), (rule != "error").alias("is_allowed"), (rule == "unverified_pair").alias("needs_choice"))


def merge_preview(shop: Shop, pairs: DataFrame) -> DataFrame:
    """What each merge would do: orders and spend that move, addresses copied (those the target lacks),
    and the phone that the target has afterwards."""
    orders = shop.orders.groupBy(F.col("customer_id").alias("source")).agg(F.count(F.lit(1)).alias("orders"), F.sum("total").alias("spend"))
    line = F.lower(F.concat_ws("|", *[F.trim(c) for c in ("address_line_1", "address_line_2", "city")]))
    own = shop.addresses.select(F.col("customer_id").alias("target"), line.alias("line")).distinct()
    theirs = shop.addresses.select(F.col("customer_id").alias("source"), line.alias("line")).distinct()
    copied = pairs.join(theirs, "source").join(own, ["target", "line"], "left_anti").groupBy("source", "target").agg(F.count(F.lit(1)).alias("copied"))
    phone = lambda k: shop.contacts.select(F.col("customer_id").alias(k), F.col("phone").alias(f"{k}_phone"))
    rows = pairs.join(orders, "source", "left").join(copied, ["source", "target"], "left").join(phone("source"), "source", "left").join(phone("target"), "target", "left")
    return rows.select("source", "target", F.coalesce("orders", F.lit(0)).alias("orders_moved"), F.round(F.coalesce("spend", F.lit(0.0)), 2).alias("spend_moved"), F.coalesce("copied", F.lit(0)).alias("addresses_copied"), F.coalesce("target_phone", "source_phone").alias("phone"))


def merge_history(shop: Shop, log: DataFrame, limit: int = 20) -> DataFrame:
    """The latest merges with both names and whether they were undone."""
    each = log.groupBy("merge_id").agg(F.min("source").alias("source"), F.min("target").alias("target"), F.max((F.col("event_type") == "undo").cast("int")).alias("u"))
    name = lambda k: shop.customers.select(F.col("customer_id").alias(k), F.col("name").alias(f"{k}_name"))
    rows = each.orderBy(F.desc("merge_id")).limit(limit).join(name("source"), "source", "left").join(name("target"), "target", "left")
    return rows.select("merge_id", "source", "target", "source_name", "target_name", (F.col("u") == 1).alias("is_undone"))


def same_phone_pairs(shop: Shop) -> DataFrame:
    """Every other customer of a phone with the first one of it, whose number is smaller: a phone of n
    customers gives n - 1 pairs, from which all others follow."""
    rows = shop.contacts.select("customer_id", normal_phone(F.col("phone")).alias("phone")).filter("phone is not null")
    first = rows.groupBy("phone").agg(F.min("customer_id").alias("first_id"))
    return rows.join(first, "phone").filter("customer_id > first_id").select(F.col("first_id").alias("customer_id"), F.col("customer_id").alias("other_id"), "phone")


def _aimed(shop: Shop, pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``pairs(customer_id, other_id, score)`` as merges that policy allows: the stronger customer is the
    target (verified, then orders, spend, a phone and smaller number)."""
    totals = _totals(shop).select("customer_id", "total_orders", "total_spent")
    phones = shop.contacts.select("customer_id", normal_phone(F.col("phone")).isNotNull().cast("int").alias("has_phone"))
    rank = shop.customers.join(totals, "customer_id", "left").join(phones, "customer_id", "left").select("customer_id", F.struct(F.col("is_verified").cast("int").alias("v"), F.coalesce("total_orders", F.lit(0)).alias("o"), F.coalesce("total_spent", F.lit(0.0)).alias("s"), F.coalesce("has_phone", F.lit(0)).alias("p"), (-F.col("customer_id")).alias("i")).alias("rank"))
    side = lambda k: rank.select(F.col("customer_id").alias(k), F.col("rank").alias(f"{k}_rank"))
    rows = pairs.join(side("customer_id"), "customer_id").join(side("other_id"), "other_id")
    swap = F.col("customer_id_rank") > F.col("other_id_rank")
    best, worst = F.greatest("customer_id_rank", "other_id_rank"), F.least("customer_id_rank", "other_id_rank")
    rows = rows.filter(merge_policy(worst["v"] == 1, best["v"] == 1) != "error")
    return rows.select(F.when(swap, F.col("other_id")).otherwise(F.col("customer_id")).alias("source"), F.when(swap, F.col("customer_id")).otherwise(F.col("other_id")).alias("target"), "score", best["o"].alias("target_orders"), best["s"].alias("target_spent"), *extra)


def suggestions(shop: Shop, pairs: DataFrame, limit: int = 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """Merges to suggest for ``pairs(customer_id, other_id, score)``: best scores and targets first;
    what merge policy refuses goes."""
    rows = _aimed(shop, pairs, extra)
    return rows.orderBy(F.desc("score"), F.desc("target_orders"), F.desc("target_spent"), "source", "target").limit(limit)


#: Ways to name a customer, the surest first.
LOCATORS = ("identity_key", "phone_hash", "name_address_hash", "name_address", "address_book", "name")


def _long(rows: DataFrame, columns: list[str], keys: list[tuple[str, Column]]) -> DataFrame:
    ways = [F.struct(F.lit(LOCATORS.index(level)).alias("place"), key.alias("key")) for level, key in keys]
    return rows.select(*columns, F.inline(F.array(*ways))).filter("key is not null")


def known_locators(people: DataFrame) -> DataFrame:
    """Every way in which ``people(customer_id, is_active, identity_key, name, phone, address)`` can be
    named: customer_id, is_active, place in LOCATORS and key."""
    name, phone, place = normal_text(F.col("name")), normal_phone(F.col("phone")), normal_text(F.col("address"))
    hashed = F.sha2(place, 256)
    book = lambda n: F.concat(n, F.lit("|"), hashed)
    keys = [
        ("identity_key", F.col("identity_key")), ("phone_hash", F.sha2(phone, 256)), ("name_address_hash", F.sha2(F.concat(name, F.lit("|"), place), 256)), ("name_address", F.concat(name, F.lit("\n"), place)),
        ("address_book", book(name)), ("address_book", book(F.lit(""))), ("name", F.when(F.length(name) >= 3, name)),
    ]
    return _long(people, ["customer_id", "is_active"], keys)


def asked_locators(asked: DataFrame) -> DataFrame:
    """The same of descriptions ``asked(asked, identity_key, phone_hash, name_address_hash, name, address,
    address_hashes)``; of several addresses any may fit, together with the name where it is given."""
    name, place = normal_text(F.col("name")), normal_text(F.col("address"))
    keys = [(c, F.nullif(F.col(c), F.lit(""))) for c in ("identity_key", "phone_hash", "name_address_hash")]
    keys += [("name_address", F.concat(name, F.lit("\n"), place)), ("name", F.when(F.length(name) >= 3, name))]
    hashes = asked.select("asked", "name", F.explode("address_hashes").alias("hash"))
    book = _long(hashes, ["asked"], [("address_book", F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.nullif(F.col("hash"), F.lit(""))))])
    return _long(asked, ["asked"], keys).unionByName(book).distinct()


def located(asked: DataFrame, people: DataFrame) -> DataFrame:
    """``asked`` with the customer that each description means and by which of LOCATORS: the first that
    fits one customer, or one active customer.

    The least and greatest customer of a key tell whether there is one, so a key that very many share
    is a row.
    """
    own = F.col("customer_id")
    on = F.when(F.col("is_active"), own)
    keys = known_locators(people).groupBy("place", "key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min(on).alias("low_on"), F.max(on).alias("high_on"))
    each = asked_locators(asked).join(keys, ["place", "key"]).groupBy("asked", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_on").alias("low_on"), F.max("high_on").alias("high_on"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low_on") == F.col("high_on"), F.col("low_on"))
    best = each.withColumn("one", one).filter("one is not null").groupBy("asked").agg(F.min_by("one", "place").alias("customer_id"), F.min("place").alias("place"))
    level = F.get(F.array(*map(F.lit, LOCATORS)), F.col("place"))
    return asked.join(best, "asked", "left").select(*asked.columns, "customer_id", level.alias("level"))


def described(shop: Shop) -> DataFrame:
    """customer_id, is_active, identity_key, name (several share one), phone and primary address."""
    address = primary_addresses(shop).select("customer_id", "address")
    rows = shop.contacts.join(address, "customer_id", "left").withColumn("name", F.regexp_replace("name", "[0-9]$", ""))
    key = identity_key(F.col("phone"), F.col("name"), F.col("address"), F.col("customer_id"))
    return rows.select("customer_id", (F.col("customer_id") % 6 != 3).alias("is_active"), key.alias("identity_key"), "name", "phone", "address")


def name_similarity(a: Column, b: Column) -> Column:
    """Of two normal names: sorted words, first words, whole names and last words, less sure for
    short names."""
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    wa, wb = words(a), words(b)
    ratio = lambda x, y: F.when((F.length(x) > 0) & (F.length(y) > 0), name_ratio(x, y)).otherwise(0.0)
    sorted_words = lambda w: F.array_join(F.array_sort(w), " ")
    full = ratio(a, b)
    last = F.when((F.size(wa) > 1) & (F.size(wb) > 1), ratio(F.get(wa, F.size(wa) - 1), F.get(wb, F.size(wb) - 1))).otherwise(full)
    mixed = 0.35 * ratio(sorted_words(wa), sorted_words(wb)) + 0.25 * ratio(F.get(wa, F.lit(0)), F.get(wb, F.lit(0))) + 0.20 * full + 0.20 * last
    base = F.when((F.size(wa) == 1) & (F.size(wb) == 1), full).otherwise(mixed)
    letters = lambda w: F.length(F.array_join(w, ""))
    sure = 0.75 + 0.25 * (F.least(F.greatest(F.size(wa), F.size(wb), F.lit(1)), F.lit(3)) / 3 * 0.6 + F.least(F.greatest(letters(wa), letters(wb), F.lit(1)), F.lit(12)) / 12 * 0.4)
    return F.when((F.size(wa) > 0) & (F.size(wb) > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * sure))).otherwise(0.0)


def _described(rows: DataFrame, *more: str) -> DataFrame:
    """customer_id and r: normal name, phone and address of ``rows``, their text, and ``more``."""
    name, phone, address = normal_text(F.col("name")), normal_phone(F.col("phone")), normal_text(F.col("address"))
    text = F.concat_ws(" | ", name, phone, address)
    return rows.select("customer_id", F.struct(F.coalesce(name, F.lit("")).alias("name"), phone.alias("phone"), F.coalesce(address, F.lit("")).alias("address"), text.alias("text"), *more).alias("r"))


def records(shop: Shop) -> DataFrame:
    """customer_id and r: normal name, phone and address of every customer, their text, orders and spend."""
    return _described(profiles(shop, shop.customers.select(F.col("customer_id").alias("source")).limit(0)), "total_orders", "total_spent")


def text_neighbours(shop: Shop, merges: DataFrame, k: int = NEIGHBOURS, search: str = "") -> DataFrame:
    """customer_id, other_id, cosine and rank: the active customers whose texts are nearest to each active
    one's, or to each whose name has the words searched for."""
    name = F.coalesce("name", F.concat(F.lit("Customer "), F.col("customer_id").cast("string")))  # as in profiles, whose orders take no part
    every = _described(shop.contacts.join(primary_addresses(shop), "customer_id", "left").withColumn("name", name))
    known = every.join(active_customers(shop.customers.select("customer_id"), merges), "customer_id", "left_semi")
    asked = known.filter(F.contains("r.name", normal_text(F.lit(search)))).select(F.col("customer_id").alias("id")) if search.strip() else None
    near = nearest(known.select(F.col("customer_id").alias("id"), F.col("r.text").alias("text")), k, asked)
    return near.select(F.col("id").alias("customer_id"), F.col("other").alias("other_id"), F.col("score").alias("cosine"), "rank")


def similar_customers(shop: Shop, merges: DataFrame, search: str = "", limit: int = 20) -> DataFrame:
    """Merges to suggest: pairs of active customers whose texts are near or whose phone is one, as far as
    their scores are kept and merge policy allows source and target; each pair once, with its best score."""
    active = active_customers(shop.customers.select("customer_id", "name"), merges)
    phones = same_phone_pairs(shop)
    for side in ("customer_id", "other_id"):
        phones = phones.join(active.select(F.col("customer_id").alias(side)), side, "left_semi")
    near = text_neighbours(shop, merges, search=search).select("customer_id", "other_id", "cosine")
    pairs = near.unionByName(phones.select("customer_id", "other_id", F.lit(None).cast("double").alias("cosine")))
    if search.strip():
        hit = active.filter(F.contains(normal_text(F.col("name")), normal_text(F.lit(search)))).select("customer_id")
        named = lambda side: pairs.join(hit.select(F.col("customer_id").alias(side)), side, "left_semi").select(*pairs.columns)
        pairs = named("customer_id").unionByName(named("other_id")).distinct()
    known, columns = written(records(shop), "records"), pairs.columns

    def suggested(rows: DataFrame) -> DataFrame:
        scored = pair_scores(shop, rows.select(*columns), known, more=("cosine",)).filter("kept")
        sure = F.struct("score", F.col("cosine").isNotNull(), F.col("customer_id") < F.col("other_id"))  # of equal scores the near pair's, as found first
        one = scored.groupBy(F.least("customer_id", "other_id").alias("customer_id"), F.greatest("customer_id", "other_id").alias("other_id")).agg(F.max("score").alias("score"), F.max_by("reasons", sure).alias("reasons"))
        return suggestions(shop, one, limit, extra=("reasons",))

    if limit > FEW:
        return suggested(written(pairs, "candidates"))
    most = pair_scores(shop, pairs, known, at_most=True, more=("cosine",)).select(*columns, "score")
    candidates = written(_aimed(shop, most, extra=tuple(columns)), "candidates")
    first = candidates.orderBy(F.desc("score"), F.desc("target_orders"), F.desc("target_spent"), *columns).limit(FIRST)
    return suggested(may_be_among(candidates, suggested(first).collect(), limit))


def may_be_among(candidates: DataFrame, found: list[Row], limit: int) -> DataFrame:
    """``candidates(score, target_orders, target_spent)``, scored at most so, without those that come after the last of
    ``limit`` suggestions ``found`` even so."""
    if len(found) < limit or not found:
        return candidates
    last = found[-1]
    score, orders, spent = F.col("score"), F.col("target_orders"), F.col("target_spent")
    equal = (orders > last["target_orders"]) | ((orders == last["target_orders"]) & (spent >= last["target_spent"] - 0.02))  # sums of money, made twice
    return candidates.filter((score > last["score"]) | ((score == last["score"]) & equal))


def pair_scores(shop: Shop, pairs: DataFrame, known: DataFrame | None = None, at_most: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Scores of ``pairs(customer_id, other_id)``: text, name, address, behaviour and a bonus for one
    phone; and whether the score or its parts are enough to keep it. ``cosine``, where ``pairs`` has it and
    it is not null, stands for the ratio of the texts. ``known`` are the ``records``, if they are there already.
    With ``at_most`` no ratio is computed: each is as great as it can be, and so are the scores. ``more`` of the pairs' columns are handed on."""
    known = records(shop) if known is None else known
    ratio = (lambda a, b: F.lit(1.0)) if at_most else name_ratio
    named = (lambda a, b: F.when((F.length(a) > 0) & (F.length(b) > 0), 1.0).otherwise(0.0)) if at_most else name_similarity
    side = lambda k, r: known.select(F.col("customer_id").alias(k), F.col("r").alias(r))
    cosine = F.col("cosine") if "cosine" in pairs.columns else F.lit(None).cast("double")
    both = pairs.select("customer_id", "other_id", cosine.alias("cosine")).join(side("customer_id", "a"), "customer_id").join(side("other_id", "b"), "other_id")
    if not at_most:
        both = spread(both, 0, "customer_id")  # the ratios are the work here, however few the bytes
    same = F.coalesce(F.col("a.phone") == F.col("b.phone"), F.lit(False))
    address_ratio = F.when((F.length("a.address") > 0) & (F.length("b.address") > 0), ratio(F.col("a.address"), F.col("b.address"))).otherwise(0.0)
    behaviour = (closeness(F.col("a.total_orders"), F.col("b.total_orders")) + closeness(F.col("a.total_spent"), F.col("b.total_spent"))) / 2
    parts = both.select("customer_id", "other_id", F.coalesce("cosine", ratio(F.col("a.text"), F.col("b.text"))).alias("text"), named(F.col("a.name"), F.col("b.name")).alias("name"), address_ratio.alias("address"), behaviour.alias("behaviour"), same.alias("same_phone"), *more)
    score = 0.45 * F.col("text") + 0.25 * F.col("name") + 0.15 * F.col("address") + 0.15 * F.col("behaviour") + F.when(F.col("same_phone"), 0.2).otherwise(0.0)
    score = F.least(F.when(F.col("same_phone"), F.greatest(score, F.lit(0.88))).otherwise(score), F.lit(0.99))
    reasons = F.array_compact(F.array(F.when(F.col("same_phone"), "Exact phone match"), F.when(F.col("name") >= 0.85, "Very similar customer names"), F.when(F.col("address") >= 0.8, "Very similar saved addresses"), F.when(F.col("behaviour") >= 0.75, "Similar order count / spend profile"), F.when(F.col("text") >= 0.8, "Strong text similarity across name, phone, and address")))
    keep = (F.col("score") >= 0.72) | F.col("same_phone") | ((F.col("name") >= 0.8) & (F.col("address") >= 0.7))
    r4 = lambda c: F.round(c, 4).alias(c)
    out = parts.withColumn("score", score).withColumn("kept", keep).withColumn("reasons", F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("High overall similarity score"))
    return out.select("customer_id", "other_id", r4("score"), r4("text"), r4("name"), r4("address"), r4("behaviour"), "same_phone", "kept", "reasons", *more)
