"""Registered queries on names of sold items, with their oracle SQL, which walks the same rule tables in
steps of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.functions import item_names as rules
from comanda.functions.item_names import clean_item, clean_names, size_mismatches, suggested_variant
from comanda.operators.catalogue import suspicious_merges
from comanda.plans.base import add
from comanda.sources.adapter import Shop

#: How point-of-sale systems write a menu item's name; {} stands for the name.
SPELLED = (
    "{}", "{} Ice Cream (Mini Tub (160gms))", "{} Vanila Ice Cream (Perfect Plenty (300ml))", "Alphanso {} Ice Cream (Regular Scoop)", "{} Brownie (2pcs)", "{} &amp; Orange Ice Cream With Alcohol", "Belgium {} Ice Cream (Family Tub)",
    "{} Duo (200ml + 200ml)", "{} Family Pack Of 3 (200+200+200 ml)", "Half In Half {}", "{} Plum Cake 1kg - Round Shape", "{} (Eggless) Ice Cream (Junior Scoop (60gms))", "Factor Visit {} (Family)", "{} (Navratri) 160gm", "{} Ice Cream 220 gms",
    "{} Cookie (1 pc)", "Waffle Cone {}", "{} Ice Cream (Contains Alcohol) (Family Feast (550gms))", "{} Ice Cream Ice Cream (Scoop)", "{} Cake (310gm) ,", "{} 500gm Ice Cream (Ice", "Hot Chocolate", "{} Dessert(2pcs)", "{} Small Scoop", "{} Ice Cream (Regular)",
    "{} Ice Cream (Mini Indulgence)", "{} Ice Cream (Regular Tub (300ml))", "Chocolate Dark {}  200ml", "{} 725 ml Ice Cream", "{} ( Any 1 )",
)


def _spelled(name: Column, way: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, SPELLED)), (way % len(SPELLED) + 1).cast("int")), F.lit("{}"), F.initcap(name))


def _raw_menu(s: Shop) -> DataFrame:
    return s.menu.select("menu_item_id", "type", _spelled(F.col("name"), F.col("menu_item_id")).alias("raw"))


def _sold_lines(s: Shop) -> DataFrame:
    """Lines of sales under the names that they came with."""
    names = s.menu.select("menu_item_id", "name")
    return s.items.join(names, "menu_item_id").select("quantity", _spelled(F.col("name"), F.col("menu_item_id") + F.col("line_no")).alias("name_raw"))


def sold_by_variant(s: Shop) -> DataFrame:
    """Sales by cleaned type and variant; names are added up as they came before they are cleaned."""
    by_name = _sold_lines(s).groupBy("name_raw").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
    named = by_name.join(clean_names(by_name, "name_raw"), "name_raw")
    return named.groupBy(F.col("clean.type").alias("type"), F.col("clean.variant").alias("variant")).agg(F.sum("n").alias("lines"), F.sum("q").alias("quantity"), F.count_distinct("clean.name").alias("names"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced_sql(x: str, pairs) -> str:
    for pattern, put in pairs:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    return x


def _found(x: str, words) -> str:
    return " OR ".join(f"contains({x}, {_quoted(w.lower())})" for w in words)


_LIST = "[" + ", ".join(map(_quoted, SPELLED)) + "]"
_RAW = lambda name, way: f"replace({_LIST}[CAST(({way}) % {len(SPELLED)} + 1 AS INTEGER)], '{{}}', (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM (SELECT unnest(string_split({name}, ' ')) AS w)))"
_RULE = "CASE " + " ".join(f"WHEN {' AND '.join(f'regexp_matches(low, {_quoted(p)})' for p in when)} THEN {k}" for k, (when, _, _) in enumerate(rules.VARIANTS) if when) + f" ELSE {len(rules.VARIANTS) - 1} END"
_TAKEN = "CASE rule " + " ".join(f"WHEN {k} THEN {_replaced_sql('spelled', [(p, '') for p in out])}" for k, (_, _, out) in enumerate(rules.VARIANTS) if out) + " ELSE spelled END"
_WHOLE = "named"
for _all, _none, _name in rules.WHOLE_NAMES:
    _tests = [f"contains(x, {_quoted(w)})" for w in _all] + [f"NOT contains(x, {_quoted(w)})" for w in _none]
    _WHOLE = f"list_transform([{_WHOLE}], lambda x: CASE WHEN {' AND '.join(_tests)} THEN {_quoted(_name)} ELSE x END)[1]"
#: From k1(raw) to cleaned(raw, name, type, variant), step by step.
_CLEAN = f"""
k2 AS (SELECT raw, {_replaced_sql("raw", rules.SPELLINGS)} AS spelled FROM k1),
k3 AS (SELECT *, lower(spelled) AS low FROM k2),
k4 AS (SELECT *, {_RULE} AS rule FROM k3),
k5 AS (SELECT raw, trim({_TAKEN}) AS taken, [{", ".join(_quoted(v) for _, v, _ in rules.VARIANTS)}][rule + 1] AS size FROM k4),
k6 AS (SELECT *, lower(taken) AS l, regexp_replace(taken, '(?i)\\s*\\(eggless\\)\\s*', ' Eggless ', 'g') AS e FROM k5),
k7 AS (SELECT *, replace(replace(CASE WHEN contains(e, 'Boston Cream Pie') THEN regexp_replace(e, '\\s*Dessert$', '') ELSE e END, '(Contains Alcohol) Ice Cream', 'Ice Cream (Contains Alcohol)'), 'Ice Cream (Contains Alcohol)', '(Contains Alcohol) Ice Cream') AS named,
  CASE WHEN l IN ({", ".join(_quoted(d.lower()) for d in rules.DRINKS)}) THEN 'Drinks' WHEN {_found("l", rules.SERVICES)} THEN 'Service' WHEN {_found("l", rules.EXTRAS)} THEN 'Extra'
    WHEN NOT contains(l, 'ice cream') AND ({_found("l", rules.DESSERTS)}) THEN 'Dessert' WHEN {_found("l", rules.COMBOS)} THEN 'Combo' ELSE 'Ice Cream' END AS type FROM k6),
k8 AS (SELECT raw, type, size, trim({_replaced_sql(_WHOLE, rules.ENDINGS)}) AS name FROM k7),
cleaned AS (SELECT raw, name, type, CASE WHEN type = 'Drinks' THEN '1_PIECE' WHEN type = 'Combo' AND size = '1_PIECE' THEN
  CASE {" ".join(f"WHEN contains(name, {_quoted(w)}) THEN {_quoted(v)}" for w, v in rules.COMBO_VARIANTS)} ELSE size END ELSE size END AS variant FROM k8)"""
_MENU_RAW = f", mr AS (SELECT menu_item_id, type AS menu_type, {_RAW('name', 'menu_item_id')} AS raw FROM m), k1 AS (SELECT DISTINCT raw FROM mr), {_CLEAN}"

add(
    "X11_clean_names", lambda s: _raw_menu(s).withColumn("c", clean_item(F.col("raw"))).select("menu_item_id", "raw", "c.name", "c.type", "c.variant"),
    f"{_MENU_RAW} SELECT menu_item_id, raw, name, type, variant FROM mr JOIN cleaned USING (raw)",
)
add(
    "U5_sold_by_variant", sold_by_variant,
    f", sr AS (SELECT quantity, {_RAW('name', 'menu_item_id + line_no')} AS raw FROM i JOIN m USING (menu_item_id)), k1 AS (SELECT DISTINCT raw FROM sr), {_CLEAN} SELECT type, variant, count(*) AS lines, sum(quantity) AS quantity, count(DISTINCT name) AS names FROM sr JOIN cleaned USING (raw) GROUP BY 1, 2",
)
_SIZE = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw), {_quoted(p)}) THEN {_quoted(v)}" for p, v in rules.SUGGESTIONS) + " END"
# identifiers are checked in pytest against the standard library
add(
    "X12_variant_suggestions", lambda s: _raw_menu(s).withColumn("s", suggested_variant(F.col("raw"))).select("menu_item_id", "raw", F.col("s.variant_name").alias("variant_name"), F.length("s.variant_id").alias("id_length")),
    f"{_MENU_RAW}, sg AS (SELECT raw, CASE WHEN variant <> '1_PIECE' THEN variant WHEN type = 'Ice Cream' OR contains(lower(raw), 'ice cream') THEN {_SIZE} END AS v FROM cleaned) SELECT menu_item_id, raw, v AS variant_name, CASE WHEN v IS NOT NULL THEN 36 END AS id_length FROM mr JOIN sg USING (raw)",
)


def _mapped_variants(s: Shop) -> DataFrame:
    """Raw names under the variant that another spelling of the name has."""
    i = F.col("menu_item_id")
    return s.menu.select(i, _spelled(F.col("name"), i).alias("raw"), clean_item(_spelled(F.col("name"), i + 1))["variant"].alias("variant"))


def _menu_merges(s: Shop) -> DataFrame:
    rows = _mapped_variants(s).select("menu_item_id", F.col("raw").alias("name"), "variant")
    side = lambda p, at: rows.select(at.alias("merge_id"), F.col("name").alias(f"{p}_name"), F.col("variant").alias(f"{p}_variant"))
    return side("source", F.col("menu_item_id")).join(side("target", F.col("menu_item_id") + 1), "merge_id")


_WRONG = ", ".join(f"CASE WHEN regexp_matches(lower(mr.raw), {_quoted(told)}) AND (NOT regexp_matches(upper(variant), {_quoted(must)}){f' OR contains(upper(variant), {_quoted(never)})' if never else ''}) THEN {_quoted(shown)} END" for told, shown, must, never in rules.TOLD_SIZES)
add(
    "E18_size_mismatches", lambda s: _mapped_variants(s).withColumn("problem", size_mismatches(F.col("raw"), F.col("variant"))).filter("problem <> ''"),
    f", mr AS (SELECT menu_item_id, {_RAW('name', 'menu_item_id')} AS raw, {_RAW('name', 'menu_item_id + 1')} AS other FROM m), k1 AS (SELECT DISTINCT other AS raw FROM mr), {_CLEAN} SELECT * FROM (SELECT menu_item_id, mr.raw AS raw, variant, concat_ws(', ', {_WRONG}) AS problem FROM mr JOIN cleaned ON cleaned.raw = mr.other) WHERE problem <> ''",
)
# the ratio of names is the standard library's; held to it in pytest
add("E18_suspicious_merges", lambda s: suspicious_merges(_menu_merges(s)), None)
