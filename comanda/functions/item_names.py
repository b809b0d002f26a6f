"""Names of sold items as point-of-sale systems send them, cleaned to name, type and variant.

The rules are tables: ordered rewrites, and variant rules of which the first that fits counts and
takes its own words out of the name. They are compiled into one struct column. Each step is bound
once (``_let``), so the plan grows with the number of rules and not with their product, and a rule's
rewrites run only for the names it fits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.functions.text import uuid5

# Fixed values, in the order in which they apply.

#: Rewrites of spellings: pattern, replacement.
SPELLINGS = (
    (r"&amp;", "&"),
    (r"\bPiec\b", "Pie"),
    (r"\bVanila\b", "Vanilla"),
    (r"\bAlphanso\b", "Alphonso"),
    (r"\bFactor Visit\b", "Factory Visit"),
    (r"Pidge/porter", "Pidge/Porter"),
    (r"(?i)\bBean[- ]to[- ]bar\b", "Bean-to-Bar"),
    (r"\bChocolate Dark\b", "Dark Chocolate"),
    (r"\bChocolate 70% Dark\b", "70% Dark Chocolate"),
    (r"\bD&n\b", "D&N"),
    (r"(?i)\(contains Alcohol\)", "(Contains Alcohol)"),
    (r"(?i)With Alcohol", "(Contains Alcohol)"),
    (r"\bFig Orange\b", "Fig & Orange"),
    (r"\bEggles\b", "Eggless"),
    (r"(?i)\bBelgium\b", "Bean-to-Bar"),
    (r"(?i)\s*\(Ice Cream\)", ""),
    (r"\bIce Cream Ice Cream\b", "Ice Cream"),
    (r"\s*\([^)]*$", ""),
)
#: Sizes by label: words of the label, (what else stands in the name, variant), variant without it.
LABELS = (
    ("Family Feast", (("725ml", "FAMILY_TUB_725ML"), ("700ml", "FAMILY_TUB_700ML"), ("550gms?", "FAMILY_TUB_550GMS")), "FAMILY_TUB_725ML"),
    ("Family Tub", (("725ml", "FAMILY_TUB_725ML"), ("700ml", "FAMILY_TUB_700ML"), ("500gms?", "FAMILY_TUB_500GMS")), "FAMILY_TUB_500GMS"),
    ("Perfect Plenty", (("350ml", "PERFECT_PLENTY_350ML"), ("325ml", "PERFECT_PLENTY_325ML"), ("300ml", "PERFECT_PLENTY_300ML"), ("200ml", "PERFECT_PLENTY_200ML"), ("200gms?", "PERFECT_PLENTY_200GMS")), "PERFECT_PLENTY_200GMS"),
    ("Mini Indulgence", (), "MINI_TUB_200ML"),
    ("Regular Tub", (("300ml", "REGULAR_TUB_300ML"), ("220gms?", "REGULAR_TUB_220GMS")), "REGULAR_TUB_220GMS"),
    ("Mini Tub", (("200ml", "MINI_TUB_200ML"), ("160gms?", "MINI_TUB_160GMS")), "MINI_TUB_160GMS"),
    ("Regular Scoop", (), "REGULAR_SCOOP_120GMS"),
    ("Junior Scoop", (), "JUNIOR_SCOOP_60GMS"),
)
#: Variant rules before and after those of the labels: patterns of the lower-case name that must all be
#: found, variant, what is taken out.
BEFORE_LABELS = (
    (("any 1",), "1_PIECE", ()),
    ((r"200ml\+200ml|200ml \+ 200ml",), "DUO_200ML_200ML", (r"(?i)\s*\(200ml\s*\+\s*200ml\)",)),
    ((r"200\+200\+200",), "FAMILY_PACK_3X200ML", (r"(?i)\s*\(200\+200\+200[^)]*\)", r"(?i)\s*\(200[ml\s]*\+200[ml\s]*\+200[ml\s]*\)")),
)
NAVRATRI = r"(?i)\s*\(navratri\)"
AFTER_LABELS = (
    ((r"\(scoop\)",), "REGULAR_SCOOP_120GMS", (r"(?i)\s*\(Scoop\)",)),
    ((r"\(regular\)$",), "REGULAR_SCOOP_120GMS", (r"(?i)\s*\(Regular\)$",)),
    ((r"\(2\s*pcs?\)",), "2_PIECES", (r"(?i)\s*\(2\s*pcs?\)", r"Dessert$")),
    ((r"\(1\s*pcs?\)",), "1_PIECE", (r"(?i)\s*\(1\s*pcs?\)", r"Dessert$")),
    ((r"\(250gm\)",), "250GMS", (r"(?i)\s*\(250gm\)",)),
    ((r"\(310gm\)",), "310GMS", (r"(?i)\s*\(310gm\)",)),
    ((r"\(325gm\)",), "325GMS", (r"(?i)\s*\(325gm\)",)),
    (("1kg",), "1KG", (r"(?i)\s*1kg",)),
    (("400gm",), "400GMS", (r"(?i)\s*400gm",)),
    (("single",), "SINGLE", (r"(?i)\s*\(single\)",)),
    (("family", "factory visit"), "FAMILY", (r"(?i)\s*\(family\)",)),
    (("small scoop",), "JUNIOR_SCOOP_60GMS", (NAVRATRI, r"(?i)\s*Small Scoop")),
    (("160gm",), "MINI_TUB_160GMS", (NAVRATRI, r"(?i)\s*\(?160gm\)?")),
    (("200ml",), "MINI_TUB_200ML", (NAVRATRI, r"(?i)\s*\(?200ml\)?")),
    ((), "1_PIECE", (NAVRATRI,)),
)
#: Types by words of the lower-case name; drinks are whole names.
DRINKS = ("Americano", "Cappuccino", "Hot Chocolate", "Water Bottle")
SERVICES = ("Factory Visit", "School Kids")
EXTRAS = ("Cup", "Takeaway Cup", "Waffle Cone", "Butter Waffle", "Delivery Charges", "Pidge/Porter", "Packaging", "Thermocol", "Dry Ice", "Hot Chocolate Fudge Sauce")
DESSERTS = (
    "Affogato", "Boston Cream Pie", "Brownie", "Cheesecake", "Lamington", "Tiramisu", "Plum Cake", "Cookie", "Tres Leches", "Employee Dessert",
    "Cream Cheese Fruit Medley Cake", "Ice Cream Cake", "Customised Ice Cream Cake",
)
COMBOS = ("Duo", "Family Pack", "Half In Half", "Combo")
ICE_CREAM = "Ice Cream"
#: Whole names: words that must stand in the name, words that must not, the name.
WHOLE_NAMES = (
    (("Chocolate & Orange", "Contains Alcohol"), (), "Chocolate & Orange (Contains Alcohol) Ice Cream"),
    (("Orange Ice Cream", "Alcohol"), ("Chocolate",), "Orange (Contains Alcohol) Ice Cream"),
    (("Orange & Biscuits", "Alcohol"), (), "Orange & Biscuits (Contains Alcohol) Ice Cream"),
)
ENDINGS = ((r"\s*-\s*Round Shape", ""), (r"\s*[-,\.]+\s*$", ""), (r"\s+", " "))
#: Variants of combos by their names, where no size told them.
COMBO_VARIANTS = (("Duo", "DUO_200ML_200ML"), ("Family Pack Of 3", "FAMILY_PACK_3X200ML"), ("Half In Half", "HALF_IN_HALF_REGULAR_SCOOP"))
#: What a name that has no size by the rules above may still tell.
SUGGESTIONS = (
    (r"60\s*gms?|60gm|junior scoop|small scoop", "JUNIOR_SCOOP_60GMS"),
    (r"120\s*gms?|120gm|regular scoop|\(regular\)", "REGULAR_SCOOP_120GMS"),
    (r"160\s*gms?|160gm|mini tub", "MINI_TUB_160GMS"),
    (r"200\s*ml|mini indulgence", "MINI_TUB_200ML"),
    (r"220\s*gms?|220gm", "REGULAR_TUB_220GMS"),
    (r"300\s*ml", "REGULAR_TUB_300ML"),
    (r"725\s*ml", "FAMILY_TUB_725ML"),
    (r"700\s*ml", "FAMILY_TUB_700ML"),
    (r"500\s*gms?|500gm", "FAMILY_TUB_500GMS"),
)
#: Sizes and forms that a raw name tells, with what its variant's name has to hold and must not hold. Fixed values.
TOLD_SIZES = (
    (r"\b60\s*g", "60g", "^JUNIOR_SCOOP_60GMS$", None),
    (r"\b120\s*g", "120g", "^REGULAR_SCOOP_120GMS$", None),
    (r"\b500\s*g", "500g", "", "SCOOP"),
    (r"\b200\s*ml", "200ml", "MINI_TUB|200ML", None),
    (r"\b700\s*ml", "700ml", "FAMILY|725ML", None),
    (r"\b725\s*ml", "725ml", "FAMILY|725ML", None),
    (r"junior scoop|small scoop", "junior_scoop", "JUNIOR_SCOOP", None),
    (r"regular scoop", "regular_scoop", "REGULAR_SCOOP", None),
    (r"mini tub", "mini_tub", "MINI_TUB", None),
    (r"perfect plenty", "perfect_plenty", "PERFECT_PLENTY|REGULAR_TUB", None),
    (r"family|feast", "family_tub", "FAMILY", None),
)
#: Namespace of identifiers made from names.
NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def _label_rules() -> list[tuple[tuple[str, ...], str, tuple[str, ...]]]:
    """A rule for each size of a label, the label alone last; all take the label out with its bracket."""
    rules = []
    for label, sizes, otherwise in LABELS:
        out = (rf"(?i)\s*\({label}\s*\([^)]+\)\)", rf"(?i)\s*\({label}\)")
        rules += [((label.lower(), *size), variant, out) for *size, variant in (*sizes, (otherwise,))]
    return rules


VARIANTS = (*BEFORE_LABELS, *_label_rules(), *AFTER_LABELS)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _rewritten(x: Column, rules) -> Column:
    for pattern, put in rules:
        x = F.regexp_replace(x, f"(?U){pattern}", put)  # (?U): letters and spaces as Unicode has them
    return x


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w.lower()) for w in words)


def _first_rule(name: Column) -> Column:
    """Number of the first variant rule that fits; the last fits all."""
    lower = F.lower(name)

    def chosen(x: Column) -> Column:
        out = F.lit(len(VARIANTS) - 1)
        for k in reversed(range(len(VARIANTS) - 1)):
            fits = F.lit(True)
            for pattern in VARIANTS[k][0]:
                fits = fits & x.rlike(f"(?U){pattern}")
            out = F.when(fits, k).otherwise(out)
        return out

    return _let(lower, chosen)


def type_of(name: Column) -> Column:
    def told(x: Column) -> Column:
        return (
            F.when(x.isin(*[d.lower() for d in DRINKS]), "Drinks")
            .when(x.rlike(_any_of(SERVICES)), "Service")
            .when(x.rlike(_any_of(EXTRAS)), "Extra")
            .when(~F.contains(x, F.lit(ICE_CREAM.lower())) & x.rlike(_any_of(DESSERTS)), "Dessert")
            .when(x.rlike(_any_of(COMBOS)), "Combo")
            .otherwise(ICE_CREAM)
        )

    return _let(F.lower(name), told)


def _whole_name(all_of: tuple[str, ...], none_of: tuple[str, ...], whole: str) -> Callable[[Column], Column]:
    def put(x: Column) -> Column:
        fits = F.lit(True)
        for w in all_of:
            fits = fits & F.contains(x, F.lit(w))
        for w in none_of:
            fits = fits & ~F.contains(x, F.lit(w))
        return F.when(fits, whole).otherwise(x)

    return put


def normal_name(name: Column) -> Column:
    """Places of brackets and of alcohol, endings and spaces."""
    name = F.regexp_replace(name, r"(?U)(?i)\s*\(eggless\)\s*", " Eggless ")
    name = _let(name, lambda x: F.when(F.contains(x, F.lit("Boston Cream Pie")), F.regexp_replace(x, r"(?U)\s*Dessert$", "")).otherwise(x))
    front, behind = F.lit("(Contains Alcohol) Ice Cream"), F.lit("Ice Cream (Contains Alcohol)")
    name = F.replace(F.replace(name, front, behind), behind, front)
    for rule in WHOLE_NAMES:
        name = _let(name, _whole_name(*rule))
    return _stripped(_rewritten(name, ENDINGS))


def clean_item(raw: Column) -> Column:
    """struct<name, type, variant> of a raw name; null for null."""

    def by_rule(b: Column) -> Column:
        """b: struct<name, rule>."""
        name = b["name"]
        for k, (_, _, out) in enumerate(VARIANTS):
            if out:
                name = F.when(b["rule"] == k, _rewritten(b["name"], [(p, "") for p in out])).otherwise(name)
        variant = F.element_at(F.array(*[F.lit(v) for _, v, _ in VARIANTS]), b["rule"] + 1)
        return F.struct(_stripped(name).alias("name"), variant.alias("variant"))

    def typed(b: Column) -> Column:
        return F.struct(normal_name(b["name"]).alias("name"), type_of(b["name"]).alias("type"), b["variant"].alias("variant"))

    def told(b: Column) -> Column:
        combo = F.lit(None).cast("string")
        for words, variant in reversed(COMBO_VARIANTS):
            combo = F.when(F.contains(b["name"], F.lit(words)), variant).otherwise(combo)
        variant = F.when(b["type"] == "Drinks", "1_PIECE").when((b["type"] == "Combo") & (b["variant"] == "1_PIECE"), F.coalesce(combo, b["variant"])).otherwise(b["variant"])
        return F.struct(b["name"].alias("name"), b["type"].alias("type"), variant.alias("variant"))

    spelled = _let(_rewritten(raw, SPELLINGS), lambda x: F.struct(x.alias("name"), _first_rule(x).alias("rule")))
    cleaned = _let(_let(_let(spelled, by_rule), typed), told)
    return F.when(raw.isNotNull(), cleaned)


def suggested_variant(raw: Column, item_type: Column | None = None, clean: Column | None = None) -> Column:
    """struct<variant_id, variant_name> for an open item: the size that cleaning finds, else, for ice cream,
    one that the name still tells; null without either."""

    def told(c: Column) -> Column:
        lower = F.lower(raw)
        kind = F.lower(F.trim(F.coalesce(item_type, c["type"]) if item_type is not None else c["type"]))
        size = F.lit(None).cast("string")
        for pattern, variant in reversed(SUGGESTIONS):
            size = F.when(lower.rlike(f"(?U){pattern}"), variant).otherwise(size)
        ice = (kind == "ice cream") | F.contains(lower, F.lit("ice cream"))
        return F.when(c["variant"] != "1_PIECE", c["variant"]).when(ice, size)

    name = _let(clean if clean is not None else clean_item(raw), told)
    suggestion = _let(name, lambda v: F.when(v.isNotNull(), F.struct(uuid5(NAMESPACE, v).alias("variant_id"), v.alias("variant_name"))))
    return F.when(F.coalesce(raw, F.lit("")) != "", suggestion)


def clean_names(rows: DataFrame, raw: str) -> DataFrame:
    """``raw`` and ``clean`` of every distinct raw name of ``rows``: names repeat in sales by the million, so each
    is cleaned once and joined back."""
    return rows.select(raw).filter(F.col(raw).isNotNull()).distinct().withColumn("clean", clean_item(F.col(raw)))


def size_mismatches(raw: Column, variant: Column) -> Column:
    """The sizes and forms in a raw name that its variant does not bear out, joined by commas; empty where
    all fit or either is null."""
    low, high = F.lower(raw), F.upper(variant)
    wrong = lambda must, never: ~high.rlike(must) if never is None else ~high.rlike(must) | high.rlike(never)
    return F.concat_ws(", ", *[F.when(low.rlike(told) & wrong(must, never), shown) for told, shown, must, never in TOLD_SIZES])
