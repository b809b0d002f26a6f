"""Personal data replaced by keyed surrogates, in DataFrame and SQL functions alone.

Entities (e-mail addresses, phone and card numbers, account numbers, IP addresses, secrets, names
after a title or a phrase that introduces one) are found by one pattern. An entity has one or two
parts: an address its local part and its domain, a name its given and its family names, each half of
a hyphenated name for itself. Each distinct part, in normal form, gets one surrogate from a keyed hash, in all documents, spellings and titles,
so "Frau Erika Muster", "Dr Muster" and "Erika Muster" stay one person and colleagues stay at one
domain. Characters keep their class (letter case, digit, punctuation), IP parts stay valid, card
numbers keep their first digit and get a valid check digit where they had one; names are made of
syllables of the name's script, given names with an ending of the gender that its titles tell.
Domains that many people share stay. Parts that would share a surrogate, or take one that the corpus
holds as such a part, draw again with the next counter until all are distinct.

In a document with a found name, the same given and family names are replaced wherever else they
stand as capitalised words, also in capitals throughout: in a run of capitalised words all but the
last are taken for given names first, the last and lone words for family names first. A word that
the text also has in lower case is replaced only beside another found name. A place or month of the
same spelling and case can't be told from the person and is replaced too. Names that no title or
phrase introduces anywhere in the document are out of reach.

Only documents with entities are shuffled. Defined cases: null text stays null; texts without
entities stay as they are; repeated rows are replaced alike; empty tables work; other columns pass
unchanged; should the surrogates of a kind run out (say more three-digit numbers than there are), an
error is raised and nothing is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.llm.common import set_aside
from comanda.session import written

#: A word of a name: no apostrophe but before a further capital, so "O'Brien" and "Smith's" end right.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]+(?:['’]\p{Lu}[\p{L}\p{M}]+)*|['’]\p{Lu}[\p{L}\p{M}]+)"
#: Particles that stand between given and family names, and stay.
PARTICLES = r"(?:(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|zu|zum|zur|af)[ ])"
NAME = rf"{WORD}(?:-{WORD})*+(?:[ ]{PARTICLES}{{0,3}}{WORD}(?:-{WORD})*+)?"
#: Patterns by type, in order of preference.
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key))\s*[=:]\s*[\"']?[A-Za-z0-9_/+-]{8,}",
    "account": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d\p{L}])\d(?:[ -]?\d){12,18}(?![\d\p{L}])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}\b|\b\d{3}[.-]\d{3,4}[.-]\d{4}\b",
    "social": r"\b\d{3}-\d{2}-\d{4}\b",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Señora?|Sra?|[Гг]осподин|[Гг]оспожа|[Гг]-н|[Гг]-жа)\.?[ ])++|(?:[Mm]y name is|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Мм]еня зовут)[ ]){NAME}",
}
#: Titles by gender, syllables by script, endings of given names, domains of many people.
MALE, FEMALE = r"(?iu)^(?:.*[ ])?(?:Mr|Herrn?|Señor|Sr|господин|г-н)\.?[ ]", r"(?iu)^(?:.*[ ])?(?:Mrs|Ms|Miss|Frau|Mme|Señora|Sra|госпожа|г-жа)\.?[ ]"
SYLLABLES = {
    "latin": ("ba", "be", "bri", "ca", "cor", "da", "del", "do", "fa", "fe", "gal", "go", "ha", "hel", "ja", "jo", "ka", "kel", "la", "li", "lo", "ma", "mel", "mo", "na", "nor", "pa", "per", "ra", "ro", "sa", "sel", "ta", "tor", "va", "vel", "wa", "wen", "za", "zo"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "го", "да", "де", "за", "зо", "ка", "ко", "ла", "ли", "ма", "ми", "на", "не", "па", "по", "ра", "ро", "са", "се", "та", "те", "фа", "фе"),
}
ENDINGS = {("male", "latin"): "n", ("female", "latin"): "ra", ("any", "latin"): "li", ("male", "cyrillic"): "н", ("female", "cyrillic"): "на", ("any", "cyrillic"): "ли"}
SHARED_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "gmx.de", "web.de", "mail.ru", "example.com", "example.org", "example.net")
#: Pieces of text between entities: runs of capitalised words, other words, and what is no word.
UPPER_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:['’]\p{Lu}[\p{L}\p{M}]+)*(?![\p{L}\p{M}\p{N}])"
RUN = rf"{UPPER_WORD}(?:[ -]{UPPER_WORD})*|[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+"
#: Inside a word no pattern begins (but for digits and signs), so most places are passed over at once.
ANY = r"(?:(?<![\p{L}\p{N}])|\G|(?=[(+\d]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Draws before the surrogates of a kind are taken to have run out.
DRAWS = 40
LOWER = "abcdefghijklmnopqrstuvwxyz"


def type_of(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def prefix_of(entity: Column, kind: Column) -> Column:
    """What stays in front: the word before a secret, the title or phrase before a name."""
    secret = F.regexp_extract(entity, r"^(\w+(?:[_-]\w+)?\s*[=:]\s*[\"']?)", 1)
    title = F.regexp_extract(entity, rf"^((?:\S+\.?[ ])*?(?:(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Señora?|Sra?|[Гг]осподин|[Гг]оспожа|[Гг]-н|[Гг]-жа)\.?[ ])*+){NAME}$", 1)
    return F.when(kind == "secret", secret).when(kind == "name", title).otherwise("")


def normal_form(value: Column, kind: Column) -> Column:
    """Spellings of one entity are equal: case of addresses, punctuation of numbers."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card", "social"), digits).when(kind == "account", F.regexp_replace(value, " ", "")).otherwise(value)


def name_form(word: Column) -> Column:
    """A name's word without case and with one kind of apostrophe."""
    return F.lower(F.translate(word, "’", "'"))


def parts_of(surface: Column, kind: Column, gender: Column) -> Column:
    """array<struct<kind, norm, surface, gender, after>>: the parts that get a surrogate each, and
    what stands behind each."""

    def part(k: Column, norm: Column, of: Column, after: Column) -> Column:
        return F.struct(k.alias("kind"), norm.alias("norm"), of.alias("surface"), gender.alias("gender"), after.alias("after"))

    local, domain = F.substring_index(surface, "@", 1), F.substring_index(surface, "@", -1)
    email = F.array(part(F.lit("email"), F.lower(surface), local, F.lit("@")), part(F.lit("domain"), F.lower(domain), domain, F.lit("")))
    words = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    gaps = F.split(surface, WORD, -1)
    n_given = F.when(F.instr(surface, " ") > 0, F.size(words(F.substring_index(surface, " ", 1)))).otherwise(0)
    names = F.transform(words(surface), lambda w, i: part(F.when(i < n_given, "given").otherwise("family"), name_form(w), w, F.get(gaps, i + 1)))
    one = F.array(part(kind, normal_form(surface, kind), surface, F.lit("")))
    return F.when(kind == "email", email).when(kind == "name", names).otherwise(one)


def _drawn(seed: Column, i: Column, below: int) -> Column:
    """A number below ``below`` from the i-th pair of hex digits of the seed, which is hashed anew
    every 32 characters."""
    wide = F.sha2(F.concat(seed, F.floor(i / 32).cast("string")), 256)
    return F.pmod(F.conv(F.substr(wide, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(below))


def _shaped(text: Column, seed: Column) -> Column:
    """Each letter and digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        letter = F.substr(F.lit(LOWER), _drawn(seed, i, 26) + 1, F.lit(1))
        hex_letter = F.substr(F.lit("abcdef"), _drawn(seed, i, 6) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), _drawn(seed, i, 10).cast("string")).when(c.rlike("[a-f]"), hex_letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn terms when one more digit follows ``digits``."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    terms = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _syllables(script: str, seed: Column, n: Column) -> Column:
    names = SYLLABLES[script]
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, names)), _drawn(seed, i, len(names)) + 1)), "")


def surrogate(norm: Column, kind: Column, gender: Column, key: str, draw: Column) -> Column:
    """The keyed surrogate, in normal form, of the draw-th try. Later tries of names, secrets and
    addresses are longer, so they never run out."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, draw.cast("string")), 256)
    longer = F.when(draw > 3, F.concat(F.lit("x"), draw.cast("string"))).otherwise("")
    email = F.concat(_shaped(F.substring_index(norm, "@", 1), seed), longer)
    name, end = F.regexp_extract(norm, r"^(.*)\.[^.]*$", 1), F.regexp_extract(norm, r"(\.[^.]*)$", 1)
    domain = F.when(norm.isin(*SHARED_DOMAINS), norm).otherwise(F.concat(_shaped(name, seed), longer, end))
    numbers = F.concat(F.substr(norm, F.lit(1), F.lit(1)), _shaped(F.substr(norm, F.lit(2)), seed))
    body = F.substr(numbers, F.lit(1), F.length(numbers) - 1)
    check = F.pmod(10 - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string")
    valid = F.pmod(_luhn_sum(F.substr(norm, F.lit(1), F.length(norm) - 1)) + F.substr(norm, F.length(norm)).cast("int"), F.lit(10)) == 0
    card = F.when(valid, F.concat(body, check)).otherwise(numbers)
    ip = F.array_join(F.transform(F.split(norm, r"\."), lambda c, i: (_drawn(seed, i, 223) + 1).cast("string")), ".")
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    n = F.lit(2) + F.floor(draw / 2).cast("int")
    syllables = F.when(script == "cyrillic", _syllables("cyrillic", seed, n)).otherwise(_syllables("latin", seed, n))
    ending = F.lit("")
    for (g, s), e in ENDINGS.items():
        ending = F.when((kind == "given") & (gender == g) & (script == s), e).otherwise(ending)
    shaped = F.concat(_shaped(norm, seed), F.when(kind == "secret", longer).otherwise(""))
    return F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "card", card).when(kind == "ip", ip).when(kind.isin("given", "family"), F.concat(syllables, ending)).when(kind.isin("phone", "social"), numbers).otherwise(shaped)


def rendered(drawn: Column, surface: Column, kind: Column) -> Column:
    """The surrogate in the part's spelling: digits fill the places of digits, case follows."""
    places = F.split(surface, "[0-9]")
    filled = F.array_join(F.transform(places, lambda p, i: F.concat(p, F.coalesce(F.substr(drawn, i + 1, F.lit(1)), F.lit("")))), "")
    upper = (surface == F.upper(surface)) & (surface != F.lower(surface))
    cased = F.when(kind.isin("email", "domain", "given", "family") & upper, F.upper(drawn)).when(kind.isin("given", "family"), F.initcap(drawn)).otherwise(drawn)
    return F.when(kind.isin("phone", "card", "social"), filled).otherwise(cased)


def gender_of(prefix: Column) -> Column:
    return F.when(prefix.rlike(MALE), "male").when(prefix.rlike(FEMALE), "female").otherwise("any")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, drawn) of the distinct ``entities(kind, gender, norm)``; drawn differs from every
    other drawn value and from every entity of its kind.

    A part's gender is the one that all its titles tell, else "any". Each round draws for what is
    left; of those that meet, the least keeps the value.
    """
    told = F.array_distinct(F.filter(F.collect_set("gender"), lambda g: g != "any"))
    left = entities.groupBy("kind", "norm").agg(told.alias("told")).select("kind", "norm", F.when(F.size("told") == 1, F.col("told")[0]).otherwise("any").alias("gender"))
    left = written(left, "entities")
    # addresses are told apart by their local parts, and domains of many people stay as they are
    held = F.when(F.col("kind") == "email", F.substring_index("norm", "@", 1)).otherwise(F.col("norm"))
    known = left.filter(~((F.col("kind") == "domain") & F.col("norm").isin(*SHARED_DOMAINS))).select("kind", held.alias("value")).distinct()
    done: list[DataFrame] = []
    for draw in range(DRAWS):
        tried = left.withColumn("drawn", surrogate(F.col("norm"), F.col("kind"), F.col("gender"), key, F.lit(draw)))
        taken = reduce(DataFrame.unionByName, [known, *[d.select("kind", F.col("drawn").alias("value")) for d in done]])
        free = tried.join(taken, (tried["kind"] == taken["kind"]) & (tried["drawn"] == taken["value"]), "left_anti")
        won = free.groupBy("kind", "drawn").agg(F.min("norm").alias("norm"))
        done.append(written(won, "surrogates"))
        left = written(left.join(done[-1], ["kind", "norm"], "left_anti"), "entities")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"{DRAWS} draws did not give distinct surrogates: there are as many entities as values of their form")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its texts' entities replaced under the secret ``key``."""
    rows, restored = set_aside(docs, ("doc_id", "text"))
    return restored(_replaced(rows, key))


def _without_names(gap: Column, names: Column, common: Column) -> Column:
    """``gap`` with the words replaced that ``names`` (map of kind:norm to surrogate) holds, in one
    pass. Words of ``common`` (array of norms) are replaced only beside another name."""
    runs = F.regexp_extract_all(gap, F.lit(RUN), F.lit(0))

    def drawn(word: Column, last: Column) -> Column:
        given, family = (F.try_element_at(names, F.concat(F.lit(f"{k}:"), name_form(word))) for k in ("given", "family"))
        return F.when(last, F.coalesce(family, given)).otherwise(F.coalesce(given, family))

    def told(run: Column) -> Column:
        words = F.split(run, "[ -]")
        signs = F.split(run, "[^ -]+", -1)
        found = F.transform(words, lambda w, i: drawn(w, i == F.size(words) - 1))
        several = F.size(F.filter(found, lambda x: x.isNotNull())) > 1

        def one(w: Column, x: Column) -> Column:
            cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(x)).otherwise(F.initcap(x))
            return F.when(x.isNotNull() & (several | ~F.array_contains(common, name_form(w))), cased).otherwise(w)

        put = F.zip_with(words, found, one)
        return F.concat(put[0], F.array_join(F.transform(F.slice(put, 2, F.size(put)), lambda w, i: F.concat(F.get(signs, i + 1), w)), ""))

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^{UPPER_WORD}"), told(r)).otherwise(r)), "")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced entities, and ``_entities``: how many its pattern found in each text."""
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    hit = written(docs.filter(has).withColumn("_hash", F.xxhash64("text")).withColumn("_matches", matches), "with-entities")
    rest = docs.filter(~has).withColumn("_entities", F.lit(0).cast("long"))
    found = hit.select(F.explode("_matches").alias("entity")).distinct()
    kind, prefix = type_of(F.col("entity")), prefix_of(F.col("entity"), F.col("kind"))
    found = found.withColumn("kind", kind).withColumn("prefix", prefix).withColumn("surface", F.substr("entity", F.length("prefix") + 1))
    parts = parts_of(F.col("surface"), F.col("kind"), gender_of(F.col("prefix")))
    found = written(found.select("entity", "prefix", F.posexplode(parts).alias("at", "part")).select("entity", "prefix", "at", "part.*"), "found")
    drawn = surrogates(found.select("kind", "gender", "norm"), key)
    put = rendered(F.col("drawn"), F.col("surface"), F.col("kind"))
    each = found.join(drawn, ["kind", "norm"]).select("entity", "prefix", F.struct("at", "kind", "norm", "drawn", "after", put.alias("put")).alias("p"))
    by_entity = each.groupBy("entity", "prefix").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the few parts of one entity
    whole = F.concat("prefix", F.array_join(F.transform("ps", lambda p: F.concat(p["put"], p["after"])), ""))
    names = F.transform(F.filter("ps", lambda p: p["kind"].isin("given", "family")), lambda p: F.struct(F.concat_ws(":", p["kind"], p["norm"]).alias("key"), p["drawn"].alias("value")))
    table = written(by_entity.select("entity", whole.alias("put"), names.alias("names")), "replacements")
    # a match's place leads to its surrogate, so long texts need no look-up in a map
    places = hit.select("doc_id", "_hash", F.posexplode("_matches").alias("_at", "entity"))
    per_doc = places.join(table, "entity").groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_set(F.struct("_at", "put"))).alias("_put"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("_names"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_put", F.map_from_entries("_names").alias("_names"))
    joined = hit.join(per_doc, hit["doc_id"].eqNullSafe(per_doc["_id"]) & (hit["_hash"] == per_doc["_h"]))
    gaps = F.split("text", ANY, -1)
    # a kind and normal form has one surrogate, so no key of the map stands twice
    forms = F.transform(F.map_keys("_names"), lambda k: F.substring_index(k, ":", -1))
    lower = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*"), F.lit(0))
    joined = joined.withColumn("_common", F.when(F.size("_names") > 0, F.array_intersect(forms, F.transform(lower, name_form))))
    gaps = F.when(F.size("_names") > 0, F.transform(gaps, lambda g: _without_names(g, F.col("_names"), F.col("_common")))).otherwise(gaps)
    # zip_with takes the gaps once a row; a look-up in a lambda would split the text at every match
    joined = joined.withColumn("_gaps", gaps)
    text = F.concat(F.col("_gaps")[0], F.array_join(F.zip_with("_put", F.slice("_gaps", 2, F.size("_matches")), lambda p, gap: F.concat(p["put"], gap)), ""))
    made = joined.withColumn("text", text).withColumn("_entities", F.size("_matches").cast("long"))
    return made.select(*[made[c] for c in docs.columns], "_entities").unionByName(rest)


def judged(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every row."""
    return _replaced(docs.select("doc_id", "text"), key).select("doc_id", "text", F.col("_entities").alias("n_entities"))
