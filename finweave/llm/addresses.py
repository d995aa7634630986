"""Which address records denote the same place, however they are written."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave.llm.spelling import distance, fold, key, neighbourhood, plain
from finweave.operators.components import connected_components, pairs_within
from finweave.session import attach, materialize

# Street types that stand after the name, before it, at the end of it, and those that do either.
AFTER = {"street": "street st str", "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv", "way": "way", "crescent": "crescent cres", "terrace": "terrace", "close": "close", "court": "court ct"}
BEFORE = {
    "calle": "calle cl c/", "paseo": "paseo po pº ps", "plaza": "plaza pza pz", "avenida": "avenida avda", "rue": "rue r", "chemin": "chemin ch chem che", "via": "via", "viale": "viale", "piazza": "piazza", "corso": "corso",
    "largo": "largo", "rua": "rua", "quai": "quai",
}
JOINED = {"strasse": "strasse str", "weg": "weg wg", "platz": "platz pl", "allee": "allee al", "gasse": "gasse", "straat": "straat", "laan": "laan"}
EITHER = {"avenue": "avenue ave av aven", "boulevard": "boulevard blvd boul bd bvd", "square": "square place pl plz"}
#: Types that one abbreviation can mean, by the style of the address.
SAME = {"avenida": "avenue", "viale": "avenue", "plaza": "square", "piazza": "square", "platz": "square", "strasse": "street", "straat": "street"}
# Names of countries, and codes of countries, which count only at either end of a part.
COUNTRIES = "united kingdom|great britain|u\\.k\\.|england|deutschland|germany|allemagne|alemania|españa|espana|spain|spanien|france|frankreich|francia|italia|italy|italien|portugal|nederland|netherlands"
COUNTRY_CODES = "uk|gb|de|es|fr|it|nl|pt"
# Small words in names of streets and towns.
SMALL = set("a al am an auf au aux da dal de del della delle den der des di do dos du el em im in la las le les lo los na of on sous sub sur the under upon und y zu zum zur".split())
# Parts inside a building, and lines that name a recipient or a house.
INSIDE = [
    r"\b(?:flat|flt|apartment|apt|unit|suite|whg|wohnung|hinterhaus|vorderhaus|piso|pta|puerta|appt|app|appartement|b[aâ]t|batiment|esc|escalera)\b\.?\s*(?:\d{1,3}[a-z]?\b|[a-z]\b(?!\s*/))",
    r"\b\d{1,2}\s*º\s*[a-z]\b", r"\b\d{1,2}(?:e|er|[eè]me)\s+[eé]tage\b", r"\b\d{1,2}\.?\s*(?:og|stock|etage)\b", r"\b(?:eg|rez-de-chauss[eé]e)\b",
]
CARE_OF = r"\b(?:c/\s*o|care of|z\.\s*hd\.|a/a)\b\.?\s+[^\W\d_]+\s+(?:agents?|family|office|familie|famille|familia)\b"
HOUSE = r"\b[^\W\d_]+\s+house\b"
NOT_TOWNS = {"unit", "flat", "apartment", "appt", "piso", "house", "hinterhaus", "etage", "family", "office", "agents", "puerta"}

_TYPE: dict[str, dict[str, str]] = {
    style: {w: k for k, v in table.items() for w in v.split()} for style, table in (("after", AFTER), ("before", BEFORE), ("either", EITHER), ("joined", JOINED))
}
_SUFFIX = sorted(((w, k) for k, v in JOINED.items() for w in v.split()), key=lambda x: -len(x[0]))
_UK = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?)\s?(\d[a-z]{2})\b")
_DIGITS = re.compile(r"\b(\d{2})\s?(\d{3})\b")
_COUNTRY = re.compile(rf"(?:^|(?<=[,;/\n\s]))(?:{plain(COUNTRIES)})(?=$|[,;/\n\s])|(?:^|(?<=[,;/\n]))\s*(?:{COUNTRY_CODES})(?=$|[,;/\n\s])|(?<=\s)(?:{COUNTRY_CODES})(?=\s*(?:$|[,;/\n]))")
_NUMBER = re.compile(r"(?:\b(?:no|nr|num)\b\.?\s*|n\s?[º°]\.?\s*|#\s*)?\b(\d{1,4}[a-z]?)\b")


@lru_cache(200_000)
def parse(text: str) -> tuple[str, str, str, str, str, str] | None:
    """House number, street type, street name, town, postal area, postcode ('' where missing), in canonical order; None without number or type.

    Names are sequences of words. The town is never written between the number and the street, so what stands there is the street's name; where street and
    town may stand side by side and no other part names a town, the word next to the type is the street and the rest the town.
    """
    s = text.lower().replace("ß", "ss").replace("°", "º")
    s = re.sub(r"(\d)\s*ª", r"\1º", s)
    s = re.sub(CARE_OF, " , ", s)
    s = re.sub(HOUSE, " , ", s)
    s = re.sub(r"\bc/(?!\s*o\b)", " calle ", s)
    s = re.sub(r"\bpº(?=\W)", " paseo ", s)
    for p in INSIDE:
        s = re.sub(p, " , ", s)
    s = re.sub(r"\bn\s?º\.?", " # ", s)
    area = code = ""
    if m := _UK.search(s):
        area, code, s = m[1], m[1] + m[2], s[: m.start()] + " , " + s[m.end() :]
    elif m := _DIGITS.search(s):
        area, code, s = m[1] + m[2][:1], m[1] + m[2], s[: m.start()] + " , " + s[m.end() :]
    s = plain(s.replace("º", " º "))
    s = _COUNTRY.sub(" , ", s)
    m = next((m for m in _NUMBER.finditer(s)), None)
    if not m:
        return None
    number = m[1]
    s = s[: m.start()] + " 0 " + s[m.end() :]
    parts = [re.findall(r"[^\W\d]+(?:'[^\W\d]+)*\.?|0", p) for p in re.split(r"[,;/\n]", s)]
    hits = [hit for n, p in enumerate(parts) for i in range(len(p)) for hit in _types(p, n, i)]
    for _, n, i, style, kind, cut in sorted(hits):
        p = parts[n]
        begin = max((j + 1 for j in range(i) if p[j] == "0"), default=0)
        end = next((j for j in range(i + 1, len(p)) if p[j] == "0"), len(p))
        back, ahead = range(begin, i), range(i + 1, end)
        if style == "joined":
            side, near = [*back, i], i
        else:
            number_next = len(ahead) == 1 and end < len(p)
            apart = bool(back) and bool(ahead) and "0" not in p and n + 1 < len(parts) and parts[n + 1][:1] == ["0"]
            first = style == "before" or style == "either" and (not back or number_next or apart)
            side = list(ahead if first else back)
            near = next((j for j in side if p[j].rstrip(".") not in SMALL), None) if first else i - 1
            if not side or near is None:
                continue
        word = (lambda j: p[j].rstrip(".")[:-cut] if style == "joined" and j == i else p[j].rstrip("."))
        if len(word(near)) < 2:
            continue
        # groups of words that may name the town: what is left of each part, cut at the number and the street
        groups: list[list[str]] = []
        for k, q in enumerate(parts):
            run: list[str] = []
            for j, t in enumerate([*q, "0"]):
                if t == "0" or k == n and (j == i or j in side):
                    groups.append(run)
                    run = []
                else:
                    run.append(t.rstrip("."))
        groups = [g for g in groups if any(len(t) > 3 and t not in NOT_TOWNS for t in g)]
        bounded = (begin > 0 and side[0] == begin and near == i - 1 if style != "joined" else begin > 0) or (side[0] == i + 1 and end < len(p) and style != "joined")
        if groups or bounded:
            street, town = [word(j) for j in side], max(groups, key=lambda g: max(len(t) for t in g if t not in NOT_TOWNS), default=[])
        else:
            street, town = [word(near)], [word(j) for j in side if j != near and (j > near or near >= i - 1)]
        street = [t for t in (re.sub(r"^[dl]'", "", t) for t in street) if t not in SMALL] or street
        town = [t for t in town if t not in NOT_TOWNS]
        if not any(len(t) > 3 for t in town):
            town = []
        return number, SAME.get(kind, kind), " ".join(street), " ".join(town), area, code
    return None


def _types(p: list[str], n: int, i: int) -> Iterator[tuple[int, int, int, str, str, int]]:
    """What street types token ``i`` of part ``n`` may stand for; full words rank before abbreviations, endings last."""
    t = p[i].rstrip(".")
    for style in ("before", "after", "either", "joined"):
        if (kind := _TYPE[style].get(t)) and len(p) > 1 and not (style == "joined" and t in _TYPE["either"]):
            rank = 0 if len(t) >= 4 or t == "rue" else 3 if t in SMALL and not p[i].endswith(".") else 2
            yield rank, n, i, "after" if style == "joined" else style, kind, 0
    for ending, kind in _SUFFIX:
        if t.endswith(ending) and len(t) > len(ending) + 3:
            full, point, numbered = len(ending) > 2 and ending != "str", p[i].endswith("."), i + 1 < len(p) and p[i + 1] == "0"
            if full and (numbered or "0" in p or len(p) == 1) or point or numbered:
                yield (1 if full else 2 if point else 4), n, i, "joined", kind, len(ending)


def parsed(entities: DataFrame) -> DataFrame:
    """entity_id with the parts of its address; where they can't be told, ``street`` holds the whole folded text and ``number`` is null."""
    schema = "entity_id string, number string, kind string, street string, town string, area string, code string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(parse(text) or (None, None, " ".join(re.findall(r"\w+", plain(text))), None, None, None))
            columns = [pa.array([x or None for x in c], pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.replace(" string", "").split(", "))

    return entities.where("entity_id is not null and trim(address) <> ''").select("entity_id", "address").mapInArrow(run, schema)


def _close(a: str, b: str, most: int) -> bool:
    return distance(a, b, most) <= most or distance(fold(a), fold(b), most) <= most


def _edits(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 0 if n <= 2 else 1 if n <= 6 else 2


def main_words(name: str) -> list[str]:
    ws = name.split()
    return [w for w in ws if w not in SMALL] or ws


@lru_cache(300_000)
def alike_street(a: str, b: str) -> bool:
    """Whether two street names differ by typos and spaces at most: word by word, short words exactly."""
    if a == b:
        return True
    x, y = main_words(a), main_words(b)
    if len(x) == len(y):
        return all(_close(u, v, 0 if max(len(u), len(v)) <= 3 and len(x) > 1 else _edits(u, v)) for u, v in zip(x, y))
    return _close("".join(x), "".join(y), 1)


@lru_cache(300_000)
def alike_town(a: str, b: str, times: int = 1) -> bool:
    """Whether two town names differ by typos, spaces, small words or a second part left out; ``times`` as many typos are allowed."""
    if a == b:
        return True
    x, y = main_words(a), main_words(b)
    same = [_close(u, v, times * _edits(u, v)) for u, v in zip(x, y)]
    if all(same):
        return True
    if len(x) == len(y) and same[0]:  # of one first name, but another second
        return False
    return len(x) + len(y) > 2 and any(_close(u, v, 2 * times) for u, v in (("".join(x), "".join(y)), ("".join(a.split()), "".join(b.split()))))


@F.pandas_udf(T.BooleanType())
def near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and alike_town(x, y) for x, y in zip(a, b)], dtype="boolean")


def settle_towns(rows: DataFrame) -> DataFrame:
    """Where a town is a misspelling of the one that most places of its postal area are in, that one; other columns unchanged.

    Distinct places count, so an address that many rows hold counts once. The counts cover all addresses; the table is joined as a dimension of checked size.
    """
    places = rows.where("area is not null and town is not null").groupBy("area", "town", "number", "kind", "street").agg(F.count(F.lit(1)).alias("rows"))
    counts = places.groupBy("area", "town").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    usual = materialize(counts.groupBy("area").agg(F.max(F.struct("n", "rows", "town")).alias("top")).select("area", F.col("top.town").alias("usual")), "address-towns")
    return attach(rows, usual, ["area"]).withColumn("town", F.when(near("town", "usual"), F.col("usual")).otherwise(F.col("town"))).drop("usual")


def _neighbours(df: DataFrame, name: str, texts: str) -> DataFrame:
    """Add the column ``keys``: the members of the deletion neighbourhoods of an array of texts, as numbers."""

    @F.pandas_udf("array<bigint>")
    def members(column: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(key(m) for x in xs for m in neighbourhood(fold(x)))) for xs in column], dtype=object)

    return df.withColumn(name, members(texts))


def alike_towns(towns: DataFrame) -> DataFrame:
    """Each distinct town with all towns written like it, itself too: town, others. Variants of a name are few, so the arrays are short."""

    @F.pandas_udf("array<string>")
    def spelled(column: pd.Series) -> pd.Series:
        return pd.Series([list({main_words(x)[0], "".join(main_words(x)), "".join(x.split())}) for x in column], dtype=object)

    index = _neighbours(towns.withColumn("texts", spelled("town")), "keys", "texts").select("town", F.explode("keys").alias("k"))
    met = index.join(index.withColumnRenamed("town", "other"), "k").select("town", "other").distinct()
    return met.where((F.col("town") == F.col("other")) | near("town", "other")).groupBy("town").agg(F.collect_set("other").alias("others"))


def place_links(places: DataFrame) -> DataFrame:
    """Pairs of distinct places (pid, number, kind, street, town, area, code) that are one: a < b.

    Keys are hierarchical. Where both sides have a postcode, it is the first level, and it must be the same: a house has one. Where a side has none, the first level
    is the town, met by all spellings alike. Number, type and a member of the street's deletion neighbourhood follow, so places meet only within one postcode or town.
    Missing components: a place without town but with a postcode may be in any town written in its postal area, and joins the place without postcode that it finds
    in one of them, but none if it finds places in several towns. A place without number (unparsed), or without both town and postcode, matches only its own copies.
    """
    full = _neighbours(places.where("number is not null and (town is not null or code is not null)").withColumn("texts", F.array(F.regexp_replace("street", " ", ""))), "keys", "texts").drop("texts")
    full = materialize(full, "address-index")
    at = lambda df, level: df.select("pid", F.explode("keys").alias("m"), "number", "kind", level).select("pid", F.xxhash64(level, "number", "kind", "m").alias("k"))
    by_code = at(full.where("code is not null"), F.col("code"))
    pairs = by_code.withColumnRenamed("pid", "a").join(by_code.withColumnRenamed("pid", "b"), "k").where("a < b").select("a", "b")
    towns = materialize(alike_towns(full.where("town is not null").select("town").distinct()), "address-alike")
    in_area = full.where("town is not null and area is not null").groupBy("area").agg(F.collect_set("town").alias("written"))  # the towns of a postal area
    open_ = attach(full.where("town is null"), materialize(in_area, "address-areas"), ["area"], "inner").withColumn("town", F.explode("written"))
    bare = attach(full.where("town is not null and code is null"), towns, ["town"], "inner").withColumn("town", F.explode("others"))
    met = at(bare, F.col("town")).withColumnRenamed("pid", "a").join(at(full.where("town is not null").select("pid", "keys", "number", "kind", "town").unionByName(open_.select("pid", "keys", "number", "kind", "town")), F.col("town")).withColumnRenamed("pid", "b"), "k")
    pairs = pairs.union(met.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    side = lambda x: full.select(F.col("pid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("number", "kind", "street", "town", "code")))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("number_a = number_b and kind_a = kind_b and (code_a is null or code_b is null or code_a = code_b)")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, unsure, town = [], [], []
            for i, j, sa, sb, ta, tb, ca, cb in zip(*(c.to_pylist() for c in batch.columns)):
                ok = alike_street(sa, sb)
                if ca and cb:  # both towns of one postcode may be misspelled
                    ok, ask = ok and (not ta or not tb or alike_town(ta, tb, 2)), None
                elif ta and tb:
                    ok, ask = ok and alike_town(ta, tb), None
                else:
                    ask = (j, ta) if ta else (i, tb)
                keep.append(ok)
                unsure.append(ask[0] if ask else None)
                town.append(ask[1] if ask else None)
            columns = [batch.column(0), batch.column(1), pa.array(unsure, pa.binary()), pa.array(town, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "unsure", "town"]).filter(pa.array(keep, pa.bool_()))

    out = met.select("a", "b", "street_a", "street_b", "town_a", "town_b", "code_a", "code_b").mapInArrow(verify, "a binary, b binary, unsure binary, town string")
    out = materialize(out, "address-met")
    asked = out.where("unsure is not null")
    one = asked.groupBy("unsure").agg(F.min("town").alias("x"), F.max("town").alias("y"))
    settled = asked.join(one.where(near("x", "y")).select("unsure"), "unsure", "left_semi").select("a", "b")
    return out.where("unsure is null").select("a", "b").unionByName(settled)


def place_classes(entities: DataFrame) -> DataFrame:
    """Each row with an address and the class of its place: entity_id, place.

    Copies are compacted before places are compared, so an address that a third of all rows hold is compared once.
    Rows with a null id or an empty address have no place.
    """
    parts = ("number", "kind", "street", "town", "code")
    number = F.unhex(F.md5(F.to_json(F.struct(*parts)))).alias("pid")  # 128 bits
    rows = materialize(settle_towns(materialize(parsed(entities), "address-parts")).select("entity_id", *parts, "area", number), "address-places")
    groups = connected_components(materialize(place_links(rows.select("pid", *parts, "area").distinct()), "address-links"))
    return rows.select("entity_id", "pid").join(groups.withColumnRenamed("node", "pid"), "pid", "left").select("entity_id", F.hex(F.coalesce("component", "pid")).alias("place")).distinct()


def same_place(entities: DataFrame) -> DataFrame:
    """All pairs of rows at one place: entity_id_a < entity_id_b."""
    return pairs_within(materialize(place_classes(entities), "address-classes"), "place", "entity_id")
