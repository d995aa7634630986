"""Amounts in many units: spellings are resolved once in a dictionary, then joined to all rows."""

from __future__ import annotations

import unicodedata
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finweave.constants import CURRENCIES
from finweave.session import attach, materialize

# Names of currencies, which say nothing about the scale, and of their smallest parts.
NAMES = {
    "USD": ["US Dollar", "US$", "U.S. dollars"],
    "EUR": ["Euro", "euros", "€"],
    "GBP": ["Pound Sterling", "pounds stg", "STG", "£"],
    "CHF": ["Swiss Franc", "SFr.", "Fr. (CH)"],
    "JPY": ["Japanese yen", "Yen", "¥"],
    "KWD": ["Kuwaiti dinar", "K.D."],
    "SEK": ["Swedish krona"],
    "PLN": ["Polish zloty", "zloty", "zł"],
    "INR": ["Indian rupee", "Rs. (IN)", "₹"],
    "AED": ["UAE dirham", "Dhs. (AE)"],
    "MXN": ["Mexican peso", "Mex$"],
    "KRW": ["Korean won", "₩"],
    "BHD": ["Bahraini dinar", "B.D."],
    "ZAR": ["S.A. rand", "Rand"],
}
PARTS = {
    "USD": ["US cents", "USD cents", "USc"],
    "EUR": ["Eurocent", "euro cents", "EUR ct"],
    "GBP": ["GBP pence", "pence stg", "GBX", "GBp"],
    "CHF": ["CHF Rappen", "Rp. (CHF)"],
    "KWD": ["KWD fils", "fils (KWD)"],
    "SEK": ["SEK öre", "öre (SEK)"],
    "PLN": ["PLN grosz", "gr (PLN)"],
    "INR": ["INR paise", "paise"],
    "AED": ["AED fils", "fils (AED)"],
    "MXN": ["MXN centavos"],
    "BHD": ["BHD fils", "fils (BHD)"],
    "ZAR": ["ZAR cents", "ZAc"],
}
# How a scale is written around an ISO code.
SCALED = {
    "k": ["k{}", "T{}", "{}k", "{} k", "{} thsd", "{} '000", "{} 000s", "{} (thousands)", "{} thousands", "{} thousand", "thousand {}", "milliers de {}", "miles de {}", "Tsd. {}"],
    "m": ["m{}", "MM {}", "{}m", "{} mn", "mn {}", "{} Mio", "{} millions", "{} million", "million {}", "millones de {}", "millions de {}", "Mio. {}"],
    "minor": ["minor units ({})"],
    "major": ["whole {}", "full {} units", "vollen {}", "unidades enteras de {}", "unités entières de {}"],
}
# Currencies that no unit stands for here, by name, so that their names aren't taken for misspellings; their codes are in CURRENCIES.
STRANGERS = {
    "CAD": "Canadian dollar", "AUD": "Australian dollar", "NZD": "New Zealand dollar", "HKD": "Hong Kong dollar", "SGD": "Singapore dollar", "NOK": "Norwegian krone", "DKK": "Danish krone", "SAR": "Saudi riyal", "QAR": "Qatari riyal",
    "OMR": "Omani rial", "JOD": "Jordanian dinar", "TND": "Tunisian dinar", "COP": "Colombian peso", "CLP": "Chilean peso", "PHP": "Philippine peso", "IDR": "Indonesian rupiah", "PKR": "Pakistani rupee", "MAD": "Moroccan dirham", "TRY": "Turkish lira",
    "RUB": "Russian ruble", "BRL": "Brazilian real", "CNY": "Chinese yuan", "PEN": "Peruvian sol", "RUR": "old Russian ruble",
}
# Words for a row's own amount, and words between them and its unit, in the languages of the feeds.
AMOUNT = "amounts?|figures?|values?|totals?|sums?|stated|expressed|recorded|montants?|valeurs?|importes?|cantidad|valor|betrag|beträge|wert|angabe|bedrag|importo"
LINK = "in|is|are|as|en|est|es|son|ist|sind|auf|em|è"
#: A clause that names the amount near its begin and then says what it is in; the rest up to the next mark may begin with a unit.
STATEMENT = rf"(?i)(?:^|;)\s*(?:\p{{L}}+\s+){{0,2}}?(?:{AMOUNT})(?:\s+\p{{L}}+){{0,2}}?\s+(?:{LINK})(?:(?:\s+\p{{L}}+)?\s+(?:in|en|em|auf))?\s+([^;,]+?)\s*(?:$|[;,]|\s-\s)"
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
#: A number with up to three words before and after it, by which a sum that is written out may have its unit.
SUM = rf"((?:[^\s;0-9]+\s+){{0,2}}(?:[^\s;0-9]+\s*)?)({NUMBER})(?![0-9/])((?:\p{{L}}+\b)?(?:\s+[^\s;0-9]+){{0,3}})"
#: Most words of a unit.
WORDS = 6

NEEDED = ["transaction_id", "amount", "currency", "source_system", "remittance_text", "created_at"]
FEED_SCALE = {"minor": "minor", "thousands": "k", "major": "major"}
#: A spelling is accepted up to the weighted distance for the length of its alias: up to 3, up to 7 and more characters. ISO codes allow no change of a letter.
DISTANCES, LENGTHS = (0.75, 1.0, 1.5), (3, 7)
GRAM = 2


def lexicon(spark: SparkSession, units: DataFrame) -> DataFrame:
    """All known spellings of currencies: alias, iso, scale (null: says nothing). Currencies without units are known too, so that they aren't mistaken for others."""
    codes = {r[0] for r in units.select("iso_currency").distinct().collect()} | {*CURRENCIES, *STRANGERS}  # a fixed table of some dozen rows
    rows: dict[str, tuple[str, str | None]] = {}
    for iso in sorted(codes):
        for scale, patterns in SCALED.items():
            for p in patterns:
                rows.setdefault(p.format(iso), (iso, scale))
        for name in [iso, iso.lower(), *NAMES.get(iso, []), *([STRANGERS[iso]] if iso in STRANGERS else [])]:
            rows[name] = (iso, None)
        for name in PARTS.get(iso, []):
            rows[name] = (iso, "minor")
    return spark.createDataFrame([(a, i, s) for a, (i, s) in rows.items()], "alias string, iso string, scale string")


def folded(text: Column) -> Column:
    """Letters, digits and currency signs in lower case without accents and marks: edits of other characters are cheap, so the index doesn't see them."""
    bare = F.translate(F.lower(text), "áàâäãåçéèêëíìîïñóòôöõøúùûüýłß", "aaaaaaceeeeiiiinoooooouuuuyls")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}\p{Sc}]+", "")


def grams(text: Column) -> Column:
    """Distinct character bigrams of the folded text with marked ends."""
    x = F.concat(F.lit("^"), folded(text), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (GRAM - 1)), lambda i: F.substring(x, i, GRAM)))


@lru_cache(100_000)
def weighted_distance(a: str, b: str, most: float = float("inf")) -> float:
    """Edit distance where case costs 0.25, marks and spaces 0.1, an accent 0.25 and other letters and digits 1; infinite beyond ``most``."""

    def weight(c: str) -> float:
        return 1.0 if c.isalnum() or unicodedata.category(c) == "Sc" else 0.1

    def swap(c: str, d: str) -> float:
        if c == d:
            return 0.0
        if c.lower() == d.lower():
            return 0.25
        if unicodedata.normalize("NFD", c)[0] == unicodedata.normalize("NFD", d)[0]:
            return 0.25
        return max(weight(c), weight(d))

    row = [0.0]
    for d in b:
        row.append(row[-1] + weight(d))
    for c in a:
        w, new = weight(c), [row[0] + weight(c)]
        for j, d in enumerate(b):
            new.append(min(row[j] + swap(c, d), row[j + 1] + w, new[j] + weight(d)))
        if min(new) > most:
            return float("inf")
        row = new
    return row[-1] if row[-1] <= most else float("inf")


def alias_dictionary(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """Map each distinct spelling to a unit: spelling, iso, scale, distance.

    Candidates come from an inverted index of bigrams. An edit of a folded letter touches at most GRAM + 1 bigrams on either side, and DISTANCES allow one such edit, so
    a fitting pair shares all but that many of the larger set, but one at least; those are verified by weighted edit distance. Where the alias has an ISO code, the spelling must
    have it too, letter by letter. Spellings that fit no alias, or two different units equally well, are left out; known currencies without units keep their name.
    """
    left = spellings.select("spelling", F.size(grams(F.col("spelling"))).alias("size"), F.explode(grams(F.col("spelling"))).alias("gram"))
    right = known.select("alias", "iso", "scale", F.size(grams(F.col("alias"))).alias("alias_size"), F.explode(grams(F.col("alias"))).alias("gram"))
    candidates = (
        left.join(F.broadcast(right), "gram")  # a fixed lexicon of about 50 spellings a currency
        .groupBy("spelling", "alias", "iso", "scale")
        .agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("size", "alias_size")).alias("size"))
        .where(F.col("shared") >= F.greatest(F.col("size") - (GRAM + 1), F.lit(1)))
    )

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(" ".join(x.split()), y, DISTANCES[-1]) for x, y in zip(a, b)], dtype="float64")

    n = F.length("alias")
    limit = F.when(n <= LENGTHS[0], DISTANCES[0]).when(n <= LENGTHS[1], DISTANCES[1]).otherwise(DISTANCES[2])
    code = F.lower("iso")
    coded = ~F.contains(F.lower("alias"), code) | F.contains(folded(F.col("spelling")), code)
    fits = candidates.where(coded).withColumn("distance", distance("spelling", "alias")).where(F.col("distance") <= limit)
    units = fits.groupBy("spelling", "iso", "scale").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("spelling").orderBy("distance")
    return (
        units.withColumn("rank", F.rank().over(best))
        .where("rank = 1")
        .withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("spelling")))
        .where("ties = 1")
        .select("spelling", "iso", "scale", "distance")
    )


def say(tx: DataFrame) -> DataFrame:
    """Add what a row itself says: ``spelled`` (its currency text) and ``said``, the text that may hold the unit of its amount; ``sum_text``, the number of a sum written out.

    With an amount, ``said`` is what follows the words for an amount; without one, it is what stands around the first number, with the number as #.
    """
    none = F.lit("")
    text, written = F.coalesce("remittance_text", none), F.col("amount").isNull()
    around = F.concat(F.regexp_extract(text, SUM, 1), F.lit("#"), F.regexp_extract(text, SUM, 3))
    return (
        tx.withColumn("sum_text", F.when(written, F.nullif(F.regexp_extract(text, SUM, 2), none)))
        .withColumn("said", F.when(~written, F.nullif(F.trim(F.regexp_extract(text, STATEMENT, 1)), none)).when(F.col("sum_text").isNotNull(), around))
        .withColumn("spelled", F.nullif(F.trim("currency"), none))
    )


def phrases(said: DataFrame) -> DataFrame:
    """The phrases that may be the unit in each distinct ``said``: said, spelling, length. A unit begins the statement, or stands at either side of the number or on both."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    halves = F.split("said", "#")
    after, before = words(F.get(halves, F.size(halves) - 1)), F.when(F.size(halves) > 1, words(halves[0])).otherwise(F.array().cast("array<string>"))
    texts = said.select("said", after.alias("after"), before.alias("before"), (F.size(halves) > 1).alias("number"))
    counted = texts.select("said", "after", "before", "number", F.explode(F.sequence(F.lit(0), F.least(F.size("after"), F.lit(WORDS)))).alias("n"))
    counted = counted.select("*", F.explode(F.sequence(F.lit(0), F.size("before"))).alias("m")).where("n + m > 0")
    phrase = F.concat_ws(" ", F.slice("before", F.size("before") - F.col("m") + 1, F.col("m")), F.slice("after", F.lit(1), F.col("n")))
    return counted.select("said", phrase.alias("spelling"), (F.col("n") + F.col("m")).alias("length"))


def feeds(source_systems: DataFrame) -> DataFrame:
    """How a feed records amounts in [valid_from, valid_to); a fixed table."""
    after = Window.partitionBy("source_system").orderBy("valid_from")
    return source_systems.select(
        F.col("source_system").alias("feed"), "default_currency", F.create_map(*(F.lit(x) for kv in FEED_SCALE.items() for x in kv))[F.col("amount_scale")].alias("feed_scale"),
        "valid_from", F.lead("valid_from").over(after).alias("valid_to"),
    )


def with_units(tx: DataFrame, all_rows: DataFrame, units: DataFrame, source_systems: DataFrame) -> DataFrame:
    """Every row of ``tx`` (its columns NEEDED) with unit_code, iso_currency, amount_in_units, amount_whole (exact) and amount_usd.

    The row's own statement outranks its currency text, which outranks the feed; a bare currency name takes its scale from the feed.
    Where amount is null the sum in the text counts, its bare currency meaning whole units, and without such a sum there is
    no unit. Texts no known spelling explains give no unit. ``all_rows`` is any table that holds the same texts; the distinct
    spellings are taken from it, so finding them needs no shuffle of the rows. An unknown or null feed, or a null created_at, tells nothing: whole units of the row's own
    currency. Rows repeated in ``tx`` come out repeated; an empty table gives none.
    """
    spark, tx = tx.sparkSession, tx.select(*NEEDED)
    said = say(all_rows.select("amount", "currency", "remittance_text"))
    asked = materialize(phrases(said.where("said is not null").select("said").distinct()), "unit-phrases")
    spellings = said.where("spelled is not null").select(F.col("spelled").alias("spelling")).union(asked.select("spelling")).distinct()
    known = materialize(alias_dictionary(spellings, lexicon(spark, units)), "unit-aliases")
    best = asked.join(known, "spelling").groupBy("said").agg(F.max(F.struct("length", (-F.col("distance")).alias("near"), "iso", "scale")).alias("x"))
    told = materialize(best.select("said", F.col("x.iso").alias("said_iso"), F.col("x.scale").alias("said_scale")), "unit-statements")
    rows = attach(say(tx), told, ["said"])
    rows = attach(rows, known.select(F.col("spelling").alias("spelled"), F.col("iso").alias("own_iso"), F.col("scale").alias("own_scale")), ["spelled"])
    rows = rows.join(
        F.broadcast(feeds(source_systems)),  # fixed: one row a feed and period
        (F.col("source_system") == F.col("feed")) & (F.col("created_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("created_at") < F.col("valid_to"))),
        "left",
    )
    written = F.col("amount").isNull()
    own = F.when(F.col("spelled").isNull(), F.col("default_currency")).otherwise(F.col("own_iso"))
    iso = F.when(written, F.col("said_iso")).otherwise(F.coalesce("said_iso", own))
    scale = F.when(written, F.coalesce("said_scale", F.lit("major"))).otherwise(F.coalesce("said_scale", "own_scale", "feed_scale", F.lit("major")))
    number = F.when(written, F.regexp_replace("sum_text", ",", "").try_cast("decimal(20,6)")).otherwise(F.col("amount").cast("decimal(20,6)"))
    codes = units.select("unit_code", "iso_currency", "power_of_ten", "usd_per_unit")
    major = {r["iso_currency"] for r in codes.collect() if r["unit_code"].endswith(".minor")}  # fixed table
    part = F.when(scale == "major", "").when((scale == "minor") & ~iso.isin(*sorted(major)), "").otherwise(F.concat(F.lit("."), scale))
    rows = rows.withColumn("__code", F.concat(iso, part)).withColumn("amount_in_units", number)
    rows = rows.join(F.broadcast(codes.withColumnRenamed("unit_code", "__code")), "__code", "left")
    power = F.create_map(*(x for p in (-3, -2, 0, 3, 6) for x in (F.lit(p), F.lit(Decimal(10) ** p).cast("decimal(12,3)"))))
    return (
        rows.withColumn("unit_code", F.when(F.col("iso_currency").isNotNull(), F.col("__code")))
        .withColumn("amount_whole", (F.col("amount_in_units") * power[F.col("power_of_ten")]).cast("decimal(30,7)"))
        .withColumn("amount_usd", F.col("amount_in_units").cast("double") * F.col("usd_per_unit"))
        .drop("__code", "power_of_ten", "usd_per_unit", "said", "spelled", "sum_text", "said_iso", "said_scale", "own_iso", "own_scale", "feed", "default_currency", "feed_scale", "valid_from", "valid_to")
    )


def undeclared(rows: DataFrame) -> DataFrame:
    """Rows whose unit isn't exactly what their currency text says."""
    return rows.where("unit_code is not null and (currency is null or currency <> unit_code)").select("transaction_id", "unit_code")
