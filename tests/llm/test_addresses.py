"""Parsing of addresses and classes of places."""

import random

import pytest

from finweave.llm import addresses


@pytest.mark.parametrize(
    "text, want",
    [
        ("107 Torebikane Avenue, Flat 8, Zanaverford, HX5 5GW, United Kingdom", ("107", "avenue", "torebikane", "zanaverford", "hx5")), ("3 blvd Dovevisell bât C 90222 Velerach-sur-Mer France", ("3", "boulevard", "dovevisell", "velerach sur mer", "902")),
        ("GB Ardosocham, HR5 2LY 36 Wimuneirc St", ("36", "street", "wimuneirc", "ardosocham", "hr5")), ("DE; 76244 Pelnerstadt; Casebitumwg. 85", ("85", "weg", "casebitum", "pelnerstadt", "762")), ("Po Varevidett 74 piso 13 Elsikum de la Sierra", ("74", "paseo", "varevidett", "elsikum de la sierra", "")),
        ("c/o ulmanrum agents, 123 tamabov drive, yelulinibury, uk", ("123", "drive", "tamabov", "yelulinibury", "")), ("C/ ZANERLINI, Nº 48\n61 795 FAROVACHALES", ("48", "calle", "zanerlini", "farovachales", "617")), ("Avenida Thuegriann, 39, 6º B, 25766 Thuemicales, España", ("39", "avenue", "thuegriann", "thuemicales", "257")),
        ("Solamaterallee 1, Whg. 23, 76215 Pelenerstadt, Deutschland", ("1", "allee", "solamater", "pelenerstadt", "762")), ("Praolobini Platz 137, 27081 Kelomicdorf", ("137", "square", "praolobini", "kelomicdorf", "270")), ("99 r. Norolorard, 56091 Fenorettville, FR", ("99", "rue", "norolorard", "fenorettville", "560")),
        ("100A Glitodett Av., Yelunachbiry, PK7 3FQ", ("100a", "avenue", "glitodett", "yelunachbiry", "pk7")), ("Hesebibachwg 79 Braarerstadt DE", ("79", "weg", "hesebibach", "braarerstadt", "")), ("94231 Dreudumejo Av. Brraanrum, 46", ("46", "avenue", "brraanrum", "dreudumejo", "942")), ("ESPAÑA FAROVACHALES PL. VAREBILELL, Nº 55", ("55", "square", "varebilell", "farovachales", "")), ("Flat 20 / # 117 Velilbach Road / Quileliniham", ("117", "road", "velilbach", "quileliniham", "")), ("Thuaronkell House, 9 Casaltell Rd., Elsirard Bay", ("9", "road", "casaltell", "elsirard bay", "")),
        ("Calle de Alcalá 12, 28014 Madrid", ("12", "calle", "alcala", "madrid", "280")), ("Rue de la Paix 12, 75002 Paris", ("12", "rue", "paix", "paris", "750")), ("12 rue du Bac 75007", ("12", "rue", "bac", "", "750")),
        ("12 Old Church Street LS1 4DY", ("12", "street", "old church", "", "ls1")), ("1 High Street, Newcastle upon Tyne NE1 4AB", ("1", "street", "high", "newcastle upon tyne", "ne1")), ("Leeds, 12 North Park Avenue", ("12", "avenue", "north park", "leeds", "")),
        ("12 North Park Avenue Leeds", ("12", "avenue", "north park", "leeds", "")), ("Via Garibaldi 3, 00185 Roma", ("3", "via", "garibaldi", "roma", "001")), ("10 Downing Street, London SW1A 2AA", ("10", "street", "downing", "london", "sw1a")),
        ("Alte Poststraße 5, 10115 Berlin", ("5", "street", "alte post", "berlin", "101")), ("Kurt-Schumacher-Str. 5, 10115 Berlin", ("5", "street", "kurt schumacher", "berlin", "101")), ("Kalverstraat 92, Amsterdam", ("92", "street", "kalver", "amsterdam", "")),
    ],
)
def test_parse(text, want):
    assert addresses.parse(text)[:5] == want


@pytest.mark.parametrize("text", ["", "nowhere", "PO box", "12", "street"])
def test_unparsed(text):
    assert addresses.parse(text) is None


SCHEMA = "entity_id string, address string, place string, number string"


def places(spark, rows):
    return {tuple(r) for r in addresses.same_place(spark.createDataFrame([(f"{k:02d}", a, "x", "y") for k, a in enumerate(rows)], SCHEMA)).collect()}


def test_places(spark):
    same = [
        "107 Torebikane Avenue, Flat 8, Zanaverford, HX5 5GW, United Kingdom", "GB; ZANAVERFORD, HX55GW; NO. 107 TOREBIKANE AV.", "c/o Some Agents, 107 Torebikame Ave, Zanaverfrod", "107 Torebikane Avenue, HX5 5GW", "107 Torebikane Avenue, Zanaverford",
    ]
    other = [
        "107A Torebikane Avenue, Zanaverford", "107 Torebikane Road, Zanaverford", "107 Torebikane Avenue, Kelomicton", "109 Torebikane Avenue, Zanaverford", "107 Pelitarov Avenue, Zanaverford", "107 Torebikane Avenue", None, "", "  ",
        "no number here", "No number here!", "x" * 20_000,
    ]
    got = places(spark, same + other)
    n = len(same)
    assert {(f"{a:02d}", f"{b:02d}") for a in range(n) for b in range(a + 1, n)} | {(f"{n + 9:02d}", f"{n + 10:02d}")} == got
    assert places(spark, []) == set() and places(spark, [None]) == set()


def test_different_places(spark):
    """Words of street and town count each, and a house has one postcode."""
    rows = [
        "12 rue du Bac 75007", "12 rue du Four 75006", "12 Old Church Street LS1 4DY", "12 New Church Street LS1 4DZ", "1 High Street, Newcastle upon Tyne NE1 4AB", "1 High Street, Newcastle under Lyme ST5 1AA",
        "1 High St, Newcastle-upon-Tyne", "1 High Street, Newcastle under Lyme", "7 North Park Road, Leeds", "7 South Park Road, Leeds", "7 Park Road, Leeds", "3 Long Road, Farovton, AB1 2CD", "3 Long Road, Farovton, AB1 2CE",
    ]
    assert places(spark, rows) == {("04", "06"), ("05", "07")}


def test_candidates_grow_with_places_not_with_towns_squared(spark):
    """One house number in one street of every town: only copies of a place meet."""
    r = random.Random(6)
    towns = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=11)) for _ in range(150)]
    texts = [f"1 High {t}, {town}" for town in towns for t in ("Street", "St.")]
    parsed = addresses.parsed(spark.createDataFrame([(str(k), t, "x", "y") for k, t in enumerate(texts)], SCHEMA))
    rows = parsed.selectExpr("cast(entity_id as binary) as pid", "number", "kind", "street", "town", "code", "area")
    assert addresses.place_links(rows).count() == 150


def test_two_towns_in_one_postal_area(spark):
    rows = ["1 Long Road, Farovton, AB1 2CD", "1 Long Road, AB1 2CD", "1 Long Road, Pelibury, AB1 9ZZ", "1 Long Road, AB1 9ZZ", "1 Long Road, AB1 7QQ", "1 Long Rd., AB1 7QQ", *(f"{k} Other Road, Pelibury, AB1 {k}XX" for k in range(2, 4))]
    assert places(spark, rows) == {("00", "01"), ("02", "03"), ("04", "05")}  # a third postcode could be in either town
    assert places(spark, ["7 Long Road, Farovton", "7 Long Rd, AB1 7QQ", *(f"{k} Other Road, {t}, AB1 {k}XY" for k, t in enumerate(["Farovton", "Pelibury"] * 3, 2))]) == {("00", "01")}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([("a", "1 Long Road, Farovton"), ("a", "1 Long Road, Farovton"), ("b", "1 Long Rd., Farovton"), (None, "1 Long Road, Farovton")], "entity_id string, address string")
    assert [tuple(r) for r in addresses.same_place(df).collect()] == [("a", "b")]


def test_a_hot_address_does_not_move_others(spark):
    """Copies of one address say nothing about the town of others in its postal area."""
    rows = ["5 Other Road, Pelibury", "5 Other Rd, AB1 7QQ", "8 Smaltun Road, Pelibury, AB1 9ZY", "8 Smalton Rd, AB1 9ZY", *["1 Long Road, Farovton, AB1 2CD"] * 60]
    assert {p for p in places(spark, rows) if p[0] < "04"} == {("00", "01"), ("02", "03")}


def test_area_with_many_towns(spark):
    towns = ["Farovton", "Pelibury", "Zanaverford", "Kelomicton", "Dovestabum", "Ostewick", "Ulmilford", "Braeterham", "Lunilgate", "Vanibridge", "Jaredmouth", "Torinales", "Solanvale", "Quilebay", "Rudurstead", "Hiroked",
             "Maratown", "Nephewick", "Karamere", "Welbourne", "Gorsefield", "Cindlecombe", "Yelland", "Ibberpool"]
    rows = [f"{k + 1} Long Lane, {t}" for k, t in enumerate(towns)] + [f"90 Other Lane, {t}, AB1 {k % 10}{chr(65 + k)}X" for k, t in enumerate(towns)] + ["7 Long Lane, AB1 9QQ", "8 Lomg Lane, AB1 9QR"]
    assert places(spark, rows) == {("06", "48"), ("07", "49")}


def test_missing_town_found_in_two(spark):
    """An address without a town that is found in two towns of its area is in neither; in a third area's town it isn't looked for."""
    area = ["90 Other Road, Pelibury, AB1 1AA", "90 Other Road, Farovton, AB1 1AB", "90 Other Road, Zanaverford, CD2 1AA"]
    assert places(spark, [*area, "5 Long Road, Pelibury", "5 Long Road, Farovton", "5 Long Rd, AB1 7QQ"]) == set()
    assert places(spark, [*area, "5 Long Road, Pelibury", "5 Long Road, Zanaverford", "5 Long Rd, AB1 7QQ"]) == {("03", "05")}
