"""The operators of the general problems against brute force and on awkward input."""

import csv
import io
import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finweave import session
from finweave.operators import asof, eager, rawparse, rolling, running, units
from finweave.operators.standing import standing_rows
from finweave.session import attach

T0 = datetime(2025, 1, 1)


# ---- standing rows and eager aggregation ---------------------------------------------------------------------------


def test_standing_rows(spark):
    rows = [("a", 1, "old", 0), ("a", 2, "new", 0), ("a", 2, "new", 1), ("b", None, "x", 0), (None, 3, "y", 0), ("c", 1, "p", 0), ("c", 1, "q", 0)]
    df = spark.createDataFrame(rows, "id string, v int, w string, __rank int")
    assert sorted(tuple(r) for r in standing_rows(df, "id", "v", ["id", "w"]).collect()) == [("a", "new"), ("b", "x"), ("c", "q")]
    assert standing_rows(df.limit(0), "id", "v", ["id", "w"]).count() == 0


def test_join_rollup_equals_plain_join(spark):
    r = random.Random(1)
    tx = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([None, Decimal(r.randrange(-50, 99))]), T0 + timedelta(days=r.randrange(9))) for _ in range(300)]
    acc = [("hot", "e1"), ("hot", "e2"), ("a", "e1"), ("a", "e1"), ("c", "e3"), (None, "e4")]
    left = spark.createDataFrame(tx, "account_id string, amount decimal(20,4), ts timestamp").withColumn("side", F.lit("source"))
    right = spark.createDataFrame(acc, "account_id string, entity_id string")
    plain = left.join(right, "account_id").groupBy("entity_id", "side").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,4)").alias("total"), F.max("ts").alias("last_at"))
    got = eager.join_rollup(eager.states(left, ["account_id", "side"], "amount", "ts"), eager.multiplicities(right, "account_id", ["entity_id"]), "account_id", ["entity_id"], ["side"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_heavy_accounts(spark):
    states = spark.createDataFrame([("a", "source", 2), ("b", "source", 1), (None, "source", 97), ("a", "destination", 100)], "account_id string, side string, n bigint")
    assert sorted(map(tuple, eager.heavy_accounts(states, 0.02).collect())) == [("a", "destination"), ("a", "source")]
    assert eager.heavy_accounts(states.limit(0), 0.02).count() == 0


def test_attach_salts_a_large_dimension(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 7)
    df, dim = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 0), (None, 0)], "k string, i int"), spark.createDataFrame([("hot", 1), ("y", 2)], "k string, v int")
    for rows in (2, 10**9):
        assert sorted((r["k"] or "", r["v"] or 0) for r in attach(df, dim, ["k"], rows=rows).collect()) == [("", 0)] + [("hot", 1)] * 50 + [("x", 0)]


# ---- units ---------------------------------------------------------------------------------------------------------

UNITS = [("USD", "USD", 0, 1.0), ("USD.minor", "USD", -2, 0.01), ("USD.k", "USD", 3, 1000.0), ("USD.m", "USD", 6, 1e6), ("JPY", "JPY", 0, 0.0067), ("JPY.k", "JPY", 3, 6.7), ("EUR", "EUR", 0, 1.09), ("EUR.minor", "EUR", -2, 0.0109)]
FEEDS = [("bank", "USD", "major", T0), ("cards", "EUR", "minor", T0), ("legacy", "USD", "minor", T0), ("legacy", "USD", "major", T0 + timedelta(days=10)), ("tokyo", "JPY", "minor", T0)]


UNIT_CASES = [  # amount, currency, feed, text, day, unit, whole
    ("5", "USD", "bank", None, 1, "USD", "5"), ("5", None, "cards", None, 1, "EUR.minor", "0.05"), ("5", "Usd", "cards", None, 1, "USD.minor", "0.05"), ("5", " USD ", "bank", None, 1, "USD", "5"),
    ("5", "US cents", "bank", None, 1, "USD.minor", "0.05"), ("5", "kUSD", "cards", None, 1, "USD.k", "5000"), ("5", "USD mn", "bank", "figure in full USD units", 1, "USD", "5"), ("5", "USD", "legacy", None, 1, "USD.minor", "0.05"),
    ("5", "USD", "legacy", None, 11, "USD", "5"), ("5", "Yen", "tokyo", None, 1, "JPY", "5"), ("5", None, "bank", "donation; montant en milliers de JPY - ref 12", 1, "JPY.k", "5000"),
    ("5", None, "bank", "coupon: 10 cents off, ref 13405", 1, "USD", "5"), ("5", "EUR", "bank", "figure is Eurocent, not whole EUR", 1, "EUR.minor", "0.05"), (None, "EUR", "bank", "sum of USD 0.129k per contract", 1, "USD.k", "129"),
    (None, None, "bank", "transfer JPY 3,015.76 urgent", 1, "JPY", "3015.76"), (None, "EUR", "cards", "invoice 77", 1, None, None), ("5", "bitcoin", "bank", None, 1, None, None), ("5", None, None, None, 1, None, None),
    ("5", "SAR thousands", "bank", None, 1, None, None), ("5", "thousand IDR", "bank", None, 1, None, None), ("5", "RUR (thousands)", "bank", None, 1, None, None), ("5", "Norwegian krone", "bank", None, 1, None, None), ("5", "UDS", "bank", None, 1, None, None),
    ("5", "Euroo", "bank", None, 1, "EUR", "5"), ("5", "U.S.D.", "bank", None, 1, "USD", "5"), ("5", "EUR", "bank", "all values are recorded in USD thousands", 1, "USD.k", "5000"), ("5", "JPY", "bank", "the amount is stated in kUSD (gross)", 1, "USD.k", "5000"),
    ("5", None, "bank", "Wert angegeben in Tsd. USD - ref 5", 1, "USD.k", "5000"), ("5", "USD", "bank", "ref 78342 quoted in EUR, settled as booked", 1, "USD", "5"), ("5", "USD", "bank", "order of 3 thousand bolts; invoice in EUR", 1, "USD", "5"),
    (None, None, "bank", "we owe you 12.5 thousand JPY today", 1, "JPY.k", "12500"), (None, None, "bank", "order of 3 thousand bolts, PO 5", 1, None, None), (None, None, "bank", "pago de USD 1,250.5", 1, "USD", "1250.5"), (None, "EUR", "bank", "transfer EUR77 urgent", 1, "EUR", "77"),
    ("5", "EUR", None, None, 1, "EUR", "5"), ("5", "US Dolar", "bank", None, 1, "USD", "5"), ("5", "", "bank", "", 1, "USD", "5"), ("5", "x" * 3000, "bank", "y" * 3000, 1, None, None),
]


def test_units(spark):
    rows = [(str(k), amount and Decimal(amount), currency, feed, text, T0 + timedelta(days=day), "clash") for k, (amount, currency, feed, text, day, _, _) in enumerate(UNIT_CASES)]
    tx = spark.createDataFrame(rows, "transaction_id string, amount decimal(20,4), currency string, source_system string, remittance_text string, created_at timestamp, feed string")
    u = spark.createDataFrame(UNITS, "unit_code string, iso_currency string, power_of_ten int, usd_per_unit double")
    s = spark.createDataFrame(FEEDS, "source_system string, default_currency string, amount_scale string, valid_from timestamp")
    out = {r["transaction_id"]: (r["unit_code"], r["amount_whole"]) for r in units.with_units(tx, tx, u, s).collect()}
    wrong = [(c, out[str(k)]) for k, c in enumerate(UNIT_CASES) if out[str(k)] != (c[5], c[6] and Decimal(c[6]))]
    assert not wrong, wrong
    assert units.with_units(tx.limit(0), tx.limit(0), u, s).count() == 0


def test_weighted_distance():
    d = units.weighted_distance
    assert d("USD", "USD") == 0 and d("usd", "USD") == 0.75 and d("U.S.D", "USD") == pytest.approx(0.2) and d("zl", "zł") == 1.0 and d("ore", "öre") == 0.25 and d("€", "") == 1.0 and d("", "ab") == 2.0


# ---- as-of ---------------------------------------------------------------------------------------------------------

CH = "change_id int, entity_id string, risk_score int, pep_flag boolean, valid_from timestamp, recorded_at timestamp, extra string"


def random_changes(seed, n_changes, n_events):
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(24 * 60) // 6 * 6)
    who = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    changes = [(k // 2 if r.random() < 0.3 else k, who(), r.randrange(99), r.random() < 0.5, when(), when(), "e") for k in range(n_changes)]
    events = [(k, who(), when(), "clash") for k in range(n_events)]
    return changes + changes[:5], events + events[:5]


@pytest.mark.parametrize("seed, changes, events, per", [(1, 60, 80, 32), (2, 200, 60, 4), (3, 1, 9, 32), (4, 0, 9, 32), (5, 9, 0, 32)])
def test_as_of(spark, monkeypatch, seed, changes, events, per):
    monkeypatch.setattr(asof, "CHANGES_PER_BUCKET", per)
    monkeypatch.setattr(asof, "EVENTS_PER_BUCKET", 16)
    monkeypatch.setattr(running, "STRETCH_ROWS", per)
    ch, ev = random_changes(seed, changes, events)
    ch, ev = (ch, ev) if changes else ([], ev)
    ev = ev if events else []
    want = set()
    for i, e, t, _ in set(ev):
        best = max(((c[4], c[5], c[0], c[2], c[3]) for c in ch if c[1] == e and None not in (e, t, c[4], c[5]) and c[4] <= t and c[5] <= t), default=None)
        want.add((i, e, t, *(best[2:] if best else (None,) * 3)))
    got = asof.as_of(
        spark.createDataFrame(ev, "id int, entity_id string, scoring_timestamp timestamp, version string"), spark.createDataFrame(ch, CH), event_id="id", entity="entity_id", event_time="scoring_timestamp",
        valid_from="valid_from", known_at="recorded_at", tie="change_id", values=["risk_score", "pep_flag"],
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


# ---- raw records ---------------------------------------------------------------------------------------------------


def brute_tokens(record: str):
    """The same verdict from a character loop."""
    fields, now, state = [], "", "start"
    for c in record:
        if state == "quoted":
            state = "closed" if c == '"' else state
            now += c
        elif state == "closed":
            if c == '"':
                state = "quoted"
            elif c == ",":
                fields.append(now[1:-1].replace('""', '"'))
                now, state = "", "start"
                continue
            else:
                return "broken_quoting"
            now += c
        elif c == ",":
            fields.append(now)
            now, state = "", "start"
        elif c == '"':
            if state == "plain":
                return "broken_quoting"
            state = "quoted"
            now += c
        else:
            state = "plain"
            now += c
    if state == "quoted":
        return "broken_quoting"
    fields.append(now[1:-1].replace('""', '"') if state == "closed" else now)
    return fields if len(fields) == 13 else "column_count"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\né', max_size=60), min_size=1, max_size=6), st.integers(1, 9))
def test_tokenizer(texts, width):
    texts = texts + [",".join(["x", '"y, z"', '""', '"q""q"'] * 3 + [t]) for t in texts]
    chunk, rawparse.CHUNK = rawparse.CHUNK, width
    try:
        got = rawparse.tokenize_csv([t.encode() for t in texts])
    finally:
        rawparse.CHUNK = chunk
    for t, (reason, at, fields, begins, _) in zip(texts, got):
        want = brute_tokens(t)
        assert (reason or fields) == (want if isinstance(want, str) else [f or None for f in want])
        assert fields is not None or 0 <= at <= len(t.encode())
        assert begins is None or begins[0] == 0 and all(t.encode()[b - 1 : b] == b"," for b in begins[1:])


def test_states_do_not_depend_on_chunks():
    classes = np.frombuffer(bytes(random.Random(3).choices([0, 1, 2, 3], [6, 3, 2, 1], k=999)), np.uint8)
    assert all((rawparse.states_before(classes, c) == rawparse.states_before(classes, 2000)).all() for c in (1, 7, 64))


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-(10**18), 10**18), st.floats(allow_nan=False, allow_infinity=False), st.text('ab"\\\n\té☃😀/', max_size=12))


def brute_json(text: str):
    """The same verdict from the standard parser, with all keys kept."""
    try:
        value = json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs), parse_float=rawparse._Number, parse_int=rawparse._Number, parse_constant=rawparse._refuse)
    except (json.JSONDecodeError, RecursionError):
        return "broken_quoting"
    if not isinstance(value, tuple) or sorted(k for k, _ in value[1]) != sorted(rawparse.FIELDS):
        return "column_count"
    by = dict(value[1])
    return [None if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, str) else "nested" for x in map(by.get, rawparse.FIELDS)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(SCALARS, min_size=13, max_size=13), st.integers(0, 9), st.integers(0, 400), st.sampled_from(list('{}[]",:\\ 0-.eEtunx\n')), st.booleans()), min_size=1, max_size=6), st.integers(3, 64))
def test_json_tokenizer(records, width):
    """Whole records, and such with a character put in, cut off, or with fields too few or too many."""
    texts = []
    for values, change, at, c, spaced in records:
        by = dict(zip(rawparse.FIELDS, values))
        if change == 1:
            del by["amount"]
        elif change == 2:
            by["more"] = 1
        elif change == 3:
            by["flagged"] = [1, {"a": None}]
        t = json.dumps(by, ensure_ascii=spaced, separators=(" , ", " : ") if spaced else (",", ":"))
        texts.append(t[: at % len(t)] + c + t[at % len(t) :] if change in (4, 5, 6) else t[: at % len(t)] if change == 7 else t)
    chunk, rawparse.CHUNK = rawparse.CHUNK, width
    try:
        got = rawparse.tokenize_json([t.encode() for t in texts])
    finally:
        rawparse.CHUNK = chunk
    for t, (reason, at, fields, begins, kinds) in zip(texts, got):
        want = brute_json(t)
        assert reason == (want if isinstance(want, str) else None), t
        if fields is None:
            assert 0 <= at <= len(t.encode())
        else:
            assert [f for f, k in zip(fields, kinds) if k != "x"] == [w for w, k in zip(want, kinds) if k != "x"] and len(begins) == 13


GOOD = ["T1", "A1", "B1", "12.5", "usd", "2025-06-12T00:15:46", "WIRE", "SG", "", "corporate, listed", "false", "76", "true"]


def as_csv(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def as_json(**change):
    kinds = dict(zip(rawparse.FIELDS, GOOD)) | {"amount": 12.5, "risk_score": 76, "is_pep": False, "flagged": True, "destination_country": None} | change
    return json.dumps({k: v for k, v in kinds.items() if v != "drop"})


def changed(n, value):
    return as_csv([value if k == n else f for k, f in enumerate(GOOD)])


CASES = [
    ("csv", as_csv(GOOD), None), ("csv", as_csv(GOOD[:-1]), "column_count"), ("csv", "", "column_count"), ("csv", None, "column_count"), ("csv", as_csv(GOOD) + ',"', "broken_quoting"), ("csv", '"a"x,' + as_csv(GOOD), "broken_quoting"),
    *(("csv", changed(n, ""), "invalid_value") for n in range(6)), *(("csv", changed(n, ""), None) for n in range(6, 13)),
    ("csv", changed(3, "1e5"), "invalid_value"), ("csv", changed(3, "12.34567"), "invalid_value"), ("csv", changed(3, "-1234567890123456.1234"), None), ("csv", changed(3, "12345678901234567"), "invalid_value"), ("csv", changed(3, "+5"), "invalid_value"),
    ("csv", changed(3, "5."), "invalid_value"), ("csv", changed(3, "5\n"), "invalid_value"), ("csv", changed(4, "EU"), "invalid_value"), ("csv", changed(4, "EÜR"), "invalid_value"), ("csv", changed(5, "2025-02-30T00:00:00"), "invalid_value"),
    ("csv", changed(5, "2024-02-29T23:59:59"), None), ("csv", changed(5, "2025-06-12T24:00:00"), "invalid_value"), ("csv", changed(5, "2025-06-12 00:15:46"), "invalid_value"), ("csv", changed(7, "SGP"), "invalid_value"),
    ("csv", changed(10, "TRUE"), "invalid_value"), ("csv", changed(11, "tbd"), "invalid_value"), ("csv", changed(9, "z" * 100_000), None), ("csv", changed(6, 'OTHER "misc"\n'), None),
    ("json", as_json(), None), ("json", as_json(amount="12.5"), "invalid_value"), ("json", as_json(flagged="true"), "invalid_value"), ("json", as_json(currency=5), "invalid_value"), ("json", as_json(transaction_type=["x"]), "invalid_value"),
    ("json", as_json(amount="drop"), "column_count"), ("json", as_json(more=1), "column_count"), ("json", as_json(amount=None), "invalid_value"), ("json", as_json(risk_score=None, is_pep=None), None), ("json", as_json()[:-1], "broken_quoting"),
    ("json", as_json().replace("12.5", "1.25e1"), "invalid_value"), ("json", as_json().replace("12.5", "NaN"), "broken_quoting"), ("json", "[1]", "column_count"), ("json", '"x"', "column_count"), ("json", "", "broken_quoting"),
    ("json", "[" * 100_000, "broken_quoting"), ("json", as_json().replace("{", '{"amount": 1, ', 1), "column_count"), (None, as_json(), None), (None, as_csv(GOOD), None), ("json", as_json(source_account=""), None),
]


def test_raw_records(spark):
    rows = [(k, f, r, "clash") for k, (f, r, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "record_id bigint, record_format string, raw_record string, reason string")
    out = {r["key"]: r for r in rawparse.classify(rawparse.tokenize(df, "record_id", "raw_record", "record_format")).collect()}
    assert len(out) == len(CASES)
    wrong = [(f, (r or "")[:80], want, out[k]["reason"], out[k]["bad_field"]) for k, (f, r, want) in enumerate(CASES) if out[k]["reason"] != want]
    assert not wrong, wrong
    wrong = [(f, r) for k, (f, r, want) in enumerate(CASES) if want and out[k]["at"] is None]
    assert not wrong, wrong
    at = next(k for k, (f, r, w) in enumerate(CASES) if f == "csv" and r == changed(3, "1e5"))
    assert CASES[at][1][out[at]["at"] :].startswith("1e5") and out[at]["bad_field"] == "amount"
    at = next(k for k, (f, r, w) in enumerate(CASES) if f == "json" and r == as_json(currency=5))
    assert CASES[at][1][out[at]["at"] :].startswith("5,") and out[at]["bad_field"] == "currency"
    good = rawparse.bronze(rawparse.classify(rawparse.tokenize(df, "record_id", "raw_record", "record_format")))
    first = good.where("record_id = 0").first()
    assert first["amount"] == Decimal("12.5") and first["transaction_timestamp"] == datetime(2025, 6, 12, 0, 15, 46) and first["is_pep"] is False and first["destination_country"] is None
    assert good.count() == sum(w is None for *_, w in CASES)
    assert rawparse.tokenize(df.limit(0), "record_id", "raw_record", "record_format").count() == 0


# ---- rolling totals ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_trailing(days, length, seed):
    x = np.random.default_rng(seed).integers(-99, 99, (3, days))
    want = np.array([[r[max(0, d - length + 1) : d + 1].sum() for d in range(days)] for r in x])
    assert (rolling.trailing(x, length) == want).all()


def test_rolling(spark):
    r = random.Random(4)
    first, last = date(2025, 1, 1), date(2025, 3, 1)
    huge = Decimal("9999999999999999.9999")
    tx = [(r.choice(["hot", "hot", "a", None]), r.choice([None, Decimal(r.randrange(-10**6, 10**6)) / 10000, huge, -huge]), r.choice([None, T0 + timedelta(hours=r.randrange(-200, 1700))]), "x") for _ in range(400)]
    df = spark.createDataFrame(tx, "account string, amount decimal(20,4), ts timestamp, d string")
    daily = rolling.daily_totals(df, "account", "ts", "amount", first, last)
    days = (last - first).days + 1
    want = {}
    for who in {t[0] for t in tx if t[0] and t[1] is not None and t[2] and first <= t[2].date() <= last}:
        x = [sum((t[1] for t in tx if t[0] == who and t[1] is not None and t[2] and t[2].date() == first + timedelta(days=d)), Decimal(0)) for d in range(days)]
        for d in range(days):
            want[who, d] = (sum(x[max(0, d - 6) : d + 1]), sum(x[max(0, d - 29) : d + 1]))
    rows = rolling.trailing_totals(daily, first, last).select("account", "d", rolling.amount_of("hi_7", "lo_7"), rolling.amount_of("hi_30", "lo_30")).collect()
    assert {(q[0], q[1]): (q[2], q[3]) for q in rows} == want
    peaks = {p[0]: (p[1], p[2]) for p in rolling.peak_days(daily, first, last).collect()}
    assert peaks == {who: tuple(max(range(days), key=lambda d: (want[who, d][k], d)) for k in (0, 1)) for who in peaks} and len(peaks) == len({w for w, _ in want})
    empty = rolling.daily_totals(df.limit(0), "account", "ts", "amount", first, last)
    assert rolling.peak_days(empty, first, last).count() == 0 and rolling.trailing_totals(empty, first, last).count() == 0


# ---- running totals ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [10**6, 3])
def test_running_and_trailing_count(spark, monkeypatch, most):
    monkeypatch.setattr(running, "STRETCH_ROWS", most)
    r = random.Random(5)
    rows = [(k, r.choice(["hot", "hot", "a", None]), None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(0, 2400, 6)), None if r.random() < 0.1 else r.randrange(99)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v int")
    got = {x["id"]: (x["running_total"], x["running_count"]) for x in running.running(df, "k", "ts", "id", "v").collect()}
    counts = {x["id"]: x["n"] for x in running.trailing_count(df, "k", "ts", "id", 30).collect()}
    kept = [x for x in rows if x[1] and x[2]]
    assert set(got) == set(counts) == {x[0] for x in kept}
    for i, k, t, _ in kept:
        before = [x for x in kept if x[1] == k and (x[2], x[0]) <= (t, i)]
        vs = [x[3] for x in before if x[3] is not None]
        assert got[i] == (sum(vs) if vs else None, len(before))
        assert counts[i] == sum(x[1] == k and t - timedelta(days=30) <= x[2] <= t for x in kept)
    assert running.running(df.limit(0), "k", "ts", "id", "v").count() == 0


