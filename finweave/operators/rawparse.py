"""Loading raw CSV and JSON records: typed rows, or the reason and offset of the failure."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = (
    "transaction_id", "source_account", "destination_account", "amount", "currency", "transaction_timestamp", "transaction_type",
    "source_country", "destination_country", "customer_type", "is_pep", "risk_score", "flagged",
)
REQUIRED = 6
#: Bytes of a chunk; the chunks of a batch are scanned side by side, their transitions composed afterwards.
CHUNK = 256

# States of the CSV tokenizer and classes of bytes.
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, COMMA, QUOTE, END = range(4)
#: STEP[class, state] is the next state. The end of a record leads back to START from everywhere.
STEP = np.array([
    [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
    [START, START, QUOTED, START, BROKEN],
    [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
    [START, START, START, START, START],
], np.uint8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord(",")], _CLASS[ord('"')] = COMMA, QUOTE

# States of the JSON tokenizer, which reads an object of scalar values; what is nested, or isn't an object, ends in J_NEST.
_JSON_STATES = (
    "start open key key_escape key_1 key_2 key_3 key_4 keyed colon string string_escape string_1 string_2 string_3 string_4 minus zero int point fraction e sign exponent "
    "t tr tru f fa fal fals n nu nul done next closed nest broken"
)
_J = {name: n for n, name in enumerate(_JSON_STATES.split())}
J_NEST, J_BROKEN, J_CLOSED = _J["nest"], _J["broken"], _J["closed"]


def _json_steps() -> tuple[np.ndarray, np.ndarray, int]:
    """The class of each byte, STEP for the JSON tokenizer, and the class that ends a record. Bytes that lead alike from every state are one class."""
    table = np.full((256, len(_J)), J_BROKEN, np.uint8)

    def rule(states: str, bytes_: bytes, to: str) -> None:
        for state in states.split():
            table[list(bytes_), _J[state]] = _J[to]

    blank, digits, hexa = b" \t\n\r", b"0123456789", b"0123456789abcdefABCDEF"
    for state in ("start", "open", "keyed", "colon", "done", "next", "closed"):
        rule(state, blank, state)
    rule("start", b'["-0123456789tfn', "nest")
    rule("start", b"{", "open")
    rule("open", b"}", "closed")
    rule("open next", b'"', "key")
    for kind, after in (("key", "keyed"), ("string", "done")):
        rule(kind, bytes(range(32, 256)), kind)
        rule(kind, b'"', after)
        rule(kind, b"\\", f"{kind}_escape")
        rule(f"{kind}_escape", b'"\\/bfnrt', kind)
        rule(f"{kind}_escape", b"u", f"{kind}_1")
        for k, to in enumerate((f"{kind}_2", f"{kind}_3", f"{kind}_4", kind), 1):
            rule(f"{kind}_{k}", hexa, to)
    rule("keyed", b":", "colon")
    rule("colon", b'"', "string")
    rule("colon", b"{[", "nest")
    rule("colon", b"-", "minus")
    rule("colon minus", b"0", "zero")
    rule("colon minus", b"123456789", "int")
    rule("int", digits, "int")
    rule("zero int", b".", "point")
    rule("point fraction", digits, "fraction")
    rule("zero int fraction", b"eE", "e")
    rule("e", b"+-", "sign")
    rule("e sign exponent", digits, "exponent")
    for word in (b"true", b"false", b"null"):
        for k, c in enumerate(word):
            rule(word[:k].decode() or "colon", bytes([c]), word[: k + 1].decode() if k + 1 < len(word) else "done")
    for state in ("zero", "int", "fraction", "exponent", "done"):
        rule(state, blank, "done")
        rule(state, b",", "next")
        rule(state, b"}", "closed")
    table[:, J_NEST] = J_NEST
    steps, classes = np.unique(table, axis=0, return_inverse=True)
    return classes.reshape(-1).astype(np.uint8), np.vstack([steps, np.full((1, len(_J)), _J["start"], np.uint8)]), len(steps)


_JSON_CLASS, _JSON_STEP, _JSON_END = _json_steps()


def states_before(classes: np.ndarray, chunk: int = CHUNK, step: np.ndarray = STEP, end: int = END) -> np.ndarray:
    """The tokenizer's state before each byte.

    First every chunk is scanned from all states at once, giving its transition as a map of states; the maps are composed from
    left to right to find each chunk's entry state; a second scan with known entries yields the states.
    """
    n, size = len(classes), step.shape[1]
    count = max(1, -(-n // chunk))
    grid = np.full(count * chunk, end, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(count, chunk).T)
    flat, wide = step.ravel(), np.uint16(size)
    maps = np.tile(np.arange(size, dtype=np.uint8), (count, 1))
    for row in grid:
        maps = flat[row[:, None] * wide + maps]
    entry, state = np.empty(count, np.uint8), START
    for k, m in enumerate(maps.tolist()):
        entry[k] = state
        state = m[state]
    out = np.empty((chunk, count), np.uint8)
    state = entry
    for j, row in enumerate(grid):
        out[j] = state
        state = flat[row * wide + state]
    return out.T.reshape(-1)[:n]


#: A tokenized record: reason and offset of the failure, or None twice; fields, the offsets at which they begin, and for JSON their kinds.
Token = tuple[str | None, int | None, list[str | None] | None, list[int] | None, str | None]


def tokenize_csv(records: list[bytes]) -> list[Token]:
    """The records as CSV; empty fields are None."""
    data = b"\n".join(records) + b"\n"
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in records]) - 1
    classes[ends] = END
    before = states_before(classes)
    broken = np.flatnonzero(
        ((classes == QUOTE) & (before == PLAIN)) | ((classes == OTHER) & (before == CLOSED)) | ((classes == END) & (before == QUOTED))
    )
    commas = np.flatnonzero((classes == COMMA) & (before != QUOTED) & (before != BROKEN))
    starts = np.concatenate([[0], ends[:-1] + 1])
    bad = np.searchsorted(broken, starts)
    first, last = np.searchsorted(commas, starts), np.searchsorted(commas, ends)
    broken, commas = [*broken.tolist(), len(data)], commas.tolist()
    out = []
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if broken[bad[k]] <= e:
            out.append(("broken_quoting", broken[bad[k]] - s, None, None, None))
            continue
        cuts = commas[first[k] : last[k]]
        if len(cuts) != len(FIELDS) - 1:
            out.append(("column_count", cuts[len(FIELDS) - 1] - s if len(cuts) >= len(FIELDS) else e - s, None, None, None))
            continue
        fields, begins = [], [s, *(c + 1 for c in cuts)]
        for a, b in zip(begins, [*cuts, e]):
            x = data[a:b]
            if x[:1] == b'"':
                x = x[1:-1].replace(b'""', b'"')
            fields.append(x.decode() or None)
        out.append((None, None, fields, [a - s for a in begins], None))
    return out


_NAMES = {name.encode(): n for n, name in enumerate(FIELDS)}
_KINDS = {ord('"'): "s", ord("t"): "b", ord("f"): "b", ord("n"): "z"}


def tokenize_json(records: list[bytes]) -> list[Token]:
    """The records as JSON objects; kinds has n (number), b, s, z (null) or x (nested) by field. Numbers keep their text.

    The tokenizer reads objects of scalars, which are a regular language; the few records with nested values, or with another value than an object, are
    read by ``nested``.
    """
    data = b"\n".join(records) + b"\n"
    array = np.frombuffer(data, np.uint8)
    classes = _JSON_CLASS[array]
    ends = np.cumsum([len(r) + 1 for r in records]) - 1
    classes[ends] = _JSON_END
    before = states_before(classes, CHUNK, _JSON_STEP, _JSON_END)
    after = np.append(before[1:], np.uint8(0))
    quote = array == ord('"')
    key_open = np.flatnonzero(quote & (after == _J["key"]) & (before != _J["key"]) & (before != _J["key_escape"])) + 1
    key_close = np.flatnonzero(quote & (before == _J["key"]) & (after == _J["keyed"]))
    value_open = np.flatnonzero((before == _J["colon"]) & (after != _J["colon"]))
    over = np.isin(after, [_J["done"], _J["next"], J_CLOSED])
    last = np.flatnonzero(over & (np.isin(before, [_J["string"], _J["tru"], _J["fals"], _J["nul"]])))  # the value's own last byte
    past = np.flatnonzero(over & np.isin(before, [_J["zero"], _J["int"], _J["fraction"], _J["exponent"]]))  # the byte after it
    value_close = np.sort(np.concatenate([last + 1, past]))
    broken = np.flatnonzero((after == J_BROKEN) & (before != J_BROKEN))
    starts = np.concatenate([[0], ends[:-1] + 1])
    first_key, first_bad = np.searchsorted(key_open, starts).tolist(), np.searchsorted(broken, starts).tolist()
    first_key.append(len(key_open))
    final = before[ends].tolist()
    key_open, key_close, value_open, value_close, broken = key_open.tolist(), key_close.tolist(), value_open.tolist(), value_close.tolist(), [*broken.tolist(), len(data)]
    out: list[Token] = []
    keys_at = values_at = opens_at = 0  # records before may be broken, so each list is followed on its own
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        while keys_at < len(key_close) and key_close[keys_at] < s:
            keys_at += 1
        while values_at < len(value_close) and value_close[values_at] <= s:
            values_at += 1
        while opens_at < len(value_open) and value_open[opens_at] < s:
            opens_at += 1
        if final[k] == J_NEST:
            out.append(nested(data[s:e].decode()))
            continue
        if final[k] != J_CLOSED:
            at = broken[first_bad[k]]
            out.append(("broken_quoting", min(at, e) - s, None, None, None))
            continue
        n = first_key[k + 1] - first_key[k]
        fields: list[str | None] = [None] * len(FIELDS)
        begins, kinds, strange = [-1] * len(FIELDS), ["z"] * len(FIELDS), None
        for i in range(n):
            a, b = key_open[first_key[k] + i], key_close[keys_at + i]
            name = data[a:b] if b"\\" not in data[a:b] else json.loads(data[a - 1 : b + 1]).encode("utf-8", "replace")
            f = _NAMES.get(name, -1)
            if f < 0 or begins[f] >= 0:
                strange = a - 1 - s
                break
            a, b = value_open[opens_at + i], value_close[values_at + i]
            begins[f], kinds[f] = a - s, _KINDS.get(data[a], "n")
            x = data[a:b]
            if kinds[f] == "s":
                fields[f] = x[1:-1].decode() if b"\\" not in x else json.loads(x).encode("utf-8", "replace").decode()
            elif kinds[f] != "z":
                fields[f] = x.decode()
        if strange is not None or n != len(FIELDS):
            out.append(("column_count", strange if strange is not None else len(data[s:e].rstrip()) - 1, None, None, None))
        else:
            out.append((None, None, fields, begins, "".join(kinds)))
    return out


class _Number(str):
    """The text of a bare number."""


def _refuse(text: str):
    raise json.JSONDecodeError("not a JSON value", text, 0)


def nested(text: str) -> Token:
    """A JSON record that isn't an object of scalars: well-formed or not, the right columns or not; fields with nested values are of kind x."""
    try:
        value = json.loads(text, object_pairs_hook=tuple, parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
    except json.JSONDecodeError as e:
        return "broken_quoting", len(text[: e.pos].encode("utf-8", "replace")), None, None, None
    except RecursionError:
        return "broken_quoting", 0, None, None, None
    if not isinstance(value, tuple) or len(value) != len(FIELDS) or {k for k, _ in value} != set(FIELDS):
        return "column_count", 0, None, None, None
    by, fields, kinds = dict(value), [], ""
    for name in FIELDS:
        x = by[name]
        kind = "z" if x is None else "b" if isinstance(x, bool) else "n" if isinstance(x, _Number) else "s" if isinstance(x, str) else "x"
        fields.append(None if kind in "zx" else str(x).lower() if kind == "b" else str(x).encode("utf-8", "replace").decode())
        kinds += kind
    begins = [len(text[: max(0, text.find(json.dumps(name)))].encode("utf-8", "replace")) for name in FIELDS]
    return None, None, fields, begins, kinds


def tokenize(df: DataFrame, key: str, raw: str, form: str) -> DataFrame:
    """Split raw records: key, reason, at (byte offset of the failure), fields, begins (their byte offsets), kinds.

    A null record is a record of no columns. Where the format is neither csv nor json, a record that begins with a brace is JSON.
    """
    schema = "key bigint, reason string, at int, fields array<string>, begins array<int>, kinds string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys, texts, forms = (c.to_pylist() for c in batch.columns)
                out: list[Token] = [("column_count", 0, None, None, None)] * len(keys)
                is_json = [f == "json" or (f != "csv" and (t or "").lstrip()[:1] == "{") for t, f in zip(texts, forms)]
                for read, wanted in ((tokenize_csv, False), (tokenize_json, True)):
                    at_ = [k for k, t in enumerate(texts) if t is not None and is_json[k] == wanted]
                    if at_:
                        for k, token in zip(at_, read([texts[k].encode("utf-8", "replace") for k in at_])):
                            out[k] = token
                kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["key", "reason", "at", "fields", "begins", "kinds"])

    return df.select(F.col(key).cast("bigint").alias("key"), raw, form).mapInArrow(run, schema)


def _invalid(name: str, n: int) -> Column:
    """Whether field ``n`` of a tokenized record breaks the rules of its column."""
    x, kind = F.col("fields")[n], F.substring("kinds", n + 1, 1)
    is_json = F.col("kinds").isNotNull()
    decimal = ~x.rlike(r"\A-?[0-9]{1,16}(\.[0-9]{1,4})?\z")
    rules = {
        "amount": decimal,
        "risk_score": decimal,
        "currency": ~x.rlike(r"\A[A-Za-z]{3}\z"),
        "source_country": ~x.rlike(r"\A[A-Za-z]{2}\z"),
        "destination_country": ~x.rlike(r"\A[A-Za-z]{2}\z"),
        "is_pep": ~x.isin("true", "false"),
        "flagged": ~x.isin("true", "false"),
        "transaction_timestamp": ~x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z")
        | F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNull(),
    }
    wanted = "n" if name in ("amount", "risk_score") else "b" if name in ("is_pep", "flagged") else "s"
    bad = F.coalesce(is_json & ~kind.isin(wanted, "z"), F.lit(False))
    if name in rules:
        bad = bad | F.coalesce(rules[name], F.lit(False))
    return bad | x.isNull() if n < REQUIRED else bad


def classify(tokens: DataFrame) -> DataFrame:
    """Add the verdict of the typed checks: reason stays null for records that load; ``bad_field`` names the column at fault, and ``at`` is where its value begins."""
    bad = F.coalesce(*(F.when(_invalid(name, n), F.lit(n)) for n, name in enumerate(FIELDS)))
    out = tokens.withColumn("__bad", F.when(F.col("reason").isNull(), bad))
    return (
        out.withColumn("bad_field", F.get(F.array(*map(F.lit, FIELDS)), "__bad"))
        .withColumn("at", F.coalesce(F.get("begins", "__bad"), "at"))
        .withColumn("reason", F.when(F.col("__bad").isNotNull(), F.lit("invalid_value")).otherwise(F.col("reason")))
        .drop("__bad")
    )


def bronze(classified: DataFrame) -> DataFrame:
    """The records that load, as typed rows of the bronze schema."""
    x = {name: F.col("fields")[n] for n, name in enumerate(FIELDS)}
    typed = {
        "amount": x["amount"].cast("decimal(20,4)"),
        "transaction_timestamp": F.try_to_timestamp(x["transaction_timestamp"], F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        "is_pep": x["is_pep"].cast("boolean"),
        "risk_score": x["risk_score"].cast("double"),
        "flagged": x["flagged"].cast("boolean"),
    }
    return classified.where("reason is null").select(F.col("key").alias("record_id"), *((typed.get(n, x[n])).alias(n) for n in FIELDS))
