"""Linking rows of one person or organisation whose name is spelled in several ways."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.spelling import allowed, distance, fold, key, meet, neighbourhood, plain
from finweave.operators.components import connected_components, pairs_within
from finweave.session import materialize

# Short and foreign forms of given names.
NICKNAMES = {
    "andrew": "andy drew andreas", "anthony": "tony anton", "benjamin": "ben benny", "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dotty dolly dorothea", "henry": "harry hank henri", "john": "jack johnny jon",
    "joseph": "joe joey jose", "matthew": "matt matthias", "samuel": "sam sammy", "thomas": "tom tommy", "abdelkader": "abdel kader abdul abd abdulkadir abdelqader", "aleksandra": "alexandra sasha ola sandra", "alexander": "alex sandy aleksandr alexandre sascha",
    "amara": "", "antonio": "tony toni anton", "bjorn": "bjoern", "charles": "chas chuck charlie carl karl", "christopher": "chris kit kristof christoph topher",
    "clara": "klara", "dmitri": "dima dmitry dimitri mitya", "edward": "ed eddie ned ted eduard", "eleanor": "ellie nell leonor elinor nora", "elizabeth": "beth liz betty eliza lisa elisabeth",
    "emeka": "chukwuemeka", "farida": "fareeda", "francisco": "frank paco fran pancho", "francois": "franck frans frank", "frederick": "fred freddy friedrich fritz freddie",
    "gabriela": "gabi gaby gabriella", "giuseppe": "peppe beppe joseph", "goran": "goeran", "guadalupe": "lupita lupe", "hannelore": "lore hanne", "hiroko": "hiro", "hugo": "hugh",
    "ikechukwu": "kechi ike", "ingrid": "inga", "irena": "irene ira", "james": "jas jim jimmy jamie", "joaquim": "joaquin quim", "johann": "jan hans john johannes", "jose": "pepe joseph",
    "jurgen": "jorg juergen", "katherine": "kathy kate katie catherine kat kath", "kenji": "ken", "kofi": "", "larissa": "lara", "leila": "layla", "malik": "malek",
    "margaret": "maggie meg peggy marge", "marta": "martha", "michael": "mike mick mikhail michel", "mohammed": "mohd muhammad mohamed mo", "natalia": "natasha nata natalie talia nathalie",
    "nicholas": "nick niko nicolas nikolaus nico", "noor": "nur", "oluwaseun": "seun olu", "orla": "orlagh", "oskar": "oscar", "patricia": "pat trish patty", "petra": "", "priya": "",
    "quentin": "quint quinn", "rajendra": "raj rajinder rajen", "richard": "rick dick rich", "robert": "bob rob bert bobby", "rosa": "rose rosie", "ruben": "reuben", "samir": "sameer sam",
    "siobhan": "chevonne shevaun shivaun", "stefan": "steve stephan stephen steffen", "susanna": "sue zuzana susan susie", "thandi": "thandiwe", "theodore": "ted teddy theo", "tomasz": "tom thomas",
    "ursula": "ulla uschi", "viktor": "victor vic", "wilhelmina": "wilma mina willa", "william": "wm bill will billy liam", "xiaoling": "ling hsiaoling hsiao", "yusuf": "yousef youssef joseph yousuf", "zsofia": "sophia sofia zsofi sophie",
}
# Given names that are written in several words.
PHRASES = {"abdul qadir": "abdelkader", "abd el kader": "abdelkader", "abd al qadir": "abdelkader", "abdel kader": "abdelkader", "hsiao ling": "xiaoling", "xiao ling": "xiaoling"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "sr", "sra", "mme", "mlle", "m.", "sir", "madam"}
# Legal forms and their spellings, without marks.
FORMS = {
    "ltd": "ltd limited", "inc": "inc incorporated", "corp": "corp corporation", "company": "co company", "llc": "llc", "gmbh": "gmbh gesellschaftmbh gesellschaftmitbeschrankterhaftung",
    "sa": "sa sociedadanonima societeanonyme", "bv": "bv beslotenvennootschap", "ag": "ag aktiengesellschaft", "plc": "plc", "srl": "srl", "nv": "nv",
}
# Words of business names and their abbreviations.
LINES = {
    "trading": "trdg trad", "construction": "constr", "properties": "props prop", "commodities": "commod comm", "shipping": "shpg ship", "petroleum": "petr petrol", "chemicals": "chem", "machinery": "mach",
    "pharmaceuticals": "pharma pharm", "electronics": "elec electr", "insurance": "ins insur", "holdings": "hldgs hold", "textiles": "textl text tex", "consulting": "consltg cons consult", "logistics": "logist log", "jewellery": "jewel jewelry jwl",
    "foods": "food", "motors": "motor mot", "metals": "metal met", "timber": "timb", "credit": "", "savings": "", "clearing": "", "bank": "", "exchange": "", "trust": "",
}
MIDDLES = {"general": "gen", "brothers": "bros", "international": "intl int", "associated": "assoc assd"}

_NICK: dict[str, set[str]] = {}
for _k, _v in NICKNAMES.items():
    for _w in [_k, *_v.split()]:
        _NICK.setdefault(fold(_w), set()).add(_k)
_FORM = {w: k for k, v in FORMS.items() for w in v.split()}
_WORD = {fold(w): k for table in (LINES, MIDDLES) for k, v in table.items() for w in [k, *v.split()]}


@lru_cache(100_000)
def person(name: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given names in order and surname parts in plain letters; initials keep one letter, abbreviations their point."""
    text = re.sub(r"\([^)]*\)", " ", name)
    head, comma, tail = text.partition(",")

    def words(s: str) -> list[str]:
        return [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?(?:-[^\W\d_]+)*", s) if plain(w).rstrip(".") not in TITLES]

    def folded(ws: list[str]) -> list[str]:
        joined = plain(re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", " ".join(ws)).replace("-", " "))
        for phrase, one in PHRASES.items():
            joined = re.sub(rf"\b{phrase}\b", one, joined)
        return [p.rstrip(".") + ("." if p.endswith(".") and len(p) > 2 else "") for p in joined.replace("'", "").replace("’", "").split() if p.strip(".")]

    if comma:
        return tuple(folded(words(tail))), tuple(folded(words(head)))
    ws = words(text)
    if not ws:
        return (), ()
    long = [w for w in ws if len(w.rstrip(".")) > 1]
    upper = [w for w in long if w.isupper()]
    if upper and len(upper) < len(long):
        last = upper
    elif double := [w for w in ws if "-" in w and not any(fold(plain(p)) in _NICK for p in w.split("-"))]:
        last = double
    elif len(ws[-1].rstrip(".")) <= 1 or (ws[-1].endswith(".") and len(ws) > 1):
        last = ws[: next((k for k, w in enumerate(ws) if len(w.rstrip(".")) <= 1 or w.endswith(".")), 1)] or [ws[0]]
    elif len(ws) > 1 and fold(plain(ws[-1])) in _NICK and fold(plain(ws[0])) not in _NICK and len(ws[0].rstrip(".")) > 1:
        last = [ws[0]]
    else:
        last = [ws[-1]]
    return tuple(folded([w for w in ws if w not in last])), tuple(folded(last))


@lru_cache(100_000)
def organisation(name: str) -> tuple[tuple[str, ...], str, str]:
    """Words of the name, legal form ('' if none), letters of an acronym ('' if none).

    Words of LINES and MIDDLES come in full, other words in plain letters.
    """
    text = re.sub(r"\b(t/a|trading as|dba)\b.*", " ", plain(name))
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", "") + " ", text)
    front = re.match(r"\s*([A-Za-z]{2,4})\s*\(\s*(\w)", name)
    front = front if front and front[1][0].lower() == front[2].lower() else None
    text = re.sub(r"[^a-z.\s]", " ", text)
    text = re.sub(r"\b(gesellschaft) (mbh|mit beschrankter haftung)\b", lambda m: m[1] + m[2].replace(" ", ""), text)
    text = re.sub(r"\b(sociedad anonima|societe anonyme|besloten vennootschap)\b", lambda m: m[1].replace(" ", ""), text)
    words, form, acronym = [], "", ""
    for w in text.split():
        w = w.strip(".")
        if not w or w in ("the", "und", "and", "of", "de"):
            continue
        if w in _FORM:
            form = form or _FORM[w]
        elif front and not words and not acronym and w == front[1].lower():
            acronym = w
        else:
            words.append(_WORD.get(fold(w), w) if len(w) > 1 else w)
    if len(words) == 1 and len(words[0]) <= 5 and words[0] not in LINES and re.search(r"(?:[A-Za-z]\.){2,}", name):
        bare = re.search(r"((?:[A-Za-z]\.){2,})", name)[1].replace(".", "").lower()
        if bare not in _FORM:
            acronym, words = bare, []
    fixed = []
    for w in words:
        if len(w) > 4 and w not in LINES and w not in MIDDLES:
            near = [k for f, k in _WORD.items() if len(f) >= 5 and distance(f, fold(w), 1) <= 1]
            w = near[0] if near else w
        fixed.append(w)
    return tuple(fixed), form, acronym


@lru_cache(300_000)
def similar(a: str, b: str, more: int = 0) -> float:
    """How well two tokens stand for one word: 1 the same, less for typos, nicknames, abbreviations and initials, 0 not at all.

    ``more`` raises the number of typos allowed.
    """
    if a == b:
        return 1.0
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) == 1 or len(y) == 1:
        if fold(x[0]) == fold(y[0]):
            return 0.5
        one, word = (x, fold(y)) if len(x) == 1 else (y, fold(x))
        return 0.4 if any(w[0] == one for k in _NICK.get(word, ()) for w in [k, *NICKNAMES[k].split()]) else 0.0
    u, v = fold(x), fold(y)
    if u == v:
        return 0.95
    if _NICK.get(u) and _NICK.get(v):
        return 0.9 if _NICK[u] & _NICK[v] else 0.0
    if (len(x) >= 3 or a.endswith(".")) and (y.startswith(x) or v.startswith(u)) or (len(y) >= 3 or b.endswith(".")) and (x.startswith(y) or u.startswith(v)):
        return 0.8
    most = allowed(x, y) + more
    d = min(distance(x, y, most), distance(u, v, most))
    if d <= most and (d <= 2 or meet(u, v)):  # never more than the index finds
        return 0.9 - 0.1 * d
    for given, other in ((u, v), (v, u)):
        if len(other) >= 4 and any(len(n := fold(w)) >= 4 and distance(n, other, 1) <= 1 for k in _NICK.get(given, ()) for w in [k, *NICKNAMES[k].split()]):
            return 0.7
    return 0.0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, list[tuple[int, int]]]:
    """The assignment of tokens with the greatest total similarity, and its pairs: over sets of used tokens, for long names by the Hungarian method."""
    if len(a) > len(b):
        total, pairs = align(b, a)
        return total, [(j, i) for i, j in pairs]
    if len(a) > 8 or len(b) > 12:
        return _align_long(a, b)
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for i, x in enumerate(a):
        new = dict(best)
        for used, (total, pairs) in best.items():
            for j, y in enumerate(b):
                if not used >> j & 1 and (s := similar(x, y)):
                    s -= 0.01 * abs(i - j)
                    if new.get(used | 1 << j, (-1.0,))[0] < total + s:
                        new[used | 1 << j] = (total + s, (*pairs, (i, j)))
        best = new
    total, pairs = max(best.values(), key=lambda t: t[0])
    return total, list(pairs)


def _align_long(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, list[tuple[int, int]]]:
    """``align`` in cubic time, by shortest augmenting paths with potentials; ``a`` isn't longer than ``b``. Tokens that gain nothing stay unassigned."""
    gain = [[max(0.0, s - 0.01 * abs(i - j)) if (s := similar(x, y)) else 0.0 for j, y in enumerate(b)] for i, x in enumerate(a)]
    n, m = len(a), len(b)
    u, v, row, back = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], at = i, 0
        least, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while row[at]:
            done[at] = True
            k, step, to = row[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -gain[k - 1][j - 1] - u[k] - v[j]
                    if cost < least[j]:
                        least[j], back[j] = cost, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            row[at] = row[back[at]]
            at = back[at]
    pairs = sorted((row[j] - 1, j - 1) for j in range(1, m + 1) if row[j] and gain[row[j] - 1][j - 1] > 0)
    return sum(gain[i][j] for i, j in pairs), pairs


def _rest(x: tuple[str, ...], pairs: list[tuple[int, int]], side: int) -> list[int]:
    used = {p[side] for p in pairs}
    return [i for i in range(len(x)) if i not in used]


def _settled(x: tuple[str, ...], y: tuple[str, ...]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The alignment and what it leaves over, after words written apart or together and one heavier misspelling are settled."""
    _, pairs = align(x, y)
    a, b = _rest(x, pairs, 0), _rest(y, pairs, 1)
    if a and b:
        one, two = "".join(x[i] for i in a), "".join(y[j] for j in b)
        if len(a) != len(b) and similar(one, two):
            return [*pairs, (a[0], b[0])], [], []
        if len(a) == len(b) == 1 and pairs and min(len(one), len(two)) >= 4 and all(similar(x[i], y[j]) >= 0.9 for i, j in pairs) and similar(one, two, 1):
            return [*pairs, (a[0], b[0])], [], []
    elif a or b:
        (long, short), at = ((x, y), 0) if a else ((y, x), 1)
        for i in range(len(long) - 1):
            for k in range(len(short)):
                if len(short[k]) >= 8 and similar(long[i] + long[i + 1], short[k]) > 0.6 and not similar(long[i], short[k]) == 1.0:
                    rest = [n for n in (a or b) if n not in (i, i + 1)]
                    return pairs, rest if at == 0 else [], rest if at == 1 else []
    return pairs, a, b


def _same_person(a: str, b: str) -> bool:
    (given_a, last_a), (given_b, last_b) = person(a), person(b)
    if not last_a or not last_b:
        return False
    x, y = given_a + last_a, given_b + last_b
    pairs, left_a, left_b = _settled(x, y)
    if left_a and left_b:  # a middle name left out on one side, a part of a double surname on the other
        middle = lambda left, given: all(0 < i < len(given) for i in left)
        part = lambda left, given: all(i >= len(given) for i in left)
        if not (middle(left_a, given_a) and part(left_b, given_b) or part(left_a, given_a) and middle(left_b, given_b)):
            return False
    strong = [(i, j) for i, j in pairs if len(x[i].rstrip(".")) > 1 and len(y[j].rstrip(".")) > 1]
    if not any(i >= len(given_a) or j >= len(given_b) for i, j in strong):
        return False
    if given_a and given_b and not similar(given_a[0], given_b[0], 1):
        return any({i, j} & {0} and similar(x[i], y[j]) >= 0.7 for i, j in pairs if i == 0 and j == 0)
    return bool(given_a) == bool(given_b)


def _same_organisation(a: str, b: str) -> bool:
    (x, form_a, short_a), (y, form_b, short_b) = organisation(a), organisation(b)
    if form_a and form_b and form_a != form_b:
        return False
    if not x or not y:
        if not x and not y:
            return bool(short_a) and short_a == short_b
        if short_a and short_a == short_b:
            return True
        words, short = (y, short_a) if not x else (x, short_b)
        letters = "".join(fold(w[0]) for w in words)
        return len(short) >= 2 and sorted("".join(fold(c) for c in short)) == sorted(letters)
    pairs, left_a, left_b = _settled(x, y)
    if left_a and left_b:
        return False
    left = [x[i] for i in left_a] + [y[j] for j in left_b]
    if any(len(w) > 1 and w not in MIDDLES for w in left):
        return False
    if not any(len(x[i]) > 1 and len(y[j]) > 1 and x[i] not in LINES and x[i] not in MIDDLES for i, j in pairs):
        return False
    return all(w[0] in (short_a if left_b else short_b) for w in left)


@lru_cache(500_000)
def same_name(a: str, b: str, is_person: bool) -> bool:
    """Whether two names are forms of one name; equal ones are."""
    if plain(a).split() == plain(b).split() != []:
        return True
    return _same_person(a, b) if is_person else _same_organisation(a, b)


def index_keys(name: str, is_person: bool) -> list[tuple[int, bool, bool]]:
    """Keys by which forms of a name meet: (key, rough, short). Two names meet in a key that isn't rough, or in a rough one that either has as a short form.

    Keys are the members of the symmetric-delete neighbourhoods of the telling tokens: surnames, and words other than those of business in general and common given
    names. Surnames that are given names too meet by these. Rough keys are the first two letters of telling tokens, by which abbreviated ones find them, and
    an organisation's first letter, by which bare acronyms find it.
    """
    out: dict[tuple[int, bool], bool] = {}

    def add(text: str, rough: bool = False, short: bool = False) -> None:
        k = key(text), rough
        out[k] = out.get(k, False) or short

    if is_person:
        given, last = person(name)
        tokens = [(t, fold(t.rstrip("."))) for t in last] + [(t, fold(t.rstrip("."))) for t in given if fold(t.rstrip(".")) not in _NICK]
        tokens = [(t, f) for t, f in tokens if len(f) > 2 or t.endswith(".")] or [(t, fold(t.rstrip("."))) for t in given + last]
        for _, f in tokens:
            for k in _NICK.get(f, ()):
                add("\2" + k)
    else:
        words, _, acronym = organisation(name)
        tokens = [(w, fold(w)) for w in words if w not in LINES and w not in MIDDLES and len(w) > 2] or [(w, fold(w)) for w in words if len(w) > 2]
        letters = acronym or "".join(w[0] for w in words)
        for c in {fold(c) for c in letters} if not words else {fold(letters[:1])}:
            if c:
                add("\0" + c, True, not words)
    for t, f in tokens:
        for m in neighbourhood(f):
            add(m)
        add("\1" + f[:2], True, len(f) <= 4 or t.endswith("."))
    return [(k, rough, short) for (k, rough), short in out.items()]


_KEYS = pa.list_(pa.struct([("k", pa.int64()), ("rough", pa.bool_()), ("short", pa.bool_())]))


def _index(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = [[{"k": k, "rough": r, "short": s} for k, r, s in index_keys(n, p)] for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, _KEYS)], ["node", "keys"])

    return nodes.select("node", "name", "is_person").mapInArrow(run, "node binary, keys array<struct<k: bigint, rough: boolean, short: boolean>>")


def prepare(entities: DataFrame) -> DataFrame:
    """The columns that matter, cleaned: entity_id, name, is_person, nid, dob, accounts, node. Rows without id or name can't be linked.

    ``node`` stands for all rows that are sure to be one party: those with one name, national_id and dob, if either is known; else each of the row's accounts
    is a node with the name, all of one party. So however many rows repeat a name with one attribute, they are compared once. Its number has 128 bits.
    """
    nid = F.nullif(F.upper(F.regexp_replace("national_id", r"[\s\-]", "")), F.lit(""))
    rows = entities.where("entity_id is not null and trim(name) <> ''").select(
        "entity_id", "name", (F.coalesce("entity_type", F.lit("")) == "INDIVIDUAL").alias("is_person"), nid.alias("nid"), F.nullif(F.trim("dob"), F.lit("")).alias("dob"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce("account_numbers", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))).alias("accounts"),
    )
    number = lambda *c: F.unhex(F.md5(F.to_json(F.struct("name", "is_person", *c))))
    by_account = F.transform("accounts", lambda x: number(x.alias("account")))
    known = F.col("nid").isNotNull() | F.col("dob").isNotNull()
    nodes = F.when(known, F.array(number("nid", "dob"))).when(F.size("accounts") > 0, by_account).otherwise(F.array(F.unhex(F.md5(F.to_json(F.struct("entity_id"))))))
    return rows.distinct().withColumn("nodes", nodes)


def attributes(rows: DataFrame) -> DataFrame:
    """What nodes agree by: node, attr; values that one node alone has are left out."""
    hashed = lambda kind, x: F.xxhash64(F.lit(kind), x)
    own = F.array_compact(F.array(F.when(F.col("nid").isNotNull(), hashed("nid", F.col("nid"))), F.when(F.col("dob").isNotNull(), hashed("dob", F.col("dob")))))
    known = rows.where("nid is not null or dob is not null").select(F.col("nodes")[0].alias("node"), F.explode(F.concat(own, F.transform("accounts", lambda x: hashed("account", x)))).alias("attr"))
    others = rows.where("nid is null and dob is null").select(F.explode(F.arrays_zip("nodes", "accounts")).alias("x")).where("x.accounts is not null").select("x.nodes", hashed("account", F.col("x.accounts")))
    attrs = materialize(known.union(others).distinct(), "names-attributes")
    shared = attrs.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("attr")
    return attrs.join(shared, "attr")


def candidates(attrs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that agree in an attribute and whose names meet in the index: a < b.

    The join key is the hash of attribute value and index key, so a value that a third of all rows hold is split by name; the value's own
    hash is compared besides.
    """
    index = attrs.join(_index(nodes), "node").select("node", "attr", F.explode("keys").alias("x")).select(F.xxhash64("attr", "x.k").alias("k"), "attr", "node", F.col("x.rough").alias("rough"), F.col("x.short").alias("short"))
    right = index.select("k", F.col("attr").alias("attr_b"), F.col("node").alias("b"), F.col("rough").alias("rough_b"), F.col("short").alias("short_b"))  # the same columns, so that the exchange is reused
    met = index.withColumnRenamed("node", "a").join(right, "k").where("a < b and attr = attr_b and rough = rough_b and (not rough or short or short_b)")
    return met.select("a", "b").distinct()


def links(rows: DataFrame) -> DataFrame:
    """Verified pairs of nodes: an attribute agrees, names are forms of one name, neither national_id nor dob contradicts; and the nodes of one row."""
    nodes = rows.select(F.explode("nodes").alias("node"), "name", "is_person", "nid", "dob").distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("name", "is_person", "nid", "dob")))
    against = F.coalesce(F.col("nid_a") != F.col("nid_b"), F.lit(False)) | F.coalesce(F.col("dob_a") != F.col("dob_b"), F.lit(False))
    met = candidates(attributes(rows), nodes).join(side("a"), "a").join(side("b"), "b").where(~against & (F.col("is_person_a") == F.col("is_person_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, p = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = pa.array([same_name(*sorted((x, y)), z) for x, y, z in zip(a, b, p)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    verified = met.select("a", "b", "name_a", "name_b", "is_person_a").mapInArrow(run, "a binary, b binary")
    of_a_row = rows.where(F.size("nodes") > 1).select(F.col("nodes")[0].alias("a"), F.explode(F.slice("nodes", F.lit(2), F.size("nodes"))).alias("b")).distinct()
    return verified.union(of_a_row)


def parties(entities: DataFrame) -> DataFrame:
    """Each row with an id and a name, and its party: entity_id, party. Rows without a link are a party of their own."""
    rows = materialize(prepare(entities), "names-rows")
    groups = materialize(connected_components(materialize(links(rows), "names-links")), "names-groups")
    # an id in several rows is one row for the result, so its nodes are one party
    member = rows.select("entity_id", F.col("nodes")[0].alias("node")).distinct().join(groups, "node", "left").select("entity_id", F.hex(F.coalesce("component", "node")).alias("party")).distinct()
    return member


def same_party(entities: DataFrame) -> DataFrame:
    """All pairs of rows of one party, links and chains of links: entity_id_a < entity_id_b.

    Rows with a null id or an empty name are in no pair; an id that occurs in several rows is one row for the result.
    """
    return pairs_within(materialize(parties(entities), "names-parties"), "party", "entity_id")
