"""Multi-pattern search against plain search, and what counts as a leak."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from finweave.llm import leak

TEXT = st.text("abc", max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=4, max_size=9), min_size=1, max_size=12), st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 30))
def test_wu_manber(patterns, texts, lane):
    kept, leak.LANE = leak.LANE, lane
    try:
        index = leak.WuManber([p.encode() for p in patterns])
        got = set(index.search([t.encode() for t in texts]))
    finally:
        leak.LANE = kept
    want = {(n, i, k) for n, t in enumerate(texts) for k, p in enumerate(index.patterns) for i in range(len(t)) if t.encode().startswith(p, i)}
    assert got == want


def test_wu_manber_without_patterns():
    assert leak.WuManber([]).search([b"abc"]) == []


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9))) for _ in range(n)).capitalize() + "."


def test_leaks(spark):
    r = random.Random(2)
    house = "This note is meant for internal use only and must not be shared with any third parties."
    items = [(k, f"{sentence(r, 12)} {sentence(r, 11)} {house} {sentence(r, 9)}") for k in range(6)] + [(90, None), (91, "")]
    filler = lambda: sentence(r, 25)
    w = [t.split() for _, t in items[:6]]
    edited = w[2][:18]
    edited[5], edited[11] = "changed", "words"
    docs = [
        (1, f"{filler()} {items[0][1]} {filler()}"), (2, f"{filler()} {' '.join(w[1][:17]).upper()} {filler()}"), (3, f"{filler()}\n\n{'  '.join(edited)} {filler()}"), (4, f"{filler()} {' '.join(w[3][:13])} {filler()}"), (5, f"{filler()} {house} {filler()}"),
        (6, f"{filler()} {' - '.join(w[4][2:10])},\n{'; '.join(w[4][10:22])} {filler()}"), (7, None), (8, ""), (9, "word " * 30_000 + " ".join(w[5][:20]) + " word" * 30_000), (10, f"{' '.join(w[0][:18])} and then {' '.join(w[1][:20])}"),
        *((100 + k, filler()) for k in range(1200)),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, words string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, item_text string, doc_id string")
    out = leak.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()
    assert {(x["doc_id"], x["item_id"]) for x in out} == {(1, 0), (2, 1), (3, 2), (6, 4), (9, 5), (10, 0), (10, 1)}
    assert next(x for x in out if x["doc_id"] == 9)["at_word"] == 30_000
    whole = next(x for x in out if x["doc_id"] == 1)
    assert whole["words"] == whole["unchanged"] == 32
    hot = f"{items[3][1]} ref ACC-12345678, FC87654321 {sentence(r, 14)}"
    many = spark.createDataFrame([(k, hot if k % 3 == 0 else filler()) for k in range(90)], "doc_id bigint, text string")
    assert leak.leaks(many, "doc_id", "text", spark.createDataFrame([(1, hot)], "item_id bigint, item_text string"), "item_id", "item_text").count() == 30
    kept, leak.ITEMS_PER_BLOCK = leak.ITEMS_PER_BLOCK, 2
    try:
        assert {tuple(x) for x in leak.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()} == {tuple(x) for x in out}
    finally:
        leak.ITEMS_PER_BLOCK = kept
    assert leak.leaks(d.limit(0), "doc_id", "text", i, "item_id", "item_text").count() == 0 and leak.leaks(d, "doc_id", "text", i.limit(0), "item_id", "item_text").count() == 0


def test_hot_item_without_references(spark):
    """An item in a third of the corpus makes its own words common, but is found, also edited; texts of its template are not."""
    r = random.Random(5)
    name = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    form = lambda: f"Please tell {name()} that the {name()} statement of {name()} covers only the days before {name()} closed its account at {name()} and {name()} left."
    item = form()
    w = item.split()
    copies = {k: " ".join(x if n != k % len(w) else "changed" for n, x in enumerate(w)) if k % 2 else item for k in range(0, 300, 3)}
    docs = [(k, f"{sentence(r, 20)} {copies.get(k) or form()} {sentence(r, 9)}") for k in range(300)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, item_text string")
    assert {x["doc_id"] for x in leak.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()} == set(copies)


COMMON = "the a of and to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which said".split()


def test_ordinary_words_only(spark):
    """An item made of the commonest words of the corpus is found in however many documents it is, whole or with single words edited."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choices(COMMON, k=n)).capitalize() + "."
    item = text(40)
    edited = item.split()
    edited[3], edited[19], edited[31] = "people", "people", "people"
    for copies in (1, 2, 60, 200):
        docs = [(k, f"{text(30)} {(item if k % 2 else ' '.join(edited)) if k < copies else text(30)} {text(20)}") for k in range(300)]
        found = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(1, item)], "item_id bigint, item_text string"), "item_id", "item_text")
        assert {x["doc_id"] for x in found.collect()} == set(range(copies))


def test_texts_of_one_form_differ_in_names(spark):
    form = "After the interview in {} on {} the officer asked {} to explain why the firm {} had moved so much money abroad."
    fill = ("Torinales", "3.5.2024", "Viktor", "Belimex")
    item = form.format(*fill)
    docs = [(1, item), (2, form.format("Wimelburg", "9.7.2023", "Orla", "Tatrasil")), (3, form.format("Wimelburg", "9.7.2023", "Viktor", "Tatrasil")), (4, item.replace("officer", "clerk").upper()), (5, item.replace("Viktor ", ""))]
    found = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(1, item)], "item_id bigint, item_text string"), "item_id", "item_text")
    assert {x["doc_id"] for x in found.collect()} == {1, 4, 5}


def brute_leaked(item, run):
    """All parts of a passage by their definition."""
    best = 0
    for a in range(len(run)):
        for b in range(a + leak.PASSAGE, len(run) + 1):
            part = run[a:b]
            if part[0][1] and part[-1][1]:
                edits = sum(not x for _, x, _ in part) + sum(n for _, _, n in part[1:])
                lost, kept = sum(item.name[i] and not x for i, x, _ in part), sum(item.own[i] and x for i, x, _ in part)
                if edits * leak.EDITS <= b - a and (not lost or kept >= leak.KEPT * lost):
                    best = max(best, b - a)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([True] * 9 + [False]), st.sampled_from([0] * 9 + [1]), st.booleans(), st.booleans()), min_size=16, max_size=60))
def test_leaked_by_definition(marks):
    n = len(marks)
    item = leak.Item(1, ["w"] * n, [False] * n, [m[2] for m in marks], [m[2] and m[3] for m in marks])
    run = [(k, m[0], m[1] if m[0] else 0) for k, m in enumerate(marks)]
    got = leak.leaked(item, run)
    assert (got[0] if got else 0) == brute_leaked(item, run)


@settings(max_examples=200, deadline=None)
@given(st.integers(16, 40), st.data())
def test_filter_never_drops_a_leak(n, data):
    """Whatever is edited within the limits, the document keeps enough test strings and words to be aligned."""
    ws = [f"w{k}abc" for k in range(n)]
    (item,) = leak.read_items([(1, " ".join(ws))])
    doc = list(ws)
    for k in sorted(data.draw(st.sets(st.integers(1, n - 2), max_size=n // leak.EDITS)), reverse=True):
        doc[k : k + 1] = data.draw(st.sampled_from([["other"], [], [doc[k], "more"]]))
    index = leak.index_items([item])
    found = list(index.near(index.search.search(["".join(doc).encode()])))
    assert [(t, k) for t, k, _ in found] == [(0, 0)]
    lost = sum(w not in doc for w in ws)
    assert lost == 0 or n - lost < leak.KEPT * lost or leak.may_hold(item, set(doc))
