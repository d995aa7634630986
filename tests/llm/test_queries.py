"""The queries of the training-data problems over whole tables of the smallest scale: what must hold of every row."""

import itertools
import os
from collections import defaultdict

import pytest

from finweave.llm import langid, leak, mixture, queries

DATA = os.environ.get("FINWEAVE_SMALL", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


@pytest.mark.parametrize("pairs, classes, group, text", [("p3_found", "p3_parties", "party", "name"), ("p7_found", "p7_places", "place", "address")])
def test_pairs_are_those_of_the_classes(spark, pairs, classes, group, text):
    members = defaultdict(list)
    for r in rows(spark, classes):
        members[r[group]].append(r["entity_id"])
    held = [r["entity_id"] for r in table(spark, "entities") if r["entity_id"] and (r[text] or "").strip()]
    assert sorted(i for m in members.values() for i in m) == sorted(held)
    got = [tuple(r) for r in rows(spark, pairs)]
    assert got and len(got) == len(set(got)) and set(got) == {p for m in members.values() for p in itertools.combinations(sorted(m), 2)}


def test_equal_addresses_are_one_place(spark):
    place = {r["entity_id"]: r["place"] for r in rows(spark, "p7_places")}
    by = defaultdict(set)
    for r in table(spark, "entities"):
        if r["entity_id"] in place:
            by[r["address"]].add(place[r["entity_id"]])
    assert all(len(p) == 1 for p in by.values())


def test_leaks_hold_their_passages(spark):
    """Each reported passage is in the document; and each verbatim run of sixteen counting words, by plain search, is reported."""
    found = rows(spark, "p8_passages")
    assert {tuple(r) for r in rows(spark, "p8_found")} == {(r["doc_id"], r["item_id"]) for r in found}
    docs = {r["doc_id"]: leak.words(r["text"]) for r in table(spark, "documents") if r["text"]}
    items = {x.item_id: x for x in leak.read_items([(r["item_id"], r["item_text"]) for r in table(spark, "eval_items") if r["item_text"]])}
    for r in found:
        assert leak.PASSAGE <= r["words"] and (r["words"] - r["unchanged"]) * leak.EDITS <= r["words"] and 0 <= r["at_word"] < len(docs[r["doc_id"]])
    joined = {i: f" {' '.join(w)} " for i, w in docs.items()}
    verbatim = set()
    for k, x in items.items():
        for a in range(len(x.words) - leak.PASSAGE + 1):
            if not any(x.house[a : a + leak.PASSAGE]):
                run = f" {' '.join(x.words[a : a + leak.PASSAGE])} "
                verbatim |= {(i, k) for i, t in joined.items() if run in t}
    assert verbatim and verbatim <= {(r["doc_id"], r["item_id"]) for r in found}


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer")
def test_mixture_has_its_shares(spark):
    mixed, shares = rows(spark, "p9_mixture"), {r["source"]: r for r in rows(spark, "p9_shares")}
    tokens, repeats, longest = defaultdict(int), defaultdict(int), max(r["n_tokens"] for r in mixed)
    for r in mixed:
        tokens[r["source"]] += r["n_tokens"]
        repeats[r["source"], r["doc_id"]] += 1
    total = sum(tokens.values())
    assert {s: r["tokens"] for s, r in shares.items() if r["tokens"]} == dict(tokens)
    assert all(n <= shares[s]["max_repeats"] for (s, _), n in repeats.items())
    for s, r in shares.items():
        assert r["actual_share"] == pytest.approx(tokens[s] / total) and abs(tokens[s] - r["reachable_share"] * total) <= 2 * longest
    assert sum(r["reachable_share"] for r in shares.values()) == pytest.approx(1) and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)


def test_languages_follow_their_segments(spark):
    text = {r["doc_id"]: r["text"] for r in table(spark, "documents")}
    label = {r["doc_id"]: r["lang"] for r in table(spark, "documents")}
    langs, at = defaultdict(set), defaultdict(int)
    for r in sorted(rows(spark, "p10_segments"), key=lambda r: (r["doc_id"], r["part"])):
        assert at[r["doc_id"]] <= r["begin"] and r["begin"] + r["length"] <= len(text[r["doc_id"]]) and (r["lang"] is None) == (r["confidence"] is None)
        at[r["doc_id"]] = r["begin"] + r["length"]
        if r["whole_sentence"]:
            assert 0 < r["confidence"] <= 1
            langs[r["doc_id"]].add(r["lang"])
    documents = rows(spark, "p10_documents")
    assert {r["doc_id"] for r in documents} == set(text) and {(r["doc_id"], r["lang"]) for r in documents if r["lang"]} == {(i, l) for i, ls in langs.items() for l in ls}
    codes = {c: k for k, v in langid.CODES.items() for c in [k, *v.split()]}
    named = {i: codes.get((l or "").strip().lower().replace("_", "-").split("-")[0]) for i, l in label.items()}
    assert {tuple(r) for r in rows(spark, "p10_found")} == {(i, l) for i, ls in langs.items() for l in ls if ls != {named[i]}}
