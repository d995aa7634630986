"""The language models against their definition, on held-out documents, and on awkward texts."""

import os

import numpy as np
import pytest

from finweave.llm import langid

DATA = os.environ.get("FINWEAVE_DATA", "/root/testdata/sf0.01")
HAVE = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_probabilities_sum_to_one():
    m = langid.fit({"en": [langid.prepared(s) for s in ("the cat sat on the mat", "a cat and the dog", "dogs and cats ran")], "de": [langid.prepared(s) for s in ("die Katze sass auf der Matte", "ein Hund und die Katze")]})
    for lang in ("en", "de"):
        l = langid.LANGUAGES.index(lang)
        for context in ("", " th", "cat ", "zzzz", " die"):
            total = 0.0
            for n in range(1 << langid.BITS):
                x = [*m.encode(context).tolist(), n]
                keys = [sum(v << (langid.BITS * k) for k, v in enumerate(reversed(x[-k_:]))) for k_ in range(1, langid.ORDER + 1)]
                logp, done = 0.0, False
                for order in range(min(langid.ORDER, len(x)), 0, -1):
                    at = np.searchsorted(m.grams[order - 1], keys[order - 1])
                    if at < len(m.grams[order - 1]) and m.grams[order - 1][at] == keys[order - 1]:
                        logp, done = logp + float(m.logs[order - 1][at, l]), True
                        break
                    c = keys[order - 1] >> langid.BITS
                    at = np.searchsorted(m.contexts[order - 1], c)
                    if at < len(m.contexts[order - 1]) and m.contexts[order - 1][at] == c:
                        logp += float(m.backs[order - 1][at, l])
                total += np.exp(logp if done else logp - np.log(1 << langid.BITS))
            assert total == pytest.approx(1.0, abs=1e-3)


def test_batches_do_not_matter():
    m = langid.fit({"en": [" the cat sat on the mat "], "fr": [" le chat est sur le tapis "]})
    s = [langid.prepared(x) for x in ("the cat", "le chat est là", "x", "œuvre 😀")]
    together = m.entropies(s)
    assert np.allclose(together, np.concatenate([m.entropies([x]) for x in s]), atol=1e-5)
    assert np.allclose(m.cuts(s)[0], together, atol=1e-5)


@pytest.mark.parametrize("label, want", [("en", "en"), ("EN", "en"), ("eng", "en"), ("en-GB", "en"), ("fr_FR", "fr"), (" spa ", "es"), ("de-CH", "de"), ("und", None), ("", None), (None, None), ("??", None), ("unknown", None), ("pl", None)])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(langid.label_language("x")).first()[0] == want


def test_sentences():
    text = "First one here. Second S.A. keeps going?  Third\nwrapped line.\n\n| a | b |\nLast"
    assert [text[a:b] for a, b in langid.split_sentences(text)] == ["First one here.", "Second S.A. keeps going?", "Third\nwrapped line.", "| a | b |", "Last"]
    assert langid.split_sentences("") == []
    assert not langid.countable("… goods named on the bill for six …") and langid.countable("the goods named on the bill were late") and not langid.countable("| EUR 5 | GBP 6 | USD 7 |")
    assert langid.prepared("He said “Mit freundlichen Grüßen” on 12.5.2024") == " he said on 0 "


@HAVE
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(langid.sample(docs.where("doc_id % 2 = 0"), "text", "lang"))
    test = docs.where("doc_id % 2 = 1").select("doc_id", "text", langid.label_language("lang").alias("lang"))
    found = langid.document_languages(langid.segments(test, "doc_id", "text", model))
    single = found.groupBy("doc_id").count().where("count = 1").select("doc_id")
    joined = found.join(single, "doc_id").withColumnRenamed("lang", "got").join(test.where("lang is not null"), "doc_id").select("got", "lang").collect()
    right = sum(r["got"] == r["lang"] for r in joined) / len(joined)
    assert len(joined) > 300 and right > 0.9  # some 5 % of the labels are wrong on purpose


@HAVE
def test_segments(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(langid.sample(docs, "text", "lang"))
    english = "The customer explained that the money came from the sale of a warehouse in the north."
    german = "Der Kunde erklärte, dass das Geld aus dem Verkauf eines Hauses in der Stadt stammt."
    rows = [(1, f"{english} {german} {english}", "en"), (2, german.upper(), "x"), (3, None, "x"), (4, "", None), (5, "| 1 | 2 |", "x"), (6, f"{english} " * 2000, "EN-us"), (7, "qzx wvk jjq xkz pqv zzx wqk", "en"), (8, f"{english} “Mit freundlichen Grüßen”", "de"), (8, english, "de"), (9, german[:-1].replace(",", "") * 8000, "de")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, part string")
    parts = langid.segments(df, "doc_id", "text", model)
    got = {}
    for r in parts.orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append((r["lang"], r["begin"], r["length"]))
        assert r["confidence"] is None or 0 < r["confidence"] <= 1
    assert [x[0] for x in got[1]] == ["en", "de", "en"] and rows[0][1][got[1][1][1] :][: got[1][1][2]] == german
    assert [x[0] for x in got[2]] == ["de"] and 3 not in got and 4 not in got and got[5][0][0] is None and len(got[6]) == 1 and [x[0] for x in got[9]] == ["de"] and got[9][0][2] == len(rows[-1][1]) and got[7][0][0] is None
    wrong = langid.relabelled(df, "doc_id", "lang", langid.document_languages(parts)).collect()
    assert {tuple(r) for r in wrong} == {(1, "en"), (1, "de"), (2, "de"), (8, "en")}
    assert langid.segments(df.limit(0), "doc_id", "text", model).count() == 0


@HAVE
def test_unpunctuated_mixtures(spark):
    """Without punctuation a language in the middle of another is found, and so are three in a row."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(langid.sample(docs, "text", "lang"))
    english = "the customer explained that the money came from the sale of a warehouse in the north and would be moved to another bank before the summer"
    german = "der kunde hat uns nach dem gespräch erklärt dass das geld aus dem verkauf eines hauses in der stadt stammt und bald überwiesen wird"
    french = "le client explique que cette somme provient de la vente d'un entrepôt dans le nord et que le contrat de vente a été envoyé à la banque avant la fin du mois"
    rows = [(1, f"{english} {german} {english}"), (2, f"{english} {german} {french}"), (3, f"{german} {french} {german} {english}"), (4, f"{english} {english}"), (5, german)]
    got = {}
    for r in langid.segments(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", model).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["lang"])
    assert got == {1: ["en", "de", "en"], 2: ["en", "de", "fr"], 3: ["de", "fr", "de", "en"], 4: ["en"], 5: ["de"]}


def test_long_labelled_texts_are_learned_from(spark):
    df = spark.createDataFrame([(1, "Every labelled text of this language is long. " * 400, "en")], "doc_id bigint, text string, lang string")
    assert [(k, len(t)) for k, t in langid.sample(df, "text", "lang")] == [("en", langid.SAMPLE_CHARS)]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "Some words that nobody ever labelled in here.", None)], "doc_id bigint, text string, lang string")
    assert langid.sample(df, "text", "lang") == []
    model = langid.train([])
    assert [r["lang"] for r in langid.segments(df, "doc_id", "text", model).collect()] == [None]
    assert langid.train([("en", "Only one text of a few words here, nothing else.")]).entropies([" a "]).shape == (1, 7)
