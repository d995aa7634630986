"""Languages of documents and of their sentences by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
# Other codes and names of the languages.
CODES = {
    "de": "deu ger german deutsch", "en": "eng english", "es": "spa spanish español espanol castellano", "fr": "fra fre french français francais", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands", "pt": "por portuguese português portugues",
}
#: Longest character sequence of the models; bits of a character's number.
ORDER, BITS = 5, 7
#: The models are fitted on at most this many labelled documents a language of at most so many characters; all other figures cover all documents.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 5_000
#: Words of a sentence that counts, and words with letters among them.
WORDS, LETTERED = 6, 4
#: A sentence is taken when the best model's cross-entropy is at most this part of the way from the mean over held-out sentences of its own
#: language to the mean over those of the other languages, and when it is ahead of the second model by this many nats in all.
REACH, LEAD = 0.7, 6.0
#: A sentence without punctuation is cut in two where two languages explain it better than one by this many nats; and around an island of another
#: language that explains its words better by so many. Pieces are cut again.
CUT, ISLAND = 40.0, 60.0
#: Characters scored at a time; sentences longer than the second number are scored in pieces.
SLICE, LONGEST = 250_000, 20_000

_SPLIT = re.compile(r"(?:(?<=[.!?])|(?<=[.!?][\"”»)]))\s+(?=(?:>\s*)*[\"“«(¿¡]*[A-ZÀ-ÖØ-Þ0-9|])|\n\s*(?=\n)|\n\s*(?=\|)|(?<=\|)\s*\n")
_SHORT = re.compile(r"(?:^|[\s(])(?:[A-Z]\.[A-Z]|[A-Z]|INC|LTD|CORP|CO|DR|MR|MRS|NO|NR|REF)\.$")


def label_language(column: str) -> Column:
    """The language a label names, or null: case, regions and longer codes are read, unknown labels name none."""
    base = F.split(F.lower(F.trim(column)), r"[-_]")[0]
    table = {c: k for k, v in CODES.items() for c in [k, *v.split()]}
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[base]


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Where the sentences of a text begin and end; together they cover it but for white space between them. Very long ones come in pieces."""
    return [piece for a, b in _sentences(text) for piece in (_pieces(text, a, b) if b - a > LONGEST else [(a, b)])]


def _pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while b - a > LONGEST:
        cut = text.rfind(" ", a + 1, a + LONGEST)
        cut = cut if cut > 0 else a + LONGEST
        yield a, cut
        a = cut
    yield a, b


def _sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        # in capitals the next word doesn't tell whether a sentence begins
        if text[m.start() - 1 : m.start()] == "." and _SHORT.search(text[max(0, m.start() - 6) : m.start()]) and text[max(at, m.start() - 40) : m.start()].isupper():
            continue
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


_ASIDE = re.compile(r"(?m)^\s*(?:>\s*)+|[“«\"](?:[^\s“”«»\"]+\s+){0,4}[^\s“”«»\"]+[”»\"]|…[^…\n]{0,100}…")


def without_asides(text: str) -> str:
    """The text with blanks in place of reply marks, quotations of up to five words and fragments between ellipses."""
    return _ASIDE.sub(lambda m: " " * len(m[0]), text)


def prepared(sentence: str) -> str:
    """Lower case, numerals as one 0, without asides, single spaces, a space at either end."""
    return " " + re.sub(r"\s+", " ", re.sub(r"[0-9][0-9.,/:-]*", "0", without_asides(sentence).lower())).strip() + " "


@dataclass
class Model:
    """Sorted arrays of packed n-grams with log-probabilities, and of contexts with log back-off weights, by order; a column a language."""

    alphabet: np.ndarray
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    limit: np.ndarray
    temperature: float = 1.0

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 2, 1).astype(np.int64)

    def entropies(self, sentences: list[str]) -> np.ndarray:
        """Cross-entropy in nats a character of each prepared sentence under each language."""
        logs, starts, lengths, _ = self.char_logs(sentences)
        return -np.add.reduceat(logs, starts, axis=0) / lengths[:, None]

    def cuts(self, sentences: list[str]) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
        """Entropies as above; and for sentences that two languages share, the numbers of the words where the language changes.

        That is one word, the best cut in two, or the two ends of the island of another language in the sentence's best one with the greatest gain (the
        largest sum of a run of differences between the two).
        """
        logs, starts, lengths, x = self.char_logs(sentences)
        space = np.flatnonzero(x == self.encode(" ")[0])  # a sentence begins with one
        sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(np.add.reduceat(logs, space, axis=0), axis=0, dtype=np.float64)])
        first = np.searchsorted(space, starts)
        of = np.searchsorted(starts, space, "right") - 1
        before, after = sums[first], sums[np.append(first[1:], len(space))]
        whole = after - before
        gain = (sums[:-1] - before[of]).max(axis=1) + (after[of] - sums[:-1]).max(axis=1) - whole.max(axis=1)[of]
        found: dict[int, tuple[int, ...]] = {}
        for k in np.flatnonzero(gain >= CUT)[np.argsort(-gain[gain >= CUT], kind="stable")].tolist():
            i = int(of[k])
            if i not in found:
                word = k - int(first[i])
                if WORDS <= word <= sentences[i].count(" ") - 1 - WORDS:
                    found[i] = (word,)
        if len(space) == 0:
            return -whole / lengths[:, None], found
        # runs of words: sums up to each word against the least sum before it in the sentence, which sinks from sentence to sentence
        end = np.append(first[1:], len(space))
        own = sums[np.arange(len(of)), whole.argmax(axis=1)[of]]
        best_gain, best_begin, best_end = np.zeros(len(sentences)), np.zeros(len(sentences), np.int64), np.zeros(len(sentences), np.int64)
        own_before = before[np.arange(len(first)), whole.argmax(axis=1)]
        for l in range(len(LANGUAGES)):
            x_ = (sums[:-1, l] - before[of, l]) - (own - own_before[of])  # before each word
            fall = float(np.abs(x_).max() * 2 + 1) * of
            low = np.minimum.accumulate(x_ - fall) + fall
            begin = np.maximum.accumulate(np.where(x_ <= low, np.arange(len(x_)), 0))
            rise = x_ - low
            top = np.maximum.reduceat(rise, first)
            better = top > best_gain
            if better.any():
                at = np.flatnonzero(rise == top[of])
                last = dict(zip(of[at].tolist(), at.tolist()))
                for i in np.flatnonzero(better).tolist():
                    best_gain[i], best_end[i], best_begin[i] = top[i], last[i] - first[i], begin[last[i]] - first[i]
        for i in np.flatnonzero(best_gain >= ISLAND).tolist():
            a, b, n = int(best_begin[i]), int(best_end[i]), int(end[i] - first[i]) - 1
            if i not in found and a >= WORDS and b - a >= WORDS and n - b >= WORDS:
                found[i] = (a, b)
        return -whole / lengths[:, None], found

    def char_logs(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of each character under each language; one search finds all languages' entries."""
        lengths = np.array([len(s) for s in sentences])
        x = self.encode("".join(sentences))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        since = np.arange(len(x)) - np.repeat(starts, lengths)
        packed = [x]
        for n in range(1, ORDER):
            back = np.zeros_like(x)
            back[n:] = x[:-n]
            packed.append(packed[-1] | np.where(since >= n, back, 0) << (BITS * n))
        at = np.minimum(np.searchsorted(self.grams[-1], packed[-1]), len(self.grams[-1]) - 1)
        hit = self.grams[-1][at] == packed[-1]
        total = self.logs[-1][at]
        total[~hit] = 0
        open_, keys = np.flatnonzero(~hit), packed[-1][~hit]
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                keys = packed[n - 1][open_]
                at = np.minimum(np.searchsorted(self.grams[n - 1], keys), len(self.grams[n - 1]) - 1)
                hit = self.grams[n - 1][at] == keys
                total[open_[hit]] += self.logs[n - 1][at[hit]]
                open_, keys = open_[~hit], keys[~hit]
            if len(open_):
                context = keys >> BITS
                at = np.minimum(np.searchsorted(self.contexts[n - 1], context), len(self.contexts[n - 1]) - 1)
                seen = self.contexts[n - 1][at] == context
                total[open_[seen]] += self.backs[n - 1][at[seen]]
        total[open_] += np.float32(-np.log(1 << BITS))
        return total, starts, lengths, x

    def judge(self, entropy: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence the number of the best language, whether it is accepted, and the confidence."""
        best = entropy.argmin(axis=1)
        row = np.arange(len(best))
        low = entropy[row, best]
        lead = (np.partition(entropy, 1, axis=1)[:, 1] - low) * lengths
        score = -(entropy - low[:, None]) * lengths[:, None] / self.temperature
        confidence = 1 / np.exp(np.maximum(score, -60)).sum(axis=1)
        return best, (low <= self.limit[best]) & (lead >= LEAD), confidence


def _count(x: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams of each order with their counts: raw ones for the longest, numbers of different left neighbours for the others."""
    padded = [np.concatenate([np.zeros(ORDER - 1, np.int64), s]) for s in x]
    packed = []
    for s in padded:
        k = np.zeros(len(s) - ORDER + 1, np.int64)
        for n in range(ORDER):
            k = k << BITS | s[n : len(s) - ORDER + 1 + n]
        packed.append(k)
    keys, counts = np.unique(np.concatenate(packed), return_counts=True)
    out = [(keys, counts)]
    for n in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(out[-1][0] & ((1 << BITS * n) - 1), return_counts=True)
        out.append((keys, counts))
    return out[::-1]


def fit(texts: dict[str, list[str]]) -> Model:
    """Models from prepared sentences by language. P(w|h) = (c(hw) - D)+ / c(h) + D N(h) / c(h) P(w|h'), D from n1 and n2 of the order."""
    points = np.unique(np.concatenate([np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32) for s in texts.values() if s] or [np.array([32], np.uint32)]), return_counts=True)
    most = np.argsort(-points[1], kind="stable")[: (1 << BITS) - 3]
    m = Model(np.sort(points[0][most]), [], [], [], [], np.full(len(LANGUAGES), np.inf))
    counted = [_count([m.encode(s) for s in texts[k]]) if texts.get(k) else None for k in LANGUAGES]
    floor = 1.0 / (1 << BITS)
    for n in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([c[n - 1][0] for c in counted if c]))
        contexts = np.unique(grams >> BITS)
        p = np.empty((len(grams), len(LANGUAGES)))
        back = np.ones((len(contexts), len(LANGUAGES)))
        for l, c in enumerate(counted):
            lower = np.full(len(grams), floor) if n == 1 else np.exp(m.logs[n - 2][np.searchsorted(m.grams[n - 2], grams & ((1 << BITS * (n - 1)) - 1)), l].astype(float))
            if c is None:
                p[:, l] = lower
                continue
            keys, counts = c[n - 1]
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            own = np.searchsorted(contexts, keys >> BITS)
            total, kinds = np.bincount(own, counts, len(contexts)), np.bincount(own, minlength=len(contexts))
            seen = total > 0
            back[seen, l] = discount * kinds[seen] / total[seen]
            of = np.searchsorted(contexts, grams >> BITS)
            p[:, l] = back[of, l] * lower
            at = np.searchsorted(grams, keys)
            p[at, l] += (counts - discount) / total[of[at]]
        m.grams.append(grams)
        m.logs.append(np.log(p).astype(np.float32))
        m.contexts.append(contexts)
        m.backs.append(np.log(back).astype(np.float32))
    return m


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on labelled texts (language, text) of which some labels are wrong and some texts mixed.

    Texts are judged by models of the other half of the texts; those that these give to another language, and single such sentences,
    are left out, twice over. The limits of the rejection and the temperature of the confidence come from every fifth sentence, which
    is held out.
    """
    texts = []
    for lang, text in rows:
        ready = [prepared(text[a:b]) for a, b in split_sentences(text) if countable(text[a:b])]
        if ready:
            texts.append((lang, ready))
    by = lambda part: {k: [s for lang, ss in part if lang == k for s in ss] for k in LANGUAGES}
    clean = texts
    for _ in range(2 if len(texts) > 1 else 0):
        halves = [fit(by(clean[k::2])) for k in (0, 1)]
        kept = []
        scored = []
        for k in (0, 1):
            flat = [s for _, ready in clean[k::2] for s in ready]
            scored.append(iter(np.concatenate([halves[1 - k].entropies(flat[n : n + 2000]) for n in range(0, len(flat), 2000)])))
        for k, (lang, ready) in enumerate(clean):
            entropy = np.array([next(scored[k % 2]) for _ in ready])
            of_text = LANGUAGES[(entropy * np.array([[len(s)] for s in ready])).sum(axis=0).argmin()]
            ready = [s for s, b in zip(ready, entropy.argmin(axis=1)) if LANGUAGES[b] == lang]
            if of_text == lang and ready:
                kept.append((lang, ready))
        clean = kept or clean
    if not texts:  # nothing to learn from, so nothing is accepted
        model = fit({"en": [" "]})
        model.limit[:] = -np.inf
        return model
    flat = [(lang, [s]) for lang, ready in clean for s in ready]
    model = fit(by([x for k, x in enumerate(flat) if k % 5] or flat))
    held = [(lang, ss[0]) for k, (lang, ss) in enumerate(flat) if k % 5 == 0]
    if held:
        entropy = np.concatenate([model.entropies([s for _, s in held[k : k + 2000]]) for k in range(0, len(held), 2000)])
        truth = np.array([LANGUAGES.index(k) for k, _ in held])
        own = entropy[np.arange(len(held)), truth]
        for l in range(len(LANGUAGES)):
            if (truth == l).any() and (truth != l).any():
                mean = own[truth == l].mean()
                model.limit[l] = mean + REACH * (entropy[truth != l, l].mean() - mean)
        lengths = np.array([len(s) for _, s in held])
        gaps = (entropy - own[:, None]) * lengths[:, None]
        likely = lambda t: np.log(np.exp(np.maximum(-gaps / t, -60)).sum(axis=1)).mean()
        model.temperature = min((1.0, 1.5, 2.0, 3.0, 5.0, 8.0), key=likely)
    return model


def countable(sentence: str) -> bool:
    """Whether this is a whole sentence of enough words: most are of letters, and it isn't cut off by an ellipsis."""
    s = without_asides(sentence).strip()
    ws = s.split()
    if len(ws) < WORDS or s[0] == "…" or s[-1] == "…" or s.startswith("...") or s.endswith("..."):
        return False
    return sum(len(w) > 1 and w.strip(".,;:!?()\"“”«»'’").isalpha() for w in ws) >= LETTERED


def sample(documents: DataFrame, text: str, label: str) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS labelled texts a language, of longer ones their first SAMPLE_CHARS characters, chosen by a hash of the text. Copies count once."""
    rows = documents.select(label_language(label).alias("lang"), F.substring(text, 1, SAMPLE_CHARS).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not n:
        return []
    scale = 1_000_000
    keep = F.create_map(*(x for k, c in n.items() for x in (F.lit(k), F.lit(min(scale, scale * SAMPLE_DOCS // c + 1)))))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < keep[F.col("lang")]).distinct()
    taken: dict[str, int] = {}
    out = []
    for r in drawn.orderBy(F.xxhash64("text"), "text").limit(2 * SAMPLE_DOCS * len(LANGUAGES)).collect():
        if taken.setdefault(r["lang"], 0) < SAMPLE_DOCS:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["text"]))
    return out


def segments(documents: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """Runs of sentences in one language: doc_id, part, lang, confidence, begin, length, words, whole_sentence.

    ``begin`` and ``length`` are in characters; sentences that are rejected or too short to count have a null language and join no run.
    ``whole_sentence`` tells whether the run holds a counted sentence. Whole texts are read; a null or empty text has no segment.
    """
    schema = "doc_id bigint, part int, lang string, confidence double, begin int, length int, words int, whole_sentence boolean"
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def score(ready: list[str]) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
            entropies, cut, at = [], {}, 0
            while at < len(ready):
                end, size = at, 0
                while end < len(ready) and (size < SLICE or end == at):
                    size += len(ready[end])
                    end += 1
                entropy, found = m.cuts(ready[at:end])
                entropies.append(entropy)
                cut |= {at + k: w for k, w in found.items()}
                at = end
            return np.concatenate(entropies), cut

        def flush(parts: list[tuple[int, int, int, str, bool]]) -> pa.RecordBatch:
            # pieces are cut until no cut gains enough; each piece is shorter, so this ends
            whole, open_ = [], [(n, p) for n, p in enumerate(parts)]
            while open_:
                ready = [prepared(p[3]) for _, p in open_]
                entropy, cut = score(ready)
                rest = []
                for k, (n, (i, a, b, s, counted)) in enumerate(open_):
                    starts = [w.start() for w in re.finditer(r"\S+", without_asides(s))] if counted and k in cut else []
                    at = [0, *(starts[w] for w in cut[k]), len(s)] if starts else []
                    if len(at) > 2 and all(x < y for x, y in zip(at, at[1:])):
                        rest += [(n, (i, a + x, a + y, s[x:y], countable(s[x:y]))) for x, y in zip(at, at[1:])]
                    else:
                        whole.append((n, a, (i, a, b, s, counted), entropy[k], len(ready[k])))
                open_ = rest
            whole.sort(key=lambda x: x[:2])
            parts = [x[2] for x in whole]
            entropy, lengths = np.array([x[3] for x in whole]), np.array([x[4] for x in whole])
            best, taken, confidence = m.judge(entropy, lengths)
            out: list[list] = []
            for (i, a, b, s, counted), l, ok, c, n in zip(parts, best.tolist(), taken.tolist(), confidence.tolist(), lengths.tolist()):
                lang, k = LANGUAGES[l] if ok and counted else None, len(s.split())
                if lang and out and out[-1][0] == i and out[-1][2] == lang:
                    last = out[-1]
                    last[3] += c * n
                    last[8] += n
                    last[5], last[6], last[7] = b - last[4], last[6] + k, True
                else:
                    part = out[-1][1] + 1 if out and out[-1][0] == i else 0
                    out.append([i, part, lang, c * n if lang else 0.0, a, b - a, k, bool(lang), n])
            for r in out:
                r[3] = r[3] / r[8] if r[2] else None
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out))[:8], kinds)], ["doc_id", "part", "lang", "confidence", "begin", "length", "words", "whole_sentence"])

        parts: list = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in split_sentences(t):
                    s = t[a:b]
                    parts.append((i, a, b, s, countable(s)))
                    size += b - a
                if size >= SLICE:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return documents.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, schema)


def document_languages(parts: DataFrame) -> DataFrame:
    """One row for each document and language that at least one whole sentence is in: doc_id, lang, words, confidence."""
    return parts.where("whole_sentence").groupBy("doc_id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))


def relabelled(documents: DataFrame, doc_id: str, label: str, languages: DataFrame) -> DataFrame:
    """Documents whose label doesn't name exactly the languages of the text: doc_id, lang for each language."""
    found = languages.groupBy("doc_id").agg(F.sort_array(F.collect_set("lang")).alias("langs"))  # at most one entry a language
    labels = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), label_language(label).alias("named"))
    wrong = found.join(labels, "doc_id").where("size(langs) > 1 or named is null or named <> langs[0]")
    return wrong.select("doc_id", F.explode("langs").alias("lang")).distinct()
