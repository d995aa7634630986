"""Passages of evaluation items inside corpus documents, found by Wu-Manber multi-pattern search."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of an item that a document must hold, changed words included.
PASSAGE = 16
#: Words of a test string.
WINDOW = 4
#: Edited words in a row that don't end a passage; one word in so many of a passage may be changed, dropped or added.
GAP, EDITS = 2, 8
#: A name or number that stands in at most so many items tells its item from others of the same form. A passage keeps at least so many of these for
#: each name or number it has changed: texts of one form differ just in these.
OWN_ITEMS, KEPT = 2, 2
#: Test strings are made of so many items at a time; the corpus is searched once for each block of items.
ITEMS_PER_BLOCK = 20_000
BLOCK, TABLE_BITS, LANE = 4, 20, 4096
_MARKS = re.compile(r"[^\w\s]|_")
_FOREIGN = re.compile(r"[^\x00-\x7f]")


@lru_cache(10_000)
def _bare(letters: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", letters) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Words as white space splits them, letters and digits only, without case and accents."""
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: _bare(m[0]), text)
    return _MARKS.sub("", text).split()


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text)


@dataclass
class Item:
    """An item's words; ``house`` marks words of sentences that stand in more than one item, ``name`` names and numbers, ``own`` those of few items."""

    item_id: int
    words: list[str]
    house: list[bool]
    name: list[bool]
    own: list[bool]

    @cached_property
    def counting(self) -> list[tuple[str, bool]]:
        return [(w, n) for w, h, n in zip(self.words, self.house, self.name) if not h]

    @cached_property
    def names(self) -> list[tuple[int, str]]:
        return [(k, w) for k, (w, n) in enumerate(self.counting) if n]

    @cached_property
    def own_words(self) -> Counter:
        return Counter(w for w, h, o in zip(self.words, self.house, self.own) if o and not h)


def names_in(sentence: str) -> list[tuple[str, bool]]:
    """The words of a sentence and whether each is a name or number: it has a digit or, within a sentence not all in capitals, a capital at its front."""
    loud, out = sentence.isupper(), []
    for token in sentence.split():
        if w := words(token):
            front = next((c for c in token if c.isalnum()), "")
            out.append((w[0], any(c.isdigit() for c in token) or bool(out) and front.isupper() and not loud))
    return out


def read_items(rows: list[tuple[int, str]]) -> list[Item]:
    texts = [(item_id, [names_in(s) for s in sentences(text)]) for item_id, text in rows]
    seen = Counter(s for _, text in texts for s in {" ".join(w for w, _ in x) for x in text})
    items = Counter(w for _, text in texts for w in {w for x in text for w, _ in x})
    out = []
    for item_id, text in texts:
        house = [seen[" ".join(w for w, _ in x)] > 1 and len(x) >= 5 for x in text for _ in x]
        flat = [y for x in text for y in x]
        out.append(Item(item_id, [w for w, _ in flat], house, [n for _, n in flat], [n and (items[w] <= OWN_ITEMS or not w.isalpha()) for w, n in flat]))
    return out


class WuManber:
    """Search for many byte strings: block shift tables, suffix-hash buckets, direct comparison."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(set(patterns))
        self.m = m = max(BLOCK, min(map(len, self.patterns), default=BLOCK))
        self.longest = max(map(len, self.patterns), default=m)
        self.shift = np.full(1 << TABLE_BITS, m - BLOCK + 1, np.int32)
        heads = np.frombuffer(b"".join(p[:m] for p in self.patterns), np.uint8).reshape(len(self.patterns), m)
        for j in range(m - BLOCK + 1):
            np.minimum.at(self.shift, self._hash(self._packed(heads[:, j : j + BLOCK])), m - BLOCK - j)
        self.suffix = self._hash(self._packed(heads[:, m - BLOCK :])).astype(np.int64)
        order = np.argsort(self.suffix, kind="stable")
        ends = np.frombuffer(b"".join(p[-BLOCK:] for p in self.patterns), np.uint8).reshape(len(self.patterns), BLOCK)
        self.suffix, self.order, self.prefix, self.end = self.suffix[order], order, self._packed(heads[:, :BLOCK])[order], self._packed(ends)[order]
        self.length = np.array([len(p) for p in self.patterns], np.int64)[order]

    @staticmethod
    def _packed(rows: np.ndarray) -> np.ndarray:
        v = rows[..., 0].astype(np.uint32)
        for k in range(1, BLOCK):
            v |= rows[..., k].astype(np.uint32) << np.uint32(8 * k)
        return v

    @staticmethod
    def _hash(packed: np.ndarray) -> np.ndarray:
        return (packed * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, position, pattern) of every occurrence. All texts are scanned side by side, long ones in overlapping lanes."""
        m = self.m
        data = b"".join(texts)
        if len(data) < m or not self.patterns:
            return []
        array = np.frombuffer(data, np.uint8)
        packed = self._packed(np.lib.stride_tricks.sliding_window_view(array, BLOCK))
        blocks = self._hash(packed)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        lanes = [(a, min(b, a + LANE + m - 1)) for s, b in zip(starts[:-1].tolist(), starts[1:].tolist()) for a in range(s, max(s + 1, b - m + 1), LANE)]
        at = np.array([a for a, _ in lanes], np.int64) + m - 1
        end = np.array([b for _, b in lanes], np.int64)
        live = at < end
        at, end, found = at[live], end[live], []
        while len(at):
            step = self.shift[blocks[at - (BLOCK - 1)]]
            if (stop := step == 0).any():
                found.append(at[stop])
                step = np.maximum(step, 1)
            at = at + step
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        if not found:
            return []
        at = np.concatenate(found)
        h = blocks[at - (BLOCK - 1)].astype(np.int64)
        low, high = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        # every position with each string of its bucket that begins and ends alike
        position = np.repeat(at - m + 1, high - low)
        string = np.arange(len(position)) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)
        alike = self.prefix[string] == packed[position]
        position, string = position[alike], string[alike]
        end = position + self.length[string]
        text = np.searchsorted(starts, position, "right") - 1
        alike = end <= starts[text + 1]
        alike[alike] = self.end[string[alike]] == packed[end[alike] - BLOCK]
        position, string, text = position[alike], self.order[string[alike]], text[alike]
        hits = zip(text.tolist(), (position - starts[text]).tolist(), string.tolist(), position.tolist())
        return [(t, at, k) for t, at, k, pos in hits if data.startswith(self.patterns[k], pos)]


def passages(item: Item, matcher: SequenceMatcher) -> Iterator[tuple[list[tuple[int, bool, int]], int, int]]:
    """The passages of the item in the matcher's second sequence: their counting words, and where they begin in the item and in the sequence.

    Runs of equal words form one passage while at most GAP words in a row differ. A counting word comes with its place, whether it is unchanged,
    and the number of words added before it. House words connect but don't count.
    """
    matcher.set_seq1(item.words)
    blocks = [b for b in matcher.get_matching_blocks() if b.size]
    k = 0
    while k < len(blocks):
        n = k
        run: list[tuple[int, bool, int]] = []
        added = 0
        while True:
            for i in range(blocks[n].a, blocks[n].a + blocks[n].size):
                if not item.house[i]:
                    run.append((i, True, added))
                added = 0
            a, b = blocks[n].a + blocks[n].size, blocks[n].b + blocks[n].size
            if n + 1 == len(blocks) or blocks[n + 1].a - a > GAP or blocks[n + 1].b - b > GAP:
                break
            run += [(i, False, 0) for i in range(a, blocks[n + 1].a) if not item.house[i]]
            added = max(0, blocks[n + 1].b - b - (blocks[n + 1].a - a))
            n += 1
        if len(run) >= PASSAGE:
            yield run, blocks[k].a, blocks[k].b
        k = n + 1


def leaked(item: Item, run: list[tuple[int, bool, int]]) -> tuple[int, int, int] | None:
    """The longest part of a passage that is a leak: its words, how many are unchanged, and the item's word it begins with; None if there is none.

    At least PASSAGE words, at most one in EDITS edited, and KEPT of the item's own names and numbers kept for each name or number changed. How often
    the words occur in the corpus plays no part, so an item is found in however many documents it is.
    """
    at = np.array([i for i, _, _ in run])
    same = np.array([x for _, x, _ in run])
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    edits = sums(~same + np.array([n for _, _, n in run]))
    names, own = np.array(item.name)[at], np.array(item.own)[at]
    kept, lost = sums(same & own), sums(~same & names)
    ends = np.flatnonzero(same) + 1
    best = None
    for a in np.flatnonzero(same).tolist():
        if len(run) - a < max(PASSAGE, best[0] + 1 if best else 0):
            break
        b = ends[ends >= a + PASSAGE]
        gone = lost[b] - lost[a]
        fits = b[((edits[b] - edits[a + 1]) * EDITS <= b - a) & ((gone == 0) | (kept[b] - kept[a] >= KEPT * gone))]
        if len(fits) and (best is None or fits[-1] - a > best[0]):
            best = int(fits[-1]) - a, int(same[a : fits[-1]].sum()), int(at[a])
    return best


def may_hold(item: Item, doc: set[str]) -> bool:
    """Whether a leak of the item can be in these words; never False for a leak.

    Every leak has PASSAGE counting words in a row of which at most one more than PASSAGE // EDITS are edited, and all names and numbers it keeps are in the item.
    """
    n = len(item.counting)
    if n < PASSAGE:
        return False
    kept = sum(item.own_words[w] for w in item.own_words.keys() & doc)
    if kept < KEPT:  # then a whole passage without a changed name is needed
        gone = [-1, *(k for k, w in item.names if w not in doc), n]
        if all(b - a <= PASSAGE for a, b in zip(gone, gone[1:])):
            return False
    gone = [(-1, False), *((k, name) for k, (w, name) in enumerate(item.counting) if w not in doc), (n, False)]
    for j, (begin, _) in enumerate(gone[:-1]):
        lost = 0
        for end, name in gone[j + 1 : j + PASSAGE // EDITS + 3]:
            if end - begin > PASSAGE and (not lost or kept >= KEPT * lost):
                return True
            lost += name
    return False


@dataclass
class Index:
    """A block of items with the test strings made of them and how many strings a leak has of each item; string k stands at the places first[k] to first[k + 1]."""

    items: list[Item]
    search: WuManber
    first: np.ndarray
    item: np.ndarray
    word: np.ndarray
    least: np.ndarray

    def near(self, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Texts and items that share enough test strings within PASSAGE words of the item, and where in the text those strings begin."""
        if not hits:
            return
        text, position, string = np.array(hits, np.int64).T
        count = self.first[string + 1] - self.first[string]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.first[string], count)
        text, position, item, word = np.repeat(text, count), np.repeat(position, count), self.item[place], self.word[place]
        pair = text * len(self.items) + item
        order = np.lexsort((word, pair))
        pair, word, position = pair[order], word[order], position[order]
        new = np.append(True, (np.diff(pair) != 0) | (np.diff(word) != 0))  # a string that occurs twice in a text counts once
        p, w = pair[new], word[new]
        far = np.arange(len(p)) + self.least[p % len(self.items)] - 1
        ok = far < len(p)
        ok[ok] = (p[far[ok]] == p[ok]) & (w[far[ok]] - w[ok] <= PASSAGE - WINDOW)
        keys = np.unique(p[ok])
        for key, a, b in zip(keys.tolist(), np.searchsorted(pair, keys, "left").tolist(), np.searchsorted(pair, keys, "right").tolist()):
            yield key // len(self.items), key % len(self.items), position[a:b]


def index_items(items: list[Item]) -> Index:
    """A leak has PASSAGE words in a row with so few edits that five test strings are whole in them; each break by house wording costs WINDOW - 1 of these."""
    places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    least = []
    for n, x in enumerate(items):
        order = list(accumulate((not h for h in x.house), initial=0))
        breaks = sum(not a and b and 0 < c < order[-1] for a, b, c in zip(x.house, x.house[1:], order[1:]))
        least.append(max(1, PASSAGE - PASSAGE // EDITS - (WINDOW - 1) * (PASSAGE // EDITS + 1 + breaks)))
        for k in range(len(x.words) - WINDOW + 1):
            pattern = "".join(x.words[k : k + WINDOW]).encode()
            if not any(x.house[k : k + WINDOW]) and len(pattern) >= BLOCK:
                places[pattern].append((n, order[k]))
    search = WuManber(list(places))
    flat = np.array([x for p in search.patterns for x in places[p]], np.int64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum([len(places[p]) for p in search.patterns])]).astype(np.int64)
    return Index(items, search, first, flat[:, 0], flat[:, 1], np.array(least, np.int64))


def leaks(documents: DataFrame, doc_id: str, text: str, eval_items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Documents with the items leaked into them: doc_id, item_id, words, unchanged, at_word.

    ``words`` is the length of the longest passage in the item's counting words, ``at_word`` where its stretch of like text begins in the document. Null or empty
    texts and items hold nothing; repeated items are found each; a passage that occurs twice in a document is reported once.
    The items are fixed test material; their index is built once and broadcast, in blocks of ITEMS_PER_BLOCK items, which bounds its size.
    """
    rows = [tuple(r) for r in eval_items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint"), item_text).orderBy(item_id).toLocalIterator()]
    items = read_items(rows)
    parts = [_search(documents, doc_id, text, index_items(items[k : k + ITEMS_PER_BLOCK])) for k in range(0, len(items), ITEMS_PER_BLOCK)]
    if not parts:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, words int, unchanged int, at_word int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _search(documents: DataFrame, doc_id: str, text: str, index: Index) -> DataFrame:
    """The leaks of one block of items: a document that holds enough test strings of an item close together and nearly all words of some passage is aligned with it."""
    shared = documents.sparkSession.sparkContext.broadcast(index)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        items = index.items
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, split = batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()]
                held: dict[int, set[str]] = {}
                begins: dict[int, np.ndarray] = {}
                matchers: dict[tuple[int, int, int], SequenceMatcher] = {}  # they index their second sequence once
                out = []
                for t, n, positions in index.near(index.search.search(["".join(ws).encode() for ws in split])):
                    if t not in held:
                        held[t] = set(split[t])
                    if not may_hold(items[n], held[t]):
                        continue
                    if t not in begins:
                        begins[t] = np.concatenate([[0], np.cumsum([len(w.encode()) for w in split[t]])])
                    reach = 2 * len(items[n].words)
                    spans: list[list[int]] = []
                    for w in sorted(set((np.searchsorted(begins[t], positions, "right") - 1).tolist())):
                        if spans and w - reach <= spans[-1][1]:
                            spans[-1][1] = min(w + reach, len(split[t]))
                        else:
                            spans.append([max(0, w - reach), min(w + reach, len(split[t]))])
                    for a, b in spans:
                        place = t, a, b
                        if place not in matchers:
                            matchers[place] = SequenceMatcher(None, b=split[t][a:b], autojunk=False)
                        for passage, _, first in passages(items[n], matchers[place]):
                            if best := leaked(items[n], passage):
                                out.append((ids[t], items[n].item_id, n, best[0], best[1], first + a))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "item_id", "n", "words", "unchanged", "at_word"])

    found = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, "doc_id bigint, item_id bigint, n int, words int, unchanged int, at_word int")
    best = F.max(F.struct("words", "unchanged", "at_word")).alias("best")
    return found.groupBy("doc_id", "item_id", "n").agg(best).select("doc_id", "item_id", "best.words", "best.unchanged", "best.at_word")
