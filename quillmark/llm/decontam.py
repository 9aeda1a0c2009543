"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage with block-max WAND.

An item's score for a passage is BM25 (the passage's distinct words are the
query, the item is the document) over the score that the item gets for itself,
so 1 is the whole item and one threshold holds for all. Passages are windows
of twice the words that the items of a class of lengths may have, half a window
apart, so each copy of an item lies whole in some window.

A search goes document at a time over posting lists in blocks that know their
largest weight: the pivot is the first list at which the sum of the lists'
largest weights reaches the threshold, a block sum below it skips to the end
of the nearest block. All items at or above the threshold are found. Before
that, the same bound is applied to all windows of a batch at once: an item's
commonest words (together under ``threshold - slack`` of its weight) are set
aside, and only windows in which its other words add up to the rest are
searched. No window that could reach the threshold is lost.

What is found is verified: the shares of the word n-grams of the item's
question and of its answer that the passage has must both reach ``overlap``,
or all of the item's n-grams together ``whole``. An item without an answer
column is divided before its last sentence.

The items go to the executors in blocks of ``block_items``, and every block is
searched by all passages, so what is broadcast has a bound. A block has an
index for each class of item lengths (powers of four), whose windows its
passages are cut into; document frequencies and the mean length are those of
all items. So what is found doesn't depend on the blocks.

Cases: null and empty texts and items have no words and match nothing; rows
without id are searched and reported without id; repeated rows are reported
each; of windows that tie the first is an item's best; an empty table on either
side gives an empty result; very long texts are cut into windows, all of which
are searched; extra columns are ignored, and pass through ``drop_contaminated``
untouched.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, blobs, discard, keep_rows, lower, materialise

_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5
    overlap: float = 0.5
    whole: float = 0.7
    ngram: int = 5
    k1: float = 1.2
    b: float = 0.75
    slack: float = 0.25
    block_postings: int = 32
    block_items: int = 20_000


def words_of(data: bytes) -> list[bytes]:
    return lower(data).translate(_FOLD).split()


def divide(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, or the last third of the words of a single sentence."""
    ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s)|\n", text.rstrip())]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number and mean length, and how many have each word that is asked for."""

    items: int
    mean: float
    df: dict[bytes, int]

    def idf(self, word: bytes) -> float:
        return math.log(1 + (self.items - self.df[word] + 0.5) / (self.df[word] + 0.5))


def length_class(words: int) -> int:
    """The power of four that is no less."""
    own = 4
    while own < words:
        own *= 4
    return own


class Index:
    """Posting lists of the items of one class of lengths, and their searches. terms: numbers of the block's words."""

    def __init__(self, items: list[tuple[object, list[bytes], list[bytes]]], longest: int, terms: dict[bytes, int], statistics: Statistics, settings: Settings):
        self.settings, self.items, self.longest, self.terms = settings, items, longest, terms
        bags = [Counter(q + a) for _, q, a in self.items]
        length = [sum(b.values()) for b in bags]
        mean = statistics.mean
        idf = {w: statistics.idf(w) for b in bags for w in b}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        k1, b = settings.k1, settings.b
        for i, bag in enumerate(bags):
            part = {w: idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[i] / mean)) for w, tf in bag.items()}
            total = sum(part.values())
            for w, x in part.items():
                lists[self.terms[w]].append((i, x / total))
        self.docs = [[d for d, _ in x] for x in lists]
        self.weights = [[w for _, w in x] for x in lists]
        self.most = np.array([max(w, default=0.0) for w in self.weights] or [0.0])
        self.here = np.array([bool(x) for x in self.docs] or [False])
        size = settings.block_postings
        self.block_end = [[d[min(i + size, len(d)) - 1] for i in range(0, len(d), size)] for d in self.docs]
        self.block_most = [[max(w[i : i + size]) for i in range(0, len(w), size)] for w in self.weights]

    # -- one passage --------------------------------------------------------

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold, by block-max WAND."""
        least = self.settings.threshold - 1e-9
        size = self.settings.block_postings
        cursors = [[self.docs[t][0], 0, t] for t in query]  # item, place, term
        out = []

        def forward(cursor: list[int], target: int) -> None:
            docs = self.docs[cursor[2]]
            cursor[1] = bisect_left(docs, target, cursor[1])
            cursor[0] = docs[cursor[1]] if cursor[1] < len(docs) else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            block_sum, nearest = 0.0, None
            for c in cursors[: pivot + 1]:
                ends = self.block_end[c[2]]
                at = bisect_left(ends, target, c[1] // size)
                if at < len(ends):
                    block_sum += self.block_most[c[2]][at]
                    nearest = ends[at] if nearest is None else min(nearest, ends[at])
            if block_sum < least:
                beyond = (nearest if nearest is not None else target) + 1
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    if c[0] < beyond:
                        forward(c, beyond)
            elif cursors[0][0] == target:
                total = 0.0
                for c in cursors[: pivot + 1]:
                    total += self.weights[c[2]][c[1]]
                    forward(c, target + 1)
                if total >= least:
                    out.append((target, total))
            else:
                for c in cursors[:pivot]:
                    if c[0] < target:
                        forward(c, target)
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    # -- a batch of passages ------------------------------------------------

    def rare_postings(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts by term, items, weights, least sum by item) of the postings that are left when each item's words most seen are set aside."""
        term = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        item = np.array([d for x in self.docs for d in x], np.int64)
        weight = np.array([w for x in self.weights for w in x])
        order = np.lexsort((term, -seen[term], item))
        aside = np.cumsum(weight[order])
        first = np.searchsorted(item[order], np.arange(len(self.items)))
        aside -= (aside - weight[order])[first][item[order]]
        spare = max(0.0, self.settings.threshold - self.settings.slack)
        common = np.zeros(len(term), bool)
        common[order] = aside <= spare
        set_aside = np.bincount(item[common], weight[common], len(self.items))
        keep = ~common
        return np.searchsorted(term[keep], np.arange(len(self.docs) + 1)), item[keep], weight[keep], self.settings.threshold - set_aside

    def windows(self, n: int) -> int:
        """How many windows cover n words."""
        return max(1, -(-n // self.longest) - 1) if n else 0

    def candidates(self, ids: np.ndarray, rare: tuple) -> np.ndarray:
        """The windows of a text (numbers of its words, -1 for others) that an item could reach the threshold in. rare: see ``rare_postings``."""
        starts, items, weights, least = rare
        place = np.flatnonzero(ids >= 0)
        own = ids[place]
        n = starts[own + 1] - starts[own]
        place, own, n = place[n > 0], own[n > 0], n[n > 0]
        if not len(place):
            return place
        last = self.windows(len(ids)) - 1
        step = place // self.longest
        window = np.concatenate([np.minimum(step, last), np.minimum(np.maximum(step - 1, 0), last)])
        pairs = np.unique(window * len(self.docs) + np.concatenate([own, own]))
        window, own = pairs // len(self.docs), pairs % len(self.docs)
        n = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(window, n) * len(self.items) + items[at]
        found, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, weights[at])
        return np.unique(found[total >= least[found % len(self.items)] - 1e-9] // len(self.items))

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float, bool]:
        """(share of the question's n-grams, of the answer's, whether they tell a copy)."""
        s = self.settings
        _, question, answer = self.items[item]
        had = {n: grams(passage, n) for n in {min(s.ngram, len(x)) for x in (question, answer, question + answer) if x}}

        def share(words: list[bytes]) -> float:
            own = grams(words, s.ngram)
            return len(own & had[min(s.ngram, len(words))]) / len(own) if own else 1.0

        q, a = share(question), share(answer)
        return q, a, q >= s.overlap and a >= s.overlap or share(question + answer) >= s.whole

    def best_windows(self, words: list[bytes], ids: np.ndarray, rare: tuple) -> list[tuple[object, float, float, float, int]]:
        """(item key, score, question share, answer share, first word) of the items that a text holds, by the best window of each."""
        best: dict[int, tuple] = {}
        for w in self.candidates(ids, rare):
            start = int(w) * self.longest
            # the last window goes to the end
            end = start + 2 * self.longest if w + 1 < self.windows(len(words)) else len(words)
            own = np.unique(ids[start:end])
            own = own[own >= 0]
            for item, score in self.search(own[self.here[own]].tolist()):
                q, a, copy = self.verify(item, words[start:end])
                if copy and (item not in best or (q + a, score) > (best[item][1] + best[item][2], best[item][0])):
                    best[item] = (score, q, a, start)
        return [(self.items[i][0], *best[i]) for i in sorted(best)]


class Block:
    """The indexes of a block of items (key, question words, answer words), one for each class of lengths."""

    def __init__(self, items: list[tuple[object, list[bytes], list[bytes]]], statistics: Statistics, settings: Settings):
        self.terms = {w: i for i, w in enumerate(sorted({w for _, q, a in items for w in q + a}))}
        by_class: dict[int, list] = {}
        for item in items:
            if item[1] or item[2]:
                by_class.setdefault(length_class(len(item[1]) + len(item[2])), []).append(item)
        self.indexes = [Index(own, longest, self.terms, statistics, settings) for longest, own in sorted(by_class.items())]

    def matcher(self) -> Callable[[bytes], list[tuple[object, float, float, float, int]]]:
        """A function from a text's bytes to its rows of ``Index.best_windows``."""
        seen, lookup = np.zeros(len(self.terms)), self.terms.get
        state: dict[str, object] = {"rare": None, "words": 0, "learned": 0}

        def one(data: bytes) -> list[tuple[object, float, float, float, int]]:
            words = words_of(data)
            ids = np.fromiter(map(lookup, words, repeat(-1)), np.int64, len(words))
            if state["words"] < 100_000:
                # which words are common here only moves work, not results: it is learned from the first texts, whenever they have doubled
                seen[:] += np.bincount(ids[ids >= 0], minlength=len(seen))
                state["words"] += len(words)
                if state["rare"] is None or state["words"] >= 2 * state["learned"]:
                    state["rare"], state["learned"] = [index.rare_postings(seen) for index in self.indexes], state["words"]
            return [row for index, rare in zip(self.indexes, state["rare"], strict=True) for row in index.best_windows(words, ids, rare)]

        return one


def blocks(benchmark: DataFrame, settings: Settings, id: str, text: str, question: str | None, answer: str | None) -> Iterator[Block]:
    """The items' indexes, block by block. Only a block's items, and the frequencies of its words, are on the driver at a time."""
    import pyarrow as pa

    spark = benchmark.sparkSession
    whole = F.col(question) if question else F.col(text)
    rows = benchmark.select(F.col(id).alias("id"), whole.cast("string").alias("q"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a"))

    def distinct_words(batches):
        for batch in batches:
            for q, a in zip(blobs(batch.column(0)), blobs(batch.column(1)), strict=True):
                words = words_of(q + b" " + a)
                own = list(dict.fromkeys(words))
                # the first row of an item carries its length
                length = [len(words), *[0] * (len(own) - 1)] if own else []
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(length, pa.int64())], names=["word", "length"])

    counts = materialise(rows.select("q", "a").mapInArrow(distinct_words, "word binary, length long").groupBy("word").agg(F.count("*").alias("df"), F.sum("length").alias("length"), F.sum((F.col("length") > 0).cast("long")).alias("items")), "item-words")
    total = counts.agg(F.sum("length"), F.sum("items")).first()
    n = total[1] or 0

    def made(items: list) -> Block:
        words = sorted({w for _, q, a in items for w in q + a})
        own = spark.createDataFrame([(w,) for w in words], "word binary")
        df = {bytes(r["word"]): r["df"] for r in counts.join(own, "word", "left_semi").select("word", "df").collect()}
        return Block(items, Statistics(n, total[0] / n if n else 0.0, df), settings)

    held: list[tuple[object, list[bytes], list[bytes]]] = []
    for row in rows.orderBy("id").toLocalIterator():
        q, a = (row["q"] or "", row["a"] or "") if answer else divide(row["q"] or "")
        held.append((row["id"], words_of(q.encode()), words_of(a.encode())))
        if len(held) >= settings.block_items:
            yield made(held)
            held = []
    if held:
        yield made(held)
    discard(counts)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap, at_word): a row for each document and test item that it holds."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind, item_kind = docs.schema[id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"{id} {kind}, {item_id} {item_kind}, score double, question_overlap double, answer_overlap double, at_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    for block in blocks(benchmark, settings, item_id, item_text, question, answer):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            one = shared.value.matcher()
            for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
                rows, at = [], []
                for i, data in enumerate(blobs(batch.column(1))):
                    own = one(data)
                    rows += own
                    at += [i] * len(own)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id, item_id, "score", "question_overlap", "answer_overlap", "at_word"])

        found = docs.select(id, text).mapInArrow(search, schema)
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no test item, all columns as they are."""
    for block in blocks(benchmark, settings, item_id, item_text, None, None):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def verdict(shared=shared):
            one = shared.value.matcher()
            return lambda data: not one(data)

        docs = keep_rows(docs, verdict, text)
    return docs
