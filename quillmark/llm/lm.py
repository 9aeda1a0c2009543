"""Language-model scores of whole texts: a smoothed unigram base and a gated recurrent model (see ``gru``).

What is learned, from the training rows only:

* Counts of all tokens of all training texts, in one aggregation.
* A lexicon of the commonest words (at most ``LEXICON``, of at most
  ``LEXICON_BYTES`` bytes), which every task holds; the words beyond it meet their counts in a
  join, so none is lost and nothing that grows is broadcast.
* The recurrent weights. A first model is trained on the driver from about
  ``WARM_TOKENS`` tokens; then every partition goes on from it over all of its
  own training texts, and the partitions' weights are averaged by the tokens
  that they read, a few vectors a task at a time.

Texts are cut and looked up once, for learning and scoring alike: their
symbols, two bytes a token, go through a table.

A word outside the model's own vocabulary is predicted as its class (by its
last bytes), within which it has its smoothed corpus share, one unseen word a
class included; so the model is a distribution over texts.

Cases: null and empty texts are the end token alone; rows without id are
scored and never learned from; repeated rows are scored each; words that tie
in count enter the lexicon by their bytes; with no training
rows every token has base probability one and the model knows classes only;
very long texts are scored to their end with the state carried; extra columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import blobs, crc_bucket, discard, materialise

LEXICON, LEXICON_BYTES = 100_000, 64
WARM_TOKENS = 300_000
#: Weight vectors that a task averages, and that go to the driver at most.
FAN = 8
#: Tokens that a task holds while it learns; a larger partition is learned from in rounds.
ROUND = 8_000_000
#: The end of a text; no word has a line break in it.
END = b"\n"
#: Texts, and tokens, that are scored side by side; words that a task counts before it passes them on.
SIDE_BY_SIDE, SIDE_TOKENS, COUNTED = 4096, 4_000_000, 300_000
LN10 = np.log(10)


def tokens_of(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % gru.RARE_CLASSES


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, rare_class, c): how often each token stands in the texts."""
    import pyarrow as pa

    def run(batches):
        def out(counts: Counter) -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(rare_class, words), pa.int32()), pa.array(counts.values(), pa.int64())], names=["word", "rare_class", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for data in blobs(batch.column(0)):
                counts.update(tokens_of(data))
                if len(counts) >= COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select(text).mapInArrow(run, "word binary, rare_class int, c long").groupBy("word", "rare_class").agg(F.sum("c").alias("c"))


class Lexicon:
    """The commonest words with their symbols and shares, and the mass of the rare classes."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, rare_sums: dict[int, tuple[int, int]]):
        """words: (word, count) from the commonest on; rare_sums: of each rare class the count and number of all its words."""
        self.total, self.denominator = total, total + 0.1 * (distinct + 1)
        self.number = {w: i for i, (w, _) in enumerate(words)}
        count = np.array([c for _, c in words], np.float64)
        self.base = np.log10((count + 0.1) / self.denominator)
        own = min(len(words), gru.WORDS)
        self.symbol = np.array([i if i < own else gru.WORDS + rare_class(w) for i, (w, _) in enumerate(words)], np.int64)
        self.word_mass = np.zeros(gru.WORDS)
        self.word_mass[:own] = (count[:own] + 0.1) / self.denominator
        mass = np.full(gru.RARE_CLASSES, 0.1)  # an unseen word each
        for k, (c, n) in rare_sums.items():
            mass[k] += c + 0.1 * n
        for w, c in words[:own]:
            mass[rare_class(w)] -= c + 0.1
        self.rare_mass = np.maximum(mass, 0.1) / self.denominator
        #: log10 of a lexicon word's share within its class; 0 for the model's own words.
        self.within = np.where(self.symbol >= gru.WORDS, self.base - np.log10(self.rare_mass)[np.maximum(self.symbol - gru.WORDS, 0)], 0.0)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Numbers in the lexicon, -1 for the words beyond it."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def symbols(self, words: list[bytes], found: np.ndarray) -> np.ndarray:
        out = self.symbol[found] if len(self.symbol) else np.zeros(len(words), np.int64)
        beyond = np.flatnonzero(found < 0)
        out[beyond] = gru.WORDS + np.fromiter(map(rare_class, map(words.__getitem__, beyond.tolist())), np.int64, len(beyond))
        return out


def make_lexicon(counts: DataFrame) -> Lexicon:
    """From materialised counts. The words down to the bin of counts that still fits LEXICON go to the driver, and a sum per bin and class."""
    bin = F.floor(F.log2("c") * 16)
    short = counts.where(F.length("word") <= LEXICON_BYTES)
    sizes = {r["bin"]: r["n"] for r in short.groupBy(bin.alias("bin")).agg(F.count("*").alias("n")).collect()}
    least, room = max(sizes, default=0) + 1, LEXICON
    for own in sorted(sizes, reverse=True):
        room -= sizes[own]
        if room < 0:
            break
        least = own
    sums = counts.groupBy("rare_class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    top = sorted(((bytes(r["word"]), r["c"]) for r in short.where(bin >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    by_class = {r["rare_class"]: (r["c"], r["n"]) for r in sums}
    return Lexicon(top, sum(c for c, _ in by_class.values()), sum(n for _, n in by_class.values()), by_class)


def encode(docs: DataFrame, shared, keep: list[str], text: str = "text") -> DataFrame:
    """keep..., n_tokens, known, base, within, rare, symbols: what the lexicon gives of each text, (word, n) of the words beyond it, and the model's symbols, two bytes each."""
    import pyarrow as pa

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        lexicon = shared.value
        log_mass = np.log10(lexicon.rare_mass)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                rare_words: list[bytes] = []
                rare_counts: list[int] = []
                ends = [0]
                for data in blobs(part.column(len(keep))):
                    words = tokens_of(data)
                    found = lexicon.look_up(words)
                    symbols = lexicon.symbols(words, found)
                    inside = found[found >= 0]
                    beyond = np.flatnonzero(found < 0)
                    rare = Counter(map(words.__getitem__, beyond.tolist()))
                    rare_words += rare
                    rare_counts += rare.values()
                    ends.append(len(rare_words))
                    # a word beyond the lexicon gets its own share by the join; its class's mass is taken off here
                    within = float(lexicon.within[inside].sum()) - float(log_mass[symbols[beyond] - gru.WORDS].sum())
                    rows.append((len(words), len(inside), float(lexicon.base[inside].sum()), within, symbols.astype("<i2").tobytes()))
                n, known, base, within, symbols = zip(*rows, strict=True)
                rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "n"])
                made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare), pa.array(symbols, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, "n_tokens", "known", "base", "within", "rare", "symbols"])

    return docs.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens long, known long, base double, within double, rare array<struct<word: binary, n: bigint>>, symbols binary")


def _symbols(batch) -> Iterator[np.ndarray]:
    for data in batch.column(batch.num_columns - 1):
        yield np.frombuffer(data.as_buffer(), "<i2")


def train_model(encoded: DataFrame, lexicon: Lexicon, id: str = "doc_id") -> tuple[dict[str, np.ndarray], int]:
    """(the recurrent weights, the tokens that they were learned from after the first model): learned from every one of the encoded training rows."""
    import pyarrow as pa

    spark = encoded.sparkSession
    model = gru.initial(lexicon.word_mass, lexicon.rare_mass)
    if not lexicon.total:
        return model, 0
    first = F.pmod(F.xxhash64(F.lit("warm"), F.col(id)), F.lit(1_000_000)) < int(min(1.0, WARM_TOKENS / lexicon.total) * 1_000_000)
    warm = [np.frombuffer(r["symbols"], "<i2").astype(np.int64) for r in encoded.where(first).select("symbols").collect()]
    model, _ = gru.train(model, warm, passes=2 if len(warm) else 1)
    start = spark.sparkContext.broadcast(gru.flat(model))

    def rounds(batches) -> Iterator[list[np.ndarray]]:
        texts, n = [], 0
        for batch in batches:
            for own in _symbols(batch):
                texts.append(own)
                n += len(own)
                if n >= ROUND:
                    yield texts
                    texts, n = [], 0
        if texts:
            yield texts

    def go_on(batches):
        own, total = gru.unflat(start.value), 0
        for texts in rounds(batches):
            own, n = gru.train(own, texts, rate=0.004, streams=gru.MORE_STREAMS)
            total += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([float(total)], pa.float64()), pa.array([gru.flat(own).tobytes()], pa.binary())], names=["n", "weights"])

    def mean(batches):
        total, n = np.zeros(gru.SIZE), 0.0
        for batch in batches:
            for own, weights in zip(batch.column(0), batch.column(1), strict=True):
                total += own.as_py() * np.frombuffer(weights.as_py(), np.float32)
                n += own.as_py()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    each = materialise(encoded.select("symbols").mapInArrow(go_on, "n double, weights binary"), "weights")
    while (left := each.count()) > FAN:
        before, each = each, materialise(each.repartition(-(-left // FAN)).mapInArrow(mean, "n double, weights binary"), "weights")
        discard(before)
    rows = each.collect()
    discard(each)
    if rows:
        model = gru.unflat(np.average([np.frombuffer(r["weights"], np.float32) for r in rows], axis=0, weights=[r["n"] for r in rows]))
    return model, int(sum(r["n"] for r in rows))


def score_texts(encoded: DataFrame, model: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """keep..., likely: the model's log10 probability of each encoded text's symbols."""
    import pyarrow as pa

    weights = encoded.sparkSession.sparkContext.broadcast(gru.flat(model))
    fields = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        own = gru.unflat(weights.value)
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            kept = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            made = pa.array(gru.score(own, texts) / LN10, pa.float64())
            held.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([*kept.columns, made], names=[*keep, "likely"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts += _symbols(part)
                n += sum(map(len, texts[-part.num_rows :]))
                held.append(pa.RecordBatch.from_arrays(part.columns[: len(keep)], names=keep))
                if len(texts) >= SIDE_BY_SIDE or n >= SIDE_TOKENS:
                    yield out()
                    n = 0
        if texts:
            yield out()

    return encoded.select(*keep, "symbols").mapInArrow(run, f"{fields}, likely double")


def score_documents(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the rows that ``training`` (a condition) marks."""
    learn = F.coalesce(training & F.col(id).isNotNull(), F.lit(False))
    counts = materialise(token_counts(docs.where(learn), text), "counts")
    lexicon = make_lexicon(counts)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    # the rows' numbers are fixed once they are written
    encoded = materialise(encode(docs.withColumn("learn", learn), shared, [id, "learn"], text).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model, _ = train_model(encoded.where("learn"), lexicon, id)
    scored = materialise(score_texts(encoded, model, ["row", id, "n_tokens", "known", "base", "within"]), "scored")
    beyond = encoded.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n").join(counts.select("word", "c"), "word", "left")
    floor = float(lexicon.denominator)
    sums = beyond.groupBy("row").agg(F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(floor))).alias("beyond"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("beyond_known"))
    more = F.coalesce("beyond", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        id,
        "n_tokens",
        (F.col("known") + F.coalesce("beyond_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(lexicon.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("within") + F.col("likely") + more).alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 10 isn't 0, score all."""
    held = F.coalesce(crc_bucket("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return score_documents(docs, crc_bucket("doc_id", 10) != 0).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
