"""Substring dedup by sliding sentence spans.

Runs of consecutive sentences are hashed: from each sentence on, and back from
each sentence's end, the shortest run of ``LEAST_SENTENCES`` sentences or more
that has ``LEAST_WORDS`` words, so a repeat of whole sentences is covered from
its first word to its last. The runs of all documents meet in one aggregation;
of a run that
repeats, the first (smallest document id, then position) stays and the
sentences that any other copy covers are removed.

Sentences end at . ! ? or a line's end; one of ``PIECE`` words or more is cut
by winnowing: after the word of the least hash in each ``PIECE`` words in a
row. Cuts rest on the words around them alone, so copies are cut alike
wherever they stand: all but PIECE words at a copy's start and PIECE - 1 at
its end, and a run is at most PIECE - 1 words longer than it must be. Hence
every copy of LEAST_WORDS + 3 * PIECE - 2 words (48) or more holds a run and
is found, by construction. Case and white space don't count.

Cases: null, empty and short texts have no runs; rows without id are left
alone and not compared; rows that repeat an id count as one document; very
long texts give runs in proportion; an empty table gives an empty one; extra
columns pass through ``remove_spans`` untouched.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, blobs, likely_members, lower, materialise

LEAST_SENTENCES, LEAST_WORDS = 3, 32
#: Words of a sentence from which it is cut, and words of a piece at most.
PIECE = 6
_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+|\n|$)")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The first eight and the next four bytes of a digest.
_HALVES = struct.Struct("<qi")


def pieces(data: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """(normalised words, how many words there are up to each piece's end, how many pieces up to each sentence's end) of a text.

    Pieces end at sentence ends and after the word of the least hash (of
    equal ones the last) of each ``PIECE`` consecutive words of a sentence.
    """
    words: list[bytes] = []
    ends: list[int] = []
    for sentence in _SENTENCE.findall(lower(data)):
        own = sentence.split()
        if own:
            words += own
            ends.append(len(words))
    if len(words) < PIECE:
        return words, ends, [*range(1, len(ends) + 1)]
    place = np.arange(len(words))
    # one key tells hash and place; the later of equal hashes is the lesser
    key = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) << 31 | (len(words) - 1 - place)
    least = key[: len(words) - PIECE + 1].copy()
    for i in range(1, PIECE):
        np.minimum(least, key[i : len(words) - PIECE + 1 + i], out=least)
    last = np.array(ends)
    sentence_of = np.searchsorted(last, place, "right")
    whole = sentence_of[: len(least)] == sentence_of[PIECE - 1 :]
    chosen = len(words) - (least[whole] & 0x7FFFFFFF)
    cuts = np.union1d(last, chosen)
    return words, cuts.tolist(), np.searchsorted(cuts, last, "right").tolist()


def sentences(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text by byte offset."""
    _, ends, _ = pieces(data)
    cuts, out, n = set(ends), [], 0
    for found in _SENTENCE.finditer(data):
        start, end = found.span()
        places = [m.span() for m in _WORD.finditer(data, start, end)]
        for i, (_, word_end) in enumerate(places):
            n += 1
            if n in cuts:
                out.append((start, end if i + 1 == len(places) else word_end))
                start = places[i + 1][0] if i + 1 < len(places) else end
    return out


def runs(data: bytes) -> list[tuple[int, int, int, int, bool]]:
    """(hash, more hash, first sentence, sentences, repeats an earlier run of this text) of each run."""
    words, ends, last = pieces(data)
    digest = xxhash.xxh3_128_digest
    starts = [0, *ends[:-1]]
    hashes = [digest(b" ".join(words[a:b])) for a, b in zip(starts, ends, strict=False)]
    long_enough = lambda a, b: b - a >= LEAST_SENTENCES and ends[b - 1] - starts[a] >= LEAST_WORDS
    chosen, end = [], 0
    for i in range(len(ends)):
        while end < len(ends) and not long_enough(i, end):
            end += 1
        if not long_enough(i, end):
            break
        chosen.append((i, end))
    # the shortest run that ends with a sentence, so that a repeat is covered to that end
    known = set(chosen)
    for end in last:
        i = bisect_left(starts, ends[end - 1] - LEAST_WORDS + 1, 0, end) - 1
        i = min(i, end - LEAST_SENTENCES)
        if i >= 0 and (i, end) not in known:
            chosen.append((i, end))
    out, seen = [], set()
    for i, end in sorted(chosen):
        key = digest(b"".join(hashes[i:end]))
        out.append((*_HALVES.unpack_from(key), i, end - i, key in seen))
        seen.add(key)
    return out


def document_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, g, at, n, again): the runs of every whole text."""
    import pyarrow as pa

    schema = f"{id} {docs.schema[id].dataType.simpleString()}, h long, g int, at int, n int, again boolean"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                rows, at = [], []
                for i, data in enumerate(blobs(part.column(1))):
                    own = runs(data)
                    rows += own
                    at += [i] * len(own)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id, "h", "g", "at", "n", "again"])

    return docs.where(F.col(id).isNotNull()).select(id, text).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans, source): of each document that holds other than first copies, their (at, n) by position and the smallest id that holds a first one."""
    own = materialise(document_runs(docs, id, text), "runs")
    first = materialise(own.groupBy("h", "g").agg(F.min(id).alias("source"), F.max(id).alias("last")).where("source < last").drop("last"), "repeats")
    other = likely_members(own, F.col("h"), first, F.col("h")).join(first, ["h", "g"]).where(F.col(id) > F.col("source")).select(id, "at", "n", "source")
    inner = own.where("again").select(id, "at", "n", F.col(id).alias("source"))
    return other.unionByName(inner).groupBy(id).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"), F.min("source").alias("source"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, sentences, sentences removed) after the spans' sentences are gone."""
    own = sentences(data)
    gone = {i for at, n in spans for i in range(at, at + n)}
    word_from = lambda place: _WORD.search(data, place).start()
    out, at = [], 0
    for i, (start, _) in enumerate(own):
        if i in gone:
            # the white space before what goes stays, that within and after it goes
            if i and i - 1 not in gone:
                out.append(data[at : word_from(start)])
            at = word_from(own[i + 1][0]) if i + 1 < len(own) else len(data)
    return b"".join([*out, data[at:]]), len(own), len(gone)


def removed(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source, n_sentences, n_removed, text) of the documents that lose sentences; text is what is left."""
    import pyarrow as pa

    schema = f"{id} {docs.schema[id].dataType.simpleString()}, source {spans.schema['source'].dataType.simpleString()}, n_sentences long, n_removed long, {text} string"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                made = [cut(data, [(s["at"], s["n"]) for s in own.as_py()]) for data, own in zip(blobs(part.column(2)), part.column(3), strict=True)]
                left = pa.array([m[0].decode("utf-8", "replace") for m in made], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), left], names=[id, "source", "n_sentences", "n_removed", text])

    spans = materialise(spans, "spans")
    likely = likely_members(docs.select(id, text), F.xxhash64(id), spans, F.xxhash64(id))
    return likely.join(spans, id).select(id, "source", text, "spans").mapInArrow(run, schema)


def remove_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents and columns, the text without other than first copies of repeated spans."""
    gone = materialise(removed(docs, repeated_spans(docs, id, text), id, text).select(F.col(id), F.col(text).alias("left_text")).dropDuplicates([id]), "cut")
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    joined = kept.join(gone.toDF("key", "left_text"), F.col(place[id]) == F.col("key"), "left")
    return joined.select(*((F.coalesce("left_text", place[c]) if c == text else F.col(place[c])).alias(c) for c in docs.columns))
