"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words, their beginnings, and beginnings
that two or more different words of the text share (one of an insult's forms
may well be chance, several are not). The machine adds to a linear score a learned interaction of every two terms, the
product of their factor vectors, which a single linear pass computes; so a
pair such as an insult and a group's name can weigh more than both alone.

It is fitted on a bounded sample (about ``Settings.positives`` and
``.negatives`` rows, of texts of ``.sample_bytes`` or fewer) of the labelled
rows, taken by a hash of the id; the sample's two shares are weighted back, so
that scores stay probabilities. Only the
``Settings.terms`` bins that the sample sets apart best enter the machine.
Every whole text is scored.

Cases: null and empty texts have no terms and get the score of the bias;
without labels of both kinds every score is the share of positives (0 without
any); repeated label rows count once, as toxic if any says so; repeated
documents are scored each; rows without id are scored, never learned from and
count as not held out; terms that tie in how well they set the sample apart
enter by bin; very long texts are scored whole, as the set of their terms; an
empty table of documents gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc_bucket, per_document

#: Bins that terms are hashed into.
BINS = 1 << 20
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Words whose bins a task remembers.
MEMO = 300_000
#: Sets the hashes of shared beginnings apart from those of beginnings.
SHARED = 100


@dataclass(frozen=True)
class Settings:
    positives: int = 4000
    negatives: int = 8000
    sample_bytes: int = 1 << 16
    terms: int = 6000
    factors: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.08
    decay: float = 2e-4
    #: Beginnings of words, in bytes, that are terms beside the word.
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    threshold: float = 0.3
    seed: int = 11


def bins_of(word: bytes, prefixes: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(bins of the word and of its beginnings, bins that count where another word of the text has them too)."""
    heads = [(word[:n], n) for n in prefixes if len(word) > n]
    alone = (zlib.crc32(word) % BINS, *(zlib.crc32(head, n) % BINS for head, n in heads))
    return alone, tuple(zlib.crc32(head, SHARED + n) % BINS for head, n in heads)


def words_of(data: bytes) -> set[bytes]:
    return set(data.translate(_FOLD).split())


def terms_of(data: bytes, prefixes: tuple[int, ...]) -> np.ndarray:
    found = [bins_of(w, prefixes) for w in words_of(data)]
    shared, n = np.unique(np.fromiter((b for _, own in found for b in own), np.int32), return_counts=True)
    return np.union1d(np.fromiter((b for own, _ in found for b in own), np.int32), shared[n > 1])


class FactorizationMachine:
    """score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>), for the terms i, j that a text has."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.bias = -20.0
        self.place: dict[int, int] = {}
        self.w = np.zeros(0, np.float32)
        self.v = np.zeros((0, settings.factors), np.float32)

    def fit(self, rows: list[tuple[int, np.ndarray]], weight_of: tuple[float, float]) -> FactorizationMachine:
        """rows: (label, bins). weight_of: what a sampled negative and positive stand for."""
        label = np.array([r[0] for r in rows], np.int64)
        weight = np.array(weight_of, np.float64)[label] if len(rows) else np.zeros(0)
        positive = float(weight[label == 1].sum())
        if not len(rows) or not 0 < positive < weight.sum():
            share = positive / weight.sum() if len(rows) else 0.0
            self.bias = 20.0 if share == 1 else -20.0
            return self
        s, total = self.settings, [(r[1]) for r in rows]
        n = [int((label == k).sum()) for k in (0, 1)]
        df = [np.bincount(np.concatenate([x for x, y in zip(total, label, strict=True) if y == k] or [np.zeros(0, np.int32)]), minlength=BINS) for k in (0, 1)]
        p = [(df[k] + 0.5) / (n[k] + 1) for k in (0, 1)]
        both = (df[0] + df[1] + 1) / (sum(n) + 2)
        apart = np.abs(p[1] - p[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
        apart[df[0] + df[1] < 3] = 0
        chosen = np.argsort(-apart, kind="stable")[: s.terms]
        chosen = np.sort(chosen[apart[chosen] > 2])
        place = np.full(BINS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        docs = [place[x][place[x] >= 0] for x in total]
        rng = np.random.default_rng(s.seed)
        self.w, self.v = np.zeros(len(chosen), np.float32), rng.normal(0, 0.02, (len(chosen), s.factors)).astype(np.float32)
        self.bias = float(np.log(positive / (weight.sum() - positive)))
        scale = (weight / weight.mean()).astype(np.float32)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(s.epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), s.batch):
                own = order[at : at + s.batch]
                size = np.array([len(docs[i]) for i in own])
                idx = np.concatenate([docs[i] for i in own]) if size.sum() else np.zeros(0, np.int32)
                row = np.repeat(np.arange(len(own)), size)
                v = self.v[idx]
                total_v = np.stack([np.bincount(row, v[:, k], len(own)) for k in range(s.factors)], 1)
                square = np.bincount(row, (v * v).sum(1), len(own))
                y = self.bias + np.bincount(row, self.w[idx], len(own)) + 0.5 * ((total_v * total_v).sum(1) - square)
                pull = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[own]) * scale[own] / len(own)
                touched, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, pull[row], len(touched)) + s.decay * self.w[touched]
                each = pull[row][:, None] * (total_v[row] - v)
                dv = np.stack([np.bincount(back, each[:, k], len(touched)) for k in range(s.factors)], 1) + s.decay * self.v[touched]
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                self.w[touched] -= (s.rate * dw / np.sqrt(gw[touched])).astype(np.float32)
                self.v[touched] -= (s.rate * dv / np.sqrt(gv[touched])).astype(np.float32)
                db = float(pull.sum())
                gb += db * db
                self.bias -= s.rate * db / np.sqrt(gb)
        self.place = {int(b): i for i, b in enumerate(chosen)}
        return self

    def raw(self, found: np.ndarray) -> float:
        """The score before the sigmoid, from the places of the text's terms."""
        v = self.v[found]
        total = v.sum(0, dtype=np.float64)
        return float(self.bias + self.w[found].sum(dtype=np.float64) + 0.5 * ((total * total).sum() - (v.astype(np.float64) ** 2).sum()))

    def scorer(self):
        """A function from a text's bytes to (score, predicted)."""
        memo: dict[bytes, tuple[tuple[int, ...], tuple[int, ...]] | tuple[()]] = {}
        place, prefixes, threshold = self.place, self.settings.prefixes, self.settings.threshold

        def one(data: bytes) -> tuple[float, int]:
            found: set[int] = set()
            once: set[int] = set()
            for word in words_of(data):
                own = memo.get(word)
                if own is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    own = tuple(tuple(place[b] for b in bins if b in place) for bins in bins_of(word, prefixes))
                    own = memo[word] = own if any(own) else ()
                if own:
                    found.update(own[0])
                    found.update(once.intersection(own[1]))
                    once.update(own[1])
            y = self.raw(np.fromiter(sorted(found), np.int64, len(found)))
            score = 1 / (1 + np.exp(-min(max(y, -30.0), 30.0)))
            return float(score), int(score >= threshold)

        return one


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Learn from the documents that have a label; labels: (id, label 0/1)."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max((F.col(label) != 0).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = [min(1.0, most / max(counts.get(k, 0), 1)) for k, most in ((0, settings.negatives), (1, settings.positives))]
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1_000_000))
    # at most about positives + negatives rows of two numbers, so every executor can have them
    drawn = F.broadcast(known.where(draw < F.when(F.col("label") == 1, int(share[1] * 1_000_000)).otherwise(int(share[0] * 1_000_000))))
    prefixes = settings.prefixes

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([terms_of(data, prefixes).tobytes() for data in blobs(part.column(0))], pa.binary())], names=["label", "bins"])

    sample = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= settings.sample_bytes).select(F.col(id).alias("id"), F.col(text).alias("text")).join(drawn, "id")
    got = sample.select("text", "label").mapInArrow(features, "label int, bins binary").collect()
    return FactorizationMachine(settings).fit([(r["label"], np.frombuffer(r["bins"], np.int32)) for r in got], (1 / max(share[0], 1e-9), 1 / max(share[1], 1e-9)))


def score(docs: DataFrame, model: FactorizationMachine, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_document(docs, [id], lambda: shared.value.scorer(), f"{id} {docs.schema[id].dataType.simpleString()}, score double, predicted int", text)


def held_out_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from labels whose crc32(doc_id) mod 4 isn't 2, score all documents."""
    model = train(docs, labels.where(crc_bucket("doc_id", 4) != 2), settings)
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
