"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit a logistic classifier over byte
n-grams is trained to tell the languages whose word has the bit from those
whose word hasn't. A text's language is the codeword of least weighted loss
(each bit weighted by how well its classifier does on the language), and texts
whose two best codewords are nearly as close are flagged as ambiguous.

The classifiers are fitted on a bounded sample of the labelled rows, taken by
a hash of the id: about ``Settings.sample_rows`` of each language, among texts
of ``Settings.sample_bytes`` or fewer. All languages are learned, and every
whole text of any length is scored.

Cases: a null text, an empty one or one without any letter is ``und`` with
score 0; so is every text if no language could be learned. With one language
learned all others are it. Rows without id are scored, never learned from and
count as not held out; repeated rows are scored row by row; of codewords that
tie the first by name is chosen; very long texts are read in blocks; extra
columns are ignored; an empty table gives an empty one, and one without
labelled rows teaches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc_bucket, per_document

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Lower case for A-Z; what is neither letter nor above ASCII becomes a space.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
#: Bins of each order's n-grams, and the orders.
BINS, ORDERS = 1 << 16, (2, 3, 4)
#: Bytes of a text that are turned into n-grams at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 400
    sample_bytes: int = 1 << 16
    steps: int = 40
    rate: float = 0.7
    #: Texts whose best two codewords differ by less than this in loss per bit are ambiguous.
    margin: float = 0.1


def ngrams(data: bytes):
    """Feature numbers of the text's byte n-grams, a block at a time."""
    for at in range(0, max(len(data), 1), BLOCK):
        a = _FOLD[np.frombuffer(b" " + data[at : at + BLOCK + 2] + b" ", np.uint8)].astype(np.uint32)
        two = a[:-1] << 8 | a[1:]
        three = (two[:-1] * np.uint32(2654435) + a[2:] * np.uint32(40503)) % np.uint32(65521)
        yield two
        yield three + np.uint32(BINS)
        if len(a) > 3:
            yield (two[:-2] * np.uint32(2246822) + two[2:] * np.uint32(3266489)) % np.uint32(65519) + np.uint32(2 * BINS)


def frequencies(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, shares) of a text."""
    found, n = np.unique(np.concatenate(list(ngrams(data))), return_counts=True)
    return found.astype(np.int32), (n / n.sum()).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all distinct splits up to six languages, above it the best of several random codes."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        rows = [(bits >> (n - 1 - i) & 1) if i else np.zeros_like(bits) for i in range(n)]
        return (1 - 2 * np.array(rows)).astype(np.float32)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_distance = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit that all share
        apart = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if apart > best_distance:
            best, best_distance = code, apart
    return best


class CodeModel:
    """The codewords, the bits' classifiers and the decoding weights."""

    def __init__(self, languages: list[str], settings: Settings):
        self.languages, self.settings = languages, settings
        self.code = codewords(len(languages))
        self.weight = np.zeros((len(ORDERS) * BINS, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.trust = np.ones_like(self.code)

    scale = np.float32(64)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> CodeModel:
        """rows: (language number, feature numbers, shares). Full-batch logistic regression with AdaGrad, languages weighted alike."""
        if not rows:
            return self
        label = np.array([r[0] for r in rows])
        used, idx = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        val = np.concatenate([r[2] for r in rows]) * self.scale
        starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])[:-1]])
        doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        target = self.code[label]
        share = (1 / np.bincount(label, minlength=len(self.languages))[label]).astype(np.float32)[:, None] / len(self.languages)
        w, b = np.zeros((len(used), self.code.shape[1]), np.float32), self.bias.copy()
        gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
        for _ in range(self.settings.steps):
            margin = np.stack([np.add.reduceat(w[idx, k] * val, starts) for k in range(w.shape[1])], 1) + b
            pull = -target * share / (1 + np.exp(np.clip(target * margin, -30, 30)))
            step = np.stack([np.bincount(idx, pull[doc, k] * val, len(used)) for k in range(w.shape[1])], 1).astype(np.float32) + 1e-6 * w
            gw += step * step
            w -= self.settings.rate * step / np.sqrt(gw)
            move = pull.sum(0)
            gb += move * move
            b -= self.settings.rate * 0.1 * move / np.sqrt(gb)
        self.weight[used], self.bias = w, b.astype(np.float32)
        right = (target * margin > 0).astype(np.float32)
        for c in range(len(self.languages)):
            own = right[label == c]
            self.trust[c] = (own.sum(0) + 1) / (len(own) + 2)
        self.trust /= self.trust.sum(1, keepdims=True)
        return self

    def margins(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1], np.float64), 0
        for found in ngrams(data):
            total += self.weight[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(n, 1) * self.scale + self.bias

    def losses(self, margin: np.ndarray) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -self.code * margin)).sum(1)

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.languages or not _LETTER.search(data.decode("utf-8", "replace")):
            return UNDETERMINED, 0.0, False
        loss = self.losses(self.margins(data))
        first = int(loss.argmin())
        near = np.exp((loss[first] - loss) * self.code.shape[1])
        rest = np.delete(loss, first)
        return self.languages[first], float(1 / near.sum()), bool(len(rest) and rest.min() - loss[first] < self.settings.margin)


def train(labelled: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> CodeModel:
    """Learn from the rows of a table of texts and languages (rows without language teach nothing)."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & (F.coalesce(F.octet_length(text), F.lit(0)) <= settings.sample_bytes)).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, settings.sample_rows / r["count"]) for r in counts}
    if not languages:
        return CodeModel([], settings)
    cut = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1_000_000)) < cut[F.col("lang")])

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [frequencies(data) for data in blobs(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["lang", "found", "share"])

    number = {name: i for i, name in enumerate(languages)}
    got = sample.select("text", "lang").mapInArrow(features, "lang string, found binary, share binary").collect()
    return CodeModel(languages, settings).fit([(number[r["lang"]], np.frombuffer(r["found"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got])


def identify(docs: DataFrame, model: CodeModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return own.predict

    return per_document(docs, [id], make, f"{id} {docs.schema[id].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean", text)


def held_out_predictions(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 4 isn't 2, predict all."""
    model = train(docs.where(crc_bucket("doc_id", 4) != 2), settings)
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held, "lang_pred", "score", "ambiguous")
