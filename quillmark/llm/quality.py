"""Quality rules by compression bands.

zstandard ratios (bytes over compressed bytes) of the whole document and of
its fixed chunks are held against limits for the length: a ratio above the
band tells repetitive text, one below it incompressible text. A text shorter
than a chunk is judged by the document's limits for its length alone.

Cases: null, empty and blank texts have no words and fail the base rule;
repeated rows and null ids are judged row by row; very long texts are
compressed in one pass of bounded memory per document; extra columns pass
through ``filter_documents`` untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import SPACES, keep_rows, per_document

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the method; ratios are bytes / compressed bytes."""

    level: int = 3
    #: (up to this many bytes, least ratio, most ratio) of a whole document: the range of the good texts of sf0.1 whose
    #: crc32 of the id is even, wider by 0.2 below and 0.05 above (0.1 in classes of under 20 texts; the first and last two are extrapolated).
    document: tuple[tuple[float, float, float], ...] = (
        (256, 1.05, 1.8), (512, 1.18, 1.86), (724, 1.27, 1.92), (1024, 1.45, 2.03), (1448, 1.53, 2.09), (2048, 1.64, 2.15),
        (2896, 1.72, 2.21), (4096, 1.85, 2.26), (5793, 1.92, 2.33), (8192, 1.95, 2.39), (11585, 2.03, 2.43), (16384, 2.06, 2.5),
        (32768, 2.14, 2.52), (65536, 2.1, 2.7), (float("inf"), 2.1, 3.0),
    )
    #: Bytes of a chunk, its least and most ratio (found likewise), and the share of chunks that may be outside.
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.69, 2.18)
    odd_share: float = 0.25
    #: One chunk beyond these is enough: good chunks lie from 1.88 to 2.14, text in base64 at 1.3, a phrase said over and over above 20.
    far: tuple[float, float] = (1.35, 3.0)


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text's UTF-8 bytes."""
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, SPACES + _CONTINUATION))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = np.zeros(n + 2, np.int32)
            again = np.fromiter((i for i, w in enumerate(windows) if seen[w] > 1), np.int64)
            np.add.at(covered, again, 1)
            np.add.at(covered, again + 3, -1)
            repeat = int((np.cumsum(covered)[:n] > 0).sum())
    return n, chars, symbols, dup_lines, repeat


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class CompressionJudge:
    """Measures ratios and gives the verdict of the bands."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.zstd.compress(data)) if data else 0.0

    def measure(self, data: bytes) -> tuple[float, int, int, int]:
        """(ratio of the whole, chunks, chunks outside their band, chunks far outside). What is left beyond the whole chunks is judged within the last chunk_bytes of the text."""
        size = self.bands.chunk_bytes
        starts = list(range(0, len(data) - size + 1, size))
        if starts and len(data) % size:
            starts.append(len(data) - size)
        ratios = [self.ratio(data[at : at + size]) for at in starts]
        outside = lambda band: sum(not band[0] <= r <= band[1] for r in ratios)
        return self.ratio(data), len(ratios), outside(self.bands.chunk), outside(self.bands.far)

    def accepts(self, n_bytes: int, ratio: float, chunks: int, odd: int, far: int) -> bool:
        least, most = next((low, high) for upto, low, high in self.bands.document if n_bytes <= upto)
        return least <= ratio <= most and odd <= self.bands.odd_share * chunks and not far


def judge_documents(docs: DataFrame, bands: Bands = Bands(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, verdicts, and the ratio and odd chunks that they rest on."""

    def make() -> Callable[[bytes], tuple]:
        judge = CompressionJudge(bands)

        def one(data: bytes) -> tuple:
            counts = base_counts(data)
            failed = base_fails(counts[0], counts[4])
            measured = judge.measure(data)
            return (*counts, failed, not failed and judge.accepts(len(data), *measured), *measured)

        return one

    kind = docs.schema[id].dataType.simpleString()
    schema = f"{id} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_odd_chunks long, n_far_chunks long"
    return per_document(docs, [id], make, schema, text)


def filter_documents(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns as they are."""

    def make() -> Callable[[bytes], bool]:
        judge = CompressionJudge(bands)

        def one(data: bytes) -> bool:
            counts = base_counts(data)
            return not base_fails(counts[0], counts[4]) and judge.accepts(len(data), *judge.measure(data))

        return one

    return keep_rows(docs, make, text)
