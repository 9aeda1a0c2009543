"""Scalar functions as Columns; Python only for NFKC and the SimHash of a text."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import FINDING_LEVELS, KIND_LABELS, OTHER_KIND, RISK_LEVELS

#: White space as ECMAScript has it, for regular expressions of Java and Python alike.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_SPACES = re.compile(SPACE + "+")
_TOKEN = re.compile(r"[^\W_]{2,}")
TEXT_CAP = 200_000


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """NFKC. ASCII stays on the JVM, since it is its own NFKC; the function is declared non-deterministic so that a filter on the result isn't pushed below it and evaluates it again."""
    other = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(F.pandas_udf(_nfkc, "string").asNondeterministic()(other), text)


def normalize(value: Column, compatibility: bool = True) -> Column:
    """NFKC, trimmed, backslashes as slashes, white space collapsed, lower case; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = nfkc(text) if compatibility else text
    collapsed = F.regexp_replace(F.regexp_replace(text, "\\\\", "/"), SPACE + "+", " ")
    return F.lower(F.trim(collapsed))


def normalize_text(value: str) -> str:
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", value or "").replace("\\", "/")).strip(" ").lower()


def stable_id(text: Column) -> Column:
    """The first sixteen hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def format_bytes(n: Column) -> Column:
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", n / F.lit(float(unit)))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, scaled(1024, "KB")).when(n < 1024**3, scaled(1024**2, "MB")).otherwise(scaled(1024**3, "GB"))


def _steps(weight: Column, table: tuple) -> Column:
    out = F.when(weight >= table[0][0], table[0][1])
    for least, label in table[1:-1]:
        out = out.when(weight >= least, label)
    return out.otherwise(table[-1][1])


def finding_level(weight: Column) -> Column:
    return _steps(weight, FINDING_LEVELS)


def risk_level(weight: Column) -> Column:
    return _steps(weight, RISK_LEVELS)


def kind_label(kind: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in KIND_LABELS.items() for x in pair))
    return F.coalesce(labels[kind], F.lit(OTHER_KIND))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^((?:[\\s\\S]*/)?)", 1)


def extension(path: Column) -> Column:
    """The last dot and what follows, in lower case; a name's leading dot is none."""
    return F.lower(F.regexp_extract(basename(path), "^.+?(\\.[^.]*)$", 1))


def classify(path: Column, content: Column) -> tuple[Column, Column]:
    """(mime, kind) from the first bytes and the name; the first match wins."""
    head, ext = F.hex(F.substring(content, 1, 16)), extension(path)
    starts = head.startswith
    office = F.when(ext.isin(".docx", ".docm"), "word").when(ext.isin(".xlsx", ".xlsm"), "excel").when(ext.isin(".pptx", ".pptm"), "powerpoint").otherwise("zip")
    legacy = F.when(ext == ".doc", "word-legacy").when(ext == ".xls", "excel-legacy").when(ext == ".ppt", "powerpoint-legacy").otherwise("ole")
    tests = [
        (starts("504B0304"), F.lit("application/zip"), office),
        (starts("255044462D"), F.lit("application/pdf"), F.lit("pdf")),
        (starts("FFD8FF"), F.lit("image/jpeg"), F.lit("image")),
        (starts("89504E470D0A1A0A"), F.lit("image/png"), F.lit("image")),
        (starts("49492A00") | starts("4D4D002A"), F.lit("image/tiff"), F.lit("image")),
        (starts("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"), F.lit("image")),
        (starts("D0CF11E0A1B11AE1"), F.lit("application/x-ole-storage"), legacy),
        (ext.isin(".txt", ".csv", ".xml", ".json", ".html", ".htm"), F.lit("text/plain"), F.lit("text")),
    ]
    mime, kind = F.when(tests[0][0], tests[0][1]), F.when(tests[0][0], tests[0][2])
    for test, m, k in tests[1:]:
        mime, kind = mime.when(test, m), kind.when(test, k)
    return mime.otherwise("application/octet-stream"), kind.otherwise("other")


def first_distinct(text: Column, pattern: str, cap: int) -> Column:
    """The first cap distinct matches, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, cap)


def local_paths(text: Column) -> Column:
    return first_distinct(text, "(?:[A-Za-z]:\\\\|file:///)[^<\"']+", 50)


def external_links(text: Column) -> Column:
    return first_distinct(text, "https?://[^<\"']+", 50)


def document_ids(text: Column) -> Column:
    return first_distinct(text, "(?i)[0-9a-f]{8}-[0-9a-f-]{27,}", 20)


def has_macros(entries: Column) -> Column:
    return F.exists(entries, lambda e: e.rlike("(?i)vbaProject\\.bin$"))


def strip_markup(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "&amp;", "&")
    return F.trim(F.regexp_replace(plain, SPACE + "+", " "))


def text_sample(text: Column) -> Column:
    return F.substring(text, 1, TEXT_CAP)


def escape_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def decode_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for escaped, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(escaped), F.lit(raw))
    return out


def printable(text: Column) -> Column:
    """Everything but printable ASCII as a question mark."""
    return F.regexp_replace(text, "[^\\x20-\\x7E]", "?")


# -- SimHash --------------------------------------------------------------------


class SimHasher:
    """Token-frequency SimHash over the first eight bytes of SHA-256, little-endian; a tied bit is set."""

    def __init__(self, memo: int = 500_000):
        self.digests: dict[str, int] = {}
        self.memo = memo

    def digest(self, token: str) -> int:
        known = self.digests.get(token)
        if known is None:
            if len(self.digests) >= self.memo:
                self.digests.clear()
            known = self.digests[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")
        return known

    def __call__(self, text: str | None) -> str:
        tokens = _TOKEN.findall(normalize_text(text or ""))
        if not tokens:
            return ""
        own = np.fromiter(map(self.digest, tokens), "<u8", len(tokens))
        votes = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 15):
            votes += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return f"{int(np.packbits(2 * votes >= len(tokens), bitorder='little').view('<u8')[0]):016x}"


def _simhash(texts: pd.Series) -> pd.Series:
    return texts.map(SimHasher())


def simhash(text: Column) -> Column:
    """Sixteen hex digits, or empty for a text without tokens; one pass, no shuffle. Declared non-deterministic like nfkc."""
    return F.pandas_udf(_simhash, "string").asNondeterministic()(text)


def fingerprint_bits(fingerprint: Column) -> Column:
    """The fingerprint's bit pattern as a long; null for none."""
    return F.when(F.length(fingerprint) == 16, F.conv(fingerprint, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; 64 if either is empty."""
    return F.coalesce(F.bit_count(fingerprint_bits(a).bitwiseXOR(fingerprint_bits(b))), F.lit(64))
