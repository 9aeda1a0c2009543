"""Secret scans: patterns propose candidates, a random forest removes false positives.

The forest sees a candidate's length, its character transitions (changes of
character class, and the likelihood of its pairs of characters in ordinary
words), how much of it dictionary words cover, whether it stands in a path or
URL, and the neighbouring words. It is trained from labelled findings, a table
(text, start, end, label) of byte offsets; where none is given, from findings
that ``labelled_findings`` makes up from public key formats on one side and
digests, paths, identifiers, numbers and placeholders on the other, with words
and names of its own beside those that the features look at.

Cases: null and empty texts have no findings; rows without id are scanned and
reported without id; repeated rows are reported each; very long texts are
scanned whole; overlapping candidates become one, the longest at its first
rule; without labelled findings of both kinds all candidates are reported;
extra columns pass through ``redact`` untouched; an empty table gives an empty
one.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, blobs

#: Public formats of credentials, most specific first (fixed values).
FORMATS = (
    ("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)", b"-----BEGIN "),
    ("cloud_access_key", rb"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", b"IA"),
    ("forge_token", rb"\bgh[pousr]_[0-9A-Za-z]{36,}\b", b"gh"),
    ("chat_token", rb"\bxox[abprs]-[0-9A-Za-z-]{10,}", b"xox"),
    ("payment_key", rb"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", b"k_"),
    ("map_key", rb"\bAIza[0-9A-Za-z_-]{35}", b"AIza"),
    ("json_web_token", rb"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", b"eyJ"),
)
#: Words that name a secret before it (fixed values).
NAMES = b"password passwd pwd secret token apikey api_key api-key access_key access-key private_key auth_key credential client_secret bearer".split()
#: Words that tell of something else (fixed values).
OTHERS = b"example sample test dummy placeholder changeme your sha sha1 sha256 md5 commit checksum digest hash uuid guid revision version etag integrity build id href src path file image isbn phone".split()
#: Ordinary words for dictionary coverage (fixed values).
DICTIONARY = b"""about access account action active address admin align allow also amount application archive array article async author backend background binary block board body build button call change check child class clear click client close cloud code color column command config content context control copy core count country create data date debug default delete design detail display document domain down element email empty end entry error event example export feature field file filter font from function get global group hash header height home html image import index internal java json key label language layout library line link list load login master match message method model name network node number option order output package page parent password path phone post present print product profile program project property public query read record remove report request require resource response save script search secret select send server service session setting share source start static status store string system table team template test text theme time title token update user value version video view watch website widget width window word work world write year""".split()
_ASSIGNED = re.compile(rb"(?i)(?:" + b"|".join(re.escape(n) for n in NAMES) + rb")[\"']?\s*(?::=|=>|[:=])\s*[\"']?([^\s\"'`;,<>]{8,})")
_IN_URL = re.compile(rb"://[^/\s:@]+:([^/\s:@]{4,})@")
#: Runs that may be keys: sixteen characters or more of the alphabets that keys are written in, a digit among them.
_RUN = re.compile(rb"[A-Za-z0-9+/_\-]{16,}={0,2}")
_DIGIT = re.compile(rb"[0-9]")
_WORD = re.compile(rb"[A-Za-z]{2,}")
#: Bytes on either side that tell of the neighbourhood.
NEAR = 48


@dataclass(frozen=True)
class Settings:
    trees: int = 40
    depth: int = 10
    least_leaf: int = 3
    sample: int = 6000
    threshold: float = 0.5
    seed: int = 5


def candidates(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each candidate by byte offset; overlapping ones become one."""
    found: list[tuple[int, int, str]] = []
    for rule, pattern, must in FORMATS:
        if must in data:
            found += [(m.start(), m.end(), rule) for m in re.finditer(pattern, data)]
    if b"=" in data or b":" in data:
        low = data.lower()
        if any(name in low for name in NAMES):
            found += [(*m.span(1), "assignment") for m in _ASSIGNED.finditer(data)]
    if b"://" in data and b"@" in data:
        found += [(*m.span(1), "url_password") for m in _IN_URL.finditer(data)]
    if _DIGIT.search(data):
        found += [(m.start(), m.end(), "high_entropy") for m in _RUN.finditer(data) if _DIGIT.search(m[0])]
    out: list[tuple[int, int, str]] = []
    for own in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and own[0] < out[-1][1]:
            last = out[-1]
            rule = last[2] if last[2] != "high_entropy" else own[2]
            out[-1] = (last[0], max(last[1], own[1]), rule)
        else:
            out.append(own)
    return out


# -- features ---------------------------------------------------------------


def _pair_table() -> np.ndarray:
    """Log-likelihoods of pairs of letters in dictionary words."""
    n = np.full((27, 27), 0.5)
    for word in DICTIONARY:
        codes = [c - 96 if 97 <= c <= 122 else 0 for c in b" " + word + b" "]
        for a, b in zip(codes, codes[1:], strict=False):
            n[a, b] += 1
    return np.log(n / n.sum(1, keepdims=True))


_PAIRS = _pair_table()
_BY_LENGTH = sorted({w for w in DICTIONARY if len(w) >= 4}, key=len, reverse=True)
_DICTIONARY = re.compile(b"|".join(_BY_LENGTH))
_KIND = bytes(1 if 48 <= c <= 57 else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4 for c in range(256))
FEATURES = ("length", "digits", "upper", "lower", "other", "transitions", "entropy", "pair_likelihood", "dictionary", "hex", "longest_run", "distinct", "slashes", "dots", "dashes", "uuid", "in_path", "name_before", "other_before", "other_after", "assigned", "quoted", "format", "in_url", "placeholder", "spread")


def features(data: bytes, start: int, end: int, rule: str) -> list[float]:
    own = data[start:end]
    n = len(own)
    kinds = own.translate(_KIND)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts = Counter(own)
    low = own.lower()
    letters = [c - 96 if 97 <= c <= 122 else 0 for c in low]
    likely = sum(_PAIRS[a, b] for a, b in zip(letters, letters[1:], strict=False)) / max(n - 1, 1)
    longest = run = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    before, after = data[max(0, start - NEAR) : start].lower(), data[end : end + NEAR].lower()
    near = before[-24:]
    words_before, words_after = set(_WORD.findall(before)), set(_WORD.findall(after))
    others = set(OTHERS)
    return [
        float(len(data[start:end])),
        kinds.count(1) / n,
        kinds.count(3) / n,
        kinds.count(2) / n,
        kinds.count(4) / n,
        changes / max(n - 1, 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        likely,
        sum(len(m) for m in _DICTIONARY.findall(low)) / n,
        float(not low.strip(b"0123456789abcdef")),
        longest / n,
        len(counts) / n,
        own.count(b"/") / n,
        own.count(b".") / n,
        own.count(b"-") / n,
        float(bool(re.fullmatch(rb"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(before[-1:] in (b"/", b"\\", b".", b"?", b"&", b"#") or after[:1] in (b"/", b"\\") or re.match(rb"\.[a-z]{2,4}\b", after) is not None),
        float(any(name in before for name in NAMES)),
        float(bool(words_before & others)),
        float(bool(words_after & others)),
        float(re.search(rb"[:=]\s*[\"']?$", near) is not None),
        float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        float(rule not in ("high_entropy", "assignment", "url_password")),
        float(rule == "url_password"),
        float(re.search(rb"(?:x{4,}|\*{3,}|0{6,}|1234567|example|changeme|your[-_]|placeholder|<|\$\{|%\()", low) is not None),
        float(max(counts.values())) / n,
    ]


# -- labelled findings --------------------------------------------------------

#: What made-up findings are written with, chosen apart from the lists that the features look at (fixed values).
MADE_WORDS = """anchor basket border bridge buffer cargo carbon center chart cloud copper corner cursor customer data delta desk driver engine field filter folder forest frame garden grid harbor header hotel index invoice island items junction kernel label lantern ledger list market matrix meadow member meter mirror module monitor motor news node office orbit order panel paper parcel parser pattern pilot planet player pocket policy portal printer queue radar rail record region report river road robot route sample scanner screen season sensor sheet signal sketch socket spring stage station stock storm stream street summer switch table target ticket timber tower track trade tunnel user valley vector vendor village violet wagon water weather wheel window winter worker zone""".split()
MADE_NAMES = "db_password DB_PASS smtp_password AWS_SECRET_ACCESS_KEY sessionToken auth_token signing_key encryption_key webhook_secret clientSecret api_token API_KEY apiKey passphrase private_key_id salt consumerKey account_key storage_secret login_pwd".split()
MADE_LABELS = "fingerprint= snapshot blob trace_id: request-id= tree parent content-md5: job digest: image@sha256: object checkpoint nonce= ref cache-key: batch span_id= layer sum".split()
MADE_EMPTY = "REPLACE_ME_PLEASE_1 insert-your-value-1 TODO_set_this_2 AAAAAAAAAAAAAAAAAAAA1 123456789012345678 foobarfoobar1234 test1234test1234 not-a-real-value-0 xxxxxxxxxxxxxxxx1 <put_value_here_1> ${SERVICE_VALUE_1} {{vault_value_1}} fill_me_in_later_1 none-of-your-business-1".split()
HEXED, LOWER = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LOWER


class _Maker:
    """Made-up findings (what stands before, the finding, what stands after) by family."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(n))

    def word(self) -> str:
        return self.rng.choice(MADE_WORDS)

    def prose(self, n: int) -> str:
        return " ".join("".join(self.rng.choice(("an", "er", "th", "le", "ou", "ti", "en", "de", "mo", "sta", "ing", "ra")) for _ in range(self.rng.randint(1, 4))) for _ in range(n))

    def identifier(self) -> str:
        own, other = self.word(), self.word()
        return self.rng.choice((f"{own}_{other}", f"{own}-{other}", own + other.title(), f"{own}/{other}", f"{own}_{other}".upper()))

    def key(self) -> str:
        rng = self.rng
        kind = rng.randrange(5)
        if kind == 0:
            return self.chars(HEXED, rng.choice((32, 40, 64)))
        if kind == 1:
            return self.chars(MIXED, rng.randint(20, 48))
        if kind == 2:
            return self.chars(MIXED + "+/", rng.choice((40, 43, 64))) + rng.choice(("", "=", "=="))
        return self.chars(LOWER, rng.randint(24, 40)) if kind == 3 else self.chars(HEXED.upper(), rng.choice((32, 40)))

    # secrets

    def assigned_key(self):
        quote = self.rng.choice(('"', "'", "", '"'))
        return self.rng.choice(MADE_NAMES) + self.rng.choice((" = ", "=", ": ", " := ", '": ')) + quote, self.key(), quote

    def assigned_password(self):
        quote = self.rng.choice(('"', "'", ""))
        return self.rng.choice(MADE_NAMES) + self.rng.choice((" = ", "=", ": ")) + quote, self.chars(MIXED + "!@#%", self.rng.randint(10, 20)), quote

    def provider_key(self):
        made = self.rng.choice(("AKIA" + self.chars(MIXED[:26] + "234567", 16), "ghp_" + self.chars(MIXED, 36), f"xoxb-{self.chars('0123456789', 12)}-{self.chars(MIXED, 24)}", "sk_live_" + self.chars(MIXED, 24), "AIza" + self.chars(MIXED + "_-", 35), f"eyJ{self.chars(MIXED, 17)}.eyJ{self.chars(MIXED, 40)}.{self.chars(MIXED + '_-', 43)}"))
        return self.rng.choice((" ", '"', "= ", f"{self.word()} ", "Authorization: Bearer ")), made, self.rng.choice((" ", '"', "\n", "."))

    def url_password(self):
        return f"{self.rng.choice(('postgres', 'https', 'amqp', 'redis'))}://{self.word()}:", self.chars(MIXED, self.rng.randint(8, 20)), f"@{self.word()}.example.com/"

    # others

    def digest(self):
        return self.rng.choice(MADE_LABELS) + self.rng.choice(("", " ")), self.chars(HEXED, self.rng.choice((32, 40, 64))), self.rng.choice((" ", "\n", '"'))

    def uuid(self):
        return self.rng.choice((" ", "id=", '"')), "-".join(self.chars(HEXED, k) for k in (8, 4, 4, 4, 12)), self.rng.choice((" ", '"', "\n"))

    def path(self):
        return self.rng.choice(("/", "https://", "./", "src=")), "/".join(self.identifier() for _ in range(self.rng.randint(2, 4))) + str(self.rng.randint(1, 999)), self.rng.choice((".html", ".js", "/", ".png", " "))

    def number(self):
        return self.rng.choice((" ", "card ", "call ", "no. ")), self.chars("0123456789", self.rng.randint(16, 20)), " "

    def placeholder(self):
        return self.rng.choice(MADE_NAMES) + self.rng.choice((' = "', ': "', '="')), self.rng.choice(MADE_EMPTY), '"'

    def name(self):
        return self.rng.choice((" ", 'class="', "#", "import ")), f"{self.identifier()}_{self.identifier()}{self.rng.randint(1, 99)}", self.rng.choice((" ", "(", '"'))

    def joined_prose(self):
        return self.rng.choice((" ", "(")), self.prose(3).replace(" ", "") + self.rng.choice(("2", "1999", "-3", "_v2")), self.rng.choice((" ", ".", ","))

    def expression(self):
        return self.rng.choice(MADE_NAMES) + self.rng.choice((": ", " = ")), self.rng.choice((self.identifier(), f"{self.identifier()}.{self.identifier()}", f"get_{self.word()}_{self.word()}()", f"self.{self.word()}.{self.word()}", self.prose(1) * 3)), self.rng.choice((" ", "\n", ")"))

    def picture(self):
        return "data:image/png;base64,", self.chars(MIXED + "+/", self.rng.randint(60, 180)), '"'


#: Families of findings; those of secrets by how often they are made.
SECRETS = ("assigned_key", "assigned_key", "assigned_key", "assigned_key", "assigned_password", "provider_key", "provider_key", "url_password")
OTHER_FAMILIES = ("digest", "uuid", "path", "number", "placeholder", "name", "joined_prose", "expression", "picture")


def labelled_findings(n: int, seed: int, without: str = "", only: str = "") -> list[tuple[bytes, int, int, int]]:
    """n made-up findings (text, start, end, label), half of them secrets; without a family, or only of one."""
    rng = random.Random(seed)
    maker = _Maker(rng)
    kinds = [tuple(f for f in families if f != without and only in ("", f)) for families in (OTHER_FAMILIES, SECRETS)]
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        label = label if kinds[label] else 1 - label
        head, own, tail = getattr(maker, rng.choice(kinds[label]))()
        left = maker.prose(rng.randint(0, 12)) + rng.choice((" ", "\n", ". "))
        text = f"{left}{head}{own}{tail}{rng.choice(('', ' ', chr(10)))}{maker.prose(rng.randint(0, 12))}"
        start = len((left + head).encode())
        out.append((text.encode(), start, start + len(own.encode()), label))
    return out


# -- forest -------------------------------------------------------------------


class Forest:
    """Decision trees on bootstrap samples, the best of a few random features at each split (Gini)."""

    def __init__(self, settings: Settings):
        self.settings = settings
        #: Of each tree the nodes' feature (-1: leaf), cut, left, right and share of secrets.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        if not len(y) or y.min() == y.max():
            return self
        few = max(1, round(math.sqrt(x.shape[1])))
        for _ in range(s.trees):
            drawn = rng.integers(0, len(y), len(y))
            feature, cut, left, right, share = [], [], [], [], []
            stack = [(drawn, 0, -1, 0)]
            while stack:
                rows, depth, parent, side = stack.pop()
                me = len(feature)
                for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (share, float(y[rows].mean()))):
                    a.append(v)
                if parent >= 0:
                    (right if side else left)[parent] = me
                if depth == s.depth or len(rows) < 2 * s.least_leaf or share[me] in (0.0, 1.0):
                    continue
                best = (1e-9, -1, 0.0)
                base = share[me] * (1 - share[me])
                for f in rng.choice(x.shape[1], few, replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, positive = x[rows[order], f], np.cumsum(y[rows[order]])
                    n = np.arange(1, len(rows))
                    ok = (v[1:] > v[:-1]) & (n >= s.least_leaf) & (len(rows) - n >= s.least_leaf)
                    if not ok.any():
                        continue
                    p, q = positive[:-1] / n, (positive[-1] - positive[:-1]) / (len(rows) - n)
                    gain = np.where(ok, base - (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows), -1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), int(f), float((v[at] + v[at + 1]) / 2))
                if best[1] >= 0:
                    feature[me], cut[me] = best[1], best[2]
                    below = x[rows, best[1]] <= best[2]
                    stack += [(rows[below], depth + 1, me, 0), (rows[~below], depth + 1, me, 1)]
            self.trees.append(tuple(np.array(a) for a in (feature, cut, left, right, share)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees; 1 without trees."""
        if not self.trees:
            return np.ones(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.where(x[np.arange(len(x)), feature[at]] <= cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += share[at]
        return total / len(self.trees)


def _rule_of(data: bytes, start: int, end: int) -> str:
    """The rule that proposes a labelled finding."""
    return next((rule for a, b, rule in candidates(data) if a < end and start < b), "high_entropy")


def train(findings: list[tuple[bytes, int, int, int]] | DataFrame | None = None, settings: Settings = Settings()) -> Forest:
    """Learn from labelled findings: a list, a table (text, start, end, label) of which a sample of settings.sample rows is taken by hash, or made-up ones."""
    if isinstance(findings, DataFrame):
        n = findings.count()
        share = min(1.0, settings.sample / max(n, 1))
        drawn = findings.where(F.pmod(F.xxhash64("text", "start", "end"), F.lit(1_000_000)) < int(share * 1_000_000))
        findings = [((r["text"] or "").encode(), r["start"], r["end"], r["label"]) for r in drawn.select("text", "start", "end", "label").collect()]
    if findings is None:
        findings = labelled_findings(settings.sample, settings.seed)
    if not findings:
        return Forest(settings)
    x = np.array([features(t, a, b, _rule_of(t, a, b)) for t, a, b, _ in findings])
    return Forest(settings).fit(x, np.array([y for *_, y in findings]))


def finder(forest: Forest) -> Callable[[bytes], list[tuple[int, int, str, float]]]:
    """A function from a text's bytes to its secrets (start, end, rule, score) by byte offset."""

    def one(data: bytes) -> list[tuple[int, int, str, float]]:
        own = candidates(data)
        if not own:
            return []
        scores = forest.score(np.array([features(data, *c) for c in own]))
        return [(*c, float(p)) for c, p in zip(own, scores, strict=True) if p >= forest.settings.threshold]

    return one


def find(docs: DataFrame, forest: Forest, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, rule, score, secret_sha256): each secret of every whole text, in characters; the secret itself is not repeated."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = f"{id} {docs.schema[id].dataType.simpleString()}, start long, length long, rule string, score double, secret_sha256 string"

    def run(batches):
        one = finder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                rows, at = [], []
                for i, data in enumerate(blobs(part.column(1))):
                    for a, b, rule, score in one(data):
                        rows.append((len(data[:a].decode("utf-8", "replace")), len(data[a:b].decode("utf-8", "replace")), rule, score, hashlib.sha256(data[a:b]).hexdigest()))
                        at.append(i)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id, "start", "length", "rule", "score", "secret_sha256"])

    return docs.select(id, text).mapInArrow(run, schema)


def redact(docs: DataFrame, forest: Forest, text: str = "text", mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """All documents and columns, each secret of the text replaced by a mark; a column of the text's length follows it."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at, size = docs.columns.index(text), docs.columns.index(length) if length else -1

    def run(batches):
        one = finder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                found = [(i, data, own) for i, data in enumerate(blobs(part.column(at))) if (own := one(data))]
                if not found:
                    yield part
                    continue
                texts = part.column(at).to_pylist()
                sizes = part.column(size).to_pylist() if length else []
                for i, data, own in found:
                    out, last = [], 0
                    for a, b, *_ in own:
                        out += [data[last:a], mark.encode()]
                        last = b
                    texts[i] = (b"".join(out) + data[last:]).decode("utf-8", "replace")
                    if length:
                        sizes[i] = len(texts[i])
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if length:
                    columns[size] = pa.array(sizes, part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
