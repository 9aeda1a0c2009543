"""The compression bands on labels they were not set from."""

import base64
import random
import zlib

from quillmark.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_verdict_rejects_junk_and_keeps_good(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").join(labels, "doc_id").where("doc_id < 5000").collect()
    judge, good, bad = quality.CompressionJudge(quality.Bands()), [], []
    verdict = lambda data: judge.accepts(len(data), *judge.measure(data))
    for r in rows:
        data = (r["text"] or "").encode()
        counts = quality.base_counts(data)
        if zlib.crc32(str(r["doc_id"]).encode()) % 2 and not quality.base_fails(counts[0], counts[4]):
            (good if r["quality"] else bad).append(data)
    assert sum(map(verdict, good)) >= 0.99 * len(good)
    assert sum(map(verdict, bad)) <= 0.5 * len(bad)
    rng = random.Random(2)
    for data in [d for d in good if 3000 < len(d) < 20_000][:30]:
        junk = len(data) * 7 // 10
        assert not verdict(data[: len(data) - junk] + base64.b64encode(rng.randbytes(junk))[:junk])


def test_one_chunk_is_judged():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]
    judge = quality.CompressionJudge(quality.Bands())
    data = b"again and again " * 128 + " ".join(words).encode()[:1500]
    assert judge.measure(data)[1] == 2 and judge.measure(data)[3] == 1 and not judge.accepts(len(data), *judge.measure(data))


def test_the_rest_beyond_whole_chunks_is_judged():
    rng = random.Random(1)
    words = b" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6))).encode() + rng.choice((b"", b"", b" the", b" and")) for _ in range(1600))[:5858]
    judge = quality.CompressionJudge(quality.Bands())
    verdict = lambda data: judge.accepts(len(data), *judge.measure(data))
    assert not verdict(words + b"buy now " * 250)
    assert judge.measure(words)[3] == 0 and judge.measure(words + b"buy now " * 250)[3] == 1
