import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, fp string, h string, row string, Ids string"
WORDS = "alpha beta gamma delta the of and quick brown fox jumps over lazy dog river stone cloud metal paper glass train house light sound water field".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ing", ".")) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, copies, repeated rows, clashing names."""
    long = prose(1, 40_000)
    texts = [None, "", " \n\t", "\x1f\x85 ñ Ñ 中文", "x" * 50_000, long, long, prose(2, 80), prose(2, 80), prose(3, 60), "a\x00b", "one"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose(2, 80), "en", "s", 1), (None, None, None, None, None), rows[7], rows[7]]
    return spark.createDataFrame([(*r, *("x",) * 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
