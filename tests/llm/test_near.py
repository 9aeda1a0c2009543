"""The pipeline's near-duplicates against all pairs of exact sets."""

import random

from quillmark.llm import near


def prose(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def plain(texts):
    """The smallest id of each text's group, by all pairs."""
    held = []
    for text in texts:
        w = text.lower().split()
        held.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_edited_copies_go(spark):
    """Three words of 248 edited: the fingerprints differ in more than four bits, the shingles are similar."""
    rng, texts = random.Random(5), []
    for n in (60, 100, 248, 248, 600):
        base = prose(rng, n)
        for edits in (0, 1, 2, 3, 5, 9, 20, n // 6):
            own = list(base)
            for at in rng.sample(range(n), edits):
                own[at] = "edited" + str(rng.randrange(10**6))
            texts.append(" ".join(own))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(texts)
    assert 5 < len(set(want)) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in near.drop_copies(docs).collect()) == sorted(set(want))


def test_hot_group_in_parts(spark, monkeypatch):
    """A group of copies cut into many small shards, in clusters and in bands, gives the same groups."""
    rng = random.Random(9)
    base, texts = prose(rng, 120), []
    for _ in range(90):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            own[at] = "edited" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    docs, want = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), plain(texts)
    assert 1 < len(set(want)) < 60
    monkeypatch.setattr(near, "EXACT_ROWS", 16)
    for cluster in (20_000, 10):
        monkeypatch.setattr(near, "CLUSTER", cluster)
        assert {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()} == dict(enumerate(want))


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(prose(rng, 80)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "x"), (2, b, "z"), (3, c, "w"), (3, a, "v"), (None, a, "n"), (4, d, "u"), (4, d, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    assert sorted(((r["doc_id"], r["text"]) for r in near.drop_copies(docs).collect()), key=repr) == sorted([(1, a), (1, b), (3, c), (None, a), (4, d)], key=repr)
