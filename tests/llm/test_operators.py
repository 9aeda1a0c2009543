"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import bpe, decontam, gru, langid, quality, queries, secret_scan, simhash, spans, toxicity, warc
from quillmark.llm.components import components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def groups(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [find(i) for i in range(n)]


# -- 1 ----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i] or "") for i in ids]
    root = groups(len(ids), ((i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash_bk(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, root, strict=True)}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_bk_tree_finds_all(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = np.unique(np.array([rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(n)], np.uint64))
    tree = simhash.BKTree(values)
    found = {(node, int(q)) for node, near in tree.within(4, values) for q in near}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}


def test_hot_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    rng = random.Random(4)
    values = sorted({5 ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)})
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.link_fingerprints(frame)).collect()}
    want = groups(len(values), ((i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4))
    own = [roots.get(simhash.signed(v), simhash.signed(v)) for v in values]
    assert len(set(zip(want, own, strict=True))) == len(set(want)) == len(set(own))


def test_components_of_a_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("a % 50 <> 49")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}


# -- 2 ----------------------------------------------------------------------------


def plain_runs(text):
    """{(first piece, piece after the last): words} of the runs of a text, by trying all pairs of pieces."""
    data = text.encode()
    places = spans.sentences(data)
    own = [tuple(spans.lower(data[a:b]).split()) for a, b in places]
    # a piece ends its sentence if there is a mark at its end or a line's end before the next piece
    last = [data[a:b].rstrip()[-1:] in (b".", b"!", b"?") or i + 1 == len(places) or b"\n" in data[b - 1 : places[i + 1][0]] for i, (a, b) in enumerate(places)]
    n = lambda i, j: sum(map(len, own[i:j]))
    fits = lambda i, j: j - i >= 3 and n(i, j) >= 32
    out = {}
    for i in range(len(own)):
        for j in range(i + 3, len(own) + 1):
            if n(i, j) > 60:
                break
            if fits(i, j) and (not fits(i, j - 1) or last[j - 1] and not fits(i + 1, j)):
                out[i, j] = tuple(own[i:j])
    return out


def test_spans(spark, texts):
    held = {i: plain_runs(texts[i] or "") for i in texts}
    first = {}
    for i in sorted(held):
        for at, key in sorted((at, key) for (at, _), key in held[i].items()):
            first.setdefault(key, (i, at))
    want = {}
    for i in held:
        gone = {s for (at, end), key in held[i].items() if first[key] != (i, at) for s in range(at, end)}
        if gone:
            data = (texts[i] or "").encode()
            kept = " ".join(data[a:b].decode() for k, (a, b) in enumerate(spans.sentences(data)) if k not in gone)
            want[i] = (len(gone), kept.split())
    assert {r["doc_id"]: (r["n_removed"], r["text"].split()) for r in queries.op2_sentence_spans(spark, SMALL).collect()} == want


def test_copies_go_whole():
    rng = random.Random(3)
    text = " ".join(rng.choice("alpha beta gamma delta the of and quick brown fox".split()) + rng.choice(("", "", ".", "\n")) for _ in range(70)).encode()
    own = [(at, n) for _, _, at, n, _ in spans.runs(text)]
    assert spans.cut(text, own)[0] == b""
    before, after = b"Before it all there was something else.  ", b"  After it came more."
    whole = before + text + b"." + after
    shared = {r[:2] for r in spans.runs(text + b".")}
    left, _, _ = spans.cut(whole, [(at, n) for h, g, at, n, _ in spans.runs(whole) if (h, g) in shared])
    assert left == before + b"After it came more."


def test_planted_passage(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + rng.choice(("", "", "", "", ".")) for _ in range(n))
    passage = ". " + prose(60) + ". "
    docs = spark.createDataFrame([(1, prose(90) + passage + prose(90)), (2, prose(50)), (3, prose(70) + passage.upper() + prose(9)), (4, prose(200))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in spans.removed(docs, spans.repeated_spans(docs)).collect()}
    assert set(out) == {3} and out[3]["source"] == 1 and len(out[3]["text"].split()) < 110
    whole = {r["doc_id"]: r["text"] for r in spans.remove_spans(docs).collect()}
    assert whole[3] == out[3]["text"] and len(whole) == 4


def test_every_copy_of_48_words_shares_a_run():
    rng = random.Random(3)
    prose = lambda n: [rng.choice("the of And a É run long WORDS".split()) + rng.choice(("",) * 9 + (".", "\n")) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(n)]
    for _ in range(300):
        passage = prose(spans.LEAST_WORDS + 3 * spans.PIECE - 2)
        texts = [" ".join([*prose(rng.randrange(60)), *passage, *prose(rng.randrange(60))]).encode() for _ in range(2)]
        held = [{r[:2] for r in spans.runs(t)} for t in texts]
        assert held[0] & held[1]
        for text in texts:
            words, ends, _ = spans.pieces(text)
            cut = [spans.lower(text[a:b]).split() for a, b in spans.sentences(text)]
            assert cut == [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]


# -- 3 ----------------------------------------------------------------------------


def test_lm_base_and_gain(spark, texts):
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in queries.op3_recurrent_lm(spark, SMALL).collect()}
    assert set(rows) == set(tokens)
    for i, r in rows.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_gru_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(2)
    model = gru.initial(np.full(gru.WORDS, 1e-4), np.full(gru.RARE_CLASSES, 1e-3))
    h = rng.normal(size=(3, gru.HIDDEN)).astype(np.float32)
    mass = [np.exp(gru.log_probabilities(model, np.repeat(h[i : i + 1], gru.SYMBOLS, 0), np.arange(gru.SYMBOLS))).sum() for i in range(3)]
    assert np.allclose(mass, 1, atol=1e-4)
    long = [rng.integers(0, gru.SYMBOLS, n) for n in (5, 300, 1)]
    want = []
    for text in long:
        state, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for s in text:
            total += gru.log_probabilities(model, state, np.array([s]))[0]
            state = gru.step(model, state, np.array([s]))[0]
        want.append(total)
    assert np.allclose(gru.score(model, long), want, rtol=1e-4)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in gru.initial(np.full(gru.WORDS, 1e-4), np.full(gru.RARE_CLASSES, 1e-3)).items()}
    window, fresh = rng.integers(0, gru.SYMBOLS, (5, 3)), np.zeros((5, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    h = np.zeros((3, gru.HIDDEN))
    g = gru.gradients(model, h, window, fresh)[0]
    for name in gru.SHAPES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for e in (1e-5, -2e-5):
            model[name][at] += e
            losses.append(gru.gradients(model, h, window, fresh)[2])
        model[name][at] += 1e-5
        assert math.isclose(g[name][at], (losses[0] - losses[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


# -- 4 ----------------------------------------------------------------------------


def test_secret_forest():
    forest = secret_scan.train()
    held = secret_scan.labelled_findings(1500, 77)
    x = np.array([secret_scan.features(t, a, b, secret_scan._rule_of(t, a, b)) for t, a, b, _ in held])
    y = np.array([r[3] for r in held])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97
    one = secret_scan.finder(forest)
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    text = f'words token = "{key}" more words, sha1 {key[::-1]} and /usr/lib/python3/dist-packages/numpy/core1.py'.encode()
    assert [text[a:b].decode() for a, b, *_ in one(text)] == [key]


def test_scan_and_redact(spark):
    forest = secret_scan.train()
    docs = spark.createDataFrame([(1, "é token = \"0123456789abcdef0123456789abcdef01234567\" é", 10), (2, "clean", 5)], "doc_id long, text string, n_chars long")
    found = secret_scan.find(docs, forest).collect()
    assert [(r["doc_id"], r["start"], r["length"]) for r in found] == [(1, 11, 40)]
    out = {r["doc_id"]: r for r in secret_scan.redact(docs, forest, length="n_chars").collect()}
    assert out[1]["text"] == 'é token = "[SECRET]" é' and out[1]["n_chars"] == 22 and out[2]["text"] == "clean"


def test_find_is_brute_force(spark, texts):
    """Every candidate by explicit walks down the trees."""
    forest = secret_scan.train()
    texts = dict(list(texts.items())[:60]) | {-1: "commit 0123456789abcdef0123456789abcdef01234567 and password = 'hk3GJ83jxnaBBd02ls'"}
    want = set()
    for i, text in texts.items():
        data = (text or "").encode()
        for a, b, rule in secret_scan.candidates(data):
            x, shares = secret_scan.features(data, a, b, rule), []
            for feature, cut, left, right, share in forest.trees:
                at = 0
                while feature[at] >= 0:
                    at = left[at] if x[feature[at]] <= cut[at] else right[at]
                shares.append(share[at])
            if sum(shares) / len(shares) >= 0.5:
                want.add((i, hashlib.sha256(data[a:b]).hexdigest(), round(sum(shares) / len(shares), 9)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert want and {(r["doc_id"], r["secret_sha256"], round(r["score"], 9)) for r in secret_scan.find(docs, forest).collect()} == want


def test_long_secrets_are_whole():
    secret = "".join(random.Random(2).choice("abcdefXYZ0189!#%") for _ in range(320))
    assert [(a, b) for a, b, _ in secret_scan.candidates(f'password = "{secret}" x'.encode())] == [(12, 332)]
    assert [b - a for a, b, _ in secret_scan.candidates(f"https://{'u' * 90}:{'p7' * 80}@host/".encode())] == [160]


@pytest.mark.parametrize("family", ("expression", "joined_prose", "name", "number", "path", "url_password"))
def test_families_not_learned_from(family):
    """These kinds of findings are told apart by a forest that has seen none of their kind."""
    forest = secret_scan.train(secret_scan.labelled_findings(2000, 5, without=family))
    held = secret_scan.labelled_findings(200, 78, only=family)
    x = np.array([secret_scan.features(t, a, b, secret_scan._rule_of(t, a, b)) for t, a, b, _ in held])
    assert ((forest.score(x) >= 0.5) == np.array([r[3] for r in held])).mean() > 0.9


# -- 5, 7 -------------------------------------------------------------------------


def test_codewords():
    for n in (2, 3, 4, 6, 30):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 1000 * np.eye(n)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else code.shape[1] // 4) and not (np.abs(code.sum(0)) == n).any()


def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op5_language_codes(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_by_explicit_distance(spark, texts):
    """Margins by a plain loop over n-grams, languages by the loss of each codeword in full."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    fold = lambda b: b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for i in sorted(texts)[:25]:
        a = [32, *(fold(b) for b in texts[i].encode()), 32]
        bins = [a[k] << 8 | a[k + 1] for k in range(len(a) - 1)]
        two = list(bins)
        bins += [65536 + (two[k] * 2654435 + a[k + 2] * 40503) % 2**32 % 65521 for k in range(len(a) - 2)]
        bins += [131072 + (two[k] * 2246822 + two[k + 2] * 3266489) % 2**32 % 65519 for k in range(len(a) - 3)]
        margin = [64 * sum(float(model.weight[f, k]) for f in bins) / len(bins) + float(model.bias[k]) for k in range(model.code.shape[1])]
        loss = {name: sum(float(model.trust[c, k]) * math.log1p(math.exp(-float(model.code[c, k]) * m)) for k, m in enumerate(margin)) for c, name in enumerate(model.languages)}
        best = min(loss, key=loss.get)
        assert got[i]["lang_pred"] == best and got[i]["ambiguous"] == (min(v for k, v in loss.items() if k != best) - loss[best] < 0.1)


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    rows = [(100 * k + i, " ".join(chr(97 + k % 26) * rng.randint(2, 5) + chr(97 + k // 3) for _ in range(30)), f"l{k:02d}") for k in range(12) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, langid.Settings(sample_rows=8))
    assert model.languages == [f"l{k:02d}" for k in range(12)]
    right = langid.identify(docs, model).join(docs, "doc_id").where("lang = lang_pred").count()
    assert right > 0.95 * len(rows)


def test_machine_is_the_sum_over_pairs(spark, texts):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert len(model.place) > 50
    own = docs.limit(40)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(own, model).collect()}
    for r in own.collect():
        found = [model.place[int(b)] for b in toxicity.terms_of(r["text"].encode(), model.settings.prefixes) if int(b) in model.place]
        w, v = model.w.astype(float), model.v.astype(float)
        y = model.bias + sum(w[i] for i in found) + sum(v[i] @ v[j] for n, i in enumerate(found) for j in found[:n])
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-min(max(y, -30), 30))), rel_tol=1e-6)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity_fm(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.85 and hit / sum(r["predicted"] for r in rows) > 0.9


def test_toxicity_terms_and_scorer_agree():
    prefixes = toxicity.Settings().prefixes
    terms = lambda text: set(toxicity.terms_of(text.encode(), prefixes).tolist())
    forms = terms("badworda") | terms("badwordb")
    assert terms("badworda badworda BADWORDA") == terms("badworda") and len(terms("badworda badwordb") - forms) == len(prefixes)
    assert terms("") == set() and len(terms("a an the")) == 3
    rng = np.random.default_rng(3)
    stems, ends = ("lorem", "ipsum", "dolori", "sit"), ("a", "ab", "abc", "us", "ere", "")
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(rng.integers(0, 9))).encode() for _ in range(400)]
    labels = [int(len({w for w in t.split() if w.startswith(b"lorem")}) > 1) for t in texts]
    machine = toxicity.FactorizationMachine(toxicity.Settings(epochs=25)).fit([(y, toxicity.terms_of(t, prefixes)) for t, y in zip(texts, labels, strict=True)], (1.0, 1.0))
    scorer, hit = machine.scorer(), 0
    for text, label in zip(texts, labels, strict=True):
        score, predicted = scorer(text)
        raw = machine.raw(np.array([machine.place[x] for x in sorted(terms(text.decode())) if x in machine.place], np.int64))
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-5
        hit += predicted == label
    assert hit / len(texts) > 0.97


def test_machine_learns_a_pair():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((int(a and b), np.array(sorted({*(100,) * a, *(200,) * b, *rng.choice(np.arange(300, 330), 4)}), np.int32)))
    machine = toxicity.FactorizationMachine(toxicity.Settings(epochs=25)).fit(rows, (1.0, 1.0))
    place = machine.place
    v = lambda *t: machine.raw(np.array([place[x] for x in t if x in place], np.int64))
    assert v(100, 200) > 0 > max(v(100), v(200), v()) and machine.v[place[100]] @ machine.v[place[200]] > 0


# -- 6 ----------------------------------------------------------------------------


def test_wand_is_brute_force(spark, texts):
    items = [(r["item_id"], *(x.encode() for x in decontam.divide(r["text"]))) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    own = [(k, decontam.words_of(q), decontam.words_of(a)) for k, q, a in items]
    length = [len(q) + len(a) for _, q, a in own]
    df = Counter(w for _, q, a in own for w in set(q + a))
    block = decontam.Block(own, decontam.Statistics(len(own), sum(length) / len(own), df), decontam.Settings(threshold=0.3, slack=0.2, block_postings=2))
    n = 0
    for index, text in ((i, t) for i in block.indexes for t in texts.values()):
        words = decontam.words_of((text or "").encode())
        ids = np.array([index.terms.get(w, -1) for w in words], np.int64)
        windows = {int(w) for w in index.candidates(ids, index.rare_postings(np.bincount(ids[ids >= 0], minlength=len(index.docs))))}
        for w in range(index.windows(len(words))):
            end = (w + 2) * index.longest if w + 1 < index.windows(len(words)) else len(words)
            query = set(ids[w * index.longest : end].tolist()) - {-1}
            scores = defaultdict(float)
            for t in query:
                for d, x in zip(index.docs[t], index.weights[t], strict=True):
                    scores[d] += x
            want = {d: round(s, 9) for d, s in scores.items() if s >= 0.3 - 1e-9}
            assert {d: round(s, 9) for d, s in index.search(sorted(t for t in query if index.here[t]))} == want
            assert not want or w in windows
            n += len(want)
    assert n > 0


def test_blocks_change_nothing(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    held = [{(r["doc_id"], r["item_id"], r["at_word"], round(r["score"], 9)) for r in decontam.contaminated(docs, items, decontam.Settings(threshold=0.4, block_items=n)).collect()} for n in (7, 20_000)]
    assert held[0] and held[0] == held[1]
    assert decontam.drop_contaminated(docs, items, decontam.Settings(block_items=11)).count() == decontam.drop_contaminated(docs, items).count() < docs.count()


def test_leaks_are_found(spark, texts):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontam.words_of(t.encode())] for i in range(len(w) - 4)}
    items = {r["item_id"]: grams(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for own in [grams(t or "")] for k, g in items.items() if g and len(own & g) >= 0.7 * len(g)}
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op6_bm25_wand(spark, SMALL).collect()} == want


# -- 8 ----------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "other é"), (5, "u", None), (4, "u", ""), (7, "x", "y" * 5000)], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write_pages(pages, path)
    rows = {r["page_id"]: r for r in warc.read_records(spark, path, verify=True).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in rows.items()} == {1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 8), 4: ("response", None, 0), 5: ("revisit", 4, 0), 7: ("response", None, 5000)}
    assert rows[2]["payload_digest"] == base64.b32encode(hashlib.sha1("other é".encode()).digest()).decode() and bytes(rows[2]["payload"]).decode() == "other é" and rows[3]["payload"] is None
    only = warc.read_records(spark, path, ["page_id", "record_type"]).where("record_type = 'revisit'")
    assert {r["page_id"] for r in only.collect()} == {3, 5}
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "record_type" not in plan.split("BatchScan")[0]


@pytest.mark.parametrize("packed", (False, True))
def test_cut_archives_are_errors(packed):
    import gzip
    import io

    first, second = (warc.make_record(i, "u", b"p" * 300, None) for i in (1, 2))
    pack = gzip.compress if packed else bytes
    for n in (10, 20, 40, len(pack(second)) - 5):
        with pytest.raises(ValueError):
            list(warc.RecordStream(io.BytesIO(pack(first) + pack(second)[:n]), packed).records(lambda h: 2))
    assert len(list(warc.RecordStream(io.BytesIO(pack(first) + pack(second)), packed).records(lambda h: 2))) == 2


def test_reader_skips_blocks():
    import io

    data = b"".join(warc.make_record(i, "u", b"p" * 3000, None if i % 2 else 0) for i in range(6))
    for packed in (False, True):
        source = io.BytesIO(b"".join(__import__("gzip").compress(warc.make_record(i, "u", b"p" * 3000, None if i % 2 else 0)) for i in range(6)) if packed else data)
        got = [(h["x-page-id"], len(b)) for h, b in warc.RecordStream(source, packed, 100).records(lambda h: 2 if h["warc-type"] == "response" else 0)]
        assert [k for k, _ in got] == ["1", "3", "5"] and all(n > 3000 for _, n in got)


# -- 9 ----------------------------------------------------------------------------


def test_base_counts(texts):
    import re

    for text in [*list(texts.values())[:80], "a b c a b c", "x\x1fy \xa0 z\n\n z\nz\n z", "#*$%&|<> é"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)} if len(words) < 400 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality.base_counts(text.encode())
        assert got[:4] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert again is None or got[4] == len(again)


def plain_verdict(data):
    """The bands' verdict, from zstandard's own sizes."""
    import zstandard

    bands = quality.Bands()
    ratio = lambda own: len(own) / len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(own))
    least, most = next((low, high) for upto, low, high in bands.document if len(data) <= upto)
    parts = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    if len(parts) > 1 and len(parts[-1]) < 2048:
        parts[-1] = data[-2048:]
    parts = [ratio(p) for p in parts if len(p) == 2048]
    odd = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in parts)
    return least <= ratio(data) <= most and 4 * odd <= len(parts) and all(bands.far[0] <= r <= bands.far[1] for r in parts)


def test_verdict_is_recomputed(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op9_compression_bands(spark, folder).collect()
    assert len(rows) == len(docs) and {r["doc_id"]: r["kept"] for r in rows} == {r["doc_id"]: not r["base_failed"] and plain_verdict(docs[r["doc_id"]]) for r in rows}


def test_bands_keep_clean_and_reject_odd(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_compression_bands(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    judge, rng = quality.CompressionJudge(quality.Bands()), random.Random(1)
    verdict = lambda data: judge.accepts(len(data), *judge.measure(data))
    assert not verdict(b"the same words again " * 200) and not verdict(rng.randbytes(4000))
    own = max((r for r in clean), key=lambda r: r["n_words"])
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}[own["doc_id"]].encode()
    assert verdict(text) and not verdict(text + b"filler " * len(text))


# -- 10 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.load_ranks(queries.RANKS), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'strevmlld.,!?é中🙂　\xa0")), st.characters(codec="utf-8")), max_size=120))
def test_bpe_is_the_library(coder, text):
    whole, bpe.TEXT_LEAF = bpe.TEXT_LEAF, 7
    try:
        ids = coder.encode(text)
    finally:
        bpe.TEXT_LEAF = whole
    assert ids == coder.base.encode_ordinary(text) and coder.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "tion", "ab", "xyz", "é", "中", "zz", "ABC"]), min_size=1, max_size=40))
def test_long_words(coder, parts):
    word, leaf = "".join(parts), bpe.BYTE_LEAF
    bpe.BYTE_LEAF = 3
    try:
        data = word.encode()
        assert word.isalpha() and coder.reduce_bytes(data, 0, len(data)) == coder.merge(data)
    finally:
        bpe.BYTE_LEAF = leaf


def test_bpe_query(spark, texts, coder):
    for r in queries.op10_bpe_tree(spark, SMALL).collect():
        ids = coder.base.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


# -- SQL and the pipeline ------------------------------------------------------------


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, SMALL)
        columns = ", ".join(frame.columns)
        assert sorted(map(tuple, frame.collect()), key=repr) == sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall(), key=repr)


def test_pipeline(spark, texts, coder):
    import corpus_pipeline

    kept = {}
    for i, text in texts.items():
        data = (text or "").encode()
        counts = quality.base_counts(data)
        if not quality.base_fails(counts[0], counts[4]) and plain_verdict(data):
            kept[i] = text
    ids = sorted(kept)
    held = [{tuple(w[k : k + 5]) for w in [kept[i].encode().lower().split()] for k in range(max(1, len(w) - 4))} for i in ids]
    root = groups(len(ids), ((i, j) for i in range(len(ids)) for j in range(i) if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])))
    kept = {i: kept[i] for k, i in enumerate(ids) if root[k] == k}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontam.words_of(t.encode())] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(g and len(grams(t) & g) >= 0.7 * len(g) for g in items)}
    one = secret_scan.finder(secret_scan.train())
    want = {}
    for i, text in kept.items():
        data = text.encode()
        for a, b, *_ in reversed(one(data)):
            data = data[:a] + b"[SECRET]" + data[b:]
        want[i] = hashlib.sha256(data).hexdigest()
    assert {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    """Words in another order leave all counts as they are, so only weights that were learned from a text can tell."""
    from quillmark.llm import lm

    monkeypatch.setattr(lm, "WARM_TOKENS", 0)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]

    def scores(turned):
        docs = spark.createDataFrame([(i, " ".join(reversed(t.split())) if i in turned else t) for i, t in enumerate(texts)], "doc_id long, text string")
        return {r["doc_id"]: (r["base_score"], r["score"]) for r in lm.held_out_scores(docs.coalesce(1)).collect() if r["held_out"]}

    plain = scores(())
    assert scores(()) == plain
    # two halves of the ids, as a hash parts them
    half = {r["i"] for r in spark.range(40).selectExpr("id AS i", "pmod(xxhash64('share', id), 1000000) < 500000 AS first").where("first").collect()}
    for own in ([i for i in train if i in half], [i for i in train if i not in half]):
        turned = scores(own[:1])
        assert all(turned[i][0] == plain[i][0] and turned[i][1] != plain[i][1] for i in plain)


def test_gru_reads_every_token():
    model = gru.initial(np.full(gru.WORDS, 1e-4), np.full(gru.RARE_CLASSES, 1e-3))
    texts = [np.arange(n) % gru.WORDS for n in (50, 49, 108)]
    assert gru.train(model, texts, streams=10)[1] == 207
    last = [*texts[:2], np.concatenate([texts[2][:-1], [7]])]
    a, b = (gru.flat(gru.train(model, t, streams=10)[0]) for t in (texts, last))
    assert not np.array_equal(a, b)
