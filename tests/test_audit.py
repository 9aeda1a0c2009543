import itertools
import random

from pyspark.sql import functions as F

from quillmark.functions.scalar import normalize_text
from quillmark.operators import audit, correlate, review

SCHEMA = "submission_id string, supplier string, zip_name string, path string, name string, kind string, size long, sha256 string, ord long, attributes map<string,string>, lists map<string,array<string>>, fingerprint string"


def files(spark, *rows):
    base = {"kind": "word", "size": 1, "attributes": {}, "lists": {}, "fingerprint": ""}
    full = [base | {"submission_id": r["supplier"], "zip_name": r["supplier"] + ".zip", "name": r["path"], "ord": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in full], SCHEMA)


def test_exact_pair_and_options(spark):
    own = {"attributes": {"lastEditor": "rare-user"}, "fingerprint": "0011223344556677"}
    both = files(spark, {"supplier": "甲", "path": "a.docx", "sha256": "x"} | own, {"supplier": "乙", "path": "a.docx", "sha256": "x"} | own)
    found = correlate.correlate(both).collect()
    assert [r["weight"] for r in found] == [95, 90, 55]
    assert found[0]["type"] == "相同文件" and found[0]["file_a"] == "甲.zip/a.docx"
    other = both.withColumn("sha256", F.col("supplier"))
    assert correlate.correlate(other, metadata_on=False, simhash_on=False).count() == 0
    assert {r["level"]: r["n"] for r in correlate.by_level(correlate.correlate(both)).collect()} == {"极高风险": 2, "高风险": 0, "中风险": 1, "低风险": 0}


def test_attribute_audit(spark):
    rows = [{"supplier": s, "path": f"{s}.x", "sha256": s, "kind": k, "attributes": {"author": a, "application": "WPS"}} for s, k, a in (("a", "word", "admin"), ("b", "pdf", "Admin "), ("c", "word", "ADMIN"))]
    groups = {r["field"]: r for r in audit.attribute_groups(files(spark, *rows)).collect()}
    assert (groups["author"]["kind"], groups["author"]["risk"], groups["author"]["value"], groups["author"]["n_files"]) == ("mixed", "高风险", "admin", 3)
    assert (groups["application"]["risk"], groups["application"]["n_files"]) == ("低风险", 2)
    issues = review.file_issues(files(spark, *rows)).where("path = 'b.x'").collect()
    assert [(r["issue"], r["level"], r["peers"]) for r in issues] == [("作者重复", "high", "a / a.x；c / c.x")]


def test_arrays_keep_order_and_repeats(spark):
    a = {"supplier": "a", "path": "1", "sha256": "1", "lists": {"localPaths": ["C:\\x", "c:/X", "D:\\y", "C:\\x", "E:\\z", "F:\\q", "G:\\r"]}}
    b = {"supplier": "b", "path": "2", "sha256": "2", "lists": {"localPaths": ["g:\\R", "f:\\q", "d:/y", "c:\\x", "e:\\z"]}}
    assert [r["value"] for r in correlate.arrays(files(spark, a, b)).orderBy("pos").collect()] == ["c:/x", "c:/x", "d:/y", "c:/x", "e:/z"]


def test_similar_is_brute_force(spark):
    import random

    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(12)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(4)]
    rows = [{"supplier": f"s{i % 7}", "path": str(i), "sha256": str(i), "fingerprint": f"{p:016x}"} for i, p in enumerate(prints)]
    want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if i % 7 != j % 7 and (prints[i] ^ prints[j]).bit_count() <= 3}
    got = [(r["ord_a"], r["ord_b"]) for r in correlate.similar(files(spark, *rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_property_rows(spark):
    own = files(spark, {"supplier": "a", "path": "d/p.pptx", "sha256": "1", "kind": "powerpoint", "attributes": {"author": "张三", "revision": "7", "totalEditingTime": "37"}})
    rows = {(r["group_id"], r["name"]): r["value"] for r in review.property_groups(own).collect()}
    assert rows["common", "作者"] == "张三" and rows["common", "最后一次保存者"] == "未提取到" and rows["document", "总编辑时间"] == "37 分钟"
    assert sum(g == "common" for g, _ in rows) == 5 + 9


def test_empty_tables(spark):
    none = files(spark, {"supplier": "a", "path": "p", "sha256": "1"}).where("false")
    assert audit.exact_groups(none).count() == audit.attribute_groups(none).count() == correlate.correlate(none).count() == review.file_issues(none).count() == 0
    assert audit.summary(none).first()["file_count"] == 0


def test_split_and_packages(spark):
    rows = files(spark, *({"supplier": "all", "path": p, "sha256": p[-1]} for p in ("x/1", "y/1", "y/2")))
    assert {r["supplier"] for r in review.split_by_top_directory(rows).collect()} == {"x", "y"}
    mixed = files(spark, *({"supplier": "all", "path": p, "sha256": p[-1]} for p in ("x/1", "2")))
    assert {r["supplier"] for r in review.split_by_top_directory(mixed).collect()} == {"all"}
    assert normalize_text("\u3000A\tB ") == "a b"


def test_near_fingerprints_are_brute_force(spark):
    rng = random.Random(7)
    values = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(40):
        values.append(rng.getrandbits(64))
        values += [values[-1] ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    distance = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    expected = sorted((a, b, distance(a, b)) for a in signed for b in signed if distance(a, b) <= 3)
    prints = spark.createDataFrame([(v,) for v in signed], "bits long")
    for shared in (1, 2):
        assert sorted(map(tuple, correlate.near_fingerprints(prints, 3, shared).collect())) == expected
    assert correlate.near_fingerprints(prints.limit(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_scalar_group_is_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(correlate, "CHUNK", 8)
    monkeypatch.setattr(correlate, "BLOCK", 32)
    rows = [{"supplier": f"s{i % 5}", "path": str(i), "sha256": str(i), "attributes": {"author": "Ann" if i % 2 else "ANN "} if i < 300 else {"author": f"own {i // 2}", "company": "Ann"}} for i in range(320)]
    names = [r["attributes"]["author"].strip().lower() for r in rows]
    want = {(i, j, rows[i]["attributes"]["author"]) for i, j in itertools.combinations(range(320), 2) if i % 5 != j % 5 and names[i] == names[j]}
    want |= {(i, j, "Ann") for i, j in itertools.combinations(range(300, 320), 2) if i % 5 != j % 5}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = correlate.scalars(files(spark, *rows)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(found) == len(want) and {(r["ord_a"], r["ord_b"], r["value"]) for r in found} == want
    assert len({r["task"] for r in found if r["value"].strip().lower() == "ann" and r["ord_b"] < 300}) > 1


def test_arrays_are_brute_force_without_shuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(correlate, "CHUNK", 2)
    monkeypatch.setattr(correlate, "BLOCK", 8)
    rng = random.Random(3)
    lists = [[rng.choice("ABCDEFGH") for _ in range(rng.randint(0, 9))] for _ in range(25)]
    own = [lists[i % 25] + [""] * (i % 2) for i in range(90)]
    rows = [{"supplier": f"s{i % 4}", "path": str(i), "sha256": str(i), "lists": {"externalLinks": x}} for i, x in enumerate(own)]
    want = [(i, j, pos, v.lower()) for i, j in itertools.combinations(range(90), 2) if i % 4 != j % 4 for pos, v in [(p, v) for p, v in enumerate(own[i]) if v and v in own[j]][:5]]
    found = correlate.arrays(files(spark, *rows))
    assert sorted((r["ord_a"], r["ord_b"], r["pos"], r["value"]) for r in found.collect()) == sorted(want)
    assert "Window" not in _plan(found)


def test_all_findings_are_sorted_only_where_asked_for(spark):
    from quillmark.plans import catalogue

    assert "rangepartitioning" not in _plan(catalogue.queries()["findings_all"](spark, "/root/testdata/sf0.001"))
    rows = [{"supplier": f"s{i}", "path": str(i), "sha256": "x" if i > 2 else str(i), "attributes": {"company": "c", "lastEditor": "e"}} for i in range(5)]
    order = [(-r["weight"], r["ord_a"], r["ord_b"]) for r in correlate.correlate(files(spark, *rows)).collect()]
    assert len(order) == 21 and order == sorted(order)
