import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import scalar


def test_normalize(spark):
    rows = spark.createDataFrame([(" C:\\Users\\Alice  ",), ("　Ａ　Ｂ\u00a0c",), (None,)], "v string")
    assert [r[0] for r in rows.select(scalar.normalize(F.col("v"))).collect()] == ["c:/users/alice", "a b c", ""]
    assert scalar.normalize_text(" C:\\Users\\Alice  ") == "c:/users/alice"


def test_simhash_vectors(spark):
    assert scalar.SimHasher()("ab") == "243f4c2efc208efb" == scalar.SimHasher()("AB ab")
    assert scalar.SimHasher()("a . ,") == "" == scalar.SimHasher()(None)
    row = spark.createDataFrame([("243f4c2efc208efb", "243f4c2efc208ef8", "")], "a string, b string, c string")
    assert row.select(scalar.hamming(F.col("a"), F.col("b")), scalar.hamming(F.col("a"), F.col("c"))).first()[:] == (2, 64)


@given(st.lists(st.text(alphabet="abcé1_ .", max_size=12), max_size=6))
def test_simhash_is_the_vote(parts):
    text = " ".join(parts)
    tokens = scalar._TOKEN.findall(scalar.normalize_text(text))
    votes = [sum(1 if hashlib.sha256(t.encode()).digest()[i >> 3] >> (i & 7) & 1 else -1 for t in tokens) for i in range(64)]
    assert scalar.SimHasher()(text) == (f"{sum(1 << i for i, v in enumerate(votes) if v >= 0):016x}" if tokens else "")


def test_labels(spark):
    row = spark.range(1).select(scalar.format_bytes(F.lit(1280)), scalar.format_bytes(F.lit(None)), scalar.finding_level(F.lit(85)), scalar.finding_level(F.lit(39)), scalar.risk_level(F.lit(45)), scalar.kind_label(F.lit("ole")), scalar.extension(F.lit("a/.b")), scalar.extension(F.lit("a/b.C.Docx")), scalar.decode_xml(F.lit("&amp;lt;&lt;"))).first()
    assert row[:] == ("1.3 KB", "0 B", "极高风险", "低风险", "中风险", "其他", "", ".docx", "&lt;<")
