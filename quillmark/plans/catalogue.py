"""The reference operators' queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import audit, correlate, review
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# -- shared SQL -----------------------------------------------------------------


def _bytes(n: str) -> str:
    part = lambda unit, name: f"printf('%.1f', floor({n} / {unit}.0 * 10 + 0.5) / 10) || ' {name}'"
    return f"CASE WHEN {n} < 1024 THEN {n}::VARCHAR || ' B' WHEN {n} < 1048576 THEN {part(1024, 'KB')} WHEN {n} < 1073741824 THEN {part(1048576, 'MB')} ELSE {part(1073741824, 'GB')} END"


def _norm(v: str) -> str:
    return f"lower(trim(regexp_replace(replace({v}, '\\', '/'), '\\s+', ' ', 'g')))"


def _id(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


D = "d AS (SELECT source AS submission_id, source AS supplier, source || '.zip' AS zip_name, 'doc_' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, doc_id AS ord, text, doc_id, lang, 'text' AS kind FROM documents)"
DA = D.replace("'text' AS kind", "['word', 'pdf', 'image'][(doc_id % 3 + 1)::INT] AS kind")
_DA_LONG = """a AS (
  SELECT supplier, zip_name, path, kind, ord, 'author' AS field, '作者' AS label, 85 AS weight, split_part(text, chr(10), 1) AS value FROM d
  UNION ALL SELECT supplier, zip_name, path, kind, ord, CASE kind WHEN 'word' THEN 'application' WHEN 'pdf' THEN 'producer' ELSE 'software' END, CASE kind WHEN 'word' THEN '程序名称' WHEN 'pdf' THEN '制作工具' ELSE '创建软件' END, 35, lang FROM d
  UNION ALL SELECT supplier, zip_name, path, kind, ord, 'revision', '修订号', 55, l.quality::VARCHAR FROM d JOIN labels l ON l.doc_id = d.doc_id WHERE kind = 'word'
)"""
P = "d AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS supplier, 'page_' || page_id AS path, 'pdf' AS kind, page_id AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links, url, html FROM pages)"
_P_LONG = """a AS (
  SELECT supplier, path, kind, ord, 'title' AS field, '标题' AS label, 50 AS weight, title AS value FROM d
  UNION ALL SELECT supplier, path, kind, ord, 'producer', '制作工具', 35, lang FROM d
)"""
_E_LONG = "a AS (SELECT user_id::VARCHAR AS supplier, 'event_' || event_id AS path, 'word' AS kind, event_id AS ord, 'revision' AS field, '修订号' AS label, 55 AS weight, json_extract_string(props, '$.k') AS value FROM events)"
_GROUPS = f"""n AS (SELECT *, {_norm('value')} AS norm FROM a WHERE value IS NOT NULL AND value <> ''),
g AS (SELECT field, norm, arg_min(value, ord) AS value, arg_min(label, ord) AS label, max(weight)::INT AS weight, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind, count(*) AS n_files, count(DISTINCT supplier) AS n_suppliers
  FROM n WHERE norm <> '' GROUP BY field, norm HAVING count(*) > 1 AND count(DISTINCT supplier) > 1),
gr AS (SELECT *, {_id("'attribute:' || field || ':' || norm")} AS group_id, CASE WHEN weight >= 70 THEN '高风险' WHEN weight >= 45 THEN '中风险' ELSE '低风险' END AS risk FROM g)"""
_EXACT = f"e AS (SELECT sha256, arg_min(size, ord) AS size, count(*) AS n_files, count(DISTINCT supplier) AS n_suppliers, {_id("'file:' || sha256")} AS group_id FROM d GROUP BY sha256 HAVING count(*) > 1 AND count(DISTINCT supplier) > 1)"
_LEVEL = "CASE WHEN weight >= 85 THEN '极高风险' WHEN weight >= 65 THEN '高风险' WHEN weight >= 40 THEN '中风险' ELSE '低风险' END"
_FINDING = f"{_id("concat_ws('|', type, supplier_a, supplier_b, value, path_a, path_b)")} AS finding_id, type, {_LEVEL} AS level, weight, supplier_a, supplier_b, zip_a || '/' || path_a AS file_a, zip_b || '/' || path_b AS file_b, value"
_REFS = "a.supplier AS supplier_a, b.supplier AS supplier_b, a.zip_name AS zip_a, b.zip_name AS zip_b, a.path AS path_a, b.path AS path_b"
_PAIR = "a.ord < b.ord AND a.supplier <> b.supplier"
_F_EXACT = f"fx AS (SELECT '相同文件' AS type, 95 AS weight, a.sha256 AS value, {_REFS} FROM d a JOIN d b ON a.sha256 = b.sha256 AND {_PAIR})"
_F_META = f"au AS (SELECT *, split_part(text, chr(10), 1) AS author, {_norm("split_part(text, chr(10), 1)")} AS norm FROM d), fm AS (SELECT '相同作者' AS type, 85 AS weight, a.author AS value, {_REFS} FROM au a JOIN au b ON a.norm = b.norm AND a.norm <> '' AND {_PAIR})"
_HASH = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all({_norm('text')}, '[\\p{{L}}\\p{{N}}]{{2,}}')) AS token FROM d),
cnt AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY doc_id, token),
hex AS (SELECT *, sha256(token) AS h FROM cnt),
val AS (SELECT doc_id, c, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT AS v FROM hex),
bit AS (SELECT doc_id, i, sum(CASE WHEN (v >> i) & 1 = 1 THEN c ELSE -c END) AS s FROM val, range(64) r(i) GROUP BY doc_id, i),
fp AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END)::UBIGINT AS f FROM bit GROUP BY doc_id)"""
_F_SIM = f"""df AS (SELECT d.*, f, lower(lpad(printf('%x', f), 16, '0')) AS hexf FROM d JOIN fp USING (doc_id)),
fs AS (SELECT '文本高度相似' AS type, 55 AS weight, a.hexf || ' / 距离 ' || bit_count(xor(a.f, b.f)) AS value, {_REFS} FROM df a JOIN df b ON {_PAIR} AND bit_count(xor(a.f, b.f)) <= 3)"""


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _plain(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", "type", "level", "weight", "supplier_a", "supplier_b", "file_a", "file_b", "value")


# -- audit ------------------------------------------------------------------------


@query(f"WITH {D}, {_EXACT} SELECT group_id, sha256, size, {_bytes('size')} AS size_label, n_files, n_suppliers FROM e")
def exact_file_groups(spark, folder):
    return audit.exact_groups(adapters.documents(spark, folder))


@query(f"WITH {D}, {_EXACT} SELECT group_id, supplier, path, d.size AS size, sha256 FROM d JOIN e USING (sha256)")
def exact_file_members(spark, folder):
    return audit.exact_members(adapters.documents(spark, folder))


_C = "c AS (SELECT conv_id::VARCHAR AS supplier, conv_id, turn || '_' || role || '.txt' AS path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size, conv_id * 100000 + turn AS ord FROM conversations)"
_M = "m AS (SELECT supplier, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS manifest_hash, count(*) AS file_count, sum(size)::BIGINT AS total_size, min(ord) AS ord FROM c GROUP BY supplier)"


@query(f"""WITH {_C}, {_M}, two AS (SELECT * FROM m UNION ALL SELECT supplier || '-copy', manifest_hash, file_count, total_size, ord + 1000000000000 FROM m WHERE supplier::BIGINT % 7 = 0)
SELECT {_id("'package:' || manifest_hash")} AS group_id, manifest_hash, string_agg(supplier, '、' ORDER BY ord) AS suppliers, arg_min(file_count, ord) AS file_count, arg_min(total_size, ord) AS total_size, {_bytes('arg_min(total_size, ord)')} AS total_size_label FROM two GROUP BY manifest_hash HAVING count(*) > 1""")
def identical_packages(spark, folder):
    files = adapters.conversations(spark, folder)
    # the tables have no identical packages, so some are submitted again under another name
    again = files.where(F.col("supplier").cast("long") % 7 == 0).withColumns({"supplier": F.concat("supplier", F.lit("-copy")), "submission_id": F.concat("submission_id", F.lit("-copy")), "ord": F.col("ord") + 1000000000000})
    return audit.identical_packages(audit.manifest_hashes(files.unionByName(again)))


@query(f"WITH {D} SELECT supplier, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS manifest_hash FROM d GROUP BY supplier")
def manifest_hash(spark, folder):
    return audit.manifest_hashes(adapters.documents(spark, folder)).select("supplier", "manifest_hash")


@query(f"WITH {_C} SELECT supplier, sha256(string_agg(path, chr(10) ORDER BY ord, path)) AS structure_hash FROM c GROUP BY supplier")
def structure_hash(spark, folder):
    return audit.structure_hashes(adapters.conversations(spark, folder)).select(F.col("submission_id").alias("supplier"), "structure_hash")


@query(f"WITH {DA} SELECT supplier, count(*) AS file_count, sum(size)::BIGINT AS total_size, {_bytes('sum(size)::BIGINT')} AS size_label, 0::BIGINT AS parse_errors FROM d GROUP BY supplier")
def supplier_stats(spark, folder):
    return audit.supplier_stats(adapters.attributed(spark, folder)).select("supplier", "file_count", "total_size", "size_label", "parse_errors")


@query(f"WITH {DA} SELECT supplier, kind, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT user_id::VARCHAR, event_type, count(*) FROM events GROUP BY ALL")
def supplier_kind_counts(spark, folder):
    events = adapters.events(spark, folder).withColumn("kind", F.col("event_type")).drop("event_type")
    files = adapters.attributed(spark, folder).select(*events.columns).unionByName(events)
    return audit.supplier_stats(files).select("supplier", F.explode("types").alias("kind", "n"))


@query(f"""WITH {DA}, {_EXACT}, {_DA_LONG}, {_GROUPS}, m AS (SELECT supplier, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS h FROM d GROUP BY supplier)
SELECT count(DISTINCT supplier) AS supplier_count, count(*) AS file_count, sum(size)::BIGINT AS total_size, (SELECT count(*) FROM (SELECT h FROM m GROUP BY h HAVING count(*) > 1)) AS identical_package_groups, (SELECT count(*) FROM e) AS exact_file_groups, (SELECT count(*) FROM gr) AS attribute_match_groups, {_bytes('sum(size)::BIGINT')} AS total_size_label FROM d""")
def audit_summary(spark, folder):
    return audit.summary(adapters.attributed(spark, folder))


@query(f"WITH {DA}, {_DA_LONG}, {_GROUPS} SELECT group_id, field, value, label, kind, weight, risk, n_files, n_suppliers FROM gr")
def attribute_groups(spark, folder):
    return audit.attribute_groups(adapters.attributed(spark, folder))


@query(f"WITH {P}, {_P_LONG}, {_GROUPS} SELECT group_id, gr.field AS field, supplier, path FROM n JOIN gr ON n.field = gr.field AND n.norm = gr.norm")
def attribute_group_members(spark, folder):
    return audit.attribute_members(adapters.pages(spark, folder)).select("group_id", "field", "supplier", "path")


@query(f"WITH {_E_LONG}, {_GROUPS} SELECT field, value, n_files, n_suppliers FROM gr")
def attribute_groups_json(spark, folder):
    return audit.attribute_groups(adapters.events(spark, folder)).select("field", "value", "n_files", "n_suppliers")


# -- findings -----------------------------------------------------------------------


@query(f"WITH {D}, {_F_EXACT} SELECT {_FINDING} FROM fx")
def findings_exact(spark, folder):
    return _plain(correlate.exact(adapters.documents(spark, folder)))


@query(f"WITH {DA}, {_F_META} SELECT {_FINDING} FROM fm")
def findings_metadata(spark, folder):
    return _plain(correlate.scalars(adapters.attributed(spark, folder)))


@query(f"""WITH {P}, el AS (SELECT supplier, supplier || '.zip' AS zip_name, path, ord, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos FROM d), l AS (SELECT *, {_norm('link')} AS value FROM el),
r AS (SELECT DISTINCT supplier, zip_name, path, ord, value FROM l WHERE value <> ''),
pr AS (SELECT '相同外部链接' AS type, 55 AS weight, a.value AS value, a.pos AS pos, {_REFS}, row_number() OVER (PARTITION BY a.ord, b.ord ORDER BY a.pos) AS place FROM l a JOIN r b ON a.value = b.value AND {_PAIR})
SELECT {_FINDING}, pos::INT AS pos FROM pr WHERE place <= 5""")
def findings_arrays(spark, folder):
    found = correlate.arrays(adapters.pages(spark, folder))
    return found.select("finding_id", "type", "level", "weight", "supplier_a", "supplier_b", "file_a", "file_b", "value", "pos")


@query(f"WITH {D}, {_HASH}, {_F_SIM} SELECT {_FINDING} FROM fs")
def findings_simhash(spark, folder):
    return _plain(correlate.similar(adapters.fingerprinted(spark, folder)))


@query(f"WITH {DA}, {_F_EXACT}, {_F_META}, {_HASH}, {_F_SIM}, f AS (SELECT * FROM fx UNION ALL SELECT * FROM fm UNION ALL SELECT * FROM fs) SELECT {_FINDING} FROM f")
def findings_all(spark, folder):
    return _plain(correlate.correlate(adapters.attributed(spark, folder, prints=True), ordered=False))


@query(f"""WITH {DA}, {_F_EXACT}, {_F_META}, {_HASH}, {_F_SIM}, f AS (SELECT weight FROM fx UNION ALL SELECT weight FROM fm UNION ALL SELECT weight FROM fs), g AS (SELECT {_LEVEL} AS level, count(*) AS n FROM f GROUP BY 1)
SELECT l.level AS level, coalesce(n, 0) AS n FROM (VALUES ('极高风险'), ('高风险'), ('中风险'), ('低风险')) l(level) LEFT JOIN g USING (level)""")
def findings_by_level(spark, folder):
    return correlate.by_level(correlate.correlate(adapters.attributed(spark, folder, prints=True), ordered=False))


# -- scalar functions -------------------------------------------------------------------


@query(f"WITH {D}, {_HASH} SELECT d.doc_id AS doc_id, coalesce(lower(lpad(printf('%x', f), 16, '0')), '') AS fingerprint FROM d LEFT JOIN fp USING (doc_id)")
def simhash_fingerprint(spark, folder):
    return adapters.fingerprinted(spark, folder).select("doc_id", "fingerprint")


@query(f"SELECT doc_id, sha256({_norm('text')}) AS normalised FROM documents")
def normalize_text(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", F.sha2(scalar.normalize(F.col("text")), 256).alias("normalised"))


@query(f"WITH n AS (SELECT doc_id, n_chars * n_chars * 37 AS n FROM documents) SELECT doc_id, n, {_bytes('n')} AS label FROM n")
def format_bytes(spark, folder):
    n = F.col("n_chars") * F.col("n_chars") * 37
    return adapters.table(spark, folder, "documents").select("doc_id", n.alias("n"), scalar.format_bytes(n).alias("label"))


# First bytes (hex), extension.
_MAGIC = (("504B0304", ".docx"), ("504B0304", ".XLSM"), ("504B0304", ".pptx"), ("504B0304", ".jar"), ("255044462D312E37", ".pdf"), ("FFD8FFE0", ".jpg"), ("89504E470D0A1A0A", ".png"), ("49492A00", ".tif"), ("4D4D002A", ".tiff"), ("524946460000000057454250", ".webp"), ("D0CF11E0A1B11AE1", ".doc"), ("D0CF11E0A1B11AE1", ".msg"), ("41", ".txt"), ("41", ".bin"), ("424D", ".bmp"))


@query("WITH m(head, ext, mime, kind) AS (VALUES " + ", ".join(f"('{h}', '{e}', '{m}', '{k}')" for (h, e), (m, k) in zip(_MAGIC, (("application/zip", "word"), ("application/zip", "excel"), ("application/zip", "powerpoint"), ("application/zip", "zip"), ("application/pdf", "pdf"), ("image/jpeg", "image"), ("image/png", "image"), ("image/tiff", "image"), ("image/tiff", "image"), ("image/webp", "image"), ("application/x-ole-storage", "word-legacy"), ("application/x-ole-storage", "ole"), ("text/plain", "text"), ("application/octet-stream", "other"), ("application/octet-stream", "other")), strict=True)) + ") SELECT 'dir/doc_' || doc_id || ext AS path, mime, kind FROM documents, m")
def classify_magic(spark, folder):
    heads = spark.createDataFrame(list(_MAGIC), "head string, ext string")
    # fifteen fixed heads, one row each for every document
    rows = adapters.table(spark, folder, "documents").join(F.broadcast(heads), F.lit(True)).select(F.concat(F.lit("dir/doc_"), F.col("doc_id").cast("string"), "ext").alias("path"), F.concat(F.unhex("head"), F.col("text").cast("binary")).alias("content"))
    mime, kind = scalar.classify(F.col("path"), F.col("content"))
    return rows.select("path", mime.alias("mime"), kind.alias("kind"))


def _matches(spark, folder, tail, extract):
    text = F.concat("text", tail)
    found = extract(text)
    return adapters.table(spark, folder, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("joined"))


def _matches_sql(tail: str, pattern: str, cap: int) -> str:
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(text || {tail}, '{pattern}') AS m FROM documents), u AS (SELECT doc_id, list_transform(list_filter(list_zip(m, range(len(m))), lambda x: list_position(m, x[1]) = x[2] + 1), lambda x: x[1])[1:{cap}] AS k FROM t)
SELECT doc_id, len(k)::BIGINT AS n, array_to_string(k, '|') AS joined FROM u"""


@query(_matches_sql("""' <a x="C:\\t\\' || source || '" y="file:///srv/' || lang || '" z="C:\\t\\' || source || '">'""", """(?:[A-Za-z]:\\\\|file:///)[^<"'']+""", 50))
def extract_local_paths(spark, folder):
    tail = F.concat(F.lit(' <a x="C:\\t\\'), "source", F.lit('" y="file:///srv/'), "lang", F.lit('" z="C:\\t\\'), "source", F.lit('">'))
    return _matches(spark, folder, tail, scalar.local_paths)


@query(_matches_sql("""' <a href="https://example.com/' || source || '"/><b>http://' || lang || '.example.org</b><a href="https://example.com/' || source || '"/>'""", """https?://[^<"'']+""", 50))
def extract_links(spark, folder):
    tail = F.concat(F.lit(' <a href="https://example.com/'), "source", F.lit('"/><b>http://'), "lang", F.lit('.example.org</b><a href="https://example.com/'), "source", F.lit('"/>'))
    return _matches(spark, folder, tail, scalar.external_links)


@query(_matches_sql("""' {' || substr(md5(source), 1, 8) || '-1111-2222-3333-' || substr(md5(lang), 1, 12) || '} ' || upper(substr(md5(source), 1, 8)) || '-1111-2222-3333-444444444444'""", """(?i)[0-9a-f]{8}-[0-9a-f-]{27,}""", 20))
def extract_guids(spark, folder):
    tail = F.concat(F.lit(" {"), F.substring(F.md5("source"), 1, 8), F.lit("-1111-2222-3333-"), F.substring(F.md5("lang"), 1, 12), F.lit("} "), F.upper(F.substring(F.md5("source"), 1, 8)), F.lit("-1111-2222-3333-444444444444"))
    return _matches(spark, folder, tail, scalar.document_ids)


@query("SELECT 'doc_' || doc_id AS path, doc_id % 3 <> 0 AS has_macros FROM documents")
def macro_flag(spark, folder):
    part = F.element_at(F.array(*map(F.lit, ("word/media/a.png", "word/vbaProject.bin", "xl/VBAPROJECT.BIN"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return adapters.table(spark, folder, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), scalar.has_macros(F.array(F.lit("word/document.xml"), part)).alias("has_macros"))


@query("SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_markup_text(spark, folder):
    return adapters.table(spark, folder, "pages").select("page_id", scalar.strip_markup(F.col("html")).alias("text"))


@query("SELECT doc_id, substr(repeat(text, 40), 1, 200000) AS sample FROM documents")
def text_sample(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", scalar.text_sample(F.repeat("text", F.lit(40))).alias("sample"))


# -- review -----------------------------------------------------------------------------

_KEYS = {"word": ("author", "", "revision", "", "application", "", "", "", ""), "pdf": ("author", "", "", "", "", "producer", "", ""), "image": ("author", "", "", "software")}
_KEY_LABELS = {"word": ("作者", "最后一次保存者", "修订号", "版本号", "程序名称", "公司", "管理者", "创建内容的时间", "最后一次保存的日期"), "pdf": ("作者", "标题", "主题", "关键词", "创建程序", "制作工具", "创建时间", "修改时间"), "image": ("作者", "标题", "说明", "创建软件")}
_KEY_VALUES = ", ".join(f"('{k}', {i}, '{label}', '{field}')" for k in _KEYS for i, (label, field) in enumerate(zip(_KEY_LABELS[k], _KEYS[k], strict=True)))


@query(f"WITH {DA}, {_DA_LONG}, k(kind, pos, label, field) AS (VALUES {_KEY_VALUES}) SELECT d.supplier AS supplier, d.path AS path, pos, k.label AS label, coalesce(a.value, '') AS value FROM d JOIN k USING (kind) LEFT JOIN a ON a.path = d.path AND a.field = k.field")
def key_metadata(spark, folder):
    return review.key_metadata(adapters.attributed(spark, folder))


_OFFICE_NAMES = ", ".join(f"({i}, '{n}', '{f}')" for i, (n, f) in enumerate(zip(_KEY_LABELS["word"], _KEYS["word"], strict=True)))
_PDF_NAMES = ", ".join(f"({i}, '{n}', '{f}')" for i, (n, f) in enumerate((("作者", "author"), ("标题", ""), ("主题", ""), ("关键词", ""), ("创建程序", ""), ("制作工具", "producer"), ("创建时间", ""), ("修改时间", ""), ("陷印状态", ""), ("元数据时间", "metadataDate"))))
_PROPERTIES = f"""{DA}, {_DA_LONG}, pr AS (
  SELECT supplier, path, 'common' AS group_id, '常见文件属性' AS group_title, name, value, NULL AS xmp FROM (SELECT supplier, path, unnest(['文件名', 'ZIP 内路径', '文件类型', '文件大小', 'SHA-256']) AS name, unnest([path, path, kind, {_bytes('size')}, sha256]) AS value FROM d)
  UNION ALL SELECT d.supplier, d.path, 'common', '常见文件属性', o.name, coalesce(nullif(a.value, ''), '未提取到'), NULL FROM d JOIN (VALUES {_OFFICE_NAMES}) o(pos, name, field) ON d.kind = 'word' LEFT JOIN a ON a.path = d.path AND a.field = o.field
  UNION ALL SELECT d.supplier, d.path, 'common', '常见文件属性', '作者', value, NULL FROM d JOIN a USING (path) WHERE d.kind = 'image' AND field = 'author' AND value <> ''
  UNION ALL SELECT d.supplier, d.path, 'pdf-metadata', '说明', o.name, CASE WHEN o.field = 'metadataDate' THEN '不适用' ELSE coalesce(nullif(a.value, ''), '未提取到') END, '未提取到' FROM d JOIN (VALUES {_PDF_NAMES}) o(pos, name, field) ON d.kind = 'pdf' LEFT JOIN a ON a.path = d.path AND a.field = o.field
  UNION ALL SELECT d.supplier, d.path, 'document', CASE d.kind WHEN 'word' THEN 'Word 专有属性' WHEN 'pdf' THEN 'PDF 文件结构' ELSE '图片属性' END, '图片作者', value, NULL FROM d JOIN a USING (path) WHERE field = 'author' AND value <> ''
  UNION ALL SELECT d.supplier, d.path, 'document', '图片属性', '创建软件', value, NULL FROM d JOIN a USING (path) WHERE field = 'software' AND value <> ''
)"""


@query(f"WITH {_PROPERTIES} SELECT path, group_id, name, value FROM pr")
def property_groups(spark, folder):
    return review.property_groups(adapters.attributed(spark, folder)).select("path", "group_id", "name", "value")


@query(f"WITH {_PROPERTIES} SELECT supplier, path AS file, group_title AS \"group\", name, CASE WHEN xmp IS NULL THEN value ELSE json_object('info', CASE WHEN name = '制作工具' AND value <> '未提取到' THEN 'C:\\t\"' || chr(10) || value ELSE value END, 'xmp', xmp)::VARCHAR END AS value FROM pr")
def all_properties_sheet(spark, folder):
    from .reports import properties_sheet

    # PDF producers with what JSON must escape
    odd = F.transform_values("attributes", lambda k, v: F.when(k == "producer", F.concat(F.lit('C:\\t"\n'), v)).otherwise(v))
    return properties_sheet(adapters.attributed(spark, folder).withColumn("attributes", odd))


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"WITH p AS (SELECT page_id, {_URL_PATH} AS p FROM pages) SELECT page_id, regexp_extract(p, '^((?:.*/)?)', 1) AS directory, regexp_extract(p, '([^/]*)$', 1) AS basename FROM p")
def path_parts(spark, folder):
    directory, base = review.path_parts(F.parse_url("url", F.lit("PATH")))
    return adapters.table(spark, folder, "pages").select("page_id", directory.alias("directory"), base.alias("basename"))


_ISSUES = f"""{DA}, {_EXACT}, {_DA_LONG}, {_GROUPS}, mem AS (
  SELECT e.group_id, supplier, path, '相同文件' AS issue, 'high' AS level FROM d JOIN e USING (sha256)
  UNION ALL SELECT gr.group_id, supplier, path, gr.label || '重复', CASE risk WHEN '高风险' THEN 'high' WHEN '中风险' THEN 'medium' ELSE 'low' END FROM n JOIN gr ON n.field = gr.field AND n.norm = gr.norm
)"""


@query(f"""WITH {_ISSUES}, m AS (SELECT DISTINCT *, supplier || ' / ' || path AS own FROM mem),
r AS (SELECT group_id, own, row_number() OVER (PARTITION BY group_id ORDER BY own) AS place, count(*) OVER (PARTITION BY group_id) AS n FROM m),
l AS (SELECT group_id, any_value(n) - 1 AS n_peers, list(own ORDER BY own) AS named FROM r WHERE place <= 11 GROUP BY group_id)
SELECT supplier, path, group_id, issue, level, n_peers, array_to_string(list_filter(named, lambda x: x <> own)[1:10], '；') AS peers FROM m JOIN l USING (group_id)""")
def file_issues(spark, folder):
    return review.file_issues(adapters.attributed(spark, folder)).drop("title")


@query(f"WITH {_ISSUES} SELECT DISTINCT group_id, supplier, path, issue, level FROM mem")
def issue_members(spark, folder):
    return review.issue_members(adapters.attributed(spark, folder)).drop("value", "of")


@query(f"WITH {DA}, {_EXACT} SELECT supplier, path FROM d WHERE sha256 IN (SELECT sha256 FROM e)")
def filter_exact_files(spark, folder):
    return review.filter_files(adapters.attributed(spark, folder), only_exact=True).select("supplier", "path")


_IN_ATTRIBUTE = "path IN (SELECT path FROM n JOIN gr ON n.field = gr.field AND n.norm = gr.norm)"


@query(f"WITH {DA}, {_DA_LONG}, {_GROUPS} SELECT supplier, path FROM d WHERE {_IN_ATTRIBUTE}")
def filter_attribute_files(spark, folder):
    return review.filter_files(adapters.attributed(spark, folder), only_attribute=True).select("supplier", "path")


@query(f"WITH {DA}, {_EXACT}, {_DA_LONG}, {_GROUPS} SELECT supplier, path FROM d WHERE {_IN_ATTRIBUTE} AND sha256 IN (SELECT sha256 FROM e)")
def filter_both(spark, folder):
    return review.filter_both(adapters.attributed(spark, folder)).select("supplier", "path")


@query(f"WITH {D} SELECT supplier, path FROM d WHERE contains(lower(path || ' ' || path), lower('OC_1'))")
def file_search(spark, folder):
    return review.search(adapters.documents(spark, folder), "OC_1").select("supplier", "path")


_HALVES = "SELECT ltrim(p, '/') AS p, size, page_id % 2 AS half, 'half ' || page_id % 2 AS supplier FROM p"


@query(f"""WITH p AS (SELECT page_id, {_URL_PATH} AS p, octet_length(encode(html))::BIGINT AS size FROM pages), f AS (SELECT CASE WHEN half = 0 AND NOT contains(p, '/') THEN 'root/' || p ELSE p END AS p, size, half, supplier FROM ({_HALVES}) UNION ALL SELECT 'readme.txt', 1, 1, 'half 1'),
s AS (SELECT half, bool_and(contains(p, '/')) AS split FROM f GROUP BY half)
SELECT CASE WHEN split THEN split_part(p, '/', 1) ELSE supplier END AS supplier, count(*) AS file_count, sum(size)::BIGINT AS total_size FROM f JOIN s USING (half) GROUP BY 1""")
def split_by_top_dir(spark, folder):
    # two submissions: of one all files stand in folders, the other has a file beside its folders and stays whole
    half = F.col("page_id") % 2
    path = F.ltrim(F.parse_url("url", F.lit("PATH")), F.lit("/"))
    path = F.when((half == 0) & ~F.contains(path, F.lit("/")), F.concat(F.lit("root/"), path)).otherwise(path)
    files = adapters.pages(spark, folder).select(half.cast("string").alias("submission_id"), F.concat(F.lit("half "), half.cast("string")).alias("supplier"), path.alias("path"), "size")
    files = files.unionByName(spark.createDataFrame([("1", "half 1", "readme.txt", 1)], files.schema))
    return review.split_by_top_directory(files).groupBy("supplier").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


@query(f"WITH {D} SELECT supplier, path, row_number() OVER (PARTITION BY supplier ORDER BY ord)::INT AS seq FROM d")
def card_sequence(spark, folder):
    return review.card_sequence(adapters.documents(spark, folder))


@query(f"WITH {D} SELECT path FROM d")
def dedup_inputs(spark, folder):
    paths = adapters.documents(spark, folder).select("path")
    return review.union_inputs(paths, paths)


@query(f"WITH {DA} SELECT kind, CASE kind WHEN 'word' THEN 'Word' WHEN 'pdf' THEN 'PDF' ELSE '图片' END AS label, count(*) AS n FROM d GROUP BY ALL")
def kind_labels(spark, folder):
    return adapters.attributed(spark, folder).groupBy("kind").agg(F.count("*").alias("n")).select("kind", scalar.kind_label(F.col("kind")).alias("label"), "n")


@query("SELECT doc_id::VARCHAR AS at, CASE WHEN doc_id % 2 = 0 THEN '保存' ELSE '另存为' END AS action, CASE WHEN doc_id % 3 = 0 THEN '删除 author' WHEN doc_id % 3 = 1 THEN 'title' ELSE 'title、subject、删除 author、删除 keywords' END AS changes FROM documents")
def operation_report(spark, folder):
    k = F.col("doc_id") % 3
    changed = F.when(k == 1, F.array(F.lit("title"))).when(k == 2, F.array(F.lit("title"), F.lit("subject")))
    deleted = F.when(k == 0, F.array(F.lit("author"))).when(k == 2, F.array(F.lit("author"), F.lit("keywords")))
    log = adapters.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("at"), F.when(F.col("doc_id") % 2 == 0, "save").otherwise("save-as").alias("action"), changed.alias("changed_fields"), deleted.alias("deleted_fields"))
    return review.operation_changes(log).select("at", "action", "changes")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
