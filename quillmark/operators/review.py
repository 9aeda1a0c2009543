"""What a reviewer sees: issues per file, filters, search, property tables, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions.scalar import basename, directory, format_bytes
from .audit import attribute_members, exact_members


#: Peers that an issue names; ``issue_members`` has all of them, once a group.
PEERS = 10


def issue_members(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """(group_id, supplier, path, issue, level, value, of): every file of every exact and attribute group, whatever the attribute."""
    exact = exact_members(files).select("group_id", "supplier", "path", F.lit("相同文件").alias("issue"), F.lit("high").alias("level"), F.col("sha256").alias("value"), F.lit("exact").alias("of"))
    level = F.when(F.col("risk") == "高风险", "high").when(F.col("risk") == "中风险", "medium").otherwise("low")
    attribute = attribute_members(files, compatibility).select("group_id", "supplier", "path", F.concat("label", F.lit("重复")).alias("issue"), level.alias("level"), "value", F.lit("attribute").alias("of"))
    return exact.unionByName(attribute).distinct()


def file_issues(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """(supplier, path, group_id, issue, level, n_peers, peers, title): an issue per group that a file belongs to, with its first ``PEERS`` peers by name.

    A group of n files gives n rows of bounded size instead of n lists of
    n - 1 peers; all peers are the group's rows of ``issue_members``.
    """
    members = issue_members(files, compatibility).withColumn("own", F.concat_ws(" / ", "supplier", "path"))
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("own"))).where(F.col("place") <= PEERS + 1)
    sizes = members.groupBy("group_id").agg((F.count("*") - 1).alias("n_peers"))
    groups = first.groupBy("group_id").agg(F.array_sort(F.collect_list("own")).alias("named")).join(sizes, "group_id")
    peers = F.array_join(F.slice(F.array_remove("named", F.col("own")), 1, PEERS), "；")
    listed = members.join(groups, "group_id").withColumn("peers", peers)
    label = F.regexp_replace("issue", "重复$", "")
    whom = F.concat("peers", F.when(F.col("n_peers") > PEERS, F.concat(F.lit(" 等 "), F.col("n_peers").cast("string"), F.lit(" 个文件"))).otherwise(""))
    title = F.when(F.col("of") == "exact", F.concat(F.lit("与 "), whom, F.lit(" 的文件内容完全相同（SHA-256："), "value", F.lit("）"))).otherwise(F.concat(F.lit("与 "), whom, F.lit(" 的"), label, F.lit("相同："), "value"))
    return listed.withColumn("title", title).select("supplier", "path", "group_id", "issue", "level", "n_peers", "peers", "title")


def filter_files(files: DataFrame, only_exact: bool = False, only_attribute: bool = False, compatibility: bool = True) -> DataFrame:
    """The files in exact groups, in attribute groups, or in both."""
    if only_exact:
        files = files.join(exact_members(files).select("supplier", "path").distinct(), ["supplier", "path"], "left_semi")
    if only_attribute:
        files = files.join(attribute_members(files, compatibility).select("supplier", "path").distinct(), ["supplier", "path"], "left_semi")
    return files


def filter_both(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """Files in exact groups and in attribute groups, both taken over all files."""
    exact = exact_members(files).select("supplier", "path").distinct()
    attribute = attribute_members(files, compatibility).select("supplier", "path").distinct()
    return files.join(exact, ["supplier", "path"], "left_semi").join(attribute, ["supplier", "path"], "left_semi")


def search(files: DataFrame, query: str) -> DataFrame:
    return files.where(F.contains(F.lower(F.concat_ws(" ", "name", "path")), F.lower(F.lit(query))))


def card_sequence(files: DataFrame) -> DataFrame:
    """(supplier, path, seq): a file's number within its submission."""
    return files.withColumn("seq", F.row_number().over(Window.partitionBy("submission_id").orderBy("ord"))).select("supplier", "path", "seq")


def path_parts(path: Column) -> tuple[Column, Column]:
    """(directory, basename), backslashes as slashes."""
    whole = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return directory(whole), basename(whole)


def split_by_top_directory(files: DataFrame) -> DataFrame:
    """Submissions by top-level directory, for each submission whose files all stand in one; the others stay whole."""
    inside = F.contains(F.col("path"), F.lit("/"))
    flat = files.groupBy("submission_id").agg(F.bool_and(inside).alias("split"))
    top = F.split_part("path", F.lit("/"), F.lit(1))
    return files.join(flat, "submission_id").withColumn("supplier", F.when(F.col("split"), top).otherwise(F.col("supplier"))).drop("split")


def union_inputs(*paths: DataFrame) -> DataFrame:
    """The distinct input paths of several selections."""
    out = paths[0]
    for more in paths[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _value(field: str) -> Column:
    a = F.col("attributes")
    return F.coalesce(F.nullif(a["version"], F.lit("")), a["appVersion"]) if field == "version" else a[field]


def key_metadata(files: DataFrame) -> DataFrame:
    """(supplier, path, pos, label, value): the fields shown first for the file's kind; missing ones are empty."""
    def rows(fields: tuple) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.coalesce(_value(f), F.lit("")).alias("value")) for i, (f, label) in enumerate(fields)))

    chosen = F.when(F.col("kind").isin("word", "excel", "powerpoint"), rows(rules.KEY_METADATA["word"])).when(F.col("kind") == "pdf", rows(rules.KEY_METADATA["pdf"])).when(F.col("kind") == "image", rows(rules.KEY_METADATA["image"])).otherwise(rows(rules.KEY_METADATA["*"]))
    return files.select("supplier", "path", F.explode(chosen).alias("r")).select("supplier", "path", "r.pos", "r.label", "r.value")


# Items of the property groups: group, group title (None: by kind), and (name, attribute).
COMMON = (("作者", "author"), ("最后一次保存者", "lastEditor"), ("创建内容的时间", "created"), ("最后一次保存的日期", "modified"), ("程序名称", "application"), ("版本号", "version"), ("公司", "company"), ("管理者", "manager"))
OFFICE_COMMON = tuple((label, f) for f, label, _ in rules.OFFICE_ATTRIBUTES)
PDF_ITEMS = (("作者", "author"), ("标题", "title"), ("主题", "subject"), ("关键词", "keywords"), ("创建程序", "creator"), ("制作工具", "producer"), ("创建时间", "created"), ("修改时间", "modified"), ("陷印状态", "trapped"), ("元数据时间", "metadataDate"))
DOCUMENT_ITEMS = (("模板", "template"), ("总编辑时间", "totalEditingTime"), ("PDF 版本", "pdfVersion"), ("扫描件文档", "scannedDocument"), ("页数", "pageCount"), ("文档ID", "documentIds"), ("工作表", "sheets"), ("图片格式", "format"), ("尺寸", "dimensions"), ("宽度", "width"), ("高度", "height"), ("位深度", "bitDepth"), ("创建软件", "software"), ("图片作者", "author"), ("图片标题", "title"), ("图片说明", "description"), ("文本元数据", "textMetadata"))
FINGERPRINT_ITEMS = (("SimHash", "textFingerprint"), ("媒体文件哈希", "mediaHashes"), ("内部结构哈希", "internalStructureHash"), ("自定义属性哈希", "customProperties"))
PATH_ITEMS = (("本地路径", "localPaths"), ("外部链接", "externalLinks"), ("包含宏", "hasMacros"), ("包含PDF脚本", "hasJavaScript"), ("包含签名", "hasSignature"), ("已加密", "encrypted"))
DOCUMENT_TITLES = {"pdf": "PDF 文件结构", "excel": "Excel 专有属性", "word": "Word 专有属性", "powerpoint": "PowerPoint 专有属性", "image": "图片属性"}


def property_groups(files: DataFrame) -> DataFrame:
    """(supplier, path, group_id, group_title, pos, name, value, xmp_value): the property table of every file.

    Empty values go, except an Office file's core rows and a PDF's rows, which
    show that nothing was extracted. List attributes are joined by line breaks.
    """
    has_lists = "lists" in files.columns

    def value(field: str) -> Column:
        own = _value(field)
        own = F.coalesce(own, F.array_join(F.col("lists")[field], "\n")) if has_lists else own
        own = F.when(F.coalesce(own, F.lit("")) != "", F.concat(own, F.lit(" 分钟"))) if field == "totalEditingTime" else own
        return F.coalesce(F.col("fingerprint"), own) if field == "textFingerprint" and "fingerprint" in files.columns else own

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in files.columns else F.lit(None).cast("string")

    def shown(field: str) -> Column:
        return F.coalesce(F.nullif(value(field), F.lit("")), F.lit(rules.MISSING))

    def item(group: str, title: Column, pos: int, name: str, own: Column, xmp: Column | None = None) -> Column:
        return F.struct(F.lit(group).alias("group_id"), title.alias("group_title"), F.lit(pos).alias("pos"), F.lit(name).alias("name"), own.cast("string").alias("value"), (xmp if xmp is not None else F.lit(None)).cast("string").alias("xmp_value"))

    office, pdf = F.col("kind").isin("word", "excel", "powerpoint"), F.col("kind") == "pdf"
    common, title = F.lit("常见文件属性"), F.create_map(*(F.lit(x) for p in DOCUMENT_TITLES.items() for x in p))[F.col("kind")]
    first = (("文件名", F.col("name")), ("ZIP 内路径", F.col("path")), ("文件类型", F.col("kind")), ("MIME", column("mime")), ("扩展名", column("extension")), ("文件大小", format_bytes(F.col("size"))), ("SHA-256", F.col("sha256")))
    rows = [item("common", common, i, n, c) for i, (n, c) in enumerate(first)]
    rows += [item("common", common, 10 + i, n, F.when(office, shown(f))) for i, (n, f) in enumerate(OFFICE_COMMON)]
    rows += [item("common", common, 30 + i, n, F.when(~office & ~pdf, value(f))) for i, (n, f) in enumerate(COMMON)]
    xmp = lambda f: F.coalesce(F.nullif(F.col("attributes")["xmp." + f], F.lit("")), F.lit(rules.MISSING))
    rows += [item("pdf-metadata", F.lit("说明"), i, n, F.when(pdf, F.lit("不适用") if f == "metadataDate" else shown(f)), F.when(pdf, xmp(f))) for i, (n, f) in enumerate(PDF_ITEMS)]
    rows += [item("document", F.coalesce(title, F.lit("文档专有属性")), i, n, value(f)) for i, (n, f) in enumerate(DOCUMENT_ITEMS)]
    rows += [item("fingerprint", F.lit("内容指纹与相似度"), i, n, value(f)) for i, (n, f) in enumerate(FINGERPRINT_ITEMS)]
    rows += [item("paths", F.lit("链接、路径与嵌入内容"), i, n, value(f)) for i, (n, f) in enumerate(PATH_ITEMS)]
    rows += [item("integrity", F.lit("格式与解析状态"), 0, "扩展名不一致", column("extension_mismatch")), item("integrity", F.lit("格式与解析状态"), 1, "解析错误", column("parse_error"))]
    useful = F.filter(F.array(*rows), lambda r: r["value"].isNotNull() & (r["value"] != ""))
    return files.select("supplier", "path", F.explode(useful).alias("r")).select("supplier", "path", "r.*")


def operation_changes(operations: DataFrame) -> DataFrame:
    """Operation log rows with the action's label and changed and deleted fields in one text."""
    deleted = F.transform(F.coalesce("deleted_fields", F.array().cast("array<string>")), lambda f: F.concat(F.lit("删除 "), f))
    changes = F.array_join(F.concat(F.coalesce("changed_fields", F.array().cast("array<string>")), deleted), "、")
    return operations.withColumns({"action": F.when(F.col("action") == "save", "保存").otherwise("另存为"), "changes": changes})
