"""Rule tables of the audit, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Attribute fields with display label and weight, by file kind.
OFFICE_ATTRIBUTES = (("author", "作者", 85), ("lastEditor", "最后一次保存者", 90), ("revision", "修订号", 55), ("version", "版本号", 50), ("application", "程序名称", 35), ("company", "公司", 80), ("manager", "管理者", 85), ("created", "创建内容的时间", 65), ("modified", "最后一次保存的日期", 75))
PDF_ATTRIBUTES = (("author", "作者", 85), ("title", "标题", 50), ("subject", "主题", 45), ("keywords", "关键词", 55), ("creator", "创建程序", 40), ("producer", "制作工具", 35), ("created", "创建时间", 65), ("modified", "修改时间", 75))
IMAGE_ATTRIBUTES = (("author", "作者", 85), ("software", "创建软件", 35), ("title", "标题", 45), ("description", "说明", 35))
ATTRIBUTES = {"word": OFFICE_ATTRIBUTES, "excel": OFFICE_ATTRIBUTES, "powerpoint": OFFICE_ATTRIBUTES, "pdf": PDF_ATTRIBUTES, "image": IMAGE_ATTRIBUTES}

# Rules that compare pairs of files: order, field, finding type, weight, option.
EXACT_RULE = (1, "相同文件", 95)
SCALAR_RULES = ((2, "author", "相同作者", 85), (3, "lastEditor", "相同最后一次保存者", 90), (4, "company", "相同公司属性", 80), (5, "manager", "相同管理者", 85), (6, "created", "相同创建时间", 65), (7, "modified", "相同保存时间", 75), (8, "template", "相同模板路径", 75), (9, "internalStructureHash", "相同内部结构", 45))
ARRAY_RULES = ((10, "documentIds", "相同文档ID", 90, "metadata"), (11, "localPaths", "相同本地路径", 90, "metadata"), (12, "externalLinks", "相同外部链接", 55, "metadata"), (13, "mediaHashes", "相同图片", 80, "image"))
SIMHASH_RULE = (14, "文本高度相似", 55)
OPTIONS = ("exact", "metadata", "image", "simhash")

# Labels.
FINDING_LEVELS = ((85, "极高风险"), (65, "高风险"), (40, "中风险"), (0, "低风险"))
RISK_LEVELS = ((70, "高风险"), (45, "中风险"), (0, "低风险"))
KIND_LABELS = {"pdf": "PDF", "word": "Word", "excel": "Excel", "powerpoint": "PowerPoint", "image": "图片", "text": "文本", "zip": "ZIP", "mixed": "多类型"}
OTHER_KIND = "其他"
MISSING = "未提取到"
UNDECIDED = "暂不判断"

#: Fields shown first for a kind; other kinds show the last entry.
KEY_METADATA = {
    **dict.fromkeys(("word", "excel", "powerpoint"), tuple((f, label) for f, label, _ in OFFICE_ATTRIBUTES)),
    "pdf": tuple((f, label) for f, label, _ in PDF_ATTRIBUTES),
    "image": (("author", "作者"), ("title", "标题"), ("description", "说明"), ("software", "创建软件")),
    "*": (("author", "作者"), ("created", "创建时间"), ("modified", "修改时间")),
}


def attribute_rules(spark: SparkSession) -> DataFrame:
    """(kind, field, label, weight); a few dozen rows, safe to broadcast."""
    return spark.createDataFrame([(k, *r) for k, rules in ATTRIBUTES.items() for r in rules], "kind string, field string, label string, weight int")


def scalar_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCALAR_RULES), "rule int, field string, type string, weight int")
