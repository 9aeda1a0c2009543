"""Report tables, each a DataFrame, and their writers: XLSX, HTML, PDF, JSON."""

from __future__ import annotations

import html
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, correlate, review

#: A reviewer's decisions: the last of a finding counts.
REVIEWS = "finding_id string, review string, at string"
DISCLAIMER = "自动检测结果仅为人工复核线索，不构成结论。"
#: Rows of a sheet that XLSX allows; more go on in further sheets.
SHEET_ROWS = 1_048_575
#: Characters of a cell that XLSX allows; of a longer value the cell holds the beginning, with an ellipsis as a mark (JSON and HTML hold all of it).
CELL_CHARS = 32_767


def properties_sheet(files: DataFrame) -> DataFrame:
    """(supplier, file, group, name, value): every property row; a PDF's Info and XMP values as JSON."""
    rows = review.property_groups(files)
    both = F.to_json(F.struct(F.col("value").alias("info"), F.col("xmp_value").alias("xmp")))
    return rows.select("supplier", F.col("path").alias("file"), F.col("group_title").alias("group"), "name", F.when(F.col("xmp_value").isNull(), F.col("value")).otherwise(both).alias("value"))


@dataclass
class Project:
    """The tables of a review; everything else is derived from them when asked for."""

    name: str
    files: DataFrame
    operations: DataFrame | None = None
    reviews: DataFrame | None = None
    created_at: str = ""
    #: What ``findings`` leaves on or off, kept with the project.
    options: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.created_at = self.created_at or datetime.now(timezone.utc).isoformat()

    def findings(self, **options: bool) -> DataFrame:
        found = correlate.correlate(self.files, **(self.options | options))
        return correlate.with_reviews(found, self.reviews) if self.reviews is not None else found

    def after_save(self, path: str, operation: dict | None = None) -> Project:
        """The project after a loose file was edited in place: the file is parsed again, everything derived follows, and the operation joins the log."""
        from ..operators.edit import OPERATIONS
        from ..sources.archives import read_submissions

        spark, place = self.files.sparkSession, ["submission_id", "supplier", "zip_name", "zip_path", "zip_sha256", "ord"]
        old = self.files.where(F.col("source_path") == path).select("source_path", *place)
        again = read_submissions(spark, [path], mode="files").drop(*place).join(old, "source_path").select(*self.files.columns)
        files = self.files.where(~F.col("source_path").eqNullSafe(path)).unionByName(again)
        log = self.operations
        if operation:
            row = spark.createDataFrame([operation], OPERATIONS)
            log = row if log is None else log.unionByName(row)
        return replace(self, files=files, operations=log)

    def _attribute(self, name: str):
        return F.coalesce(F.col("attributes")[name], F.lit("")).alias(name)

    def tables(self) -> dict[str, DataFrame]:
        """The seven sheets."""
        spark, files = self.files.sparkSession, self.files
        log = review.operation_changes(self.operations) if self.operations is not None else None
        totals = audit.summary(files)
        count = F.lit(0) if log is None else F.lit(log.count())
        metrics = {"项目": F.lit(self.name), "创建时间": F.lit(self.created_at), "供应商数量": F.col("supplier_count"), "文件数量": F.col("file_count"), "完全相同文件组": F.col("exact_file_groups"), "属性重复组": F.col("attribute_match_groups"), "操作记录": count, "审查说明": F.lit(DISCLAIMER)}
        summary = totals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("指标"), v.cast("string").alias("结果")) for k, v in metrics.items()))).alias("r")).select("r.*")
        stats, manifests = audit.supplier_stats(files), audit.manifest_hashes(files)
        sha = F.first("zip_sha256") if "zip_sha256" in files.columns else F.lit("")
        zips = files.groupBy("submission_id").agg(sha.alias("zip_sha256"))
        suppliers = stats.join(manifests.select("submission_id", "zip_name", "manifest_hash", "ord"), "submission_id").join(zips, "submission_id").orderBy("ord")
        error = F.col("parse_error") if "parse_error" in files.columns else F.lit(None).cast("string")
        listed = files.orderBy("ord").select(
            F.col("supplier").alias("供应商"), F.col("path").alias("ZIP 内路径"), F.col("kind").alias("类型"), F.col("size").alias("字节"), F.col("sha256").alias("SHA-256"),
            *(F.coalesce(F.col("attributes")[a], F.lit("")).alias(label) for a, label in (("author", "作者"), ("lastEditor", "最后保存者"), ("title", "标题"), ("subject", "主题"), ("keywords", "关键词"), ("creator", "创建程序"), ("producer", "制作工具"), ("pdfVersion", "PDF版本"), ("dimensions", "图片尺寸"), ("software", "图片软件"))), error.alias("解析错误"),
        )
        exact = audit.exact_members(files).orderBy(F.desc("size"), "group_id", "supplier", "path").toDF("分组ID", "供应商", "文件", "字节", "SHA-256")
        attributes = audit.attribute_members(files).orderBy(F.desc("weight"), "group_id", "supplier", "path").select(F.col("group_id").alias("分组ID"), F.col("group_kind").alias("文件类型"), F.col("label").alias("属性"), F.col("value").alias("属性值"), F.col("risk").alias("风险等级"), F.col("weight").alias("权重"), F.col("supplier").alias("供应商"), F.col("path").alias("文件完整路径"))
        heads = ("时间", "供应商", "文件", "操作", "修改字段", "删除字段", "输出文件", "验证", "修改前 SHA-256", "修改后 SHA-256")
        empty = spark.createDataFrame([], ", ".join(f"`{h}` string" for h in heads))
        operations = empty if log is None else log.orderBy("at").select("at", "supplier", "file", "action", F.array_join(F.coalesce("changed_fields", F.array().cast("array<string>")), "、"), F.array_join(F.coalesce("deleted_fields", F.array().cast("array<string>")), "、"), "destination", "verified", "before_sha256", "after_sha256").toDF(*heads)
        return {
            "审查摘要": summary,
            "供应商汇总": suppliers.select("supplier", "zip_name", "file_count", "total_size", "zip_sha256", "manifest_hash", "parse_errors").toDF("供应商", "ZIP 文件", "文件数", "总字节", "ZIP SHA-256", "清单哈希", "解析异常"),
            "文件清单": listed,
            "完全相同文件": exact,
            "属性重复审查": attributes,
            "操作记录": operations,
            "全部属性": properties_sheet(files).toDF("供应商", "文件", "属性分类", "属性名称", "属性值"),
        }


# -- XLSX -----------------------------------------------------------------------

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, int | float):
        text = _BAD.sub("", str(value))
        text = text if len(text) <= CELL_CHARS else text[: CELL_CHARS - 1] + "…"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(text, quote=False)}</t></is></c>'
    return f"<c><v>{value}</v></c>"


def _sheet(heads: list[str], rows: Iterator) -> Iterator[bytes]:
    yield b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield ("<row>" + "".join(_cell(h).replace("<c ", '<c s="1" ', 1) for h in heads) + "</row>").encode()
    n = 1
    for row in rows:
        n += 1
        yield ("<row>" + "".join(map(_cell, row)) + "</row>").encode()
    last, k = "", len(heads)
    while k:
        k, r = divmod(k - 1, 26)
        last = chr(65 + r) + last
    yield f'</sheetData><autoFilter ref="A1:{last}{n}"/></worksheet>'.encode()


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """A sheet per table, header frozen and filtered; rows are streamed from the cluster, a table too long goes on in further sheets."""
    sheets = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, table in tables.items():
            rows, more, part = table.toLocalIterator(), True, 0
            ahead = next(rows, None)
            while more:
                part += 1
                sheets.append(name if part == 1 else f"{name} {part}")

                def some():
                    nonlocal ahead
                    n = 0
                    while ahead is not None and n < SHEET_ROWS:
                        yield ahead
                        ahead, n = next(rows, None), n + 1

                with out.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w") as target:
                    for chunk in _sheet(table.columns, some()):
                        target.write(chunk)
                more = ahead is not None
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        out.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(len(sheets))) + "</Types>")
        rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        out.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name="{html.escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rels}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + f'<Relationship Id="s" Type="{rels}/styles" Target="styles.xml"/></Relationships>')
        out.writestr("xl/styles.xml", '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')


# -- HTML, PDF, JSON ------------------------------------------------------------


def write_html(project: Project, path: str) -> None:
    tables = project.tables()
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<!doctype html><html lang="zh"><head><meta charset="utf-8"><title>{html.escape(project.name)}</title></head><body><h1>{html.escape(project.name)}</h1><p>{html.escape(DISCLAIMER)}</p>')
        for name in ("审查摘要", "供应商汇总", "完全相同文件", "属性重复审查", "操作记录"):
            table, empty = tables[name], True
            out.write(f"<h2>{name}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in table.columns) + "</tr>")
            for row in table.toLocalIterator():
                empty = False
                out.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in row) + "</tr>")
            out.write("</table>" + ("<p>无</p>" if empty else ""))
        out.write("</body></html>")


def write_pdf(project: Project, path: str) -> None:
    """Counts and exact groups in plain ASCII, fifty lines a page."""
    from ..sources import pdf

    totals = audit.summary(project.files).first()
    lines = [project.name, f"Created {project.created_at}", f"Suppliers {totals['supplier_count']}, files {totals['file_count']}, exact groups {totals['exact_file_groups']}, attribute groups {totals['attribute_match_groups']}", ""]
    lines += [f"{r['group_id']}  {r['supplier']}  {r['path']}  {r['size']}" for r in audit.exact_members(project.files).orderBy("group_id", "supplier", "path").toLocalIterator()]
    lines = [re.sub(r"[^\x20-\x7e]", "?", line)[:105] for line in lines]
    document = pdf.Document(b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [] /Count 0 >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n")
    tree = document.objects[2]
    font = document.add({"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1"), "BaseFont": pdf.Name("Helvetica")})
    for at in range(0, len(lines), 50):
        body = "BT /F1 9 Tf 14 TL 40 800 Td " + " ".join("(" + re.sub(r"([()\\])", r"\\\1", line) + ") Tj T*" for line in lines[at : at + 50]) + " ET"
        content = document.add(pdf.Stream({}, body.encode("ascii")))
        tree["Kids"].append(document.add({"Type": pdf.Name("Page"), "Parent": pdf.Ref(2), "MediaBox": [pdf.Raw(x) for x in (0, 0, 595, 842)], "Resources": {"Font": {"F1": font}}, "Contents": content}))
    tree["Count"] = pdf.Raw(len(tree["Kids"]))
    with open(path, "wb") as out:
        out.write(document.save())


def write_json(project: Project, path: str) -> None:
    """The project as a JSON text, two spaces deep, rows streamed."""
    from ..sources.parsers import Limits

    submissions = audit.supplier_stats(project.files).join(audit.manifest_hashes(project.files).select("submission_id", "zip_name", "manifest_hash", "ord"), "submission_id").orderBy("ord")
    parts = {"submissions": submissions, "files": project.files.orderBy("ord"), "findings": project.findings(), "exactFiles": audit.exact_groups(project.files), "attributeMatches": audit.attribute_groups(project.files)}
    parts |= {"operationLog": project.operations} if project.operations is not None else {}
    parts |= {"reviews": project.reviews} if project.reviews is not None else {}
    head = {"schemaVersion": 3, "name": project.name, "createdAt": project.created_at, "disclaimer": DISCLAIMER, "options": project.options, "limits": asdict(Limits())}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, ensure_ascii=False, indent=2)[:-2])
        for name, table in parts.items():
            out.write(f',\n  "{name}": [')
            for i, row in enumerate(table.toLocalIterator()):
                out.write(("," if i else "") + "\n    " + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
            out.write("\n  ]")
        out.write("\n}\n")


def load_json(spark: SparkSession, path: str) -> Project:
    """A saved project with its options, log and review states; groups and findings are computed anew from its files."""
    from ..operators.edit import OPERATIONS
    from ..sources.archives import SCHEMA

    whole = spark.read.json(path, multiLine=True, schema=f"name string, createdAt string, options map<string,boolean>, reviews array<struct<{REVIEWS.replace(' ', ': ').replace(',:', ',')}>>, files array<{SCHEMA.simpleString()}>, operationLog array<struct<{', '.join(c.replace(' ', ': ', 1) for c in OPERATIONS.split(', '))}>>")
    head = whole.select("name", "createdAt", "options", F.isnotnull("operationLog").alias("log"), F.isnotnull("reviews").alias("reviewed")).first()
    rows = lambda name: whole.select(F.inline(name))
    return Project(head["name"], rows("files"), rows("operationLog") if head["log"] else None, rows("reviews") if head["reviewed"] else None, head["createdAt"], head["options"] or {})


def write_report(project: Project, path: str) -> None:
    """By the name's ending: .xlsx, .html, .pdf, else JSON."""
    ending = path.rpartition(".")[2].lower()
    if ending == "xlsx":
        write_xlsx(project.tables(), path)
    else:
        {"html": write_html, "pdf": write_pdf}.get(ending, write_json)(project, path)
