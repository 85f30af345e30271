"""Trees as JSON and as clean DOCX files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import fold_documents

STYLE = "node_type string, level int, style_id string, font string, font_cn string, size double, bold boolean, before double, after double, spacing double, indent double, keep_next boolean, page_break boolean, alignment string"
# ---- Fixed values: the styles of node types. ----
STYLES = [
    ("heading", 1, "Heading1", "Times New Roman", "黑体", 22.0, False, 24.0, 18.0, 1.5, 0.0, True, True, "left"),
    ("heading", 2, "Heading2", "Times New Roman", "黑体", 16.0, False, 18.0, 12.0, 1.5, 0.0, True, False, "left"),
    ("heading", 3, "Heading3", "Times New Roman", "黑体", 14.0, False, 12.0, 6.0, 1.5, 0.0, True, False, "left"),
    ("heading", 4, "Heading4", "Times New Roman", "黑体", 12.0, False, 6.0, 3.0, 1.5, 0.0, True, False, "left"),
    ("heading", 5, "Heading5", "Times New Roman", "黑体", 11.0, True, 3.0, 3.0, 1.5, 0.0, True, False, "left"),
    ("heading", 6, "Heading6", "Times New Roman", "黑体", 11.0, True, 3.0, 3.0, 1.5, 0.0, True, False, "left"),
    ("paragraph", 0, "Normal", "Times New Roman", "宋体", 12.0, False, 0.0, 0.0, 1.5, 2.0, True, False, "left"),
    ("list", 0, "ListParagraph", "Times New Roman", "宋体", 12.0, False, 0.0, 0.0, 1.5, 0.0, False, False, "left"),
    ("table", 0, "TableNormal", "Times New Roman", "宋体", 10.5, False, 0.0, 0.0, 1.0, 0.0, False, False, "center"),
    ("image", 0, "ImageStyle", "Times New Roman", "宋体", 12.0, False, 0.0, 0.0, 1.5, 0.0, False, False, "center"),
    ("caption", 0, "Caption", "Times New Roman", "宋体", 10.5, False, 0.0, 0.0, 1.5, 0.0, False, False, "center"),
    ("formula", 0, "FormulaStyle", "Cambria Math", None, 11.0, False, 0.0, 0.0, 1.5, 0.0, False, False, "center"),
]
PAGE_WIDTH_PT, PAGE_HEIGHT_PT, MARGIN_PT = 595, 842, 72
# ---- End of fixed values. ----
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, STYLE)


def with_style(nodes: DataFrame) -> DataFrame:
    """Nodes (node_type, global_level) with ``style``; heading levels are held within one to six, none is one."""
    level = F.when(F.col("node_type") == "heading", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("global_level", F.lit(1))))).otherwise(0)
    table = styles(nodes.sparkSession)
    packed = table.select("node_type", F.col("level").alias("_level"), F.struct("style_id", "font", "font_cn", "size", "bold", "before", "after", "spacing", "indent", "keep_next", "page_break", "alignment").alias("style"))
    # The styles are a dozen rows.
    return nodes.withColumn("_level", level).join(F.broadcast(packed), ["node_type", "_level"], "left").drop("_level")


def _run(said: str, s: dict) -> str:
    cn = f" w:eastAsia={quoteattr(s['font_cn'])}" if s["font_cn"] else ""
    fonts = f"<w:rFonts w:ascii={quoteattr(s['font'])} w:hAnsi={quoteattr(s['font'])}{cn}/>"
    size = f'<w:sz w:val="{round(2 * s["size"])}"/>'
    return f'<w:r><w:rPr>{fonts}{"<w:b/>" if s["bold"] else ""}{size}</w:rPr><w:t xml:space="preserve">{escape(said)}</w:t></w:r>'


def _paragraph(said: str, s: dict) -> str:
    marks = ("<w:keepNext/>" if s["keep_next"] else "") + ("<w:pageBreakBefore/>" if s["page_break"] else "")
    spacing = f'<w:spacing w:before="{round(20 * s["before"])}" w:after="{round(20 * s["after"])}" w:line="{round(240 * s["spacing"])}" w:lineRule="auto"/>'
    indent = f'<w:ind w:firstLineChars="{round(100 * s["indent"])}"/>' if s["indent"] else ""
    return f'<w:p><w:pPr><w:pStyle w:val={quoteattr(s["style_id"])}/>{marks}{spacing}{indent}<w:jc w:val={quoteattr(s["alignment"])}/></w:pPr>{_run(said, s)}</w:p>'


def _table(cells: list[list[str]], s: dict, repeat_header: bool) -> str:
    width = max(map(len, cells), default=0)
    rows = []
    for i, row in enumerate(cells):
        head = "<w:trPr><w:tblHeader/></w:trPr>" if repeat_header and i == 0 else ""
        padded = [*row, *[""] * (width - len(row))]
        rows.append(f"<w:tr>{head}{''.join(f'<w:tc><w:p>{_run(c or "", s)}</w:p></w:tc>' for c in padded)}</w:tr>")
    edges = "".join(f'<w:{e} w:val="single" w:sz="8"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f'<w:tbl><w:tblPr><w:jc w:val="center"/><w:tblBorders>{edges}</w:tblBorders></w:tblPr>{"".join(rows)}</w:tbl><w:p/>' if cells else ""


def docx_of(rows: list[dict]) -> bytes:
    """A file of nodes in preorder; images are placeholders."""
    body = []
    for r in sorted(rows, key=lambda r: r["preorder"]):
        s, said = r["style"], r["text"] or ""
        if s is None:
            continue
        if r["node_type"] == "table":
            body.append(_table(r["cell_matrix"] or [], s, bool(r["repeat_header"])))
        else:
            body.append(_paragraph(f"[图片: {said or '(空)'}]" if r["node_type"] == "image" else said, s))
    page = f'<w:sectPr><w:pgSz w:w="{20 * PAGE_WIDTH_PT}" w:h="{20 * PAGE_HEIGHT_PT}"/><w:pgMar w:top="{20 * MARGIN_PT}" w:right="{20 * MARGIN_PT}" w:bottom="{20 * MARGIN_PT}" w:left="{20 * MARGIN_PT}"/></w:sectPr>'
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>{"".join(body)}{page}</w:body></w:document>'
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    kinds = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{main}"/></Types>'
    relation = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", kinds), ("_rels/.rels", relation), ("word/document.xml", document)):
            z.writestr(name, content)
    return out.getvalue()


def render(nodes: DataFrame) -> DataFrame:
    """doc_id and ``content``: a clean DOCX of each tree (node_type, global_level, text, preorder, perhaps cell_matrix and repeat_header)."""
    for name, kind in (("cell_matrix", "array<array<string>>"), ("repeat_header", "boolean")):
        nodes = nodes if name in nodes.columns else nodes.withColumn(name, F.lit(None).cast(kind))
    return fold_documents(with_style(nodes), ["preorder", "node_type", "text", "style", "cell_matrix", "repeat_header"], lambda rows: [(docx_of(rows),)], "content binary")


def tree_json(nodes: DataFrame) -> DataFrame:
    """doc_id and ``value``: the nodes of each tree in preorder as one JSON object, nulls left out."""
    columns = [c for c in nodes.columns if c not in ("doc_id", "preorder")]
    listed = F.transform(F.sort_array(F.collect_list(F.struct("preorder", F.struct(*columns).alias("n")))), lambda x: x["n"])
    return nodes.groupBy("doc_id").agg(listed.alias("nodes"), F.count("*").alias("node_count")).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document_id"), "node_count", "nodes")).alias("value"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Add entries (action, node_id, before, after, source, reason) with a time to the log at ``path``."""
    entries.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)
