"""Uploads and content items made from the standard tables: documents as office files and as parsed items."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from brookwell.plans.base import table

KINDS = (".docx", ".pptx", ".txt", ".exe")
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def office_file(doc_id: int, text: str) -> bytes:
    """A text document with a paragraph a line, or slides of three lines with an image on every second one, or the text itself."""
    lines = (text or "").split("\n")
    out = io.BytesIO()
    if doc_id % 4 > 1:
        return (text or "").encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if doc_id % 4 == 0:
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
            z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        else:
            for i in range(0, len(lines), 3):
                n = i // 3 + 1
                shapes = "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>" for x in lines[i : i + 3])
                z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {_P}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
                if n % 2 == 0:
                    z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", f'<Relationships><Relationship Id="r" Target="../media/image{n}.PNG"/></Relationships>')
                    z.writestr(f"ppt/media/image{n}.PNG", b"x" * n)
            z.writestr("ppt/media/image0.jpg", b"unused")
            z.writestr("ppt/media/clip.mp4", b"no image")
    return out.getvalue()


def files(spark, d):
    """(doc_id, path, extension, content) of each document as a file."""
    made = F.pandas_udf(lambda ids, texts: pd.Series([office_file(i, t) for i, t in zip(ids, texts, strict=True)]), "binary")
    extension = F.element_at(F.array(*(F.lit(x) for x in KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", extension).alias("path"), extension.alias("extension"), made("doc_id", "text").alias("content"))


def raw_items(spark, d):
    """(doc_id, pos, kind, label, text, html, markdown, img_path, caption, page_no): two items a document with its whole text, as a parser gives them."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("line"))
    k, null = F.col("doc_id") % 6, F.lit(None).cast("string")
    one = docs.select("doc_id", F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit("paragraph").alias("label"), F.col("line").alias("text"), null.alias("html"), null.alias("markdown"), null.alias("img_path"), null.alias("caption"), F.lit(1).alias("page_no"))
    kind = F.when(k < 2, "table").when(k < 4, "picture").otherwise("text")
    two = docs.select(
        "doc_id", F.lit(1).alias("pos"), kind.alias("kind"), F.when(k == 4, "Formula").when(k == 5, "equation_block").alias("label"),
        F.when(k == 4, F.concat(F.lit("x = "), "doc_id")).when(k == 5, " ").alias("text"), F.when(k == 0, F.concat(F.lit("<table>"), "line", F.lit("</table>"))).alias("html"),
        F.when(k == 1, F.concat(F.lit("| "), "line", F.lit(" |"))).alias("markdown"), F.when(k == 2, F.concat(F.lit("img/"), "doc_id", F.lit(".png"))).alias("img_path"),
        F.when(k.isin(0, 1, 2), F.concat(F.lit("from "), "source")).when((k == 3) & (F.col("doc_id") % 12 == 3), F.lit("lost")).alias("caption"), (F.col("doc_id") % 3).cast("int").alias("page_no"),
    )
    return one.union(two)


#: The converted items of ``raw_items``.
ITEMS = """items AS (SELECT doc_id, 0 AS pos, 'text' AS type, text, NULL AS table_body, NULL AS img_path, NULL AS caption, 0 AS page_idx FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
UNION ALL SELECT doc_id, 1, CASE doc_id % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'table' WHEN 2 THEN 'image' WHEN 3 THEN 'text' ELSE 'equation' END, CASE doc_id % 6 WHEN 3 THEN '[Image: lost]' WHEN 4 THEN 'x = ' || doc_id END,
  CASE doc_id % 6 WHEN 0 THEN '<table>' || text || '</table>' WHEN 1 THEN '| ' || text || ' |' END, CASE WHEN doc_id % 6 = 2 THEN 'img/' || doc_id || '.png' END,
  CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 'from ' || source WHEN doc_id % 6 = 4 THEN '' END, greatest(CAST(doc_id % 3 AS INT) - 1, 0) FROM documents WHERE doc_id % 6 IN (0, 1, 2, 4) OR doc_id % 12 = 3)"""
