"""Office files as sections and items. A file is a zip of XML parts; each row is read by itself inside a task."""

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.functions.text import strip

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHOW = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Extensions of images that are taken from slides.
RASTER = (".jpeg", ".jpg", ".png", ".gif", ".webp", ".bmp")
SECTION = "array<struct<page_number:int,slide_number:int,paragraph_index:int,text:string>>"
MEDIA = "array<struct<name:string,page_idx:int,size:long>>"
ARROW = {
    SECTION: pa.list_(pa.struct([("page_number", pa.int32()), ("slide_number", pa.int32()), ("paragraph_index", pa.int32()), ("text", pa.string())])),
    MEDIA: pa.list_(pa.struct([("name", pa.string()), ("page_idx", pa.int32()), ("size", pa.int64())])),
}
#: Files whose sections are Python objects at one time; what is read of a batch is Arrow's.
AT_ONCE = 64


def _said(paragraph: ElementTree.Element, ns: str) -> str:
    marks = {f"{ns}t": None, f"{ns}tab": "\t", f"{ns}br": "\n"}
    return "".join((e.text or "") if marks[e.tag] is None else marks[e.tag] for e in paragraph.iter() if e.tag in marks)


def paragraphs(content: bytes) -> Iterator[str]:
    """Paragraphs of a text document's body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    yield from (_said(p, WORD) for p in body.findall(f"{WORD}p"))


def slides(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(number, texts of the shapes) of each slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number in numbers:
            root = ElementTree.fromstring(z.read(f"ppt/slides/slide{number}.xml"))
            yield number, ["\n".join(_said(p, DRAW) for p in body.findall(f"{DRAW}p")) for body in root.iter(f"{SHOW}txBody")]


def media(content: bytes) -> list[dict]:
    """Images of a presentation with the first slide that refers to each, from 0; 0 without one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        first: dict[str, int] = {}
        for n in sorted(z.namelist()):
            m = re.fullmatch(r"ppt/slides/_rels/slide(\d+)\.xml\.rels", n)
            for rel in ElementTree.fromstring(z.read(n)) if m else ():
                if "media/image" in rel.get("Target", ""):
                    first.setdefault(rel.get("Target").rsplit("/", 1)[-1].lower(), int(m[1]))
        found = sorted(i.filename for i in z.infolist() if i.filename.startswith("ppt/media/") and i.filename.lower().endswith(RASTER))
        return [{"name": n.rsplit("/", 1)[-1], "page_idx": first.get(n.rsplit("/", 1)[-1].lower(), 1) - 1, "size": z.getinfo(n).file_size} for n in found]


def _section(text: str, page: int | None = None, slide: int | None = None, paragraph: int | None = None) -> dict:
    return {"page_number": page, "slide_number": slide, "paragraph_index": paragraph, "text": text}


def docx_sections(content: bytes) -> list[dict]:
    return [_section(t.strip(), paragraph=i) for i, t in enumerate(paragraphs(content), 1) if t.strip()]


def docx_whole(content: bytes) -> list[dict]:
    """One section, paragraphs apart by blank lines."""
    return [_section("\n\n".join(t for t in paragraphs(content) if t).strip(), paragraph=1)]


def pptx_sections(content: bytes) -> list[dict]:
    parts = [(n, "\n".join(t.strip() for t in texts if t.strip())) for n, texts in slides(content)]
    return [_section(t, slide=n) for n, t in parts if t]


def pptx_whole(content: bytes) -> list[dict]:
    """One section for the presentation."""
    return [_section("\n\n".join(t.strip() for _, texts in slides(content) for t in texts if t.strip()), slide=1)]


def parsed(content: Column, read: Callable[[bytes], list[dict]], kind: str = SECTION) -> Column:
    """``read`` of each file; null where a file is null or broken."""

    def one(x: bytes | None) -> list[dict] | None:
        try:
            return None if x is None else read(x)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
            return None

    def run(contents: pa.Array) -> pa.Array:
        parts = [pa.array([one(x.as_py()) for x in contents[at : at + AT_ONCE]], ARROW[kind]) for at in range(0, len(contents), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], ARROW[kind])

    return F.arrow_udf(run, kind)(content)


def sections(files: DataFrame, readers: dict[str, Callable[[bytes], list[dict]]] | None = None, whole_text: bool = True) -> DataFrame:
    """(columns of ``files`` but content, page_number, slide_number, paragraph_index, text): each extension by its own reader, plain text decoded; raises on an extension without one."""
    readers = readers or {".docx": docx_sections, ".pptx": pptx_sections}
    known = [*readers, *([".txt"] if whole_text else [])]
    keep = [c for c in files.columns if c != "content"]
    checked = F.when(F.col("extension").isin(known), F.col("extension")).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.coalesce("extension", F.lit("null")))))
    files = files.withColumn("extension", checked)
    out = None
    for extension, read in readers.items():
        rows = files.where(F.col("extension") == extension).select(*keep, F.explode(parsed(F.col("content"), read)).alias("s")).select(*keep, "s.*")
        out = rows if out is None else out.unionByName(rows)
    if whole_text:
        text = strip(F.decode("content", "UTF-8"))
        none = F.lit(None).cast("int")
        plain = files.where(F.col("extension") == ".txt").select(*keep, none.alias("page_number"), none.alias("slide_number"), none.alias("paragraph_index"), text.alias("text")).where("text <> ''")
        out = plain if out is None else out.unionByName(plain)
    return out


def items(raw: DataFrame) -> DataFrame:
    """Parsed items (kind text, table or picture) by type: a text with a formula's label is an equation, a table is HTML, else Markdown, else text; a picture without a file is a text of its caption, without both nothing; blank texts go."""
    label, caption = F.lower(F.coalesce("label", F.lit(""))), F.coalesce("caption", F.lit(""))
    equation = (F.col("kind") == "text") & (F.contains(label, F.lit("formula")) | F.contains(label, F.lit("equation")))
    lost = (F.col("kind") == "picture") & (F.coalesce("img_path", F.lit("")) == "")
    kind = F.when(equation, "equation").when(F.col("kind") == "table", "table").when((F.col("kind") == "picture") & ~lost, "image").otherwise("text")
    text = F.when(lost & (caption != ""), F.concat(F.lit("[Image: "), caption, F.lit("]"))).when(F.col("kind") == "text", F.col("text"))
    body = F.when(F.col("kind") == "table", F.coalesce("html", "markdown", "text"))
    out = raw.withColumns({"type": kind, "said": text, "table_body": body, "page_idx": F.greatest(F.coalesce(F.col("page_no") - 1, F.lit(0)), F.lit(0))})
    kept = F.when(F.col("type").isin("text", "equation"), strip(F.coalesce("said", F.lit(""))) != "").otherwise(F.lit(True))
    return out.where(kept).select("doc_id", "pos", "type", F.col("said").alias("text"), "table_body", F.when(F.col("type") == "image", F.col("img_path")).alias("img_path"), F.when(F.col("type") != "text", caption).alias("caption"), "page_idx")
