"""Text, HTML and DOCX as marked-up paragraphs and words with byte offsets, and back."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, xml_escape

WORD_PART = "word/document.xml"


def wrap_text(text: Column) -> Column:
    """Each line of a plain text as an escaped paragraph."""
    paragraphs = F.transform(F.split(text, "\n"), lambda t: F.concat(F.lit("<w:p><w:t>"), xml_escape(t), F.lit("</w:t></w:p>")))
    return F.concat(F.lit("<d>"), F.array_join(paragraphs, ""), F.lit("</d>"))


def html_paragraphs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))


def wrap_html(html: Column) -> Column:
    return F.concat(F.lit("<d>"), F.array_join(F.transform(html_paragraphs(html), lambda p: F.concat(F.lit("<w:p><w:t>"), p, F.lit("</w:t></w:p>"))), ""), F.lit("</d>"))


def read_docx(spark: SparkSession, paths) -> DataFrame:
    """path, xml of the main part; files that are no DOCX have a null xml and an error."""

    def run(parts):
        for p in parts:
            xml, error = [], []
            for raw in p["content"]:
                try:
                    xml.append(zipfile.ZipFile(io.BytesIO(bytes(raw))).read(WORD_PART).decode("utf-8"))
                    error.append(None)
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
                    xml.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": p["path"], "xml": xml, "error": error})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, xml string, error string")


def replace_docx(originals: DataFrame) -> DataFrame:
    """originals(path, content, xml) -> path, content: the same archive with another main part."""

    def run(parts):
        for p in parts:
            out = []
            for raw, xml in zip(p["content"], p["xml"], strict=True):
                sink = io.BytesIO()
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as old, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as new:
                    for item in old.infolist():
                        new.writestr(item, xml.encode() if item.filename == WORD_PART else old.read(item.filename))
                out.append(sink.getvalue())
            yield pd.DataFrame({"path": p["path"], "content": out})

    return originals.select("path", "content", "xml").mapInPandas(run, "path string, content binary")


def markup_words(xml: Column) -> Column:
    """array<struct<form, start, end>> of the words in w:t elements: byte offsets in the UTF-8 markup, blanks left out."""
    return F.pandas_udf(_words, "array<struct<form: string, start: int, end: int>>")(xml)


def _words(xml: pd.Series) -> pd.Series:
    token = re.compile(r"[^\W_]+|[\W_]")
    entity = re.compile(r"&(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);|.", re.S)
    plain = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(doc):
        out = []
        for m in re.finditer(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", doc or "", re.S):
            at = len((doc or "")[: m.start(1)].encode())
            chars, places = [], []
            for x in entity.findall(m[1]):
                c = plain.get(x) or (chr(int(x[3:-1], 16) if x[2] == "x" else int(x[2:-1])) if x.startswith("&#") and len(x) > 3 else x)
                chars.append(c)
                places.append(at)
                at += len(x.encode())
            places.append(at)
            text = "".join(chars)
            out += [{"form": w[0], "start": places[w.start()], "end": places[w.end()]} for w in token.finditer(text) if not w[0].isspace()]
        return out

    return xml.map(one)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, form, start, end (characters), bstart, bend (bytes): one row per token of a text.

    Texts are dealt by key once; exploding, running sums and whatever works per document follow without another shuffle.
    """
    dealt = docs.select(key, text).repartition(key)
    rows = dealt.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("pos", "form"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end, bend = F.sum(F.length("form")).over(before), F.sum(F.octet_length("form")).over(before)
    rows = rows.withColumns({"end": end, "bend": bend})
    return rows.select(key, "pos", "form", (F.col("end") - F.length("form")).alias("start"), "end", (F.col("bend") - F.octet_length("form")).alias("bstart"), "bend")
