"""DOCX files: paragraphs by style as sections, and core properties."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.operators.sections import SECTIONS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARSED = f"struct<title:string,author:string,date:string,text:string,sections:{SECTIONS},custom:map<string,string>,error:string>"
#: Styles that are headings, and their levels.
LEVELS = {"title": 0, **{f"heading {i}": i for i in range(1, 7)}}


def name_title(path: str) -> str:
    """A title from a file's name: words apart, capitalised if the name is in one case."""
    base = path.rsplit("/", 1)[-1]
    name = (base.rsplit(".", 1)[0] or base).replace("_", " ").replace("-", " ").strip()
    return " ".join(w.capitalize() for w in name.split()) if name.isupper() or name.islower() else name


def _paragraph(p: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def read(path: str, content: bytes) -> dict:
    """One file's title, author, date, text, sections and custom properties. Text within tables is left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        styles = {}
        if "word/styles.xml" in names:
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                n = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else s.get(f"{_W}styleId")
        core = {x.tag.rpartition("}")[2]: (x.text or "").strip() or None for x in ET.fromstring(z.read("docProps/core.xml"))} if "docProps/core.xml" in names else {}
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    sections, rows = [], [] if body is None else body.findall(f"{_W}p")
    for p in rows:
        text = _paragraph(p)
        if not text.strip():
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        named = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "") if style is not None else ""
        level = LEVELS.get(named.lower())
        sections.append({"content": text, "section_type": "paragraph" if level is None else "heading" if level else "title", "level": level or 0})
    custom = {"last_modified": core.get("modified"), "category": core.get("category"), "comments": core.get("description"), "keywords": core.get("keywords"), "subject": core.get("subject")}
    return {"title": core.get("title") or name_title(path), "author": core.get("creator"), "date": core.get("created"), "text": "\n\n".join(s["content"] for s in sections), "sections": sections, "custom": {k: v for k, v in custom.items() if v}, "error": None}


def parse(path: Column | str, content: Column | str) -> Column:
    @F.pandas_udf(_PARSED)
    def parsed(p: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for name, data in zip(p, c):
            try:
                out.append(read(name, data))
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                out.append({"error": f"the file is no DOCX document: {type(e).__name__}"})
        return pd.DataFrame(out, columns=["title", "author", "date", "text", "sections", "custom", "error"]).astype(object).where(lambda d: d.notna(), None)

    return parsed(path, content)


def columns(d: str) -> dict[str, Column]:
    return {k: F.col(f"{d}.{k}") for k in ("title", "author", "date", "text", "sections", "custom", "error")}
