"""PDF files through PyMuPDF, if it is installed: blocks of pages, and documents made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

_BLOCK = "struct<page:int,block:int,x0:double,y0:double,x1:double,y1:double,size:double,bold:boolean,text:string,page_width:double,page_height:double,images:int,ocr:boolean>"
_PARSED = f"struct<title:string,author:string,date:string,blocks:array<{_BLOCK}>,custom:map<string,string>,error:string>"


def pdf_date(value: str | None) -> str | None:
    """'D:YYYYMMDD…' as YYYY-MM-DD."""
    return f"{value[2:6]}-{value[6:8]}-{value[8:10]}" if value and value.startswith("D:") and len(value) >= 10 else value or None


def recognised(page, n: int, images: int, own: list[dict]) -> list[dict]:
    """The page's blocks, or its picture's paragraphs where it has images and hardly any text; any failure keeps the blocks."""
    length, width, height = sum(len(b["text"]) for b in own), page.rect.width, page.rect.height
    if not images or not (length < 50 or length / max(width * height, 1) < 0.0005):
        return own
    try:
        found = ocr_page(page.get_pixmap(dpi=300).tobytes("png"))
    except Exception:  # no Tesseract, or it gave up: what the page has as text
        return own
    return [{"page": n, "block": i, "x0": 0.0, "y0": float(i), "x1": width, "y1": float(i + 1), "size": 10.0, "bold": False, "text": t, "page_width": width, "page_height": height, "images": images, "ocr": True} for i, t in enumerate(found)] or own


def read(content: bytes) -> dict:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        if pdf.is_encrypted:
            return {"error": "the file is encrypted"}
        meta, blocks = pdf.metadata or {}, []
        for n, page in enumerate(pdf):
            images, own = len(page.get_images()), []
            for b, x in enumerate(page.get_text("dict")["blocks"]):
                spans = [s for line in x.get("lines", []) for s in line["spans"]]
                text = " ".join(s["text"] for s in spans).strip()
                if text:
                    own.append({"page": n, "block": b, **dict(zip(("x0", "y0", "x1", "y1"), map(float, x["bbox"]))), "size": max(s["size"] for s in spans), "bold": any("bold" in s["font"].lower() for s in spans), "text": text, "page_width": page.rect.width, "page_height": page.rect.height, "images": images, "ocr": False})
            blocks += recognised(page, n, images, own)
        custom = {"page_count": str(len(pdf)), "producer": meta.get("producer"), "creator": meta.get("creator"), "keywords": meta.get("keywords")}
    return {"title": meta.get("title") or None, "author": meta.get("author") or None, "date": pdf_date(meta.get("creationDate")), "blocks": blocks, "custom": {k: v for k, v in custom.items() if v}, "error": None}


def parse(content: Column | str) -> Column:
    """Struct of metadata and blocks; without PyMuPDF each file has an error that says so."""

    @F.pandas_udf(_PARSED)
    def parsed(c: pd.Series) -> pd.DataFrame:
        out = []
        for data in c:
            try:
                out.append(read(data))
            except ImportError:
                out.append({"error": "PyMuPDF is not installed"})
            except Exception as e:  # the library raises its own kinds for broken files
                out.append({"error": f"the file can't be read: {type(e).__name__}: {e}"})
        return pd.DataFrame(out, columns=["title", "author", "date", "blocks", "custom", "error"]).astype(object).where(lambda d: d.notna(), None)

    return parsed(content)


def blocks(parsed: DataFrame) -> DataFrame:
    """(path, d) of parsed files to the block table that the page operators take, with the path as doc_id."""
    return T.each(parsed.select(F.col("path").alias("doc_id"), "d"), ["doc_id"], F.coalesce("d.blocks", F.expr(f"cast(array() as array<{_BLOCK}>)"))).select("doc_id", "x.*")


def ocr_page(image: bytes, timeout: float = 30) -> list[str]:
    """Paragraphs of a page's picture, by Tesseract if pytesseract is installed."""
    import io

    import pytesseract
    from PIL import Image

    text = pytesseract.image_to_string(Image.open(io.BytesIO(image)), config="--psm 6", timeout=timeout)
    return [p.strip() for p in text.split("\n\n") if p.strip()]
