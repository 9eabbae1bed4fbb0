"""Page passes from blocks to documents, Markdown's structure, progress, and runs taken up again."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sparkloom.operators import completion
from sparkloom.plans import qa, text_queries
from sparkloom.progress import Progress
from sparkloom.sources import files, markdown, pages
from sparkloom.sources.stages import StageStore, documents_hash


def whole_document(blocks):
    """(text, sections) of one document's blocks, pass after pass, in plain Python."""
    alike = lambda a, b: a == b or SequenceMatcher(None, a, b).ratio() > 0.75
    by = {}
    for b in blocks:
        by.setdefault(b["page"], []).append(b)
    known = []
    for pick in (min, max):
        groups = {}
        for p in sorted(by):
            t = pick(by[p], key=lambda b: (b["y0"], b["block"]))["text"]
            if t and len(t) < 200:
                at = next((k for k in groups if k == t or SequenceMatcher(None, t, k).ratio() > 0.75), t)
                groups[at] = groups.get(at, 0) + 1
        known += [k for k, n in groups.items() if n >= 3]
    texts, sections = [], []
    for p in sorted(by):
        own = [b for b in by[p] if not any(SequenceMatcher(None, b["text"], k).ratio() > 0.75 for k in known)]
        if not own:
            continue
        sizes = [b["size"] for b in own]
        body = max(set(sizes), key=lambda s: (sizes.count(s), -min(b["block"] for b in own if b["size"] == s)))
        centre = lambda b: (b["x0"] + b["x1"]) / 2
        h = [0] * 10
        for b in own:
            h[min(int(centre(b) // (b["page_width"] / 10)), 9)] += 1
        peaks = sum(h[i - 1] < h[i] > h[i + 1] for i in range(1, 9))
        n = 1 if len(own) < 3 or not peaks else peaks + 1
        own.sort(key=lambda b: (min(int(centre(b) // (b["page_width"] / n)), n - 1), b["y0"], b["block"]))
        texts.append("\n".join(b["text"] for b in own))
        for b in own:
            head = b["size"] > body * 1.2 or b["bold"]
            top = b["y0"] < b["page_height"] * 0.2 and b["size"] > body * 1.5
            kind = "title" if head and top else "heading" if head else "paragraph"
            level = 0 if not head else 1 if top or b["size"] >= body * 1.5 else 2
            sections.append((b["text"] + f" [Page {p + 1}]" if head else b["text"], kind, level))
    out, held = [], None
    for t in texts:
        if not t.strip():
            continue
        if held is not None and (t.lstrip()[:1].islower() or t.lstrip()[:1] in tuple(",;:)]}>")):
            t, held = held + " " + t.lstrip(), None
        elif held is not None:
            out.append(held)
            held = None
        if not any(c in t[-20:] for c in ".!?") or t.rstrip().endswith("-"):
            held = t
        else:
            out.append(t)
    return "\n\n".join([*out, held] if held is not None else out), sections


def test_page_documents_against_plain_python(spark):
    table = text_queries.blocks(spark, "/root/testdata/sf0.001")
    own = {}
    for r in table.collect():
        own.setdefault(r.doc_id, []).append(r.asDict())
    got = {r.doc_id: (r.text, [tuple(s) for s in r.sections]) for r in text_queries.page_documents(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: w for d, b in own.items() if (w := whole_document(b))[1]}


def test_recognised_pages_are_mended(spark):
    rows = [("d", 0, i, 0.0, 100.0, float(i), 10.0, False, t, 100.0, 100.0, True) for i, t in enumerate(["|t is a b|g day", "ab", "file.name ends."])]
    df = spark.createDataFrame(rows, "doc_id string, page int, block int, x0 double, x1 double, y0 double, size double, bold boolean, text string, page_width double, page_height double, ocr boolean")
    assert pages.documents(df).first().text == "It is a bIg day\nfilename ends."
    assert pages.documents(df.limit(0)).count() == 0


MARK = """---
title: A
---
Top line
========

Some text
goes on.

```python
# no heading
x = 1

y = 2
```
## Lists ##
- one
  and more
- two

1. first
> quoted
> lines

Under
---
after

***
~~~
open fence # x
"""


def test_markdown_structure(spark):
    df = spark.createDataFrame([(MARK,), ("",), (None,), ("```\n# a\n```",), ("plain",)], "t string")
    got = [[(s.content, s.section_type, s.level) for s in r.s] if r.s is not None else None for r in df.select(markdown.structure("t").alias("s")).collect()]
    assert got[0] == [("Top line", "heading", 1), ("Some text goes on.", "paragraph", 0), ("# no heading\nx = 1\n\ny = 2", "code_block", 0), ("Lists", "heading", 2), ("one and more", "paragraph", 0), ("two", "paragraph", 0), ("first", "paragraph", 0), ("quoted lines", "paragraph", 0), ("Under", "heading", 2), ("after", "paragraph", 0), ("open fence # x", "code_block", 0)]
    assert not got[1] and not got[2] and got[3] == [("# a", "code_block", 0)] and got[4] == [("plain", "paragraph", 0)]


def test_media_types(spark):
    df = spark.createDataFrame([("a/x", bytearray(b"text"), "application/pdf"), ("b.md", bytearray(b"t"), "text/plain"), ("c", bytearray(b"%PDF-1"), None), ("d", bytearray(b"hi"), "text/markdown; charset=utf-8"), ("e", bytearray(b"\x00\x01"), "image/png")], "path string, content binary, mime string")
    assert [r.k for r in df.select(files.doc_type("path", "content", "mime").alias("k")).collect()] == ["pdf", "markdown", "pdf", "markdown", "unknown"]


def test_progress_and_hash(spark):
    said = []
    p = Progress(said.append, 7)
    for s in ("documents", "chunks", "again-0-standalone", "outcomes"):
        p.reached(s)
    assert [x.split(",")[0] for x in said] == ["[#......] 1/7 documents", "[##.....] 2/7 chunks", "[##.....] 2/7 again-0-standalone", "[#######] 7/7 outcomes"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string")
    assert documents_hash(a) == documents_hash(a.orderBy(F.desc("doc_id"))) != documents_hash(a.limit(1)) != documents_hash(a.withColumn("text", F.lit("z")))


def test_a_broken_stage_asks_again_for_one_part_only(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    docs = spark.createDataFrame([(i, f"# Title {i}\n\n" + f"The river {i} is long and wide. " * 40) for i in range(8)], "doc_id int, text string")

    class Breaks(completion.Offline):
        def complete(self, prompt, system=None, json_mode=False):
            if "generat" in prompt[:40].lower() and not broken.exists() and calls.exists() and calls.read_text().count("g") >= 2:
                broken.touch()
                raise SystemExit("gone")  # not an error of one request: the task dies
            with calls.open("a") as f:
                f.write("g" if "generat" in prompt[:40].lower() else "x")
            return super().complete(prompt, system, json_mode)

    s = qa.Settings(parts=4, diversity=None, repair_attempts=0)
    try:
        qa.run(docs, Breaks, s, StageStore(spark, "one", str(tmp_path / "runs")))
    except BaseException:  # noqa: BLE001 - however Spark reports it
        pass
    assert broken.exists()
    store = StageStore(spark, "one", str(tmp_path / "runs"))
    result = qa.run(docs, Breaks, s, store)
    assert "analyses/part=0" not in store.made_now and result.questions.count() > 0
    assert result.analyses.count() == result.chunks.count()
