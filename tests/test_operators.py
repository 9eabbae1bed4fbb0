"""Operators against small specifications in Python, and golden tables."""

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom import errors
from sparkloom.functions import text as T
from sparkloom.operators import budget, chunking, completion, judging, leak, parse, repair, routing, sections
from sparkloom.sources import docx, pages, pdf, stages

quick = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column_of, *values):
    """column_of applied to a row of values."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column_of(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def many(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in df.select("i", column_of(F.col("c")).alias("x")).orderBy("i").collect()]


# Leaks

DROPPED = ["According to the passage, what is X?", "What does the text say about X?", "As described above, what is X?", "In this document, what is X?", "The author argues what about X?", "Based on the passage, what is X?", "What does this article discuss on X?"]
FLAGGED = ["Which tool is mentioned for X?", "X is described as what?", "Which of the following is X?", "Given the passage, what is X?"]
PASSED = ["What does a B-tree node hold?", "How is the author's surname formatted in citations?", "Why did this change matter in 1990?", "What is the main advantage of this technique?"]


def test_leak_tables(spark):
    asked = DROPPED + FLAGGED + PASSED
    got = many(spark, lambda q: leak.verdict(q, F.lit("It is X.")), asked)
    assert got == ["drop"] * len(DROPPED) + ["flag"] * len(FLAGGED) + ["pass"] * len(PASSED)


def test_leak_details(spark):
    assert one(spark, leak.verdict, "According to the text, what is mentioned on X?", "a") == "drop"
    assert one(spark, leak.verdict, "What is X?", "The passage states X.") == "drop"
    assert one(spark, lambda q, a: leak.verdict(q, a, scan_answer=False), "What is X?", "The passage states X.") == "pass"
    assert one(spark, leak.verdict, "What is X?", "X is mentioned twice.") == "pass"
    assert one(spark, lambda q, a: leak.verdict(q, a, enabled=False), DROPPED[0], "a") == "pass"
    assert one(spark, leak.verdict, None, None) == "pass"
    found = one(spark, leak.leak, "Per the document, what is X?", "The text says X.")
    assert found["action"] == "drop" and found["matches"] == ["question: 'Per the document'", "answer: 'The text says'"]


# Texts


def spec_whitespace(t):
    if t == "":
        return ""
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
    return "\n".join(x.strip() for x in t.splitlines()).strip() + "\n"


def spec_reflow(t):
    lines, out, held = t.split("\n"), [], []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            if held:
                out.append(" ".join(held))
                held = []
            out.append("")
            continue
        nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
        held.append(line)
        if line[-1] in ".!?\"'>" or (nxt and nxt[0].isupper()) or line.startswith("* "):
            out.append(" ".join(held))
            held = []
    return "\n".join(out + ([" ".join(held)] if held else []))


messy = st.text(st.sampled_from(list("ab A.\n\t\"!*-1")), max_size=40)


@quick
@given(st.lists(messy, min_size=20, max_size=40))
def test_normalising(spark, texts):
    assert many(spark, T.normalize_whitespace, texts) == [spec_whitespace(t) for t in texts]
    flat = [re.sub(r"\t", " ", t) for t in texts]
    assert many(spark, T.reflow, flat) == [spec_reflow(t) for t in flat]


def test_whitespace_golden(spark):
    assert one(spark, T.normalize_whitespace, "Line 1\n\n\n\nLine 2\n\n\nLine 3") == "Line 1\n\nLine 2\n\nLine 3\n"


def test_scalars(spark):
    assert many(spark, T.unit_float, ["0.4", " 7 ", "-1", "x", None, "nan"])[:5] == [0.4, 1.0, 0.0, 0.5, 0.5]
    assert many(spark, T.count_int, ["3.9", "-2", "x", None, "inf"]) == [3, 0, 0, 0, 0]
    assert many(spark, T.standardize_bullets, ["  - a  ", "3.  b", "◦ c\n\tx", "a - b"]) == ["  * a", "* b", "* c\n\tx", "a - b"]
    assert many(spark, T.sentences, ["Dr. Who came. He left! e.g. this one? Yes"]) == [["Dr. Who came.", "He left!", "e.g. this one?", "Yes"]]
    assert many(spark, T.fenced, ['x ```json\n{"a": 1}\n``` y', "none"]) == ['{"a": 1}', None]
    with pytest.raises(KeyError):
        T.fill_template("{x}")


# Sections and chunks


def test_sections(spark):
    text = "# One\nalpha\nbeta\n\nChapter IV: Growth\ngamma\nA Plain Heading\ndelta.\nALL 2 CAPS\n" + "Long letters " * 20
    got = [(s["content"].strip(), s["section_type"], s["level"]) for s in one(spark, sections.extract, text)]
    assert got == [("One", "heading", 1), ("alpha beta", "paragraph", 0), ("Chapter IV:  Growth", "heading", 1), ("gamma", "paragraph", 0), ("A Plain Heading", "heading", 2), ("delta.", "paragraph", 0), ("ALL 2 CAPS", "heading", 1), (("Long letters " * 20).strip(), "paragraph", 0)]
    assert one(spark, sections.extract, "") == [] == one(spark, sections.extract, None)


def rows(lengths, heads=()):
    return [{"content": ("H" if i in heads else "w" * 9 + ". ") * 1 if i in heads else ("word word. " * (n // 11 + 1))[:n], "section_type": "heading" if i in heads else "paragraph", "level": 1 if i in heads else 0} for i, n in enumerate(lengths)]


def test_merge_sizes(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([400, 300, 1500])], "doc_id int, sequence int, content string")
    got = chunking.merge_small(df).orderBy("sequence").collect()
    assert [len(r["content"]) for r in got] == [702, 1500] and [r["sequence"] for r in got] == [0, 1]


def spec_merge(sizes, least, most):
    out, i = [], 0
    while i < len(sizes):
        if sizes[i] < least and i + 1 < len(sizes) and sizes[i] + sizes[i + 1] <= most * 1.1:
            out.append(sizes[i] + sizes[i + 1] + 2)
            i += 2
        else:
            out.append(sizes[i])
            i += 1
    return out


def test_merge_against_loop(spark):
    rng = random.Random(3)
    cases = {d: [rng.choice([1, 3, 5, 8, 12, 20, 30]) for _ in range(rng.randint(1, 25))] for d in range(300)}
    df = spark.createDataFrame([(d, i, "x" * n) for d, ns in cases.items() for i, n in enumerate(ns)], "doc_id int, sequence int, content string")
    got = {}
    for r in chunking.merge_small(df, 10, 20).orderBy("doc_id", "sequence").collect():
        got.setdefault(r["doc_id"], []).append(len(r["content"]))
    assert got == {d: spec_merge(ns, 10, 20) for d, ns in cases.items()}


def test_fixed_fold():
    c = chunking.Chunking("fixed_size", target=500, overlap=50, min=0, max=2500)
    assert len(chunking.fold_fixed(rows([1500]), c)) == 1
    assert len(chunking.fold_fixed(rows([1500]), chunking.Chunking("fixed_size", target=500, overlap=50, min=0, max=2500, split_long=True))) > 1
    got = chunking.fold_fixed(rows([300, 300, 300]), c)
    assert len(got) == 3 and all(len(x["content"]) <= 500 for x in got)
    headed = chunking.fold_fixed(rows([1, 200, 1, 200], (0, 2)), c)
    assert len(headed) == 2 and [h["content"] for h in headed[0]["headings"]] == ["H"] and "H\n\n" in headed[1]["content"]


def test_semantic_fold():
    c = chunking.Chunking(target=300, overlap=50, min=100, max=500)
    got = chunking.fold_semantic(rows([1, 150, 1, 150, 150, 150, 150], (0, 2)), c)
    assert got[0]["overlap_chars"] == 0 and [h["content"] for h in got[0]["headings"]] == ["H"]
    assert any(g["overlap_chars"] for g in got[1:])
    assert sum(g["content"].count("word word") > 0 for g in got) == len(got)
    whole = "".join(r["content"] for r in rows([1, 150, 1, 150, 150, 150, 150], (0, 2)))
    assert all(p in whole for p in ["word word"])
    assert chunking.fold_semantic([], c) == []


@quick
@given(st.lists(st.text(st.sampled_from(list("ab A.!\n")), max_size=60), min_size=10, max_size=30), st.integers(5, 40))
def test_overlaps_agree_with_columns(spark, texts, n):
    assert many(spark, lambda c: chunking.semantic_overlap(c, n), texts) == [chunking._semantic_tail(t, n) for t in texts]
    assert many(spark, lambda c: chunking.fixed_overlap(c, n), texts) == [chunking._fixed_tail(t, n) for t in texts]


def test_chunks_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, [])], f"doc_id int, sections {sections.SECTIONS}")
    assert chunking.chunk(df).count() == 0
    with pytest.raises(errors.ChunkingError):
        chunking.chunk(df, chunking.Chunking("hybrid"))
    with pytest.raises(errors.ChunkingError):
        chunking.Chunking(min=3000)
    chunking.register_strategy("whole", lambda rows, c: [{"content": " ".join(r["content"] for r in rows), "headings": [], "overlap_chars": 0}])
    two = spark.createDataFrame([(1, [("a", "paragraph", 0), ("b", "paragraph", 0)])], f"doc_id int, sections {sections.SECTIONS}")
    assert chunking.chunk(two, chunking.Chunking("whole")).first()["content"] == "a b"


# Budgets


def spec_budget(density, yields, b):
    cats = {n: b.of(n) for n in b.categories}
    f = max(0.5, min(2.0, 1 + density - 0.5))
    n = {c: max(x.min_questions, yields[c]) for c, x in cats.items()}
    if b.adaptive:
        n = {c: max(cats[c].min_questions, round(v * f * cats[c].weight)) for c, v in n.items()}
    total = sum(n.values())
    if total > b.max_questions:
        n = {c: max(cats[c].min_questions, round(v * b.max_questions / total)) for c, v in n.items()}
        excess = sum(n.values()) - b.max_questions
        for c in sorted(n, key=lambda c: (cats[c].weight, n[c], c)):
            cut = min(max(excess, 0), n[c] - cats[c].min_questions)
            n[c], excess = n[c] - cut, excess - cut
    return n


@pytest.mark.parametrize("b", [budget.Budget(), budget.Budget(max_questions=3), budget.Budget(adaptive=False, max_questions=6), budget.Budget(ignore_categories=True)])
def test_budget(spark, b):
    rng = random.Random(1)
    cases = [(i, rng.random(), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(cases, "chunk_id int, density double, factual int, inferential int, conceptual int")
    got = {}
    for r in budget.allocate(df, b).collect():
        got.setdefault(r["chunk_id"], {})[r["category"]] = r["n"]
    assert got == {i: spec_budget(d, {"factual": x, "inferential": y, "conceptual": z}, b) for i, d, x, y, z in cases}


def test_budget_worked_example(spark):
    df = spark.createDataFrame([(1, 0.8, 3, 2, 1)], "chunk_id int, density double, factual int, inferential int, conceptual int")
    got = lambda b: {r["category"]: r["n"] for r in budget.allocate(df, b).collect()}
    assert got(budget.Budget(ignore_categories=True)) == {"factual": 4, "inferential": 3, "conceptual": 1}
    assert got(budget.Budget(ignore_categories=True, max_questions=3)) == {"factual": 2, "inferential": 1, "conceptual": 0}


# Replies


def test_analysis_replies(spark):
    ok = one(spark, parse.analysis, '```json\n{"technical_depth": "0.9", "complexity": 3, "estimated_question_yield": {"factual": "2.5", "other": 4}, "key_concepts": [" a ", "", 3, null, ["x"]]}\n```')
    assert (ok["status"], ok["information_density"], ok["complexity"], ok["topic_coherence"]) == ("ok", 0.9, 1.0, 0.5)
    assert (ok["factual"], ok["inferential"], ok["key_concepts"]) == (2, 0, ["a", "3"])
    for bad in ("[1]", "nothing", "", None):
        x = one(spark, parse.analysis, bad)
        assert (x["status"], x["information_density"], x["factual"]) == ("failed", 0.5, 1)
    assert one(spark, parse.analysis, '{"notes": "n",} trailing')["notes"] == "n"


def test_question_replies(spark):
    item = '{"question": " q ", "answer": "a", "category": "Factual"}'
    want = [("q", "a", "factual")]
    plain = lambda x: None if x is None else [tuple(i) for i in x]
    for reply in (f"[{item}]", f'{{"questions": [{item}]}}', f"Sure\n```json\n[{item}]\n```", f"```\nno\n```\n```json\n[{item}]\n```", '[{"Q": "q", "A": "a", "category": "FACTUAL"}, {"question": "", "answer": "a"}, {"answer": "b"}]'):
        assert plain(one(spark, parse.questions, reply)) == want
    for reply in ('{"information_density": 1, "estimated_question_yield": {}}', "none", '[{"question": "q"}]', "[]", None):
        assert not one(spark, parse.questions, reply)


def test_judge_replies(spark):
    good = one(spark, lambda c: parse.judge(c, judging.FAITHFULNESS), '{"factual_accuracy": {"score": "0.8", "reason": "r"}, "answer_completeness": {"score": "x"}, "suggested_improvements": "s"}')
    assert tuple(good) == (0.8, "r", 0.0, None, "s")
    for bad in ('{"factual_accuracy": 0.9, "answer_completeness": 0.9}', '{"factual_accuracy": {"score": 1}}', "no"):
        assert one(spark, lambda c: parse.judge(c, judging.FAITHFULNESS), bad) is None


def test_rewrite_replies(spark):
    assert tuple(one(spark, parse.rewrite, '```json\n{"question": "q", "answer": "a"}\n```')) == ("q", "a")
    for bad in ('{"question": null, "answer": null}', '{"question": " ", "answer": "a"}', "no", None):
        assert one(spark, parse.rewrite, bad) is None


# Verdicts and repair


def spec_diversity(texts, threshold):
    kept, out = [], []
    for t in texts:
        best = max((SequenceMatcher(None, t, k).ratio() for k in kept), default=0.0)
        out.append(best < threshold)
        if best < threshold:
            kept.append(t)
    return out


def test_diversity(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    asked = [(g, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for g in range(20) for i in range(12)]
    df = spark.createDataFrame(asked, "chunk_id int, generation_index int, question string")
    got = judging.diversity(df).orderBy("chunk_id", "generation_index").collect()
    for g in range(20):
        assert [r["diversity_ok"] for r in got if r["chunk_id"] == g] == spec_diversity([q for c, _, q in asked if c == g], 0.85)
    same = spark.createDataFrame([(1, 0, "What is a tree?"), (1, 1, "How is grass cut?"), (1, 2, "what is the tree")], "chunk_id int, generation_index int, question string")
    assert [r["diversity_ok"] for r in judging.diversity(same).orderBy("generation_index").collect()] == [True, True, False]
    assert judging.distinct_questions(same).count() == 2


@pytest.mark.parametrize("valid, faithful, alone, flag, rewrite_ok, outcome, attempted", [
    (True, True, True, "pass", None, "kept", False), (False, True, False, "pass", True, "repaired", True), (True, True, True, "flag", False, "kept", True),
    (False, True, False, "pass", False, "dropped", True), (False, False, False, "pass", None, "dropped", False), (False, True, False, "pass", None, "dropped", False),
])
def test_repair_table(spark, valid, faithful, alone, flag, rewrite_ok, outcome, attempted):
    q = spark.createDataFrame([("1", "q", "a", valid, faithful, True, alone, flag)], "question_id string, question string, answer string, is_valid boolean, factual_accuracy_ok boolean, answer_completeness_ok boolean, standalone_ok boolean, leak_action string")
    tried = q.where(repair.is_candidate()).select("question_id", F.lit("q2").alias("new_question"), F.lit("a2").alias("new_answer"), F.lit(bool(rewrite_ok)).alias("repaired"))
    if rewrite_ok is None:
        tried = tried.where("false")
    r = repair.keep_better(q, tried).first()
    assert (r["outcome"], r["attempted"], r["question"]) == (outcome, attempted, "q2" if outcome == "repaired" else "q")


# Completion


def test_chat_bodies():
    assert completion.parse_chat('{"choices": [{"message": {"content": " x "}}]}') == "x"
    assert completion.parse_chat('{"message": {"content": "a"}}') == "a"
    assert completion.parse_chat('{"message": {"content": "a"}, "done": false}\n{"message": {"content": "b"}, "done": true}') == "b"
    assert completion.parse_chat('{"message": {"content": "a"}}\nrubbish') == "a"
    with pytest.raises(errors.CompletionError):
        completion.parse_chat("{}")
    assert completion.retry_after("3") == 3.0 and completion.retry_after("x") is None and completion.retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0.0


def test_retries():
    calls, waits = [], []

    def f():
        calls.append(1)
        raise errors.CompletionError("no", retryable=len(calls) < 3)

    with pytest.raises(errors.CompletionError):
        errors.retried(5, 1.0, 60.0, sleep=waits.append)(f)()
    assert len(calls) == 3 and 0.9 <= waits[0] <= 1.1 and 1.8 <= waits[1] <= 2.2


def test_rate_limit():
    now = [0.0]
    limit = completion.RateLimit(2, 0, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.take(1)
    assert now[0] >= 60
    tokens = completion.RateLimit(0, 10, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    tokens.take(8)
    before = now[0]
    tokens.take(8)
    assert now[0] - before >= 60


def test_http_requests_and_service(spark):
    import http.server
    import json
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(seen) == 1 else 200)
            self.end_headers()
            self.wfile.write(b'{"choices": [{"message": {"content": "hello"}}]}')

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = routing.Service("remote", "m", api_base=f"http://127.0.0.1:{server.server_port}/v1", initial_delay=0.01, max_delay=0.02)
    assert completion.Http(s).complete("p", "sys", True) == "hello" and len(seen) == 2
    path, body = seen[-1]
    assert path == "/v1/chat/completions" and [m["role"] for m in body["messages"]] == ["system", "user"] and body["response_format"] == {"type": "json_object"}
    server.shutdown()
    azure = completion.Http(routing.Service("remote", "dep", provider="azure", api_base="https://x", api_version="v1"), token=lambda: "t")
    url, headers, _ = azure.request("p", None, False)
    assert url == "https://x/openai/deployments/dep/chat/completions?api-version=v1" and headers["Authorization"] == "Bearer t"
    assert completion.Http(routing.Service("local", "m", api_base="http://localhost:11434")).request("p", None, False)[0].endswith("/api/chat")


def test_replay_asks_each_prompt_once(spark, tmp_path):
    log = tmp_path / "log"

    def reply(p):
        with log.open("a") as f:
            f.write("x")
        return p.upper()

    requests = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, prompt string")
    known = spark.createDataFrame([], "request_hash string, reply string")
    answered, new = completion.complete_with_replay(requests, known, lambda: completion.Scripted(reply), "t")
    assert {r["k"]: r["reply"] for r in answered.collect()} == {1: "A", 2: "A", 3: "B", 4: None} and len(log.read_text()) == 2
    again, more = completion.complete_with_replay(requests.where("k < 4"), new, lambda: completion.Scripted(reply), "t")
    assert again.where("reply is null").count() == 0 and more.count() == 0 and len(log.read_text()) == 2


def test_routing():
    services = {"remote": routing.Service("remote", "a", ("validation",)), "local": routing.Service("local", "b", ("analysis",))}
    assert [routing.service_for(t, services).name for t in ("analysis", "generation", "validation")] == ["local", "remote", "remote"]
    with pytest.raises(errors.CompletionError):
        routing.service_for("analysis", {})
    with pytest.raises(errors.ConfigurationError):
        routing.check_services({"a": routing.Service("a", "m", ("x",)), "b": routing.Service("b", "m", ("x",))})


# Pages and files


def test_pages_joined_over_ends(spark):
    df = spark.createDataFrame([(["It goes on and on and", "then it ends here.", "", "A new sentence -", "Next page starts."],)], "p array<string>")
    assert df.select(pages.join_pages("p").alias("x")).first()["x"] == ["It goes on and on and then it ends here.", "A new sentence -", "Next page starts."]


def test_columns_and_headers(spark):
    b = [(1, p, i, float(x), float(x + 100), float(y), 10.0, False, t, 600.0, 800.0) for p in range(4) for i, (x, y, t) in enumerate([(30, 0, f"Annual Report {p}"), (30, 100, "left one"), (330, 100, "right one"), (30, 300, "left two"), (330, 300, f"r{p}"), (30, 700, "left last")])]
    df = spark.createDataFrame(b, "doc_id int, page int, block int, x0 double, x1 double, y0 double, size double, bold boolean, text string, page_width double, page_height double")
    assert {r["n_columns"] for r in pages.column_count(df).collect()} == {3}
    order = [r["text"] for r in pages.column_order(df).where("page = 0").orderBy("pos").collect()]
    assert order.index("left last") < order.index("right one")
    found = {(r["place"], r["text"], r["pages"]) for r in pages.repeated_lines(df).collect()}
    assert found == {("header", "Annual Report 0", 4), ("footer", "left last", 4)}
    assert pages.drop_repeated(df, pages.repeated_lines(df)).count() == 4 * 4


def test_docx(tmp_path, spark):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda style, t: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    path = tmp_path / "my_first-file.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Title", "T")}{p("H1", "One")}{p("", "text")}{p("", " ")}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="Title"><w:name w:val="Title"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    got = docx.read(str(path), path.read_bytes())
    assert [(s["content"], s["section_type"], s["level"]) for s in got["sections"]] == [("T", "title", 0), ("One", "heading", 1), ("text", "paragraph", 0)]
    assert got["title"] == "My First File" and got["text"] == "T\n\nOne\n\ntext"
    from sparkloom.sources import files

    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    docs, bad = files.read(spark, str(tmp_path))
    assert [r["title"] for r in docs.collect()] == ["My First File"] and {r["path"].rpartition("/")[2] for r in bad.collect()} == {"broken.docx", "x.pdf"}


def test_registered_reader_and_sniffing(spark, tmp_path):
    from sparkloom.sources import files

    (tmp_path / "a.xyz").write_text("plain text in an unknown kind of file")
    (tmp_path / "b.rev").write_text("txet")
    files.register_reader("reversed", ("rev",), lambda df: files._row(df, "reversed", text=F.reverse(F.col("content").cast("string"))))
    try:
        docs, _ = files.read(spark, str(tmp_path))
        assert {(r["doc_type"], r["text"]) for r in docs.collect()} == {("text", "plain text in an unknown kind of file"), ("reversed", "text")}
    finally:
        files.READERS.pop("reversed")
        files.EXTENSIONS.pop("reversed")


def test_pdf_dates():
    assert pdf.pdf_date("D:20240131120000Z") == "2024-01-31" and pdf.pdf_date(None) is None and pdf.pdf_date("2020") == "2020"


# Stages and streams


def test_stage_helpers(spark, tmp_path):
    assert stages.config_hash({"version": 1, "a": 2}) == stages.config_hash({"version": 2, "a": 2}) != stages.config_hash({"a": 3})
    docs = spark.createDataFrame([("a",), ("b",)], "doc_hash string")
    assert [r[0] for r in stages.pending(docs, docs.where("doc_hash = 'a'")).collect()] == ["b"]
    ck = spark.createDataFrame([("d", 1, 5), ("d", 3, 7), ("d", 2, 9)], "document_id string, saved_at_timestamp int, processed_chunk_count int")
    assert stages.latest(ck).first()["processed_chunk_count"] == 7
    (tmp_path / "q.jsonl").write_text('{"question_id": "1", "question": "q", "answer": "a", "chunk_id": "c"}\nrubbish\n{"question": "q"}\n')
    good, bad = stages.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert good.count() == 1 and bad.count() == 2
    for i in range(5):
        stages.StageStore(spark, f"r{i}", str(tmp_path / "runs")).made("s", lambda: docs)
    assert len(stages.StageStore(spark, "r4", str(tmp_path / "runs")).prune(3)) == 2


def test_arrivals_once_each(spark, tmp_path):
    from sparkloom.streaming import incremental

    src = tmp_path / "in"
    src.mkdir()
    run = lambda: incremental.process(spark, str(src), str(tmp_path / "ck"), str(tmp_path / "docs"), str(tmp_path / "bad"))
    (src / "a.txt").write_text("one")
    (src / "e.txt").write_text(" ")
    run()
    (src / "b.txt").write_text("two")
    run()
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == ["one", "two"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_ascii_json(spark):
    from sparkloom.sources import sinks

    assert one(spark, sinks.ascii_json, '{"a": "é😀x"}') == '{"a": "\\u00e9\\ud83d\\ude00x"}'


def test_likeness_is_difflibs(spark):
    from sparkloom.operators import likeness

    r, ab = random.Random(3), ["ab", "abcde ", "abcdefghijklmnopqrstuvwxyz äöü", "".join(map(chr, range(97, 400))) + "\U0001f600"]
    for n in range(600):
        size, chars = r.choice([0, 1, 5, 40, 63, 64, 199, 200, 201, 260]), r.choice(ab)
        a, b = ("".join(r.choice(chars) for _ in range(r.randint(0, size) if i else size)) for i in (1, 0))
        if n % 2 and b:
            i = r.randrange(len(b))
            a = b[:i] + r.choice(["", "x", "hello"]) + b[i + r.randint(0, 3) :]
        assert likeness.ratio(likeness.Text(a), likeness.Text(b)) == SequenceMatcher(None, a, b).ratio(), (a, b)
    for _ in range(20):
        row = ["".join(r.choice("abc de") for _ in range(r.choice([0, 8, 30, 220]))) for _ in range(12)]
        kept, scores = [], []
        for x in row:
            best = max([SequenceMatcher(None, x, y).ratio() for y in kept], default=0.0)
            scores.append(best)
            kept += [x] * (best < 0.7)
        assert likeness.greatest(row, 0.7) == scores


def test_chunks_leave_in_slices_and_merge_as_by_columns(spark):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("content", pa.string()), ("section_type", pa.string()), ("level", pa.int32())]))
    one = [{"content": "x" * (chunking.SLICE // 10), "section_type": "paragraph", "level": 0}]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([one * 4, one * 4, one * 4, None, [], one * 30, one, one], kind)], names=["doc_id", "sections"])
    assert [p.column(0).to_pylist() for p in chunking._slices(batch, 1)] == [[0, 1], [2, 3, 4], [5], [6, 7]]
    r = random.Random(5)
    docs = [(d, [(r.choice("abcé") * r.choice([1, 20, 90, 200, 400]), r.choice(["heading", "paragraph", "paragraph"]), r.randint(1, 3)) for _ in range(r.randint(0, 25))]) for d in range(60)] + [(90, None)]
    df = spark.createDataFrame(docs, "doc_id int, sections array<struct<content:string,section_type:string,level:int>>")
    c = chunking.Chunking(target=300, overlap=40, min=150, max=500)
    plain = chunking.merge_small(chunking.chunk(df, c), c.min, c.max)
    merged = chunking.chunk(df, c, merge=True)
    assert merged.count() > 100 and sorted(map(str, merged.collect())) == sorted(map(str, plain.select(merged.columns).collect()))


def test_keywords_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, "b a b c_d c_d The"), (2, None), (3, ""), (4, "z y x z")], "doc_id int, text string")
    got = T.keywords(docs, k=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "b", 2, 1), (1, "c_d", 2, 2), (4, "y", 1, 2), (4, "z", 2, 1)]
    more = docs.union(spark.createDataFrame([(4, "w x x"), (None, "n m"), (None, "m")], "doc_id int, text string"))
    assert sorted(map(tuple, T.keywords(more, k=2).where("doc_id = 4 or doc_id is null").collect()), key=str) == [(4, "x", 3, 1), (4, "z", 2, 2), (None, "m", 2, 1), (None, "n", 1, 2)]
    assert T.keywords(more, k=2).where("doc_id = 1").count() == 2


def test_strip_is_pythons(spark):
    texts = ["", " a ", "　 x y\x85\x1c", "  ", "a​", "é \n", "\t\x0b\x0c\r q    "]
    assert many(spark, T.strip, texts) == [x.strip() for x in texts]


def test_filled_values_stay_as_they_are(spark):
    assert many(spark, lambda c: T.fill_template("{{x}} {v} }}", v=c), ["a", "{{b}}", "\ue000", None]) == ["{x} a }", "{x} {{b}} }", "{x} \ue000 }", "{x} N/A }"]
