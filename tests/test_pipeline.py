"""The façade, the pipeline's invariants, and taking up a run again."""

import json

import pytest

from sparkloom import config as C
from sparkloom import project as P
from sparkloom.errors import ConfigurationError
from sparkloom.operators import completion
from sparkloom.plans import qa
from sparkloom.sources.stages import StageStore

TEXT = "# Rivers\n\n" + " ".join(f"The river number {i} flows past the town of Place{i}." for i in range(60)) + "\n\n## Lakes\n\n" + " ".join(f"Lake {i} is deep and cold." for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, TEXT.replace("river", "stream")), (3, ""), (4, None)], "doc_id bigint, text string")


def test_invariants(spark, docs):
    r = qa.run(docs, completion.Offline, store=StageStore(spark))
    stats = {x["doc_id"]: x for x in r.document_stats.collect()}
    assert set(stats) == {1, 2}
    for s in stats.values():
        assert s["generated"] == s["valid"] + s["rejected"] and s["generated"] > 0
        assert s["valid"] == s["factual_valid"] + s["inferential_valid"] + s["conceptual_valid"]
    assert r.questions.count() == sum(s["valid"] for s in stats.values())
    assert {x["outcome"] for x in r.outcomes.select("outcome").distinct().collect()} <= {"kept", "repaired", "dropped"}
    assert r.outcomes.where("leak_action = 'drop' and outcome = 'kept'").count() == 0


def test_resumes_without_new_calls(spark, docs, tmp_path):
    calls = tmp_path / "calls"

    class Counting(completion.Offline):
        def complete(self, prompt, system=None, json_mode=False):
            with calls.open("a") as f:
                f.write("x")
            return super().complete(prompt, system, json_mode)

    first = qa.run(docs, Counting, store=StageStore(spark, "one", str(tmp_path / "runs")))
    n = len(calls.read_text())
    store = StageStore(spark, "one", str(tmp_path / "runs"))
    second = qa.run(docs, Counting, store=store)
    assert not store.made_now and len(calls.read_text()) == n
    assert sorted(map(str, first.questions.collect())) == sorted(map(str, second.questions.collect()))
    (tmp_path / "runs/one/verdicts/_SUCCESS").unlink()
    third = StageStore(spark, "one", str(tmp_path / "runs"))
    qa.run(docs, Counting, store=third)
    assert third.made_now == ["verdicts"] and len(calls.read_text()) == n


def test_standalone_judge_does_not_see_the_source(spark, docs):
    seen = []

    def reply(prompt):
        if prompt.startswith("[standalone]") and "flows past the town of Place1." in prompt.replace("It is", ""):
            return "leaked"
        return completion.Offline().complete(prompt)

    r = qa.run(docs, lambda: completion.Scripted(reply), store=StageStore(spark))
    assert not seen and r.outcomes.where("leak_action <> 'drop' and standalone = 0").count() == 0


def test_failing_calls_are_failures_of_their_rows(spark, docs):
    def reply(prompt):
        if prompt.startswith("[analysis]") and "Lake 1 " in prompt:
            raise ValueError("no")
        return completion.Offline().complete(prompt)

    r = qa.run(docs, lambda: completion.Scripted(reply), store=StageStore(spark))
    bad = r.failures.collect()
    assert bad and all(x["stage"] == "analysis" and "no" in x["error"] for x in bad)
    assert r.document_stats.agg({"failed_analysis_chunks": "sum"}).first()[0] == len(bad)


def test_project_reads_and_writes(spark, tmp_path, monkeypatch):
    root = P.create(str(tmp_path / "p"))
    (root / "input/a.txt").write_text(TEXT)
    (root / "input/b.md").write_text("---\ntitle: The B\n---\n" + TEXT)
    (root / "input/c.bin").write_bytes(b"\x00\x01\x02\x03")
    (root / "input/d.txt").write_text("  ")
    project = P.Project(spark, str(root))
    summary = project.process_input()
    assert summary["processed"] == 2 and summary["failed"] == 2
    out = json.loads((root / "output/questions.json").read_text())
    assert out["questions"] and {"question", "answer", "context", "category", "metadata"} <= set(out["questions"][0])
    assert out["statistics"]["valid"] == len(out["questions"])
    result = project.process("a.txt")
    path = project.save(result, "chat", "jsonl", "openai_chat")
    lines = [json.loads(x) for f in sorted((tmp_path / "p/output/chat.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert path.endswith("chat.jsonl") and lines and [m["role"] for m in lines[0]["messages"]] == ["user", "assistant"]
    project.save(result, "flat", "csv", "standard")
    head = next(f for f in (root / "output/flat.csv").glob("part-*") if f.read_text()).read_text().splitlines()[0]
    assert head.startswith("id,input,output,context,category,chunk_id,") and head.endswith("metadata_json")
    assert json.loads((root / "output/flat.csv_stats.json").read_text())["generated"] > 0
    with pytest.raises(FileNotFoundError):
        project.process("none.txt")


@pytest.mark.parametrize("tree", [
    {"chunking": {"strategy": "hybrid"}}, {"chunking": {"min_chunk_size": 2000}}, {"llm_services": {"local": {"enabled": False}, "remote": {"enabled": False}}}, {"nonsense": 1}, {"output": {"format": "xml"}},
    {"llm_services": {"local": {"preferred_tasks": ["analysis"]}, "remote": {"preferred_tasks": ["analysis"]}}}, {"llm_services": {"remote": {"provider": "azure"}}}, {"validation": {"diversity": 2.0}}, {"decontextualization": {"max_attempts": 4}}, {"processing": {"log_level": "LOUD"}}, {"chunking": {"overlap_size": "x"}},
])
def test_wrong_configurations(tree):
    with pytest.raises(ConfigurationError):
        C.load(tree=tree, env={})


def test_configuration_from_environment_and_file(tmp_path):
    c = C.load(tree={"llm_services": {"remote": {"model": "${MODEL}", "rate_limit_tokens": 5, "top_p": 0.5}}}, env={"MODEL": "m1", "SPARKLOOM_OUTPUT__JSON_INDENT": "4", "SPARKLOOM_CHUNKING__TARGET_CHUNK_SIZE": "1200"})
    s = c.services()["remote"]
    assert s.model == "m1" and s.tokens_per_minute == 5 and dict(s.extra) == {"top_p": 0.5}
    assert c.output.json_indent == 4 and c.chunking.target_chunk_size == 1200
    path = tmp_path / "c.yaml"
    assert C.write_default(str(path)) and not C.write_default(str(path))
    assert C.load(str(path), env={}) == C.Config()
    with pytest.raises(ConfigurationError):
        C.load(str(path), {}, env={})
    assert C.warnings(C.load(tree={"chunking": {"overlap_size": 600}}, env={}))


def test_command_line(tmp_path, capsys, monkeypatch):
    from sparkloom import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main(["create-project", "x"]) == 0 and (tmp_path / "x/config/loom.yaml").exists()
    assert cli.main(["init-config", "y.yaml"]) == 0 and cli.main(["init-config", "y.yaml"]) == 0
    assert cli.main(["formats"]) == 0 and cli.main(["info"]) == 0 and cli.main(["version"]) == 0
    assert "jsonl" in capsys.readouterr().out


def test_no_text_is_shuffled_before_repairs(spark, docs):
    plans = {}

    class Seen(StageStore):
        def made(self, stage, make):
            def seen():
                df = make()
                plans[stage] = df._jdf.queryExecution().executedPlan().toString()
                return df

            return super().made(stage, seen)

    qa.run(docs, completion.Offline, store=Seen(spark))
    for stage in ("chunks", "analyses", "questions", "checked", "first-faithfulness", "first-standalone", "verdicts"):
        assert "hashpartitioning" not in plans[stage] and "Join" not in plans[stage], stage
