"""Prompts by name: built in, and overridden from YAML files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from sparkloom.errors import CompletionError, ConfigurationError


@dataclass(frozen=True)
class Prompt:
    template: str
    system: str | None = None
    json_output: bool = True


BUILT_IN = {
    "analysis": Prompt("[analysis]\nHow much can be asked about this text? Score information_density, topic_coherence and complexity from 0 to 1, estimate how many factual, inferential and conceptual questions it can answer (estimated_question_yield), and list its key_concepts. Reply with one JSON object.\n---\n{chunk}\n---\n", "You judge how much a text has to ask about."),
    "generation": Prompt("[generation]\nWrite questions that this text alone can answer, with their answers.\nfactual: {factual}\ninferential: {inferential}\nconceptual: {conceptual}\nConcepts: {concepts}\nName what you ask about; never refer to the text itself. Reply with a JSON array of objects with question, answer and category.\n---\n{chunk}\n---\n", "You write questions and answers for training data."),
    "faithfulness": Prompt("[faithfulness]\nIs the answer true to the source (factual_accuracy), and whole (answer_completeness)? For each give an object with a score from 0 to 1 and a reason; add suggested_improvements. Reply with one JSON object.\nQuestion: {question}\nAnswer: {answer}\n---\n{chunk}\n---\n", "You check answers against their source."),
    "standalone": Prompt("[standalone]\nCan the question be understood without any source at hand? Give standalone as an object with a score from 0 to 1 and a reason; add suggested_improvements. Reply with one JSON object.\n---\nQuestion: {question}\nAnswer: {answer}\n---\n", "You check whether questions stand alone."),
    "rewrite": Prompt("[rewrite]\nRewrite the pair so that it stands alone and stays true to the source. If that can't be done give null for both. Reply with one JSON object with question and answer.\nIssue: {issue}\nQuestion: {question}\nAnswer: {answer}\n---\n{chunk}\n---\n", "You make questions stand alone."),
}


def load(folder: str | None = None, strict: bool = False) -> tuple[dict[str, Prompt], dict[str, str]]:
    """(prompts, failures): the built-in ones, overridden by a folder's *.yaml (name: {template, system_prompt, json_output}).

    A file that can't be read is a failure, and an error if strict.
    """
    import yaml

    out, bad = dict(BUILT_IN), {}
    for p in sorted(Path(folder).glob("*.y*ml")) if folder else []:
        try:
            for name, x in (yaml.safe_load(p.read_text(encoding="utf-8")) or {}).items():
                out[name] = Prompt(x["template"], x.get("system_prompt"), bool(x.get("json_output", True)))
        except (yaml.YAMLError, KeyError, TypeError, AttributeError, OSError, UnicodeDecodeError) as e:
            bad[p.name] = f"{type(e).__name__}: {e}"
    if strict and bad:
        raise ConfigurationError(f"prompt files can't be read: {bad}")
    return out, bad


def get(prompts: dict[str, Prompt], name: str) -> Prompt:
    if name not in prompts:
        raise CompletionError(f"no prompt is called {name!r}")
    return prompts[name]


def write_defaults(folder: str) -> list[str]:
    """Write the built-in prompts as YAML files, never over existing ones; returns the names written."""
    import yaml

    Path(folder).mkdir(parents=True, exist_ok=True)
    done = []
    for name, p in BUILT_IN.items():
        path = Path(folder, f"{name}.yaml")
        if not path.exists():
            path.write_text("# Braces that are meant as such are doubled.\n" + yaml.safe_dump({name: {"template": p.template, "system_prompt": p.system, "json_output": p.json_output}}, sort_keys=False, allow_unicode=True), encoding="utf-8")
            if yaml.safe_load(path.read_text(encoding="utf-8"))[name]["template"] != p.template:
                raise ConfigurationError(f"{path} doesn't read as it was written")
            done.append(path.name)
    return done
