"""Replies of completion services, read tolerantly: JSON text to struct and array columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

CATEGORIES = ("factual", "inferential", "conceptual", "implementation", "architectural", "troubleshooting")
_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
_YAML = r"(?m)^([A-Za-z_]+):[ \t]*(.*)$"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _object(v: Column) -> Column:
    """v, if it is a JSON object, else null."""
    return T.let(v, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), x))


def parsed_object(c: Column | str) -> Column:
    """A reply's object as a variant: its first fenced block, else all of it, each repaired where needed; else null."""
    c = T._col(c)
    tries = [T.fenced(c), c, T.repair_json(T.fenced(c)), T.repair_json(c)]
    return F.coalesce(*[_object(F.try_parse_json(x)) for x in tries])


def analysis(c: Column | str) -> Column:
    """Struct of status ('ok' or 'failed'), three scores in 0..1, yields of three kinds, key_concepts and notes.

    Older names of the fields count too. What can't be read becomes 0.5 for scores and 0 for counts; without any
    yields they are 1, 0, 0. A reply that is no object is 'failed' with those defaults; null counts as one.
    """

    def one(v: Column) -> Column:
        def either(*names: str, kind: str = "string") -> Column:
            return F.coalesce(*[_get(v, f"$.{n}", kind) for n in names])

        yields = _get(v, "$.estimated_question_yield", "variant")
        has = v.isNotNull() & yields.isNotNull() & F.schema_of_variant(yields).startswith("OBJECT")
        concepts = F.coalesce(*[_get(v, f"$.{n}", "array<variant>") for n in ("key_concepts", "key_technical_concepts")])
        plain = F.filter(concepts, lambda x: F.schema_of_variant(x).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"))
        named = F.filter(F.transform(plain, lambda x: T.strip(_get(x, "$"))), lambda s: s != "")

        def amount(k: str, default: int) -> Column:
            return F.when(has, T.count_int(_get(v, f"$.estimated_question_yield.{k}"))).otherwise(default)

        return F.struct(
            F.when(v.isNull(), "failed").otherwise("ok").alias("status"),
            T.unit_float(either("information_density", "technical_depth")).alias("information_density"),
            T.unit_float(either("topic_coherence", "architectural_clarity")).alias("topic_coherence"),
            T.unit_float(either("complexity", "implementation_specificity")).alias("complexity"),
            amount("factual", 1).alias("factual"),
            amount("inferential", 0).alias("inferential"),
            amount("conceptual", 0).alias("conceptual"),
            F.coalesce(named, F.array().cast("array<string>")).alias("key_concepts"),
            F.when(v.isNull(), "the reply is no JSON object").otherwise(_get(v, "$.notes")).alias("notes"),
        )

    return T.let(parsed_object(c), one)


_ITEM = "question string, Q string, answer string, A string, category string"


def _items(text: Column, fenced: bool) -> Column:
    """The items of a JSON array whose first has a question (and, outside fences, an answer), or of an object's 'questions'; else null."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    direct = F.when(kind.startswith("ARRAY<OBJECT"), F.from_json(text, f"array<struct<{_ITEM.replace(' string', ':string')}>>", {"mode": "PERMISSIVE"}))
    first = F.get(direct, F.lit(0))
    good = F.coalesce(first["question"], first["Q"]).isNotNull()
    if not fenced:
        good = good & F.coalesce(first["answer"], first["A"]).isNotNull()
    held = F.when(kind.startswith("OBJECT"), F.to_json(_get(v, "$.questions", "variant")))
    inner = F.from_json(held, f"array<struct<{_ITEM.replace(' string', ':string')}>>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.when(good, direct), F.when(F.schema_of_variant(F.try_parse_json(held)).startswith("ARRAY"), inner))


def questions(c: Column | str) -> Column:
    """Array of (question, answer, category) of a reply, blank ones left out; null if it holds no list of questions.

    All of it as JSON first, then each fenced block in turn. Unknown categories become 'unknown'.
    """
    c = T._col(c)
    blocks = F.transform(F.regexp_extract_all(c, F.lit(_FENCE), 1), lambda b: _items(b, True))
    found = F.coalesce(_items(T.strip(c), False), F.get(F.filter(blocks, lambda b: b.isNotNull()), F.lit(0)))

    def tidy(i: Column) -> Column:
        kind = F.lower(T.strip(F.coalesce(i["category"], F.lit(""))))
        return F.struct(
            T.strip(F.coalesce(i["question"], i["Q"])).alias("question"),
            T.strip(F.coalesce(i["answer"], i["A"])).alias("answer"),
            F.when(kind.isin(*CATEGORIES), kind).otherwise("unknown").alias("category"),
        )

    return F.filter(F.transform(found, tidy), lambda q: (F.coalesce(q["question"], F.lit("")) != "") & (F.coalesce(q["answer"], F.lit("")) != ""))


def judge(c: Column | str, dimensions: tuple[str, ...]) -> Column:
    """Struct of a score and a reason for each dimension, and the suggestion; null if a dimension is no object.

    A score that is no number is 0.
    """

    def one(v: Column) -> Column:
        parts = {d: _get(v, f"$.{d}", "variant") for d in dimensions}
        whole = v.isNotNull()
        fields = []
        for d, part in parts.items():
            whole = whole & part.isNotNull() & F.schema_of_variant(part).startswith("OBJECT")
            fields += [F.coalesce(_get(v, f"$.{d}.score").try_cast("double"), F.lit(0.0)).alias(d), _get(v, f"$.{d}.reason").alias(f"{d}_reason")]
        return F.when(whole, F.struct(*fields, _get(v, "$.suggested_improvements").alias("suggestion")))

    return T.let(parsed_object(c), one)


def rewrite(c: Column | str) -> Column:
    """Struct (question, answer) of a rewritten pair, or null if the service declined or the reply can't be read."""

    def one(v: Column) -> Column:
        q, a = T.strip(_get(v, "$.question")), T.strip(_get(v, "$.answer"))
        return F.when((F.coalesce(q, F.lit("")) != "") & (F.coalesce(a, F.lit("")) != ""), F.struct(q.alias("question"), a.alias("answer")))

    return T.let(parsed_object(c), one)
