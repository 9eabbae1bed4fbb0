"""From documents to validated questions: chunks, analyses, questions, verdicts, repairs, statistics.

Stages that call a service are written tables, so that no call is made twice, and a run that broke off goes
on at the first stage that is missing. Between them all is Column expressions. Up to the verdicts a chunk is one row
with an array of its questions, which takes the chunk's text along: no text is shuffled before repairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import budget, chunking, completion, judging, leak, parse, repair, sections
from sparkloom.plans import prompts as P
from sparkloom.session import spread
from sparkloom.sources.stages import StageStore


@dataclass(frozen=True)
class Settings:
    """repair_attempts: 0 turns repairs off. repair_keeps_diversity: a repaired question must have passed the first diversity check.

    parts: written parts of the stages that ask services most, what a run that is taken up again needn't ask twice.
    """

    chunking: chunking.Chunking = chunking.Chunking()
    budget: budget.Budget = field(default_factory=budget.Budget)
    thresholds: tuple[tuple[str, float], ...] = tuple((d, judging.THRESHOLD) for d in judging.DIMENSIONS)
    diversity: float | None = 0.85
    leak_filter: bool = True
    scan_answer: bool = True
    repair_attempts: int = 1
    repair_keeps_diversity: bool = True
    concurrency: int = 3
    parts: int = 1
    whitespace: bool = True
    encoding: bool = True
    formatting: bool = True


@dataclass(frozen=True)
class Result:
    """questions: the valid ones; outcomes: all, with verdicts; chunk_stats and document_stats: the funnel; failures: chunks and questions whose calls failed."""

    chunks: DataFrame
    questions: DataFrame
    outcomes: DataFrame
    chunk_stats: DataFrame
    document_stats: DataFrame
    failures: DataFrame
    analyses: DataFrame


def _prompt(prompts: dict[str, P.Prompt], name: str, **values):
    return T.fill_template(P.get(prompts, name).template, **values)


def _answered(requests: DataFrame, store: StageStore, stage: str, ask, parts: int) -> DataFrame:
    """The replies of a stage, made in so many written parts: a run that breaks off asks again for the part it was in only."""
    if parts < 2:
        return store.made(stage, lambda: ask(requests))
    for i in range(parts):
        store.made(f"{stage}/part={i}", lambda i=i: ask(requests.where(F.pmod(F.xxhash64(*requests.columns[:1]), F.lit(parts)) == i)))
    return store.spark.read.parquet(store.path(stage)).drop("part")


def make_chunks(docs: DataFrame, s: Settings, key: str = "doc_id") -> DataFrame:
    """Documents (key, text, and perhaps path, title, sections) to chunks with ids and context."""
    body = T.preprocess("text", s.whitespace, s.encoding, s.formatting)
    has = docs.columns
    path = F.col("path") if "path" in has else F.col(key).cast("string")
    title = F.col("title") if "title" in has else F.lit(None).cast("string")
    found = docs.where(F.coalesce(T.strip("text"), F.lit("")) != "").select(key, T.document_hash(path, "text").alias("doc_hash"), title.alias("doc_title"), sections.resolve("sections" if "sections" in has else None, body).alias("sections"))
    named = found.withColumn("__doc", F.struct(key, "doc_hash", "doc_title"))
    merged = chunking.chunk(named, s.chunking, "__doc", merge=True).select("__doc.*", "sequence", "content", "headings", "overlap_chars")
    return chunking.context(chunking.with_ids(merged, "doc_hash"), "doc_title").drop("doc_title")


def _ask(df: DataFrame, name: str, prompts, factory, s: Settings) -> DataFrame:
    p = P.get(prompts, name)
    return completion.complete(df, factory, system=p.system, concurrency=s.concurrency, json_mode=p.json_output, tasks=0).drop("prompt")


def _leaks(x, s: Settings):
    """(leak_action, leak_reason) of a question's struct."""
    return T.let(leak.leak(x["question"], x["answer"], enabled=s.leak_filter, scan_answer=s.scan_answer), lambda found: F.struct(found["action"].alias("leak_action"), found["reason"].alias("leak_reason")))


def with_questions(made: DataFrame, s: Settings) -> DataFrame:
    """Replies with lists of questions to generation_error and q: the questions with ids, diversity and leaks."""
    listed = made.withColumn("items", parse.questions("reply")).withColumn("generation_error", F.when(F.col("items").isNull(), F.coalesce("error", F.lit("the reply holds no questions"))))
    if s.diversity is None:
        scored = listed.withColumn("__best", F.transform("items", lambda x: F.lit(0.0)))
    else:
        scored = listed.withColumn("__best", judging.likeness(s.diversity)(F.transform("items", lambda x: T.diversity_form(F.coalesce(x["question"], F.lit(""))))))

    def one(z, i):
        x, best = z["items"], z["__best"]
        own = {"question_id": F.sha2(F.concat_ws("|", "chunk_id", i.cast("string")), 256), "generation_index": i, **{c: x[c] for c in ("question", "answer", "category")}, "diversity": 1 - best, "diversity_ok": F.lit(True) if s.diversity is None else best < s.diversity}
        return T.let(_leaks(x, s), lambda found: F.struct(*[v.alias(n) for n, v in own.items()], *[found[c].alias(c) for c in ("leak_action", "leak_reason")]))

    return scored.withColumn("q", F.transform(F.arrays_zip("items", "__best"), one)).drop("items", "__best", "reply", "error")


def judge(checked: DataFrame, store: StageStore, tag: str, prompts, factory, s: Settings) -> DataFrame:
    """Rows of a chunk's content and its questions q with leaks to rows of questions with scores, <dimension>_ok, is_valid and reasons; dropped ones are not sent to a judge."""

    def asked(name: str, **chunk):
        return F.transform("q", lambda x: F.when(x["leak_action"] != "drop", _prompt(prompts, name, question=x["question"], answer=x["answer"], **chunk)))

    def read(dimensions: tuple[str, ...]):
        return F.transform("reply", lambda r: parse.judge(r, dimensions))

    # read as they are written, so that each reply is parsed once
    rows = checked.where(F.size("q") > 0)
    keep = [c for c in rows.columns if c != "content"]
    faith = rows.withColumn("prompt", asked("faithfulness", chunk="content")).select(*keep, "prompt")
    a = _answered(faith, store, f"{tag}-faithfulness", lambda r: _ask(r, "faithfulness", prompts, factory, s).withColumn("faithful", read(judging.FAITHFULNESS)), s.parts)
    alone = spread(a).select(*keep, "faithful", asked("standalone").alias("prompt"))
    b = _answered(alone, store, f"{tag}-standalone", lambda r: _ask(r, "standalone", prompts, factory, s).withColumn("alone", read(judging.STANDALONE)), s.parts)
    each = T.each(b, [c for c in keep if c != "q"], F.arrays_zip("q", "faithful", "alone"), "z").drop("pos")
    flat = each.select("*", "z.q.*").withColumns(judging.judged(F.col("z.faithful"), F.col("z.alone"))).drop("z")
    return judging.verdicts(flat, dict(s.thresholds))


def run(docs: DataFrame, factory: completion.Factory, settings: Settings = Settings(), store: StageStore | None = None, prompts: dict[str, P.Prompt] | None = None, key: str = "doc_id") -> Result:
    """All stages. A store with a name makes the run one that can be taken up again."""
    s, spark = settings, docs.sparkSession
    prompts = prompts or P.BUILT_IN
    store = store or StageStore(spark)
    chunks = store.made("chunks", lambda: make_chunks(docs, s, key))

    asks = spread(chunks.select("chunk_id", key, "content")).withColumn("prompt", _prompt(prompts, "analysis", chunk="content"))
    parsed = _answered(asks, store, "analyses", lambda r: _ask(r, "analysis", prompts, factory, s).withColumn("a", parse.analysis("reply")), s.parts).drop("reply").select("*", "a.*").drop("a")
    analyses = parsed.drop(key, "content")
    counted = budget.with_counts(spread(parsed).where("status = 'ok'").withColumnRenamed("information_density", "density"), s.budget)
    counts = F.map_from_entries("counts")
    n = {c: F.coalesce(counts[c], F.lit(0)) for c in s.budget.categories}
    wanted = counted.withColumns({f"__n_{c}": x for c, x in n.items()}).where(" + ".join(f"`__n_{c}`" for c in s.budget.categories) + " > 0")
    concepts = F.coalesce(F.nullif(F.array_join("key_concepts", ", "), F.lit("")), F.lit("N/A"))
    numbers = {c: F.col(f"__n_{c}") if c in s.budget.categories else F.lit(0) for c in ("factual", "inferential", "conceptual")}
    asks = wanted.select("chunk_id", key, "content", _prompt(prompts, "generation", chunk="content", concepts=concepts, **numbers).alias("prompt"))
    made = _answered(asks, store, "questions", lambda r: _ask(r, "generation", prompts, factory, s), s.parts)
    checked = store.made("checked", lambda: with_questions(made, s))
    judged = store.made("verdicts", lambda: judge(spread(checked).drop("generation_error"), store, "first", prompts, factory, s))
    judged = judged.withColumn("reasons", F.array_compact(F.concat("reasons", F.array(F.when(~F.col("diversity_ok"), "(diversity) too much like an earlier question"))))).withColumn("is_valid", F.col("is_valid") & F.col("diversity_ok"))

    open_ = judged.where(repair.is_candidate())
    if s.repair_keeps_diversity:
        open_ = open_.where("diversity_ok")
    sources = chunks.select("chunk_id", F.col("content").alias("context"))
    # a number of partitions of its own: few bytes may be much work, so adaptive merging would be wrong
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tried = []
    for i in range(s.repair_attempts):
        told = repair.issue(F.when(~F.col("standalone_ok"), judging.reason("standalone", "standalone")), F.col("leak_reason"))
        met = open_.repartition(deal, "chunk_id").join(sources.repartition(deal, "chunk_id"), "chunk_id")
        work = met.select("question_id", "chunk_id", F.col("context").alias("content"), "question", "answer", _prompt(prompts, "rewrite", issue=told, question="question", answer="answer", chunk="context").alias("prompt"))
        new = store.made(f"rewrites-{i}", lambda w=work: _ask(w, "rewrite", prompts, factory, s).withColumn("new", parse.rewrite("reply")).drop("reply", "error"))
        changed = (F.col("new.question") != F.col("question")) | (F.col("new.answer") != F.col("answer"))
        found = T.let(F.struct("question_id", "new.question", "new.answer"), lambda x: T.let(_leaks(x, s), lambda y: F.struct(*[x[c].alias(c) for c in ("question_id", "question", "answer")], *[y[c].alias(c) for c in ("leak_action", "leak_reason")])))
        retold = spread(new).where(F.col("new").isNotNull() & changed).select("chunk_id", "content", F.array(found).alias("q"))
        again = judge(retold, store, f"again-{i}", prompts, factory, s)
        done = store.made(f"repaired-{i}", lambda a=again: a.select("question_id", "question", "answer", "leak_action", "leak_reason", "standalone", "standalone_ok", "is_valid"))
        tried.append((new.select("question_id"), done))
        open_ = open_.drop("leak_action", "leak_reason", "standalone", "standalone_ok").join(done.where("not is_valid").select("question_id", "leak_action", "leak_reason", "standalone", "standalone_ok"), "question_id")
    if tried:
        best = None
        for i, (_, d) in enumerate(tried):
            x = d.where("is_valid").select("question_id", F.col("question").alias("new_question"), F.col("answer").alias("new_answer"))
            best = x if best is None else best.unionByName(x)
        rewrites = tried[0][0].join(best, "question_id", "left").withColumn("repaired", F.col("new_question").isNotNull())
    else:
        rewrites = spark.createDataFrame([], "question_id string, new_question string, new_answer string, repaired boolean")
    outcomes = store.made("outcomes", lambda: repair.keep_better(judged, rewrites))

    stats = repair.funnel(outcomes, key, "chunk_id")
    asked = checked.select("chunk_id", "generation_error")
    chunk_stats = parsed.select(key, "chunk_id", "status").join(asked, "chunk_id", "left").join(stats.drop(key), "chunk_id", "left")
    numbers = [c for c in stats.columns if c not in (key, "chunk_id")]
    chunk_stats = chunk_stats.na.fill(0, numbers)
    document_stats = chunk_stats.groupBy(key).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("status") != "ok").alias("failed_analysis_chunks"), F.count_if(F.col("generation_error").isNotNull()).alias("failed_qa_chunks"), *[F.sum(c).alias(c) for c in numbers])
    bad = analyses.where("status <> 'ok'").select("chunk_id", F.lit("analysis").alias("stage"), F.coalesce("error", "notes").alias("error"))
    bad = bad.unionByName(asked.where("generation_error is not null").select("chunk_id", F.lit("generation").alias("stage"), F.col("generation_error").alias("error")))
    failures = bad.join(chunks.select("chunk_id", key, "sequence", T.preview("content").alias("preview")), "chunk_id")
    return Result(chunks, outcomes.where("outcome <> 'dropped'").join(sources, "chunk_id"), outcomes, chunk_stats, document_stats, failures, analyses)
