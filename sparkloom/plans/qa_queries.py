"""Queries on questions and answers: leaks, budgets, replies, verdicts, repair, statistics and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import budget, judging, layouts, leak, parse, repair, routing
from sparkloom.plans.text_queries import quoted, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# One question for each document, of eight kinds: three refer to their source, three may, two don't.
_ASKED = ["According to the passage, what is item {}?", "What does the text say on item {}?", "How does item {} work?", "What is mentioned with item {}?", "Which of the following is item {}?", "Why is item {} used?", "Given the context, what is item {}?", "When was item {} made?"]
_SAID = ["It is part of a set. {}", "The passage states much. {}", "{}", "The value is noted. {}", "{}", "As described above, it works. {}", "{}", "{}"]
_KINDS = ["factual", "inferential", "conceptual"]


def _sql_case(values: list[str], key: str, fill: str) -> str:
    def filled(v: str) -> str:
        before, after = v.split("{}")
        return " || ".join([quoted(before)] * bool(before) + [fill] + [quoted(after)] * bool(after))

    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {filled(v)}" for i, v in enumerate(values)) + " end"


_ASKED_SQL = f"""asked as (select doc_id, lang, source, doc_id // 4 as chunk_id, (doc_id % 4)::int as generation_index, {_sql_case(_ASKED, "doc_id", "doc_id::varchar")} as question, {_sql_case(_SAID, "doc_id", "text")} as answer,
 case doc_id % 3 when 0 then 'factual' when 1 then 'inferential' else 'conceptual' end as category, text from documents)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def case(values: list[str], fill: str):
        return F.expr(_sql_case(values, "doc_id", fill))

    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.expr("doc_id div 4").alias("chunk_id"), F.expr("cast(doc_id % 4 as int)").alias("generation_index"), case(_ASKED, "cast(doc_id as string)").alias("question"), case(_SAID, "text").alias("answer"),
        F.expr("case doc_id % 3 when 0 then 'factual' when 1 then 'inferential' else 'conceptual' end").alias("category"), "text",
    )


def _any_sql(c: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, {quoted('(?i)' + p)})" for p in patterns) + ")"


_VERDICT_SQL = f"case when {_any_sql('question', leak.DROP)} or {_any_sql('answer', leak.DROP)} then 'drop' when {_any_sql('question', leak.FLAG)} then 'flag' else 'pass' end"


def _hits_sql(c: str, patterns) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({c}, {quoted('(?i)' + p)}) then '{c}: ''' || regexp_extract({c}, {quoted('(?i)' + p)}) || '''' end" for p in patterns) + "], lambda x: x is not null)"


@query(f"with {_ASKED_SQL} select doc_id, {_VERDICT_SQL} as action from asked")
def leak_verdict(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", leak.verdict("question", "answer").alias("action"))


@query(f"""
with {_ASKED_SQL}, v as (select *, {_VERDICT_SQL} as action from asked)
select doc_id, action, array_to_string(case action when 'drop' then list_concat({_hits_sql("question", leak.DROP)}, {_hits_sql("answer", leak.DROP)}) when 'flag' then {_hits_sql("question", leak.FLAG)} else [] end, '; ') as matches from v
""")
def leak_matches(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", leak.leak("question", "answer").alias("l")).select("doc_id", "l.action", F.array_join("l.matches", "; ").alias("matches"))


@query(f"with {_ASKED_SQL} select lang, {_VERDICT_SQL} as action, category, count(*) as n from asked group by all")
def leak_funnel(spark, sf_dir):
    return asked(spark, sf_dir).groupBy("lang", leak.verdict("question", "answer").alias("action"), "category").agg(F.count("*").alias("n"))


@query("""
with t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, text as question, answer from t where role = 'user' and next_role = 'assistant'
""")
def qa_from_turns(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def _turn_pairs(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))


def _budget_sql(cats: dict, cap: int = 10) -> str:
    rows = ", ".join(f"('{n}', {c.min_questions}, {c.weight}::double)" for n, c in cats.items())
    return f"""
with cats(category, least, w) as (values {rows}),
d as (select doc_id, (n_chars % 101) / 100.0::double as density, (n_chars % 7)::int as factual, (n_chars % 5)::int as inferential, (n_chars % 4)::int as conceptual from documents),
y as (select doc_id, density, category, least, w, case category when 'factual' then factual when 'inferential' then inferential else conceptual end as yield from d cross join cats),
a as (select *, greatest(least, round_even(greatest(least, yield) * least(2.0::double, greatest(0.5::double, 1.0 + (density - 0.5))) * w, 0)::int) as n0 from y),
b as (select *, sum(n0) over (partition by doc_id) as total from a),
c as (select *, case when total > {cap} then greatest(least, round_even(n0 * {cap}::double / total, 0)::int) else n0 end as n1 from b),
e as (select *, greatest(0, sum(n1) over (partition by doc_id) - {cap}) as excess, coalesce(sum(n1 - least) over (partition by doc_id order by w, n1, category rows between unbounded preceding and 1 preceding), 0) as before from c)
select doc_id, category, (n1 - least(greatest(excess - before, 0), n1 - least))::int as n from e"""


def _densities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(n_chars % 101 as double) / 100 as density", "cast(n_chars % 7 as int) as factual", "cast(n_chars % 5 as int) as inferential", "cast(n_chars % 4 as int) as conceptual")


@query(_budget_sql(budget.Budget().categories))
def question_budget(spark, sf_dir):
    return budget.allocate(_densities(spark, sf_dir), key="doc_id")


@query(_budget_sql({n: budget.Category() for n in budget.Budget().categories}))
def question_budget_plain(spark, sf_dir):
    return budget.allocate(_densities(spark, sf_dir), budget.Budget(ignore_categories=True), key="doc_id")




# Replies: JSON bare, fenced, with trailing commas, or none at all; the text goes in as a JSON string.
def _replies(spark, sf_dir) -> DataFrame:
    quoted_text = F.expr("substring(to_json(struct(text as t)), 6, length(to_json(struct(text as t))) - 6)")
    body = F.concat(
        F.lit('{"information_density": '), ((F.col("n_chars") % 150) / 100.0).cast("double").cast("string"), F.lit(', "topic_coherence": "0.'), (F.col("n_chars") % 9 + 1).cast("string"), F.lit('", "complexity": '), F.when(F.col("doc_id") % 3 == 0, '"high"').otherwise("0.25"),
        F.lit(', "estimated_question_yield": {"factual": '), (F.col("n_chars") % 6).cast("string"), F.lit(', "inferential": "2.7", "conceptual": -1}, "key_concepts": [" '), "lang", F.lit(' ", "", '), (F.col("doc_id") % 10).cast("string"), F.lit(', {"a": 1}], "notes": '), quoted_text,
    )
    k = F.col("doc_id") % 5
    reply = F.when(k == 4, F.concat(F.lit("no reply for "), "doc_id")).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("}\n```\nDone."))).when(k == 2, F.concat(body, F.lit(",}"))).otherwise(F.concat(body, F.lit("}")))
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


@query("""
select doc_id, case when doc_id % 5 = 4 then 'failed' else 'ok' end as status,
 case when doc_id % 5 = 4 then 0.5 else least(1.0, ((n_chars % 150) / 100.0)::double) end::double as information_density,
 case when doc_id % 5 = 4 then 0.5 else (n_chars % 9 + 1) / 10.0 end::double as topic_coherence,
 case when doc_id % 5 = 4 or doc_id % 3 = 0 then 0.5 else 0.25 end::double as complexity,
 case when doc_id % 5 = 4 then 1 else n_chars % 6 end::int as factual, case when doc_id % 5 = 4 then 0 else 2 end::int as inferential, 0::int as conceptual,
 case when doc_id % 5 = 4 then '' else lang || ',' || (doc_id % 10) end as key_concepts, case when doc_id % 5 = 4 then 'the reply is no JSON object' else text end as notes from documents
""")
def analysis_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", parse.analysis("reply").alias("a")).select("doc_id", "a.status", "a.information_density", "a.topic_coherence", "a.complexity", "a.factual", "a.inferential", "a.conceptual", F.array_join("a.key_concepts", ",").alias("key_concepts"), "a.notes")


@query(f"""
with {_ASKED_SQL}, k as (select doc_id, question, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') as answer, category from asked where doc_id % 4 <> 3)
select doc_id, 0::int as pos, question, answer, case when doc_id % 2 = 0 then category else 'unknown' end as category from k where answer <> ''
union all select doc_id, 1::int, 'And the other?', 'No.', 'factual' from k
""")
def question_parse(spark, sf_dir):
    q = asked(spark, sf_dir)
    cat = F.when(F.col("doc_id") % 2 == 0, F.upper("category")).otherwise("riddle")
    item = F.to_json(F.struct(F.col("question"), F.col("answer"), cat.alias("category")))
    rows = F.concat(F.lit("["), item, F.lit(', {"question": " And the other? ", "answer": "No.", "category": "factual"}, {"question": "  ", "answer": "x"}, {"question": "q", "answer": null}]'))
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, rows).when(k == 1, F.concat(F.lit('{"questions": '), rows, F.lit("}"))).when(k == 2, F.concat(F.lit("Sure:\n```\nnot json\n```\n```json\n"), rows, F.lit("\n```"))).otherwise(F.lit("I can't."))
    return T.each(q, ["doc_id"], parse.questions(reply), "i").select("doc_id", "pos", "i.question", "i.answer", "i.category")


@query("""
select doc_id, ((n_chars % 100) / 100.0)::double as factual_accuracy, case when doc_id % 2 = 0 then 0.0 else 0.9 end::double as answer_completeness, 'seen ' || source as factual_accuracy_reason, text as suggestion from documents where doc_id % 3 <> 2
""")
def judge_parse(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 3 == 2, F.lit('{"factual_accuracy": 0.9, "answer_completeness": 0.8}')).otherwise(
        F.to_json(F.struct(F.struct(((F.col("n_chars") % 100) / 100.0).alias("score"), F.concat(F.lit("seen "), "source").alias("reason")).alias("factual_accuracy"), F.struct(F.when(F.col("doc_id") % 2 == 0, "n/a").otherwise("0.9").alias("score")).alias("answer_completeness"), F.col("text").alias("suggested_improvements")))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", parse.judge(reply, judging.FAITHFULNESS).alias("j")).where("j is not null")
    return docs.select("doc_id", "j.factual_accuracy", "j.answer_completeness", "j.factual_accuracy_reason", "j.suggestion")


@query(r"""
select doc_id, case when doc_id % 2 = 0 then 'http://a.b/c ' || lang else lang end as url, (n_chars % 3)::bigint as n from documents
""")
def json_repair(spark, sf_dir):
    broken = F.concat(F.lit('{"url": "'), F.when(F.col("doc_id") % 2 == 0, "http://a.b/c ").otherwise(""), "lang", F.lit('", // the place\n /* count */ "n": ['), (F.col("n_chars") % 3).cast("string"), F.lit(",],\n} and more"))
    v = F.try_parse_json(T.repair_json(broken))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_variant_get(v, "$.url", "string").alias("url"), F.try_variant_get(v, "$.n[0]", "bigint").alias("n"))


@query(f"""
with {_ASKED_SQL} select doc_id, 'Answer ' || category || ' {{x}} about ' || lang || ': ' || question as prompt from asked
""")
def prompt_fill(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", T.fill_template("Answer {category} {{x}} about {lang}: {question}", category="category", lang="lang", question="question").alias("prompt"))


# Labels as judges: quality for accuracy, its opposite of toxic for standing alone.
_JUDGED_SQL = f"""{_ASKED_SQL},
judged as (select a.*, {_VERDICT_SQL} as leak_action, coalesce(l.quality, 0) * 0.8::double as factual_accuracy, case when a.doc_id % 7 = 0 then 0.6 else 0.9 end::double as answer_completeness, (case when coalesce(l.toxic, 0) = 1 or a.doc_id % 5 = 0 then 0.2 else 0.75 end)::double as standalone from asked a left join labels l using (doc_id))"""


def judged(spark, sf_dir) -> DataFrame:
    q = asked(spark, sf_dir).withColumn("leak_action", leak.verdict("question", "answer"))
    lab = table(spark, sf_dir, "labels")
    return q.join(lab, "doc_id", "left").withColumns({
        "factual_accuracy": F.coalesce("quality", F.lit(0)) * F.lit(0.8),
        "answer_completeness": F.when(F.col("doc_id") % 7 == 0, 0.6).otherwise(0.9),
        "standalone": F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.col("doc_id") % 5 == 0), 0.2).otherwise(0.75),
    }).drop("quality", "toxic")


@query("select doc_id, quality >= 0.7 as quality_ok, 1 - toxic >= 0.7 as clean_ok, '(quality) quality score: ' || printf('%.2f', quality::double) || ' (Threshold: 0.7)' as reason from labels")
def judge_threshold(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", judging.passes(F.col("quality").cast("double")).alias("quality_ok"), judging.passes(1.0 - F.col("toxic")).alias("clean_ok"), judging.reason("quality", F.col("quality").cast("double")).alias("reason"))


@query("""
with a as (select doc_id, quality::double as factual_accuracy, quality::double as answer_completeness, case when quality = 0 then 'say more' end as suggestion from labels),
b as (select doc_id, (n_chars % 10) / 10.0::double as standalone, 'name it' as suggestion from documents where lang = 'en')
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(factual_accuracy, 0) as factual_accuracy, coalesce(answer_completeness, 0) as answer_completeness, coalesce(standalone, 0)::double as standalone, coalesce(a.suggestion, b.suggestion) as suggestion from a full outer join b on a.doc_id = b.doc_id
""")
def judge_merge(spark, sf_dir):
    q = F.col("quality").cast("double")
    a = table(spark, sf_dir, "labels").select("doc_id", q.alias("factual_accuracy"), q.alias("answer_completeness"), F.when(q == 0, "say more").alias("suggestion"))
    b = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", ((F.col("n_chars") % 10) / 10.0).cast("double").alias("standalone"), F.lit("name it").alias("suggestion"))
    return judging.merge_judges(a, b, "doc_id")


@query(f"""
with {_JUDGED_SQL}
select doc_id, leak_action, leak_action <> 'drop' and factual_accuracy >= 0.7 and answer_completeness >= 0.7 and standalone >= 0.7 as is_valid,
 case when leak_action = 'drop' then '(leak_filter) refers to its source' else '(factual_accuracy) factual_accuracy score: ' || printf('%.2f', factual_accuracy) || ' (Threshold: 0.7); (answer_completeness) answer_completeness score: ' || printf('%.2f', answer_completeness) || ' (Threshold: 0.7); (standalone) standalone score: ' || printf('%.2f', standalone) || ' (Threshold: 0.7)' || case when leak_action = 'flag' then '; (leak_filter) may refer to its source' else '' end end as reasons from judged
""")
def verdict_aggregate(spark, sf_dir):
    return judging.verdicts(judged(spark, sf_dir)).select("doc_id", "leak_action", "is_valid", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""
with {_JUDGED_SQL} select doc_id from judged where leak_action <> 'drop' and factual_accuracy >= 0.7 and answer_completeness >= 0.7 and (standalone < 0.7 or leak_action = 'flag')
""")
def repair_route(spark, sf_dir):
    return judging.verdicts(judged(spark, sf_dir)).where(repair.is_candidate()).select("doc_id")


# A rewrite of a candidate passes for every third document.
def _outcomes(spark, sf_dir) -> DataFrame:
    v = judging.verdicts(judged(spark, sf_dir)).withColumn("diversity_ok", F.col("doc_id") % 11 != 0).withColumn("is_valid", F.col("is_valid") & F.col("diversity_ok"))
    made = v.where(repair.is_candidate()).select("doc_id", F.concat(F.lit("Restated: "), "question").alias("new_question"), F.col("answer").alias("new_answer"), (F.col("doc_id") % 3 == 0).alias("repaired"))
    return repair.keep_better(v, made, "doc_id")


_OUTCOME_SQL = f"""{_JUDGED_SQL},
cand as (select *, leak_action <> 'drop' and factual_accuracy >= 0.7 and answer_completeness >= 0.7 as faithful, leak_action <> 'drop' and standalone >= 0.7 as alone, doc_id % 11 <> 0 as diverse from judged),
tried as (select *, faithful and (not alone or leak_action = 'flag') as attempted from cand),
outcomes as (select *, case when attempted and doc_id % 3 = 0 then 'repaired' when faithful and alone and diverse then 'kept' else 'dropped' end as outcome from tried)"""


@query(f"with {_OUTCOME_SQL} select doc_id, outcome, attempted, case when outcome = 'repaired' then 'Restated: ' else '' end || question as question from outcomes")
def keep_better(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("doc_id", "outcome", "attempted", "question")


_FUNNEL = """count(*) as generated, count(*) filter (outcome <> 'dropped') as valid, count(*) filter (outcome = 'dropped') as rejected, count(*) filter (attempted) as repair_attempted, count(*) filter (outcome = 'repaired') as repair_succeeded, count(*) filter (attempted and outcome <> 'repaired') as repair_failed,
 count(*) filter (outcome = 'dropped' and not faithful and leak_action <> 'drop') as rejected_faithfulness, count(*) filter (outcome = 'dropped' and not alone and leak_action <> 'drop') as rejected_standalone, count(*) filter (outcome = 'dropped' and not diverse) as rejected_diversity, count(*) filter (outcome = 'dropped' and leak_action = 'drop') as rejected_leak,
 count(*) filter (outcome = 'dropped' and attempted) as rejected_repair, count(*) filter (outcome = 'dropped' and faithful and alone and diverse and not attempted) as rejected_other,
 count(*) filter (outcome <> 'dropped' and category = 'factual') as factual_valid, count(*) filter (outcome <> 'dropped' and category = 'inferential') as inferential_valid, count(*) filter (outcome <> 'dropped' and category = 'conceptual') as conceptual_valid"""


@query(f"with {_OUTCOME_SQL} select chunk_id, {_FUNNEL} from outcomes group by chunk_id")
def chunk_funnel(spark, sf_dir):
    return repair.funnel(_outcomes(spark, sf_dir), "chunk_id")


@query(f"with {_OUTCOME_SQL} select lang, source, count(*) as generated, count(*) filter (outcome <> 'dropped') as valid from outcomes group by rollup (lang, source)")
def funnel_rollup(spark, sf_dir):
    return _outcomes(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("generated"), F.count_if(F.col("outcome") != "dropped").alias("valid"))


@query("""
with n as (select conv_id, turn, text, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda w: w <> '' and w not in (""" + ", ".join(map(quoted, T.DIVERSITY_WORDS)) + """)), ' ') as norm from conversations)
select conv_id, min(turn) as turn, count(*) as copies, norm from n group by conv_id, norm
""")
def diversity_exact(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", T.diversity_form("text").alias("norm")).agg(F.min("turn").alias("turn"), F.count("*").alias("copies"))


@query(None)
def diversity_fuzzy(spark, sf_dir):
    """Turns of each conversation that are unlike all accepted ones before them (a sequential rule: no SQL)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return judging.diversity(turns, "conv_id", "turn", "text").select("conv_id", "turn", F.round("diversity", 9).alias("diversity"), "diversity_ok")


@query("""
with done as (select user_id, max(event_id) as last_id from events where event_type = 'purchase' group by user_id)
select event_id, user_id from events e where not exists (select 1 from done d where d.user_id = e.user_id and e.event_id <= d.last_id)
""")
def resume_anti_join(spark, sf_dir):
    """Work left after the last checkpoint of each user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    done = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    return e.alias("e").join(done.alias("d"), (F.col("e.user_id") == F.col("d.user_id")) & (F.col("e.event_id") <= F.col("d.last_id")), "left_anti").select("event_id", "user_id")


@query("select user_id, event_id, json_extract_string(props, '$.k')::int as k from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type <> 'error') where r = 1")
def latest_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    best = F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("b")
    return e.groupBy("user_id").agg(best).select("user_id", "b.event_id", F.get_json_object("b.props", "$.k").cast("int").alias("k"))


@query("""
select conv_id, turn, json_object('messages', json_array(json_object('role', 'user', 'content', text), json_object('role', 'assistant', 'content', answer)))::varchar as record from (
 select *, lead(role) over w as nr, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'
""")
def layout_chat(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct(layouts.messages("text", "answer").alias("messages"))).alias("record"))


def _layout_sql(q: str, a: str) -> str:
    return f"select text as {q}, answer as {a}, 'turn ' || turn as context from (select *, lead(role) over w as nr, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'"


def _records(spark, sf_dir) -> DataFrame:
    return _turn_pairs(spark, sf_dir).select("text", "answer", F.concat(F.lit("turn "), "turn").alias("context"))


@query(_layout_sql("question", "answer"))
def layout_default(spark, sf_dir):
    return layouts.apply(_records(spark, sf_dir), "default")


@query(_layout_sql("prompt", "completion"))
def layout_legacy(spark, sf_dir):
    return layouts.apply(_records(spark, sf_dir), "openai_legacy")


@query(_layout_sql("input", "output"))
def layout_standard(spark, sf_dir):
    return layouts.apply(_records(spark, sf_dir), "standard")


@query("""
select conv_id || '-' || turn as id, text as prompt, answer as completion, '' as context, 'factual' as category, conv_id::varchar as chunk_id, turn::varchar as generation_index, role as position_role, '{"generation_index":' || turn || ',"position_info":{"role":"' || role || '"}}' as metadata_json from (
 select *, lead(role) over w as nr, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'
""")
def layout_csv(spark, sf_dir):
    p = _turn_pairs(spark, sf_dir)
    df = p.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "answer", F.lit("").alias("context"), F.lit("factual").alias("category"), F.col("conv_id").cast("string").alias("chunk_id"), F.struct(F.col("turn").alias("generation_index"), F.struct("role").alias("position_info")).alias("metadata"))
    return layouts.flat(df, "openai_legacy")


@query("select event_id, case when event_type in ('view', 'click') then 'remote' when event_type in ('purchase', 'signup') then 'local' else 'remote' end as service from events")
def service_routing(spark, sf_dir):
    services = {"remote": routing.Service("remote", "a", ("view", "click")), "local": routing.Service("local", "b", ("purchase", "signup"))}
    return table(spark, sf_dir, "events").select("event_id", routing.route(F.col("event_type"), services).alias("service"))


@query("""
select event_id, count(*) over w as requests, round(sum(value) over w, 6) as tokens, count(*) over w > 20 as waits from events window w as (partition by event_type order by epoch_us(ts) range between 59999999 preceding and current row)
""")
def rate_window_60s(spark, sf_dir):
    return routing.rate_window(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value"), 20).select("event_id", "requests", F.round("tokens", 6).alias("tokens"), "waits")


@query(None)
def qa_outcomes(spark, sf_dir):
    """Every question that the offline completer asks of every document, with verdict and outcome; tests hold its invariants."""
    from sparkloom.operators.completion import Offline
    from sparkloom.plans import qa

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return qa.run(docs, Offline).outcomes.select("doc_id", "chunk_id", "generation_index", "category", "question", "answer", "leak_action", "diversity_ok", "is_valid", "outcome")


@query(None)
def qa_document_stats(spark, sf_dir):
    """The funnel of each document, by the offline completer."""
    from sparkloom.operators.completion import Offline
    from sparkloom.plans import qa

    return qa.run(table(spark, sf_dir, "documents").select("doc_id", "text"), Offline).document_stats
