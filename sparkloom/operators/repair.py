"""Which weak questions are rewritten, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORY_COUNTS = ("factual", "inferential", "conceptual")


def is_candidate(leak: Column | str = "leak_action") -> Column:
    """Faithful and complete, but not standing alone or flagged."""
    leak = F.col(leak) if isinstance(leak, str) else leak
    return F.col("factual_accuracy_ok") & F.col("answer_completeness_ok") & (~F.col("standalone_ok") | (leak == "flag"))


def issue(standalone_reason: Column, leak_reason: Column) -> Column:
    """What is wrong, in one line, for the rewriting prompt; nulls are left out."""
    return F.concat_ws(" ", standalone_reason, leak_reason)


def keep_better(questions: DataFrame, rewrites: DataFrame, key: str = "question_id") -> DataFrame:
    """Each question with its outcome: 'repaired' (the rewrite passed), 'kept' (the original is valid), or 'dropped'.

    rewrites: (key, new_question, new_answer, repaired), one row for each question that was tried.
    """
    df = questions.join(rewrites, key, "left")
    done = F.coalesce(F.col("repaired"), F.lit(False))
    ok = F.coalesce(F.col("is_valid"), F.lit(False))
    return df.withColumns({
        "outcome": F.when(done, "repaired").when(ok, "kept").otherwise("dropped"),
        "question": F.when(done, F.col("new_question")).otherwise(F.col("question")),
        "answer": F.when(done, F.col("new_answer")).otherwise(F.col("answer")),
        "attempted": F.col("repaired").isNotNull(),
    }).drop("new_question", "new_answer", "repaired")


def rejections() -> dict[str, Column]:
    """Counts of dropped questions by cause; one question may count for several, 'other' if for none."""
    gone = F.col("outcome") == "dropped"
    faithful = ~(F.col("factual_accuracy_ok") & F.col("answer_completeness_ok")) & (F.col("leak_action") != "drop")
    standalone = ~F.col("standalone_ok") & (F.col("leak_action") != "drop")
    causes = {
        "rejected_faithfulness": faithful,
        "rejected_standalone": standalone,
        "rejected_diversity": ~F.col("diversity_ok"),
        "rejected_leak": F.col("leak_action") == "drop",
        "rejected_repair": F.col("attempted"),
    }
    none = F.lit(True)
    for c in causes.values():
        none = none & ~F.coalesce(c, F.lit(False))
    return {n: F.count_if(gone & c) for n, c in (causes | {"rejected_other": none}).items()}


def funnel(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Per group: generated, valid, rejected, repairs tried, done and failed, causes, and kept questions by category."""
    kept = F.col("outcome") != "dropped"
    aggs = {
        "generated": F.count("*"),
        "valid": F.count_if(kept),
        "rejected": F.count_if(~kept),
        "repair_attempted": F.count_if(F.col("attempted")),
        "repair_succeeded": F.count_if(F.col("outcome") == "repaired"),
        "repair_failed": F.count_if(F.col("attempted") & (F.col("outcome") != "repaired")),
        **rejections(),
        **{f"{c}_valid": F.count_if(kept & (F.col("category") == c)) for c in CATEGORY_COUNTS},
    }
    return outcomes.groupBy(*keys).agg(*[v.alias(n) for n, v in aggs.items()])
