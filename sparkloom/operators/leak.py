"""Questions and answers that refer to their source: DROP, FLAG or PASS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


_WHICH = "(?:the|this) "
_PLAIN = _any("document excerpt passage text")
_CONTAINER = _any("article author chapter content document excerpt material passage reading source text")
_SUBJECT = _any("article author chapter document excerpt passage reading section source text")
_SAYS = _any("argues? asserts? claims? concludes? contends? describes? discuss(?:es)? explains? indicates? mentions? notes? observes? posits? reports? says? shows? states? suggests?")
_WRITES = _any("argues? asserts? claims? concludes? contends? describes? explains? mentions? notes? observes? posits? says? states? suggests? writes?")
_POINTED = _any("defined described discussed explained mentioned noted outlined shown stated")
_TOLD = _any("defined described discussed mentioned noted outlined referenced stated")

DROP = (
    rf"\baccording to {_WHICH}{_CONTAINER}\b",
    rf"\b{_WHICH}{_SUBJECT} {_SAYS}\b",
    rf"\bas {_POINTED} (?:{_any('above below earlier here previously')}|in {_WHICH}{_any('article chapter document excerpt passage section text')})\b",
    rf"\bin {_WHICH}{_PLAIN}\b",
    rf"\b{_WHICH}authors?(?:'s)? {_WRITES}\b",
    rf"\b(?:based on|from|per) {_WHICH}{_any('article document excerpt passage reading text')}\b",
)
FLAG = (
    rf"\b{_any('are is was were')} {_TOLD}\b",
    rf"\bas {_any('described discussed mentioned noted stated')}\b",
    rf"\b{_any('all what which')} of the following\b",
    rf"\bthe {_any('above below following')}\b",
    rf"\bgiven {_WHICH}{_any('context document excerpt information passage text')}\b",
)


def _hits(c: Column, patterns: Sequence[str], label: str) -> Column:
    """The first hit of each pattern; no pattern matches nothing, so '' means none."""
    if not patterns:
        return F.array().cast("array<string>")
    found = F.filter(F.array(*[F.regexp_extract(c, f"(?i){p}", 0) for p in patterns]), lambda x: x != "")
    return F.transform(found, lambda x: F.concat(F.lit(f"{label}: '"), x, F.lit("'")))


def _hit(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def verdict(question: Column | str, answer: Column | str, enabled: bool = True, scan_answer: bool = True, drop: Sequence[str] = DROP, flag: Sequence[str] = FLAG) -> Column:
    """'drop', 'flag' or 'pass'; drop wins. The answer is scanned for drop patterns only. Null counts as ''."""
    q, a = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (question, answer))
    if not enabled:
        return F.lit("pass")
    dropped = _hit(q, drop) | _hit(a, drop) if scan_answer else _hit(q, drop)
    return F.when(dropped, "drop").when(_hit(q, flag), "flag").otherwise("pass")


def matches(question: Column | str, answer: Column | str, drop: Sequence[str] = DROP, flag: Sequence[str] = FLAG) -> Column:
    """What was found, of the tier that decided: "question: '…'" or "answer: '…'", the first hit of each pattern."""
    q, a = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (question, answer))
    return F.when(_hit(q, drop) | _hit(a, drop), F.concat(_hits(q, drop, "question"), _hits(a, drop, "answer"))).otherwise(_hits(q, flag, "question"))


def leak(question: Column | str, answer: Column | str, enabled: bool = True, scan_answer: bool = True, drop: Sequence[str] = DROP, flag: Sequence[str] = FLAG) -> Column:
    """Struct of action, matches and reason; each pattern runs over each text once."""
    q, a = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (question, answer))
    none = F.array().cast("array<string>")
    if not enabled:
        return F.struct(F.lit("pass").alias("action"), none.alias("matches"), F.lit(None).cast("string").alias("reason"))

    def told(d: Column) -> Column:
        def with_flags(f: Column) -> Column:
            return F.struct(
                F.when(F.size(d) > 0, "drop").when(F.size(f) > 0, "flag").otherwise("pass").alias("action"),
                F.when(F.size(d) > 0, d).otherwise(f).alias("matches"),
                F.when(F.size(d) > 0, F.concat(F.lit("refers to its source: "), F.array_join(d, ", "))).when(F.size(f) > 0, F.concat(F.lit("may refer to its source: "), F.array_join(f, ", "))).alias("reason"),
            )

        return T.let(F.when(F.size(d) > 0, none).otherwise(_hits(q, flag, "question")), with_flags)

    return T.let(F.concat(_hits(q, drop, "question"), _hits(a, drop, "answer") if scan_answer else none), told)
