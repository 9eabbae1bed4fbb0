"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What str.strip and str.split take for white space.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same, one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LETTER = r"[\p{L}\p{N}_]"
_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once for each row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(df: DataFrame, keys: list[str], items: Column | str, item: str = "x", pos: str = "pos") -> DataFrame:
    """(keys, pos, item): an array's items by row. Null and empty arrays have none.

    An outer generator with a filter after it: before an inner one the optimizer would put a filter that works out the
    array again, twice, and at the scan.
    """
    return df.select(*keys, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(_col(c), F.lit(SPACES))


def strip_part(c: Column) -> Column:
    """strip() for a lambda's variable: most lines have no white space at their ends, and only ends are looked at."""
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(WS), strip(c)).otherwise(c)


def lines(c: Column | str) -> Column:
    """Lines by every Unicode line break; a final break makes no empty line."""
    def cut(t: Column) -> Column:
        return F.split(F.when(F.right(t, F.lit(1)).rlike(_BREAK), F.left(t, F.char_length(t) - 1)).otherwise(t), _BREAK)

    return let(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), cut)


def tokens(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_col(c), rf"{WS}+"), lambda w: w != "")


def normalize_whitespace(c: Column | str) -> Column:
    """One space for runs of spaces and tabs, at most one blank line, lines stripped, one final newline; '' stays ''."""
    c = _col(c)
    tight = F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
    return F.when(c == "", "").otherwise(F.concat(strip(F.array_join(F.transform(lines(tight), strip_part), "\n")), F.lit("\n")))


#: Wrongly decoded punctuation and what it stands for, in the order of replacement.
MOJIBAKE = {"\u00c2\u00a0": " ", "\u00e2\u0080\u0099": "'", "\u00e2\u0080\u0098": "'", "\u00e2\u0080\u009c": '"', "\u00e2\u0080\u009d": '"', "\u00e2\u0080\u0093": "-", "\u00e2\u0080\u0094": "--", "\u00e2\u0080\u00a6": "...", "\ufeff": ""}


def fix_encoding(c: Column | str) -> Column:
    def fixed(t: Column) -> Column:
        out, any_ = t, F.lit(False)
        for bad, good in MOJIBAKE.items():
            out = F.replace(out, F.lit(bad), F.lit(good))
        for first in sorted({bad[0] for bad in MOJIBAKE}):
            any_ = any_ | t.contains(first)
        return F.when(any_, out).otherwise(t)

    return let(_col(c), fixed)


def standardize_bullets(c: Column | str) -> Column:
    """Bulleted and numbered lines begin with '* ', indented as before, their text stripped."""
    marked = F.regexp_replace(_col(c), "(?m)^([ \t]*)(?:[•*\\-+◦○●■□▪▫]|\\d+\\.)[ \t]+(.*)", "$1\u0001* $2")
    tidy = F.regexp_replace(marked, r"\x01\* [ \t]*([^\n]*?)[ \t]*(?=\n|\z)", "\u0001* $1")
    return F.replace(tidy, F.lit("\u0001"), F.lit(""))


def reflow(c: Column | str) -> Column:
    """Join lines of one paragraph.

    A line ends its paragraph line if it closes like a sentence, is a list item, or the next line begins upper-case
    or is blank; any other is followed by a space. So a line's separator depends on it and its successor only,
    and one pass over the lines does it.
    """

    def part(p: Column) -> Column:
        line, nxt = p["line"], p["next"]
        ends = line.rlike(r"[.!?\"'>]\z") | line.startswith("* ") | nxt.rlike(r"^\p{Lu}") | (line == "") | (nxt == "")
        return F.concat(line, F.when(nxt.isNull(), "").when(ends, "\n").otherwise(" "))

    def whole(rows: Column) -> Column:
        after = F.slice(rows, F.lit(2), F.size(rows))
        return F.array_join(F.transform(F.arrays_zip(rows.alias("line"), after.alias("next")), part), "")

    return let(F.transform(F.split(_col(c), "\n"), strip_part), whole)


def preprocess(c: Column | str, whitespace: bool = True, encoding: bool = True, formatting: bool = True) -> Column:
    """The configured normalisations in their order."""
    c = _col(c)
    c = normalize_whitespace(c) if whitespace else c
    c = fix_encoding(c) if encoding else c
    return reflow(standardize_bullets(c)) if formatting else c


def text_stats(c: Column | str) -> Column:
    """Struct of char_count, word_count, sentence_count (pieces between stops) and avg_word_length; null for ''."""
    c = _col(c)

    def stats(t: Column) -> Column:
        letters = F.aggregate(t, F.lit(0), lambda a, w: a + F.char_length(w))
        return F.struct(
            F.char_length(c).alias("char_count"),
            F.size(t).alias("word_count"),
            F.size(F.split(c, "[.!?]+")).alias("sentence_count"),
            (letters / F.greatest(F.size(t), F.lit(1))).alias("avg_word_length"),
        )

    return F.when(c != "", let(tokens(c), stats))


def sentences(c: Column | str) -> Column:
    """Split after . ? ! and white space, but not within abbreviations such as 'e.g.' or 'Dr.'."""
    parts = F.split(_col(c), r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=[.?!])\s")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({_LETTER}+)"), 1)


#: Words that say nothing about a text's topic.
STOP_WORDS = tuple("a about above after again against all an and any as at because before below between both but by can down during each few for from further here how if in into just more most no nor not now of off on once only or other out over own same should so some such than the then there through to too under until up very when where while why will with".split())
#: Words left out when questions are compared.
DIVERSITY_WORDS = tuple("a about an and are as at but by for from he how i in is it of on or she the they to was we were what when where which who whom whose why with you".split())


def keyword_counts(c: Column | str) -> Column:
    """Array of (word, cnt, first): a text's words that aren't stop words, how often each stands in it and where first."""
    found = F.filter(F.transform(words(c), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: ~x["word"].isin(*STOP_WORDS))

    def runs(s: Column) -> Column:
        def begin(x: Column, i: Column) -> Column:
            return F.when((i == 0) | (F.get(s, i - 1)["word"] != x["word"]), F.struct(x["word"].alias("word"), x["pos"].alias("first"), i.alias("at")))

        def count(b: Column) -> Column:
            return F.transform(b, lambda z, i: F.struct(z["word"].alias("word"), (F.coalesce(F.get(b, i + 1)["at"], F.size(s)) - z["at"]).cast("bigint").alias("cnt"), z["first"].alias("first")))

        return let(F.array_compact(F.transform(s, begin)), count)

    return let(F.sort_array(found), runs)


#: Up to so many repeated keys are sent to all tasks.
FEW = 100_000


def keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """(key, word, cnt, rank): the k most frequent words that aren't stop words, ties by first occurrence.

    A row's words are counted in the row. Only rows that share their key with others are brought together, with the
    counts of each; which ones is found by shuffling keys.
    """
    shared = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__key"))
    n = shared.limit(FEW + 1).count()

    def top(rows: DataFrame) -> DataFrame:
        ranked = let(F.sort_array(F.transform(keyword_counts(text), lambda x: F.struct((-x["cnt"]).alias("less"), x["first"].alias("first"), x["word"].alias("word")))), lambda s: F.slice(s, 1, int(k)))
        return each(rows, [key], ranked, "x").select(key, "x.word", (-F.col("x.less")).alias("cnt"), (F.col("pos") + 1).alias("rank"))

    if not n:
        return top(docs)
    shared = F.broadcast(shared) if n <= FEW else shared
    same = F.col(key).eqNullSafe(F.col("__key"))
    found = each(docs.join(shared, same, "left_semi"), [key], keyword_counts(text), "x")
    counted = found.groupBy(key, "x.word").agg(F.sum("x.cnt").alias("cnt"), F.min("x.first").alias("first"))
    ranked = counted.selectExpr(f"`{key}`", "word", "cnt", f"row_number() over (partition by `{key}` order by cnt desc, first) as rank").where(f"rank <= {int(k)}")
    return top(docs.join(shared, same, "left_anti")).unionByName(ranked)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common words; 0 if either has none."""

    def share(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    return let(F.array_distinct(words(a)), lambda x: let(F.array_distinct(words(b)), lambda y: share(x, y)))


def reading_time(n_words: Column | str) -> Column:
    """Seconds at 225 words a minute."""
    return F.floor(_col(n_words) / 3.75).cast("int")


def boundaries(c: Column | str) -> Column:
    """Array of (start, end) of the parts between blank lines that aren't blank."""
    parts = F.split(_col(c), "\n\n")
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p) + 2).alias("at"),
            F.when(strip(p) == "", s["out"]).otherwise(F.array_append(s["out"], F.struct(s["at"].alias("start"), (s["at"] + F.char_length(p)).alias("end")))).alias("out"),
        ),
    )
    return step["out"]


def diversity_form(c: Column | str) -> Column:
    """Lower case, no punctuation, no filler words: what questions are compared by."""
    bare = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s]", "")
    return F.array_join(F.filter(tokens(bare), lambda w: ~w.isin(*DIVERSITY_WORDS)), " ")


def document_hash(path: Column | str, text: Column | str) -> Column:
    """16 hex digits of the SHA-256 of path and content."""
    return F.substring(F.sha2(F.concat(F.coalesce(_col(path), F.lit("")), F.lit("::"), F.coalesce(_col(text), F.lit(""))), 256), 1, 16)


def repair_json(c: Column | str) -> Column:
    """JSON without comments, trailing commas and what follows its last bracket. A '//' inside a string stays."""
    c = F.regexp_replace(_col(c), r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r"(?m)(?<![:\"\w])//[^\n]*$", "")
    c = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    return strip(F.regexp_replace(c, r"(?s)([}\]])[^}\]]*\z", "$1"))


def fenced(c: Column | str) -> Column:
    """The object in the first fenced block, or null."""
    found = F.regexp_extract(_col(c), r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(found, F.lit(""))


def unit_float(c: Column | str, default: float = 0.5) -> Column:
    """A number from text, held to 0..1; default if it is none."""
    return let(strip(_col(c).cast("string")).try_cast("double"), lambda x: F.when(x.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def count_int(c: Column | str) -> Column:
    """A whole number of at least 0 from text, fractions cut; 0 if it is none."""
    return F.coalesce(F.greatest(F.lit(0), _col(c).cast("string").try_cast("double").try_cast("int")), F.lit(0))


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"[^/]*\z", 0)


def preview(c: Column | str, n: int = 500) -> Column:
    """The first n characters, with '...' if there are more."""
    c = _col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def fill_template(template: str, **values: Column | str) -> Column:
    """A template's {name} places filled; {{ and }} are braces. A name without a value is an error."""
    out, rest, at = [], template.replace("{{", "\ue000").replace("}}", "\ue001"), 0

    def said(part: str) -> Column:
        return F.lit(part.replace("\ue000", "{").replace("\ue001", "}"))

    for m in re.finditer(r"\{(\w+)\}", rest):
        if m[1] not in values:
            raise KeyError(f"the template needs a value for {m[1]}")
        out += [said(rest[at : m.start()]), F.coalesce(_col(values[m[1]]).cast("string"), F.lit("N/A"))]
        at = m.end()
    return F.concat(*out, said(rest[at:]))
