"""Mixing sources to target weights by hierarchical budgeting.

Weights sit on a tree of domain, language and source. Budgets go down from the root: a node's budget is split
among its children in proportion to weight, each child up to what its leaves can give (tokens x epochs). What a
short child can't take goes to its siblings in proportion to their weights, and only what no sibling can take
leaves the node for its ancestors' other children. The split has a closed form over children sorted by
capacity / weight, so it is three window queries over small tables of tree nodes.

Each leaf's documents have a seeded order for every epoch. A leaf of N tokens and budget B is read B // N times
whole, and the next epoch's order is cut after the longest prefix of at most B % N tokens. The cut is a key: the
4096 ranges of the order are summed first, and only the range in which the prefix ends is sorted, so a hot
leaf is never sorted in one task. Documents are then chosen by comparing keys with their leaf's row.

The leaf of a row is its own domain, lang and source. The documents table has no domain column: there, and only there,
the domain follows from the number at the end of the source's name (DOMAINS in turn; 'other' without a number).

Nulls and odd input: a null domain, lang or source counts as 'unknown'; one of another type counts by its text. A null, empty or white text has no
tokens and is never chosen. A null doc_id has the order of the word 'null'. Repeated rows and equal ids tie: all
or none of them are in a prefix. Rows of an unnamed branch have weight DEFAULT_WEIGHT; weight 0 takes nothing.
Sums are whole tokens, rounded down, so a node may stay one token a child below its budget. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize

LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHT = 1
#: Whole numbers, by level and by the node's path.
WEIGHTS = {"web": 4, "books": 3, "news": 2, "reference": 2, "web/en": 6, "books/en": 6, "news/en": 6, "reference/en": 6, "web/de": 2, "web/fr": 2, "books/de": 2, "books/fr": 2, "news/de": 2, "news/fr": 2}
SEED, EPOCHS, RATIO = 17, 2, 1.0
#: Leaf rows up to this many are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000

DOMAINS = ("web", "books", "news", "reference")


def token_count(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _leaf_columns(docs: DataFrame) -> list[Column]:
    """The tree's path of each row; without a domain column, the domain is made from the number at the source's end."""
    domain = F.expr(f"case when regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' then 'other' else element_at(array({', '.join(map(repr, DOMAINS))}), pmod(cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 4) + 1) end")
    own = F.col("domain").cast("string") if "domain" in docs.columns else domain
    named = lambda c: F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("unknown"))
    return [named(own).alias("domain"), *(named(c).alias(c) for c in ("lang", "source"))]


def _key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def split(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes with the parent's `budget`, own `weight` and `capacity` (order by `name`), to the same with `alloc`."""
    over = f"(partition by {', '.join(parent) or '1'} order by capacity / weight, name"
    rows = nodes.where("weight > 0").selectExpr(
        "*",
        f"coalesce(sum(capacity) over {over} rows between unbounded preceding and 1 preceding), 0) as cap_before",
        f"sum(weight) over {over} rows between current row and unbounded following) as weight_from",
    )
    # a child is full if, once it and all before it are, the rest's share reaches its ratio
    rows = rows.withColumn("full", F.expr("(cast(budget as decimal(38,0)) - cap_before) * weight >= cast(capacity as decimal(38,0)) * weight_from"))
    rows = rows.selectExpr("*", f"coalesce(sum(case when full then capacity end) over (partition by {', '.join(parent) or '1'}), 0) as cap_full", f"coalesce(sum(case when not full then weight end) over (partition by {', '.join(parent) or '1'}), 0) as weight_open")
    return rows.withColumn("alloc", F.expr("case when full then capacity else cast(floor((cast(budget as decimal(38,0)) - cap_full) * weight / weight_open) as bigint) end")).drop("cap_before", "weight_from", "full", "cap_full", "weight_open")


def _weights(paths: Column, weights: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,int>")
    return F.coalesce(F.try_element_at(table, paths), F.lit(DEFAULT_WEIGHT)).cast("bigint")


def budgets(leaves: DataFrame, total: int, weights: dict[str, int], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) to the same with alloc, the tokens each may give."""
    caps = leaves.withColumn("capacity", F.col("tokens") * epochs)
    root = caps.groupBy("domain").agg(F.sum("capacity").alias("capacity")).select("*", F.lit(total).cast("bigint").alias("budget"), _weights(F.col("domain"), weights).alias("weight"), F.col("domain").alias("name"))
    top = split(root, []).select("domain", F.col("alloc").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain").select("*", _weights(F.concat_ws("/", "domain", "lang"), weights).alias("weight"), F.col("lang").alias("name"))
    mids = split(mid, ["domain"]).select("domain", "lang", F.col("alloc").alias("budget"))
    low = caps.join(mids, ["domain", "lang"]).select("*", _weights(F.concat_ws("/", *LEVELS), weights).alias("weight"), F.col("source").alias("name"))
    return split(low, ["domain", "lang"]).select(*LEVELS, "tokens", "alloc")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan(docs: DataFrame, ratio: float = RATIO, epochs: int = EPOCHS, weights: dict[str, int] | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' index (doc_id, leaf, tokens) and the leaves' plan (leaf, whole epochs, last key of the next)."""
    weights = WEIGHTS if weights is None else weights
    index = materialize(docs.select("doc_id", *_leaf_columns(docs), token_count(F.col("text")).alias("tokens")).where("tokens > 0"), "index")
    leaves = index.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = materialize(leaves, "leaves")
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    alloc = budgets(leaves, int(everything * ratio), weights, epochs).selectExpr(*LEVELS, "alloc div tokens as whole", "alloc % tokens as part")
    alloc = materialize(alloc, "alloc")
    keyed = index.join(_small(alloc.where("part > 0")), list(LEVELS)).select(*LEVELS, "part", "tokens", _key(F.col("whole"), seed).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "part", "range").agg(F.sum("tokens").alias("tokens"))
    leaf = ", ".join(LEVELS)
    run = materialize(sums.selectExpr(*LEVELS, "part", "range", "tokens", f"sum(tokens) over (partition by {leaf} order by range) as upto"), "ranges")
    edge = run.where("upto > part and upto - tokens <= part").selectExpr(*LEVELS, "range", "upto - tokens as before")
    inside = keyed.join(_small(edge), [*LEVELS, "range"]).selectExpr(*LEVELS, "key", "part - before as room", f"sum(tokens) over (partition by {leaf} order by key range between unbounded preceding and current row) as upto")
    # the last key taken: in the edge range if anything of it fits, else all of the ranges before it
    last = inside.where("upto <= room").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = alloc.join(edge, list(LEVELS), "left").join(last, list(LEVELS), "left").selectExpr(*LEVELS, "whole", "case when part = 0 then '' else coalesce(last, range, '') end as last")
    return index, materialize(cut, "cuts")


def chosen(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """rows with doc_id and leaf columns, once for each epoch in which they are chosen, with `epoch`."""
    both = rows.join(_small(cuts), list(LEVELS))
    times = F.col("whole") + F.when(_key(F.col("whole"), seed) <= F.col("last"), 1).otherwise(0)
    both = both.withColumn("__times", times).where("__times > 0")
    return both.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__times").cast("int") - 1))).drop("__times", "whole", "last")


def mix(docs: DataFrame, ratio: float = RATIO, epochs: int = EPOCHS, weights: dict[str, int] | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as many times as it is chosen, with their own columns."""
    _, cuts = plan(docs, ratio, epochs, weights, seed)
    own = docs.select("doc_id", *_leaf_columns(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).where(token_count(F.col("__row.text")) > 0)
    return chosen(own, cuts, seed).select("__row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The documents chosen, with their leaf, epoch and tokens."""
    index, cuts = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return chosen(index, cuts, SEED).select("doc_id", *LEVELS, F.col("epoch"), "tokens")


def _level_sql(name: str, parent: str, path: str, source: str) -> str:
    """One level's split, as in split()."""
    weight = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())
    over = f"({f'partition by {parent} ' if parent else ''}order by capacity / weight, {name}"
    whole = f"({f'partition by {parent}' if parent else ''})"
    return f"""
{name}_w as (select *, cast(case {path} {weight} else {DEFAULT_WEIGHT} end as bigint) as weight from {source}),
{name}_s as (select *, coalesce(sum(capacity) over {over} rows between unbounded preceding and 1 preceding), 0) as cap_before,
  sum(weight) over {over} rows between current row and unbounded following) as weight_from from {name}_w),
{name}_f as (select *, (budget::hugeint - cap_before) * weight >= capacity::hugeint * weight_from as is_full from {name}_s),
{name}_a as (select *, case when is_full then capacity else ((budget::hugeint - coalesce(sum(case when is_full then capacity end) over {whole}, 0)) * weight)
  // coalesce(sum(case when not is_full then weight end) over {whole}, 0) end::bigint as alloc from {name}_f)"""


def _oracle() -> str:
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"
    domain = f"case when source is null then 'unknown' when {number} = '' then 'other' else (array[{', '.join(map(repr, DOMAINS))}])[({number}::int % 4) + 1] end"
    return f"""
with idx as (select doc_id, {domain} as domain, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
    coalesce(len(regexp_extract_all(text, '\\S+')), 0)::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::bigint * {EPOCHS} as capacity from idx where tokens > 0 group by all),
root as (select domain, sum(capacity)::bigint as capacity, (select sum(tokens)::bigint from leaves) as budget from leaves group by all),
{_level_sql('domain', '', 'domain', 'root')},
mid as (select l.domain, l.lang, sum(l.capacity)::bigint as capacity, any_value(d.alloc) as budget from leaves l join domain_a d using (domain) group by 1, 2),
{_level_sql('lang', 'domain', "concat(domain, '/', lang)", 'mid')},
low as (select l.domain, l.lang, l.source, l.tokens, l.capacity, a.alloc as budget from leaves l join lang_a a using (domain, lang)),
{_level_sql('source', 'domain, lang', "concat(domain, '/', lang, '/', source)", 'low')},
parts as (select domain, lang, source, alloc // tokens as whole, alloc % tokens as part from source_a),
keyed as (select i.*, p.whole, p.part, md5(concat_ws('/', '{SEED}', p.whole::varchar, coalesce(i.doc_id::varchar, 'null'))) as key from idx i join parts p using (domain, lang, source) where i.tokens > 0),
upto as (select *, sum(tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as upto from keyed),
times as (select *, whole + (upto <= part)::int as times from upto)
select doc_id, domain, lang, source, e::int as epoch, tokens from times, unnest(range(times)) as r(e)"""


ORACLE = _oracle()
