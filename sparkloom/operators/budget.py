"""How many questions of each category a chunk should get."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T


@dataclass(frozen=True)
class Category:
    min_questions: int = 0
    weight: float = 1.0


@dataclass(frozen=True)
class Budget:
    """categories: minimum and weight of each; ignore_categories: count as if all were 0 and 1."""

    categories: dict[str, Category] = field(default_factory=lambda: {"factual": Category(2, 1.0), "inferential": Category(2, 1.2), "conceptual": Category(1, 1.5)})
    max_questions: int = 10
    adaptive: bool = True
    ignore_categories: bool = False

    def of(self, name: str) -> Category:
        return Category() if self.ignore_categories else self.categories[name]


def allocate(chunks: DataFrame, budget: Budget = Budget(), key: str = "chunk_id") -> DataFrame:
    """(key, density, <category> yields) to (key, category, n)."""
    return T.each(with_counts(chunks, budget, "__counts"), [key], "__counts", "x").select(key, "x.category", "x.n")


def with_counts(chunks: DataFrame, budget: Budget = Budget(), name: str = "counts") -> DataFrame:
    """chunks (with density and <category> yields) with an array of (category, n).

    A yield is raised to the category's minimum, scaled by density and weight (half to even), scaled down to the cap,
    and what still exceeds the cap is taken from the categories with the least weight, then count, then name, never
    below the minimum. All within a row: no shuffle.
    """
    names = list(budget.categories)
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.lit(1.0) + (F.col("density") - 0.5)))
    cap, df = F.lit(budget.max_questions), chunks
    least = {c: max(0, budget.of(c).min_questions) for c in names}
    for c in names:
        n = F.greatest(F.lit(least[c]), F.coalesce(F.col(c), F.lit(0)))
        if budget.adaptive:
            n = F.greatest(F.lit(least[c]), F.bround(n * factor * F.lit(budget.of(c).weight), 0).cast("int"))
        df = df.withColumn(f"__{c}", n)
    total = sum((F.col(f"__{c}") for c in names), F.lit(0))
    df = df.withColumn("__total", total)
    for c in names:
        scaled = F.greatest(F.lit(least[c]), F.bround(F.col(f"__{c}") * cap.cast("double") / F.col("__total"), 0).cast("int"))
        df = df.withColumn(f"__{c}", F.when(F.col("__total") > cap, scaled).otherwise(F.col(f"__{c}")))
    rows = F.array_sort(F.array(*[F.struct(F.lit(float(budget.of(c).weight)).alias("w"), F.col(f"__{c}").alias("n"), F.lit(c).alias("category"), F.lit(least[c]).alias("least")) for c in names]))
    df = df.withColumn("__rows", rows)
    excess = F.greatest(F.lit(0), F.aggregate("__rows", F.lit(0), lambda a, r: a + r["n"]) - cap)
    taken = F.aggregate(
        "__rows",
        F.struct(excess.alias("left"), F.expr("cast(array() as array<struct<category:string,n:int>>)").alias("out")),
        lambda s, r: F.struct(
            (s["left"] - F.least(s["left"], r["n"] - r["least"])).alias("left"),
            F.array_append(s["out"], F.struct(r["category"].alias("category"), (r["n"] - F.least(s["left"], r["n"] - r["least"])).alias("n"))).alias("out"),
        ),
    )
    return df.select(*chunks.columns, taken["out"].alias(name))
