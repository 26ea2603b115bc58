"""Token-budgeted packing: prefix trimming as a window sum, and the greedy ladder of files and symbols per query."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Shares of a budget and limits of the ladder.
RESERVE_SHARE, RESERVE_MOST, LEFT_OVER = 0.25, 3000, 20
ARCHITECTURE_SHARE, DEPENDENCY_SHARE = 0.15, 0.06


@dataclass(frozen=True)
class Budget:
    tokens: int = 12_000
    file_tokens: int = 2000
    symbol_tokens: int = 800

    @property
    def reserve(self) -> int:
        return min(int(self.tokens * RESERVE_SHARE), RESERVE_MOST)

    @property
    def content(self) -> int:
        return self.tokens - self.reserve


def trim(lines: DataFrame, budget: int, *keys: str) -> DataFrame:
    """Lines (keys, i, tokens) up to the first that overflows the budget.

    Of the lines with tokens only the first budget + 1 of a key can matter, which a limit per key keeps before the
    shuffle, so a key with very many lines is not sorted whole; they tell where the key is cut.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    first = lines.where("tokens > 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(budget, 0) + 1)
    cut = first.withColumn("_u", F.sum("tokens").over(running)).where(F.col("_u") > budget).groupBy(*keys).agg(F.min("i").alias("_cut"))
    kept = lines.join(cut, list(keys), "left").where(F.col("_cut").isNull() | (F.col("i") < F.col("_cut"))).drop("_cut")
    return kept.withColumn("used", F.sum("tokens").over(running)).where(F.col("used") <= budget)


def ladder(items: list[dict], budget: Budget) -> list[tuple[int, str, int]]:
    """(rank, form, tokens) of the packed items of one query, in rank order.

    An item has rank, id, file, is_file, full, card, mention (tokens of each form; null where it has none) and
    parent. What fits in no form is dropped and the next one is tried.
    """
    left, out = budget.content, []
    whole: set[str] = set()
    coded: set[str] = set()
    inside: set[str] = set()
    for item in sorted(items, key=lambda x: (x["rank"], x["id"])):
        if left <= LEFT_OVER:
            break
        if item["is_file"]:
            if item["file"] in whole or item["id"] in inside:
                continue
            forms = [("full", item["full"], budget.file_tokens if item["file"] not in coded else -1), ("compressed", item["card"], budget.tokens), ("mention", item["mention"], budget.tokens)]
        else:
            if item["file"] in whole or item["id"] in inside or item.get("parent") in inside:
                continue
            forms = [("code", item["full"], budget.symbol_tokens), ("card", item["card"], budget.tokens)]
        for form, cost, most in forms:
            if cost is not None and cost <= min(most, left):
                left -= cost
                inside.add(item["id"])
                if form == "full":
                    whole.add(item["file"])
                if form == "code":
                    coded.add(item["file"])
                out.append((item["rank"], form, cost))
                break
    return out


def pack(ranked: DataFrame, budget: Budget | None = None) -> DataFrame:
    """ranked (query_id, rank, id, file, is_file, parent, full, card, mention) -> (query_id, rank, form, tokens).

    One group per query; a query has at most its result limit of rows.
    """
    budget = budget or Budget()
    query = dict(ranked.dtypes)["query_id"]

    def run(key, table):
        got = ladder(table.to_pylist(), budget)
        ids = pa.array([key[0].as_py()] * len(got), table.schema.field("query_id").type)
        return pa.table([ids, pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], names=["query_id", "rank", "form", "tokens"])

    return ranked.groupBy("query_id").applyInArrow(run, f"query_id {query}, rank int, form string, tokens long")


def fit(sections: dict[str, list[str]], budget: int, cost) -> dict[str, list[str]]:
    """Drop recommendations, then summary lines from the end, until all sections fit the budget."""
    out = {k: list(v) for k, v in sections.items()}
    for name in ("recommendations", "summary", "dependencies", "architecture"):
        while out.get(name) and sum(cost(x) for lines in out.values() for x in lines) > budget:
            out[name].pop()
    return out
