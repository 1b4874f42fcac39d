"""Interaction of filters: what each removes in any order, and its fair share.

Removal is a cooperative game.  Its players are the filters, and a coalition is worth
the documents that fail at least one of its filters.  The Hart-Mas-Colell potential

    P(empty) = 0,   P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|

gives every filter its Shapley value as P(all) - P(all without it).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.session import written

#: All orders of the filters are listed, so their number is limited.
MAX_FILTERS = 7


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text without nulls: A few words, B repetitive, C loud, D symbols."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def failure_cells(docs: DataFrame, failures: Mapping[str, Column], copies: str | None = None, part: str = "lang",
                  labels: DataFrame | None = None) -> DataFrame:
    """(part, fails, docs, good, toxic): documents per part and set of failed filters,
    the filters numbered as in ``filter_names``, one bit each.

    ``failures`` are conditions over ``docs`` with the null texts made empty.  The
    filter ``copies``, if asked for, fails a document whose text is that of a document
    with a smaller doc_id; one without doc_id never fails it and is nobody's original.
    A document is good (toxic) if a row of ``labels`` with its doc_id has quality
    (toxic) 1; a null doc_id has no labels.  A null part is an empty string; repeated rows all count.

    Texts leave the scan as digests.  A group of copies is never gathered: all its
    documents but the first are counted as failing, which takes the total of all rows
    and one first row per digest and part, both combined before they are shuffled.
    """
    names = filter_names(failures, copies)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    fails = sum((F.when(failures[name], F.lit(1 << k)).otherwise(0) for k, name in enumerate(names) if name in failures),
                F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), fails.alias("fails"),
                       F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    flags = {"good": F.lit(False), "toxic": F.lit(False)}
    if labels is not None:
        known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            *(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(flag) for flag, c in (("good", "quality"), ("toxic", "toxic"))))
        # Null ids meet no label; a key of their own spares the join one hot task.
        named = rows.where("doc_id IS NOT NULL").join(known.where("good OR toxic"), "doc_id", "left")
        rows = named.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
        flags = {flag: F.coalesce(flag, F.lit(False)) for flag in flags}
    rows = written(rows.withColumns(flags), "audit-rows")

    kind = ["part", "fails", "good", "toxic"]
    counts = rows.groupBy(*kind).agg(F.sum("n").alias("n"))
    if copies is not None:
        failed = F.col("fails").bitwiseOR(F.lit(1 << names.index(copies))).alias("fails")
        named = rows.where("doc_id IS NOT NULL")
        first = named.groupBy("digest", *kind).agg(F.min(F.struct("doc_id", "n")).alias("least"))
        origin = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row per part at most
        first = first.withColumn("origin", origin).where("least.doc_id = origin").select(*kind, "least.n")
        counts = named.groupBy(*kind).agg(F.sum("n").alias("n")).select("part", failed, "good", "toxic", "n").unionByName(
            first.select("part", failed, "good", "toxic", (-F.col("n")).alias("n"))).unionByName(first).unionByName(
            rows.where("doc_id IS NULL").select(*kind, "n"))
    return counts.groupBy("part", "fails").agg(F.sum("n").alias("docs"), *(
        F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag) for flag in ("good", "toxic")))


def filter_names(failures: Mapping[str, Column], copies: str | None = None) -> list[str]:
    names = sorted({*failures, *([] if copies is None else [copies])})
    if not 1 <= len(names) <= MAX_FILTERS or any(len(name) != 1 for name in names):
        raise ValueError(f"one to {MAX_FILTERS} filters with names of one character")
    return names


def potentials(worth: str, k: int) -> Column:
    """The potentials of the 2**k coalitions in the order of their bits, times k!, which
    makes them whole numbers: ``worth`` is an expression for the worth of coalition s.

    A coalition stands behind all its subsets, so one pass in that order is the
    recursion."""
    without = f"aggregate(sequence(0, {k - 1}), 0L, (t, i) -> t + if(s & shiftleft(1, i) <> 0, p[s ^ shiftleft(1, i)], 0L))"
    return F.expr(f"aggregate(sequence(1, {2 ** k - 1}), array(0L), (p, s) -> concat(p, array("
                  f"({worth} * {factorial(k)}L + {without}) div bit_count(s))))")


def interactions(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, filter,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the removals
    of the step's filter over all orders).  ``cells`` is as ``failure_cells`` gives it;
    a part has at most 2**k cells, and only these are gathered."""
    k, full = len(names), 2 ** len(names) - 1
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "docs", "good", "toxic")).alias("cells"))

    def worth(c: str) -> Column:
        return F.expr(f"transform(sequence(0, {full}), s -> aggregate(cells, 0L, (t, x) -> "
                      f"t + if(x.fails & s <> 0, x.{c}, 0L)))")

    games = parts.select("part", *(worth(c).alias(c) for c in ("docs", "good", "toxic")), F.expr(
        "aggregate(cells, 0L, (t, x) -> t + x.docs)").alias("total"))
    games = games.withColumn("potential", potentials("docs[s]", k))
    steps, bit = [], {name: 1 << i for i, name in enumerate(names)}
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "filter": name, "before": before,
                          "bit": bit[name], "after": before | bit[name]})
            before |= bit[name]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,before:int,bit:int,after:int>>")
    rows = games.withColumn("at", F.explode(listed)).select("part", "at.*", "docs", "good", "toxic", "total", "potential")
    return rows.selectExpr(
        "part", "filter_order", "step", "total - docs[after] AS kept", "docs[after] - docs[before] AS removed",
        "docs[bit] - docs[after] + docs[before] AS redundant", f"docs[{full}] - docs[{full} ^ bit] AS unique_fails",
        "good[after] - good[before] AS good_lost", "toxic[after] - toxic[before] AS toxic_lost",
        f"potential[{full}] - potential[{full} ^ bit] AS shapley", "filter")


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, failures: Mapping[str, Column] | None = None,
                 copies: str | None = "E", part: str = "lang") -> DataFrame:
    """``interactions`` of the filters over all of ``docs`` (doc_id, text, ``part`` and
    whatever the conditions name; other columns play no part), see ``failure_cells`` for
    nulls and repeated rows.  Without documents there is no part and no row; a part
    whose documents all pass has rows of zeros."""
    failures = text_failures(F.col("text")) if failures is None else failures
    return interactions(failure_cells(docs, failures, copies, part, labels), filter_names(failures, copies))
