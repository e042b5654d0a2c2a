"""Splits that keep related records together.

Records that share any of the given keys (directly or through other records) form a component;
components come from Hash-to-Min. Components are assigned to splits by weighted rendezvous hashing: every
split has the score ``-weight / ln(u)`` with ``u`` hashed from component and split, and the highest wins.

Hashing alone reaches the proportions only in expectation, and a component that holds a third of its class
moves the class's shares with it. So the components that hold more than ``LARGE`` of their class (at most
``1 / LARGE`` of them, whatever the size of the table) are placed first, the largest one first, each in the split
that lacks most records, equal ones by the score. The others are hashed with what each split then lacks as its
weight. What is left of a deviation is what the largest components force and about
``sqrt(LARGE) / 2`` of a class at most from the hashing.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import hash_to_min
from docloom.llm.unit import unit
from docloom.session import materialize

#: Share of its class above which a component is placed by what the splits lack.
LARGE = 1 / 1000


def components(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``component``: rows that share a value of one of the string columns ``keys``, closed under chains.

    A null value is no key. A row without any key is a component of its own with its equals
    (named after a hash of the row). The first key is the anchor: other keys that occur with a
    single anchor value simply belong to it and never enter the graph, so a value which a third of
    all rows share costs one node and a partial aggregate.
    """
    named = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    own = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))), 256))
    first = F.coalesce(*named, own)
    links = df.select(first.alias("x"), F.explode(F.array_compact(F.array(*named, first))).alias("y")).distinct()
    links = materialize(links, "links")
    owner = links.groupBy("y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A y with one x hangs on it; the graph is what is left, in both roles.
    graph = links.join(owner.where("lo <> hi").select("y"), "y", "left_semi").select("x", "y")
    found = hash_to_min(graph, "x", "y")
    anchor = owner.select("y", F.col("lo").alias("x"))
    # Of x that hang on another key themselves, y = x is in the graph only if they are shared.
    placed = anchor.join(found.select(F.col("node").alias("x"), "component"), "x", "left").select("y", F.coalesce("component", "x").alias("component"))
    row_key = "__row_key"
    # Rows are joined by their last key, which is the most selective one.
    keyed = df.withColumn(row_key, F.coalesce(*named[::-1], own))
    return keyed.join(placed.select(F.col("y").alias(row_key), "component"), row_key).drop(row_key)


def rendezvous(component: Column, weights: dict[str, Column | float], salt: str) -> Column:
    """The split of a component; a weight that is not positive never wins against one that is. Ties
    (practically impossible) go to the first name in order."""
    scores = []
    for name, weight in sorted(weights.items()):
        u = unit(salt, component, name) + F.lit(2.0**-53)
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        scores.append(F.struct((w / -F.log(u)).alias("score"), F.lit(name).alias("name")))
    best = F.aggregate(F.array(*scores), scores[0], lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return best["name"]


def _place_large(names: list[str]):
    """Large components of one class, the largest first, each to the split that lacks most."""

    def run(tab: pa.Table) -> pa.Table:
        rows = sorted(zip(tab["n"].to_pylist(), tab["component"].to_pylist(), *(tab[f"w{i}"].to_pylist() for i in range(len(names)))), key=lambda r: (-r[0], r[1]))
        lacks = [rows[0][2 + i] * tab["total"][0].as_py() for i in range(len(names))]
        chosen = []
        for n, component, *_ in rows:
            tie = [xxhash.xxh3_64_intdigest(f"{component}|{name}") for name in names]
            best = max(range(len(names)), key=lambda i: (lacks[i], tie[i]))
            lacks[best] -= n
            chosen.append((component, names[best], n))
        return pa.table({"component": [c for c, _, _ in chosen], "assigned_split": [s for _, s, _ in chosen], "n": pa.array([n for _, _, n in chosen], pa.int64()), "c": pa.array([tab["c"][0].as_py()] * len(chosen), pa.string())})

    return run


def assign_splits(df: DataFrame, keys: list[str], class_key: str, proportions: dict[str, float], by_class: dict[str, dict[str, float]] | None = None, salt: str = "split") -> DataFrame:
    """``df`` with ``component``, ``component_class`` and ``assigned_split``.

    ``proportions`` hold for every class (column ``class_key``), ``by_class`` overrides them. The
    class of a component is the one most of its rows have (the smallest of equals; null counts
    as a class of its own). Proportions must be positive; they need not sum to one. Shares are
    counted in rows of ``df``, so repeated rows should be removed before.
    """
    placed = materialize(components(df, keys), "components")
    counts = placed.groupBy("component", F.col(class_key).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("c").alias("c"))).alias("m"), F.sum("n").alias("n")).select("component", F.col("m.c").alias("c"), "n")
    main = materialize(main, "component-classes")
    names = sorted({*proportions, *(s for own in (by_class or {}).values() for s in own)})

    def shares(p: dict[str, float]) -> list[Column]:
        return [F.lit(p.get(name, 0.0) / sum(p.values())) for name in names]

    weight = shares(proportions)
    for name, own in (by_class or {}).items():
        weight = [F.when(F.col("c") == name, w).otherwise(old) for w, old in zip(shares(own), weight)]
    totals = main.groupBy("c").agg(F.sum("n").alias("total")).select(F.col("c").alias("k"), "total", *(w.alias(f"w{i}") for i, w in enumerate(weight)))
    sized = main.join(totals, F.col("c").eqNullSafe(F.col("k"))).drop("k")
    large = F.col("n") > F.col("total") * LARGE
    fixed = materialize(sized.where(large).groupBy("c").applyInArrow(_place_large(names), "component string, assigned_split string, n long, c string"), "large-components")
    used = fixed.groupBy(F.col("c").alias("k")).agg(*(F.sum(F.when(F.col("assigned_split") == name, F.col("n")).otherwise(0)).alias(f"u{i}") for i, name in enumerate(names)))
    rest = sized.where(~large).join(used, F.col("c").eqNullSafe(F.col("k")), "left")
    lacks = {name: F.greatest(F.col(f"w{i}") * F.col("total") - F.coalesce(f"u{i}", F.lit(0)), F.lit(0.0)) for i, name in enumerate(names)}
    hashed = rest.select("component", rendezvous(F.col("component"), lacks, salt).alias("assigned_split"))
    decided = fixed.select("component", "assigned_split").unionByName(hashed).join(main.select("component", F.col("c").alias("component_class")), "component")
    return placed.join(decided, "component")


def conflicting(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """The rows with a split of those components (see ``components``) whose rows have more than one split."""
    rows = materialize(components(df, keys).where(F.col(split).isNotNull()), "components")
    bad = rows.groupBy("component").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select("component")
    return rows.join(bad, "component", "left_semi")
