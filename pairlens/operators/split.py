"""Leakage-free train / validation split over connected components of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage, stored
from pairlens.operators.joins import hot_from_counts, skew_join
from pairlens.operators.ordered import hash_prefix_sum


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
    return lowest.withColumn("m", F.least("m", "u"))


def _attach_minimum(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m) with m the smallest node among u and its neighbours; hubs are salted."""
    minima = _neighbour_minimum(edges)
    hot = hot_from_counts(minima, ["u"])
    return skew_join(edges, minima.drop("_rows"), ["u"], spread=F.col("v"), hot=hot, n_left=n_edges)


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Expects edges with u > v; links every larger neighbour of a node to its minimum."""
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.select(F.explode(F.array(there, back)).alias("e")).select("e.u", "e.v")
    linked = _attach_minimum(both, 2 * n_edges).filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Expects edges with u > v; links every smaller neighbour and u itself to the minimum."""
    neighbour = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    itself = F.struct(F.col("u"), F.col("m").alias("v"))
    linked = _attach_minimum(edges, n_edges).select(F.explode(F.array(neighbour, itself)).alias("e"))
    return linked.select("e.u", "e.v").filter("u > v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node either hangs on exactly one other or is hung on."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            )
        ).alias("e")
    ).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up + down > 1").isEmpty()


def component_of_edges(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (u, v) as (node, component).

    Alternating large-star and small-star rounds until only stars are left; every round ends in a
    table of the shared folder, so the plan stays short and a lost executor costs at most one
    round. The table of the round before is deleted then. The component is named after its smallest
    node. Nodes without edges do not appear.
    """
    current = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while not _is_star_forest(current.rows):
        n_edges = current.rows.count()  # from the footers of the table
        # A large star never adds edges, so the count still bounds the small star's input.
        after = stored(_small_star(_large_star(current.rows, n_edges), n_edges))
        current.discard()
        current = after
    roots = current.rows.select(F.col("v").alias("node")).distinct()
    return current.rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _value_key(column: str, id: str, nulls_connect: bool) -> Column:
    text = F.col(column).cast("string")
    missing = F.lit("null") if nulls_connect else F.concat(F.lit("row:"), F.col(id).cast("string"))
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), text), missing), 256))


def connected_components(
    df: DataFrame, columns: list[str], id: str = "row_id", nulls_connect: bool = True
) -> DataFrame:
    """(id, component) where rows sharing a value in any of the columns are together.

    Each value is represented by its smallest row id, so the graph has one node per value of
    the first column plus the representatives of the others, and only distinct links between
    representatives enter the iteration. The component is its smallest row id.
    """
    return _components(df, columns, id, nulls_connect)[0]


def _components(
    df: DataFrame, columns: list[str], id: str, nulls_connect: bool
) -> tuple[DataFrame, int]:
    keys = [f"_key{i}" for i in range(len(columns))]
    # Long values are read and hashed once; from here on rows are an id and 32-byte keys.
    rows = cut_lineage(
        df.select(id, *[_value_key(c, id, nulls_connect).alias(k) for c, k in zip(columns, keys)])
    )
    n = rows.count()
    for i, key in enumerate(keys):
        minima = rows.groupBy(key).agg(F.min(id).alias(f"_rep{i}"), F.count(F.lit(1)).alias("_rows"))
        hot = hot_from_counts(minima, [key])
        rows = skew_join(rows, minima.drop("_rows"), [key], spread=F.col(id), hot=hot, n_left=n).drop(key)
    if len(columns) == 1:
        return rows.select(id, F.col("_rep0").alias("component")), n
    rows = cut_lineage(rows)
    links = F.explode(F.array(*[F.col(f"_rep{i}") for i in range(1, len(columns))])).alias("v")
    edges = rows.select(F.col("_rep0").alias("u"), links).filter("u <> v").distinct()
    labels = component_of_edges(edges).withColumnRenamed("node", "_rep0")
    joined = skew_join(
        rows.select(id, "_rep0"), labels, ["_rep0"], how="left", spread=F.col(id), n_left=n
    )
    return joined.select(id, F.coalesce("component", "_rep0").alias("component")), n


def component_split(
    df: DataFrame,
    columns: list[str],
    train_frac: float = 0.8,
    seed: int = 42,
    id: str = "row_id",
    nulls_connect: bool = True,
) -> DataFrame:
    """(id, component, split): whole components go to train until its share is reached.

    Components are taken in seeded hash order while the rows taken so far are below
    ``train_frac`` of all rows, so train overshoots by at most one component.
    """
    members, n = _components(df, columns, id, nulls_connect)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"))
    placed = hash_prefix_sum(sizes, seed, "component", F.col("_rows")).withColumn(
        "split",
        F.when(F.col("before") < F.col("total") * F.lit(train_frac), "train").otherwise("val"),
    )
    return skew_join(
        members,
        placed.select("component", "split"),
        ["component"],
        spread=F.col(id),
        hot=hot_from_counts(sizes, ["component"]),
        n_left=n,
    ).select(id, "component", "split")


def split_report(split: DataFrame) -> DataFrame:
    """Rows, components and share of each side."""
    sides = split.groupBy("split", "component").agg(F.count(F.lit(1)).alias("_rows"))
    report = sides.groupBy("split").agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_components")
    )
    everything = Window.partitionBy()
    return report.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(everything))
