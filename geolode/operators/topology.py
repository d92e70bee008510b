"""Mesh topology: edges, neighbours, boundaries, regularity, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G


def half_edges(faces: DataFrame) -> DataFrame:
    """(fid, k, a, b, u, v): each face's three directed edges, and their ends in order."""
    k = [F.struct(F.lit(i).alias("k"), F.col(p).alias("a"), F.col(q).alias("b")) for i, (p, q) in enumerate(("ab", "bc", "ca"))]
    e = faces.select("fid", F.explode(F.array(*k)).alias("e")).select("fid", "e.*")
    return e.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})


def edges(faces: DataFrame) -> DataFrame:
    """(u, v, n_faces): each edge once."""
    return half_edges(faces).where("u != v").groupBy("u", "v").agg(F.count("*").alias("n_faces"))


def naked_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("n_faces = 1").select("u", "v")


def face_neighbours(faces: DataFrame) -> DataFrame:
    """(fid, n0, n1, n2): the face across each edge, -1 where there is none.

    The first two uses of an edge, by face and side, are neighbours; a third one has none.
    """
    w = Window.partitionBy("u", "v").orderBy("fid", "k")
    e = half_edges(faces).where("u != v")
    e = e.select("fid", "k", F.row_number().over(w).alias("use"), F.lag("fid").over(w).alias("before"), F.lead("fid").over(w).alias("after"))
    other = F.when(F.col("use") == 1, F.col("after")).when(F.col("use") == 2, F.col("before"))
    return e.groupBy("fid").agg(*(F.coalesce(F.max(F.when(F.col("k") == i, other)), F.lit(-1)).alias(f"n{i}") for i in range(3)))


def vertex_degrees(faces: DataFrame) -> DataFrame:
    """(vid, n_neighbours, n_faces, on_border) of every vertex in use."""
    e = edges(faces)
    ends = e.select(F.explode(F.array("u", "v")).alias("vid"), "n_faces")
    corner = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n_faces"))
    return ends.groupBy("vid").agg(F.count("*").alias("n_neighbours"), F.bool_or(F.col("n_faces") == 1).alias("on_border")).join(corner, "vid").select("vid", "n_neighbours", "n_faces", "on_border")


def vertex_neighbours(faces: DataFrame) -> DataFrame:
    """(vid, nid): both directions of every edge."""
    e = edges(faces)
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("nid")), F.struct(F.col("v").alias("vid"), F.col("u").alias("nid")))).alias("p")).select("p.*")


def topology_checks(faces: DataFrame) -> DataFrame:
    """One row: edges, naked and crowded edges, and whether all faces wind alike."""
    e = half_edges(faces).where("u != v")
    directed = e.groupBy("u", "v").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("u")).alias("up"))
    return directed.agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") == 1).alias("n_naked"), F.count_if(F.col("n") > 2).alias("n_crowded"), F.coalesce(F.bool_and((F.col("up") <= 1) & (F.col("n") - F.col("up") <= 1)), F.lit(True)).alias("winds_alike"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    """(vid, degree): naked edges at each vertex; more than two is a branching."""
    return naked_edges(faces).select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("degree"))


def creases(xyz: DataFrame, faces: DataFrame, cosine: float) -> DataFrame:
    """(u, v, cosine): edges of exactly two faces whose normals' cosine is at most ``cosine``."""
    nx, ny, nz = G.normal()
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    unit = xyz.select("fid", nx.alias("nx"), ny.alias("ny"), nz.alias("nz"), length.alias("l")).where("l > 0")
    unit = unit.select("fid", *((F.col(k) / F.col("l")).alias(k) for k in ("nx", "ny", "nz")))
    e = half_edges(faces).join(unit, "fid")
    pair = e.groupBy("u", "v").agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("p"), F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("q"))
    exact = edges(faces).where("n_faces = 2")
    dot = F.col("p.nx") * F.col("q.nx") + F.col("p.ny") * F.col("q.ny") + F.col("p.nz") * F.col("q.nz")
    return pair.where("n = 2").join(exact, ["u", "v"], "left_semi").select("u", "v", dot.alias("cosine")).where(F.col("cosine") <= cosine)


def regularity(xyz: DataFrame, sample: int = 2048) -> DataFrame:
    """Faces sampled, skinny ones (an angle under 8 degrees), the median of their mean edges, and whether the mesh is very sparse or skinny, over evenly spread faces."""
    n = xyz.count()
    s = min(n, sample)
    if n > s:
        # Ranks by face id come from counts of ranges, so no task sorts the whole mesh.
        xyz = evenly(xyz, s, n)

    def length(p, q):
        return F.sqrt(sum((F.col(f"{p}{k}") - F.col(f"{q}{k}")) * (F.col(f"{p}{k}") - F.col(f"{q}{k}")) for k in "xyz"))

    m = xyz.select(length("a", "b").alias("l0"), length("b", "c").alias("l1"), length("c", "a").alias("l2"))

    def angle(opposite, p, q):
        cosine = F.try_divide(p * p + q * q - opposite * opposite, 2 * p * q)
        return F.degrees(F.acos(G.clamp(cosine, -1.0, 1.0)))

    l0, l1, l2 = F.col("l0"), F.col("l1"), F.col("l2")
    least = F.least(angle(l0, l1, l2), angle(l1, l2, l0), angle(l2, l0, l1))
    m = m.withColumn("skinny", F.coalesce(least < 8, F.lit(True)))
    skinny = m.agg(F.count("*").alias("n_sampled"), F.count_if("skinny").alias("n_skinny"))
    # The sample is bounded, so one window over it is too.
    ranked_ = m.select(((l0 + l1 + l2) / 3).alias("l")).withColumn("k", F.row_number().over(Window.orderBy("l"))).where(F.col("k") == s // 2 + 1)
    return skinny.join(F.broadcast(ranked_.select(F.col("l").alias("median_edge"))), how="cross") if n else skinny.withColumn("median_edge", F.lit(None).cast("double"))


#: Faces under which a mesh is sparse, and share of its diagonal that its edges must not pass.
SPARSE_FACES, SPARSE_EDGE = 250, 12


def mesh_verdict(xyz: DataFrame) -> DataFrame:
    """One row: ``n_faces``, ``diagonal``, ``median_edge``, ``very_sparse`` and ``very_skinny`` (a hundredth of the sample, one face at least)."""
    ends = [f(F.greatest(*(F.col(f"{c}{k}") for c in "abc")) if f is F.max else F.least(*(F.col(f"{c}{k}") for c in "abc"))) for k in "xyz" for f in (F.min, F.max)]
    whole = xyz.agg(F.count("*").alias("n_faces"), *(e.alias(f"e{i}") for i, e in enumerate(ends)))
    size = sum((F.col(f"e{i + 1}") - F.col(f"e{i}")) * (F.col(f"e{i + 1}") - F.col(f"e{i}")) for i in (0, 2, 4))
    one = whole.select("n_faces", F.coalesce(F.sqrt(size), F.lit(0.0)).alias("diagonal")).join(regularity(xyz), how="cross")
    sparse = (F.col("n_faces") < SPARSE_FACES) | ((F.col("diagonal") > 0) & (F.col("median_edge") > F.col("diagonal") / SPARSE_EDGE))
    skinny = (F.col("n_sampled") > 0) & (F.col("n_skinny") >= F.greatest(F.lit(1), F.floor(F.col("n_sampled") / 100)))
    return one.select("n_faces", "diagonal", "median_edge", sparse.alias("very_sparse"), skinny.alias("very_skinny"))


def evenly(rows: DataFrame, s: int, n: int, by: str = "fid") -> DataFrame:
    """``s`` of ``n`` rows by rank: those of rank floor(i * n / s)."""
    from geolode.plans.lineage import materialized

    # Both readers must see the same ranges: their borders come from a sample, and adaptive execution may merge them for one reader only.
    cut = materialized(rows.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()))
    local = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1)
    before = cut.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = local.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_at") + F.col("_before"))
    # rank r is floor(i n / s) for some i exactly if ceil(r s / n) n / s floors to r
    i = F.ceil(F.col("_rank") * s / n)
    return ranked.where((i < s) & (F.floor(i * n / s) == F.col("_rank"))).drop("_part", "_at", "_before", "_rank")


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's place (from 0) in an order that has no ties: ranges are sorted apart, then offset by the rows before them."""
    from geolode.plans.lineage import materialized

    cut = materialized(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = cut.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def compacted(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that a face uses, with their new number ``nid`` in the order of the old ones."""
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    from geolode.plans.lineage import materialized

    v = vertices.join(used, "vid", "left_semi")
    cut = materialized(v.repartitionByRange("vid").withColumn("_part", F.spark_partition_id()))
    before = cut.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("_part").orderBy("vid")) - 1
    return cut.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn("nid", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
