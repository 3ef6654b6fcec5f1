"""Import graph: boundaries, rules between them, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from repolytics.operators.graph import strong_components


def dependencies(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """from, to, edges: distinct imports that cross boundaries.

    imports: src, dst.  packages: package, boundary.
    """
    a = packages.select(F.col("package").alias("src"), F.col("boundary").alias("from"))
    b = packages.select(F.col("package").alias("dst"), F.col("boundary").alias("to"))
    crossing = imports.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter(F.col("from") != F.col("to"))
    return crossing.groupBy("from", "to").agg(F.count(F.lit(1)).alias("edges"))


def violations(imports: DataFrame, packages: DataFrame, module: str, top: str = "cmd") -> DataFrame:
    """kind, package, imported, from, to: imports of the top layer or of the module root."""
    a = packages.select(F.col("package").alias("src"), F.col("boundary").alias("from"))
    b = packages.select(F.col("package").alias("dst"), F.col("boundary").alias("to"))
    named = imports.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    upward = named.filter((F.col("to") == top) & (F.col("from") != top)).withColumn("kind", F.lit("cmd-imported"))
    root = named.filter((F.col("dst") == module) & (F.col("src") != module) & F.lit(module != "")).withColumn("to", F.lit("")).withColumn("kind", F.lit("root-import"))
    return upward.unionByName(root).select("kind", F.col("src").alias("package"), F.col("dst").alias("imported"), "from", "to")


def cycles(imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """cycle, package, members: the packages that import each other in a circle, a row each.

    A cycle is a class of packages of which each reaches every other; it is named after its
    smallest member, and members is how many it has.  A package that imports itself is one
    of its own.  With packages (package), only imports between these count.
    """
    edges = imports.select("src", "dst")
    if packages is not None:
        known = packages.select("package").distinct()
        edges = edges.join(known.withColumnRenamed("package", "src"), "src", "left_semi").join(known.withColumnRenamed("package", "dst"), "dst", "left_semi")
    found = strong_components(edges)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return found.join(size, "component").select(F.col("component").alias("cycle"), F.col("node").alias("package"), "members")


def cycle_violations(found: DataFrame, packages: DataFrame, shown: int = 20) -> DataFrame:
    """kind, package, imported, from, to of cycles, in the form of violations: one row a cycle.

    package names the first members, in order; imported says how many more there are.
    """
    place = F.row_number().over(Window.partitionBy("cycle").orderBy("package"))
    first = found.withColumn("place", place).filter(F.col("place") <= shown)
    named = first.groupBy("cycle", "members").agg(F.array_join(F.array_sort(F.collect_list("package")), " -> ").alias("names"))
    more = F.when(F.col("members") > shown, F.format_string("and %d more", F.col("members") - shown)).otherwise("")
    own = packages.select(F.col("package").alias("cycle"), F.col("boundary").alias("from"))
    return named.join(own, "cycle").select(F.lit("cycle").alias("kind"), F.col("names").alias("package"), more.alias("imported"), "from", F.lit("").alias("to"))
