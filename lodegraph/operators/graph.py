"""Call graph operators: resolution of edges, callers, multi-hop traversal, importers and the unit tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hops after which a traversal's state is cut loose from its lineage, where the session has a checkpoint folder.
CUT_EVERY = 3


def is_symbol(unit_type: str = "unit_type", kind: str = "kind") -> Column:
    return (F.col(kind) == "symbol") & ~F.col(unit_type).isin("import", "config_key")


def _chain_ends(chain: Column, name: Column) -> Column:
    low, n = F.lower(chain), F.lower(name)
    return F.endswith(low, F.concat(F.lit("."), n)) | F.endswith(low, F.concat(F.lit("::"), n))


def resolve_edges(edges: DataFrame, units: DataFrame, aliases: DataFrame) -> DataFrame:
    """edges (edge_id, file_id, callee, callee_full) with callee_unit_id, by the first of these that finds one unit:
    a symbol of the same file by name or qualified name; the alias target by qualified name; the alias target by
    module path and symbol; a symbol of that name anywhere. Ambiguous names resolve to nothing at a step."""
    symbols = units.filter(is_symbol()).select("unit_id", "file_id", "name", "qualname", F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/", ".").alias("module"))

    def unique(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("unit_id").alias("u"), F.count_distinct("unit_id").alias("n")).filter("n = 1").drop("n")

    local = symbols.select("unit_id", "file_id", F.explode(F.array_distinct(F.array("name", "qualname"))).alias("key"))
    first = F.substring_index("callee_full", ".", 1)
    rest = F.when(F.contains("callee_full", F.lit(".")), F.expr("substring(callee_full, instr(callee_full, '.'))")).otherwise("")
    out = edges.select("edge_id", "file_id", "callee", "callee_full", first.alias("__alias"), rest.alias("__rest"))
    by_key = unique(local, "file_id", "key")
    out = out.join(by_key.select("file_id", F.col("key").alias("callee"), F.col("u").alias("__u1")), ["file_id", "callee"], "left")
    out = out.join(aliases.select("file_id", F.col("alias").alias("__alias"), "target"), ["file_id", "__alias"], "left")
    out = out.withColumn("__path", F.concat("target", "__rest"))
    out = out.join(unique(symbols, "qualname").select(F.col("qualname").alias("__path"), F.col("u").alias("__u2")), "__path", "left")
    modules = unique(symbols.withColumn("__path", F.concat_ws(".", "module", "qualname")), "__path")
    out = out.join(modules.select("__path", F.col("u").alias("__u3")), "__path", "left")
    out = out.join(unique(symbols, "name").select(F.col("name").alias("callee"), F.col("u").alias("__u4")), "callee", "left")
    return out.select("edge_id", "file_id", "callee", "callee_full", F.coalesce("__u1", "__u2", "__u3", "__u4").alias("callee_unit_id"))


def callers(names: DataFrame, edges: DataFrame, units: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """target, unit_id, line, call, resolved_target: for each name, units that call it, with their first call.

    A call counts if its last segment or its whole chain is the name, its chain ends in the name after a dot or two
    colons, or it resolves to a unit of that name or qualified name. For names with a dot or two colons, calls
    through an import alias count too, unless a symbol of the file shadows the alias. Calls outside tests come first.
    """
    u = units.select("unit_id", "file_id", "name", "qualname", "kind", "unit_type", "file_path")
    called = u.select(F.col("unit_id").alias("callee_unit_id"), F.col("name").alias("__n"), F.col("qualname").alias("__q"))
    e = edges.join(called, "callee_unit_id", "left")
    keys = F.array_distinct(F.filter(F.array(F.lower("callee"), F.lower("callee_full"), F.lower(F.element_at(F.split("callee_full", "::"), -1)), F.lower("__n"), F.lower("__q")), lambda x: x.isNotNull()))
    parts = F.split(F.lower("callee_full"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # An equality on any key first, so that the join hashes; the exact rule afterwards.
    near = e.withColumn("__k", F.explode(F.array_distinct(F.concat(keys, tails))))
    asked = names.select(F.col("target"), F.lower("target").alias("__k"))
    t = F.col("target")
    direct = near.join(asked, "__k").filter((F.col("callee") == t) | (F.col("callee_full") == t) | _chain_ends(F.col("callee_full"), t) | (F.col("__n") == t) | (F.col("__q") == t))
    direct = direct.select("target", F.col("caller_unit_id").alias("unit_id"), "line", F.col("callee_full").alias("call"), F.lit(None).cast("string").alias("resolved_target"), F.lit(0).alias("__branch"))
    if aliases is not None:
        shadow = u.filter(is_symbol()).select("file_id", F.col("name").alias("alias")).distinct()
        free = aliases.join(shadow, ["file_id", "alias"], "left_anti")
        head = F.substring_index("callee_full", ".", 1)
        rest = F.when(F.contains("callee_full", F.lit(".")), F.expr("substring(callee_full, instr(callee_full, '.'))")).otherwise("")
        through = edges.select("caller_unit_id", "file_id", "line", "callee_full", head.alias("alias"), rest.alias("__rest")).join(free, ["file_id", "alias"]).withColumn("__full", F.concat("target", "__rest")).withColumnRenamed("target", "resolved_target")
        dotted = names.filter(F.contains("target", F.lit(".")) | F.contains("target", F.lit("::"))).select("target", F.col("target").alias("__full"))
        more = through.join(dotted, "__full").select("target", F.col("caller_unit_id").alias("unit_id"), "line", F.col("callee_full").alias("call"), "resolved_target", F.lit(1).alias("__branch"))
        direct = direct.unionByName(more)
    out = direct.join(u.select("unit_id", F.contains(F.lower("file_path"), F.lit("test")).cast("int").alias("__test")), "unit_id")
    w = Window.partitionBy("target", "unit_id").orderBy("__branch", "__test", "line", "call")
    return out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("target", "unit_id", "line", "call", "resolved_target")


def transitive(name: str, edges: DataFrame, units: DataFrame, depth: int) -> DataFrame:
    """unit_id and hop (the shortest) of units that reach the name by calls in at most depth hops. Every hop is one
    join of the distinct names of the last hop's units; visited units never come again."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(name,)], "target string").filter("target != ''")
    seen: DataFrame | None = None
    for hop in range(1, depth + 1):
        found = callers(frontier, edges, units).select("unit_id").distinct()
        if seen is not None:
            found = found.join(seen, "unit_id", "left_anti")
        found = found.withColumn("hop", F.lit(hop))
        seen = found if seen is None else seen.unionByName(found)
        if hop % CUT_EVERY == 0 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            seen = seen.checkpoint()
            found = seen.filter(F.col("hop") == hop)
        names = found.join(units.select("unit_id", "name", "qualname"), "unit_id").select(F.explode(F.array("name", "qualname")).alias("target"))
        frontier = names.filter("target != ''").distinct()
    return seen


def callees(edges: DataFrame, unit_id: int) -> DataFrame:
    return edges.filter(F.col("caller_unit_id") == unit_id).orderBy("line", "callee_full")


def resolve(units: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Symbols but imports by name, qualified name or its last part; types first."""
    hit = (F.col("kind") == "symbol") & (F.col("unit_type") != "import") & ((F.col("name") == name) | (F.col("qualname") == name) | F.endswith("qualname", F.lit("." + name)))
    return units.filter(hit).orderBy(F.col("unit_type").isin("class", "struct", "interface", "enum").desc(), "name", "file_path", "start_line").limit(limit)


def importers(units: DataFrame, aliases: DataFrame, files: DataFrame, target: str, limit: int = 50) -> DataFrame:
    """file_path and via of files that import the target or something inside it; alias rows win over import units."""
    inside = lambda c: (F.col(c) == target) | F.startswith(c, F.lit(target + "."))
    a = aliases.filter(inside("target")).join(files.select("file_id", F.col("path").alias("file_path")), "file_id").select("file_path", F.col("target").alias("via"), F.lit(0).alias("b"))
    b = units.filter((F.col("unit_type") == "import") & inside("qualname")).select("file_path", F.col("qualname").alias("via"), F.lit(1).alias("b"))
    w = Window.partitionBy("file_path").orderBy("b", "via")
    return a.unionByName(b).withColumn("n", F.row_number().over(w)).filter("n = 1").orderBy("b", "file_path").limit(limit).select("file_path", "via")


def children(units: DataFrame, unit_id: int) -> DataFrame:
    return units.filter(F.col("parent_id") == unit_id).orderBy("start_line", "start_col")


def siblings(units: DataFrame, unit_id: int) -> DataFrame:
    """Units with the same parent, the unit itself among them."""
    own = units.filter(F.col("unit_id") == unit_id).select("parent_id")
    return units.join(own, "parent_id", "left_semi").orderBy("start_line", "start_col")
