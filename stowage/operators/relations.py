"""The relational logic of archives, over `entries` frames.

Parsers emit facts; links, groups, duplicates, budgets and totals are joins, windows and aggregates here.
Each works within an archive (`archive_path`), which is the key of every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "archive_path"


def specific(key: str) -> Column:
    """A value of format_specific, null where it is absent."""
    return F.try_element_at(F.col("format_specific"), F.lit(key))


def safe_components(components: Column, name: Column) -> Column:
    """Components without `.`; null for empty, absolute or climbing paths and for NUL."""
    kept = F.filter(components, lambda c: (c != "") & (c != "."))
    bad = name.isNull() | name.startswith("/") | name.contains("\0") | (F.size(kept) == 0) | F.array_contains(kept, "..")
    return F.when(~bad, kept)


def normal_path(name: Column) -> Column:
    """The normalised path of a name, null if it is not safe."""
    return F.array_join(safe_components(F.split(name, "/"), name), "/")


def hard_link_targets(entries: DataFrame, link: str = "linkPath") -> DataFrame:
    """entries with target_index: for each hard link the last earlier entry of the linked path.

    A running maximum over one sort of paths and links serves as the as-of join: no pairs are made. A
    target counts if it is a file or itself a link with a target.
    """
    path, to = normal_path(F.col("name")), normal_path(specific(link))
    is_link = F.col("kind") == "hardlink"
    points = entries.select(KEY, "index", F.lit(1).alias("__is"), path.alias("__path"), F.col("kind").alias("__kind")).unionByName(entries.where(is_link & to.isNotNull()).select(KEY, "index", F.lit(0).alias("__is"), to.alias("__path"), F.lit(None).cast("string").alias("__kind")))
    # at the same index the link comes before its own path
    upto = Window.partitionBy(KEY, "__path").orderBy("index", "__is").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__is") == 1, F.struct("index", "__kind")), True).over(upto)
    found = points.withColumn("__last", last).where((F.col("__is") == 0) & F.col("__last").isNotNull()).select(KEY, "index", F.col("__last.index").alias("target_index"), F.col("__last.__kind").alias("__tk"))
    files = found.where(F.col("__tk") == "file").select(KEY, "index", "target_index")
    return entries.join(_through_links(found, files), [KEY, "index"], "left")


def _through_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """Links to files, and links to links that end at a file; link chains go strictly back, so they end."""
    links = found.where(F.col("__tk") == "hardlink").select(KEY, "index", "target_index")
    good, waiting = files, links
    while not waiting.isEmpty():
        more = waiting.join(good.select(KEY, F.col("index").alias("target_index")).distinct(), [KEY, "target_index"], "left_semi").select(KEY, "index", "target_index")
        if more.isEmpty():
            break
        waiting = waiting.join(more, [KEY, "index"], "left_anti").select(KEY, "index", "target_index")
        good = good.unionByName(more)
    return good


def copy_sources(entries: DataFrame, copy_of: str = "copyPath") -> DataFrame:
    """entries with source_index: a file copy's last earlier entry of that path, if it is a regular file of equal size and no copy itself."""
    path, to = normal_path(F.col("name")), normal_path(specific(copy_of))
    points = entries.select(KEY, "index", F.lit(1).alias("__is"), path.alias("__path"), F.struct("index", "kind", "uncompressed_size", specific(copy_of).isNotNull().alias("copy")).alias("__row")).unionByName(entries.where(specific(copy_of).isNotNull()).select(KEY, "index", F.lit(0).alias("__is"), to.alias("__path"), F.struct("index", "kind", "uncompressed_size", F.lit(True).alias("copy")).alias("__row")))
    upto = Window.partitionBy(KEY, "__path").orderBy("index", "__is").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__is") == 1, F.col("__row")), True).over(upto)
    good = (F.col("__last.kind") == "file") & ~F.col("__last.copy") & (F.col("__last.uncompressed_size") == F.col("__row.uncompressed_size"))
    found = points.withColumn("__last", last).where((F.col("__is") == 0) & good).select(KEY, "index", F.col("__last.index").alias("source_index"))
    return entries.join(found, [KEY, "index"], "left")


def link_closure(entries: DataFrame, link: str = "linkPath") -> DataFrame:
    """(archive_path, index, file_index): links by path followed to a file, however they point; cycles never resolve.

    Pointer doubling: each round a link's target jumps to its target's target, so rounds grow with the
    logarithm of the longest chain.
    """
    rows = entries.select(KEY, "index", "kind", F.col("name").alias("__path"), specific(link).alias("__to"))
    first = rows.groupBy(KEY, "__path").agg(F.min_by(F.struct("index", "kind"), "index").alias("__t"))
    now = rows.where(F.col("kind") == "hardlink").join(first.withColumnRenamed("__path", "__to"), [KEY, "__to"]).select(KEY, "index", F.col("__t.index").alias("at"), (F.col("__t.kind") == "file").alias("done"))
    rounds = max(1, int(now.groupBy(KEY).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]).bit_length())
    for _ in range(rounds):
        nxt = now.select(KEY, F.col("index").alias("at"), F.col("at").alias("__n"), F.col("done").alias("__d"))
        now = now.join(nxt, [KEY, "at"], "left").select(KEY, "index", F.when(F.col("done"), F.col("at")).otherwise(F.coalesce("__n", "at")).alias("at"), (F.col("done") | F.coalesce("__d", F.lit(False))).alias("done"))
    return now.where("done").select(KEY, "index", F.col("at").alias("file_index"))


def merge_apple_double(entries: DataFrame, policy: str = "merge") -> DataFrame:
    """AppleDouble sidecars (`__MACOSX/dir/._name` or `dir/._name`): their rows give way to fork rows after their file.

    expose leaves all rows; hide drops sidecars that have a file; merge puts each as `fork=rsrc` behind
    its file. Indices are made anew and link indices follow.
    """
    if policy == "expose":
        return entries
    parts = F.filter("path_components", lambda c: c != "")
    bare = F.when(parts[0] == "__MACOSX", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    last = F.element_at(bare, -1)
    side = (F.col("kind") == "file") & (F.size(bare) > 0) & last.startswith("._") & (F.length(last) > 2)
    target = F.concat(F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(0))), F.array(F.substring(last, 3, 1 << 20)))
    marked = entries.withColumns({"__side": F.coalesce(side, F.lit(False)), "__to": F.array_join(F.when(side, target), "/"), "__own": F.array_join(parts, "/")})
    owners = marked.where(~F.col("__side")).groupBy(KEY, F.col("__own").alias("__to")).agg(F.min("index").alias("__owner"))
    joined = marked.join(owners, [KEY, "__to"], "left")
    joined = joined.withColumn("__fork", F.col("__side") & F.col("__owner").isNotNull())
    kept = joined.where(~F.col("__fork")) if policy == "hide" else joined
    order = Window.partitionBy(KEY).orderBy(F.when(F.col("__fork"), F.col("__owner")).otherwise(F.col("index")), F.col("__fork").cast("int"), "index")
    fresh = kept.withColumn("__new", (F.row_number().over(order) - 1).cast("int"))
    links = fresh.select(KEY, F.col("index").cast("string").alias("__t"), F.col("__new").alias("__tn"))
    fresh = fresh.withColumn("__t", specific("hardLinkTargetIndex")).join(links, [KEY, "__t"], "left")
    put = lambda m, key, value: F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), value))
    values = F.coalesce("format_specific", F.create_map().cast("map<string,string>"))
    values = F.when(F.col("__fork"), put(put(values, "fork", F.lit("rsrc")), "appleDoubleSidecar", F.col("name"))).otherwise(values)
    values = F.when(F.col("__tn").isNotNull(), put(values, "hardLinkTargetIndex", F.col("__tn").cast("string"))).otherwise(values)
    name = F.when(F.col("__fork"), F.col("__to")).otherwise(F.col("name"))
    out = {"index": F.col("__new"), "name": name, "path_components": F.when(F.col("__fork"), F.split("__to", "/")).otherwise(F.col("path_components")), "format_specific": values}
    return fresh.select(*[out[c].alias(c) if c in out else F.col(c) for c in entries.columns])


def solid_islands(entries: DataFrame, solid: Column) -> DataFrame:
    """solid_group from runs: a non-solid file leads the solid ones after it; directories play no part; runs of one are -1."""
    files = F.col("kind") != "directory"
    upto = Window.partitionBy(KEY).orderBy("index")
    lead = F.last(F.when(files & ~solid, F.col("index")), True).over(upto)
    marked = entries.withColumn("__lead", F.when(files, lead))
    size = F.count(F.when(files, 1)).over(Window.partitionBy(KEY, "__lead"))
    group = F.when(files & F.col("__lead").isNotNull() & (size > 1), F.col("__lead")).otherwise(-1)
    return marked.withColumn("solid_group", group.cast("int")).drop("__lead")


def folder_groups(entries: DataFrame, folder: Column, always: bool = False) -> DataFrame:
    """solid_group = the folder, if it holds more than one entry, or always."""
    marked = entries.withColumn("__f", folder)
    n = F.count("__f").over(Window.partitionBy(KEY, "__f"))
    return marked.withColumn("solid_group", F.when(F.col("__f").isNotNull() & (F.lit(always) | (n > 1)), F.col("__f")).otherwise(-1).cast("int")).drop("__f")


def hard_link_groups(entries: DataFrame) -> DataFrame:
    """(archive_path, hard_link_group, members, first_index, bytes): entries of one inode; only the member with data counts its bytes."""
    group = specific("hardLinkGroup")
    return entries.where(group.isNotNull()).groupBy(KEY, group.alias("hard_link_group")).agg(F.count("*").alias("members"), F.min("index").alias("first_index"), F.max("uncompressed_size").alias("bytes"))


def first_lookup(entries: DataFrame, lookup: DataFrame, on: list[str], order: str) -> DataFrame:
    """Equi-join with the first matching lookup row in a given order."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    return entries.join(lookup.withColumn("__r", rank).where("__r = 1").drop("__r"), on, "left")


def tree_paths(nodes: DataFrame, id: str = "id", parent: str = "parent", name: str = "name") -> DataFrame:
    """(archive_path, id, path, depth) of parent-child rows by doubling; nodes in cycles get no path."""
    now = nodes.select(KEY, F.col(id).alias("id"), F.col(parent).alias("up"), F.array(F.col(name)).alias("parts"))
    most = nodes.groupBy(KEY).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    for _ in range(int(most).bit_length()):
        if now.where(F.col("up").isNotNull()).isEmpty():
            break
        above = now.select(KEY, F.col("id").alias("up"), F.col("up").alias("__u"), F.col("parts").alias("__p"))
        joined = now.join(above, [KEY, "up"], "left")
        now = joined.select(KEY, "id", "__u", F.when(F.col("__p").isNotNull(), F.concat("__p", "parts")).otherwise(F.col("parts")).alias("parts")).withColumnRenamed("__u", "up")
    return now.where(F.col("up").isNull()).select(KEY, "id", F.array_join("parts", "/").alias("path"), F.size("parts").alias("depth"))


def first_of_duplicates(entries: DataFrame, path: Column | None = None) -> DataFrame:
    """The first entry of each path, with how many later ones were skipped."""
    marked = entries.withColumn("__p", F.col("name") if path is None else path)
    w = Window.partitionBy(KEY, "__p")
    return marked.withColumns({"__r": F.row_number().over(w.orderBy("index")), "skipped": F.count("*").over(w) - 1}).where("__r = 1").drop("__r", "__p")


def over_budget(entries: DataFrame, limit: int) -> DataFrame:
    """(archive_path, declared, over): whether an archive's declared sizes exceed the limit."""
    return entries.groupBy(KEY).agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("declared")).withColumn("over", F.col("declared") > limit)


def produced_budget(rows: DataFrame, limit: int, produced: str = "bytes") -> DataFrame:
    """rows with over: from the first entry, in order, whose running output exceeds the limit."""
    w = Window.partitionBy(KEY).orderBy("index")
    return rows.withColumn("over", F.sum(F.coalesce(F.col("uncompressed_size"), F.col(produced), F.lit(0))).over(w) > limit)


def overlaps(entries: DataFrame) -> DataFrame:
    """Entries whose stored record runs into the next one of their archive."""
    w = Window.partitionBy(KEY).orderBy("raw_record.record_start", "index")
    return entries.where(F.col("raw_record").isNotNull()).withColumn("next_start", F.lead("raw_record.record_start").over(w)).where(F.col("raw_record.record_end") > F.col("next_start"))


def without_covered_forks(entries: DataFrame) -> DataFrame:
    """Resource forks only where no data fork has their path."""
    fork = F.coalesce(specific("fork"), F.lit("data"))
    data = entries.where(fork != "rsrc").select(KEY, "name").distinct()
    return entries.where(fork != "rsrc").unionByName(entries.where(fork == "rsrc").join(data, [KEY, "name"], "left_anti").select(*entries.columns))


def extraction_order(entries: DataFrame) -> DataFrame:
    """entries with phase: files and links 0, forward hard links 1, resource forks 2, directories 3 (deepest first)."""
    rows = hard_link_targets(entries)
    fork = F.coalesce(specific("fork"), F.lit("data")) == "rsrc"
    phase = F.when(F.col("kind") == "directory", 3).when(fork, 2).when((F.col("kind") == "hardlink") & F.col("target_index").isNull(), 1).otherwise(0)
    depth = F.when(phase == 3, -F.size("path_components")).otherwise(0)
    w = Window.partitionBy(KEY).orderBy("phase", "__depth", "index")
    return rows.withColumns({"phase": phase, "__depth": depth}).withColumn("step", F.row_number().over(w)).drop("__depth")
