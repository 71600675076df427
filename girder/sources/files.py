"""Source trees as tables: files, paths, package roots, and imports resolved against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions.text import basename, dirname, npm_package, resolved

# Folders that a walk skips, source extensions, those that a specifier may leave out, and what one may stand for.
SKIPPED = ("node_modules", "build", "dist", ".next", ".git", "storybook-static", "coverage")
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".svelte")
RESOLVED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json")
ALIASES = {".js": (".ts", ".tsx", ".js"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(full, size) of all files below a root, by the store's own listing, as a file scan lists them; names only."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    it, rows = top.getFileSystem(conf).listFiles(top, True), []
    while it.hasNext():
        f = it.next()
        rows.append((f.getPath().toUri().getPath(), f.getLen()))
    return spark.createDataFrame(rows, "full string, size long")


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: str = r"\.d\.[cm]?ts$") -> DataFrame:
    """(path, text) below a root, read whole and in parallel by Spark; paths are relative with forward slashes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)  # readers skip empty files, which the listing adds
    prefix = root.rstrip("/").split("://")[-1].rstrip("/") + "/"
    full = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    texts = raw.select(full.alias("full"), F.decode("content", "utf-8").alias("text"))
    empty = listed(spark, root).filter("size = 0").select("full", F.lit("").alias("text"))
    rows = texts.unionByName(empty).select(F.substring("full", F.lit(len(prefix) + 1), F.length("full")).alias("path"), "text")
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    skip = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return rows.filter(ext.isin(*extensions) & ~F.col("path").rlike(skip) & ~F.col("path").rlike(ignored))


def described(files: DataFrame) -> DataFrame:
    return files.withColumns({"dir": dirname(F.col("path")), "base": basename(F.col("path")), "ext": F.regexp_extract("path", r"(\.[^./]+)$", 1)})


def all_paths(files: DataFrame) -> DataFrame:
    """Paths that exist: files and every folder above them."""
    from girder.functions.text import ancestors

    return files.select("path", F.lit(False).alias("is_dir")).unionByName(files.select(F.explode(ancestors(F.col("path"))).alias("path"), F.lit(True).alias("is_dir")).distinct())


def package_roots(paths: DataFrame, marker: str) -> DataFrame:
    """(root, source): folders that hold a marker file, with their src folder if there is one."""
    roots = paths.filter(basename(F.col("path")) == marker).select(dirname(F.col("path")).alias("root"))
    src = paths.filter("is_dir").select(F.col("path").alias("source"))
    want = F.when(F.col("root") == "", F.lit("src")).otherwise(F.concat("root", F.lit("/src")))
    return roots.withColumn("want", want).join(src, F.col("want") == F.col("source"), "left").select("root", "source")


def workspace_projects(files: DataFrame) -> DataFrame:
    """(root, name): folders with project.json, named by it, by package.json beside it, or by the folder."""
    own = files.filter(basename(F.col("path")) == "project.json").select(dirname(F.col("path")).alias("root"), F.get_json_object("text", "$.name").alias("own"))
    package = files.filter(basename(F.col("path")) == "package.json").select(dirname(F.col("path")).alias("root"), F.get_json_object("text", "$.name").alias("package"))
    return own.join(package, "root", "left").select("root", F.coalesce("own", "package", basename(F.col("root"))).alias("name"))


def resolved_imports(imports: DataFrame, paths: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(path, specifier, target_path, target_kind, target_package): relative specifiers against the paths on disk, the first
    candidate in rank order; packages against a table (package, target_path); node: is built in. Each folder and specifier
    is resolved once."""
    keys = imports.select(dirname(F.col("path")).alias("dir"), "specifier").distinct()
    local = keys.filter(F.col("specifier").rlike(r"^\.\.?(/|$)")).withColumn("base", resolved(F.col("dir"), F.col("specifier")))
    ext = F.regexp_extract("base", r"(\.[^./]+)$", 1)
    stem = F.expr("left(base, length(base) - length(regexp_extract(base, '(\\\\.[^./]+)$', 1)))")
    alias = F.element_at(F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), ext)
    tries = F.concat(
        F.array("base"),
        F.coalesce(F.transform(alias, lambda e: F.concat(stem, e)), F.array().cast("array<string>")),
        F.transform(F.array(*map(F.lit, RESOLVED)), lambda e: F.concat("base", e)),
        F.transform(F.array(*map(F.lit, RESOLVED)), lambda e: F.concat(F.col("base"), F.lit("/index"), e)),
    )
    ranked = local.select("dir", "specifier", F.posexplode(tries).alias("rank", "candidate"))
    hit = ranked.join(paths.filter("not is_dir").select(F.col("path").alias("candidate")), "candidate").groupBy("dir", "specifier").agg(F.min_by("candidate", "rank").alias("target_path"))
    found = hit.select("dir", "specifier", "target_path", F.lit("local").alias("target_kind"), F.lit(None).cast("string").alias("target_package"))
    builtin = keys.filter("specifier like 'node:%'").select("dir", "specifier", F.col("specifier").alias("target_path"), F.lit("builtin").alias("target_kind"), F.lit(None).cast("string").alias("target_package"))
    found = found.unionByName(builtin)
    if packages is not None:
        name = F.regexp_extract("specifier", r"^((?:@[^/]+/)?[^/]+)", 1)
        bare = keys.filter(~F.col("specifier").rlike(r"^(\.|node:|/)")).withColumn("package", name).join(packages, "package")
        found = found.unionByName(bare.select("dir", "specifier", "target_path", F.lit("external").alias("target_kind"), F.coalesce(npm_package(F.col("target_path")), "package").alias("target_package")))
    return imports.withColumn("dir", dirname(F.col("path"))).join(found, ["dir", "specifier"], "left").drop("dir")
