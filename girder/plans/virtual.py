"""A virtual repository over the star-schema tables, so that policy queries run on them: parts are files, successive parts of
an order are imports, documents are texts, events are hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), "p_name", "p_size", "p_brand", "p_retailprice")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"))
    return rows.filter("b is not null and a div 50 = b div 50").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) paths."""
    f = files(spark, d)
    a, b = f.select(F.col("id").alias("a"), F.col("path").alias("src")), f.select(F.col("id").alias("b"), F.col("path").alias("dst"))
    return raw_edges(spark, d).join(a, "a").join(b, "b").select("src", "dst")


def observed(spark: SparkSession, d: str) -> DataFrame:
    """(path, target_path, target_kind, target_package): local edges, and one external edge for each supplied part."""
    local = edges(spark, d).select(F.col("src").alias("path"), F.col("dst").alias("target_path"), F.lit("local").alias("target_kind"), F.lit(None).cast("string").alias("target_package"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 10).alias("s")).distinct()
    package = F.concat(F.lit("@pkg/s"), F.col("s").cast("string"))
    external = li.join(files(spark, d).select("id", "path"), "id").select("path", F.concat(F.lit("node_modules/"), package, F.lit("/index.js")).alias("target_path"), F.lit("external").alias("target_kind"), package.alias("target_package"))
    return local.unionByName(external)


def bindings(spark: SparkSession, d: str) -> DataFrame:
    """Each edge imports two symbols of its target: a default named after its size class, and its name."""
    f = files(spark, d)
    target = f.select(F.col("path").alias("target_path"), F.col("p_size").alias("size"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol_name"))
    rows = edges(spark, d).select(F.col("src").alias("path"), F.col("dst").alias("target_path")).join(target, "target_path")
    both = F.explode(F.array(F.struct(F.lit(0).alias("bind_ord"), F.concat(F.lit("size"), (F.col("size") % 5).cast("string")).alias("symbol"), F.lit("default").alias("binding_kind")), F.struct(F.lit(1).alias("bind_ord"), F.col("symbol_name").alias("symbol"), F.lit("named").alias("binding_kind"))))
    return rows.select("path", F.col("target_path").alias("specifier"), "target_path", both.alias("b")).select("path", "specifier", "target_path", "b.*")


def surface_sites(spark: SparkSession, d: str) -> DataFrame:
    """Each order line flag of a part is an export of its file."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus").distinct()
    rows = li.join(files(spark, d).select("id", "path"), "id")
    return rows.select("path", F.concat("l_returnflag", F.lower("l_linestatus")).alias("name"), F.when(F.col("l_linestatus") == "O", "named").otherwise("default").alias("kind"), F.lit("variable").alias("declares"), (F.col("l_returnflag") == "R").alias("reexport"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "source", "lang")


VFILES = """vfiles AS (SELECT p_partkey AS id, 'src/' || lower(p_type) || '/' || lower(replace(p_brand,'#','-')) || '/' || replace(p_name,' ','-') || '.' || p_partkey || '.ts' AS path, p_name, p_size, p_brand, p_retailprice FROM part)"""
VEDGES = (
    VFILES
    + """, vraw AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a // 50 = b // 50),
vedges AS (SELECT x.path AS src, y.path AS dst FROM vraw JOIN vfiles x ON x.id = a JOIN vfiles y ON y.id = b)"""
)
VOBSERVED = (
    VEDGES
    + """, vobserved AS (SELECT src AS path, dst AS target_path, 'local' AS target_kind, NULL AS target_package FROM vedges UNION ALL
SELECT path, 'node_modules/@pkg/s' || s || '/index.js', 'external', '@pkg/s' || s FROM (SELECT DISTINCT l_partkey AS id, l_suppkey % 10 AS s FROM lineitem) JOIN vfiles USING (id))"""
)
VBINDINGS = (
    VEDGES
    + """, vbindings AS (SELECT src AS path, dst AS target_path, 0 AS bind_ord, 'size' || (p_size % 5) AS symbol, 'default' AS kind FROM vedges JOIN vfiles ON path = dst UNION ALL
SELECT src, dst, 1, replace(p_name,' ','_'), 'named' FROM vedges JOIN vfiles ON path = dst)"""
)
VSITES = (
    VFILES
    + """, vsites AS (SELECT path, l_returnflag || lower(l_linestatus) AS name, CASE WHEN l_linestatus = 'O' THEN 'named' ELSE 'default' END AS kind, l_returnflag = 'R' AS reexport
FROM (SELECT DISTINCT l_partkey AS id, l_returnflag, l_linestatus FROM lineitem) JOIN vfiles USING (id))"""
)
VCONTENT = """vcontent AS (SELECT doc_id, 'src/' || source || '/' || lang || '/doc' || doc_id || '.md' AS path, text, source, lang FROM documents)"""
