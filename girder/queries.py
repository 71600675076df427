"""Registered queries of the policy engine over the virtual repository, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.functions import text as ft
from girder.operators import campaigns as C
from girder.operators import detect as D
from girder.operators import evaluation as E
from girder.operators import families as fam
from girder.operators import graph as G
from girder.operators import infer as I
from girder.operators import measures as M
from girder.operators import records as RC
from girder.operators import sectors as S
from girder.plans import virtual as V
from girder.plans.rules import Allowance, ExportRule, FolderRule, GraphRule, ImportRule, MemberRule, NamingRule, ParityRule, RootRule, SurfaceRule, allowance_table, rule_table
from girder.plans.virtual import VBINDINGS, VCONTENT, VEDGES, VFILES, VOBSERVED, VSITES
from girder.sources import history as H
from girder.sources import reports as R
from girder.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
VIOLATION = ["kind", "rule_name", "message", "file", "subject"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- imports -----------------------------------------------------------------------------------------------------------

IMPORTS = [
    ImportRule("economy-stays-home", "{name} is outside", ["^src/economy/"], [], [], ["^src/economy/", "^src/standard/"], allowances=[Allowance("economy", "allow", "economy", "^src/economy/"), Allowance("economy", "allow", "standard", "^src/standard/"), Allowance("economy", "external", "@pkg/s1")], externals=["@pkg/s1"]),
    ImportRule("small-allowlist", "no", ["^src/small/(brand-[12])/"], ["/hot-"], [], ["^src/(small|medium)/", "^src/large/brand-1"], allowances=[Allowance("small", "allow", "own", "^src/small/$1/", "shared"), Allowance("small", "allow", "large", "^src/large/brand-99/"), Allowance("medium", "allow", "own", "^src/small/$1/", "shared")]),
    ImportRule("promo-locked", "locked", ["^src/promo/brand-99/"], [], [], ["^src/promo/"], allowances=[Allowance("promo", "allow", "promo", "^src/promo/"), Allowance("promo", "external", "zod")]),
]


@query(
    f"""WITH {VEDGES} SELECT 'import' AS kind, 'economy-stays-home' AS rule_name, '{{name}} is outside' AS message, src AS file, dst AS subject FROM vedges
WHERE regexp_matches(src, '^src/economy/') AND NOT regexp_matches(dst, '^src/economy/|^src/standard/')
UNION ALL SELECT 'import', 'small-allowlist', 'no', src, dst FROM vedges WHERE regexp_matches(src, '^src/small/(brand-[12])/') AND NOT regexp_matches(src, '/hot-') AND NOT regexp_matches(dst, '^src/(small|medium)/|^src/large/brand-1')"""
)
def import_allowlist_violations(spark, d):
    local = V.observed(spark, d).filter("target_kind = 'local'")
    return fam.import_violations(local, rule_table(spark, IMPORTS))


@query(
    f"""WITH {VEDGES}, m AS (SELECT src, dst, regexp_extract(src, '^src/([^/]+)/([^/]+)/', 1) AS c1, regexp_extract(src, '^src/([^/]+)/([^/]+)/', 2) AS c2 FROM vedges)
SELECT 'import' AS kind, 'leaves-module' AS rule_name, 'x' AS message, src AS file, dst AS subject FROM m WHERE c1 <> '' AND NOT regexp_matches(dst, '^src/' || regexp_escape(c1) || '/' || regexp_escape(c2) || '/') AND regexp_matches(dst, '^src/' || regexp_escape(c1) || '/')"""
)
def import_same_module_backref(spark, d):
    rules = [ImportRule("leaves-module", "x", ["^src/([^/]+)/([^/]+)/"], [], ["^src/$1/"], ["^src/$1/$2/"])]
    return fam.import_violations(V.observed(spark, d).filter("target_kind = 'local'"), rule_table(spark, rules))


@query(
    f"""WITH {VOBSERVED} SELECT 'import' AS kind, 'externals' AS rule_name, 'e' AS message, path AS file, target_path AS subject FROM vobserved
WHERE regexp_matches(path, '^src/(economy|small)/brand-1') AND target_kind = 'external' AND target_package NOT IN ('@pkg/s1', '@pkg/s4')"""
)
def import_external_allow(spark, d):
    rules = [ImportRule("externals", "e", ["^src/(economy|small)/brand-1"], externals=["@pkg/s1", "@pkg/s4"], dependency_kind="external")]
    return fam.import_violations(V.observed(spark, d), rule_table(spark, rules))


@query(
    f"""WITH {VOBSERVED} SELECT 'import' AS kind, 'any-kind' AS rule_name, 'k' AS message, path AS file, target_path AS subject FROM vobserved
WHERE regexp_matches(path, '^src/large/brand-2') AND NOT (target_kind = 'external' AND target_package = '@pkg/s2') AND regexp_matches(target_path, 's[0-4]/index|^src/large/')"""
)
def import_dependency_kind(spark, d):
    rules = [ImportRule("any-kind", "k", ["^src/large/brand-2"], [], ["s[0-4]/index", "^src/large/"], externals=["@pkg/s2"])]
    return fam.import_violations(V.observed(spark, d), rule_table(spark, rules))


@query(f"""WITH {VEDGES} SELECT src, count(*) AS n_edges, count(DISTINCT dst) AS n_targets FROM vedges WHERE regexp_matches(src, '^src/(economy|small)/') GROUP BY src""")
def rules_selecting_importers(spark, d):
    rules = rule_table(spark, [ImportRule("sel", "", ["^src/(economy|small)/"])])
    picked = fam.rules_selecting(V.edges(spark, d), rules, "src")
    return picked.groupBy("src").agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_targets"))


# -- exports, members, surface -----------------------------------------------------------------------------------------


@query(
    f"""WITH {VBINDINGS} SELECT 'export' AS kind, 'no-size' AS rule_name, 's' AS message, path AS file, target_path || '#' || symbol AS subject FROM vbindings
WHERE regexp_matches(path, '^src/(economy|promo)/') AND kind = 'default' AND symbol IN ('size1', 'size3')"""
)
def export_symbol_restriction(spark, d):
    rules = [ExportRule("no-size", "s", ["^src/(economy|promo)/"], symbols=["size1", "size3"], kinds=["default"])]
    return fam.export_violations(V.bindings(spark, d), rule_table(spark, rules))


@query(
    f"""WITH {VBINDINGS} SELECT 'export' AS kind, 'whole' AS rule_name, 'w' AS message, path AS file, target_path || '#' || string_agg(symbol, ',' ORDER BY bind_ord) AS subject FROM vbindings
WHERE regexp_matches(path, '^src/') AND regexp_matches(target_path, '^src/(small|large)/') GROUP BY path, target_path"""
)
def export_grouped_fix(spark, d):
    rules = [ExportRule("whole", "w", ["^src/"], [], ["^src/(small|large)/"], kinds=["named", "default"], fix="namespace")]
    return fam.export_violations(V.bindings(spark, d), rule_table(spark, rules))


def _members(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.concat(F.lit("src/u"), (F.col("user_id") % 20).cast("string"), F.lit("/e"), F.col("event_id").cast("string"), F.lit(".ts")).alias("path"), F.when(F.col("event_id") % 3 == 0, "calls").otherwise("members").alias("subject"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Shape"), (F.col("user_id") % 7).cast("string"))).alias("in_decl"), F.when(F.col("event_id") % 2 == 0, "interface").otherwise("class").alias("declares"))


MEMBERS_SQL = """vm AS (SELECT 'src/u' || (user_id % 20) || '/e' || event_id || '.ts' AS path, CASE WHEN event_id % 3 = 0 THEN 'calls' ELSE 'members' END AS subject, event_type AS name,
CASE WHEN event_id % 5 <> 0 THEN 'Shape' || (user_id % 7) END AS in_decl, CASE WHEN event_id % 2 = 0 THEN 'interface' ELSE 'class' END AS declares FROM events)"""


@query(
    f"""WITH {MEMBERS_SQL} SELECT 'member' AS kind, 'vocabulary' AS rule_name, 'v' AS message, path AS file, name AS subject FROM vm
WHERE regexp_matches(path, '^src/u1') AND subject = 'members' AND in_decl IS NOT NULL AND regexp_matches(in_decl, 'Shape[0-4]$') AND declares = 'interface' AND NOT regexp_matches(name, '^(view|click)$')
UNION ALL SELECT 'member', 'no-error-calls', 'c', path, name FROM vm WHERE NOT regexp_matches(path, '^src/u2/') AND subject = 'calls' AND regexp_matches(name, 'err')"""
)
def member_vocabulary(spark, d):
    rules = [MemberRule("vocabulary", "v", ["^src/u1"], in_=["Shape[0-4]$"], declares=["interface"], allow=["^(view|click)$"]), MemberRule("no-error-calls", "c", ["^src/"], ["^src/u2/"], subject="calls", match=["err"])]
    return fam.member_violations(_members(spark, d), rule_table(spark, rules))


def _surface(spark, d, *rules):
    return fam.surface_violations(V.files(spark, d), V.surface_sites(spark, d), rule_table(spark, list(rules)))


@query(f"""WITH {VSITES} SELECT 'surface' AS kind, 'no-reexport' AS rule_name, 'r' AS message, path AS file, name AS subject FROM vsites WHERE regexp_matches(path, '^src/(small|promo)/') AND reexport AND kind = 'named'""")
def surface_forbid(spark, d):
    return _surface(spark, d, SurfaceRule("no-reexport", "r", ["^src/(small|promo)/"], kinds=["named"], reexport=True))


@query(f"""WITH {VSITES} SELECT 'surface' AS kind, 'only' AS rule_name, 'a' AS message, path AS file, name AS subject FROM vsites WHERE regexp_matches(path, '^src/large/') AND NOT regexp_matches(name, '^N')""")
def surface_allow(spark, d):
    return _surface(spark, d, SurfaceRule("only", "a", ["^src/large/"], demand="allow", allow=["^N"]))


@query(f"""WITH {VSITES} SELECT 'surface' AS kind, 'named' AS rule_name, 'n' AS message, path AS file, name AS subject FROM vsites WHERE regexp_matches(path, '^src/medium/') AND NOT regexp_matches(name, '^A') AND NOT regexp_matches(name, '^[A-Z]o$')""")
def surface_convention(spark, d):
    return _surface(spark, d, SurfaceRule("named", "n", ["^src/medium/"], match_not=["^A"], demand="convention", convention="^[A-Z]o$"))


@query(
    f"""WITH {VSITES} SELECT 'surface' AS kind, 'some' AS rule_name, 'c' AS message, f.path AS file, NULL::VARCHAR AS subject FROM vfiles f LEFT JOIN vsites s ON f.path = s.path AND kind = 'named'
WHERE regexp_matches(f.path, '^src/(economy|standard)/') GROUP BY f.path HAVING count(s.path) < 2 OR count(s.path) > 2"""
)
def surface_count(spark, d):
    return _surface(spark, d, SurfaceRule("some", "c", ["^src/(economy|standard)/"], kinds=["named"], demand="count", least=2, most=2))


# -- structure ---------------------------------------------------------------------------------------------------------

STRUCTURE_FOLDERS = [FolderRule("brand-1x", "f", ["/brand-1[0-9]*$"], [r"^(red|blue)-"]), FolderRule("brand-12", "g", ["/brand-12$"], [r"^hot-"]), FolderRule("open", "o", ["^src/promo/"], [M.OPEN_LAYOUT])]
FOLDERS_SQL = """CASE WHEN regexp_matches(folder, '/brand-1[0-9]*$') THEN 1 ELSE 0 END AS g1, CASE WHEN regexp_matches(folder, '/brand-12$') THEN 1 ELSE 0 END AS g2, CASE WHEN regexp_matches(folder, '^src/promo/') THEN 1 ELSE 0 END AS g3"""
VPARTS = VFILES + """, vparts AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS base FROM vfiles)"""


@query(
    f"""WITH {VPARTS}, w AS (SELECT path, folder || '/' || regexp_replace(base, '\\.[^.]*$', '') || '.test.ts' AS s FROM vparts WHERE regexp_matches(path, '/(hot|cold)-') AND NOT regexp_matches(path, '^src/promo/')
UNION ALL SELECT path, regexp_replace(folder, '/[^/]*$', '') || '/index.ts' FROM vparts WHERE regexp_matches(path, '/(hot|cold)-') AND NOT regexp_matches(path, '^src/promo/'))
SELECT 'structure' AS kind, 'tested' AS rule_name, 'p' AS message, path AS file, s AS subject FROM w WHERE s NOT IN (SELECT path FROM vfiles)"""
)
def structure_parity(spark, d):
    f = V.files(spark, d)
    return fam.parity_violations(f, f, rule_table(spark, [ParityRule("tested", "p", ["/(hot|cold)-"], ["^src/promo/"], ["{base}.test.ts", "../index.ts"])]))


@query(
    f"""WITH {VFILES} SELECT 'structure' AS kind, 'digits' AS rule_name, 'n' AS message, path AS file, regexp_extract(path, '/brand-([0-9]+)/.*\\.([0-9]+)\\.ts$', 2) AS subject FROM vfiles
WHERE regexp_extract(path, '/brand-([0-9]+)/.*\\.([0-9]+)\\.ts$', 1) <> regexp_extract(path, '/brand-([0-9]+)/.*\\.([0-9]+)\\.ts$', 2) AND NOT regexp_matches(path, '/old-')
UNION ALL SELECT 'structure', 'kebab', 'k', path, regexp_extract(path, '/([^/]*)\\.[0-9]+\\.ts$', 1) FROM vfiles WHERE NOT regexp_matches(regexp_extract(path, '/([^/]*)\\.[0-9]+\\.ts$', 1), '^(red|blue|new)-[a-z]+$')"""
)
def structure_naming(spark, d):
    rules = [NamingRule("digits", "n", [r"/brand-([0-9]+)/.*\.([0-9]+)\.ts$"], ["/old-"], subject=2, same_as=1), NamingRule("kebab", "k", [r"/([^/]*)\.[0-9]+\.ts$"], [], subject=1, convention="^(red|blue|new)-[a-z]+$")]
    return fam.naming_violations(V.files(spark, d), rule_table(spark, rules))


@query(
    f"""WITH {VPARTS}, g AS (SELECT *, {FOLDERS_SQL} FROM vparts)
SELECT 'structure' AS kind, CASE WHEN g1 = 1 THEN 'brand-1x' WHEN g2 = 1 THEN 'brand-12' ELSE 'open' END AS rule_name, CASE WHEN g1 = 1 THEN 'f' WHEN g2 = 1 THEN 'g' ELSE 'o' END AS message, path AS file, base AS subject FROM g
WHERE g1 + g2 + g3 > 0 AND NOT (g1 = 1 AND regexp_matches(base, '^(red|blue)-') OR g2 = 1 AND regexp_matches(base, '^hot-') OR g3 = 1)"""
)
def structure_layout(spark, d):
    return fam.layout_violations(V.files(spark, d), rule_table(spark, STRUCTURE_FOLDERS))


@query(
    f"""WITH {VPARTS}, g AS (SELECT *, {FOLDERS_SQL} FROM vparts)
SELECT 'structure' AS kind, CASE WHEN regexp_matches(path, '^src/small/') THEN 'small-root' ELSE 'root' END AS rule_name, 'r' AS message, path AS file, folder AS subject FROM g WHERE g1 + g2 + g3 = 0 AND regexp_matches(path, '^src/small/|^src/(large|small)/')"""
)
def structure_roots(spark, d):
    return fam.root_violations(V.files(spark, d), rule_table(spark, STRUCTURE_FOLDERS), rule_table(spark, [RootRule("small-root", "r", ["^src/small/"]), RootRule("root", "r", ["^src/(large|small)/"])]))


@query(
    f"""WITH {VEDGES} SELECT kind, rule_name, count(*) AS n FROM (
SELECT 'import' AS kind, 'economy-stays-home' AS rule_name FROM vedges WHERE regexp_matches(src, '^src/economy/') AND NOT regexp_matches(dst, '^src/economy/|^src/standard/')
UNION ALL SELECT 'import', 'small-allowlist' FROM vedges WHERE regexp_matches(src, '^src/small/(brand-[12])/') AND NOT regexp_matches(src, '/hot-') AND NOT regexp_matches(dst, '^src/(small|medium)/|^src/large/brand-1')
UNION ALL SELECT 'orphan', 'orphans' FROM vfiles WHERE regexp_matches(path, '^src/(small|large)/') AND path NOT IN (SELECT dst FROM vedges)) GROUP BY 1, 2"""
)
def findings_union(spark, d):
    found = fam.findings([import_allowlist_violations(spark, d), _orphans(spark, d, ["^src/(small|large)/"])])
    return found.groupBy("kind", "rule_name").agg(F.count("*").alias("n"))


@query(
    f"""WITH {VFILES}, one AS (SELECT path FROM vfiles WHERE id = 7) SELECT path, 'import' AS family, r AS rule_name, o AS ord FROM one, (VALUES ('economy-stays-home', 0, '^src/economy/'), ('all', 1, '^src/')) t(r, o, p) WHERE regexp_matches(path, p)"""
)
def explain_file(spark, d):
    path = V.files(spark, d).filter("id = 7").select("path").first()[0]
    return fam.explain(path, {"import": rule_table(spark, [IMPORTS[0], ImportRule("all", "", ["^src/"])])})


# -- baselines ---------------------------------------------------------------------------------------------------------

BASE_SQL = f"""WITH {VEDGES}, v AS (SELECT 'import|leaves-type|' || src || '|' || dst AS entry, src FROM vedges WHERE regexp_extract(src, '^src/([^/]+)/', 1) <> regexp_extract(dst, '^src/([^/]+)/', 1)),
base AS (SELECT DISTINCT entry FROM v WHERE regexp_matches(src, '^src/(economy|small|large)/') UNION ALL SELECT 'import|leaves-type|' || path || '|gone' FROM vfiles WHERE id % 100 = 3)"""


def _leaves(spark, d):
    rules = [ImportRule("leaves-type", "t", ["^src/([^/]+)/"], [], [], ["^src/$1/"])]
    return fam.import_violations(V.observed(spark, d).filter("target_kind = 'local'"), rule_table(spark, rules))


def _baseline(spark, d, found):
    held = M.baseline_of(found.filter(F.col("file").rlike("^src/(economy|small|large)/")))
    gone = V.files(spark, d).filter("id % 100 = 3").select(F.concat(F.lit("import|leaves-type|"), "path", F.lit("|gone")).alias("entry"))
    return held.unionByName(gone)


@query(BASE_SQL + " SELECT entry, src AS file FROM v WHERE entry NOT IN (SELECT entry FROM base)")
def baseline_new(spark, d):
    found = _leaves(spark, d)
    return M.unbaselined(found, _baseline(spark, d, found)).select("entry", "file")


@query(BASE_SQL + " SELECT entry FROM base WHERE entry NOT IN (SELECT entry FROM v)")
def baseline_stale(spark, d):
    found = _leaves(spark, d)
    return M.stale_entries(found, _baseline(spark, d, found))


@query(BASE_SQL + " SELECT entry IN (SELECT entry FROM base) AS baselined, count(*) AS n FROM v GROUP BY 1")
def baseline_flagged(spark, d):
    found = _leaves(spark, d)
    return M.flagged(found, _baseline(spark, d, found)).groupBy("baselined").agg(F.count("*").alias("n"))


@query(BASE_SQL + " SELECT DISTINCT entry FROM v")
def baseline_entries(spark, d):
    return M.baseline_of(_leaves(spark, d))


# -- measures ----------------------------------------------------------------------------------------------------------

REACH_SQL = f"""WITH {VPARTS}, g AS (SELECT *, {FOLDERS_SQL} FROM vparts), reach AS (SELECT path, regexp_matches(path, '^src/economy/') OR regexp_matches(path, '^src/small/(brand-[12])/') AND NOT regexp_matches(path, '/hot-') OR regexp_matches(path, '^src/promo/brand-99/') AS imports,
regexp_matches(path, '^src/large/brand-2') AS members, regexp_matches(path, '/new-') AS surface, regexp_matches(path, '^src/medium/') AND NOT regexp_matches(path, '/old-') AS graph,
CASE WHEN g1 + g2 + g3 = 0 THEN NULL WHEN g1 + g2 = 0 THEN 'open' ELSE 'enumerated' END AS structure FROM g), residue AS (SELECT path FROM reach WHERE NOT imports AND NOT members AND NOT surface AND NOT graph AND coalesce(structure, '') <> 'enumerated')"""


def _reach(spark, d):
    rules = lambda x: rule_table(spark, x)
    return M.reach_of(V.files(spark, d), rules(IMPORTS), rules(STRUCTURE_FOLDERS), rules([MemberRule("m", "", ["^src/large/brand-2"])]), rules([SurfaceRule("s", "", ["/new-"])]), rules([GraphRule("g", "", ["^src/medium/"], ["/old-"])]))


@query(REACH_SQL + """ SELECT family, covered, total, covered / total AS share FROM (SELECT unnest([{'f': 'graph', 'c': count_if(graph)}, {'f': 'imports', 'c': count_if(imports)}, {'f': 'members', 'c': count_if(members)}, {'f': 'structure', 'c': count_if(structure = 'enumerated')}, {'f': 'surface', 'c': count_if(surface)}]) AS x, count(*) AS total, x.f AS family, x.c::BIGINT AS covered FROM reach)""".replace("SELECT family, covered, total, covered / total AS share FROM (SELECT unnest", "SELECT x.f AS family, x.c::BIGINT AS covered, total, x.c / total AS share FROM (SELECT unnest").replace(", x.f AS family, x.c::BIGINT AS covered FROM reach", " FROM reach"))
def coverage_by_family(spark, d):
    return M.coverage_of(_reach(spark, d))


@query(REACH_SQL + " SELECT path, imports, members, surface, graph, structure FROM reach")
def reach_of_files(spark, d):
    return _reach(spark, d)


@query(REACH_SQL + " SELECT path FROM residue")
def residue_files(spark, d):
    return M.residue_files(_reach(spark, d))


@query(
    REACH_SQL
    + """, anc AS (SELECT path, unnest(['src', regexp_extract(path, '^(src/[^/]+)/', 1), regexp_extract(path, '^(.*)/', 1)]) AS folder FROM vfiles), w AS (SELECT folder, count(*) AS n, count(r.path) AS own FROM anc LEFT JOIN residue r USING (path) GROUP BY folder),
whole AS (SELECT folder FROM w WHERE n = own) SELECT folder FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE a.folder LIKE b.folder || '/%')"""
)
def residue_folders(spark, d):
    return M.folders_wholly_in(M.residue_files(_reach(spark, d)), V.files(spark, d))


LIVE_SQL = """live AS (SELECT count_if(regexp_matches(path, '^src/economy/')) > 0 AS e, count_if(regexp_matches(path, '^src/small/(brand-[12])/') AND NOT regexp_matches(path, '/hot-')) > 0 AS s, count_if(regexp_matches(path, '^src/promo/brand-99/')) > 0 AS p FROM vfiles)"""


@query(f"""WITH {VFILES}, {LIVE_SQL} SELECT node, allowances FROM live, (VALUES ('economy', 3::BIGINT), ('small', 2), ('medium', 1), ('promo', 2)) t(node, allowances) WHERE NOT CASE WHEN node = 'economy' THEN e WHEN node = 'promo' THEN p ELSE s END""")
def vacancy(spark, d):
    return M.vacant_nodes(V.files(spark, d), rule_table(spark, IMPORTS), allowance_table(spark, IMPORTS))


SLACK_SQL = f"""WITH {VOBSERVED}, sel AS (SELECT *, regexp_extract(path, '^src/small/(brand-[12])/', 1) AS c1 FROM vobserved), u AS (
SELECT 'economy' AS node, 'allow' AS allow_kind, 'economy' AS entry FROM sel WHERE regexp_matches(path, '^src/economy/') AND regexp_matches(target_path, '^src/economy/')
UNION SELECT 'economy', 'allow', 'standard' FROM sel WHERE regexp_matches(path, '^src/economy/') AND regexp_matches(target_path, '^src/standard/')
UNION SELECT 'economy', 'external', '@pkg/s1' FROM sel WHERE regexp_matches(path, '^src/economy/') AND target_package = '@pkg/s1'
UNION SELECT n, 'allow', 'own' FROM sel, (VALUES ('small'), ('medium')) t(n) WHERE c1 <> '' AND NOT regexp_matches(path, '/hot-') AND regexp_matches(target_path, '^src/small/' || regexp_escape(c1) || '/')
UNION SELECT 'small', 'allow', 'large' FROM sel WHERE c1 <> '' AND NOT regexp_matches(path, '/hot-') AND regexp_matches(target_path, '^src/large/brand-99/')),
{LIVE_SQL}, decl(place, is_fragment, allow_kind, entry, node) AS (VALUES ('economy', false, 'allow', 'economy', 'economy'), ('economy', false, 'allow', 'standard', 'economy'), ('economy', false, 'external', '@pkg/s1', 'economy'), ('shared', true, 'allow', 'own', 'small'), ('shared', true, 'allow', 'own', 'medium'), ('small', false, 'allow', 'large', 'small')),
s AS (SELECT place, is_fragment, allow_kind, entry, count(DISTINCT u.node) AS used_at, count(DISTINCT decl.node) AS "of" FROM live, decl LEFT JOIN u USING (node, allow_kind, entry) WHERE CASE WHEN node = 'economy' THEN e ELSE s END GROUP BY 1, 2, 3, 4)"""


def _slack(spark, d):
    return M.slack_of(V.files(spark, d), V.observed(spark, d), rule_table(spark, IMPORTS), allowance_table(spark, IMPORTS))


@query(SLACK_SQL + ' SELECT place, is_fragment, allow_kind, entry, used_at, "of" FROM s WHERE used_at = 0')
def slack(spark, d):
    return _slack(spark, d).filter("used_at = 0")


@query(SLACK_SQL + ' SELECT place, is_fragment, allow_kind, entry, used_at, "of", used_at * 2 < "of" AS concentrated FROM s')
def concentration(spark, d):
    return _slack(spark, d).withColumn("concentrated", M.is_concentrated())


@query(
    REACH_SQL
    + """, c AS (SELECT count_if(imports) / count(*) AS imports, count_if(members) / count(*) AS members, count_if(graph) / count(*) AS graph FROM reach), l(family, "limit", tolerance) AS (VALUES ('imports', 0.5::DOUBLE, 0.0::DOUBLE), ('members', 0.01, 0.005), ('graph', 0.14, 0.1)),
v AS (SELECT 'imports' AS family, imports AS share FROM c UNION ALL SELECT 'members', members FROM c UNION ALL SELECT 'graph', graph FROM c)
SELECT family, share, CASE WHEN "limit" - share > tolerance THEN 'breached' WHEN share - "limit" > tolerance THEN 'surpassed' ELSE 'within' END AS standing FROM v JOIN l USING (family)"""
)
def limit_standing(spark, d):
    limits = spark.createDataFrame([("imports", 0.5, 0.0), ("members", 0.01, 0.005), ("graph", 0.14, 0.1)], "family string, limit double, tolerance double")
    rows = M.coverage_of(_reach(spark, d)).join(F.broadcast(limits), "family")
    return rows.select("family", "share", M.standing(F.lit("up"), F.col("limit"), F.col("tolerance"), F.col("share")).alias("standing"))


@query(REACH_SQL + """, c AS (SELECT count_if(imports) / count(*) AS a FROM reach) SELECT 'imports' AS family, a AS actual, 0.9::DOUBLE AS floor FROM c WHERE a < 0.9""")
def coverage_shortfalls(spark, d):
    return M.shortfalls(M.coverage_of(_reach(spark, d)), {"imports": 0.9, "members": 0.0001})


# -- graph -------------------------------------------------------------------------------------------------------------


def _nodes(spark, d):
    return V.files(spark, d).select(F.col("path").alias("node"))


def _orphans(spark, d, within):
    return G.orphan_violations(_nodes(spark, d), V.edges(spark, d), "orphans", "nobody imports it", within)


@query(f"WITH {VEDGES} SELECT src, dst FROM vedges")
def graph_edges(spark, d):
    t = V.observed(spark, d).select("path", "target_path", "target_kind")
    return G.edges_of(V.files(spark, d), t)


@query(f"""WITH {VEDGES} SELECT 'orphan' AS kind, 'orphans' AS rule_name, 'nobody imports it' AS message, path AS file, NULL::VARCHAR AS subject FROM vfiles WHERE regexp_matches(path, '^src/(small|large|promo)/') AND path NOT IN (SELECT dst FROM vedges)""")
def graph_orphans(spark, d):
    return _orphans(spark, d, ["^src/(small|large|promo)/"])


CLOSURE = f"""WITH RECURSIVE {VEDGES}, reach(origin, node) AS (SELECT src, dst FROM vedges UNION SELECT r.origin, e.dst FROM reach r JOIN vedges e ON r.node = e.src)"""


@query(
    f"""WITH RECURSIVE {VEDGES}, open_edges AS (SELECT src, dst FROM vedges WHERE NOT regexp_matches(dst, '/hot-')), reach(origin, node) AS (SELECT src, dst FROM open_edges WHERE regexp_matches(src, '^src/(economy|small)/') UNION SELECT r.origin, e.dst FROM reach r JOIN open_edges e ON r.node = e.src)
SELECT origin, node FROM reach WHERE origin <> node AND regexp_matches(node, '^src/(large|promo)/')"""
)
def graph_reach_pairs(spark, d):
    found = G.reach(V.edges(spark, d), _nodes(spark, d).filter(F.col("node").rlike("^src/(economy|small)/")).select(F.col("node").alias("origin")), ["/hot-"])
    return found.filter(F.col("node").rlike("^src/(large|promo)/")).select("origin", "node")


@query(
    f"""WITH RECURSIVE {VEDGES}, reach(origin, node, hops) AS (SELECT src, dst, 1 FROM vedges WHERE regexp_matches(src, '/red-') AND src <> dst UNION SELECT r.origin, e.dst, r.hops + 1 FROM reach r JOIN vedges e ON r.node = e.src WHERE r.hops < 60)
SELECT origin, node, min(hops)::INT AS hops FROM reach WHERE origin <> node GROUP BY 1, 2"""
)
def graph_reach_hops(spark, d):
    origins = _nodes(spark, d).filter(F.col("node").rlike("/red-")).select(F.col("node").alias("origin"))
    return G.reach(V.edges(spark, d), origins).select("origin", "node", "hops")


@query()
def graph_reach_route(spark, d):
    return G.reach_violations(_nodes(spark, d), V.edges(spark, d), "no-reach", "reaches", ["^src/economy/"], ["^src/large/"], ["/hot-"])


@query(
    CLOSURE
    + """, m AS (SELECT a.origin AS node, least(a.origin, min(a.node)) AS comp FROM reach a JOIN reach b ON a.origin = b.node AND a.node = b.origin GROUP BY a.origin)
SELECT 'cycle' AS kind, 'cycles' AS rule_name, 'cyclic' AS message, comp AS file, string_agg(node, ' ↔ ' ORDER BY node) AS subject FROM m GROUP BY comp"""
)
def graph_cycles(spark, d):
    return G.cycle_violations(_nodes(spark, d), V.edges(spark, d), "cycles", "cyclic", ["^src/"])


HEIGHTS = (
    CLOSURE
    + """, m AS (SELECT a.origin AS node, least(a.origin, min(a.node)) AS comp FROM reach a JOIN reach b ON a.origin = b.node AND a.node = b.origin GROUP BY a.origin), c AS (SELECT path AS node, coalesce(comp, path) AS comp FROM vfiles LEFT JOIN m ON path = node),
dag AS (SELECT DISTINCT x.comp AS a, y.comp AS b FROM vedges JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.comp <> y.comp), walk(comp, h) AS (SELECT DISTINCT comp, 0 FROM c UNION SELECT dag.a, walk.h + 1 FROM walk JOIN dag ON dag.b = walk.comp),
heights AS (SELECT node, max(h)::INT AS height FROM c JOIN walk USING (comp) GROUP BY node)"""
)


@query(HEIGHTS + " SELECT node, height FROM heights")
def graph_height(spark, d):
    return G.heights(_nodes(spark, d), V.edges(spark, d))


@query(
    HEIGHTS
    + """, v AS (SELECT 'import' AS kind, 'economy-stays-home' AS rule_name, '{name} is outside' AS message, src AS file, dst AS subject FROM vedges WHERE regexp_matches(src, '^src/economy/') AND NOT regexp_matches(dst, '^src/economy/|^src/standard/')
UNION ALL SELECT 'import', 'small-allowlist', 'no', src, dst FROM vedges WHERE regexp_matches(src, '^src/small/(brand-[12])/') AND NOT regexp_matches(src, '/hot-') AND NOT regexp_matches(dst, '^src/(small|medium)/|^src/large/brand-1'))
SELECT coalesce(s.height, f.height, 0) AS height, concat_ws('|', kind, rule_name, file, subject) AS fingerprint, kind, rule_name, message, file, subject FROM v LEFT JOIN heights s ON s.node = subject LEFT JOIN heights f ON f.node = file"""
)
def violations_by_height(spark, d):
    return G.by_height(import_allowlist_violations(spark, d), G.heights(_nodes(spark, d), V.edges(spark, d)))


# -- detectors ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {VCONTENT} SELECT path FROM vcontent WHERE regexp_matches(path, '^src/src[0-9]/') AND (regexp_matches(text, '(?m)^Of') OR regexp_matches(text, '(?m)token = ')) AND NOT doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"""
)
def detector_file(spark, d):
    docs = V.contents(spark, d)
    bad = V.table(spark, d, "labels").filter("quality = 0").select("doc_id").distinct().join(docs.select("doc_id", "path"), "doc_id").select("path", F.lit("").alias("key"), F.lit(None).cast("string").alias("anchor"))
    tree = D.all_of(D.Term("path", file=["^src/src[0-9]/"]), D.any_of(D.Term("content", pattern="^Of"), D.Term("content", pattern="token = ")), D.none_of(D.Term("report", rows=bad)))
    return D.file_hits(docs.select("path", "text"), tree)


@query(
    f"""WITH {MEMBERS_SQL}, f AS (SELECT DISTINCT regexp_extract(path, '^(src/u[0-9]+/e[0-9]{{1,2}})', 1) || '.ts' AS path FROM vm), m AS (SELECT DISTINCT regexp_extract(path, '^(src/u[0-9]+/e[0-9]{{1,2}})', 1) || '.ts' AS path, name, in_decl FROM vm WHERE in_decl IS NOT NULL)
SELECT DISTINCT path, in_decl AS key FROM m a WHERE name = 'error' AND NOT regexp_matches(path, 'u3') AND NOT EXISTS (SELECT 1 FROM m b WHERE b.path = a.path AND b.in_decl = a.in_decl AND b.name = 'signup')"""
)
def detector_declaration(spark, d):
    m = _members(spark, d).filter("in_decl is not null").select(F.concat(F.regexp_extract("path", "^(src/u[0-9]+/e[0-9]{1,2})", 1), F.lit(".ts")).alias("path"), "name", F.col("in_decl").alias("key")).distinct().withColumn("anchor", F.col("key"))
    files = m.select("path").distinct().withColumn("text", F.lit(""))
    leaf = lambda n: D.Term("members", rows=m.filter(F.col("name") == n).select("path", "key", "anchor"), level="declaration")
    return D.candidates(files, D.all_of(D.Term("path", file_not=["u3"]), leaf("error"), D.none_of(leaf("signup"))), "declaration").select("path", "key")


@query(
    f"""WITH {VCONTENT}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM vcontent)
SELECT path, 'line' || pos AS key FROM l WHERE regexp_matches(path, '/(en|de)/') AND contains(row, 'token = ') AND NOT contains(row, '@')"""
)
def detector_match(spark, d):
    docs = V.contents(spark, d).select("path", "text")
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "row")).select("path", F.concat(F.lit("line"), (F.col("pos") + 1).cast("string")).alias("key"), F.lit(None).cast("string").alias("anchor"), "row")
    leaf = lambda s: D.Term("syntax", rows=lines.filter(F.col("row").contains(s)).drop("row"), level="match")
    return D.candidates(docs, D.all_of(D.Term("path", file=["/(en|de)/"]), leaf("token = "), D.none_of(leaf("@"))), "match").select("path", "key")


@query(
    f"""WITH {VCONTENT} SELECT leaf, kind, count_if(holds)::BIGINT AS n FROM (SELECT 0 AS leaf, 'path' AS kind, regexp_matches(path, '/fr/') AS holds FROM vcontent UNION ALL SELECT 1, 'content', regexp_matches(text, '(?m)[0-9]{{4}}$') FROM vcontent) GROUP BY 1, 2"""
)
def detector_truth_table(spark, d):
    tree = D.any_of(D.Term("path", file=["/fr/"]), D.Term("content", pattern="[0-9]{4}$"))
    return D.truth_table(V.contents(spark, d).select("path", "text"), tree).groupBy("leaf", "kind").agg(F.count_if("holds").alias("n"))


@query(
    f"""WITH {VCONTENT}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM vcontent), n AS (SELECT path, row, pos, row_number() OVER (PARTITION BY path, row ORDER BY pos) AS k FROM l)
SELECT path, (pos - 1)::INT AS pos, CASE WHEN k > 1 THEN row || '~' || k ELSE row END AS unique_key FROM n"""
)
def match_ordinals(spark, d):
    lines = V.contents(spark, d).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "row"))
    return D.unique_keys(lines, ["path"], "row", ["pos"]).select("path", "pos", "unique_key")


@query()
def content_hashes(spark, d):
    return V.contents(spark, d).select("path", ft.fnv1a(F.col("text")).alias("digest"))


@query(f"""WITH RECURSIVE {VFILES}, h(path, i, v) AS (SELECT path, 0, 2166136261::HUGEINT FROM vfiles UNION ALL SELECT path, i + 1, (xor(v::BIGINT, ascii(path[i + 1])::BIGINT)::HUGEINT * 16777619) % 4294967296 FROM h WHERE i < length(path))
SELECT path, lower(lpad(printf('%x', v::BIGINT), 8, '0')) AS digest FROM h WHERE i = length(path)""")
def path_hashes(spark, d):
    return V.files(spark, d).select("path", ft.fnv1a_ascii(F.col("path")).alias("digest"))


# -- scalars -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {VCONTENT} SELECT source, sum(len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\\S'))))::BIGINT AS lines, count(*) AS files FROM vcontent GROUP BY source""")
def measure_lines(spark, d):
    return V.contents(spark, d).groupBy("source").agg(F.sum(ft.non_blank_lines(F.col("text"))).alias("lines"), F.count("*").alias("files"))


@query(
    f"""WITH {VCONTENT}, p AS (SELECT lang, count_if(contains(text, '@'))::DOUBLE AS "of", count(*)::DOUBLE AS per FROM vcontent GROUP BY lang) SELECT lang, floor((CASE WHEN per = 0 THEN 0 ELSE 100 * "of" / per END) * 1e6 + 0.5) / 1e6 AS value, greatest(0.0, floor((floor((100 * "of" / per) * 1e6 + 0.5) / 1e6 - 5.0) * 1e6 + 0.5) / 1e6) AS distance FROM p"""
)
def measure_ratio(spark, d):
    p = V.contents(spark, d).groupBy("lang").agg(F.count_if(F.contains("text", F.lit("@"))).cast("double").alias("of"), F.count("*").cast("double").alias("per"))
    value = M.value_of_parts(F.col("of"), F.col("per"), F.lit(True), F.lit(100.0))
    return p.withColumn("value", value).select("lang", "value", M.distance_to_target(F.lit("down"), F.lit(5.0), F.col("value")).alias("distance"))


# -- sectors and phases ------------------------------------------------------------------------------------------------


@query(f"""WITH {VFILES} SELECT regexp_extract(path, '^src/[^/]+/brand-[0-9]+', 0) AS sector, count(*) AS files FROM vfiles WHERE regexp_matches(path, '^src/[^/]+/brand-[0-9]+') GROUP BY 1""")
def sectors_glob(spark, d):
    return C.glob_sectors(V.files(spark, d), "^src/[^/]+/brand-[0-9]+/").groupBy("sector").agg(F.count("*").alias("files"))


DRIFT_SQL = f"""WITH {VFILES}, claims AS (SELECT path, 'type-' || regexp_extract(path, '^src/([^/]+)/', 1) AS sector, 0 AS claim_ord FROM vfiles WHERE regexp_matches(path, '^src/(small|large)/') UNION ALL SELECT path, 'hot', 1 FROM vfiles WHERE regexp_matches(path, '/hot-'))"""


def _placed(spark, d):
    f = V.files(spark, d)
    a = f.filter(F.col("path").rlike("^src/(small|large)/")).select("path", F.concat(F.lit("type-"), F.regexp_extract("path", "^src/([^/]+)/", 1)).alias("sector"), F.lit(0).alias("claim_ord"))
    b = f.filter(F.col("path").rlike("/hot-")).select("path", F.lit("hot").alias("sector"), F.lit(1).alias("claim_ord"))
    return C.placed(a.unionByName(b), f, F.array(F.lit("^src/promo/")))


@query(DRIFT_SQL + " SELECT path, arg_min(sector, claim_ord) AS sector FROM claims GROUP BY path HAVING count(DISTINCT sector) > 1")
def sector_drift(spark, d):
    return _placed(spark, d).filter("drift").select("path", "sector")


@query(DRIFT_SQL + " SELECT path FROM vfiles WHERE regexp_matches(path, '^src/promo/') AND path NOT IN (SELECT path FROM claims)")
def sectors_legacy(spark, d):
    return _placed(spark, d).filter("in_legacy").select("path")


@query(
    f"""WITH {VFILES}, roots(root, sector) AS (VALUES ('src', 'all'), ('src/small', 'small'), ('src/small/brand-1', 'b1'), ('src/large/brand-2', 'b2')) SELECT path, arg_max(sector, length(root)) AS sector, arg_max(root, length(root)) AS root FROM vfiles JOIN roots ON path LIKE root || '/%' GROUP BY path"""
)
def sector_of_deleted(spark, d):
    roots = spark.createDataFrame([("src", "all"), ("src/small", "small"), ("src/small/brand-1", "b1"), ("src/large/brand-2", "b2")], "root string, sector string")
    return C.deepest(V.files(spark, d), F.broadcast(roots))


PHASES = [(0, "stop-errors", ["error"], False, False), (1, "agree", [], True, False), (2, "signups", ["signup"], False, False), (3, "open", [], False, True)]
OBJECTIVES = [("error", None), ("signup", "open"), ("click", "signups"), ("view", None)]
PHASE_SQL = """hits AS (SELECT user_id AS sector, event_type AS objective, count(*) AS n FROM events WHERE value > 60 GROUP BY 1, 2), pos AS (SELECT DISTINCT user_id AS sector, (user_id % 4)::INT AS reached, user_id % 3 = 0 AS agreed FROM events),
ph AS (SELECT sector, reached, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.sector = pos.sector AND objective = 'error') THEN 0 WHEN NOT agreed THEN 1 WHEN reached < 3 AND EXISTS (SELECT 1 FROM hits h WHERE h.sector = pos.sector AND objective = 'signup') THEN 2 ELSE 3 END AS phase_at FROM pos)"""


def _campaign(spark, d):
    e = V.table(spark, d, "events")
    phases = spark.createDataFrame(PHASES, "ord int, phase string, objectives array<string>, attested boolean, open boolean")
    objectives = spark.createDataFrame(OBJECTIVES, "objective string, until string")
    hits = e.filter("value > 60").groupBy(F.col("user_id").alias("sector"), F.col("event_type").alias("objective")).agg(F.count("*").alias("n"))
    agreed = F.when(F.col("sector") % 3 == 0, F.array(F.lit("agree"))).otherwise(F.array().cast("array<string>"))
    positions = e.select(F.col("user_id").alias("sector")).distinct().select("sector", (F.col("sector") % 4).cast("int").alias("reached"), agreed.alias("attested"))
    return phases, objectives, hits, positions


@query(f"WITH {PHASE_SQL} SELECT sector, phase_at FROM ph")
def phase_derivation(spark, d):
    phases, objectives, hits, positions = _campaign(spark, d)
    return C.derived_phase(positions, hits, phases, objectives)


@query(
    f"""WITH {PHASE_SQL}, w(objective, first, "end") AS (VALUES ('error', 0, 1073741824), ('signup', 2, 3), ('click', -1, 2), ('view', -1, 1073741824)) SELECT sector, objective, first, "end", phase_at FROM ph, w WHERE NOT ("end" < 1073741824 AND "end" <= reached) AND phase_at >= first AND phase_at < "end" """
)
def phase_residue(spark, d):
    phases, objectives, hits, positions = _campaign(spark, d)
    at = C.derived_phase(positions, hits, phases, objectives).join(positions.select("sector", "reached"), "sector")
    win = C.windows(objectives, phases).withColumn("over_shared", F.lit(False))
    return at.crossJoin(F.broadcast(win)).filter(C.in_window()).select("sector", "objective", "first", "end", "phase_at")


@query(
    """WITH s AS (SELECT DISTINCT user_id AS sector FROM events), o AS (SELECT DISTINCT event_type AS objective FROM events) SELECT sector, objective, count(e.event_id) AS n FROM s CROSS JOIN o LEFT JOIN events e ON e.user_id = sector AND e.event_type = objective AND e.value > 60 GROUP BY 1, 2"""
)
def tally_zero_filled(spark, d):
    e = V.table(spark, d, "events")
    hits = e.filter("value > 60").select(F.col("user_id").alias("sector"), F.col("event_type").alias("objective"))
    return C.tally(e.select(F.col("user_id").alias("sector")), e.select(F.col("event_type").alias("objective")).distinct(), hits)


# -- ledgers -----------------------------------------------------------------------------------------------------------

SNAP_SQL = """old AS (SELECT event_type AS objective, user_id AS sector, 'e' || event_id AS entry, event_id AS ord FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_id % 2 = 0), new AS (SELECT event_type AS objective, user_id AS sector, 'e' || event_id AS entry, event_id AS ord FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20' AND event_id % 3 <> 0)"""


def _snapshots(spark, d):
    e = V.table(spark, d, "events")
    rows = lambda x: x.select(F.col("event_type").alias("objective"), F.col("user_id").alias("sector"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry"), F.col("event_id").alias("ord"))
    at = F.col("ts").cast("timestamp_ntz")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows(e.filter((at < day("2024-01-16")) & (F.col("event_id") % 2 == 0))), rows(e.filter((at >= day("2024-01-08")) & (at < day("2024-01-20")) & (F.col("event_id") % 3 != 0)))


@query(
    f"""WITH {SNAP_SQL} SELECT objective, sector, entry, CASE WHEN o.entry IS NULL THEN 'unrecorded' WHEN n.entry IS NULL THEN 'stale' ELSE 'ledgered' END AS state FROM old o FULL JOIN new n USING (objective, sector, entry)"""
)
def ledger_reconcile(spark, d):
    old, new = _snapshots(spark, d)
    return C.reconcile(old, new).select("objective", "sector", "entry", "state")


MATCH_SQL = """m AS (SELECT 'f' || (user_id % 5) AS f, 'd' || (event_id % 4) AS a, event_type AS objective, user_id AS sector, event_id FROM events), mo AS (SELECT objective, sector, f || '#' || a || '#' || lpad(printf('%x', event_id % 97), 8, '0') AS entry, event_id AS ord FROM m WHERE event_id % 4 <> 1),
mn AS (SELECT objective, sector, f || '#' || a || '#' || lpad(printf('%x', (event_id + event_id % 2) % 97), 8, '0') AS entry, event_id AS ord FROM m WHERE event_id % 4 <> 2),
s0 AS (SELECT * FROM mo ANTI JOIN mn USING (objective, sector, entry)), f0 AS (SELECT * FROM mn ANTI JOIN mo USING (objective, sector, entry)),
sa AS (SELECT *, regexp_extract(entry, '^(.*)#', 1) AS k FROM s0), fa AS (SELECT *, regexp_extract(entry, '^(.*)#', 1) AS k FROM f0),
sb AS (SELECT *, row_number() OVER (PARTITION BY objective, sector, k ORDER BY ord, entry) AS rn FROM sa), fb AS (SELECT *, row_number() OVER (PARTITION BY objective, sector, k ORDER BY ord, entry) AS rn FROM fa),
p1 AS (SELECT objective, sector, fb.entry, fb.ord AS n, sb.entry AS was, sb.ord AS o FROM fb JOIN sb USING (objective, sector, k, rn)),
s1 AS (SELECT * FROM s0 WHERE (objective, sector, entry, ord) NOT IN (SELECT (objective, sector, was, o) FROM p1)), f1 AS (SELECT * FROM f0 WHERE (objective, sector, entry, ord) NOT IN (SELECT (objective, sector, entry, n) FROM p1)),
sc AS (SELECT *, regexp_extract(entry, '^([^#]*)#', 1) || regexp_extract(entry, '(#[^#]*)$', 1) AS k FROM s1), fc AS (SELECT *, regexp_extract(entry, '^([^#]*)#', 1) || regexp_extract(entry, '(#[^#]*)$', 1) AS k FROM f1),
sd AS (SELECT *, row_number() OVER (PARTITION BY objective, sector, k ORDER BY ord, entry) AS rn FROM sc), fd AS (SELECT *, row_number() OVER (PARTITION BY objective, sector, k ORDER BY ord, entry) AS rn FROM fc),
p2 AS (SELECT objective, sector, fd.entry, fd.ord AS n, sd.entry AS was, sd.ord AS o FROM fd JOIN sd USING (objective, sector, k, rn)),
s2 AS (SELECT * FROM s1 WHERE (objective, sector, entry, ord) NOT IN (SELECT (objective, sector, was, o) FROM p2)), f2 AS (SELECT * FROM f1 WHERE (objective, sector, entry, ord) NOT IN (SELECT (objective, sector, entry, n) FROM p2))"""


@query(
    f"""WITH {MATCH_SQL} SELECT objective, sector, entry, 'ledgered' AS state, NULL AS was FROM mn SEMI JOIN mo USING (objective, sector, entry) UNION ALL SELECT objective, sector, entry, 'drifted', was FROM p1 UNION ALL SELECT objective, sector, entry, 'drifted', was FROM p2
UNION ALL SELECT objective, sector, entry, 'unrecorded', NULL FROM f2 UNION ALL SELECT objective, sector, entry, 'stale', NULL FROM s2"""
)
def ledger_reconcile_match(spark, d):
    e = V.table(spark, d, "events")
    f, a = F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string"))
    row = lambda x, h: x.select(F.col("event_type").alias("objective"), F.col("user_id").alias("sector"), F.concat(f, F.lit("#"), a, F.lit("#"), F.lower(F.lpad(F.hex(h % 97), 8, "0"))).alias("entry"), F.col("event_id").alias("ord"))
    return C.reconcile(row(e.filter("event_id % 4 <> 1"), F.col("event_id")), row(e.filter("event_id % 4 <> 2"), F.col("event_id") + F.col("event_id") % 2), "match")


LEDGER_SQL = "WITH " + SNAP_SQL + """, sec AS (SELECT objective, sector, count(*)::DOUBLE AS initial, (sector % 3)::DOUBLE AS cleared, (sector % 2)::DOUBLE AS closed FROM old GROUP BY 1, 2), con AS (SELECT objective, sector, (sector % 3 + sector % 2)::DOUBLE AS delta FROM sec WHERE sector % 7 <> 0)"""


def _ledger(spark, d):
    old, _ = _snapshots(spark, d)
    sec = old.groupBy("objective", "sector").agg(F.count("*").cast("double").alias("initial")).withColumns({"cleared": (F.col("sector") % 3).cast("double"), "closed": (F.col("sector") % 2).cast("double")})
    con = sec.filter("sector % 7 <> 0").select("objective", "sector", (F.col("sector") % 3 + F.col("sector") % 2).cast("double").alias("delta"))
    return old, sec, con


@query(LEDGER_SQL + """ SELECT objective, sector, initial AS holdouts, initial + coalesce(delta, 0) - cleared - closed AS expected, initial = initial + coalesce(delta, 0) - cleared - closed AS holds FROM sec LEFT JOIN con USING (objective, sector)""")
def ledger_arithmetic(spark, d):
    old, sec, con = _ledger(spark, d)
    return C.arithmetic(sec, old, con)


@query(
    LEDGER_SQL
    + """, t AS (SELECT objective, sum(initial) + coalesce((SELECT sum(delta) FROM con c WHERE c.objective = sec.objective), 0) - sum(closed) AS total, sum(initial) AS n FROM sec GROUP BY objective) SELECT objective, CASE WHEN total <= 0 THEN 1.0 ELSE 1 - n / total END AS progress FROM t"""
)
def ledger_progress(spark, d):
    old, sec, con = _ledger(spark, d)
    return C.progress(sec, old, con)


@query(
    f"""WITH {SNAP_SQL}, r AS (SELECT objective, sector, count_if(o.entry IS NOT NULL AND n.entry IS NULL) AS gone, count_if(o.entry IS NOT NULL) AS held, count_if(o.entry IS NOT NULL AND n.entry IS NOT NULL) AS kept, count(n.entry) AS now FROM old o FULL JOIN new n USING (objective, sector, entry) GROUP BY 1, 2)
SELECT objective, sector, CASE WHEN held = 0 THEN now ELSE held END::DOUBLE AS initial, CASE WHEN held = 0 OR sector % 5 = 0 THEN 0 ELSE gone END::DOUBLE AS cleared, CASE WHEN held > 0 AND sector % 5 = 0 THEN held ELSE 0 END::DOUBLE AS closed, CASE WHEN held = 0 THEN now WHEN sector % 5 = 0 THEN 0 ELSE kept END::INT AS n_holdouts FROM r WHERE NOT (held = 0 AND sector % 5 = 0)"""
)
def ledger_clear(spark, d):
    old, new = _snapshots(spark, d)
    ledger = old.groupBy("objective", "sector").agg(F.count("*").cast("double").alias("initial"), F.array_sort(F.collect_list("entry")).alias("holdouts")).withColumns({"entered": F.lit("2024-01-01"), "cleared": F.lit(0.0), "closed": F.lit(0.0), "last_cleared": F.lit("2024-01-01")})
    outside = old.select("objective", "sector").unionByName(new.select("objective", "sector")).filter("sector % 5 = 0")
    out = C.cleared(ledger, C.reconcile(old, new), outside, "2024-01-20")
    return out.select("objective", "sector", "initial", "cleared", "closed", F.size("holdouts").alias("n_holdouts"))


@query(
    """WITH v AS (SELECT event_type AS objective, user_id AS sector, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS recorded, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS value FROM events GROUP BY 1, 2) SELECT objective, sector, CASE WHEN recorded IS NULL THEN 'unrecorded' WHEN value - recorded > 5 THEN 'breached' WHEN recorded - value > 5 THEN 'surpassed' ELSE 'within' END AS standing FROM v WHERE value IS NOT NULL"""
)
def measure_standing(spark, d):
    # sums of doubles depend on their order, which decides at a difference of just the tolerance: rows are added up by event_id
    order = Window.partitionBy("objective", "sector").orderBy("event_id", "value")
    pick = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = V.table(spark, d, "events").select(F.col("event_type").alias("objective"), F.col("user_id").alias("sector"), "event_id", "value")
    v = rows.select("objective", "sector", pick(0).alias("recorded"), pick(1).alias("value"), F.lead(F.lit(True)).over(order).alias("more")).filter("more is null and value is not null")
    v = v.withColumns({"closed": F.lit(None).cast("double"), "direction": F.lit("down")})
    return v.select("objective", "sector", C.measure_standing(v, F.lit(5.0)).alias("standing"))


@query(
    f"""WITH {SNAP_SQL}, a AS (SELECT objective, sector, count(*) AS n FROM old GROUP BY 1, 2), b AS (SELECT objective, sector, count(*) AS n FROM new GROUP BY 1, 2), j AS (SELECT sector, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now FROM a FULL JOIN b USING (objective, sector))
SELECT sector, CASE WHEN bool_or(now < was) AND bool_or(now > was) THEN 'mixed' WHEN bool_or(now < was) THEN 'forward' WHEN bool_or(now > was) THEN 'back' ELSE 'neutral' END AS direction FROM j GROUP BY sector"""
)
def residue_direction(spark, d):
    old, new = _snapshots(spark, d)
    n = lambda x: x.groupBy("objective", "sector").agg(F.count("*").alias("n"))
    return C.direction(n(old), n(new), ["sector"], ["objective"]).select("sector", "direction")


@query(
    """WITH c AS (SELECT event_type AS objective, max(CASE WHEN value > 60 THEN strftime(ts, '%Y-%m-%d') END) AS last_cleared, count_if(value > 100) AS n FROM events GROUP BY 1) SELECT objective, n > 0 AND date_diff('day', greatest(coalesce(last_cleared, '2024-01-01'), '2024-01-01')::DATE, DATE '2024-02-05') > 7 AS stalled FROM c"""
)
def ledger_stalled(spark, d):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    c = V.table(spark, d, "events").groupBy(F.col("event_type").alias("objective")).agg(F.max(F.when(F.col("value") > 60, day)).alias("last_cleared"), F.count_if(F.col("value") > 100).alias("n"))
    c = c.withColumns({"created": F.lit("2024-01-01"), "sector_clock": F.lit(None).cast("string")})
    return c.select("objective", C.stalled(c, 7 * 86_400_000, "2024-02-05").alias("stalled"))


@query(
    """WITH hits AS (SELECT l_suppkey % 10 AS sector, 'p' || l_partkey AS path, min(l_quantity)::INT AS start_line FROM lineitem GROUP BY 1, 2), hunks AS (SELECT 'p' || p_partkey AS path, p_size AS hunk_start, p_size + 2 AS hunk_end FROM part WHERE p_partkey % 2 = 0), r AS (SELECT sector, h.path AS entry, start_line, CASE WHEN hunk_end < start_line THEN start_line - hunk_end WHEN start_line + 1 < hunk_start THEN hunk_start - start_line - 1 ELSE 0 END AS distance FROM hits h JOIN hunks USING (path))
SELECT sector, entry, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY distance, entry) AS rank FROM r) WHERE rank <= 5"""
)
def nudge_top5(spark, d):
    li = V.table(spark, d, "lineitem")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    hits = li.groupBy((F.col("l_suppkey") % 10).alias("sector"), name("l_partkey").alias("path")).agg(F.min("l_quantity").cast("int").alias("start_line")).withColumns({"entry": F.col("path"), "end_line": F.col("start_line") + 1})
    hunks = V.table(spark, d, "part").filter("p_partkey % 2 = 0").select(name("p_partkey").alias("path"), F.col("p_size").alias("hunk_start"), (F.col("p_size") + 2).alias("hunk_end"))
    touched = hits.join(hunks.select("path"), "path", "left_semi")
    return C.nudged(touched, hunks, ["sector"]).select("sector", "entry", "distance", "rank")


KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT strftime(ts, '%Y-%m-%d') AS commit, " + ", ".join(f"count_if(event_type = '{k}')::BIGINT AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY 1")
def history_series(spark, d):
    c = V.table(spark, d, "events").groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("commit"), F.col("event_type").alias("objective")).agg(F.count("*").alias("n"))
    return C.history(c, list(KINDS))


@query(
    """WITH p AS (SELECT p_brand AS phase, count(*) AS n, max(p_size) AS top FROM part GROUP BY 1), r AS (SELECT * FROM p WHERE phase <> (SELECT max(phase) FROM p)), c AS (SELECT * FROM p WHERE phase <> (SELECT min(phase) FROM p))
SELECT coalesce(r.phase, c.phase) AS phase, CASE WHEN r.phase IS NULL THEN 'refined' WHEN r.n % 2 = 0 AND c.phase IS NULL THEN 'unreceipted' WHEN r.n % 2 = 0 AND c.n % 3 = 0 AND c.top % 2 = 1 THEN 'changed' WHEN r.n % 2 = 0 AND c.n % 3 = 0 THEN 'unreceipted' WHEN c.n % 3 = 0 THEN 'refined' END AS verdict
FROM r FULL JOIN c ON r.phase = c.phase WHERE verdict IS NOT NULL"""
)
def plan_diff(spark, d):
    """Brands as phases: the record lacks the last, the plan the first; every third asks something else, some with a receipt."""
    p = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("phase")).agg(F.count("*").alias("n"), F.max("p_size").alias("top"))
    low, high = p.agg(F.min("phase"), F.max("phase")).first()
    rows = p.select("phase", F.col("phase").alias("ord"), F.lit("h").alias("hash"), (F.col("n") % 2 == 0).alias("defined"), F.lit(0).alias("concessions"), "n", "top")
    now = rows.filter(F.col("phase") != low).withColumns({"hash": F.when(F.col("n") % 3 == 0, "other").otherwise("h"), "concessions": (F.col("top") % 2).cast("int")})
    return C.plan_diff(rows.filter(F.col("phase") != high).drop("n", "top"), now.drop("n", "top"))


@query(
    """WITH v AS (SELECT event_type AS objective, user_id AS sector, avg(CASE WHEN event_id % 3 = 0 THEN value END) AS initial, avg(CASE WHEN event_id % 3 = 1 THEN value END) AS recorded, avg(CASE WHEN event_id % 3 = 2 THEN value END) AS value FROM events GROUP BY 1, 2)
SELECT objective, sector, recorded AS "from", value AS "to" FROM v WHERE initial IS NOT NULL AND recorded IS NOT NULL AND value IS NOT NULL AND sector % 2 = 0 AND recorded <> value"""
)
def measure_reentry(spark, d):
    """Records of even sectors were closed and enter their window again: the moves that are conceded."""
    pick = lambda k: F.avg(F.when(F.col("event_id") % 3 == k, F.col("value")))
    v = V.table(spark, d, "events").groupBy(F.col("event_type").alias("objective"), F.col("user_id").alias("sector")).agg(pick(0).alias("initial"), pick(1).alias("recorded"), pick(2).alias("value")).na.drop()
    rows = v.withColumns({"direction": F.lit("down"), "entered": F.lit("t0"), "improved": F.lit(0.0), "closed": F.when(F.col("sector") % 2 == 0, F.col("recorded")), "last_improved": F.lit("t0"), "inside": F.lit(True)})
    return C.cleared_measure(rows, F.lit(0.5), "t1")[1].select("objective", "sector", "from", "to")


@query(
    """WITH s AS (SELECT event_type AS campaign, user_id AS sector, count_if(value > 90) AS count, count_if(value < 2) AS stale, count_if(value > 120) AS new, user_id % 50 <> 0 AS entered FROM events GROUP BY 1, 2),
r AS (SELECT campaign, sum(count) AS count, sum(stale) AS stale, sum(new) AS new, bool_or(NOT entered) AS missing FROM s GROUP BY 1)
SELECT campaign, concat_ws(',', CASE WHEN stale > 0 THEN 'stale' END, CASE WHEN missing THEN 'missing ledger' END, CASE WHEN new > 0 AND NOT missing THEN 'growth' END, CASE WHEN count = 0 AND stale = 0 AND NOT missing THEN 'complete' END) AS reasons FROM r WHERE stale > 0 OR missing OR new > 0 OR count = 0"""
)
def campaign_failures(spark, d):
    value = F.col("value")
    s = V.table(spark, d, "events").groupBy(F.col("event_type").alias("campaign"), F.col("user_id").alias("sector")).agg(F.count_if(value > 90).alias("count"), F.count_if(value < 2).alias("stale"), F.count_if(value > 120).alias("new"))
    fixed = {"objective": F.lit("o"), "inside": F.lit(True), "entered": F.col("sector") % 50 != 0, "holds": F.lit(True), "unmeasured": F.lit(False), "drift": F.lit(0), "unreceipted": F.lit(0), "on_complete": F.lit("remove")}
    return RC.failures(RC.campaign_report(s.withColumns(fixed))).select("campaign", F.array_join("reasons", ",").alias("reasons"))


# -- campaigns evaluated over their sectors ----------------------------------------------------------------------------

PLAN_PHASES = [(0, "stop-errors", ["error"], False, False), (1, "agree", [], True, False), (2, "signups", ["signup", "purchase"], False, False), (3, "open", [], False, True)]
PLAN_OBJECTIVES = [("error", None, False), ("signup", "open", False), ("click", "signups", False), ("view", None, False), ("purchase", None, True)]
# Files are users' events, sectors the users, and what user 1 did is shared: purchases are read there alone, and hold all sectors.
EVALUATED_SQL = """WITH RECURSIVE h AS (SELECT 'u' || user_id AS sector, event_type AS objective, 'e' || event_id AS entry FROM events WHERE value > 60),
names AS (SELECT DISTINCT CASE WHEN user_id = 1 THEN 'shared' ELSE 'u' || user_id END AS sector, user_id FROM events UNION SELECT 'shared', 1),
hit AS (SELECT CASE WHEN sector = 'u1' THEN 'shared' ELSE sector END AS sector, objective, entry FROM h WHERE (sector = 'u1') = (objective = 'purchase')),
w(objective, first, "end", shared) AS (VALUES ('error', 0, 1073741824, false), ('signup', 2, 3, false), ('click', -1, 2, false), ('view', -1, 1073741824, false), ('purchase', 2, 1073741824, true)),
cnt AS (SELECT sector, objective, count(*)::DOUBLE AS n FROM hit GROUP BY 1, 2), sh AS (SELECT coalesce((SELECT n FROM cnt WHERE sector = 'shared' AND objective = 'purchase'), 0) AS n),
st AS (SELECT names.sector, user_id, w.*, CASE WHEN w.shared THEN sh.n ELSE coalesce(cnt.n, 0) END AS n, CASE WHEN user_id % 5 = 0 OR names.sector = 'shared' THEN -1 ELSE user_id % 4 END AS reached, user_id % 3 = 0 AND user_id % 5 <> 0 AS agreed FROM names CROSS JOIN w CROSS JOIN sh LEFT JOIN cnt ON cnt.sector = names.sector AND cnt.objective = w.objective),
ph AS (SELECT sector, CASE WHEN sector = 'shared' THEN 4 WHEN bool_or(objective = 'error' AND n > 0) THEN 0 WHEN NOT any_value(agreed) THEN 1 WHEN bool_or(objective = 'signup' AND n > 0 AND reached < 3) OR bool_or(objective = 'purchase' AND n > 0) THEN 2 ELSE 3 END AS phase_at FROM st GROUP BY sector),
ev AS (SELECT st.*, phase_at, CASE WHEN st.sector = 'shared' THEN shared ELSE NOT ("end" < 1073741824 AND "end" <= reached) AND phase_at >= first AND phase_at < "end" END AS inside, st.sector <> 'shared' AND NOT ("end" < 1073741824 AND "end" <= reached) AND first > phase_at AS behind FROM st JOIN ph USING (sector))"""


def _evaluated(spark, d):
    e = V.table(spark, d, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = e.select("user_id", "event_type", "value", F.concat(user, F.lit("/e"), F.col("event_id").cast("string")).alias("path"))
    perimeter = S.Perimeter("glob", ["^u[0-9]+/"])
    sectors = S.discovered(rows.select("path"), perimeter, shared=["^u1/"])
    found = rows.filter("value > 60").select(F.col("event_type").alias("objective"), "path", F.lit(None).cast("string").alias("subject"))
    at = S.hit_sectors(found, sectors, perimeter)
    hits = at.select("objective", "sector", "path", F.substring_index("path", "/", -1).alias("entry"))
    phases = spark.createDataFrame(PLAN_PHASES, "ord int, phase string, objectives array<string>, attested boolean, open boolean")
    fixed = {"measured": F.lit(False), "direction": F.lit("down"), "target": F.lit(None).cast("double")}
    plan = E.Plan(phases, spark.createDataFrame(PLAN_OBJECTIVES, "objective string, until string, over_shared boolean").withColumns(fixed), shared=True)
    step = F.struct(F.lit("agree").alias("phase"), F.lit("a").alias("by"), F.lit("t0").alias("at"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast(RC.REVOKED).alias("revoked"))
    said = F.when(F.col("user_id") % 3 == 0, F.array(step)).otherwise(F.array().cast(RC.ATTESTED))
    records = e.filter("user_id % 5 <> 0 and user_id <> 1").select("user_id").distinct().select(user.alias("sector"), (F.col("user_id") % 4).cast("int").alias("reached"), F.lit("t0").alias("since"), said.alias("attested"), F.array().cast("array<struct<text:string,by:string,at:string>>").alias("notes"))
    return E.evaluated(sectors, plan, hits, records), plan, records


def _plan_ledger(e):
    """Each objective's ledger before: every hit of an even number was a holdout, and so were some that are gone."""
    at = e.hits.filter("objective <> 'purchase'").select("objective", "sector", "entry", F.expr("cast(substr(entry, 2) as bigint)").alias("id")).filter("id % 2 = 0")
    old = at.select("objective", "sector", F.when(F.col("id") % 3 == 0, F.concat(F.lit("gone"), F.col("id").cast("string"))).otherwise(F.col("entry")).alias("entry"))
    rows = old.groupBy("objective", "sector").agg(F.array_sort(F.collect_list("entry")).alias("holdouts"))
    return rows.select("objective", "sector", F.lit("t0").alias("entered"), F.size("holdouts").cast("double").alias("initial"), F.lit(0.0).alias("cleared"), F.lit(0.0).alias("closed"), F.lit("t0").alias("last_cleared"), "holdouts")


PLAN_LEDGER_SQL = """, led AS (SELECT sector, objective, CASE WHEN id % 3 = 0 THEN 'gone' || id ELSE entry END AS entry, id % 3 = 0 AS gone FROM (SELECT *, substr(entry, 2)::BIGINT AS id FROM hit) WHERE objective <> 'purchase' AND id % 2 = 0)"""


@query(EVALUATED_SQL + " SELECT sector, objective, n, phase_at, inside, behind FROM ev")
def campaign_evaluated(spark, d):
    return _evaluated(spark, d)[0].states.select("sector", "objective", "n", "phase_at", "inside", "behind")


@query(EVALUATED_SQL + " SELECT sector, objective, entry FROM hit WHERE (sector, objective) IN (SELECT (sector, objective) FROM ev WHERE inside)")
def campaign_counted(spark, d):
    return E.counted(_evaluated(spark, d)[0]).select("sector", "objective", "entry")


@query(EVALUATED_SQL + " SELECT sector, objective, n FROM ev WHERE n > 0 AND first = phase_at AND first >= 0")
def campaign_toward_next(spark, d):
    e, plan, _ = _evaluated(spark, d)
    return E.toward_next(e, plan)


@query(EVALUATED_SQL + PLAN_LEDGER_SQL + " SELECT sector, objective, entry FROM hit SEMI JOIN led USING (sector, objective, entry) WHERE (sector, objective) IN (SELECT (sector, objective) FROM ev WHERE inside)")
def campaign_ledgered(spark, d):
    e, _, _ = _evaluated(spark, d)
    holdouts = _plan_ledger(e).select("objective", "sector", F.posexplode("holdouts").alias("ord", "entry"))
    return E.ledgered(e, holdouts).select("sector", "objective", "entry")


@query(
    EVALUATED_SQL
    + PLAN_LEDGER_SQL
    + """, o AS (SELECT sector, objective, count(*) AS held, count_if(gone) AS stale FROM led GROUP BY 1, 2)
SELECT ev.sector, ev.objective, CASE WHEN held IS NULL THEN ev.n ELSE held END::DOUBLE AS initial, CASE WHEN held IS NOT NULL AND inside THEN stale ELSE 0 END::DOUBLE AS cleared, CASE WHEN held IS NOT NULL AND NOT inside AND NOT behind THEN held ELSE 0 END::DOUBLE AS closed,
CASE WHEN held IS NULL THEN ev.n WHEN inside THEN held - stale WHEN behind THEN held ELSE 0 END::INT AS n_holdouts FROM ev LEFT JOIN o USING (sector, objective) WHERE (ev.objective <> 'purchase' OR ev.sector = 'shared') AND (held IS NOT NULL OR inside)"""
)
def campaign_clear(spark, d):
    e, _, _ = _evaluated(spark, d)
    out = E.cleared(e, _plan_ledger(e), "t1")[0]
    return out.select("sector", "objective", "initial", "cleared", "closed", F.size("holdouts").alias("n_holdouts"))


@query(
    EVALUATED_SQL
    + PLAN_LEDGER_SQL
    + """, rec AS (SELECT DISTINCT sector, reached, agreed FROM st WHERE reached >= 0), o AS (SELECT sector, objective, count(*)::DOUBLE AS held FROM led GROUP BY 1, 2),
own AS (SELECT rec.sector, rec.reached, agreed, w.objective, coalesce(held, CASE WHEN first > rec.reached THEN 1 ELSE 0 END) AS n FROM rec CROSS JOIN w LEFT JOIN o ON o.objective = w.objective AND o.sector = CASE WHEN w.shared THEN 'shared' ELSE rec.sector END)
SELECT sector, CASE WHEN bool_or(objective = 'error' AND n > 0) THEN 0 WHEN NOT any_value(agreed) THEN 1 WHEN bool_or(objective = 'signup' AND n > 0 AND reached < 3) OR bool_or(objective = 'purchase' AND n > 0) THEN 2 ELSE 3 END AS phase_at FROM own GROUP BY sector"""
)
def campaign_ledger_phase(spark, d):
    e, plan, records = _evaluated(spark, d)
    return E.ledger_phase(records, _plan_ledger(e), plan)


PERIMETER_SQL = """, m(marker, sector, owns) AS (VALUES ('src/small/sector.json', 'small', NULL), ('src/large/sector.json', 'large', '^src/large/brand-1'), ('src/promo/brand-99/sector.json', 'small', NULL)),
c AS (SELECT path, sector, marker FROM vfiles, m WHERE (owns IS NULL AND path LIKE regexp_extract(marker, '^(.*)/', 1) || '/%') OR regexp_matches(path, owns)), f AS (SELECT path, arg_min(sector, marker) AS sector FROM c GROUP BY path)"""


@query(f"WITH {VFILES}{PERIMETER_SQL} SELECT path, CASE WHEN regexp_matches(path, '/hot-') THEN 'shared' ELSE coalesce(f.sector, 'legacy') END AS sector FROM vfiles LEFT JOIN f USING (path) WHERE regexp_matches(path, '/hot-') OR f.sector IS NOT NULL OR regexp_matches(path, '^src/(large|economy)/')")
def sectors_of_markers(spark, d):
    """Two markers of one name own their folders, a third what its pattern says; hot files are shared, some others legacy."""
    own = [("src/small/sector.json", "small", []), ("src/large/sector.json", "large", [("^src/large/brand-1", "src/large")]), ("src/promo/brand-99/sector.json", "small", [])]
    rows = spark.createDataFrame(own, "marker string, sector string, owns array<struct<pattern:string,root:string>>")
    return S.discovered(V.files(spark, d), S.Perimeter("marker", rows=rows), shared=["/hot-"], legacy=["^src/(large|economy)/"]).files.select("path", "sector")


@query(f"WITH {VFILES} SELECT regexp_replace(path, '\\.[^.]*$', '') AS sector, regexp_extract(path, '^(.*)/', 1) AS root, path FROM vfiles")
def sectors_of_files(spark, d):
    found = S.discovered(V.files(spark, d), S.Perimeter("file"))
    return found.files.join(found.names, "sector").select("sector", S.root_of(F.col("roots"), F.col("path")).alias("root"), "path")


@query(
    """WITH decl AS (SELECT p_brand AS path, p_partkey AS ord, p_name AS name, p_size AS a, p_size + p_partkey % 20 AS b FROM part), pos AS (SELECT DISTINCT p_brand AS path, l_quantity::INT AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
x AS (SELECT pos.path, line, name, row_number() OVER (PARTITION BY pos.path, line ORDER BY a DESC, ord DESC) AS rn FROM pos JOIN decl ON decl.path = pos.path AND line BETWEEN a AND b) SELECT pos.path, pos.line, x.name AS anchor FROM pos LEFT JOIN x ON x.path = pos.path AND x.line = pos.line AND rn = 1"""
)
def innermost_anchor(spark, d):
    """Parts as declarations of their brand's file; each line that an order names lies in the innermost that holds it."""
    p = V.table(spark, d, "part")
    declared = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_size").alias("start_line"), F.lit(0).alias("start_col"), (F.col("p_size") + F.col("p_partkey") % 20).cast("int").alias("end_line"), F.lit(0).alias("end_col"))
    at = V.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("path"), F.col("l_quantity").cast("int").alias("line"), F.lit(0).alias("col")).distinct()
    return D.innermost(at, declared).select("path", "line", "anchor")


DAYS_SQL = """c AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS sha, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS ord, event_type || '/u' || user_id AS path FROM events)"""


def _commits(spark, d):
    at = F.col("ts").cast("timestamp")
    return V.table(spark, d, "events").select(F.date_format(at, "yyyy-MM-dd").alias("sha"), F.datediff(at, F.lit("2024-01-01")).alias("ord"), F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string")).alias("path")).distinct()


@query(f"WITH {DAYS_SQL} SELECT sha, ord, string_agg(path, ',' ORDER BY path) AS files FROM c WHERE regexp_matches(path, '^(error|signup)/u[0-9]$') GROUP BY sha, ord")
def commits_touching(spark, d):
    """Days as commits, users' kinds of events as files."""
    out = H.commits_touching(_commits(spark, d), F.array(F.lit("^(error|signup)/u[0-9]$")))
    return out.select("sha", "ord", F.array_join("files", ",").alias("files"))


@query(f"WITH {DAYS_SQL}, v AS (SELECT path, ord, count(*) OVER (PARTITION BY path ORDER BY ord) AS version FROM c WHERE ord % 2 = 0), s AS (SELECT DISTINCT sha, ord FROM c) SELECT s.sha, path, max(version) AS version FROM s JOIN v ON v.ord <= s.ord GROUP BY s.sha, path")
def versions_as_of(spark, d):
    """The last version of every file that was written at or before each commit."""
    c = _commits(spark, d)
    even = c.filter("ord % 2 = 0").select("path", "ord")
    version = F.count("*").over(Window.partitionBy("path").orderBy("ord"))
    return H.as_of(c, even.withColumn("version", version), ["path"])


@query(f"WITH {VFILES}, t AS (SELECT DISTINCT regexp_extract(path, '^(src/[^/]+)/', 1) AS node, p_brand AS member, p_size AS item FROM vfiles), n AS (SELECT node, count(DISTINCT member) AS n FROM t GROUP BY 1) SELECT node, item FROM t JOIN n USING (node) GROUP BY node, item, n HAVING count(*) = n")
def infer_shared_by_all(spark, d):
    f = V.files(spark, d).select(F.regexp_extract("path", "^(src/[^/]+)/", 1).alias("node"), F.col("p_brand").alias("member"), F.col("p_size").alias("item"))
    return I.shared_by_all(f, "node", "member", "item")


# -- inference ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {VEDGES}, e AS (SELECT DISTINCT regexp_extract(src, '^(src/[^/]+)/', 1) AS node, regexp_extract(dst, '^(src/[^/]+)/', 1) AS target FROM vedges) SELECT node, string_agg(target, ',' ORDER BY target) AS allow FROM e WHERE node <> target GROUP BY node"""
)
def infer_allow_sets(spark, d):
    return I.allow_sets(V.edges(spark, d), 2).select("node", F.array_join("allow", ",").alias("allow"))


@query(
    f"""WITH {VPARTS}, t AS (SELECT DISTINCT regexp_extract(path, '^(src/[^/]+)/', 1) AS p, folder AS node, regexp_extract(base, '-([a-z]+)\\.', 1) AS t FROM vparts), n AS (SELECT p, node, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT a.p, a.node AS a, b.node AS b, count(*) AS common FROM t a JOIN t b ON a.p = b.p AND a.t = b.t AND a.node < b.node GROUP BY 1, 2, 3)
SELECT b.p, a, b, common, common / (x.n + y.n - common) AS likeness FROM b JOIN n x ON x.p = b.p AND x.node = a JOIN n y ON y.p = b.p AND y.node = b WHERE common >= 2 OR common / (x.n + y.n - common) >= 0.5"""
)
def infer_similar_siblings(spark, d):
    traits = V.files(spark, d).select(F.regexp_extract("path", "^(src/[^/]+)/", 1).alias("parent"), ft.dirname(F.col("path")).alias("node"), F.regexp_extract(ft.basename(F.col("path")), r"-([a-z]+)\.", 1).alias("trait"))
    return I.similar_pairs(traits, "parent", "node", "trait")


@query(
    f"""WITH RECURSIVE {VEDGES}, pair AS (SELECT src AS a, dst AS b FROM vedges WHERE src <> dst UNION SELECT dst, src FROM vedges WHERE src <> dst), walk(a, b) AS (SELECT a, b FROM pair UNION SELECT w.a, e.b FROM walk w JOIN pair e ON w.b = e.a) SELECT a AS node, least(a, min(b)) AS root FROM walk GROUP BY a"""
)
def infer_groups(spark, d):
    return I.families_of(V.edges(spark, d).filter("src <> dst").toDF("a", "b"))


@query(
    f"""WITH {VFILES}, nodes(node) AS (VALUES ('src'), ('src/small'), ('src/small/brand-1'), ('src/large/brand-2')) SELECT path, arg_max(node, length(node)) AS node FROM vfiles JOIN nodes ON path LIKE node || '/%' GROUP BY path"""
)
def infer_governing_node(spark, d):
    nodes = spark.createDataFrame([(x,) for x in ("src", "src/small", "src/small/brand-1", "src/large/brand-2")], "node string")
    return I.governors(V.files(spark, d), F.broadcast(nodes))


# -- sources -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {VFILES} SELECT path AS file, (p_size - 1)::INT AS line, (id % 80)::INT AS col, 'TS' || (2300 + p_size) AS code, 'Type ' || p_name AS message FROM vfiles"""
)
def report_tsc(spark, d):
    line = F.concat("path", F.lit("("), F.col("p_size").cast("string"), F.lit(","), (F.col("id") % 80 + 1).cast("string"), F.lit("): error TS"), (F.col("p_size") + 2300).cast("string"), F.lit(": Type "), "p_name")
    text = V.files(spark, d).select(F.concat(line, F.lit("\r\nsummary line")).alias("text"), "id")
    return R.unique(R.tsc(text))


@query(f"""WITH {VFILES} SELECT path AS file, (p_size - 1)::INT AS line, 2 AS col, 'no-' || (p_size % 3) AS code, p_name AS message FROM vfiles""")
def report_eslint(spark, d):
    doc = F.to_json(F.array(F.struct(F.col("path").alias("filePath"), F.array(F.struct(F.concat(F.lit("no-"), (F.col("p_size") % 3).cast("string")).alias("ruleId"), F.col("p_size").alias("line"), F.lit(3).alias("column"), F.concat("p_name", F.lit("\nmore")).alias("message"))).alias("messages"))))
    return R.eslint(V.files(spark, d).select(doc.alias("text")))


@query(f"""WITH {VFILES} SELECT path AS file, (p_size - 1)::INT AS line, 0 AS col, '' AS code, p_name AS message FROM vfiles""")
def report_regex_parse(spark, d):
    text = V.files(spark, d).select(F.concat("path", F.lit(" @ "), F.col("p_size").cast("string"), F.lit(" > "), "p_name").alias("text"))
    return R.by_regex(text, r"^(?<file>\S+) @ (?<line>\d+) > (?<message>.*)$")


@query(
    f"""WITH {VFILES} SELECT id, path, (p_size)::BIGINT AS hunk_start, CASE WHEN id % 2 = 0 THEN p_size + 3 ELSE p_size END::BIGINT AS hunk_end FROM vfiles WHERE id % 3 <> 0"""
)
def diff_parse(spark, d):
    gone = F.col("id") % 3 == 0
    new = F.when(gone, F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), "path"))
    mode = F.when(gone, F.lit("deleted file mode 100644\n")).otherwise(F.lit("index 1..2\n"))
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), mode, F.lit("--- a/"), "path", F.lit("\n+++ "), new, F.lit("\n@@ -1,0 +"), F.col("p_size").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(",4")).otherwise(F.lit("")), F.lit(" @@ ctx\n+a\n+b"))
    text = V.files(spark, d).select("id", head.alias("text"))
    return R.diff(text, keys=("id",))[0]


@query(
    """WITH e AS (SELECT user_id % 10 AS repo, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT repo, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY repo, k"""
)
def change_feed_sessions(spark, d):
    e = V.table(spark, d, "events").select((F.col("user_id") % 10).alias("repo"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    out = feed.sessions(e, "30 minutes", ["repo"])
    return out.select("repo", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", F.array_join("paths", ",").alias("paths"))
