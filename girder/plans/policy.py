"""Manifests: a policy written as a directory tree, read on the driver and lowered to the flat rules that queries broadcast.

A key that ends in / is a folder, any other a file; alternatives stand between bars. A folder admits the children it lists
unless it is partial or open; allowances are inherited until a node resets them, denials always accumulate. Every rule carries
a probe that it must report; a policy with a rule that cannot fire is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from girder.plans.patterns import CONVENTIONS
from girder.plans.rules import Allowance, ExportRule, FolderRule, GraphRule, ImportRule, MemberRule, NamingRule, ParityRule, RootRule, SurfaceRule

# Keys that each part of a manifest may hold, and the manifest's file names.
TOP = frozenset("version roots baseline ledger resolve aliases exports graph limits defs tree structure campaigns message".split())
NODE = frozenset("message partial layout name imports importedBy members surface requires requiresNot children use".split())
IMPORTS = frozenset("allow external deny reset unrestricted message use".split())
OPEN_LAYOUT = "^.*$"  # a folder that admits any file
FILES = ("architecture.yaml", "architecture.yml", "architecture.json")


class Refused(ValueError):
    """A policy that cannot be loaded; the reasons are its arguments."""


@dataclass
class Policy:
    imports: list[ImportRule] = field(default_factory=list)
    exports: list[ExportRule] = field(default_factory=list)
    members: list[MemberRule] = field(default_factory=list)
    surface: list[SurfaceRule] = field(default_factory=list)
    parity: list[ParityRule] = field(default_factory=list)
    naming: list[NamingRule] = field(default_factory=list)
    folders: list[FolderRule] = field(default_factory=list)
    roots: list[RootRule] = field(default_factory=list)
    cycles: list[GraphRule] = field(default_factory=list)
    orphans: list[GraphRule] = field(default_factory=list)
    reach: list[GraphRule] = field(default_factory=list)
    limits: dict = field(default_factory=dict)
    outside: list[str] = field(default_factory=list)
    probes: list[tuple[str, object, dict]] = field(default_factory=list)  # family, rule, probe
    partial: list[str] = field(default_factory=list)
    unrestricted: list[str] = field(default_factory=list)
    baseline: str | None = None
    report_unresolved: bool = True
    ignore_unresolved: list[str] = field(default_factory=list)  # patterns of specifiers

    def has_graph_rules(self) -> bool:
        return bool(self.cycles or self.orphans or self.reach)


def parse(text: str, name: str = "architecture.yaml") -> dict:
    if name.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def included(value, read: Callable[[str], str], base: str = ".", seen: tuple[str, ...] = ()):
    """Splices `{include: path}` nodes; a file that includes itself is refused."""
    if isinstance(value, dict):
        if set(value) == {"include"}:
            path = str(PurePosixPath(base) / value["include"])
            if path in seen:
                raise Refused(f"{path} includes itself")
            return included(parse(read(path), path), read, str(PurePosixPath(path).parent), (*seen, path))
        return {k: included(v, read, base, seen) for k, v in value.items()}
    if isinstance(value, list):
        return [included(v, read, base, seen) for v in value]
    return value


def expanded(manifest: dict) -> tuple[dict, dict[tuple[str, ...], str]]:
    """The manifest with `use: name` replaced by that fragment of `defs` (own keys win), and where each came from."""
    defs, origin = manifest.get("defs", {}), {}

    def walk(value, at: tuple[str, ...], through: tuple[str, ...]):
        if isinstance(value, list):
            return [walk(v, (*at, str(i)), through) for i, v in enumerate(value)]
        if not isinstance(value, dict):
            return value
        if "use" in value:
            name = value["use"]
            if name in through:
                raise Refused(f"fragment {name} uses itself")
            if name not in defs:
                raise Refused(f"there is no fragment {name}")
            own = {k: v for k, v in value.items() if k != "use"}
            merged = {**defs[name], **own} if isinstance(defs[name], dict) else defs[name]
            origin[at] = name
            for k in merged if isinstance(merged, dict) else ():
                if k not in own:
                    origin[(*at, k)] = name
            return walk(merged, at, (*through, name))
        return {k: walk(v, (*at, k), through) for k, v in value.items()}

    return {k: walk(v, (k,), ()) for k, v in manifest.items() if k != "defs"}, origin


def many(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def source(glob: str, groups: dict[str, int], target: bool) -> str:
    """A glob's regex source; captures become groups on the importing side, and $n or \\n where they come again."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("(?:/.*)?")
            i += 3
        elif glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] in "*?":
            out.append("[^/]*" if glob[i] == "*" else "[^/]")
            i += 1
        elif m := re.match(r"\{([A-Za-z]\w*)\}", glob[i:]):
            if m[1] in groups:
                out.append(f"${groups[m[1]]}" if target else f"\\{groups[m[1]]}")
            elif target:
                out.append("[^/]+")
            else:
                groups[m[1]] = len(groups) + 1
                out.append("([^/]+)")
            i += len(m[0])
        elif glob[i] == "[" and (end := glob.find("]", i)) > 0:
            out.append(glob[i : end + 1].replace("[!", "[^"))
            i = end + 1
        else:
            out.append(re.sub(r"([.+^$()|\[\]\\{}])", r"\\\1", glob[i]))
            i += 1
    return "".join(out)


def probe_path(glob: str) -> str:
    """A path that the glob matches."""
    words = iter("alpha beta gamma delta epsilon zeta eta theta".split())
    given: dict[str, str] = {}
    glob = re.sub(r"\{(\w+)\}", lambda m: given.setdefault(m[1], next(words, "iota")), glob)
    return re.sub(r"\[.*?\]", "a", glob.replace("**", "deep").replace("*", "any").replace("?", "x"))


STRAY = ["zzProbeStray", "zz-probe-stray", "ZZ_PROBE_STRAY", "zz probe stray"]  # one of them breaks any convention that rules something out


def sample(globs) -> str:
    """A name that the first of the globs admits."""
    return probe_path(many(globs)[0]) if many(globs) else STRAY[0]


def lowered(manifest: dict, origin: dict[tuple[str, ...], str] | None = None) -> Policy:
    out, origin, aliases = Policy(), origin or {}, manifest.get("aliases", {})
    if unknown := set(manifest) - TOP:
        raise Refused(*(f"unknown key {k}" for k in sorted(unknown)))

    def alias(glob: str) -> str:
        for k, v in aliases.items():
            if glob == k or glob.startswith(k + "/"):
                return v + glob[len(k) :]
        return glob

    def target(glob: str, groups: dict[str, int] | None = None) -> str:
        s = source(alias(glob), dict(groups or {}), True)
        return "^" + s + ("" if s.endswith(".*)?") or "*" in glob.rpartition("/")[2] and "." not in glob.rpartition("/")[2] else "$" if "." in glob.rpartition("/")[2] else "(?:/|$)")

    def own_pattern(src: str) -> str:
        return f"^{src}$"

    def walk(key: str, node: dict, at: dict, siblings: dict, where: tuple[str, ...]) -> None:
        if unknown := set(node) - NODE:
            raise Refused(*(f"{'/'.join(where)}: unknown key {k}" for k in sorted(unknown)))
        folder = key.endswith("/") or "children" in node
        options = [alias(o.strip().rstrip("/")) for o in key.split("|")]
        groups = dict(at["groups"])
        if len(options) > 1 and any("{" in o for o in options):
            raise Refused(f"{key} names several patterns and a capture")
        body = source(options[0], groups, False) if len(options) == 1 else "(?:" + "|".join(source(o, dict(groups), False) for o in options) + ")"
        literal = [o for k in siblings if k != key for o in (x.strip().rstrip("/") for x in k.split("|")) if not re.search(r"[*{\[?]", o)] if re.search(r"[*{]", options[0]) else []
        if literal:
            body = "(?!(?:" + "|".join(map(re.escape, literal)) + ")(?:/|$))" + body
        path = f"{at['path']}/{body}" if at["path"] else body
        glob = f"{at['glob']}/{options[0]}" if at["glob"] else options[0]
        name = f"{at['name']}/{key.rstrip('/')}" if at["name"] else key.rstrip("/")
        inside, mine = f"^{path}/", own_pattern(path)
        scope = inside if folder else mine
        probe = probe_path(glob) + ("/zzprobe.ts" if folder else "")
        imports = node.get("imports") or {}
        if unknown := set(imports) - IMPORTS:
            raise Refused(*(f"{name}: unknown key imports.{k}" for k in sorted(unknown)))
        if node.get("partial"):
            out.partial.append(name)
        if imports.get("unrestricted"):
            out.unrestricted.append(name)
        from_use = lambda k: origin.get((*where, "imports", k)) or origin.get((*where, "imports"))
        added = [Allowance(name, "allow", alias(g), target(g, groups), from_use("allow")) for g in many(imports.get("allow"))]
        added += [Allowance(name, "external", p, None, from_use("external")) for p in many(imports.get("external"))]
        allowances = added if imports.get("reset") or imports.get("unrestricted") else [*at["allow"], *added]
        message = imports.get("message", at["message"])
        if "imports" in node:
            to_not = [a.pattern for a in allowances if a.pattern]
            if allowances and not any(p in ("^.*", "^(?:.*)") for p in to_not):
                aside = overriding(node, path, groups)
                if not folder:
                    aside += narrower(key, siblings, at, mine, probe)
                rule = ImportRule(f"{name}/imports", message, [scope], aside, [], to_not, [a.entry for a in allowances if a.kind == "external"], None, allowances)
                out.imports.append(rule)
                out.probes.append(("import", rule, {"path": probe, "target": "nowhere/zz/outside.ts"}))
            elif not imports.get("unrestricted"):
                raise Refused(f"{name} states an imports policy without an allowlist; say unrestricted if that is meant")
            for i, d in enumerate(many(imports.get("deny"))):
                rule = ImportRule(f"{name}/deny-{i}", d["message"], [scope], [target(x, groups) for x in many(d.get("except"))], [target(x, groups) for x in many(d["match"])], [target(x, groups) for x in many(d.get("matchNot"))])
                out.imports.append(rule)
                out.probes.append(("import", rule, {"path": probe, "target": probe_path(alias(many(d["match"])[0]))}))
        if by := node.get("importedBy"):
            rule = ImportRule(f"{name}/importedBy", by["message"], ["^"], [*(target(x) for x in many(by["allow"])), scope], [scope], [target(x, groups) for x in many(by.get("matchNot"))])
            out.imports.append(rule)
            out.probes.append(("import", rule, {"path": "nowhere/zz/outside.ts", "target": probe}))
        for i, m in enumerate(many(node.get("members"))):
            full = lambda xs: [own_pattern(source(x, {}, False)) for x in many(xs)]
            rule = MemberRule(f"{name}/members-{i}", m["message"], [scope], [], m.get("subject", "members"), full(m.get("in")), m.get("declares"), full(m.get("match")), full(m.get("matchNot")), full(m.get("allow")))
            out.members.append(rule)
            site = {"name": sample(m.get("match")), "in": sample(m.get("in")) if m.get("in") else None, "declares": (m.get("declares") or [None])[0], **(m.get("probe") or {})}
            out.probes.append(("member", rule, {"path": probe, **site}))
        for i, m in enumerate(many(node.get("surface"))):
            full = lambda xs: [own_pattern(source(x, {}, False)) for x in many(xs)]
            demand = "allow" if "allow" in m else "convention" if "convention" in m else "count" if "count" in m else "forbid"
            conv = m.get("convention")
            conv = conv["regex"] if isinstance(conv, dict) else CONVENTIONS[conv] if conv else None
            count = m.get("count") or {}
            rule = SurfaceRule(f"{name}/surface-{i}", m["message"], [scope], [target(x, groups) for x in many(m.get("except"))], m.get("kinds"), m.get("declares"), m.get("reexport"), full(m.get("match")), full(m.get("matchNot")), demand, full(m.get("allow")), conv, count.get("min"), count.get("max"))
            out.surface.append(rule)
            site = {"kind": (m.get("kinds") or ["named"])[0], "declares": (m.get("declares") or ["other"])[0], "reexport": bool(m.get("reexport"))}
            names = [sample(m.get("match"))] if m.get("match") else STRAY
            many_sites = [{**site, "name": names[0]}] * (0 if count.get("min") else (count.get("max") or 0) + 1) if demand == "count" else [{**site, "name": x} for x in names]
            out.probes.append(("surface", rule, {"path": probe, "sites": (m.get("probe") or {}).get("sites", many_sites)}))
        if requires := many(node.get("requires")):
            rule = ParityRule(f"{name}/requires", node.get("message", "A sibling is missing."), [mine] if not folder else [inside + "[^/]+$"], [f"(?:^|/){source(x, {}, False)}$" for x in many(node.get("requiresNot"))], requires)
            out.parity.append(rule)
            out.probes.append(("parity", rule, {"path": probe}))
        naming = node.get("name", at["naming"])
        if naming is not None and not folder and ("{" in options[0] or "*" in options[0]):
            like = naming.get("like") if isinstance(naming, dict) else None
            conv = None if like else naming["regex"] if isinstance(naming, dict) else CONVENTIONS[naming]
            subject = f"^{at['path']}/{'' if not at['path'] else ''}" if at["path"] else "^"
            head = re.sub(r"\\?\*|\{\w+\}", "\0", options[0], count=1).split("\0")
            pattern = subject + source(head[0], {}, False) + r"([^/.]+)" + (source(head[1], {}, False) if len(head) > 1 else "") + "$"
            if like and like not in groups:
                raise Refused(f"{name}: no capture {like}")
            rule = NamingRule(f"{name}/name", node.get("message", "The name breaks the convention."), [pattern], [], len(at["groups"]) + 1, at["groups"].get(like) if like else None, conv)
            out.naming.append(rule)
            out.probes.append(("naming", rule, {"path": probe_path(glob)}))
        children = node.get("children") or {}
        if folder and children and not node.get("partial"):
            files = [own_pattern(source(o.strip(), dict(groups), False).replace("\\1", "[^/]+")) for k in children if not k.endswith("/") for o in k.split("|")]
            if node.get("layout") == "open":
                files = [OPEN_LAYOUT]
            if files:
                rule = FolderRule(f"{name}/layout", node.get("message", "This folder does not admit that file."), [mine], files)
                out.folders.append(rule)
                if files != [OPEN_LAYOUT]:
                    out.probes.append(("layout", rule, {"path": probe_path(glob) + "/zz probe stray"}))
        elif folder and node.get("layout") == "open":
            out.folders.append(FolderRule(f"{name}/layout", node.get("message", ""), [mine], [OPEN_LAYOUT]))
        if not at["path"] and folder and not node.get("partial") and children:
            out.roots.append(RootRule(f"{name}/root", node.get("message", "This folder is no part of the taxonomy."), [inside]))
        below = {"path": path, "glob": glob, "name": name, "groups": groups, "allow": allowances, "message": message, "naming": naming}
        for k, child in children.items():
            walk(k, child or {}, below, children, (*where, "children", k))

    def overriding(node: dict, path: str, groups: dict[str, int]) -> list[str]:
        """Patterns of descendants that state imports of their own, for whose files this node's list steps aside."""
        found = []
        for k, child in (node.get("children") or {}).items():
            for o in k.split("|"):
                own = dict(groups)
                p = f"{path}/{source(o.strip().rstrip('/'), own, False)}"
                if (child or {}).get("imports") is not None:
                    found.append(f"^{p}/" if k.endswith("/") or "children" in child else f"^{p}$")
                elif child and "children" in child:
                    found += overriding(child, p, own)
        return found

    def narrower(key: str, siblings: dict, at: dict, mine: str, probe: str) -> list[str]:
        found = []
        for k, s in siblings.items():
            if k == key or (s or {}).get("imports") is None or k.endswith("/") or "children" in s:
                continue
            for o in k.split("|"):
                theirs = f"^{at['path']}/{source(o.strip(), dict(at['groups']), False)}$" if at["path"] else f"^{source(o.strip(), {}, False)}$"
                their_probe = probe_path(f"{at['glob']}/{o.strip()}" if at["glob"] else o.strip())
                if not re.search(mine, their_probe):
                    continue
                if re.search(theirs, probe):
                    raise Refused(f"{key} and {k} select the same files, and each states an imports policy")
                found.append(theirs)
        return found

    root = {"path": "", "glob": "", "name": "", "groups": {}, "allow": [], "message": "This import is not allowed.", "naming": None}
    tree = manifest.get("tree") or {}
    for k, node in tree.items():
        walk(k, node or {}, root, tree, ("tree", k))
    for e in many(manifest.get("exports")):
        rule = ExportRule(e["name"], e["message"], ["^"], [target(x) for x in many(e.get("except"))], [target(x) for x in many(e["module"])], [], e.get("symbols"), e.get("kinds", ["named"]), e.get("fix"))
        out.exports.append(rule)
        bound = {"target": probe_path(alias(many(e["module"])[0])), "symbol": (e.get("symbols") or ["zzProbe"])[0], "kind": rule.kinds[0], **(e.get("probe") or {})}
        out.probes.append(("export", rule, {"path": "nowhere/zz/outside.ts", **bound}))
    graph = manifest.get("graph") or {}
    pick = lambda g, *keys: {k: [target(x) for x in many(g.get(j))] for k, j in keys}
    for g in many(graph.get("cycles")):
        out.cycles.append(GraphRule(g["name"], g["message"], **pick(g, ("within", "within"), ("within_not", "withinNot"))))
    for g in many(graph.get("orphans")):
        out.orphans.append(GraphRule(g["name"], g["message"], **pick(g, ("within", "within"), ("within_not", "withinNot"), ("entry", "entry"))))
    for g in many(graph.get("reach")):
        out.reach.append(GraphRule(g["name"], g["message"], **pick(g, ("from_", "from"), ("to", "to"), ("via", "via"))))
    out.limits = manifest.get("limits") or {}
    out.outside = [target(x) for x in many(out.limits.get("outside"))]
    out.baseline = manifest.get("baseline")
    return out


def failing_probes(policy: Policy) -> list[str]:
    """Rules that do not report their own probe; decided in Python, no job runs."""
    bad = []
    hit = lambda patterns, value: any(re.search(p, value) for p in patterns)
    for family, rule, probe in policy.probes:
        path = probe["path"]
        if family == "import":
            m = None if hit(rule.from_not, path) else next((m for p in rule.from_ if (m := re.search(p, path))), None)
            if m is None:
                bad.append(f"{rule.name} does not select its probe {path}")
                continue
            put = lambda p, m=m: re.sub(r"\$([1-9])", lambda g: re.escape(m[int(g[1])]) if int(g[1]) <= len(m.groups()) and m[int(g[1])] is not None else g[0], p)
            if rule.to and not hit(map(put, rule.to), probe["target"]) or hit(map(put, rule.to_not), probe["target"]):
                bad.append(f"{rule.name} does not report its probe {path} -> {probe['target']}")
        elif family in ("export", "member", "surface") and (not hit(rule.from_, path) or hit(rule.from_not, path)):
            bad.append(f"{rule.name} does not select its probe {path}")
        elif family == "export" and (not hit(rule.to, probe["target"]) or probe["kind"] not in rule.kinds or rule.symbols and probe["symbol"] not in rule.symbols):
            bad.append(f"{rule.name} does not cover its probe {probe['symbol']} of {probe['target']}")
        elif family == "member" and (
            rule.in_ and not hit(rule.in_, probe["in"] or "") or rule.declares and probe["declares"] not in rule.declares or rule.match and not hit(rule.match, probe["name"]) or hit([*rule.match_not, *rule.allow], probe["name"])
        ):
            bad.append(f"{rule.name} does not report its probe {probe['name']}")
        elif family == "surface":
            spoken = [s for s in probe["sites"] if (not rule.kinds or s["kind"] in rule.kinds) and (not rule.declares or s.get("declares", "other") in rule.declares) and rule.reexport in (None, s.get("reexport", False)) and (not rule.match or hit(rule.match, s["name"])) and not hit(rule.match_not, s["name"])]
            fine = {"forbid": [], "allow": rule.allow, "convention": [rule.convention]}.get(rule.demand)
            held = (rule.least or 0) <= len(spoken) <= (len(spoken) if rule.most is None else rule.most) if fine is None else all(hit(fine, s["name"]) for s in spoken)
            if held:
                bad.append(f"{rule.name} reports nothing for its probe")
        elif family == "naming":
            if (m := re.search(rule.file[0], path)) is None:
                bad.append(f"{rule.name} does not name its probe {path}")
            elif rule.same_as is None and rule.convention and all(re.search(rule.convention, x) for x in STRAY):
                bad.append(f"{rule.name} admits every name")
        elif family == "parity" and (not hit(rule.file, path) or hit(rule.file_not, path)):
            bad.append(f"{rule.name} does not ask its probe {path}")
        elif family == "layout":
            folder, _, base = path.rpartition("/")
            if not hit(rule.folder, folder) or hit(rule.files, base):
                bad.append(f"{rule.name} does not refuse its probe {path}")
    return bad


def load(text: str, name: str = "architecture.yaml", read: Callable[[str], str] | None = None) -> Policy:
    """A manifest's text to a policy whose rules all fire on their probes."""
    manifest = parse(text, name)
    if read:
        manifest = included(manifest, read)
    policy = lowered(*expanded(manifest))
    over = [f"{len(v)} nodes are {k}; the limit is {policy.limits[k]}" for k, v in (("partial", policy.partial), ("unrestricted", policy.unrestricted)) if k in policy.limits and len(v) > policy.limits[k]]
    if reasons := failing_probes(policy) + over:
        raise Refused(*reasons)
    return policy
