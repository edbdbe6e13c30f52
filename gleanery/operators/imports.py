"""References between files: what a file's text names, the paths that it may mean, those of them that exist, and what follows.

Files are rows (path, text); paths are relative to the project and use slashes. The kind of a file follows its suffix. All of it
is column functions and joins: paths are normalised as arrays of their parts, candidates become rows and meet the table of known
paths by equality, so the work is spread by candidate path, whatever a file refers to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Suffixes that a reference of a kind may leave out, in the order in which they are tried. Fixed values.
SUFFIXES = {"python": (".py",), "script": (".ts", ".tsx", ".js", ".jsx"), "arkts": (".ets", ".ts", ".js"), "route": (".ets",), "dart": (".dart",), "link": ()}
KINDS = {"py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "ets": "arkts", "dart": "dart", "md": "link", "html": "link"}

_QUOTED = r"""(?:from\s+|import\s*\(|require\s*\()\s*['"]([^'"]+)['"]"""
_ROUTE = r"""(?:pushUrl|replaceUrl)\(\s*\{\s*url:\s*['"]([^'"]+)['"]"""
_FROM = r"(?m)^[ \t]*from[ \t]+(\.+[\w.]*)[ \t]+import[ \t]+([\w, \t*]+)"
_MODULE = r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][\w.]*)"


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def normal_path(path: Column) -> Column:
    """A path without empty and `.` parts, `..` taken back; null if it leads out of the project."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(False).alias("out"), F.array().cast("array<string>").alias("p"))
    up = lambda a: F.struct((a["out"] | (F.size(a["p"]) == 0)).alias("out"), F.when(F.size(a["p"]) > 0, F.slice(a["p"], 1, F.size(a["p"]) - 1)).otherwise(a["p"]).alias("p"))
    down = lambda a, x: F.struct(a["out"].alias("out"), F.concat(a["p"], F.array(x)).alias("p"))
    found = F.aggregate(parts, start, lambda a, x: F.when(x == "..", up(a)).otherwise(down(a, x)))
    return F.when(~found["out"], F.array_join(found["p"], "/"))


def references(files: DataFrame) -> DataFrame:
    """(path, kind, spec, base): what a file's text refers to. base is the path that the reference starts from; null for what
    lies outside the project (packages, addresses)."""
    low = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rows = files.select("path", "text", low[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))].alias("kind")).where("kind is not null and text is not null")
    every = lambda pattern, group=1: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    under = lambda base, spec: F.concat_ws("/", base, spec)
    here = folder(F.col("path"))
    spec = F.col("spec")

    quoted = rows.where("kind in ('script', 'arkts')").select("path", "kind", F.explode(every(_QUOTED)).alias("spec"))
    dart = rows.where("kind = 'dart'").select("path", "kind", F.explode(every(r"""import\s+['"]([^'"]+)['"]""")).alias("spec"))
    relative = quoted.unionByName(dart).withColumn("base", F.when(spec.startswith("."), under(here, spec)))

    routes = rows.where("kind = 'arkts'").select("path", F.lit("route").alias("kind"), F.explode(every(_ROUTE)).alias("spec")).where(~spec.startswith("$") & ~spec.startswith("@"))
    root = F.coalesce(F.regexp_extract(F.col("path"), "^(.*?(?:^|/)ets)/", 1), F.lit(""))
    bases = F.array_distinct(F.array(F.lit(""), F.when(root != "", root).otherwise(here), here))
    routes = routes.withColumn("base", F.explode(F.transform(bases, lambda b: under(b, F.regexp_replace("spec", "^/+", "")))))

    # Python: dots lead up from the file's folder, names stand for modules of their own as well.
    told = rows.where("kind = 'python'").select("path", "kind", F.explode(F.arrays_zip(every(_FROM, 1).alias("m"), every(_FROM, 2).alias("names"))).alias("x")).select("path", "kind", "x.*")
    names = F.filter(F.transform(F.split("names", ","), lambda n: F.trim(n)), lambda n: ~n.isin("", "*"))
    dotted = told.select("path", "kind", F.explode(F.concat(F.array("m"), F.transform(names, lambda n: F.concat(F.col("m"), F.lit("."), n)))).alias("spec"))
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    inner = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.+", "/")
    dotted = dotted.withColumn("base", F.concat_ws("/", here, F.repeat(F.lit("../"), dots - 1), inner))
    plain = rows.where("kind = 'python'").select("path", "kind", F.explode(every(_MODULE)).alias("spec")).withColumn("base", F.replace(spec, F.lit("."), F.lit("/")))

    marked = rows.where("path ilike '%.md'").select("path", "kind", F.explode(every(r"\[[^\]]+\]\(([^)]+)\)")).alias("spec"))
    tagged = rows.where("path ilike '%.html'").select("path", "kind", F.explode(every(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']""")).alias("spec"))
    links = marked.unionByName(tagged).where(~spec.startswith("#") & (spec != ""))
    target = F.regexp_replace(spec, "[#?].*$", "")
    outside = spec.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//")
    links = links.withColumn("base", F.when(~outside, F.when(spec.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(under(here, target))))
    return reduce(DataFrame.unionByName, [relative, routes, dotted, plain, links]).distinct()


def candidates(found: DataFrame) -> DataFrame:
    """(path, kind, spec, turn, candidate): the paths that a reference may mean, in the order in which they are tried: as it
    stands, with a suffix of its kind in place of its own, and as a folder with an index of the kind."""
    base = normal_path(F.col("base"))
    rows = found.withColumn("base", base).where("base is not null")
    stem = F.when(suffix(F.col("base")) != "", F.expr("left(base, length(base) - length(regexp_extract(base, '[^/]([.][^./]*)$', 1)))")).otherwise(F.col("base"))
    inside = lambda name: F.concat(F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/"))), F.lit(name))

    def tried(kind: str, endings: tuple[str, ...]) -> Column:
        own = F.when((F.lit(kind) == "link") | ((F.lit(kind) != "python") & (suffix(F.col("base")) != "")), F.col("base"))
        index = "__init__" if kind == "python" else "index"
        twice = [inside(f"{name}{e}") for name in (("__init__", "index") if kind not in ("python", "link") else (index,)) for e in endings]
        return F.array(own, *(F.when(stem != "", F.concat(stem, F.lit(e))) for e in endings), *twice)

    listed = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], tried(*kv)), SUFFIXES.items(), F).otherwise(F.array().cast("array<string>"))
    return rows.select("path", "kind", "spec", F.posexplode(listed).alias("turn", "candidate")).where("candidate is not null and candidate <> ''")


def resolved(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, kind, spec, status, target): each reference with every file that it may mean.

    status is resolved (one file), ambiguous (several), dangling (none in the project) or external (a package or an
    address, or a path out of the project); the last two have no target.
    """
    found = references(files)
    paths = (files if known is None else known).select(F.col("path").alias("target")).distinct()
    met = candidates(found).select("path", "kind", "spec", F.col("candidate").alias("target")).distinct().join(paths, "target")
    keys = ["path", "kind", "spec"]
    count = met.groupBy(*keys).agg(F.count("*").alias("__n"))
    inside = found.groupBy(*keys).agg(F.max(normal_path(F.col("base")).isNotNull()).alias("__inside"))
    status = F.when(F.col("__n") == 1, "resolved").when(F.col("__n") > 1, "ambiguous").when(F.col("__inside"), "dangling").otherwise("external")
    told = inside.join(count, keys, "left").select(*keys, status.alias("status"))
    return told.join(met, keys, "left").select(*keys, "status", "target")


def reached(entries: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(entry, path, depth): the files that each entry leads to in at most so many steps, each with its least number of steps.

    Only the newest files of an entry go on; what is known of an entry is not visited again, so cycles end.
    """
    step = links.where("target is not null").select("path", "target").distinct()
    front = written(entries.select(F.col("path").alias("entry"), "path").distinct())
    found = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = front.join(step, "path").select("entry", F.col("target").alias("path")).distinct()
        front = written(new.join(found.select("entry", "path"), ["entry", "path"], "left_anti"))
        found = found.unionByName(front.withColumn("depth", F.lit(d)))
    return found
