"""Links analyses into one typed graph. Every rule is an equi-join over exploded analyses.

nodes: id, kind, name, path, file, start_line, end_line, signature, doc, exported, language, external.
edges: src, kind, dst, weight, variant, resolution, seq (raw; merge with graph.merged_edges).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T
from ..sources.analysis import ANALYSIS
from ..sources.checkpoints import checkpointed
from . import graph

# What a specifier may stand for.
ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.mts", "/index.cts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")

#: Rows of a table that every task gets.
LOOKUP = 100_000


def _file(path):
    return F.concat(F.lit("file:"), path)


def _symbol(path, name):
    return F.concat(F.lit("sym:"), path, F.lit("#"), name)


def nodes(analysis: DataFrame, *columns: str) -> DataFrame:
    """All columns, or some; only what those are made of is read."""
    none = F.lit(None).cast("string")
    number = F.lit(None).cast("int")

    def row(df, id_, kind, name, path=none, file=none, start=number, end=number, signature=none, doc=none, exported=F.lit(None).cast("boolean"), language=none, external=F.lit(False)):
        cols = dict(id=id_, kind=kind, name=name, path=path, file=file, start_line=start, end_line=end, signature=signature, doc=doc, exported=exported, language=language, external=external)
        return df.select(*[cols[k].alias(k) for k in columns or cols])

    p = F.col("path")
    repo = row(analysis.sparkSession.range(1), F.lit("repo:."), F.lit("repository"), F.lit("."), path=F.lit("."))
    dirs = analysis.select(F.explode(T.ancestors(p)).alias("d")).distinct()
    dirs = row(dirs, F.concat(F.lit("dir:"), "d"), F.lit("directory"), T.basename(F.col("d")), path=F.col("d"))
    files = row(analysis, _file(p), F.lit("file"), T.basename(p), p, p, F.lit(1), F.col("loc"), language=F.col("language"))
    s = analysis.withColumn("s", F.explode("symbols"))
    symbols = row(s, _symbol(p, F.col("s.symbol_path")), F.col("s.kind"), F.col("s.name"), p, p, F.col("s.start_line"), F.col("s.end_line"), F.col("s.signature"), F.col("s.doc"), F.col("s.exported"), F.col("language"))
    m = references(analysis).where("package IS NOT NULL").select("package").distinct()
    modules = row(m, F.concat(F.lit("mod:"), "package"), F.lit("module"), F.col("package"), external=F.lit(True))
    return reduce(DataFrame.union, [repo, dirs, files, symbols, modules])


def package_of(specifier):
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def normalized(folder, specifier):
    """A relative specifier against the folder of its file, without . and .. parts."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), specifier), "/"), lambda x: ~x.isin("", "."))

    def step(acc, x):
        return F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def references(analysis: DataFrame) -> DataFrame:
    """(path, specifier, bindings, type_only, seq, package): imports, and re-exports with a null seq, in one pass."""
    i = F.transform("imports", lambda m, k: F.struct(m["specifier"].alias("specifier"), m["bindings"].alias("bindings"), m["type_only"].alias("type_only"), k.alias("seq")))
    kind = analysis.select(i.alias("i")).schema["i"].dataType
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.elementType.fields[1:]]
    r = F.transform("reexports", lambda m: F.struct(m["specifier"].alias("specifier"), *none))
    empty = F.array().cast(kind)
    return _packaged(analysis.select("path", F.inline(F.concat(F.coalesce(i, empty), F.coalesce(r, empty)))))


def _packaged(refs: DataFrame) -> DataFrame:
    """refs with the package, which is read off the specifier."""
    outer = ~F.col("specifier").startswith(".") & ~F.col("specifier").startswith("/")
    return refs.withColumn("package", F.when(outer, package_of(F.col("specifier"))))


def resolved(refs: DataFrame, analysis: DataFrame) -> DataFrame:
    """refs (path, specifier) -> (folder, specifier, target) of those that name a file of the repository.

    What a specifier names follows from its folder, so each pair is tried once, however many files write it.
    """
    d = refs.where(F.col("specifier").startswith(".")).select(T.dirname(F.col("path")).alias("folder"), "specifier").distinct()
    d = checkpointed(d)  # else a join's filter on the base is tried on every reference, before they are made distinct
    d = d.withColumn("base", normalized(F.col("folder"), F.col("specifier")))
    base = F.col("base")
    bare = F.regexp_replace(base, r"\.([cm]?)js(x?)$", "")
    typed = F.regexp_extract(base, r"\.([cm]?)js(x?)$", 1)
    swapped = F.when(base.rlike(r"\.[cm]?jsx?$"), F.array(F.concat(bare, F.lit("."), typed, F.lit("ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.array().cast("array<string>"))
    tries = F.concat(F.array(base), swapped, F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS[1:]]))
    t = d.select("base").distinct().select("base", F.posexplode(tries).alias("k", "target")).join(analysis.select(F.col("path").alias("target")), "target")
    hit = t.groupBy("base").agg(F.min_by("target", "k").alias("target"))
    return d.join(hit, "base").select("folder", "specifier", "target")


def lookup(table: DataFrame) -> DataFrame:
    """A table that many rows look into, written once. If it is small every task gets it, so that a key that all rows
    look for puts them into no partition of its own."""
    out = checkpointed(table)
    return F.broadcast(out) if out.limit(LOOKUP + 1).count() <= LOOKUP else out


def imported(analysis: DataFrame, refs: DataFrame) -> DataFrame:
    """refs, of references() or some of them, with a target: those that name a file or a package."""
    outer = refs.where("package IS NOT NULL").withColumn("target", F.lit(None).cast("string"))
    inner = refs.where(F.col("specifier").startswith(".")).withColumn("folder", T.dirname(F.col("path")))
    inner = inner.join(lookup(resolved(refs, analysis)), ["folder", "specifier"])
    return outer.union(inner.select(*outer.columns))


def own_exports(analysis: DataFrame) -> DataFrame:
    """(path, again, name, file, symbol_path, to) of the symbols that a file exports itself, the first symbol of each name,
    per file and without a shuffle. to is the symbol's id, empty if the analysis has left the symbol out; again: whether
    the file re-exports too."""
    pairs = F.transform(F.filter("exports", lambda e: e["symbol_path"].isNotNull()), lambda e: F.struct(e["exported"].alias("name"), e["symbol_path"].alias("symbol_path")))
    d = analysis.select("path", (F.coalesce(F.size("reexports"), F.lit(0)) > 0).alias("again"), F.col("symbols.symbol_path").alias("here"), pairs.alias("pairs"))
    d = d.withColumn("pairs", F.array_sort(F.array_distinct("pairs")))
    first = F.filter("pairs", lambda e, i: (i == 0) | ~e["name"].eqNullSafe(F.get("pairs", i - 1)["name"]))
    known = F.transform(first, lambda e: F.struct(e["name"].alias("name"), e["symbol_path"].alias("symbol_path"), F.array_contains("here", e["symbol_path"]).alias("held")))
    p = F.col("path")
    return d.select("path", "again", F.inline(known)).select("path", "again", "name", p.alias("file"), "symbol_path", F.when(F.col("held"), _symbol(p, F.col("symbol_path"))).otherwise("").alias("to"))


def exported(analysis: DataFrame, again: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, file, symbol_path, to): what each file exports under which name, re-export chains resolved; and the part
    of it that files which re-export have. again: the re-exports (path, r).

    Only files that re-export, or that others re-export, take part in the rounds, and a round follows what the last one
    has found.
    """
    cells = ["path", "name", "file", "symbol_path", "to"]
    own = own_exports(analysis)
    r = again.select("path", F.col("r.specifier").alias("specifier"), "r.star", "r.names")
    r = r.join(targets.where("target IS NOT NULL AND seq IS NULL").select("path", "specifier", "target").distinct(), ["path", "specifier"])
    star = lookup(r.where("star").select(F.col("path").alias("via"), F.col("target").alias("path")).distinct())
    named = r.where("NOT star").select(F.col("path").alias("via"), F.col("target").alias("path"), F.explode("names").alias("n")).select("via", "path", F.col("n.imported").alias("name"), F.col("n.exported").alias("as_name"))
    named = lookup(named.where("as_name IS NOT NULL").distinct())
    ends = lookup(star.select("path").union(named.select("path")).distinct())
    chains = own.join(ends.withColumn("is_end", F.lit(True)), "path", "left").where("again OR is_end")
    new = found = checkpointed(chains.select(*cells).distinct())
    while not new.isEmpty():  # each round follows re-exports one file further, until nothing new is reached
        through = new.join(star, "path").where("name <> 'default'").select(F.col("via").alias("path"), "name", "file", "symbol_path", "to")
        renamed = new.join(named, ["path", "name"]).select(F.col("via").alias("path"), F.col("as_name").alias("name"), "file", "symbol_path", "to")
        new = checkpointed(through.union(renamed).distinct().join(found, cells, "left_anti"))
        found = found.union(new)
    w = Window.partitionBy("path", "name").orderBy((F.col("file") != F.col("path")), "file", "symbol_path")
    first = checkpointed(found.join(again.select("path").distinct(), "path", "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*cells))
    return first.union(own.where("NOT again").select(*cells)), first


def _edge(df, src, kind, dst, weight=None, variant=None, resolution=None, seq=None):
    none = F.lit(None).cast("string")
    return df.select(
        src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        (none if variant is None else variant).alias("variant"), (none if resolution is None else resolution).alias("resolution"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"),
    )


HERITAGE = {"extends_names": ("inheritance", "extends"), "implements_names": ("inheritance", "implements"), "composition_names": ("composition", None), "type_refs": ("references", None)}


#: Columns of an analysis, and fields of its symbols, that the edges of a kind, and ids and kinds of nodes, are made of.
_HEIRS = "path imports reexports exports symbols"
NEEDS = {
    "contains": ("path symbols", "symbol_path parent"), "imports": ("path imports reexports", ""), "exports": ("path reexports exports symbols", "symbol_path"),
    **{kind: (_HEIRS, f"symbol_path parent {' '.join(f for f, (k, _) in HERITAGE.items() if k == kind)}") for kind in ("inheritance", "composition", "references")},
    "calls": (f"{_HEIRS} file_calls", "symbol_path parent name exported calls"), "nodes": ("path imports reexports symbols", "symbol_path kind"),
}


def needs(*kinds: str) -> StructType:
    """The part of an analysis that edges() reads for some kinds, and nodes() for id and kind."""
    columns, fields = ({x for k in kinds for x in NEEDS[k][at].split()} for at in (0, 1))
    out = StructType([f for f in StructType.fromDDL(ANALYSIS) if f.name in columns])
    for f in out:
        if f.name == "symbols":
            f.dataType = ArrayType(StructType([x for x in f.dataType.elementType if x.name in fields]))
    return out


def edges(analysis: DataFrame, *kinds: str) -> DataFrame:
    """Edges of all kinds, or of some; only what those need is linked.

    No end is missing in nodes(): paths come from the analyses, and a symbol is looked for in that of its own file, as an
    analysis may leave some out.
    """
    p = F.col("path")
    out = []

    def asked(*of):
        return not kinds or any(k in kinds for k in of)

    up = T.dirname(p)
    above = F.when(up == ".", F.lit("repo:.")).otherwise(F.concat(F.lit("dir:"), up))
    if asked("contains"):  # repository, directories, files, symbols
        dirs = analysis.select(F.explode(T.ancestors(p)).alias("path")).distinct()
        out.append(_edge(dirs, above, "contains", F.concat(F.lit("dir:"), p)))
        here = F.col("symbols.symbol_path")
        row = lambda a, b, seq: F.struct(a.alias("a"), b.alias("b"), seq.alias("seq"))
        held = F.transform("symbols", lambda x, k: F.when(x["parent"].isNull() | F.array_contains("here", x["parent"]), row(F.when(x["parent"].isNull(), _file(p)).otherwise(_symbol(p, x["parent"])), _symbol(p, x["symbol_path"]), k)))
        whole = F.array(row(above, _file(p), F.lit(0)))
        h = analysis.select("path", here.alias("here"), "symbols").select(F.inline(F.concat(whole, F.filter(F.coalesce(held, F.array().cast("array<struct<a:string,b:string,seq:int>>")), lambda x: x.isNotNull()))))
        out.append(_edge(h, F.col("a"), "contains", F.col("b"), seq=F.col("seq")))
    fields = [f for f, (kind, _) in HERITAGE.items() if asked(kind)]
    if not (asked("imports", "exports", "calls") or fields):
        return reduce(DataFrame.union, out)
    again = checkpointed(analysis.select("path", F.explode("reexports").alias("r"))) if asked("exports", "calls") or fields else None
    if asked("imports", "calls") or fields:
        refs = references(analysis)
    else:  # exports alone follow no imports
        refs = _packaged(again.select("path", F.col("r.specifier").alias("specifier"), F.lit(None).cast("int").alias("seq")))
    i = checkpointed(imported(analysis, refs))
    named = i.where("seq IS NOT NULL")
    if asked("imports"):  # weighted by their bindings
        weight = F.greatest(F.size("bindings"), F.lit(1))
        to = F.coalesce(F.when(F.col("target").isNotNull(), _file(F.col("target"))), F.concat(F.lit("mod:"), "package"))
        out.append(_edge(named, _file(p), "imports", to, weight, F.when(F.col("type_only"), "type-only"), seq=F.col("seq")))
    if not (asked("exports", "calls") or fields):
        return reduce(DataFrame.union, out)
    x, chained = exported(analysis, again, i)
    if asked("exports"):  # own symbols, named re-exports to the symbol, stars to the file
        names = again.where("NOT r.star").select("path", F.explode("r.names").alias("n")).select("path", F.col("n.exported").alias("name")).distinct()
        out.append(_edge(x.where("file = path"), _file(p), "exports", F.col("to")))
        out.append(_edge(chained.where("file <> path").join(names, ["path", "name"]), _file(p), "exports", F.col("to"), variant=F.lit("reexport")))
        star = again.where("r.star").select("path", F.col("r.specifier").alias("specifier")).join(i.where("target IS NOT NULL AND seq IS NULL").select("path", "specifier", "target").distinct(), ["path", "specifier"])
        out.append(_edge(star, _file(p), "exports", _file(F.col("target")), variant=F.lit("reexport")))
    if asked("calls") or fields:
        out += _uses(analysis, named.where("target IS NOT NULL"), x, fields, asked("calls"))
    return reduce(DataFrame.union, out).where("src <> '' AND dst <> ''")


def _found(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """The part of a table that rows look for by keys."""
    return lookup(table.join(lookup(rows.select(*keys).distinct()), list(keys), "left_semi"))


def _uses(analysis: DataFrame, named: DataFrame, x: DataFrame, fields: list[str], calls: bool) -> list[DataFrame]:
    """Edges of calls, type references, heritage and composition.

    A name means what its file binds by an import (named, looked up in the exports x), else what the file declares. Which
    of the two it may be is read off its own analysis, so only bound names are joined with the bindings.
    """
    p, out = F.col("path"), []
    b = named.select("path", "target", F.explode("bindings").alias("b")).select("path", "target", F.col("b.local").alias("local"), F.col("b.imported").alias("name"))
    bound = b.join(_found(b.select(F.col("target").alias("path"), "name"), x, "path", "name").withColumnRenamed("path", "target"), ["target", "name"])
    bound = bound.select("path", "local", "file", "symbol_path", "to").repartition("path", "local").distinct()
    by_import = bound.select("path", F.col("local").alias("name"), F.col("to").alias("t1"))
    none = F.array().cast("array<string>")
    tops = F.transform(F.filter("symbols", lambda s: s["parent"].isNull()), lambda s: s["symbol_path"])
    locals_ = F.flatten(F.transform("imports", lambda m: m["bindings"]))["local"]
    s = analysis.select("path", F.explode("symbols").alias("s"))
    files = analysis.select("path", "symbols", *["file_calls"] * calls, F.coalesce(tops, none).alias("tops"), F.coalesce(locals_, none).alias("locals"))

    def linked(rows):
        """rows with path, name, is_bound -> and t1, what the import of the name leads to."""
        free = rows.where("NOT is_bound").withColumn("t1", F.lit(None).cast("string"))
        return rows.where("is_bound").join(by_import, ["path", "name"], "left").select(*free.columns).union(free)

    def marked(name):  # in the arrays, so that no row carries the names of its file
        return F.coalesce(F.array_contains("locals", name), F.lit(False)).alias("is_bound"), F.coalesce(F.array_contains("tops", name), F.lit(False)).alias("is_top")

    if fields:
        def listed(s, field):
            kind, variant = (F.lit(x).cast("string") for x in HERITAGE[field])
            return F.transform(F.coalesce(s[field], none), lambda n: F.struct(s["symbol_path"].alias("own"), kind.alias("kind"), variant.alias("variant"), n.alias("name"), *marked(n)))

        used = F.flatten(F.transform("symbols", lambda s: F.concat(*[listed(s, f) for f in fields])))
        u = linked(files.select("path", F.inline(used)))
        to = F.coalesce("t1", F.when(F.col("is_top"), _symbol(p, F.col("name"))))
        out.append(_edge(u.withColumn("dst_", to).where("dst_ IS NOT NULL"), _symbol(p, F.col("own")), F.col("kind"), F.col("dst_"), variant=F.col("variant")))
    if not calls:
        return out

    def called(c, own, parent):
        return F.struct(own.alias("own"), parent.alias("parent"), c["name"].alias("name"), c["receiver"].alias("receiver"), c["is_new"].alias("is_new"), *marked(c["name"]))

    inner = F.flatten(F.transform("symbols", lambda s: F.transform(s["calls"], lambda c: called(c, s["symbol_path"], s["parent"]))))
    outer = F.transform("file_calls", lambda c: called(c, F.lit(None).cast("string"), F.lit(None).cast("string")))
    c = files.select("path", F.inline(F.concat(F.coalesce(inner, F.array().cast(dict(files.select(outer.alias("o")).dtypes)["o"])), outer)))
    c = checkpointed(c.groupBy(*c.columns).agg(F.count("*").alias("n")))
    free, this = F.col("receiver").isNull(), F.col("receiver") == "this"
    # members of the own class, of namespaces and of classes: only those that a call names are looked for
    member = s.where("s.parent IS NOT NULL").select("path", F.col("s.parent").alias("parent"), F.col("s.name").alias("name"), F.col("s.symbol_path").alias("s4"))
    own = _found(c.where(this), member, "path", "parent", "name")
    asked = lookup(c.where(~free).select("path", "receiver", "name").distinct())
    space = asked.join(b.where("name = '*'").select("path", F.col("local").alias("receiver"), "target"), ["path", "receiver"])
    space = space.join(_found(space.select(F.col("target").alias("path"), "name"), x, "path", "name").select(F.col("path").alias("target"), "name", F.col("to").alias("t3")), ["target", "name"])
    static = asked.join(bound.select("path", F.col("local").alias("receiver"), F.col("file").alias("f5"), F.col("symbol_path").alias("p5")), ["path", "receiver"])
    parts = _found(static.select(F.col("f5").alias("path"), F.col("p5").alias("parent"), "name"), member, "path", "parent", "name")
    static = static.join(parts.select(F.col("path").alias("f5"), F.col("parent").alias("p5"), "name", _symbol(F.col("path"), F.col("s4")).alias("t5")), ["f5", "p5", "name"])
    everywhere = s.where("s.exported").select(F.col("s.name").alias("name"), p.alias("f6"), F.col("s.symbol_path").alias("s6"))
    everywhere = everywhere.join(lookup(c.where(~(free & F.col("is_top"))).select("name").distinct()), "name", "left_semi")
    unique = everywhere.groupBy("name").agg(F.count("*").alias("k"), F.first("f6").alias("f6"), F.first("s6").alias("s6")).where("k = 1")
    c = linked(c).join(own, ["path", "parent", "name"], "left").join(lookup(space.select("path", "receiver", "name", "t3")), ["path", "receiver", "name"], "left")
    c = c.join(lookup(static.select("path", "receiver", "name", "t5")), ["path", "receiver", "name"], "left").join(lookup(unique.select("name", _symbol(F.col("f6"), F.col("s6")).alias("t6"))), "name", "left")

    rules = ("import", "same-class", "namespace", "same-file", "global-unique")

    def to(dst, how):
        return F.struct(dst.alias("dst"), F.lit(how).alias("how"), F.lit(rules.index(how)).alias("seq"))

    pick = (
        F.when(free & F.col("t1").isNotNull(), to(F.col("t1"), "import"))
        .when(this & F.col("s4").isNotNull(), to(_symbol(p, F.col("s4")), "same-class"))
        .when(F.col("t3").isNotNull(), to(F.col("t3"), "namespace"))
        .when(F.col("t5").isNotNull(), to(F.col("t5"), "import"))
        .when(free & F.col("is_top"), to(_symbol(p, F.col("name")), "same-file"))
        .when(F.col("t6").isNotNull(), to(F.col("t6"), "global-unique"))
    )
    c = c.withColumn("to", pick).where("to IS NOT NULL")
    src = F.when(F.col("own").isNull(), _file(p)).otherwise(_symbol(p, F.col("own")))
    return [*out, _edge(c, src, "calls", F.col("to.dst"), F.col("n"), F.when(F.col("is_new"), "instantiates"), F.col("to.how"), F.col("to.seq") * 2 + F.coalesce(F.col("is_new").cast("int"), F.lit(0)))]


def merged(analysis: DataFrame, *kinds: str) -> DataFrame:
    """Merged edges of all kinds, or of some."""
    return graph.merged_edges(edges(analysis, *kinds))


def build(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, merged edges) of a repository."""
    return checkpointed(nodes(analysis).dropDuplicates(["id"])), checkpointed(merged(analysis))
