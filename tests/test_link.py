"""Linking of files: rules met together, and the sizes of what is joined."""

import pytest
from pyspark.sql import functions as F

from tesselon.operators import link


def odd_repository(spark):
    """Re-export chains and cycles, names bound, declared and renamed, namespaces, statics, members; and files at the root."""
    files = {
        "base.ts": "export class Base { static make() { return new Base(); } keep() { this.keep(); this.lost(); } }\nexport function helper() { twice(); }\nfunction twice() {}\nexport { twice as other };\n",
        "a/index.ts": 'export * from "../base";\nexport { Base as Root, nothing as gone } from "../base.js";\nexport * from "./loop";\nimport { helper } from "../base";\nhelper();\n',
        "a/loop.ts": 'export * from ".";\nexport * from "../b";\nexport function own() { own(); }\nexport default function () {}\n',
        "b/index.ts": 'export * as space from "../base";\nexport { Root as Stem } from "../a";\nexport * from "../a/loop.js";\n',
        "b/use.ts": 'import * as tools from "../a";\nimport { Root, Stem, helper as h, own } from "../a/loop";\nimport type { Base } from "../base";\nexport class Use extends Root implements Base { private x: Stem; go(k: Base) { tools.helper(); Root.make(); h(); new Stem(); own(); this.go(k); unknown(); far(); } }\n',
        "c/far.ts": 'import far0 from "@scope/far/deep";\nimport { lost } from "./absent";\nexport function far() { tools.helper(); far0(); }\nfunction go() { lost(); }\n',
        "c/two.jsx": 'const { x } = require("../c/far");\nexport const far2 = () => far();\nclass Use {}\nclass Other extends Use {}\n',
    }
    from tesselon.sources import analysis

    return analysis.analyses(spark.createDataFrame(sorted(files.items()), "path string, content string")).cache()


@pytest.fixture(scope="module")
def analysis(spark):
    return odd_repository(spark)


def rows(df):
    return sorted(str((r.src, r.kind, r.dst, r.weight, r.n, r.variant, r.resolution)) for r in df.collect())


def test_one_lookup_for_a_specifier(spark):
    """What many files of a folder import is tried once, not once for each file."""
    from tesselon.sources import analysis as A

    a = A.analyses(spark.createDataFrame([("b.ts", "export const x = 1;"), *[(f"app/c{i}.ts", 'import { x } from "../b";') for i in range(50)]], "path string, content string"))
    got = link.resolved(a.select("path", F.explode("imports").alias("i")).select("path", "i.specifier"), a).collect()
    assert [tuple(r) for r in got] == [("app", "../b", "b.ts")]
    assert link.merged(a, "imports").where("dst = 'file:b.ts'").count() == 50


@pytest.fixture(scope="module")
def every(analysis):
    return link.merged(analysis).cache()


def test_one_kind_and_all(analysis, every):
    """A kind linked alone has the edges that it has among all, and every end is a node."""
    ids = {r.id for r in link.nodes(analysis).collect()}
    assert {x for r in every.collect() for x in (r.src, r.dst)} <= ids
    for kind in ("contains", "inheritance"):
        assert rows(link.merged(analysis, kind)) == rows(every.where(F.col("kind") == kind)) != []


def test_large_lookups(analysis, every, monkeypatch):
    """The same edges if no lookup is small enough for every task."""
    monkeypatch.setattr(link, "LOOKUP", 0)
    assert rows(link.merged(analysis)) == rows(every)


def test_rules_met_together(every):
    got = {(r.src, r.kind, r.dst): (r.weight, r.n, r.variant, r.resolution) for r in every.collect()}
    use = "sym:b/use.ts#Use"
    assert got[f"{use}.go", "calls", "sym:base.ts#Base.make"] == (1.0, 1, None, "import")
    assert got[f"{use}.go", "calls", "sym:base.ts#Base"] == (1.0, 1, "instantiates", "import")
    assert got[f"{use}.go", "calls", "sym:base.ts#helper"] == (2.0, 2, None, "import")  # by a renamed import and a namespace
    assert got[use, "inheritance", "sym:base.ts#Base"][:2] == (2.0, 2)
    assert (f"{use}.go", "calls", f"{use}.go") not in got


def test_symbols_that_the_analysis_left_out(spark):
    """No edge leads to or from a symbol that is not in the analysis of its file."""
    from tesselon.sources import analysis as A

    a = A.analyses(spark.createDataFrame([("a.ts", "export class A { m() {} }")], "path string, content string"))
    a = a.withColumn("symbols", F.filter("symbols", lambda s: s["symbol_path"] != "A"))
    assert [(r.src, r.dst) for r in link.merged(a, "contains", "exports").collect()] == [("repo:.", "file:a.ts")]


def test_a_lexer_matches_words_only(monkeypatch):
    """Single spaces, line ends and brackets need no match of the pattern."""
    from tesselon.sources import script

    class Counted:
        asked, pattern = 0, script._TOKEN

        def match(self, s, i):
            self.asked += 1
            return self.pattern.match(s, i)

    counted = Counted()
    monkeypatch.setattr(script, "_TOKEN", counted)
    text = "f (a, [b]) ;\n{ c : d }\n`x\n` /* y\n*/ e"
    assert [(t.text, t.line) for t in script.lex(text)] == [*((x, 1) for x in "f(a,[b]);"), *((x, 2) for x in "{c:d}"), ("`x\n`", 3), ("e", 5)]
    assert counted.asked == 8


def test_a_task_holds_few_analyses(spark):
    """A batch of files is analyzed in groups, with the same rows whether it ends one or not."""
    from tesselon.sources import analysis as A

    n = A.HELD + 3
    held = spark.createDataFrame([(f"a/f{i}.ts", f"export const x{i} = {i};") for i in range(n)], "path string, content string")
    assert {(r.path, r.exports[0].exported) for r in A.analyses(held).collect()} == {(f"a/f{i}.ts", f"x{i}") for i in range(n)}


def test_a_kind_needs_part_of_an_analysis(spark, every, monkeypatch):
    """Edges of one kind come from the columns and fields that they are made of; exports alone follow no imports."""
    from tesselon.sources import analysis as A

    whole = A.analyses
    for kind in sorted(set(link.NEEDS) - {"nodes"}):
        with monkeypatch.context() as m:
            m.setattr(A, "analyses", lambda files, kind=kind: whole(files, schema=link.needs(kind)))
            part = odd_repository(spark)
        assert set(part.columns) < {f.name for f in link.StructType.fromDDL(A.ANALYSIS)}
        assert rows(link.merged(part, kind)) == rows(every.where(F.col("kind") == kind)) != []
    assert "imports" not in link.needs("exports").names


def test_all_kinds_in_few_passes(spark, analysis):
    """Names of all fields are looked for in one pass, whatever kinds are asked for; a specifier is tried on distinct folders
    only; and a part of the analysis gives the same ids and kinds of nodes, and all edges."""
    from tesselon.sources import analysis as A

    files = spark.createDataFrame([("b.ts", "export class A {}"), ("a/c.ts", 'import { A } from "../b";\nexport class C extends A { x: A; }')], "path string, content string")
    a = A.analyses(files, schema=link.needs(*link.NEEDS))

    def passes(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")

    assert passes(link.edges(a, "contains")) == 2
    assert passes(link.edges(a, "composition")) == passes(link.edges(a, "inheritance", "composition", "references")) > 0
    assert passes(link.resolved(link.references(a), a)) == 1
    whole = A.analyses(files)
    assert rows(link.merged(a)) == rows(link.merged(whole)) != []
    assert sorted(link.nodes(a, "id", "kind").collect()) == sorted(link.nodes(whole).select("id", "kind").collect())
