"""Analyses of files as a DataFrame, by the first analyzer that claims a file's extension; and their chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import EXTENSIONS
from ..functions import text as T
from . import script

CALL = "array<struct<name:string,receiver:string,is_new:boolean>>"
ANALYSIS = (
    "path string, language string, loc int, "
    "imports array<struct<specifier:string,bindings:array<struct<local:string,imported:string>>,type_only:boolean>>, "
    "reexports array<struct<specifier:string,star:boolean,names:array<struct<imported:string,exported:string>>>>, "
    "exports array<struct<exported:string,symbol_path:string>>, "
    "symbols array<struct<symbol_path:string,name:string,kind:string,exported:boolean,default_export:boolean,parent:string,signature:string,doc:string,"
    f"start_line:int,end_line:int,extends_names:array<string>,implements_names:array<string>,composition_names:array<string>,calls:{CALL},type_refs:array<string>>>, "
    f"file_calls {CALL}, file_type_refs array<string>"
)
#: (extensions, function of (path, content)); plugins stand before the built-in one.
Analyzer = tuple[tuple[str, ...], Callable[[str, str], dict | None]]
BUILT_IN: Analyzer = (EXTENSIONS, script.analyze)
FILE_CHUNK, SYMBOL_CHUNK = 4000, 8000
#: Parts of the files for each core, and analyses that a task holds as Python objects at once.
PARTS, HELD = 4, 256


def analyses(files: DataFrame, analyzers: tuple[Analyzer, ...] = (BUILT_IN,), schema: StructType | None = None) -> DataFrame:
    """One row per file that an analyzer could read, with the columns and fields of schema (None: all). Files are dealt to all cores first: a table of a million of them may
    be one small split. A task hands its analyses on in small groups: each has hundreds of objects, which the collector
    would walk through again and again."""
    columns = schema or StructType.fromDDL(ANALYSIS)
    arrow = to_arrow_schema(columns)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                rows = []
                for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    dot = path.rfind(".")
                    own = next((f for ext, f in analyzers if path[dot:].lower() in ext), None)
                    got = own(path, content or "") if own else None
                    if got is not None:
                        rows.append(got)
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    parts = PARTS * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(parts, "path").mapInArrow(run, columns)


def chunks(analysis: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file, name, kind, text, hash, start_line, end_line): one chunk per file and per top-level symbol."""
    a = analysis.join(files.select("path", "content"), "path")
    imports = F.transform("imports", lambda i: F.concat(F.lit("import "), F.array_join(F.transform(i["bindings"], lambda b: b["local"]), ", "), F.lit(" from "), i["specifier"]))
    again = F.transform("reexports", lambda r: F.concat(F.lit("export "), F.when(r["star"], "*").otherwise(F.array_join(F.transform(r["names"], lambda n: n["exported"]), ", ")), F.lit(" from "), r["specifier"]))
    top = F.filter("symbols", lambda s: s["parent"].isNull())
    cards = F.flatten(F.transform(top, lambda s: F.filter(F.array(s["doc"], s["signature"]), lambda x: x.isNotNull() & (x != ""))))
    whole = F.array_join(F.concat(F.array(F.concat(F.lit("// "), "path")), imports, again, cards), "\n")
    file_rows = a.select(F.concat(F.lit("file:"), "path").alias("id"), F.col("path").alias("file"), T.basename(F.col("path")).alias("name"), F.lit("file").alias("kind"), T.truncate_lines(whole, FILE_CHUNK).alias("text"), F.lit(1).alias("start_line"), F.col("loc").alias("end_line"))
    s = a.select("path", F.split("content", "\n", -1).alias("lines"), F.explode(top).alias("s"))
    body = F.array_join(F.slice("lines", F.col("s.start_line"), F.greatest(F.col("s.end_line") - F.col("s.start_line") + 1, F.lit(1))), "\n")
    symbol_rows = s.select(F.concat(F.lit("sym:"), "path", F.lit("#"), "s.symbol_path").alias("id"), F.col("path").alias("file"), F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), T.truncate_lines(body, SYMBOL_CHUNK).alias("text"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"))
    out = file_rows.union(symbol_rows)
    return out.withColumn("hash", F.sha1("text"))


def fingerprint(settings: dict) -> str:
    import hashlib

    return hashlib.sha1(json.dumps(settings, sort_keys=True, default=list).encode()).hexdigest()
