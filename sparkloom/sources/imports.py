"""Import extraction and resolution for fourteen languages: one pattern and a few path templates a language.

Extraction is one pass of a regular expression over each source; resolution joins all candidate
paths with the list of files at once and keeps the first that exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extension, pattern of an import (its first group is the path), templates of the files it may name.
LANGUAGES = {
    "python": ("py", r"(?m)^\s*(?:from|import)\s+([.\w]+)", ("{p}.py", "{p}/__init__.py")),
    "javascript": ("js", r"""(?:from|require\(|import)\s*\(?['"]([^'"]+)['"]""", ("{p}", "{p}.js", "{p}.ts", "{p}/index.js", "{p}/index.ts")),
    "typescript": ("ts", r"""(?:from|require\(|import)\s*\(?['"]([^'"]+)['"]""", ("{p}", "{p}.ts", "{p}.js", "{p}/index.ts", "{p}/index.js")),
    "java": ("java", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", ("{p}.java", "src/main/java/{p}.java")),
    "go": ("go", r"""(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$""", ("{p}.go", "{p}/main.go")),
    "rust": ("rs", r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)", ("{p}.rs", "{p}/mod.rs", "src/{p}.rs")),
    "c": ("c", r"""(?m)^\s*#\s*include\s*["<]([^">]+)[">]""", ("{p}", "include/{p}")),
    "cpp": ("cpp", r"""(?m)^\s*#\s*include\s*["<]([^">]+)[">]""", ("{p}", "include/{p}")),
    "csharp": ("cs", r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", ("{p}.cs",)),
    "kotlin": ("kt", r"(?m)^\s*import\s+([\w.]+)", ("{p}.kt", "src/main/kotlin/{p}.kt")),
    "scala": ("scala", r"(?m)^\s*import\s+([\w.]+)", ("{p}.scala", "src/main/scala/{p}.scala")),
    "ruby": ("rb", r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", ("{p}.rb", "lib/{p}.rb")),
    "php": ("php", r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""", ("{p}", "src/{p}")),
    "lua": ("lua", r"""require\s*\(?\s*['"]([^'"]+)['"]""", ("{p}.lua", "{p}/init.lua")),
    "pascal": ("pas", r"(?i)\buses\s+(\w+)", ("{p}.pas",)),
    "cobol": ("cbl", r"(?im)^(?:.{6}[^*/\n])?.*?\b(?:COPY|CALL)\s+['\"]?([\w-]+)['\"]?", ("cpy/{p}.cpy", "{p}.cpy", "{p}.cbl")),
}
DOTTED = ("python", "java", "csharp", "kotlin", "scala", "lua")


def scan(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(path, source) of all files of a language below a folder, by a recursive, distributed listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{LANGUAGES[language][0]}").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("source"))


def extract(sources: DataFrame) -> DataFrame:
    """(program_id, language, ord, module) of sources (program_id, language, source)."""
    found = None
    for name, (_, pattern, _) in LANGUAGES.items():
        found = F.when(F.col("language") == name, F.regexp_extract_all("source", F.lit(pattern), 1)) if found is None else found.when(F.col("language") == name, F.regexp_extract_all("source", F.lit(pattern), 1))
    return sources.select("program_id", "language", F.posexplode(found).alias("ord", "module"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (…, language, dir, module) with path: the first candidate that is in ``files`` (path); null for a library."""
    module = F.regexp_replace("module", r"^\./", "")
    p = F.when(F.col("language").isin(*DOTTED), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))).when(F.col("language") == "rust", F.replace(module, F.lit("::"), F.lit("/"))).otherwise(module)
    templates = None
    for name, (_, _, forms) in LANGUAGES.items():
        some = F.array(*[F.concat(F.lit(a), F.col("p"), F.lit(b)) for a, b in (f.split("{p}") for f in forms)])
        templates = F.when(F.col("language") == name, some) if templates is None else templates.when(F.col("language") == name, some)
    rows = imports.withColumn("p", p)
    keys = imports.columns
    c = rows.select(*keys, F.posexplode(templates).alias("n", "form"))
    c = c.select(*keys, "n", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.when(F.col("dir") == "", F.col("form")).otherwise(F.concat_ws("/", "dir", "form")).alias("path")), F.struct(F.lit(1).alias("o"), F.col("form").alias("path")))).alias("c"))
    c = c.select(*keys, "n", "c.o", "c.path").join(files.select("path").distinct(), "path")
    w = Window.partitionBy(*keys).orderBy("o", "n")
    best = c.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "path")
    return imports.join(best, keys, "left")


def project_roots(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, root): the nearest folder above each file that holds a marker file; null if none."""
    up = files.withColumn("parts", F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1))
    up = up.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("root"))
    at = markers.select(F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("root")).distinct()
    near = up.join(at, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(near, "path", "left")


def connections(sources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of record-processing sources (path, source): nodes (kind, id, path), edges (src, kind, dst), names in upper case.

    Programs CALL programs by literal and COPY copybooks; comment lines do not count. A program's path is that of its source, else of
    the file (path) of its name; copybooks have none.
    """
    text = F.regexp_replace("source", r"(?m)^.{6}[*/].*$", "")
    program = F.upper(F.regexp_extract(text, r"(?i)PROGRAM-ID\.\s+([\w-]+)", 1))
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), F.upper(x).alias("dst")))
    every = F.concat(found(r"""(?i)\bCALL\s+['"]([\w-]+)['"]""", "CALL"), found(r"""(?i)\bCOPY\s+['"]?([\w-]+)""", "COPY"))
    edges = sources.select(program.alias("src"), F.inline(every)).select("src", "kind", "dst").distinct()
    own = sources.select(F.lit("PROGRAM").alias("kind"), program.alias("id"), "path")
    named = files.where(~F.lower("path").endswith(".cpy")).select(F.upper(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("id"), F.col("path").alias("file"))
    called = edges.where("kind = 'CALL'").select(F.col("dst").alias("id")).join(named, "id", "left").select(F.lit("PROGRAM").alias("kind"), "id", F.col("file").alias("path"))
    copied = edges.where("kind = 'COPY'").select(F.lit("COPYBOOK").alias("kind"), F.col("dst").alias("id"), F.lit(None).cast("string").alias("path"))
    return own.union(called).union(copied).groupBy("kind", "id").agg(F.min("path").alias("path")), edges
