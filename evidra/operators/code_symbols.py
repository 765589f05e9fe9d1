"""Symbols and imports of source files, by patterns per language.

A baseline that stays in the JVM: one pass of ``regexp_extract_all`` per kind over
the content. It reads lines, not syntax trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import dirname, normal_path
from evidra.session import saved

#: Language -> kind -> pattern whose first group is the name. Patterns hold no lookaround, so other engines can run them too.
PATTERNS = {
    "ts": {
        "function": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)",
        "class": r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
        "variable": r"(?m)^(?:export\s+)?(?:const|let|var)\s+(\w+)",
        "interface": r"(?m)^\s*(?:export\s+)?interface\s+(\w+)",
    },
    "py": {"function": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "class": r"(?m)^\s*class\s+(\w+)", "variable": r"(?m)^([A-Za-z_]\w*)(?:\s*:\s*\w+)?\s*=[^=]"},
    "go": {"function": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"(?m)^type\s+(\w+)\s+struct", "variable": r"(?m)^(?:var|const)\s+(\w+)"},
    "java": {"class": r"(?m)^\s*(?:public\s+)?(?:final\s+|abstract\s+)*(?:class|interface|enum|record)\s+(\w+)"},
    "rb": {"function": r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)", "class": r"(?m)^\s*class\s+(\w+)", "variable": r"(?m)^([A-Z]\w*)\s*="},
}
PATTERNS["js"] = {k: p for k, p in PATTERNS["ts"].items() if k != "interface"}


def _found(pattern: str, kind: str, content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def symbols(files: DataFrame, language: Column) -> DataFrame:
    """``id, kind, name`` of the symbols in each file, each once. Null contents and other languages have none."""
    content = F.col("content")
    out = F.array().cast("array<struct<kind:string,name:string>>")
    for name, patterns in PATTERNS.items():
        own = F.concat(*[_found(p, k, content) for k, p in patterns.items()])
        out = F.when(language == name, own).otherwise(out)
    rows = files.where(F.col("content") != "").select("id", F.explode(F.array_distinct(out)).alias("s"))
    return rows.select("id", "s.kind", "s.name")


#: Language -> kind -> pattern of a line whose first group is the name (fixed values: the syntax of the languages). No lookaround, so other engines can run them too.
LINES = {
    "ts": {
        "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(?[\w\s,:]*\)?\s*=>", "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)",
        "interface": r"^\s*(?:export\s+)?interface\s+(\w+)", "type": r"^\s*(?:export\s+)?(?:type|enum)\s+(\w+)", "route": r"\.(?:get|post|put|patch|delete)\(\s*['\"`](/[^'\"`]*)", "test": r"^\s*(?:it|test|describe)\(\s*['\"`]([^'\"`]+)",
        "import": r"^\s*import\s.*?['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]",
    },
    "py": {
        "function": r"^\s*(?:async\s+)?def\s+(\w+)", "class": r"^\s*class\s+(\w+)", "route": r"^\s*@\w+\.(?:get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)", "test": r"^\s*(?:async\s+)?def\s+(test_\w+)", "import": r"^\s*from\s+([\w.]+)\s+import|^\s*import\s+([\w.]+)",
    },
    "rb": {
        "function": r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "class": r"^\s*class\s+(\w+)", "module": r"^\s*module\s+(\w+)", "route": r"^\s*(?:get|post|put|patch|delete)\s+['\"](/[^'\"]*)", "test": r"^\s*(?:it|describe|context)\s+['\"]([^'\"]+)", "import": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)",
    },
    "go": {
        "function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"^type\s+(\w+)\s+struct", "interface": r"^type\s+(\w+)\s+interface", "route": r"\.(?:GET|POST|PUT|PATCH|DELETE|HandleFunc)\(\s*\"(/[^\"]*)", "test": r"^func\s+(Test\w+)", "import": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",
    },
    "rs": {
        "function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", "class": r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "interface": r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "type": r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)",
        "module": r"^\s*(?:pub\s+)?mod\s+(\w+)", "import": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    },
    "java": {
        "function": r"^\s*(?:public|protected|private|static|final|abstract|synchronized)[\w\s<>\[\],.?]*\s(\w+)\s*\([^;]*\{\s*$", "class": r"^\s*(?:public\s+|final\s+|abstract\s+|static\s+)*class\s+(\w+)", "interface": r"^\s*(?:public\s+)?interface\s+(\w+)",
        "type": r"^\s*(?:public\s+)?(?:enum|record)\s+(\w+)", "route": r"^\s*@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:\w+\s*=\s*)?\"([^\"]*)", "import": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    },
    "php": {
        "function": r"^\s*(?:public\s+|protected\s+|private\s+|static\s+)*function\s+(\w+)", "class": r"^\s*(?:final\s+|abstract\s+)*class\s+(\w+)", "interface": r"^\s*interface\s+(\w+)", "route": r"Route::(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]*)", "import": r"^\s*use\s+([\w\\]+)",
    },
    "cs": {
        "function": r"^\s*(?:public|protected|private|internal|static|async|override|virtual)[\w\s<>\[\],.?]*\s(\w+)\s*\([^;]*\)\s*\{?\s*$", "class": r"^\s*(?:public\s+|internal\s+|sealed\s+|static\s+|abstract\s+|partial\s+)*class\s+(\w+)", "interface": r"^\s*(?:public\s+)?interface\s+(\w+)",
        "route": r"\[Http(?:Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)", "import": r"^\s*using\s+([\w.]+)\s*;",
    },
    "cpp": {
        "function": r"^[\w:<>,*&\s]+?[\s*&]((?:\w+::)?~?\w+)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$", "class": r"^\s*(?:class|struct)\s+(\w+)", "module": r"^\s*namespace\s+(\w+)", "import": r"^\s*#include\s+[<\"]([^>\"]+)",
    },
}
LINES["js"] = {k: p for k, p in LINES["ts"].items() if k not in ("interface", "type")}
LINES["tsx"], LINES["jsx"] = LINES["ts"], LINES["js"]
#: Words before a parenthesis that are no calls (fixed values).
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "func", "fn", "elif", "and", "or", "not", "in", "new", "await", "typeof", "sizeof", "match", "super", "class", "with", "except", "print")


def parse(files: DataFrame, language: Column) -> DataFrame:
    """``id, kind, name, line`` of what the lines of each file declare: symbols, routes, tests and imports.

    One pass over the lines of a file, which stay in one array; a language that isn't known gives nothing.
    """
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")

    def hits(patterns: dict[str, str]) -> Column:
        def own(kind: str, pattern: str) -> Column:
            groups = pattern.count("|^") + pattern.count(r"|\b") + 1
            name = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, pattern, g), F.lit("")) for g in range(1, groups + 1)])
            made = F.transform("_lines", lambda x, i: F.struct(F.lit(kind).alias("kind"), name(x).alias("name"), (i + 1).alias("line")))
            return F.filter(made, lambda s: s["name"].isNotNull())

        return F.concat(*[own(k, p) for k, p in patterns.items()])

    out = F.array().cast("array<struct<kind:string,name:string,line:int>>")
    for name, patterns in LINES.items():
        out = F.when(F.col("_language") == name, hits(patterns)).otherwise(out)
    rows = files.where(F.col("content") != "").select("id", language.alias("_language"), lines.alias("_lines"))
    return rows.where(F.col("_language").isin(*LINES)).select("id", F.explode(out).alias("s")).select("id", "s.kind", "s.name", "s.line")


def calls(files: DataFrame, language: Column) -> DataFrame:
    """``id, caller, callee, line, known``: calls by the function declared last before (empty at the top), and whether the same file declares the callee."""
    from pyspark.sql import Window as W

    declared = saved(parse(files, language).where("kind = 'function'").groupBy("id", "line").agg(F.min("name").alias("name")))
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    rows = files.where(F.col("content") != "").select("id", language.alias("_l"), lines.alias("lines")).where(F.col("_l").isin(*LINES)).dropDuplicates(["id"])
    numbered = rows.select("id", F.posexplode("lines").alias("i", "text")).select("id", (F.col("i") + 1).alias("line"), "text")
    inside = numbered.join(declared, ["id", "line"], "left").withColumn("caller", F.last("name", ignorenulls=True).over(W.partitionBy("id").orderBy("line")))
    inside = saved(inside.where(F.contains(F.col("text"), F.lit("("))))
    named = inside.select("id", "line", F.coalesce("caller", F.lit("")).alias("caller"), "name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    named = named.where(~F.col("callee").isin(*NO_CALLS) & ~F.coalesce(F.col("callee") == F.col("name"), F.lit(False)))
    known = declared.select("id", F.col("name").alias("callee"), F.lit(True).alias("_k")).distinct()
    return named.join(known, ["id", "callee"], "left").select("id", "caller", "callee", "line", F.coalesce("_k", F.lit(False)).alias("known"))


def diagnostics(files: DataFrame) -> DataFrame:
    """``id, code`` of files that can't be right at a glance: ``EMPTY_FILE``, ``UNBALANCED_BRACES`` and ``CONFLICT_MARKERS``, outside strings and comments."""
    # escapes go first, so that no pattern repeats a group: the JVM would recurse over long strings
    plain = F.regexp_replace(F.regexp_replace("content", r"\\.", ""), r"//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", "")
    count = lambda c: F.length(F.regexp_replace(plain, rf"[^\{c}]", ""))
    codes = F.array_compact(F.array(
        F.when(F.trim("content") == "", "EMPTY_FILE"), F.when(count("{") != count("}"), "UNBALANCED_BRACES"), F.when(F.col("content").rlike(r"(?m)^(<<<<<<< |>>>>>>> )"), "CONFLICT_MARKERS"),
    ))
    return files.where("content is not null").select("id", F.explode(codes).alias("code"))


#: What a relative specifier may stand for, in order (fixed values).
IMPORT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``id, specifier, target``: imports (``id, repo_root, path, specifier``) that name a file of the same repo.

    A relative specifier is taken from the folder of the importing file and stands for the nine candidates
    of ``IMPORT_ENDINGS``, the first that exists wins; any other stands for itself. Each candidate is a row of an equi-join.
    """
    relative = F.col("specifier").startswith(".")
    base = normal_path(F.concat(dirname("path"), F.lit("/"), F.replace("specifier", F.lit("\\"), F.lit("/"))))
    candidates = F.when(relative, F.transform(F.array(*map(F.lit, IMPORT_ENDINGS)), lambda e: F.concat(base, e))).otherwise(F.array("specifier"))
    rows = imports.select("id", "repo_root", "specifier", F.posexplode(candidates).alias("place", "target"))
    hits = rows.join(files.select("repo_root", F.col("path").alias("target")).distinct(), ["repo_root", "target"])
    return hits.groupBy("id", "specifier").agg(F.min_by("target", "place").alias("target"))
