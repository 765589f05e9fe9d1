"""Classifiers of paths, code and findings as column expressions.

The lists are fixed values: conventions of languages and frameworks. Tests of a path are where it
begins, what it holds and how it ends; the first class that fits wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.scalars import basename, dirname, extension, posix

#: Role -> (begins, holds, ends), in order (fixed values).
ROLES = {
    "test": (
        ("tests/", "test/"), ("/tests/", "/test/", "/spec/", "__tests__/", ".test.", ".spec."),
        ("_test.ts", "_test.js", "_test.py", "_test.rb", "_spec.rb", "_test.go", "_test.rs", "Test.java", "Tests.java", "Test.php", "Tests.cs", "Test.cs", "_test.cpp", "_test.cc", "_test.cxx"),
    ),
    "fixture": (
        ("fixtures/", "fixture/", "mocks/", "stubs/", "__mocks__/", "__fixtures__/"), ("/fixtures/", "/fixture/", "__fixtures__/", "/mocks/", "/stubs/", "__mocks__/"), (),
    ),
    "docs": (("docs/",), ("/docs/",), (".md", ".rst", ".txt", "README", "CHANGELOG", "LICENSE")),
    "config": (
        (), (), ("package.json", "tsconfig.json", "jsconfig.json", ".eslintrc.json", ".prettierrc.json", "jest.config.js", "vitest.config.ts", ".yaml", ".yml"),
    ),
    "generated": (
        ("dist/", "build/", "generated/", "out/", "vendor/", "vendors/", "third_party/", "third-party/"),
        ("/dist/", "/build/", "/generated/", "__generated__/", "/out/", "/vendor/", "/vendors/", "/third_party/", "/third-party/"), (".d.ts", ".min.js", ".min.css", ".min.mjs", ".min.cjs"),
    ),
}
#: Folders and files of entry points (fixed values): folders anywhere; files at the top or in ``src``; files anywhere.
ENTRY_FOLDERS = ("api", "routes", "handlers", "controllers")
ENTRY_FILES = {
    "server": ("ts", "js", "py", "rb", "go", "rs", "php"), "app": ("ts", "js", "py", "rb", "go", "rs", "php"), "index": ("ts", "js", "py", "rb"), "main": ("ts", "js", "py", "rb", "go", "rs", "php", "cs", "cpp"),
    "Server": ("java",), "App": ("java",), "Main": ("java",), "Program": ("cs",),
}
ENTRY_ANYWHERE = {
    "server": ("ts", "js", "rb"), "app": ("ts", "js", "rb"), "index": ("ts", "js", "rb"), "main": ("ts", "js", "rb", "go", "rs", "cs", "cpp"), "Main": ("java",), "Program": ("cs",),
}
#: Code of entry points (fixed values).
ENTRY_CODE = (
    r"app\.(use|listen|run)", r"express(\(\)|\.Router)", r"createServer", r"router\.", r"if __name__ == ['\"]__main__['\"]", r"(FastAPI|Flask|APIRouter)\(\)", r"uvicorn\.run", r"Rails\.application", r"Sinatra::Base",
    r"\b(get|post|put|patch|delete)\s+['\"][^'\"]+['\"]", r"__FILE__\s*==\s*\$PROGRAM_NAME", r"\bfunc\s+main\s*\(", r"\bfn\s+main\s*\(", r"public\s+static\s+void\s+main\s*\(", r"Route::(get|post|put|patch|delete)\s*\(",
    r"static\s+void\s+Main\s*\(", r"\bint\s+main\s*\(",
)
#: What a path of an entry point holds -> its kind, in order (fixed values).
ENTRY_KINDS = (
    ("admin-route", ("admin",)), ("checkout-route", ("order", "checkout")), ("api-route", ("api",)), ("route", ("routes", "router")), ("server-entry", ("server", "app")), ("main-entry", ("index", "main")),
)
#: Extension -> test framework (fixed values).
FRAMEWORKS = {
    "py": "pytest", "rb": "minitest", "go": "go test", "rs": "cargo test", "java": "junit", "php": "phpunit", "cs": "xunit", "cpp": "gtest", "cc": "gtest", "cxx": "gtest", "js": "node:test", "ts": "vitest", "tsx": "vitest",
}
#: Words of path segments -> domain, in order; then category -> domain (fixed values).
DOMAIN_WORDS = (
    ("auth", "auth|login|session|permission|rbac|admin"), ("commerce", "cart|checkout|payment|price|pricing|order|billing"), ("input-boundary", "schema|validator|validation|input|form"),
    ("data-access", "db|database|repo|repository|model|migration|sql"), ("runtime-config", "config|env|secret|token|credential"), ("test-assurance", "__tests__|tests?|spec|fixtures?"),
    ("api-boundary", "api|route|controller|handler|endpoint"),
)
DOMAINS = {
    "auth": "auth", "payment": "commerce", "validation": "input-boundary", "data": "data-access", "config": "runtime-config", "maintainability": "code-health", "testing": "test-assurance",
    "compatibility": "compatibility", "release-risk": "release-gate", "security": "security-boundary",
}
#: Words of path segments -> what a reviewer should know (fixed values).
REVIEW_WORDS = {"test-path": "__tests__|tests?|spec", "fixture-path": "fixtures?|mocks?|examples?", "generated-path": "dist|build|generated|coverage"}


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return F.coalesce(out, F.lit(False))


def _fits(path: Column, begins: tuple, holds: tuple, ends: tuple) -> Column:
    return _any([*(path.startswith(x) for x in begins), *(F.contains(path, F.lit(x)) for x in holds), *(path.endswith(x) for x in ends)])


def role_of(path: Column | str) -> Column:
    """Role by path: test, fixture, docs, config (also JSON about configuration or settings), generated, else source."""
    path = posix(path)
    out = F.lit("source")
    for role, (begins, holds, ends) in reversed(ROLES.items()):
        test = _fits(path, begins, holds, ends)
        if role == "config":
            test = test | (path.endswith(".json") & (F.contains(path, F.lit("config")) | F.contains(path, F.lit("settings"))))
        out = F.when(test, role).otherwise(out)
    return out


def is_generated_path(path: Column | str) -> Column:
    """Whether a path is one of generated, vendored or minified files."""
    return _fits(posix(path), *ROLES["generated"])


def is_graph_file(path: Column | str, extensions: Iterable[str]) -> Column:
    """Whether a file belongs into the graph: of a known language, and not generated."""
    return extension(path).isin(*extensions) & ~is_generated_path(path)


def is_entrypoint(path: Column | str, content: Column | str | None = None) -> Column:
    """Whether a file is an entry point, by its path or, if given, by its code."""
    path = posix(path)
    tests = [path.startswith(f"{x}/") | F.contains(path, F.lit(f"/{x}/")) for x in ENTRY_FOLDERS]
    for stem, ends in ENTRY_FILES.items():
        tests += [path.isin(*[f"{stem}.{e}" for e in ends]), *(path.startswith(f"src/{stem}.{e}") for e in ends)]
    for stem, ends in ENTRY_ANYWHERE.items():
        tests += [F.contains(path, F.lit(f"/{stem}.{e}")) for e in ends]
    out = _any(tests)
    if content is not None:
        code = F.col(content) if isinstance(content, str) else content
        out = out | F.coalesce(code.rlike("|".join(f"(?:{p})" for p in ENTRY_CODE)), F.lit(False))
    return out


def entrypoint_kind(path: Column | str) -> Column:
    """The kind of an entry point by its path."""
    path = posix(path)
    out = F.lit("entrypoint")
    for kind, words in reversed(ENTRY_KINDS):
        out = F.when(_fits(path, (), words, ()), kind).otherwise(out)
    return out


def test_framework(path: Column | str) -> Column:
    """The test framework of a file by its extension; Ruby files about ``spec`` have another than the others."""
    table = F.create_map(*[F.lit(x) for pair in FRAMEWORKS.items() for x in pair])
    path = F.col(path) if isinstance(path, str) else path
    return F.when((extension(path) == "rb") & F.contains(path, F.lit("spec")), "rspec").otherwise(F.coalesce(table[extension(path)], F.lit("unknown")))


def _segment(words: str) -> str:
    return rf"(^|/)({words})(/|\.|-|_)"


def domain_of(path: Column, category: Column) -> Column:
    """The domain of a finding by words of its path, else by its category."""
    table = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    out = table[category]
    for domain, words in reversed(DOMAIN_WORDS):
        out = F.when(path.rlike("(?i)" + _segment(words)), domain).otherwise(out)
    return out


def review_tags(confidence: Column, paths: Column) -> Column:
    """Tags for a review of false positives: low confidence, no evidence, and kinds of paths; ``fp-review`` with any of them."""
    paths = F.transform(F.coalesce(paths, F.array().cast("array<string>")), F.lower)
    tags = [F.when(confidence < 0.7, "fp-review:low-confidence"), F.when(F.size(paths) == 0, "fp-review:missing-evidence")]
    holds = lambda words: F.exists(paths, lambda p: p.rlike(_segment(words)))
    tags += [F.when(holds(words), f"fp-review:{name}") for name, words in REVIEW_WORDS.items()]
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("fp-review")))).otherwise(found)


def without_extension(path: Column | str) -> Column:
    """A path without its extension."""
    return F.regexp_replace(path, r"\.[^.]+$", "")


def source_key(path: Column | str) -> Column:
    """The name by which tests of a file are found: its own, or that of its folder for an index file."""
    plain = without_extension(path)
    return F.when(basename(plain) == "index", basename(dirname(plain))).otherwise(basename(plain))


def test_level(path: Column | str) -> Column:
    """The level of a test by its path."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.rlike("e2e|playwright|cypress"), "e2e").when(path.rlike("integration|integ"), "integration").when(path.rlike("smoke"), "smoke").otherwise("unit")


def test_command(path: Column | str) -> Column:
    """The command that runs a test file."""
    path = F.col(path) if isinstance(path, str) else path
    return (
        F.when(path.endswith(".py"), F.concat(F.lit("pytest "), path)).when(path.endswith(".go"), "go test ./...").when(path.endswith(".rb"), F.concat(F.lit("bundle exec ruby "), path))
        .otherwise(F.concat(F.lit("npm test -- "), path))
    )


def likelihood(severity: Column) -> Column:
    """How likely a risk of a severity is."""
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise("unknown")


def date_only(text: Column, now: Column) -> Column:
    """The date at the begin of a text, else 30 days after ``now``."""
    found = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(F.date_format(F.date_add(now, 30), "yyyy-MM-dd"))


def markdown_cell(text: Column | str) -> Column:
    """A text as a cell of a markdown table."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r\n?|\n", " ")


def excerpt_hash(content: Column, start: Column, end: Column) -> Column:
    """The hash of the lines of a text from ``start`` to ``end``; null if they aren't all there."""
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    fits = (start >= 1) & (end >= start) & (end <= F.size(lines))
    low = F.when(fits, start).otherwise(1)
    return F.when(fits, F.sha2(F.array_join(F.slice(lines, low, F.when(fits, end - start + 1).otherwise(0)), "\n"), 256))
