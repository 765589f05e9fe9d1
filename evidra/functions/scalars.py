"""Scalar expressions: ranks, paths, identifiers, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered severities (fixed values).
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(col: Column | str) -> Column:
    """0 for info up to 4 for critical; null for anything else."""
    col = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(col == name, i).otherwise(out)
    return out


def extension(path: Column | str) -> Column:
    """The extension of a path without its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column | str) -> Column:
    """The last segment of a path."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column | str) -> Column:
    """The path without its last segment; ``.`` at the top."""
    head = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(head == "", ".").otherwise(head)


def posix(path: Column | str) -> Column:
    """A path with slashes only."""
    return F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))


def normal_path(path: Column | str) -> Column:
    """A path with slashes, without empty and ``.`` segments; ``..`` takes the segment before it back (at the top, nothing)."""
    plain = F.filter(F.split(posix(path), "/"), lambda x: ~x.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    folded = F.aggregate(plain, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(folded, "/")


def package_of(path: Column | str) -> Column:
    """``packages/x`` for paths below it, else ``.``."""
    found = F.regexp_extract(path, r"^(packages/[^/]+)/", 1)
    return F.when(found == "", ".").otherwise(found)


def primary_path(evidence: str = "evidence") -> Column:
    """Path of the first evidence, or empty."""
    return F.coalesce(F.try_element_at(evidence, F.lit(1))["path"], F.lit(""))


def fingerprint(rule: Column, symbols: Column, excerpt: Column, path: Column) -> Column:
    """16 hex digits over rule, sorted symbols and excerpt hash, or the path if there is neither."""
    has_symbols = F.coalesce(F.size(symbols), F.lit(0)) > 0
    parts = F.concat_ws(
        "|",
        F.concat(F.lit("rule:"), rule),
        F.when(has_symbols, F.concat(F.lit("symbols:"), F.array_join(F.array_sort(symbols), ","))),
        F.when(excerpt.isNotNull(), F.concat(F.lit("excerpt:"), excerpt)),
        F.when(~has_symbols & excerpt.isNull(), F.concat(F.lit("path:"), path)),
    )
    return F.substring(F.sha2(parts, 256), 1, 16)


def title_key(title: Column | str) -> Column:
    """A title in lower case with only letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+", " "))


def rule_key(rule: Column | str) -> Column:
    """A rule id in upper case with other characters as ``_``; ``UNKNOWN`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.upper(rule), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("UNKNOWN"))


def _brace_choices(glob: str) -> list[str]:
    """The globs that a glob with ``{a,b}`` stands for."""
    depth, low, commas = 0, -1, []
    for at, char in enumerate(glob):
        if char == "{":
            low, commas = (at, [at]) if depth == 0 else (low, commas)
            depth += 1
        elif char == "," and depth == 1:
            commas.append(at)
        elif char == "}" and depth:
            depth -= 1
            if depth == 0 and len(commas) > 1:
                edges = [*commas, at]
                middles = [glob[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]
                return [x for m in middles for x in _brace_choices(glob[:low] + m + glob[at + 1 :])]
    return [glob]


_SEGMENT_PART = re.compile(r"\*+|\?|\[[!^]?\]?[^\]/]*\]|[^*?\[]+|\[")


def _segment_regex(segment: str) -> str:
    """One segment of a glob. A wildcard at its begin doesn't stand for a dot; ``*`` alone stands for at least one character."""
    if segment.strip("*") == "" and segment:
        return r"(?!\.)[^/]+"
    out = []
    for part in _SEGMENT_PART.findall(segment):
        if part[0] == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part[0] == "[" and len(part) > 2:
            body = part[1:-1]
            negated = body[0] in "!^"
            out.append(("[^/" if negated else "[") + re.sub(r"([\[\]\\&~^])", r"\\\1", body[negated:]) + "]")
        else:
            out.append(re.escape(part))
    return (r"(?!\.)" if segment[:1] in ("*", "?", "[") else "") + "".join(out)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression.

    ``**`` as a whole segment stands for any folders (at the end, for at least one segment), ``*`` and ``?`` stay in a segment,
    ``[a-z]``, ``[!a]`` and ``{a,b}`` are choices; wildcards don't stand for names that begin with a dot.
    """
    choices = []
    for choice in _brace_choices(glob):
        segments = choice.split("/")
        out = ""
        for at, segment in enumerate(segments):
            last = at == len(segments) - 1
            if segment == "**":
                out += r"(?!\.)[^/]+(?:/(?!\.)[^/]+)*" if last else r"(?:(?!\.)[^/]+/)*"
            else:
                out += _segment_regex(segment) + ("" if last else "/")
        choices.append(out)
    return "^(?:" + "|".join(choices) + ")$"


def _owner_glob(glob: str) -> str:
    """An ownership glob: ``**`` is anything, ``*`` and ``?`` stay in a segment, all else is plain."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)


def owner_regex(pattern: str) -> str:
    """An ownership pattern: ``/x`` is anchored at the top, ``x/`` is a folder by its plain name; others match at any depth."""
    anchored, folder = pattern.startswith("/"), pattern.endswith("/")
    body = pattern.removeprefix("/").removesuffix("/")
    if not body:
        return "(?!)"
    if folder:
        return f"^{re.escape(body)}(?:/|$)" if anchored else f"(?:^|/){re.escape(body)}/"
    return ("^" if anchored and "/" in body else "(?:^|/)" if "/" in body else r"(?:^|/)(?=[^/]*$)") + _owner_glob(body) + "$"


#: Extension -> language (fixed values).
LANGUAGE_OF = {
    "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "py": "py", "rb": "rb", "go": "go", "rs": "rs", "java": "java", "php": "php", "cs": "cs",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}


def language_of(path: Column | str) -> Column:
    """Language by extension, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def canonical_json(document: Column | str) -> Column:
    """A JSON text with its members in the order of their names and without blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(document))


def canonical_digest(document: Column | str) -> Column:
    """The SHA-256 of the canonical text."""
    return F.sha2(canonical_json(document), 256)


#: Lines of reports that differ from run to run (fixed values).
VOLATILE = r"^(#\s*(Generated|Run ID):|\*\*(Generated|Run ID)\*\*:|(generated_at|run_id):\s*)"


def stable_text(content: Column | str) -> Column:
    """A report without the lines that differ from run to run."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(VOLATILE)), "\n")


def combined_hash(hashes: Column) -> Column:
    """One hash over the hashes of a group of files that fits a row, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), "|"), 256)
