"""Database files: recognition, migrations with their operations, schema objects, and differences between two states."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.sql_inventory import operations, plain_name, tokens

#: Paths of database files (fixed values: conventions of frameworks).
_MIGRATION_CODE = r"(^|/)(src/migrations|migrations|db/migrate)/.*\.(ts|js|py|rb)$"
#: Frameworks by path, the first that fits (fixed values).
ORM_PATHS = (
    (r"migrations/\d{10,}-.*\.ts$|typeorm", "typeorm"), (r"db/migrate/\d{14}_.*\.rb$", "rails"), (r"[VU]\d{8}__.*\.sql$|flyway", "flyway"), (r"migrations/\d{14}_.*\.js$", "knex"),
    (r"migrations/\d{4}_.*\.py$", "django"), (r"sequelize|/migrations/.*\.js$", "sequelize"), (r"prisma", "prisma"),
)
#: Frameworks by code, the first with a hit (fixed values).
ORM_CODE = (
    ("typeorm", r"@(Entity|Column|Table|JoinColumn|Index)\s*\(|(createQueryBuilder|getRepository)\s*\("),
    ("prisma", r"model\s+\w+\s*\{|db\.\$\w+\s*\(|prisma\.\w+\s*\(|PrismaClient"),
    ("sequelize", r"sequelize\.define\s*\(|\.sync\s*\(|DataTypes\.\w+"),
    ("knex", r"knex\s*\(['\"]\w+['\"]\)|\.(table|schema|raw)\s*\("),
    ("rails", r"ActiveRecord::Base|(create_table|add_column|remove_column|change_table)\s*\("),
    ("flyway", r"Flyway|V\d{8}__|migrate\s*\("),
    ("django", r"class\s+\w+\s*\(.*Model\)|models\.(Model|CharField|IntegerField)|makemigrations|migrate"),
)
#: Words of a text that tell its dialect, looked at in this order (fixed values).
DIALECT_WORDS = (
    ("postgresql", ("SERIAL", "RETURNING", "JSONB", "::", "ILIKE", "NOW()", "CURRENT_TIMESTAMP", "UUID")),
    ("mysql", ("AUTO_INCREMENT", "ENGINE=", "INT(11)", "VARCHAR(255)", "DATETIME", "UNSIGNED", "TINYINT")),
    ("sqlite", ("AUTOINCREMENT", "INTEGER PRIMARY KEY")),
)
#: Words of path segments that tell the dialect (fixed values).
DIALECT_PATHS = (("postgresql", r"(?i)(^|[/._-])(postgres(ql)?|pg|psql)([/._-]|$)"), ("mysql", r"(?i)(^|[/._-])(mysql|mariadb)([/._-]|$)"), ("sqlite", r"(?i)(^|[/._-])sqlite3?([/._-]|$)"))
#: SQL types by their plain name (fixed values).
TYPES = {
    "integer": ("int", "integer", "serial"), "bigint": ("bigint", "bigserial"), "smallint": ("smallint", "tinyint", "smallserial"), "decimal": ("decimal", "money"), "numeric": ("numeric",),
    "float": ("real", "float"), "double": ("double", "double precision"), "boolean": ("boolean", "bool"), "char": ("char", "character"), "varchar": ("varchar", "character varying", "string"), "text": ("text",),
    "date": ("date",), "datetime": ("datetime",), "timestamp": ("timestamp", "timestamptz"), "time": ("time", "timetz"), "json": ("json",), "jsonb": ("jsonb",), "blob": ("blob", "bytea", "binary", "varbinary"),
    "clob": ("clob",), "uuid": ("uuid",), "array": ("array",),
}
#: Changes of types that lose something (fixed values).
RISKY = (
    ("bigint", "integer"), ("decimal", "integer"), ("numeric", "integer"), ("float", "integer"), ("double", "float"), ("varchar", "char"), ("text", "varchar"), ("timestamp", "date"), ("datetime", "date"),
    ("jsonb", "json"), ("uuid", "varchar"),
)
#: What undoes an operation; others undo themselves (fixed values).
INVERSE = {"create_table": "drop_table", "add_column": "drop_column", "add_constraint": "drop_constraint", "add_index": "drop_index"}
INVERSE |= {b: a for a, b in INVERSE.items()}


def _ordered(tests: list[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for test, value in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
    return out


def is_database_file(path: Column | str) -> Column:
    """SQL files, and code in folders of migrations."""
    path = F.col(path) if isinstance(path, str) else path
    return F.coalesce(path.endswith(".sql") | path.rlike(_MIGRATION_CODE), F.lit(False))


def orm_of_path(path: Column | str) -> Column:
    """The framework that a path suggests, else ``unknown``."""
    path = F.col(path) if isinstance(path, str) else path
    return _ordered([(path.rlike(p), name) for p, name in ORM_PATHS], "unknown")


def orm_of_code(content: Column | str) -> Column:
    """The framework that code suggests, else ``none``."""
    content = F.col(content) if isinstance(content, str) else content
    return _ordered([(content.rlike(p), name) for name, p in ORM_CODE], "none")


def dialect_of(path: Column, content: Column) -> Column:
    """The dialect by a segment of the path, else by words of the text, else ``unknown``."""
    upper = F.upper(content)
    tests = [(path.rlike(p), name) for name, p in DIALECT_PATHS]
    for name, words in DIALECT_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(upper, F.lit(w))
        tests.append((hit, name))
    return _ordered(tests, "unknown")


def without_comments(sql: Column | str) -> Column:
    """A script with blanks in place of its comments."""
    return F.regexp_replace(sql, r"--[^\n]*|/\*[\s\S]*?\*/|(?m)^\s*//[^\n]*", " ")


def transaction(content: Column | str) -> Column:
    """Struct of ``has_begin, has_commit, has_rollback, pattern``; comments don't count."""
    text = F.upper(without_comments(content))
    begin, commit, back = (text.rlike(rf"\b{w}\b") for w in ("BEGIN", "COMMIT", "ROLLBACK"))
    pattern = F.when(begin & commit, "begin-commit").when(text.rlike(r"TRANSACTION\(\)|\.TRANSACTION\s*\(|(DB|KNEX|CONNECTION)\.TRANSACTION"), "transaction-call").otherwise("none")
    return F.struct(begin.alias("has_begin"), commit.alias("has_commit"), back.alias("has_rollback"), pattern.alias("pattern"))


def redact_secrets(content: Column | str) -> Column:
    """A script with values of secrets, passwords in addresses and private keys replaced."""
    text = F.regexp_replace(content, r"(?i)((?:password|passwd|pwd|secret|api[_-]?key|token)\s*=\s*)(['\"])[^'\"]*\2", "$1$2[REDACTED]$2")
    text = F.regexp_replace(text, r"(?i)([a-z][a-z0-9+.-]*://[^:\s/@]+:)[^@\s/]+@", "$1[REDACTED]@")
    return F.regexp_replace(text, r"-----BEGIN (?:RSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA )?PRIVATE KEY-----", "[REDACTED PRIVATE KEY]")


def normal_type(sql_type: Column | str) -> Column:
    """The plain type behind a SQL type, whatever its size; ``enum`` for enums, else ``unknown``."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sql_type), r"\s*\([^)]*\)", ""), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for kind, names in TYPES.items() for name in names for x in (name, kind)])
    return F.coalesce(names[base], F.when(base.startswith("enum"), "enum").otherwise("unknown"))


def risky_change(old: Column, new: Column) -> Column:
    """Whether a change of plain types loses something; an unknown old type is always a risk."""
    pairs = [f"{a}>{b}" for a, b in RISKY]
    return (F.coalesce(old, F.lit("unknown")) == "unknown") | F.concat(old, F.lit(">"), new).isin(pairs)


_CALL_SQL = r"""\.raw\s*\(\s*['"`]([^'"`]+)['"`]\s*\)"""
_TEMPLATE_SQL = r"(?i)`([^`]*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)[^`]*)`"
_STRING_SQL = r"""(?i)['"]([^'"]*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)[^'"]*)['"]"""


def sql_of_code(content: Column | str) -> Column:
    """The SQL texts in code: of raw calls, then of templates, then of strings; all hits, in order."""
    return F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in (_CALL_SQL, _TEMPLATE_SQL, _STRING_SQL)])


def line_of(content: Column, at: Column) -> Column:
    """The line of a place (from 1) in a text; place 0 (nothing found) is line 1."""
    return F.length(F.regexp_replace(F.substring(content, F.lit(1), F.greatest(at - 1, F.lit(0))), r"[^\n]", "")) + 1


def raw_sql_refs(files: DataFrame) -> DataFrame:
    """``path, ord, start_line, end_line, sql, is_dynamic, context`` of the SQL texts in code (``path, content``)."""
    rows = files.where("content is not null").select("path", "content", F.posexplode(sql_of_code("content")).alias("ord", "sql"))
    at = F.instr("content", F.col("sql"))
    start = line_of(F.col("content"), at)
    lines = F.length(F.regexp_replace("sql", r"[^\n]", ""))
    dynamic = F.contains(F.col("sql"), F.lit("${")) | F.contains(F.col("sql"), F.lit("?"))
    context = F.when(F.contains(F.col("path"), F.lit("migration")), "migration").otherwise("query")
    return rows.select("path", "ord", start.alias("start_line"), (start + lines).alias("end_line"), "sql", dynamic.alias("is_dynamic"), context.alias("context"))


def _rows(make: Callable[[str], list[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in make(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.string(), *kinds])], ["path", *names])

    return run


def diagnose(sql: str) -> list[tuple[str, int]]:
    """Code and line of what is wrong with a script: unterminated strings and comments, parentheses, definitions that end early, objects declared twice."""
    found = []
    depth, opened = 0, []
    for kind, text, line in tokens(sql, keep_all=True):
        if kind == "string" and (len(text) < 2 or text[-1] != "'"):
            found.append(("UNTERMINATED_STRING", line))
        elif kind == "comment" and text.startswith("/*") and not text.endswith("*/"):
            found.append(("UNTERMINATED_COMMENT", line))
        elif kind == "unknown":
            found.append(("UNKNOWN_CHARACTER", line))
        elif text == "(":
            depth += 1
            opened.append(line)
        elif text == ")":
            depth -= 1
            if depth < 0:
                found.append(("UNBALANCED_PARENTHESES", line))
                depth = 0
            else:
                opened.pop()
    found.extend(("UNBALANCED_PARENTHESES", line) for line in opened)
    seen: set[tuple[str, str]] = set()
    for op in schema(sql):
        if op[0] in ("table", "index"):
            if (op[0], op[1]) in seen:
                found.append(("DUPLICATE_OBJECT_DECLARATION", op[5]))
            seen.add((op[0], op[1]))
    for words in statements(sql):
        upper = [t.upper() for _, t, _ in words]
        if upper[:1] in (["CREATE"], ["DROP"], ["ALTER"]) and len(upper) < 3:
            found.append(("INCOMPLETE_DDL", words[0][2]))
    return found


def diagnostics(scripts: DataFrame) -> DataFrame:
    """``path, code, line`` of the diagnostics of scripts (``path, content``), each once."""
    run = _rows(diagnose, ["code", "line"], [pa.string(), pa.int32()])
    return scripts.select("path", "content").mapInArrow(run, "path string, code string, line int").distinct()


def statements(sql: str) -> list[list[tuple[str, str, int]]]:
    """The tokens of each statement."""
    out: list[list[tuple[str, str, int]]] = [[]]
    for token in tokens(sql, keep_all=True):
        if token[0] in ("ws", "comment", "unknown"):
            continue
        if token[1] == ";":
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


_CONSTRAINTS = (("PRIMARY", "primary_key"), ("FOREIGN", "foreign_key"), ("UNIQUE", "unique"), ("CHECK", "check"))


def _constraint_kind(upper: list[str]) -> str | None:
    return next((kind for word, kind in _CONSTRAINTS if word in upper), None)


def schema(sql: str) -> list[tuple[str, str, str | None, str | None, bool | None, int]]:
    """Kind (table, column, index, constraint), name, table, type, nullable and line of the objects that a script defines."""
    out: list[tuple] = []
    for words in statements(sql):
        upper = [t.upper() for _, t, _ in words]
        line = words[0][2]
        if upper[0] == "CREATE" and "TABLE" in upper[1:3]:
            at = upper.index("TABLE") + 1
            at += 3 if upper[at : at + 3] == ["IF", "NOT", "EXISTS"] else 0
            if at >= len(words) or words[at][0] != "name":
                continue
            table = plain_name(words[at][1])
            out.append(("table", table, None, None, None, line))
            for part in _parts(words[at + 1 :]):
                own = [t.upper() for _, t, _ in part]
                if own[0] in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "KEY"):
                    name = plain_name(part[1][1]) if own[0] == "CONSTRAINT" and len(part) > 1 else ""
                    out.append(("constraint", name, table, _constraint_kind(own) or "unknown", None, part[0][2]))
                    continue
                kind = []
                for k, t, _ in part[1:]:
                    if k != "name" and t not in "()," and k != "number" or t.upper() in ("NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "CONSTRAINT"):
                        break
                    kind.append(t)
                text = re.sub(r"\s*\(\s*.*", "", " ".join(kind)).lower()
                primary = "PRIMARY" in own
                nullable = not primary and not any(a == "NOT" and b == "NULL" for a, b in zip(own, own[1:], strict=False))
                out.append(("column", plain_name(part[0][1]), table, text, nullable, part[0][2]))
                if kind_of := _constraint_kind(own[1:]) or ("foreign_key" if "REFERENCES" in own else None):
                    out.append(("constraint", "", table, kind_of, None, part[0][2]))
        elif upper[0] == "CREATE" and "INDEX" in upper[1:3] and "ON" in upper:
            at = upper.index("INDEX") + 1
            at += 3 if upper[at : at + 3] == ["IF", "NOT", "EXISTS"] else 0
            on = upper.index("ON")
            if on + 1 < len(words):
                out.append(("index", plain_name(words[at][1]), plain_name(words[on + 1][1]), "unique" if "UNIQUE" in upper[:3] else "plain", None, line))
        elif upper[:2] == ["ALTER", "TABLE"] and "CONSTRAINT" in upper and "ADD" in upper:
            at = upper.index("CONSTRAINT") + 1
            if at < len(words) and len(words) > 2:
                out.append(("constraint", plain_name(words[at][1]), plain_name(words[2][1]), _constraint_kind(upper[at:]) or "unknown", None, line))
    return out


def _parts(words: list[tuple[str, str, int]]) -> Iterator[list[tuple[str, str, int]]]:
    """The parts of the first parenthesis, split at its own commas."""
    depth, part = 0, []
    for word in words:
        text = word[1]
        if text == "(":
            depth += 1
            if depth == 1:
                continue
        if text == ")":
            depth -= 1
            if depth == 0:
                break
        if depth == 1 and text == ",":
            if part:
                yield part
            part = []
        elif depth:
            part.append(word)
    if part:
        yield part


_SCHEMA = "path string, kind string, name string, table_name string, type string, nullable boolean, line int"


def schema_inventory(scripts: DataFrame) -> DataFrame:
    """``path, kind, name, table_name, type, nullable, line``: the four outputs of an inventory (tables, columns, indexes, constraints) as tagged rows."""
    run = _rows(schema, ["kind", "name", "table_name", "type", "nullable", "line"], [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()])
    return scripts.select("path", "content").mapInArrow(run, _SCHEMA)


_OPERATIONS = "array<struct<type:string,table_name:string,object_name:string,new_type:string,not_null:boolean,has_default:boolean>>"


def migrations(scripts: DataFrame) -> DataFrame:
    """A row per script and direction: ``path, direction, name, has_transaction, transaction_pattern, has_rollback, operations``.

    Plain scripts (``.sql``) are read as a whole, code by the SQL texts in it. Code with a ``down`` method has a second row, whose
    operations are those of the first undone; a script without operations and without an ``up`` method has none.
    """
    code = scripts.where("content is not null").select(
        "path", "content", F.when(F.col("path").endswith(".sql") & (orm_of_code("content") == "none"), F.col("content")).otherwise(F.array_join(F.array_distinct(sql_of_code("content")), ";\n")).alias("sql"),
        transaction("content").alias("tx"), F.col("content").rlike(r"\bup\s*\([^)]*\)[^{]*\{").alias("has_up"), F.col("content").rlike(r"\bdown\s*\([^)]*\)[^{]*\{").alias("has_down"),
        F.regexp_extract("content", r"class\s+(\w+)", 1).alias("name"),
    )
    kind = pa.list_(pa.struct([("type", pa.string()), ("table_name", pa.string()), ("object_name", pa.string()), ("new_type", pa.string()), ("not_null", pa.bool_()), ("has_default", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type", "table_name", "object_name", "new_type", "not_null", "has_default"]
        for batch in batches:
            found = [[dict(zip(names, op, strict=True)) for op in operations(x or "")] for x in batch.column("sql").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "operations"])

    parsed = code.drop("content").mapInArrow(run, code.drop("content").withColumn("operations", F.lit(None).cast(_OPERATIONS)).schema)
    inverse = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    undone = F.transform("operations", lambda o: o.withField("type", F.coalesce(inverse[o["type"]], o["type"])))
    common = ["path", F.coalesce(F.nullif("name", F.lit("")), F.lit("migration_1")).alias("name"), (F.col("tx.pattern") != "none").alias("has_transaction"),
              F.when(F.col("tx.pattern") == "none", "unknown").otherwise(F.col("tx.pattern")).alias("transaction_pattern"), F.col("has_down").alias("has_rollback")]
    up = parsed.where("has_up or size(operations) > 0").select(*common, F.lit("up").alias("direction"), (F.col("tx.has_begin") | F.col("tx.has_commit")).alias("transaction_signal"), "operations")
    down = parsed.where("has_down").select(*common, F.lit("down").alias("direction"), (F.col("tx.has_begin") | F.col("tx.has_rollback")).alias("transaction_signal"), undone.alias("operations"))
    return up.unionByName(down)


def signature(operation: Column) -> Column:
    """Type, table, object and new type of an operation as one text."""
    return F.concat_ws("|", operation["type"], F.coalesce(operation["table_name"], F.lit("")), F.coalesce(operation["object_name"], F.lit("")), F.lower(F.coalesce(operation["new_type"], F.lit(""))))


def diff_assets(base: DataFrame, head: DataFrame) -> DataFrame:
    """``path, change, detail`` between the migrations of two states, by path (``up`` rows).

    ``added``, ``removed`` and ``modified`` migrations; ``new_operation`` and ``removed_operation`` with their signature; ``rollback_removed``
    and ``transaction_removed`` for migrations in both.
    """
    side = lambda d, tag: d.where("direction = 'up'").select("path", F.transform("operations", signature).alias(f"{tag}_ops"), F.col("has_rollback").alias(f"{tag}_back"), F.col("transaction_signal").alias(f"{tag}_tx"))
    both = side(base, "a").join(side(head, "b"), "path", "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a_ops", none), F.coalesce("b_ops", none)
    new, gone = F.array_except(b, a), F.array_except(a, b)
    there = F.col("a_ops").isNotNull() & F.col("b_ops").isNotNull()
    differs = (F.size(new) + F.size(gone) > 0) | (F.col("a_back") != F.col("b_back")) | (F.col("a_tx") != F.col("b_tx"))
    entry = lambda change, detail: F.struct(F.lit(change).alias("change"), detail.alias("detail"))
    empty = F.lit("")
    single = F.array_compact(F.array(
        F.when(F.col("a_ops").isNull(), entry("added", empty)), F.when(F.col("b_ops").isNull(), entry("removed", empty)), F.when(there & differs, entry("modified", empty)),
        F.when(there & F.col("a_back") & ~F.col("b_back"), entry("rollback_removed", empty)), F.when(there & F.col("a_tx") & ~F.col("b_tx"), entry("transaction_removed", empty)),
    ))
    listed = F.concat(single, F.transform(new, lambda x: entry("new_operation", x)), F.transform(gone, lambda x: entry("removed_operation", x)))
    return both.select("path", F.explode(listed).alias("e")).select("path", "e.change", "e.detail")


def migration_findings(found: DataFrame) -> DataFrame:
    """``path, rule, detail``: destructive operations, risky changes of types, dropped constraints and indexes, migrations without transaction or way back."""
    op = F.col("o")
    rules = F.array_compact(F.array(
        F.when(op["type"] == "drop_table", "drop_table"), F.when(op["type"] == "drop_column", "drop_column"),
        F.when((op["type"] == "add_column") & op["not_null"] & ~op["has_default"], "not_null_without_default"),
        F.when((op["type"] == "modify_column") & op["new_type"].isNotNull() & risky_change(F.lit("unknown"), op["new_type"]), "risky_type_change"),
        F.when(op["type"] == "drop_constraint", "drop_constraint"), F.when(op["type"] == "drop_index", "drop_index"),
    ))
    up = found.where("direction = 'up'")
    per = up.select("path", F.explode("operations").alias("o")).select("path", F.explode(rules).alias("rule"), signature(op).alias("detail"))
    flags = F.array_compact(F.array(F.when(~F.col("transaction_signal") & ~F.col("has_transaction"), "no_transaction"), F.when(~F.col("has_rollback"), "no_rollback")))
    return per.unionByName(up.select("path", F.explode(flags).alias("rule"), F.lit("").alias("detail"))).distinct()
