"""Queries for database files. The tables hold no SQL scripts, so scripts are written from the rows of ``part``, one a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import database, sql_inventory
from evidra.plans.registry import FILES_SQL, Registry, rows_of
from evidra.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _text(template: str, **parts: Column) -> Column:
    """A template with columns in place of ``{name}``."""
    pieces = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        pieces.append(parts[piece] if i % 2 else F.lit(piece))
    return F.concat(*pieces)


#: What the script of a part holds beside its table and index, by variant.
_CHANGES = {1: "ALTER TABLE t{k} DROP COLUMN old{k};\n", 2: "DROP TABLE IF EXISTS u{k};\n", 3: "ALTER TABLE t{k} ALTER COLUMN name TYPE text;\n", 4: "ALTER TABLE t{k} ADD COLUMN n int NOT NULL;\n", 5: "DROP INDEX ix{k};\n"}
_HEAD = "-- BEGIN and COMMIT are missing here\n{begin}CREATE TABLE IF NOT EXISTS t{k} (id bigint NOT NULL PRIMARY KEY, name varchar(20), price decimal(10,2) NOT NULL DEFAULT 0);\nCREATE UNIQUE INDEX ix{k} ON t{k} (name);\n{change}{commit}"


def _scripts(spark, folder: str, shift: Column | int = 0, ending: Column | None = None) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    variant = (F.col("p_size") + shift) % 6
    change = F.lit("")
    for v, text in _CHANGES.items():
        change = F.when(variant == v, _text(text, k=k)).otherwise(change)
    wrapped = variant % 2 == 0
    content = _text(_HEAD, k=k, begin=F.when(wrapped, "BEGIN;\n").otherwise(""), commit=F.when(wrapped, "COMMIT;\n").otherwise(""), change=change)
    path = _text("db/{d}/V20240101__p{k}.sql", d=F.when(F.col("p_partkey") % 3 == 0, "mysql").when(F.col("p_partkey") % 3 == 1, "pg").otherwise("upgrade"), k=k)
    return table(spark, folder, "part").select("p_partkey", "p_size", path.alias("path"), (content if ending is None else F.concat(content, ending)).alias("content"))


#: The same scripts' facts for SQL.
_P = "with p as (select p_partkey as k, p_size % 6 as v, 'db/' || case p_partkey % 3 when 0 then 'mysql' when 1 then 'pg' else 'upgrade' end || '/V20240101__p' || p_partkey || '.sql' as path, p_size from part), "
_CODE = "export class M{k} implements MigrationInterface {\n  async up(q) {\n    await q.query(`CREATE TABLE c{k} (id int)`);\n  }\n  async down(q) {\n    await q.query(\"DROP TABLE c{k} -- ?\");\n  }\n}\n"


def _code(spark, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    content = F.replace(F.lit(_CODE), F.lit("{k}"), k)
    return table(spark, folder, "part").select("p_partkey", _text("src/migrations/1715700{k}000-c.ts", k=F.lpad(k, 7, "0")).alias("path"), content.alias("content"))


@query(FILES_SQL + _P[5:] + """a as (select path from p union all select 'src/migrations/1715700' || lpad(k::varchar, 7, '0') || '000-c.ts' from p union all select path from fi where path is not null)
 select is_database, orm, count(*) as n from (select coalesce(ends_with(path, '.sql') or regexp_matches(path, '(^|/)(migrations|db/migrate)/.*\\.(ts|js|py|rb)$'), false) as is_database,
 case when regexp_matches(path, 'migrations/[0-9]{10,}-.*\\.ts$') or contains(path, 'typeorm') then 'typeorm' when regexp_matches(path, '[VU][0-9]{8}__.*\\.sql$') or contains(path, 'flyway') then 'flyway' when contains(path, 'sequelize') or (contains(path, '/migrations/') and ends_with(path, '.js')) then 'sequelize'
 when contains(path, 'prisma') then 'prisma' else 'unknown' end as orm from a) group by all""")
def database_files(spark, folder):
    """Files by whether they are database files, and the framework their path suggests."""
    paths = _scripts(spark, folder).select("path").unionByName(_code(spark, folder).select("path")).unionByName(rows_of(spark, folder, "files", "path", where="path is not null").select("path"))
    return paths.groupBy(database.is_database_file("path").alias("is_database"), database.orm_of_path("path").alias("orm")).agg(F.count("*").alias("n"))


@query(_P + "q as (select path, case k % 3 when 0 then 'mysql' when 1 then 'postgresql' else case when k % 2 = 0 then 'sqlite' else 'unknown' end end as dialect from p) select * from q")
def sql_dialects(spark, folder):
    """The dialect of each script: by a segment of its path (``upgrade`` isn't ``pg``), else by its words."""
    rows = _scripts(spark, folder, ending=F.when(F.col("p_partkey") % 2 == 0, "CREATE TABLE z (id integer primary key autoincrement);\n").otherwise(""))
    return rows.select("path", database.dialect_of(F.col("path"), F.col("content")).alias("dialect"))


_OPS = """o as (select path, k, 'create_table' as type, 't' || k as table_name, '' as object_name from p union all select path, k, 'add_index', 't' || k, 'ix' || k from p
 union all select path, k, case v when 1 then 'drop_column' when 2 then 'drop_table' when 3 then 'modify_column' when 4 then 'add_column' else 'drop_index' end, case v when 2 then 'u' || k when 5 then '' else 't' || k end, case v when 1 then 'old' || k when 2 then '' when 3 then 'name' when 4 then 'n' else 'ix' || k end from p where v > 0)"""


@query(_P + _OPS + " select path, type as operation, table_name, object_name from o")
def ddl_operations(spark, folder):
    """The schema operations of each script."""
    found = sql_inventory.inventory(_scripts(spark, folder))
    return found.select("path", "operation", F.coalesce("table_name", F.lit("")).alias("table_name"), F.coalesce("object_name", F.lit("")).alias("object_name"))


@query(_P + """o as (select path, 'table' as kind, 't' || k as name, '' as table_name, '' as type, '' as nullable, 2 + (v % 2 = 0)::int as line from p
 union all select path, 'column', c.name, 't' || k, c.type, c.nullable, 2 + (v % 2 = 0)::int from p, (values ('id', 'bigint', 'false'), ('name', 'varchar', 'true'), ('price', 'decimal', 'false')) c(name, type, nullable)
 union all select path, 'constraint', '', 't' || k, 'primary_key', '', 2 + (v % 2 = 0)::int from p union all select path, 'index', 'ix' || k, 't' || k, 'unique', '', 3 + (v % 2 = 0)::int from p) select * from o""")
def schema_objects(spark, folder):
    """Tables, columns, indexes and constraints that each script defines."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return database.schema_inventory(_scripts(spark, folder)).select("path", "kind", text("name"), text("table_name"), text("type"), text("nullable"), "line")


@query(_P + """s as (select path, 'up' as direction, 'migration_1' as name, v % 2 = 0 as has_transaction, case when v % 2 = 0 then 'begin-commit' else 'unknown' end as transaction_pattern, false as has_rollback, v % 2 = 0 as transaction_signal, case when v > 0 then 3 else 2 end as n_operations from p),
 c as (select 'src/migrations/1715700' || lpad(k::varchar, 7, '0') || '000-c.ts' as path, d as direction, 'M' || k as name, false as has_transaction, 'unknown' as transaction_pattern, true as has_rollback, false as transaction_signal, 2 as n_operations from p, (values ('up'), ('down')) x(d)) select * from s union all select * from c""")
def migration_analysis(spark, folder):
    """Scripts and migration code with their directions, transactions and numbers of operations."""
    both = _scripts(spark, folder).select("path", "content").unionByName(_code(spark, folder).select("path", "content"))
    found = database.migrations(both)
    return found.select("path", "direction", "name", "has_transaction", "transaction_pattern", "has_rollback", "transaction_signal", F.size("operations").alias("n_operations"))


@query(_P + "q as (select 'src/migrations/1715700' || lpad(k::varchar, 7, '0') || '000-c.ts' as path, d as direction, t as operation, 'c' || k as table_name from p, (values ('up', 'create_table'), ('up', 'drop_table'), ('down', 'drop_table'), ('down', 'create_table')) x(d, t)) select * from q")
def inverted_operations(spark, folder):
    """The operations of migration code, and what undoes them."""
    return database.migrations(_code(spark, folder)).select("path", "direction", F.explode("operations").alias("o")).select("path", "direction", F.col("o.type").alias("operation"), "o.table_name")


@query(_P + """f as (select path, case v when 1 then 'drop_column' when 2 then 'drop_table' when 3 then 'risky_type_change' when 4 then 'not_null_without_default' when 5 then 'drop_index' end as rule from p where v > 0
 union all select path, 'no_transaction' from p where v % 2 = 1 union all select path, 'no_rollback' from p) select path, rule from f""")
def migration_risks(spark, folder):
    """What is risky about each migration."""
    return database.migration_findings(database.migrations(_scripts(spark, folder))).select("path", "rule")


_SIG = "case {v} when 1 then 'drop_column|t' || k || '|old' || k || '|' when 2 then 'drop_table|u' || k || '||' when 3 then 'modify_column|t' || k || '|name|text' when 4 then 'add_column|t' || k || '|n|' when 5 then 'drop_index||ix' || k || '|' end"


@query(_P + f"""b as (select *, (p_size + case when k % 3 = 0 then 1 else 0 end) % 6 as w from p), x as (select path, k, v, w, k % 5 <> 0 as inb, k % 7 <> 0 as inh from b),
 every as (select k, path, inb, inh, v, w, unnest([('create_table|t' || k || '||'), ('add_index|t' || k || '|ix' || k || '|')]) as s from x where inb <> inh)
 select path, 'added' as change, '' as detail from x where inh and not inb union all select path, 'removed', '' from x where inb and not inh
 union all select path, case when inh then 'new_operation' else 'removed_operation' end, s from every
 union all select path, 'new_operation', {_SIG.format(v='w')} from x where inh and not inb and w > 0 union all select path, 'removed_operation', {_SIG.format(v='v')} from x where inb and not inh and v > 0
 union all select path, 'modified', '' from x where inb and inh and v <> w union all select path, 'new_operation', {_SIG.format(v='w')} from x where inb and inh and v <> w and w > 0 union all select path, 'removed_operation', {_SIG.format(v='v')} from x where inb and inh and v <> w and v > 0
 union all select path, 'transaction_removed', '' from x where inb and inh and v % 2 = 0 and w % 2 = 1""")
def database_diff(spark, folder):
    """What changed between two states of the scripts."""
    base = _scripts(spark, folder).where("p_partkey % 5 != 0")
    head = _scripts(spark, folder, F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).where("p_partkey % 7 != 0")
    return database.diff_assets(database.migrations(base), database.migrations(head))


@query(_P + """q as (select 'src/migrations/1715700' || lpad(k::varchar, 7, '0') || '000-c.ts' as path, n as ord, l as start_line, l as end_line, case n when 0 then 'CREATE TABLE c' || k || ' (id int)' else 'DROP TABLE c' || k || ' -- ?' end as sql, n = 1 as is_dynamic, 'migration' as context from p, (values (0, 3), (1, 6)) x(n, l)) select * from q""")
def raw_sql_refs(spark, folder):
    """SQL texts in code with their lines, and whether they are put together at run time."""
    return database.raw_sql_refs(_code(spark, folder))


@query(_P + """q as (select path, 'UNTERMINATED_STRING' as code, 4 + (v % 2 = 0)::int * 2 + (v > 0)::int as line from p where k % 10 = 0 union all select path, 'UNBALANCED_PARENTHESES', 4 + (v % 2 = 0)::int * 2 + (v > 0)::int from p where k % 10 = 1
 union all select path, 'DUPLICATE_OBJECT_DECLARATION', 4 + (v % 2 = 0)::int * 2 + (v > 0)::int from p where k % 10 = 2 union all select path, 'UNTERMINATED_COMMENT', 4 + (v % 2 = 0)::int * 2 + (v > 0)::int from p where k % 10 = 3 union all select path, 'INCOMPLETE_DDL', 4 + (v % 2 = 0)::int * 2 + (v > 0)::int from p where k % 10 = 4) select * from q""")
def sql_diagnostics(spark, folder):
    """What is wrong with scripts that were damaged at their end."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    ending = F.when(k % 10 == 0, "SELECT 'open").when(k % 10 == 1, "SELECT (1").when(k % 10 == 2, _text("CREATE TABLE t{k} (id int);", k=n)).when(k % 10 == 3, "/* open").when(k % 10 == 4, "DROP TABLE").otherwise("")
    return database.diagnostics(_scripts(spark, folder, ending=ending))


@query(_P + "q as (select path, 'password=''[REDACTED]'' https://u:[REDACTED]@h/x k' || k as redacted from p) select * from q")
def redacted_scripts(spark, folder):
    """Scripts with their secrets replaced."""
    k = F.col("p_partkey").cast("string")
    rows = _scripts(spark, folder).select("path", _text("password='v{k}' https://u:p{k}@h/x k{k}", k=k).alias("content"))
    return rows.select("path", database.redact_secrets("content").alias("redacted"))


@query("""select p_partkey, case p_size % 8 when 0 then 'varchar' when 1 then 'double' when 2 then 'timestamp' when 3 then 'decimal' when 4 then 'enum' when 5 then 'unknown' when 6 then 'integer' else 'jsonb' end as type, p_size % 8 in (3, 5, 7) as risky from part""")
def sql_types(spark, folder):
    """Plain types behind SQL types, and whether a change from them (to integer, or json) loses something."""
    names = ["VARCHAR (20)", "double  precision", "timestamptz", "money", "enum('a','b')", "geometry", "Serial", "JSONB"]
    text = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 8 + 1).cast("int"))
    kind = database.normal_type(text)
    to = F.when(F.col("p_size") % 8 == 7, "json").otherwise("integer")
    return table(spark, folder, "part").select("p_partkey", kind.alias("type"), database.risky_change(kind, to).alias("risky"))


@query(_P + "q as (select 'table' as kind, count(*) as n, count(distinct path) as n_files from p union all select 'column', 3 * count(*), count(*) from p union all select 'index', count(*), count(*) from p union all select 'constraint', count(*), count(*) from p) select * from q")
def database_statistics(spark, folder):
    """How many objects of each kind the scripts define."""
    return database.schema_inventory(_scripts(spark, folder)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))
