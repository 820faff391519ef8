"""SQL text dumps: written row by row as expressions, read back by a lexer."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators import sqllexer
from veilframe.plans.rules import ForeignKey
from veilframe.session import stage
from veilframe.sources.writers import map_type


def sql_literal(c: Column, dtype: T.DataType) -> Column:
    """The value as SQL text.

    Text with a line break is written as an escape string, so that a statement is always one line.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(dtype, T.NumericType):
        text = c.cast("string")
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit(r"E'\\x"), F.lower(F.hex(c)), F.lit("'"))
    else:
        nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
        raw = F.to_json(c) if nested else c.cast("string")
        quoted = F.replace(raw, F.lit("'"), F.lit("''"))
        escaped = F.replace(quoted, F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        plain = F.concat(F.lit("'"), quoted, F.lit("'"))
        text = F.when(raw.rlike("[\n\r]"), F.concat(F.lit("E'"), escaped, F.lit("'"))).otherwise(plain)
    return F.when(c.isNull(), "NULL").otherwise(text)


def create_statement(schema: T.StructType, table: str, primary_key: Iterable[str] = ()) -> str:
    parts = [f"{f.name} {map_type(f)}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields]
    keys = list(primary_key)
    if keys:
        parts.append(f"PRIMARY KEY ({', '.join(keys)})")
    return f"CREATE TABLE {table} ({', '.join(parts)});"


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT per row in column `value`."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    literals = [sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *literals), F.lit(");")).alias("value"))


def to_sql_dump(df: DataFrame, table: str, primary_key: Iterable[str] = ()) -> DataFrame:
    """CREATE TABLE, then the inserts, as text rows."""
    create = df.sparkSession.createDataFrame(
        [(f"-- CREATE TABLE {table}",), (create_statement(df.schema, table, primary_key),)], "value string"
    )
    return create.unionByName(insert_statements(df, table))


def constraint_ddl(constraints: DataFrame, schema: str | None = None) -> DataFrame:
    """ALTER TABLE text of each row `(name, type, table, cols, ref_table, ref_cols)` of a constraints table."""
    dot = f"{schema}." if schema else ""
    cols, ref = F.array_join("cols", ", "), F.array_join("ref_cols", ", ")
    fallback = F.concat(F.lit("fk_"), F.col("table"), F.lit("_"), F.array_join("cols", "_"))
    name = F.when(F.trim("name") != "", F.col("name")).otherwise(fallback)
    head = F.concat(F.lit(f"ALTER TABLE {dot}"), F.col("table"), F.lit(" ADD CONSTRAINT "), name)
    fk = F.concat(F.lit(f" REFERENCES {dot}"), F.col("ref_table"), F.lit(" ("), ref, F.lit(")"))
    tail = F.when(F.col("type") == "FOREIGN KEY", fk).otherwise("")
    text = F.concat(head, F.lit(" "), F.col("type"), F.lit(" ("), cols, F.lit(")"), tail, F.lit(";"))
    known = F.col("type").isin("PRIMARY KEY", "UNIQUE", "FOREIGN KEY")
    return constraints.filter(known).select("table", name.alias("name"), text.alias("ddl"))


def foreign_key_ddl(keys: Iterable[ForeignKey]) -> list[str]:
    out = []
    for k in keys:
        name = k.name or f"fk_{k.child}_{'_'.join(k.child_columns)}"
        out.append(
            f"ALTER TABLE {k.child} ADD CONSTRAINT {name} FOREIGN KEY ({', '.join(k.child_columns)}) "
            f"REFERENCES {k.parent}({', '.join(k.parent_columns)});"
        )
    return out


# ---------------------------------------------------------------- reading

_PARSED = "table string, columns array<string>, values array<string>, reject string"


class DumpTables(dict):
    """Tables of a dump by name; `rejects` holds the statements that gave no rows, as column `value`."""

    rejects: DataFrame


def _parsed(statement: str) -> list[tuple]:
    found = sqllexer.parse(statement)
    if found is not None:
        table, columns, rows = found
        return [(table, columns, row, None) for row in rows]
    return [] if sqllexer.ignored(statement) else [(None, None, None, statement.strip())]


def _batch(out: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"columns": pa.list_(pa.string()), "values": pa.list_(pa.string()), "block": pa.int64(), "whole": pa.bool_()}
    columns = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds.get(c, pa.string())) for i, c in enumerate(columns)], columns)


def parse_statements(statements: DataFrame) -> DataFrame:
    """Statements in column `value` to `(table, columns, values, reject)`: a row for each row they insert, or the statement
    itself as `reject` where it gave none.

    Comments, blanks and CREATE give nothing. `columns` is null where a statement lists none. Values are SQL literals: casts
    are dropped, ARRAY[...] is JSON text.
    """

    def parsed(batches):
        for batch in batches:
            rows = [r for s in batch.column(0).to_pylist() if s is not None for r in _parsed(s)]
            yield _batch(rows, "table columns values reject")

    return statements.select("value").mapInArrow(parsed, _PARSED)


def parse_inserts(statements: DataFrame) -> DataFrame:
    """Rows of INSERT statements as `(table, columns, values)`; a statement may hold several rows."""
    return parse_statements(statements).where("reject IS NULL").select("table", "columns", "values")


def unread_statements(statements: DataFrame) -> DataFrame:
    """Statements other than comments, blanks and CREATE that gave no rows, as column `value`: the rejects of a dump."""
    return parse_statements(statements).where("reject IS NOT NULL").select(F.col("reject").alias("value"))


def _block_texts(batches, more: int = 0):
    """(first of its block, file, block, lines joined, further columns) of lines that come block by block, a batch at a time."""
    at = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3 + more)]
        begin = 0
        while begin < len(columns[0]):
            key, end = (columns[0][begin], columns[1][begin]), begin + 1
            while end < len(columns[0]) and (columns[0][end], columns[1][end]) == key:
                end += 1
            yield key != at, *key, "".join(f"{v}\n" for v in columns[2][begin:end]), [c[begin] for c in columns[3:]]
            at, begin = key, end


def _block_states(lines: DataFrame) -> DataFrame:
    """`(file, block, state)`: the state of the lexer where each block begins.

    Each block maps every state it might begin in to the one it ends in; the maps of a file's blocks, a small row each, are
    composed in order. A dollar quote whose mark does not occur in a block goes through it.
    """

    def row(key, states):
        return pa.RecordBatch.from_pylist(
            [{"file": key[0], "block": key[1], "begins": list(states), "ends": list(states.values())}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("begins", pa.list_(pa.string())), ("ends", pa.list_(pa.string()))]),
        )

    def mapped(batches):
        now, states = None, {}
        for first, file, block, text, _ in _block_texts(batches):
            if first:
                if now is not None:
                    yield row(now, states)
                now, states = (file, block), {s: s for s in (sqllexer.FIXED if block else ("",))}
            if block:  # a mark met for the first time: what began inside its quote is still there
                states |= {m: m for m in sqllexer.marks(text) if m not in states}
            ended = {s: sqllexer.walk(text, s)[1] for s in set(states.values())}
            states = {s: ended[e] for s, e in states.items()}
        if now is not None:
            yield row(now, states)

    def composed(table: pa.Table) -> pa.Table:
        rows, state, out = sorted(table.to_pylist(), key=lambda r: r["block"]), "", []
        for r in rows:
            out.append(state)
            state = dict(zip(r["begins"], r["ends"], strict=True)).get(state, state)
        return pa.table({"file": [r["file"] for r in rows], "block": pa.array([r["block"] for r in rows], pa.int64()), "state": out})

    maps = lines.mapInArrow(mapped, "file string, block long, begins array<string>, ends array<string>")
    return maps.groupBy("file").applyInArrow(composed, "file string, block long, state string")


def scan_dump(spark: SparkSession, path) -> DataFrame:
    """Dump files to `(table, columns, values, reject)`, as `parse_statements` gives them.

    A statement ends at a semicolon outside literals, names and comments, wherever lines or blocks of the file end. Files are
    read in blocks by several tasks: the first pass finds the state each block begins in, the second cuts and parses. Only
    statements that reach over the end of a block are put together from their pieces.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = stage(_block_states(lines), "dump-states")
    names = "table columns values reject file block piece whole"

    def cut(batches):
        state, held, whole, key = "", "", False, None
        for first, file, block, text, (begun,) in _block_texts(batches, 1):
            out = []
            if first:
                if key is not None:
                    out.append((None, None, None, None, *key, held, whole))
                key, state, held, whole = (file, block), begun, "", True
            ends, state = sqllexer.walk(text, state)
            done = 0
            for end in ends:
                statement, held, done = held + text[done:end], "", end
                if whole and block:  # ends what an earlier block began
                    out.append((None, None, None, None, *key, statement, None))
                else:
                    out += [(*r, None, None, None, None) for r in _parsed(statement)]
                whole = False
            held += text[done:]
            yield _batch(out, names)
        if key is not None:
            yield _batch([(None, None, None, None, *key, held, whole)], names)

    begun = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "state")  # a row per block of a file
    found = stage(begun.mapInArrow(cut, f"{_PARSED}, file string, block long, piece string, whole boolean"), "dump-pieces")
    # A block gives its head (whole is null) and what is open at its end; a block without any end gives itself (whole).
    pieces = found.where("piece IS NOT NULL").withColumn("later", F.col("whole").isNotNull())
    opens = F.col("later") & (~F.col("whole") | (F.col("block") == 0))
    order = Window.partitionBy("file").orderBy("block", "later")
    joined = (
        pieces.withColumn("begin", F.last(F.when(opens, F.col("block")), ignorenulls=True).over(order))
        .groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "later", "piece"))).alias("p"))
        .select(F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("value"))
    )
    return found.where("piece IS NULL").select("table", "columns", "values", "reject").unionAll(parse_statements(joined))


def scan_statements(spark: SparkSession, path) -> DataFrame:
    """Rows that the statements of dump files insert, as `(table, columns, values)`."""
    return scan_dump(spark, path).where("reject IS NULL").select("table", "columns", "values")


def read_statements(spark: SparkSession, path) -> DataFrame:
    """Statements as column `value`, for dumps in which a statement ends at a line that ends in a semicolon."""
    lines = spark.read.option("lineSep", ";\n").text(path)
    return lines.select(F.explode(F.split("value", ";\r\n")).alias("value"))


def _unquoted(c: Column) -> Column:
    """Text of one SQL literal; NULL for the word NULL."""
    body = F.replace(F.regexp_replace(c, r"(?s)^E?'(.*)'$", "$1"), F.lit("''"), F.lit("'"))
    # What lies between escaped backslashes holds the other escapes.
    parts = F.transform(F.split(body, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(F.upper(F.trim(c)) == "NULL", F.lit(None)).when(c.startswith("E'"), F.array_join(parts, "\\")).otherwise(body)


def table_of(statements: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Text rows of one table of a dump; give them to `split_rejects` for typed rows.

    Rows of statements without a column list follow the order of `schema`.
    """
    rows = statements.filter(F.col("table") == table.lower())
    out = []
    for i, f in enumerate(schema.fields):
        at = F.when(F.col("columns").isNull(), F.lit(i)).otherwise(F.array_position("columns", f.name).cast("int") - 1)
        text = _unquoted(F.get("values", at))
        if isinstance(f.dataType, T.BinaryType):
            text = F.unhex(F.regexp_replace(text, r"^\\x", ""))
        elif not isinstance(f.dataType, T.StringType):
            text = F.trim(text)
        out.append(text.alias(f.name))
    return rows.select(*out)


def scan_sql_dump(spark: SparkSession, path, schemas: Mapping[str, T.StructType]) -> DumpTables:
    """Tables of a dump as text rows, by name; statements that gave no rows are in its `rejects`."""
    found = stage(scan_dump(spark, path), "dump-rows")
    rows = found.where("reject IS NULL")
    out = DumpTables({name: table_of(rows, name, schema) for name, schema in schemas.items()})
    out.rejects = found.where("reject IS NOT NULL").select(F.col("reject").alias("value"))
    return out
