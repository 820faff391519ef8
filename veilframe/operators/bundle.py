"""Backups: records numbered in order, cut into parts by size, encrypted, written, inspected and restored.

A part is one row `(part_no, name, content)`. The content is text: a magic first line, then one JSON record per line
with the file it belongs to, its number in the bundle and its data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import require_key
from veilframe.session import stage
from veilframe.sources.committed import CommittedFolder, committed_files, has_manifest

MAGIC = "#veilframe-bundle-1"
DEFAULT_PART_BYTES = 100 * 1024 * 1024
_UNITS = {"": 1, "B": 1, "K": 2**10, "KB": 2**10, "M": 2**20, "MB": 2**20, "G": 2**30, "GB": 2**30, "T": 2**40,
          "TB": 2**40}


def parse_size(text: str | int | None) -> int:
    """`100MB`, `250`, `1 GB`; anything unreadable means 100 MB."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", str(text)) if text is not None else None
    unit = _UNITS.get(m[2].upper()) if m else None
    return int(m[1]) * unit if unit else DEFAULT_PART_BYTES


# ---------------------------------------------------------------- numbering and parts


def with_offsets(df: DataFrame, size: Column, order_by: list[str] | None = None) -> DataFrame:
    """Each row's number and the bytes before it (`__row`, `__start`), without a single-task window.

    Rows are range-sorted (or taken in input order), every task adds running totals to its own rows, the result is
    written once, and the task totals, one small row per task, are summed and joined back. Order by columns that
    tell rows apart: the sort then also splits a frequent value over several tasks.
    """
    rows = df.sort(*order_by) if order_by else df
    rows = rows.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    extra = [("__task", T.IntegerType()), ("__local", T.LongType()), ("__local_row", T.LongType())]
    schema = T.StructType(rows.schema.fields + [T.StructField(n, t) for n, t in extra])

    def running(batches):
        from pyspark import TaskContext

        task, done, count = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("__size")).to_numpy()
            n = len(sizes)
            ends = done + np.cumsum(sizes)
            columns = [
                pa.array(np.full(n, task, dtype=np.int32)),
                pa.array(ends - sizes),
                pa.array(np.arange(count, count + n, dtype=np.int64)),
            ]
            done, count = (int(ends[-1]) if n else done), count + n
            yield pa.RecordBatch.from_arrays(
                batch.columns + columns, names=batch.schema.names + ["__task", "__local", "__local_row"]
            )

    staged = stage(rows.mapInArrow(running, schema), "offsets")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        staged.groupBy("__task")
        .agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"), F.max("__local").alias("__last"))
        .withColumns(
            {
                "__bytes_before": F.coalesce(F.sum("__bytes").over(before), F.lit(0)),
                "__rows_before": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
            }
        )
        .withColumn("__last_start", F.max(F.col("__bytes_before") + F.col("__last")).over(Window.partitionBy(F.lit(1))))
        .select("__task", "__bytes_before", "__rows_before", "__last_start")
    )
    joined = staged.join(F.broadcast(totals), "__task")  # one row per task of the staging job
    return joined.withColumns(
        {"__start": F.col("__local") + F.col("__bytes_before"), "__row": F.col("__local_row") + F.col("__rows_before")}
    ).drop("__task", "__local", "__local_row", "__bytes_before", "__rows_before", "__size")


def assign_parts(
    df: DataFrame, size_col: str | Column, max_bytes: int | str, base: str = "export", order_by: list[str] | None = None
) -> DataFrame:
    """Part number (from 1) and part name of each row.

    A row belongs to the part its first byte falls in, so parts can be told apart without walking the rows one after
    the other; a part overshoots by at most its last row, where greedy filling would have started a new one.
    """
    limit = parse_size(max_bytes)
    size = F.col(size_col) if isinstance(size_col, str) else size_col
    rows = with_offsets(df, size, order_by)
    part = F.call_function("div", F.col("__start"), F.lit(limit).cast("long"))
    name = F.when(F.col("__last_start") < limit, F.lit(base)).otherwise(
        F.concat(F.lit(f"{base}-part"), (part + 1).cast("string"))
    )
    return rows.withColumns({"part_no": (part + 1).cast("int"), "part_name": name}).drop("__last_start")


def record_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as `(file, data)` JSON records; nulls are kept."""
    out = None
    for name, df in tables.items():
        data = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        one = df.select(F.lit(name).alias("file"), data.alias("data"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to export")
    return out


def pack_parts(
    lines: DataFrame,
    line: Column,
    max_bytes: int | str,
    base: str,
    suffix: str = ".jsonl",
    order_by: list[str] | None = None,
    greedy: bool = False,
    of: str | None = None,
) -> DataFrame:
    """Lines to parts, in input order or sorted; a group never holds more than one part's bytes and one line.

    With `greedy` parts are cut as `rotation.greedy_parts` does: below the limit, but for a single line that is larger.
    `of` names the column with each line's table: `contents` then tells the tables of a part and how many lines each has.
    """
    sized = lines.select(line.alias("line"), *[c for c in dict.fromkeys([*(order_by or []), *([of] if of else [])]) if c != "line"])
    if greedy:
        from veilframe.operators.rotation import greedy_parts as assign
    else:
        assign = assign_parts
    parts = assign(sized, F.octet_length("line") + 1, max_bytes, base, order_by)
    if of:
        runs = parts.groupBy("part_no", "part_name", F.col(of).alias("of")).agg(
            F.collect_list(F.struct("__row", "line")).alias("lines")
        )
        contents = F.sort_array(F.collect_list(F.struct("of", F.size("lines").cast("long").alias("lines"))))
        grouped = runs.groupBy("part_no", "part_name").agg(
            F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"), contents.alias("contents")
        )
    else:
        ordered = F.sort_array(F.collect_list(F.struct("__row", "line")))
        grouped = parts.groupBy("part_no", "part_name").agg(ordered.alias("lines"))
    text = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return grouped.select(
        "part_no",
        F.concat("part_name", F.lit(suffix)).alias("name"),
        F.encode(F.concat(F.lit(MAGIC + "\n"), text), "utf-8").alias("content"),
        *(["contents"] if of else []),
    )


def export_bundle(
    tables: Mapping[str, DataFrame], base: str, max_bytes: int | str = DEFAULT_PART_BYTES, key: str | None = None,
    greedy: bool = False, indexed: bool = False,
) -> DataFrame:
    """Tables to parts (`greedy` as in `pack_parts`), encrypted when a key is given; `indexed` parts know their `contents`."""
    line = F.to_json(F.struct("file", "data"))
    parts = pack_parts(record_lines(tables), line, max_bytes, base, greedy=greedy, of="file" if indexed else None)
    return encrypt_parts(parts, key) if key else parts


def _aes_key(key: str | None) -> Column:
    return F.lit(bytearray(hashlib.sha256(require_key(key).encode()).digest()))


def encrypt_parts(parts: DataFrame, key: str) -> DataFrame:
    """AES-256-CBC with a random vector in front; `.enc` is added to the name. `contents` becomes encrypted text."""
    def secret(value):
        return F.aes_encrypt(value, _aes_key(key), F.lit("CBC"), F.lit("PKCS"))

    out = {"content": secret(F.col("content")), "name": F.concat("name", F.lit(".enc"))}
    if "contents" in parts.columns:
        out["contents"] = F.base64(secret(F.encode(F.concat(F.lit(MAGIC), F.to_json("contents")), "utf-8")))
    return parts.withColumns(out)


def _plain(key: str | None) -> Column:
    """Decrypted content, NULL where the key does not open it; parts without `.enc` are taken as they are."""
    encrypted = F.col("name").endswith(".enc")
    if key is None or not key.strip():
        return F.when(~encrypted, F.col("content"))
    opened = F.try_aes_decrypt(F.col("content"), _aes_key(key), F.lit("CBC"), F.lit("PKCS"))
    return F.when(encrypted, opened).otherwise(F.col("content"))


def _opens(plain: Column) -> Column:
    # padding can fit by chance, so the first line is checked as well
    head = F.substring(plain, 1, len(MAGIC)) == F.lit(MAGIC.encode())
    return F.coalesce(head, F.lit(False))


def decrypt_parts(parts: DataFrame, key: str | None) -> DataFrame:
    """Parts with plain content; a part that does not open fails the job."""
    plain = _plain(key)
    checked = F.when(_opens(plain), plain).otherwise(
        F.raise_error(F.concat(F.lit("wrong key or damaged part: "), F.col("name"))).cast("binary")
    )
    return parts.select("part_no", F.regexp_replace("name", r"\.enc$", "").alias("name"), checked.alias("content"))


def validate_key(parts: DataFrame, key: str | None) -> bool:
    """Whether the key opens the first part."""
    first = parts.orderBy("part_no").limit(1)
    row = first.select(_opens(_plain(key)).alias("ok")).head()
    return bool(row and row.ok)


def scan_bundle(parts: DataFrame, key: str | None = None) -> DataFrame:
    """Records of a bundle as `(part_no, line_no, file, data)`."""
    lines = F.split(F.decode("content", "utf-8"), "\n")
    rows = decrypt_parts(parts, key).select("part_no", F.posexplode(lines).alias("line_no", "line"))
    record = F.from_json("line", "file string, data string")
    return rows.filter(F.col("line_no") > 0).select("part_no", "line_no", record.alias("r")).select(
        "part_no", "line_no", "r.file", "r.data"
    )


def restore_table(records: DataFrame, file: str, schema: T.StructType) -> DataFrame:
    """One table of a bundle with its schema."""
    rows = records.filter(F.col("file") == file)
    return rows.select(F.from_json("data", schema).alias("r")).select("r.*")


def inspect_bundle(parts: DataFrame, key: str | None = None) -> DataFrame:
    """Files of a bundle with their columns and record counts, and a status: SUCCESS, KEY_REQUIRED or INVALID_KEY."""
    blank = key is None or not key.strip()
    plain = _plain(key)
    opened = parts.select("part_no", "name", plain.alias("content")).withColumn("ok", _opens(F.col("content")))
    status = F.when(F.col("ok"), "SUCCESS").when(F.lit(blank) & F.col("name").endswith(".enc"), "KEY_REQUIRED").otherwise(
        "INVALID_KEY"
    )
    lines = F.slice(F.split(F.decode(F.when(F.col("ok"), F.col("content")), "utf-8"), "\n"), 2, 2**31 - 1)
    record = F.from_json("line", "file string, data string")
    rows = opened.select("part_no", status.alias("status"), F.posexplode_outer(lines).alias("line_no", "line"))
    rows = rows.select("status", "part_no", "line_no", record.alias("r"))
    first = F.min_by(F.json_object_keys("r.data"), F.struct("part_no", "line_no"))
    return rows.groupBy("status", F.col("r.file").alias("file")).agg(
        first.alias("columns"), F.count("r.file").alias("records")
    )


# ---------------------------------------------------------------- part files


def write_part_files(parts: DataFrame, folder: str) -> DataFrame:
    """Write each part as one file below `folder` (any file system Arrow knows); returns `(name, length)`.

    Tasks write the files, under a temporary name first, so a repeated task replaces its own work. A folder without a scheme
    is one of Spark's default file system.
    """
    return _write_parts(parts, folder).select("name", "length")


def _write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """As `write_part_files`, with the digest of each file and the `contents` of encrypted parts (else null)."""
    folder = CommittedFolder(parts.sparkSession, folder, "parts").folder
    folder = re.sub(r"^file:/(?!/)", "file:///", re.sub("^s3a:", "s3:", folder))

    def write(batches):
        from pyarrow import fs

        for batch in batches:
            names, sizes, digests = [], [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, root = fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                with system.open_output_stream(f"{root}/_{name}.tmp") as out:
                    out.write(content)
                system.move(f"{root}/_{name}.tmp", f"{root}/{name}")
                names.append(name)
                sizes.append(len(content))
                digests.append(hashlib.sha256(content).hexdigest())
            columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "length", "sha256", "contents"])

    known = dict(parts.dtypes).get("contents") == "string"
    contents = F.col("contents") if known else F.lit(None).cast("string").alias("contents")
    return parts.select("name", "content", contents).mapInArrow(
        write, "name string, length long, sha256 string, contents string"
    )


def part_number(name: Column) -> Column:
    """Part number in a file name: `-part7`, else `_7.` before the extension, else 0."""
    marked = F.regexp_extract(name, r"(?i)[-_.]part(\d+)", 1)
    plain = F.regexp_extract(name, r"(?i)[-_](\d+)\.[^.]+", 1)
    number = F.when(marked != "", marked).when(plain != "", plain).otherwise("0")
    return F.coalesce(number.try_cast("int"), F.lit(0))


def order_parts(files: DataFrame, name: str = "name") -> DataFrame:
    """Natural order: part 10 after part 2, then by name without case."""
    return files.orderBy(part_number(F.col(name)), F.lower(F.col(name)))


def find_parts(files: DataFrame, start: str | None = None, prefix: str | None = None, extensions=()) -> DataFrame:
    """Parts of one backup from a file listing.

    `start` names one part: its siblings are found. Otherwise files beginning with `prefix` are taken, or all files
    when none does.
    """
    lower = F.lower("name")
    if extensions:
        keep = F.lit(False)
        for e in extensions:
            keep = keep | lower.endswith(e.lower())
        files = files.filter(keep)
    if start is not None:
        marked = re.search(r"[-_.]part", start)
        stem = start[: marked.end()] if marked else None
        return order_parts(files.filter(F.col("name").startswith(stem) if stem else F.col("name") == start))
    if prefix:
        hits = files.filter(lower.startswith(prefix.lower()))
        files = files if hits.isEmpty() else hits
    return order_parts(files)


def part_name_pattern(base: str) -> str:
    """The names that parts of the backup `base` can have, as a regular expression."""
    return rf"^{re.escape(base)}([-_.][pP][aA][rR][tT]\d+|[-_]\d+)?(\.\w+)+$"


def save_parts(parts: DataFrame, folder: str, base: str) -> DataFrame:
    """Write the parts of the backup `base` and commit them together; returns `(name, length)`.

    The manifest keeps each part's digest, and its contents (encrypted) where the parts are indexed. The parts of an earlier backup of that name stay until all new ones are written, and are known from its manifest: other
    files of the folder are never removed or replaced.
    """
    out = CommittedFolder(parts.sparkSession, folder, base)
    try:
        log = stage(_write_parts(parts, out.staging), "export-log")
        about = {r.name: {"sha256": r.sha256, "contents": r.contents} for r in log.toLocalIterator()}
        out.commit({n: n for n in out.staged()}, about)
    finally:
        out.drop_staging()
    return log.select("name", "length")


def part_index(spark: SparkSession, folder: str, key: str, base: str) -> DataFrame:
    """`(name, file, lines)`: which tables lie in which parts of the backup `base`, from its manifest.

    Parts whose contents the manifest does not hold, or the key does not open, have a null `file`.
    """
    entries = CommittedFolder(spark, folder, base).entries()
    known = spark.createDataFrame([(e["name"], e.get("contents")) for e in entries], "name string, contents string")
    text = F.decode(F.try_aes_decrypt(F.unbase64("contents"), _aes_key(key), F.lit("CBC"), F.lit("PKCS")), "utf-8")
    text = F.when(text.startswith(MAGIC), F.substring(text, len(MAGIC) + 1, 2**31 - 1))
    held = F.explode_outer(F.from_json(text, "array<struct<of: string, lines: long>>"))
    return known.select("name", held.alias("held")).select("name", F.col("held.of").alias("file"), "held.lines")


def check_part_files(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """`(name, status)` of the parts of the backup `base` by its manifest: OK, ABSENT, DAMAGED or UNKNOWN (no digest kept)."""
    entries = CommittedFolder(spark, folder, base).entries()
    known = spark.createDataFrame([(e["name"], e.get("sha256")) for e in entries], "name string, sha256 string")
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found")
    )
    status = (
        F.when(F.col("found").isNull(), "ABSENT").when(F.col("sha256").isNull(), "UNKNOWN")
        .when(F.col("found") == F.col("sha256"), "OK").otherwise("DAMAGED")
    )
    return known.join(files, "name", "left").select("name", status.alias("status"))


def read_part_files(
    spark: SparkSession, folder: str, extensions=(".enc", ".jsonl"), base: str | None = None, names: list[str] | None = None
) -> DataFrame:
    """Part files of a folder as bundle parts: those of the backup `base` (by its manifest, else by name), or all of them.

    With `names` only these files are opened.
    """
    paths = folder if names is None else [f"{folder.rstrip('/')}/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", n) for n in names]
    rows = spark.read.format("binaryFile").load(paths)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = rows.select(name.alias("name"), "content")
    if base is not None and has_manifest(spark, folder, base):
        rows = rows.join(committed_files(spark, folder, base), "name", "left_semi")
    elif base is not None:
        rows = rows.where(F.col("name").rlike(part_name_pattern(base)))
    keep = F.lit(False)
    for e in extensions:
        keep = keep | F.col("name").endswith(e)
    return rows.filter(keep).select(part_number(F.col("name")).alias("part_no"), "name", "content")
