"""Exact deduplication by a tree of merges over sorted runs of digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, free_name
from veilframe.session import stage

FAN_IN = 8


def _best(order: Column, keep: str) -> Column:
    return F.max(order) if keep == "largest" else F.min(order)


def duplicate_groups(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", fan_in: int = FAN_IN,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, `carry` columns, keep_id, group_size, kept, text_sha256, and its run and place.

    Texts are equal when their bytes are; null counts as empty. `keep` names which id of a group stays. A missing id
    loses against any other; among equal ids (repeated rows) the first row read stays, so exactly one row of a group
    is kept.

    Every input partition is one run of digests, sorted and reduced to a row per digest. In each round `fan_in` runs
    merge into one, keeping per digest the best identifier and the number of rows, until one run is left. Then the
    answers go down the same tree: an entry asks the run it was merged into. No step meets more rows of one text than
    an input partition holds or `fan_in` runs give, whatever the size of its group. Two entries merge only if
    SHA-256, byte length and a second 64-bit digest of the text agree.

    Each level is a narrow table (no texts), staged in the shared folder.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    text = F.coalesce(column(text_column), F.lit(""))
    ident = column(id_column)
    place = F.monotonically_increasing_id()
    # Ordered so that missing ids lose and earlier rows win.
    order = F.struct(ident.isNotNull() if keep == "largest" else ident.isNull(), ident.alias("id"),
                     (-place if keep == "largest" else place).alias("place"))
    leaves = stage(
        df.select(
            ident.alias("id"), *[column(c).alias(f"c_{i}") for i, c in enumerate(carry)],
            F.spark_partition_id().alias("run"), place.alias("place"), order.alias("best"),
            F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("size"),
            F.xxhash64(text).alias("second"),
        ),
        "digests",
    )
    key = ["sha", "size", "second"]

    def merged(entries: DataFrame, count: Column) -> DataFrame:
        runs = entries.groupBy("run", *key).agg(_best(F.col("best"), keep).alias("best"), F.sum(count).alias("n"))
        return stage(runs.sortWithinPartitions("run", *key), "run")

    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    levels = [merged(leaves, F.lit(1))]
    while runs > 1:
        levels.append(merged(levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), F.col("n")))
        runs = -(-runs // fan_in)

    answers = levels[-1].select("run", *key, "best", "n")
    for below in levels[-2::-1]:
        up = answers.select(F.col("run").alias("up"), *key, F.col("best").alias("best"), F.col("n").alias("n"))
        answers = (
            below.drop("best", "n").withColumn("up", F.floor(F.col("run") / fan_in).cast("int"))
            .join(up, ["up", *key]).drop("up")
        )
    mine = answers.select("run", *key, F.col("best").alias("winner"), "n")
    return leaves.join(mine, ["run", *key]).select(
        F.col("id").alias(id_column), *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("winner.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.place") == F.col("winner.place")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "run", "place",
    )


def drop_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `df` that stay, with the columns of `df`.

    Rows are found again by id and a hash of all their columns. Rows equal in every column are one row; of them one
    is returned.
    """
    mark = free_name(df.columns, "row_hash")
    marked = df.withColumn(mark, row_hash(df))
    kept = duplicate_groups(marked, id_column, text_column, keep, carry=(mark,)).where("kept")
    return only_rows(marked, kept, id_column, mark)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, null told apart from empty."""
    parts = []
    for name, kind in df.dtypes:
        value = column(name)
        if "map<" in kind or "variant" in kind:
            value = F.to_json(F.struct(value))
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def only_rows(marked: DataFrame, kept: DataFrame, id_column: str, mark: str) -> DataFrame:
    """The rows of `marked` whose id and hash are in `kept`, one of each; without the hash column."""
    names = [c for c in marked.columns if c != mark]
    wanted = kept.select(column(id_column).alias("wanted_id"), column(mark).alias("wanted_hash"))
    found = marked.join(wanted, column(id_column).eqNullSafe(F.col("wanted_id")) & (column(mark) == F.col("wanted_hash")), "left_semi")
    repeated = marked.groupBy(column(id_column).alias("i"), column(mark).alias("h")).count().where("count > 1").limit(1)
    if repeated.isEmpty():
        return found.select(*[column(c) for c in names])
    whole = found.groupBy(column(id_column).alias("i"), column(mark).alias("h")).agg(F.first(F.struct(*[column(c) for c in names])).alias("row"))
    return whole.select(*[F.col("row").getField(c).alias(c) for c in names])
