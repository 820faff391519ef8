"""Synthetic tables that keep primary, foreign and unique keys.

Every value is an expression of the row's sequence number, so a table of any size is one narrow plan. Parent keys are
looked up by position with an equi join, unique picks come from a permutation of the positions: nothing is drawn and
checked against what was drawn before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.fpe import permute
from veilframe.functions.hashing import digit, int_div, keyed_hash, pick, subkey
from veilframe.functions.synthetic import ANCHOR, hash_uuid
from veilframe.operators.catalog import indexed
from veilframe.operators.values import (
    ANCHOR_TIME, COLUMN_RULES, DOC_RULES, INT_KEYS, JSON_RULES, KEY_RULES, SMALL_KEYS, TINY_KEYS, Field, GenColumn, kind_of, spark_type,
    value_by,
)
from veilframe.plans.rules import ForeignKey, simple_name

DEFAULT_FIELDS = ["id", "fullName", "email", "phone", "department", "status", "salary", "createdDate"]
DEFAULT_DOC_FIELDS = ["name", "email", "phone", "status", "role", "amount", "createdAt"]
DATE_KEYS = 2**31 - 2  # days before the anchor; from the 739,252nd on they lie before the year 1, which Spark and files hold but Python's dates do not


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[GenColumn, ...]
    rows: int


def sequence(spark: SparkSession, n: int) -> DataFrame:
    """Row numbers 1..n in column `seq`."""
    return spark.range(1, n + 1).withColumnRenamed("id", "seq")


def topo_order(tables: Iterable[str], keys: Iterable[ForeignKey]) -> list[str]:
    """Parents before children; references to itself do not count; a cycle is taken in the given order."""
    names = list(tables)
    by_name = {simple_name(n): n for n in names}
    needs: dict[str, set[str]] = {n: set() for n in names}
    for k in keys:
        child, parent = by_name.get(simple_name(k.child)), by_name.get(simple_name(k.parent))
        if child and parent and child != parent:
            needs[child].add(parent)
    done: list[str] = []
    while len(done) < len(names):
        # one round places every table whose parents are placed, in the given order
        before = len(done)
        for n in names:
            if n not in done and needs[n] <= set(done):
                done.append(n)
        if len(done) == before:
            done += [n for n in names if n not in done]
    return done


# ---------------------------------------------------------------- keys and codes


def key_capacity(col: GenColumn) -> int | None:
    """How many distinct keys a column can hold, None where the sequence number itself is the bound."""
    kind = kind_of(col.type)
    if kind == "short":
        return SMALL_KEYS
    if kind == "byte":
        return TINY_KEYS
    if kind == "int":
        return 2**31 - 2
    if kind == "date":
        return DATE_KEYS
    if kind == "text" and 0 < col.size <= 5:
        return {1: 26, 2: 936}.get(col.size, 36**col.size)
    if kind == "text" and col.size:
        room = col.size - (len("user@example.com") if "email" in col.name.lower() else len(col.name) + 1)
        return 10 ** max(room, 0) - 1
    return None


def gen_key(seq: Column, col: GenColumn, n: int, key: str = "generate") -> Column:
    """A unique value per sequence number; a domain that cannot hold `n` values is an error."""
    capacity = key_capacity(col)
    if capacity is not None and n > capacity:
        raise ValueError(f"{col.name}: {n} unique values do not fit, the type holds {capacity}")
    return value_by(KEY_RULES, Field(seq, col, key, col.name.lower(), col.size))


# ---------------------------------------------------------------- foreign keys


def gen_fk(rows: DataFrame, column: str, parents: DataFrame, count: int, key: str, salt: str = "") -> DataFrame:
    """Adds a parent key per row: position = keyed hash of the sequence number, then an equi join on the position.

    `parents` has `idx` (0..count-1) and `key` (see `indexed_keys`). Positions are spread evenly, so the join has no
    hot side; a small parent table is broadcast by size.
    """
    at = digit(keyed_hash(F.col("seq"), key, f"fk.{column}.{salt}"), count)
    return _lookup(rows.withColumn("__idx", at), column, parents)


def gen_unique_fk(rows: DataFrame, column: str, parents: DataFrame, count: int, key: str) -> DataFrame:
    """Parent keys without repeats: the permuted sequence number is the position; NULL once all are used.

    Rows past the last parent key do not take part in the join: without a key they would all meet in one task.
    """
    kind = parents.schema["key"].dataType
    spare = rows.where((F.col("seq") > count) | F.col("seq").isNull()).withColumn(column, F.lit(None).cast(kind))
    if count < 1:
        return rows.withColumn(column, F.lit(None).cast(kind))
    at = permute(F.col("seq") - 1, count, key, f"ufk.{column}")
    return _lookup(rows.where(F.col("seq") <= count).withColumn("__idx", at), column, parents).unionByName(spare)


def _lookup(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    keys = parents.select(F.col("idx").alias("__idx"), F.col("key").alias(column))
    return rows.join(keys, "__idx", "left").drop("__idx")


def indexed_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null keys of a parent column as `(idx, key)`."""
    keys = df.select(F.col(column).alias("key")).dropna().distinct()
    return indexed(keys, ["key"]).select("idx", "key")


def gen_composite_key(
    rows: DataFrame, parents: Mapping[str, tuple[DataFrame, int]], key: str, n: int
) -> DataFrame:
    """Distinct combinations of parent keys: the sequence number is permuted over all combinations and divided out.

    `parents` maps each key column to its `(idx, key)` table and the number of keys. More rows than combinations is an
    error.
    """
    total = 1
    for _, count in parents.values():
        total *= count
    if n > total:
        raise ValueError(f"{n} rows do not fit into {total} key combinations")
    total = min(total, 2**62)  # what a long can number; still more than any row count
    out = rows.withColumn("__combo", permute(F.col("seq") - 1, total, key, "composite"))
    rest = F.col("__combo")
    for column, (table, count) in parents.items():
        out = _lookup(out.withColumn("__idx", rest % F.lit(count).cast("long")), column, table)
        rest = int_div(rest, count)
    return out.drop("__combo")


def unused_combinations(candidates: DataFrame, existing: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The first `n` candidate rows (by `seq`) whose key columns the existing table does not hold."""
    free = candidates.join(existing.select(*columns).distinct(), columns, "left_anti")
    return free.orderBy("seq").limit(n)


# ---------------------------------------------------------------- values


def gen_value(seq: Column, col: GenColumn, key: str) -> Column:
    """A plain value: special types first, then by column name, then by type; texts are cut to the column."""
    return value_by(COLUMN_RULES, Field(seq, col, key, f"gen.{col.name.lower()}", col.size or 255))


def coerce(c: Column, col: GenColumn) -> Column:
    """Fit any value to a column: integers wrapped into the positive range, texts cut, dates and numbers parsed."""
    kind = kind_of(col.type)
    if kind in ("short", "byte", "int", "long"):
        number = F.coalesce(c.cast("string").try_cast("decimal(38,0)").try_cast("long"), F.lit(1).cast("long"))
        if kind == "long":
            return number
        top, wrap, name = {
            "short": (32_767, SMALL_KEYS, "smallint"), "byte": (127, TINY_KEYS, "tinyint"),
            "int": (2_147_483_647, INT_KEYS, "int"),
        }[kind]
        fits = (number > 0) & (number <= top)
        return F.when(fits, number).otherwise(F.pmod(F.abs(number), F.lit(wrap).cast("long")) + 1).cast(name)
    if kind in ("decimal", "double"):
        number = c.cast("string").try_cast("double")
        value = F.coalesce(number, F.lit(0.0))
        return value.try_cast(spark_type(col)) if kind == "decimal" else value
    if kind == "date":
        return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"), F.lit(ANCHOR))
    if kind == "timestamp":
        return F.coalesce(c.cast("string").try_cast("timestamp_ntz"), F.lit(ANCHOR_TIME).cast("timestamp_ntz"))
    if kind == "bool":
        return F.coalesce(c.cast("string").try_cast("boolean"), F.lit(False))
    if kind == "binary":
        return F.encode(c.cast("string"), "utf-8")
    if kind == "array":
        return F.array(c.cast("string"))
    text = c.cast("string")
    return F.substring(text, 1, col.size) if col.size else text


# ---------------------------------------------------------------- tables


def generate(
    rows: DataFrame,
    spec: TableSpec,
    key: str,
    parents: Mapping[tuple[str, str], tuple[DataFrame, int]] | None = None,
) -> DataFrame:
    """One table over the sequence numbers in `rows`; `spec.rows` is their number.

    `parents` maps `(table, column)` to `(idx, key)` tables with their sizes. A foreign key without a known parent
    gets a placeholder, and a column `<x>_id` without a declared parent uses the keys of table `<x>` if known.
    """
    known = {(simple_name(t), c.lower()): v for (t, c), v in (parents or {}).items()}
    keys = [c for c in spec.columns if c.primary]
    out, placed = rows, {}
    composite = {c.name: _parent_of(c, known) for c in keys} if len(keys) > 1 else {}
    if composite and all(composite.values()):
        out = gen_composite_key(out, composite, key, spec.rows)
        placed = {name: F.col(name) for name in composite}
    for col in spec.columns:
        if col.name in placed:
            continue
        parent = _parent_of(col, known)
        if parent and not col.primary:
            table, count = parent
            out = gen_unique_fk(out, col.name, table, count, key) if col.unique else gen_fk(out, col.name, table, count, key, spec.name)
            placed[col.name] = F.col(f"`{col.name}`")
    seq, select = F.col("seq"), []
    for col in spec.columns:
        if col.name in placed:
            value = placed[col.name]
        elif col.foreign:
            value = _orphan_value(seq, col, key)
        elif col.primary or col.unique:
            value = gen_key(seq, col, spec.rows, key)
        else:
            value = gen_value(seq, col, key)
        select.append(value.alias(col.name))
    return out.select(*select)


def _parent_of(col: GenColumn, known: Mapping):
    if col.foreign:
        return known.get((simple_name(col.foreign[0]), col.foreign[1].lower()))
    if not col.primary and not col.unique and col.name.lower().endswith("_id"):
        stem = col.name.lower()[:-3]
        for (table, _), value in known.items():
            if table == stem:
                return value
    return None


def _orphan_value(seq: Column, col: GenColumn, key: str) -> Column:
    """A foreign key whose parent has no rows: null or a placeholder."""
    if kind_of(col.type) in ("long", "int", "short"):
        value = F.lit(1).cast(spark_type(col))
    elif 0 < col.size <= 2:
        value = F.concat(F.lit("R"), (seq % 10).cast("string"))
    elif 0 < col.size < 5:
        value = F.concat(F.lit("R"), (seq % 9 + 1).cast("string"))
    else:
        value = F.lit("REF-1")
    if not col.nullable:
        return value
    return F.when(digit(keyed_hash(seq, key, f"orphan.{col.name}"), 2) == 1, value)


# ---------------------------------------------------------------- files and documents


def json_value(seq: Column, field: str, key: str) -> Column:
    """Value of a JSON or delimited field, by name."""
    return value_by(JSON_RULES, Field(seq, GenColumn(field), key, f"json.{field.lower()}", 0))


def gen_json(rows: DataFrame, key: str, fields: Iterable[str] = (), template: Mapping | None = None) -> DataFrame:
    """Records from a field list, or shaped like a sample record: nesting and array lengths are kept."""
    seq = F.col("seq")
    if template is None:
        return rows.select(*[json_value(seq, f, key).alias(f) for f in (list(fields) or DEFAULT_FIELDS)])
    return rows.select(*[_from_template(seq, f, v, key).alias(f) for f, v in template.items()])


def _from_template(seq: Column, field: str, sample, key: str) -> Column:
    if isinstance(sample, Mapping):
        return F.struct(*[_from_template(seq, f, v, key).alias(f) for f, v in sample.items()])
    if isinstance(sample, list):
        return F.array(*[_from_template(seq, field, v, key) for v in sample])
    return json_value(seq, field, key)


def gen_csv(rows: DataFrame, key: str, fields: Iterable[str] = ()) -> DataFrame:
    """Text rows for one delimited file: fields of the spec or of a template's header, else a default list."""
    table = gen_json(rows, key, fields)
    return table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns])


def parse_doc_fields(specs: Iterable[str]) -> dict[str, int | None]:
    """`name`, `name:type(len)` or `name(len)` to name -> longest text."""
    out: dict[str, int | None] = {}
    for raw in specs:
        text = (raw or "").strip()
        if not text or text.lower() == "_id":
            continue
        length = re.search(r"\((\s*\d+\s*)\)", text)
        name = re.split(r"[: ]+", text)[0].split("(")[0].strip()
        out[name] = int(length[1]) if length and int(length[1]) > 0 else None
    return out


def doc_value(seq: Column, field: str, key: str, longest: int | None = None) -> Column:
    """Value of a document field, by name and longest text."""
    return value_by(DOC_RULES, Field(seq, GenColumn(field), key, f"doc.{field.lower()}", longest or 0))


def doc_fields(sample: Mapping | None = None, specs: Iterable[str] = ()) -> dict[str, int | None]:
    """Fields of a sample document (short texts keep their length) and of the spec, else a default list."""
    out: dict[str, int | None] = {}
    for name, value in (sample or {}).items():
        if name != "_id":
            out[name] = len(value) if isinstance(value, str) and 0 < len(value) <= 5 else None
    out |= parse_doc_fields(specs)
    return out or dict.fromkeys(DEFAULT_DOC_FIELDS)


def gen_docs(rows: DataFrame, key: str, sample: Mapping | None = None, specs: Iterable[str] = ()) -> DataFrame:
    """Documents with a 24-digit hexadecimal `_id` from the sequence number."""
    seq = F.col("seq")
    doc_id = F.substring(F.sha2(F.concat(F.lit(subkey(key, "doc")), seq.cast("string")), 256), 1, 24).alias("_id")
    return rows.select(doc_id, *[doc_value(seq, f, key, n).alias(f) for f, n in doc_fields(sample, specs).items()])


# ---------------------------------------------------------------- report and seed datasets


def generation_report(generated: Mapping[str, DataFrame], targets: Mapping[str, int]) -> DataFrame:
    """Rows made against rows asked for, percent at most 99 until done."""
    from veilframe.operators.catalog import row_counts

    counts = row_counts(generated)
    target = F.lit(None).cast("long")
    for name, n in targets.items():
        target = F.when(F.col("table") == name, F.lit(n).cast("long")).otherwise(target)
    percent = F.round(F.col("n_rows") * 100 / target).cast("int")
    return counts.withColumn("target", target).withColumn(
        "percent", F.when(F.col("n_rows") >= F.col("target"), 100).otherwise(F.least(percent, F.lit(99)))
    )


def sample_report(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)


CARD_CATEGORIES = ["Grocery", "Electronics", "Travel", "Dining", "Apparel", "Entertainment"]
CARD_COUNTRIES = ["India", "USA", "UK", "UAE", "Singapore"]
CARD_STATES = ["APPROVED", "APPROVED", "APPROVED", "DECLINED", "PENDING"]
DISPUTE_STATES = ["OPEN", "INVESTIGATING", "RESOLVED_REFUNDED", "RESOLVED_DENIED"]


def _ago(h: Column, days: int) -> Column:
    """A moment up to `days` before the anchor, in whole seconds."""
    return F.lit(ANCHOR_TIME).cast("timestamp_ntz") - F.make_dt_interval(secs=digit(h, days * 86_400).cast("decimal(18,6)"))


def seed_card_dataset(customers: DataFrame, merchants: DataFrame, key: str = "seed") -> dict[str, DataFrame]:
    """Customers, one card each, merchants, transactions pairing the n-th card with the n-th merchant, disputes.

    Both inputs carry `seq` (see `sequence`; the original sizes are 100,000 and 50,000).
    """
    seq = F.col("seq")

    def h(label: str) -> Column:
        return keyed_hash(seq, key, label)

    people = customers.select(
        "seq", hash_uuid(seq, key, "customer").alias("customer_id"),
        F.concat(F.lit("First_"), seq.cast("string")).alias("first_name"),
        F.concat(F.lit("Last_"), seq.cast("string")).alias("last_name"),
        F.concat(F.lit("user_"), seq.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+91"), (digit(h("phone"), 4_000_000_000) + 6_000_000_000).cast("string")).alias("phone_number"),
        _ago(h("created"), 365).alias("created_at"),
    )
    cards = people.select(
        "seq", hash_uuid(seq, key, "card").alias("card_id"), "customer_id",
        F.concat(F.lit("****-****-****-"), (digit(h("number"), 9000) + 1000).cast("string")).alias("card_number_masked"),
        F.concat(
            F.lpad((digit(h("month"), 12) + 1).cast("string"), 2, "0"), F.lit("/"), (digit(h("year"), 7) + 26).cast("string")
        ).alias("expiration_date"),
        F.md5(h("cvv").cast("string")).alias("cvv_hash"),
        ((digit(h("limit"), 10) + 1) * 50_000).cast("decimal(10,2)").alias("credit_limit"),
        (digit(h("active"), 100) >= 5).alias("is_active"),
        (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("created_at"),
    )
    shops = merchants.select(
        "seq", hash_uuid(seq, key, "merchant").alias("merchant_id"),
        F.concat(F.lit("Merchant_"), seq.cast("string")).alias("merchant_name"),
        pick(CARD_CATEGORIES, h("category")).alias("category"), pick(CARD_COUNTRIES, h("country")).alias("country"),
        _ago(h("opened"), 365).alias("created_at"),
    )
    pairs = cards.select("seq", "card_id").join(shops.select("seq", "merchant_id"), "seq")
    payments = pairs.select(
        "seq", hash_uuid(seq, key, "transaction").alias("transaction_id"), "card_id", "merchant_id",
        ((digit(h("amount"), 2_500_000) + 1000).cast("decimal(20,0)") / F.lit(100)).cast("decimal(12,2)").alias("amount"),
        F.lit("INR").alias("currency"), _ago(h("paid"), 30).alias("transaction_date"),
        pick(CARD_STATES, h("state")).alias("status"),
    )
    reason = F.concat(
        F.lit("Unauthorized charge / Item not received - Ref #"), digit(h("reason"), 100_000).cast("string")
    )
    disputes = payments.select(
        "seq", hash_uuid(seq, key, "dispute").alias("dispute_id"), "transaction_id", reason.alias("dispute_reason"),
        pick(DISPUTE_STATES, h("dispute")).alias("status"), F.col("amount").alias("amount_claimed"),
        (F.col("transaction_date") + F.make_dt_interval(F.lit(2))).alias("created_at"),
    )
    return {"customers": people, "credit_cards": cards, "merchants": shops, "transactions": payments, "disputes": disputes}


def seed_shop_dataset(
    users: DataFrame, products: DataFrame, orders: DataFrame, n_users: int = 1000, n_products: int = 100, key: str = "seed"
) -> dict[str, DataFrame]:
    """Users, products and orders (original sizes 1000, 100, 5000); orders point to users and products by number."""
    seq = F.col("seq")

    def h(label: str) -> Column:
        return keyed_hash(seq, key, label)

    def named(prefix: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), seq.cast("string"), F.lit(suffix))

    def cents(label: str, low: int, high: int) -> Column:
        value = (digit(h(label), (high - low) * 100) + low * 100).cast("decimal(20,0)") / F.lit(100)
        return value.cast("decimal(10,2)")

    return {
        "users": users.select(
            seq.alias("id"), named("user").alias("username"), named("user", "@example.com").alias("email"),
            named("FirstName").alias("first_name"), named("LastName").alias("last_name"),
        ),
        "products": products.select(
            seq.alias("id"), named("Product ").alias("product_name"), named("Description for product ").alias("description"),
            cents("price", 10, 1010).alias("price"), digit(h("stock"), 1000).cast("int").alias("stock_quantity"),
        ),
        "orders": orders.select(
            seq.alias("id"), (digit(h("user"), n_users) + 1).alias("user_id"),
            (digit(h("product"), n_products) + 1).alias("product_id"),
            (digit(h("quantity"), 10) + 1).cast("int").alias("quantity"), cents("total", 100, 5100).alias("total_amount"),
        ),
    }
