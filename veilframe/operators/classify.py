"""Name-based classification of columns as sensitive, key or mapping columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.catalog import key_column_count
from veilframe.plans.rules import RuleSet

# Fixed values: (category, rule, provider, confidence, name test, reason), first full match wins, case is ignored.
NAME_RULES = [
    ("EMAIL", "SFD", "email", 0.99, ".*(email|e_mail|mail_addr).*", "e-mail address"),
    ("FIRST_NAME", "SFD", "first_name", 0.98, ".*(first_name|fname|given_name|forename).*", "given name"),
    ("LAST_NAME", "SFD", "last_name", 0.98, ".*(last_name|lname|surname|family_name).*", "family name"),
    ("FULL_NAME", "SFD", "full_name", 0.95,
     ".*(cust_name|customer_name|staff_name|actor_name|client_name|contact_name|owner_name|full_name|person_name"
     "|employee_name|user_name|username).*", "name of a person or user"),
    ("NAME_GENERIC", "SFD", "full_name", 0.85, "name|.*_name", "generic name column"),
    ("PHONE", "SFD", "phone", 0.98, ".*(phone|mobile|tel_no|fax|contact_no).*", "telephone number"),
    ("STREET_ADDRESS", "SFD", "street", 0.96, ".*(address|addr|street|residence|line1|line2).*", "street address"),
    ("CITY", "SFD", "city", 0.92, ".*(city|district|town|municipality).*", "city or district"),
    ("POSTAL_CODE", "SFD", "zip", 0.95, ".*(postal_code|zip_code|zipcode|postcode|pincode).*", "postal code"),
    ("STATE_COUNTRY", "SFD", "country", 0.85, ".*(country|state_name|province|state).*", "state or country"),
    ("CARD_SECURITY", "SFD", "digits", 0.98, ".*(cvv|cvc|cid|card_security_code|security_code).*", "card security code"),
    ("CARD_EXPIRATION", "PMD", "date_shift", 0.95, ".*(card_exp|exp_date|exp_month|exp_year|card_expiry).*",
     "card expiry date"),
    ("CREDIT_CARD", "SFD", "card", 0.98, ".*(credit_card|card_number|card_no|card_num|cc_num|pan_number).*",
     "payment card number"),
    ("BANK_ACCOUNT", "SFD", "account", 0.96,
     ".*(iban|swift|bic|account_no|acc_no|acc_num|bank_account|routing_number).*", "bank account"),
    ("ROUTING_NUMBER", "SFD", "account", 0.96, ".*(routing_number|sort_code|aba_routing).*", "bank routing number"),
    ("SALARY_AMOUNT", "SFD", "amount", 0.92, ".*(salary|wage|compensation|bonus|income|remuneration).*", "pay"),
    ("FINANCIAL_BALANCE", "SFD", "amount", 0.88, ".*(balance|amount|credit_limit|revenue|fee|price).*", "amount of money"),
    ("PASSWORD_SECRET", "SFD", "password", 0.99,
     ".*(password|passwd|pwd|salt|secret_answer|security_answer).*", "password or secret"),
    ("API_TOKEN", "SFD", "token", 0.98,
     ".*(api_key|apikey|secret_key|private_key|auth_token|access_token|jwt|bearer_token|session_id|refresh_token).*",
     "key or token"),
    ("PHI_HEALTH_DATA", "FPH", "encrypt", 0.96,
     ".*(mrn|patient_id|medical_record|health_plan|insurance_id|diagnosis|prescription|treatment|health_status).*",
     "health data"),
    ("IP_ADDRESS", "SFD", "ip", 0.95, ".*(ip_address|client_ip|ipv4|ipv6|mac_address|mac_addr).*", "network address"),
    ("DEMOGRAPHIC", "SFD", "word", 0.90, ".*(gender|ethnicity|marital_status|religion|nationality).*",
     "demographic attribute"),
    ("DATE_OF_BIRTH", "PMD", "date_shift", 0.97, ".*(dob|birth_date|birthdate|date_of_birth|birthday).*",
     "date of birth"),
    ("SSN_NATIONAL_ID", "FPH", "encrypt", 0.98,
     ".*(ssn|social_security|national_id|tax_id|tin|aadhaar|passport|license_no|driver_license|dl_number).*",
     "national identifier"),
]
# Fixed values.
TENANT_NAMES = ".*(tenant_id|organization_id|org_id|company_id|workspace_id).*"
JUNCTION_HINTS = ["role", "item", "map", "rel", "xref", "link", "actor", "film", "category"]
UNIQUE_NAMES = ["uuid", "guid", "license_key", "registration_no", "account_key"]


def singular(name: Column) -> Column:
    """English singular of a table name; names of up to three letters stay."""
    n = F.length(name)
    cut = lambda k: F.left(name, n - k)
    return (
        F.when(n <= 3, name)
        .when(name.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(name.rlike("(ses|xes|shes|ches)$"), cut(2))
        .when(name.endswith("s") & ~name.endswith("ss"), cut(1))
        .otherwise(name)
    )


def is_primary_key(table: Column, column: Column) -> Column:
    """`id`, `<t>_id`, `<t>id` or `pk_<t>`, for the table name and its singular; both in lower case."""
    forms = [F.lit("id")]
    for t in (table, singular(table)):
        forms += [F.concat(t, F.lit("_id")), F.concat(t, F.lit("id")), F.concat(F.lit("pk_"), t)]
    return column.isin(*forms)


def is_foreign_key(table: Column, column: Column) -> Column:
    """Ends in `_id` or `_fk`, or begins with `fk_`, and is not the table's own primary key."""
    return (column.endswith("_id") | column.endswith("_fk") | column.startswith("fk_")) & ~is_primary_key(table, column)


def is_unique_key(column: Column) -> Column:
    return column.isin(*UNIQUE_NAMES)


def parent_candidate(column: Column) -> Column:
    """The table name a key column points to, by its own name; NULL when it names none."""
    stem = F.when(column.rlike("(_id|_fk)$"), F.left(column, F.length(column) - 3)).when(
        column.startswith("fk_"), F.substring(column, F.lit(4), F.length(column))
    )
    return F.when(stem != "", stem)


def infer_parent(columns: DataFrame) -> DataFrame:
    """Adds `target_table`: the listed table a key column points to, else the bare candidate name.

    A table is found by its exact name, its singular, or candidate plus s. The table list is grouped per spelling
    before the join, so each column matches at most one row.
    """
    names = columns.select("table").distinct()
    lower = F.lower(F.trim("table"))
    spellings = names.select(
        F.col("table").alias("__target"),
        F.explode(
            F.array(
                F.struct(lower.alias("s"), F.lit(0).alias("r")),
                F.struct(singular(lower).alias("s"), F.lit(1).alias("r")),
                F.struct(F.when(lower.endswith("s"), F.left(lower, F.length(lower) - 1)).alias("s"), F.lit(2).alias("r")),
            )
        ).alias("x"),
    )
    lookup = spellings.filter("x.s IS NOT NULL").groupBy(F.col("x.s").alias("__candidate")).agg(
        F.min_by("__target", F.struct("x.r", "__target")).alias("__target")
    )
    with_candidate = columns.withColumn("__candidate", parent_candidate(F.lower(F.trim("column"))))
    joined = with_candidate.join(lookup, "__candidate", "left")
    target = F.coalesce("__target", "__candidate")
    return joined.withColumn("target_table", target).drop("__candidate", "__target")


def is_mapping_column(table: Column, column: Column, id_columns: Column) -> Column:
    """Tenant columns, and key columns of a table that looks like a junction."""
    hints = F.lit(False)
    for hint in JUNCTION_HINTS:
        hints = hints | table.contains(hint)
    junction = table.contains("_") & (hints | (id_columns >= 2))
    return column.rlike(f"^(?:{TENANT_NAMES})$") | (junction & is_foreign_key(table, column))


def name_rule(column: Column) -> Column:
    """Number of the first name rule that matches (from 0), NULL for none."""
    out = F.lit(None).cast("int")
    for i in range(len(NAME_RULES) - 1, -1, -1):
        out = F.when(column.rlike(f"(?i)^(?:{NAME_RULES[i][4]})$"), F.lit(i)).otherwise(out)
    return out


def classify_columns(columns: DataFrame, alone: bool = False) -> DataFrame:
    """`(table, column)` rows to the classified ones: category, rule, confidence, key kind, target, reason.

    `alone` judges each column by itself, without counting the key columns beside it.
    """
    counted = columns.withColumn("n_id_columns", F.lit(0)) if alone else key_column_count(columns)
    named = counted.withColumns({"__t": F.lower(F.trim("table")), "__c": F.lower(F.trim("column"))})
    rows = infer_parent(named)
    t, c = F.col("__t"), F.col("__c")
    kind = (
        F.when(is_mapping_column(t, c, F.col("n_id_columns")), "TABLE_MAPPING")
        .when(is_primary_key(t, c), "PRIMARY_KEY")
        .when(is_foreign_key(t, c), "FOREIGN_KEY")
        .when(is_unique_key(c), "UNIQUE_KEY")
    )
    rows = rows.withColumns({"__kind": kind, "__rule": name_rule(c)}).filter("__kind IS NOT NULL OR __rule IS NOT NULL")

    def of_rule(i: int) -> Column:
        values = [r[i] for r in NAME_RULES]
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("__rule"))

    k = F.col("__kind")
    key_confidence = F.when(k == "TABLE_MAPPING", 0.96).when(k == "PRIMARY_KEY", 0.99).when(k == "FOREIGN_KEY", 0.95).when(
        k == "UNIQUE_KEY", 0.92
    )
    points = k.isin("TABLE_MAPPING", "FOREIGN_KEY")
    key_type = F.when(k.isNotNull(), k).when(c.isin("username", "user_name"), "UNIQUE_KEY")
    target = F.when(points & (c != "parent_id"), F.col("target_table"))
    reason = (
        F.when(k == "TABLE_MAPPING", "mapping column")
        .when(k == "PRIMARY_KEY", "primary key")
        .when(k == "FOREIGN_KEY", "foreign key")
        .when(k == "UNIQUE_KEY", "unique identifier")
        .otherwise(of_rule(5))
    )
    return rows.select(
        "table", "column",
        F.coalesce(k, of_rule(0)).alias("category"),
        F.when(k.isNotNull(), "FPH").otherwise(of_rule(1)).alias("rule"),
        F.when(k.isNotNull(), "encrypt").otherwise(of_rule(2)).alias("provider"),
        F.coalesce(key_confidence, of_rule(3)).alias("confidence"),
        key_type.alias("key_type"), target.alias("target_table"),
        F.when(points, "id").alias("target_column"), reason.alias("reason"),
    )


LIST_NAMES = 1000  # names in one row of a list


def classification_summary(classified: DataFrame, lists: bool = True, names: int = LIST_NAMES) -> DataFrame:
    """Columns per rule kind and per key kind with their counts, and the totals.

    With `lists` the sorted names of each group come too, in chunks (0, 1, ...) of at most `names`: a group has a row per
    chunk, and no task gathers more than one. Totals list no names.
    """
    groups = F.explode(
        F.filter(
            F.array(
                F.concat(F.lit("rule:"), "rule"), F.concat(F.lit("key:"), "key_type"), F.lit("total:columns"),
                F.when(F.col("key_type").isNotNull(), "total:keys"),
            ),
            lambda g: g.isNotNull(),
        )
    )
    full = F.concat("table", F.lit("."), "column")
    rows = classified.select(groups.alias("group"), full.alias("full"))
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_columns"))
    if not lists:
        return counts
    from veilframe.operators.catalog import indexed

    numbered = indexed(rows.where(~F.col("group").startswith("total:")).distinct(), ["group", "full"])
    starts = numbered.groupBy("group").agg(F.min("idx").alias("first"))
    placed = numbered.join(starts, "group").withColumn("chunk", F.floor((F.col("idx") - F.col("first")) / names).cast("int"))
    chunks = placed.groupBy("group", "chunk").agg(F.array_join(F.sort_array(F.collect_list("full")), ", ").alias("columns"))
    return counts.join(chunks, "group", "left").select(
        "group", F.coalesce("chunk", F.lit(0)).alias("chunk"), "n_columns", F.coalesce("columns", F.lit("")).alias("columns")
    )


def rules_from_classification(classified: DataFrame, base: RuleSet | None = None) -> RuleSet:
    """A rule set with one rule per classified column (metadata: one row per column of the catalog)."""
    rows = classified.select("table", "column", "rule").collect()
    picked = {kind: tuple(sorted(f"{r.table}.{r.column}" for r in rows if r.rule == kind)) for kind in ("SFD", "PMD", "FPH")}
    return replace(base or RuleSet(), masking=picked["SFD"], partial=picked["PMD"], constraint=picked["FPH"])


_ENTITY = (
    "map<string, struct<table string, column string, category string, ruleType string, fakerMethod string,"
    " confidence double, reason string, keyType string, targetTable string, targetColumn string>>"
)


def parse_model_labels(df: DataFrame, reply: str) -> DataFrame:
    """Labelled columns from a JSON reply text, one row per label.

    A code fence around the reply is dropped, the labels may be wrapped in `detectedEntities` or be the whole reply,
    and missing fields get defaults. A reply that is not JSON gives no rows.
    """
    text = F.trim(F.col(reply))
    fenced = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```[^`]*$", 1)
    body = F.when(text.startswith("```") & (fenced != ""), F.trim(fenced)).otherwise(text)
    wrapped = F.get_json_object(body, "$.detectedEntities")
    entities = F.from_json(F.when(wrapped.startswith("{"), wrapped).otherwise(body), _ENTITY)
    rows = df.select(*[c for c in df.columns if c != reply], F.explode(entities).alias("name", "e"))
    rows = rows.filter("e IS NOT NULL")
    dotted = F.split("name", r"\.")
    has_dot = F.col("name").contains(".")
    return rows.select(
        *[c for c in df.columns if c != reply],
        "name",
        F.coalesce("e.table", F.when(has_dot, F.get(dotted, F.lit(0))).otherwise("")).alias("table"),
        F.coalesce("e.column", F.when(has_dot, F.get(dotted, F.lit(1))).otherwise(F.col("name"))).alias("column"),
        F.coalesce("e.category", F.lit("PII")).alias("category"),
        F.upper(F.coalesce("e.ruleType", F.lit("SFD"))).alias("rule"),
        F.coalesce("e.fakerMethod", F.lit("full_name")).alias("provider"),
        F.coalesce("e.confidence", F.lit(0.95)).alias("confidence"),
        F.coalesce("e.reason", F.lit("labelled by the model")).alias("reason"),
        F.col("e.keyType").alias("key_type"), F.col("e.targetTable").alias("target_table"),
        F.col("e.targetColumn").alias("target_column"),
    )
