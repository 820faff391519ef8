"""The checked queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bpe_stream import roundtrip_digests
from veilframe.llm.common import held_out
from veilframe.llm.compression_quality import fit_quality, quality_score
from veilframe.llm.conversation_trie import conversation_trie, with_shared_heads
from veilframe.llm.exact_dedup import duplicate_groups
from veilframe.llm.kneser_ney import train_and_score
from veilframe.llm.language import fit_languages, language_of
from veilframe.llm.parity_join import near_copies
from veilframe.llm.sharding import shard_records
from veilframe.llm.string_tiling import tile_coverage
from veilframe.llm.token_counts import counts_and_fit
from veilframe.llm.tool_calls import link_tool_calls
from veilframe.llm.url_rules import judge_urls
from veilframe.llm.whitening import whitened_components
from veilframe.registry.base import Query, table

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(run, sql)
        return run

    return register


@query("op1_sampled_splitters")
def sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    records = table(spark, folder, "documents").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    out = shard_records(records, F.col("n_bytes") + 1, F.col("digest"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


_DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op4_exact_dedup", _DEDUP_SQL)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    groups = duplicate_groups(table(spark, folder, "documents"), keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUALITY_THRESHOLD = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, folder: str):
    """The quality classifier, learned from the labels outside the held-out fifth."""
    return fit_quality(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id"), 5, 0))


@query("op3_compression_classifier")
def compression_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A calibrated quality score of every document."""
    docs = table(spark, folder, "documents")
    score = quality_score(F.col("text"), quality_model(spark, docs, folder))
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int")
    )


@query("op7_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, and how much of each fits into 2048 tokens."""
    counts = counts_and_fit(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), counts.alias("c"))
        .select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > 2048).alias("over_limit"), "c.fitting_bytes")
    )


@query("op9_bpe_roundtrip")
def bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    digests = roundtrip_digests(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, folder, "documents").select("doc_id", digests.alias("d")).select("doc_id", "d.*")


@query("op5_string_tiling")
def string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item: a row for each pair."""
    return tile_coverage(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_parity_sketch_join")
def parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among all documents, and each one's links: four-word shingles, Jaccard similarity of 0.85 and more."""
    return near_copies(table(spark, folder, "documents"), 85, 100, 4, links=True).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op8_kneser_ney")
def kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under a bigram model of six sevenths of them."""
    docs, out = table(spark, folder, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 7, 2)
    model, scores = train_and_score(docs, ~out)
    return scores.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


@query("op6_language_spans")
def language_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, from labelled spans of it."""
    docs, out = table(spark, folder, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = fit_languages(docs, ~out)
    return docs.select("doc_id", out.alias("held_out"), language_of(F.col("text"), model).alias("l")).select(
        "doc_id", "held_out", "l.lang_pred", "l.score", F.size("l.spans").alias("n_spans"),
    )


#: The tools that the query below takes user turns for: name, parameter, type, required.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("translate", "query", "string", True), ("translate", "target", "string", True),
    ("summarize", "query", "string", True), ("summarize", "limit", "integer", False),
]

_TOOL_SQL = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, ['search', 'translate', 'summarize', 'browse'][length(text) % 4 + 1] AS name, text,
         to_json(text) AS q FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'
), lv AS (
  SELECT a.conv_id, a.call_id, a.turn, 0 AS level FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL SELECT a.conv_id, a.call_id, a.turn, lv.level + 1 FROM u a JOIN lv ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 2
), c AS (
  SELECT u.*, lv.level, r.text AS content,
    CASE name WHEN 'search' THEN '{"limit":' || length(u.text) || ',"query":' || q || '}'
      WHEN 'translate' THEN CASE WHEN u.turn >= 4 THEN '{"query":' || q || '}' ELSE '{"query":' || q || ',"target":"en"}' END
      WHEN 'summarize' THEN CASE WHEN u.turn >= 2 THEN '{"limit":"many","query":' || q || '}' ELSE '{"limit":5,"query":' || q || ',"style":"short"}' END
      ELSE '{"query":' || q || '}' END AS args,
    list_concat(CASE WHEN name = 'browse' THEN ['unknown tool'] WHEN name = 'translate' AND u.turn >= 4 THEN ['missing target']
      WHEN name = 'summarize' AND u.turn >= 2 THEN ['no integer: limit'] WHEN name = 'summarize' THEN ['unknown style'] ELSE [] END,
      list_concat(CASE WHEN r.conv_id IS NULL THEN ['no result'] ELSE [] END,
        CASE WHEN u.turn >= 2 AND level = 0 THEN ['needs unknown c' || (u.turn - 2)] ELSE [] END)) AS errors
  FROM u JOIN lv USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
)
SELECT conv_id, call_id, turn AS position, name, CAST(level AS INTEGER) AS level, CAST(len(errors) AS INTEGER) AS n_errors,
  '{"arguments":' || args || ',"call_id":"' || call_id || '","errors":' || to_json(errors) || ',"level":' || level || ',"name":"' || name
  || '","result":' || coalesce(to_json(content), 'null') || '}' AS json FROM c
UNION ALL
SELECT conv_id, call_id, turn, NULL, NULL, 1, '{"arguments":null,"call_id":"' || call_id || '","errors":["no call"],"level":null,"name":null,"result":' || to_json(text) || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = r.conv_id AND u.call_id = r.call_id)
"""


@query("op10_tool_call_linking", _TOOL_SQL)
def tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn taken as a tool call that needs the one before it, every assistant turn as the result of the turn before."""
    turns = table(spark, folder, "conversations")
    text, turn = F.col("text"), F.col("turn")
    name = F.element_at(F.array(*map(F.lit, ("search", "translate", "summarize", "browse"))), F.length(text) % 4 + 1)
    plain = F.to_json(F.struct(text.alias("query")))
    arguments = (
        F.when(name == "search", F.to_json(F.struct(text.alias("query"), F.length(text).alias("limit"))))
        .when((name == "translate") & (turn < 4), F.to_json(F.struct(text.alias("query"), F.lit("en").alias("target"))))
        .when((name == "summarize") & (turn >= 2), F.to_json(F.struct(text.alias("query"), F.lit("many").alias("limit"))))
        .when(name == "summarize", F.to_json(F.struct(text.alias("query"), F.lit(5).alias("limit"), F.lit("short").alias("style"))))
        .otherwise(plain)
    )
    call = lambda t: F.concat(F.lit("c"), t.cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", call(turn).alias("call_id"), turn.alias("position"), name.alias("name"), arguments.alias("arguments"),
        F.when(turn >= 2, F.array(call(turn - 2))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), turn.alias("position"), text.alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return link_tool_calls(calls, results, schemas)


#: Host, path and verdict of the rules of the query below.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

_URL_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES %s), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages
), h AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), f AS (SELECT n, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS place
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.n = f.n AND place = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op12_url_intervals", _URL_SQL)
def url_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, and the longest rule that fits them."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op13_exact_whitening")
def exact_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in their first eight whitened components. A deviation beyond a long is null."""
    rows = whitened_components(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t
), steps AS (  -- of crc32: each character, then eight shifts
  SELECT conv_id, list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS l FROM ids
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(l, lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 6 AS h FROM steps
), rebuilt AS (
  SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = c.base AND t.p < c.h UNION ALL SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h
), s AS (SELECT conv_id, coalesce(list({'r': r, 'x': x} ORDER BY p) FILTER (p IS NOT NULL), []) AS s FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), pre AS (SELECT conv_id, d, s[1:d] AS path, len(s) = d AS ending FROM s, unnest(range(0, len(s) + 1)) AS u(d)
), n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM pre GROUP BY path, d
), k AS (
  SELECT n.*, up.conv_id AS parent_conv_id, coalesce(length(n.path[n.d].x), 0) AS points FROM n LEFT JOIN n AS up ON up.d = n.d - 1 AND up.path = CASE WHEN n.d > 0 THEN n.path[1:n.d - 1] END
), kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1
), f AS (SELECT k.*, coalesce(kids.n, 0) AS n_children FROM k LEFT JOIN kids ON kids.path = k.path
), below AS (
  SELECT path[1:e] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * points) AS saved FROM f, unnest(range(0, d + 1)) AS u(e) GROUP BY 1
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN below ON below.path = f.path
"""


@query("op11_conversation_trie", _TRIE_SQL)
def trie(spark: SparkSession, folder: str) -> DataFrame:
    """All beginnings of the conversations, each of which takes the first turns of the first one of its hundred."""
    return conversation_trie(table(spark, folder, "conversations"), with_shared_heads)
