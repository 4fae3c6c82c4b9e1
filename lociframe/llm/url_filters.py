"""Operator 9: temporal list join. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import durable, free_name, pick

#: A key on more than one capture in HOT_SHARE is hot; a capture has at most KEYS keys, so there are at most HOT_SHARE * KEYS such keys.
HOT_SHARE = 256
#: Keys that a capture looks up at most: the page, the host and parent domains. Domain names have 127 labels at most.
KEYS = 128
#: Parts that the captures of a hot key are dealt into at least, and captures of a part.
SALTS, SALTED = 64, 200_000
#: Actions of list entries; where a key has several on one date, the largest rank holds.
ACTIONS = ("remove", "allow", "block")

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", ""), F.lit(""))


def page_of(url: Column) -> Column:
    """Host and path without scheme, port, query, fragment and final slashes; null where there is no host."""
    return F.concat(host_of(url), F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", ""))


def domains_of(host: Column) -> Column:
    """The parent domains of a host with two labels at least, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (scope, value, action, listed_on) as intervals: key, action, valid_from, valid_to (exclusive, null: open).

    An entry holds from its date until the next entry for the same key; ``remove`` ends what held before. Several
    entries for a key on one date count as the strongest. Entries with a null or with an unknown scope or action
    are void. A key has at most one row a date, so the window below is bounded by the calendar.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).cast("int")
    per_date = (
        pick(entries, "scope", "value", "action", "listed_on")
        .where(F.col("scope").isin("page", "host", "domain") & F.col("action").isin(*ACTIONS) & F.col("value").isNotNull() & F.col("listed_on").isNotNull())
        .select(F.concat_ws(":", F.col("scope"), F.lower("value")).alias("key"), F.col("listed_on").cast("date").alias("valid_from"), rank.alias("rank"))
        .groupBy("key", "valid_from")
        .agg(F.max("rank").alias("rank"))
    )
    order = Window.partitionBy("key").orderBy("valid_from")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank"))
    return per_date.withColumn("valid_to", F.lead("valid_from").over(order)).select("key", action.alias("action"), "valid_from", "valid_to").where(F.col("action") != "remove")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Judge every capture by the entries in force on the day of its fetch.

    A capture is looked up as its page, then its host (as ``host`` and as ``domain``), then each parent domain, the
    most specific first; the first key with an entry in force decides. Returns id, host, fetched_on, verdict,
    rule_scope, rule_value, rule_from. Verdicts: ``block`` or ``allow`` by a rule, ``none`` where no rule holds,
    ``undated`` for a null date, ``invalid`` for a URL that is null or has no host. Every row of ``captures`` gives
    one row, repeated rows and null ids too; an empty list gives ``none`` everywhere.

    An as-of join: intervals and captures of a key lie in one order of dates, and each capture carries the last
    interval that began on or before its day; it decides if it has not ended. So a capture makes one row a key, however
    many dates the key has. Keys that many captures share are found by a partial count, and their captures are
    dealt over parts, SALTED captures each, to which their intervals, one a day at most, are copied.
    """
    rows = pick(captures, id_col, url, fetched).toDF("_id", "_url", "_on").select("_id", host_of(F.col("_url")).alias("host"), page_of(F.col("_url")).alias("_page"), F.col("_on").cast("date").alias("_on"), F.monotonically_increasing_id().alias("_row"))
    rows = durable(rows, "captures")
    keys = F.concat(
        F.array(F.concat(F.lit("page:"), F.lower("_page")), F.concat(F.lit("host:"), F.col("host")), F.concat(F.lit("domain:"), F.col("host"))),
        F.transform(domains_of(F.col("host")), lambda d: F.concat(F.lit("domain:"), d)),
    )
    looked = rows.where(F.col("host").isNotNull() & F.col("_on").isNotNull()).select("_row", "_on", F.posexplode(keys).alias("_order", "key"))
    total = rows.count()
    hot = looked.groupBy("key").count().where(F.col("count") * HOT_SHARE > F.lit(max(total, 4 * HOT_SHARE)))
    hot = hot.select("key", F.greatest(F.lit(SALTS), F.ceil(F.col("count") / SALTED)).cast("int").alias("_parts"))
    hot = F.broadcast(durable(hot, "hot-keys"))  # HOT_SHARE * KEYS rows at most
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    asked = looked.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("_row"), parts).cast("int").alias("_salt"), F.col("_on").alias("_at"), F.lit(1).alias("_kind"), "_row", "_order", F.lit(None).cast("struct<action:string,valid_from:date,valid_to:date>").alias("_entry"))
    listed = validity_intervals(entries).join(hot, "key", "left")
    listed = listed.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_row"), F.lit(None).cast("int").alias("_order"), F.struct("action", "valid_from", "valid_to").alias("_entry"))
    so_far = Window.partitionBy("key", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (
        asked.unionByName(listed)
        .withColumn("_held", F.last("_entry", ignorenulls=True).over(so_far))
        .where("_kind = 1 AND _held IS NOT NULL AND (_held.valid_to IS NULL OR _at < _held.valid_to)")
        .groupBy("_row")
        .agg(F.min(F.struct("_order", "key", F.col("_held.action").alias("action"), F.col("_held.valid_from").alias("valid_from"))).alias("_best"))
    )
    verdict = F.when(F.col("host").isNull(), "invalid").when(F.col("_on").isNull(), "undated").otherwise(F.coalesce(F.col("_best.action"), F.lit("none")))
    return rows.join(met, "_row", "left").select(
        F.col("_id").alias(id_col),
        "host",
        F.col("_on").alias("fetched_on"),
        verdict.alias("verdict"),
        F.substring_index("_best.key", ":", 1).alias("rule_scope"),
        F.expr("substring(_best.key, instr(_best.key, ':') + 1)").alias("rule_value"),
        F.col("_best.valid_from").alias("rule_from"),
    )


#: First and number of the days over which the dates below are spread.
FIRST_DAY, DAYS = "2021-01-01", 1461


def _draw(text: Column, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int") % modulus


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over what ``pages`` holds: five entries a host, three a registered domain, one a page.

    The tables have no list. Dates and actions are drawn from the digest of scope, value and entry number.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), page_of(F.col("url")).alias("page")).where("host IS NOT NULL")
    of = [
        seen.select(F.lit("host").alias("scope"), F.col("host").alias("value"), F.lit(5).alias("n")),
        seen.select(F.lit("domain").alias("scope"), F.substring_index("host", ".", -2).alias("value"), F.lit(3).alias("n")),
        seen.select(F.lit("page").alias("scope"), F.col("page").alias("value"), F.lit(1).alias("n")),
    ]
    values = of[0].union(of[1]).union(of[2]).distinct()
    each = values.select("scope", "value", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    seed = F.concat_ws("|", "scope", "value", F.col("k").cast("string"))
    return each.select(
        "scope",
        "value",
        F.element_at(F.array(*map(F.lit, ACTIONS)), _draw(F.concat(F.lit("action|"), seed), 3) + 1).alias("action"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), _draw(F.concat(F.lit("date|"), seed), DAYS)).alias("listed_on"),
    )


def op9_temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    return filter_captures(pages.withColumn(free_name(pages, "fetched_on"), fetched), dated_list(pages))


_SQL_HOST = rf"nullif(regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '\.$', ''), '')"
ORACLE_SQL = rf"""
WITH cap AS (
  SELECT page_id, {_SQL_HOST} AS host,
         {_SQL_HOST} || regexp_replace(regexp_extract(url, '{_URL}', 2), '/+$', '') AS page,
         CAST(DATE '{FIRST_DAY}' + CAST(((page_id % {DAYS}) + {DAYS}) % {DAYS} AS INTEGER) AS DATE) AS fetched_on,
         row_number() OVER () AS rid
  FROM pages),
vals AS (
  SELECT DISTINCT 'host' AS scope, host AS value, 5 AS n FROM cap WHERE host IS NOT NULL
  UNION SELECT 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 3 FROM cap WHERE host IS NOT NULL
  UNION SELECT 'page', page, 1 FROM cap WHERE host IS NOT NULL),
each AS (SELECT scope, value, scope || '|' || value || '|' || k AS seed FROM vals, range(1, 6) r(k) WHERE k <= n),
ent AS (
  SELECT scope || ':' || lower(value) AS key,
         CAST(('0x' || substr(md5('action|' || seed), 1, 6)) AS BIGINT) % 3 AS rank,
         CAST(DATE '{FIRST_DAY}' + CAST(CAST(('0x' || substr(md5('date|' || seed), 1, 6)) AS BIGINT) % {DAYS} AS INTEGER) AS DATE) AS d
  FROM each),
per AS (SELECT key, d, max(rank) AS rank FROM ent GROUP BY key, d),
iv AS (SELECT key, rank, d, lead(d) OVER (PARTITION BY key ORDER BY d) AS until FROM per),
looked AS (
  SELECT rid, fetched_on, 'page:' || lower(page) AS key, 0 AS o FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT rid, fetched_on, 'host:' || host, 1 FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT rid, fetched_on, 'domain:' || host, 2 FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT rid, fetched_on, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), 1 + i
            FROM cap, range(2, 128) r(i) WHERE host IS NOT NULL AND i <= len(string_split(host, '.')) - 1),
met AS (
  SELECT l.rid, iv.key, iv.rank, iv.d, row_number() OVER (PARTITION BY l.rid ORDER BY l.o) AS rn
  FROM looked l JOIN iv ON l.key = iv.key AND l.fetched_on >= iv.d AND (iv.until IS NULL OR l.fetched_on < iv.until) AND iv.rank > 0)
SELECT c.page_id, c.host, c.fetched_on,
       CASE WHEN c.host IS NULL THEN 'invalid' WHEN c.fetched_on IS NULL THEN 'undated' WHEN m.rank = 2 THEN 'block' WHEN m.rank = 1 THEN 'allow' ELSE 'none' END AS verdict,
       split_part(m.key, ':', 1) AS rule_scope, substr(m.key, instr(m.key, ':') + 1) AS rule_value, m.d AS rule_from
FROM cap c LEFT JOIN met m ON c.rid = m.rid AND m.rn = 1
"""
