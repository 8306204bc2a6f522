"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

All expressions are Spark's own. The filter is a table of blocks of eight 32-bit lanes (packed into
four longs); a key sets one bit in each lane of its one block. It never has more than `max_blocks`
blocks, so broadcasting it is bounded whatever the list's length; a longer list only lets more
URLs through to the exact hash join, which removes all false positives.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is never
listed (verdict allow); repeated rows are judged each; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import stored

#: (host, path, verdict); a rule fits the host and its subdomains where the path begins with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host labels of sites whose pages make up the list of the query.
LISTED_LABELS = ["casino-win", "free-bets", "cheap-pills", "spam-farm"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18
LANES = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www. or m., default port, fragment, tracking fields and closing slash; fields are sorted. Empty for a url without host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/{2,}", "/"), r"/$", "")
    fields = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.sort_array(F.filter(fields, lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))), "&")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """Four longs, each with one bit set in its lower and one in its upper 32 bits."""
    h = F.xxhash64(F.lit("lane"), key)
    bit = lambda lane: F.shiftrightunsigned(h, 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    one = F.lit(1).cast("long")
    return [F.expr("0L").bitwiseOR(_shl(one, bit(2 * i))).bitwiseOR(_shl(one, bit(2 * i + 1) + 32)) for i in range(LANES // 2)]


def _shl(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def bloom_blocks(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of the distinct `canon` of listed: (block, w0..w3), and its number of blocks."""
    n = listed.count()
    n_blocks = max(1, min(max_blocks, -(-n * BITS_PER_KEY // (32 * LANES))))
    key = F.col("canon")
    rows = listed.select(_block(key, n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES // 2)]), n_blocks


def listed_flags(urls: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """urls (with a column canon) and `listed` boolean: whether canon is in listed (distinct canon)."""
    blocks, n_blocks = bloom_blocks(listed, max_blocks)
    key = F.col("canon")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(key)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probed = urls.withColumn("block", _block(key, n_blocks)).join(F.broadcast(blocks), "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False)) & (key != ""))
    columns = urls.columns
    out = probed.filter(~F.col("maybe")).select(*columns, F.lit(False).alias("listed"))
    exact = probed.filter("maybe").select(*columns).join(listed.select("canon", F.lit(True).alias("found")), "canon", "left")
    return out.unionByName(exact.select(*columns, F.coalesce("found", F.lit(False)).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages; listed: a table of urls that are blocked where no rule fits."""
    url = F.col("url").cast("string")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canon"))
    keys = stored(listed.select(canonical_url(F.col("url").cast("string")).alias("canon")).filter("canon <> ''").distinct())
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return listed_flags(urls, keys, max_blocks).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def example_list(pages: DataFrame) -> DataFrame:
    """A list of urls to block, as none is given: the pages of LISTED_LABELS' hosts whose number is even, written otherwise than in pages, and a page of each that isn't there.

    An entry has another scheme, a www. host in capitals with a port, doubled and closing slashes, its fields turned round between tracking fields, and a fragment.
    """
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    label = r"(^|\.)(" + "|".join(LISTED_LABELS) + r")(\.|$)"
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    turned = F.concat(F.lit("utm_medium=list&"), F.array_join(F.reverse(F.split(query, "&")), "&"), F.lit("&gclid=1"))
    name = F.concat(F.lit("FTP://www."), F.upper(F.regexp_replace(host, r"^(www|m)\.", "")), F.lit(":80/"))
    entries = F.array(F.concat(name, path, F.lit("/?"), turned, F.lit("#list")), F.concat(name, path, F.lit("/gone")))
    even = F.regexp_extract(path, r"([0-9])(\.html)?/?$", 1).isin("0", "2", "4", "6", "8")
    return pages.filter(host.rlike(label) & even).select(F.explode(entries).alias("url"))


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, example_list(pages))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), spam AS (
  SELECT *, regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query FROM (
    SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM p)
  WHERE regexp_matches(host, '(^|\.)(casino-win|free-bets|cheap-pills|spam-farm)(\.|$)') AND regexp_extract(path, '([0-9])(\.html)?/?$', 1) IN ('0', '2', '4', '6', '8')
), entries AS (
  SELECT 'FTP://www.' || upper(regexp_replace(host, '^(www|m)\.', '')) || ':80/' || path || '/?utm_medium=list&' || array_to_string(list_reverse(string_split(query, '&')), '&') || '&gclid=1#list' AS url FROM spam
  UNION ALL SELECT 'FTP://www.' || upper(regexp_replace(host, '^(www|m)\.', '')) || ':80/' || path || '/gone' FROM spam
), u AS (
  SELECT page_id, url, false AS entry FROM p UNION ALL SELECT NULL, url, true FROM entries
), s AS (
  SELECT page_id, entry,
         translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS fields
  FROM u
), c AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.([^.]+\.)', '\2') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS canon
  FROM s
), r AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    host <> '' AND canon IN (SELECT canon FROM c WHERE entry) AS listed
  FROM c WHERE NOT entry)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM r
"""
