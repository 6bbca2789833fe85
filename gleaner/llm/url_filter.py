"""Operator 13: judge addresses by override rules, then by a list of canonical addresses behind a blocked Bloom filter.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's; the longest rule wins
(then the longer host, then block). Rules are a short list and become one expression.

Addresses without a rule are asked of the list. Their keys are the canonical address and the hosts above it (a listed host
covers its site). A key has one block of the Bloom filter, a row of eight words with a bit of the key in each: a block
without all eight bits rules the key out. What passes is joined by hash with the listed keys themselves, so false positives
go. The filter is broadcast while it has at most ``BROADCAST_BYTES``; a larger one is joined by block number, and addresses
that share a key are split by the engine as in any skewed join. Only built-in functions run, and only the address is read.

Canonical: host in lower case without user, default port, leading ``www.`` and trailing dots; path without trailing slashes
and index page; parameters sorted, those of tracking left out; no scheme, no fragment.

Cases: a null address or one without ``://`` has an empty host and path, no rule, and is allowed; every row gets a row,
repeated ones too; empty tables give no rows; an empty list blocks nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the production query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The sites that the production query lists, under each of the domains.
LISTED_NAMES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]
#: Parameters that tell where a reader came from, not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Hosts above an address that are asked: its own, and those of at most so many last labels.
HOST_LABELS = 5
WORDS, KEYS_PER_BLOCK = 8, 24
BROADCAST_BYTES = 64 << 20


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of an address; empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.substr(text, F.locate("://", text) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> tuple[Column, Column]:
    """The canonical host and address; both empty where there is no host."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"\.+$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    address = F.concat(site, F.regexp_replace(path, r"/+(index\.(html?|php))?/*$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return site, F.when(site == "", F.lit("")).otherwise(address)


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for h, p, verdict in best]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule: string, verdict: string>"))


def keys(site: Column, address: Column) -> Column:
    """What of an address may be listed: itself, its host, and hosts above it of two labels or more."""
    labels = F.split(site, r"\.")
    above = F.transform(F.filter(F.sequence(F.lit(2), F.lit(HOST_LABELS)), lambda k: k < F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return F.array_distinct(F.concat(F.array(address, site), above))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> Column:
    """A bit in each word, by six bits each of a second hash."""
    own = F.xxhash64(F.lit(1), key)
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(own, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)])


def bloom(listed: DataFrame, n: int, per_block: int = KEYS_PER_BLOCK) -> tuple[DataFrame, int]:
    """(block, words) for ``listed`` (key), and how many blocks there are."""
    blocks = max(1, -(-n // per_block))
    each = listed.select(block_of(F.col("key"), blocks).alias("block"), bits_of(F.col("key")).alias("bits"))
    words = F.array(*[F.bit_or(F.col("bits")[i]) for i in range(WORDS)])
    return each.groupBy("block").agg(words.alias("words")), blocks


def possible(asked: DataFrame, listed: DataFrame, n: int, per_block: int = KEYS_PER_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``asked`` (with a ``key``) that the filter doesn't rule out."""
    table, blocks = bloom(listed, n, per_block)
    table = F.broadcast(table) if blocks * 8 * (WORDS + 4) <= broadcast_bytes else table
    bits = bits_of(F.col("key"))
    has = F.forall(F.zip_with("words", bits, lambda w, b: w.bitwiseAND(b) == b), lambda x: x)
    return asked.withColumn("block", block_of(F.col("key"), blocks)).join(table, "block").where(has).drop("block", "words")


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with the columns worked out once: filters on them aren't moved below, where they would be worked out again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, per_block: int = KEYS_PER_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``listed`` has addresses (url) of any number."""
    host, path, query = parts(F.col("url"))
    base = once(pages, ["page_id"], host=host, path=path, query=query)
    site, address = canonical(F.col("host"), F.col("path"), F.col("query"))
    base = once(base, ["page_id", "host", "path"], found=rule_of(rules, F.col("host"), F.col("path")), site=site, address=address)
    entries = listed.select(canonical(*parts(F.col("url")))[1].alias("key")).where("key <> ''").distinct()
    entries = checkpointed(entries)
    n = entries.count()
    decided = F.col("found").isNotNull() | (F.col("site") == "")
    out = base.where(decided).select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))
    open_ = base.where(~decided).select("page_id", "host", "path", "site", "address")
    asked = open_.select("address", F.explode(keys(F.col("site"), F.col("address"))).alias("key"))
    hits = possible(asked, entries, n, per_block, broadcast_bytes).join(entries, "key").select("address").distinct().withColumn("listed", F.lit(True))
    met = open_.join(hits, "address", "left")
    return out.unionByName(met.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")))


def listed_sites(spark: SparkSession) -> DataFrame:
    sites = F.flatten(F.transform(F.array(*map(F.lit, LISTED_NAMES)), lambda name: F.transform(F.array(*map(F.lit, LISTED_DOMAINS)), lambda domain: F.concat(F.lit("http://"), name, F.lit("."), domain, F.lit("/")))))
    return spark.range(1).select(F.explode(sites).alias("url"))


def oracle() -> str:
    """The same rows in SQL: rules by a table of them, listed sites by their hosts."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    sites = ", ".join(f"('{n}.{d}')" for n in LISTED_NAMES for d in LISTED_DOMAINS)
    return f"""
WITH r(h, p, v) AS (VALUES {rules}), l(site) AS (VALUES {sites}),
a AS (SELECT row_number() OVER () AS rn, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT rn, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS v FROM b JOIN r ON ('.' || b.host) LIKE '%.' || r.h AND starts_with(b.path, r.p) GROUP BY rn),
s AS (SELECT DISTINCT rn FROM b JOIN l ON ('.' || b.host) LIKE '%.' || l.site)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, CASE WHEN s.rn IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM b LEFT JOIN m USING (rn) LEFT JOIN s USING (rn)"""
