"""Addresses, referrers, user agents and names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- addresses -------------------------------------------------------------------------------

_HTTP = r"^https?://"


def host(url: Column) -> Column:
    """Host name in lower case, '' for anything that is not an absolute address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def split_url(url: Column) -> dict[str, Column]:
    """path, origin, query and hash. Text that neither starts with '/' nor 'http' is a route name and kept whole."""
    url = F.coalesce(url, F.lit(""))
    absolute, local = url.rlike(_HTTP), url.startswith("/")
    rest = F.when(absolute, F.regexp_replace(url, r"^https?://[^/?#]*", "")).when(local, url)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return {
        "path": F.when(rest.isNull(), url).otherwise(F.when(path == "", F.lit("/")).otherwise(path)),
        "origin": F.when(absolute, F.lower(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1))).otherwise(F.lit("")),
        "query": F.when(rest.isNull(), F.lit("")).otherwise(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)),
        "hash": F.when(rest.isNull(), F.lit("")).otherwise(F.regexp_extract(rest, r"(#.+)$", 1)),
    }


def query_params(query: Column) -> Column:
    """Query text as a map of decoded values; the last of repeated keys counts. '+' reads as a space."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    entries = F.transform(pairs, lambda p: F.struct(decode(F.element_at(F.split(p, "=", 2), 1)).alias("k"),
                                                   decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v")))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                       lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))
    return last


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce((host(a) == host(b)) & (host(a) != ""), F.lit(False))


def strip_slashes(col: Column) -> Column:
    return F.regexp_replace(col, r"/+$", "")


def slug(col: Column) -> Column:
    """Lower-case words joined by '-'; diacritics folded, runs of '|' act as a separator, other signs dropped."""
    folded = F.translate(col, "åäöÅÄÖáàâãéèêëíìîïóòôõúùûüñçÁÀÂÃÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÜÑÇ", "aaoAAOaaaaeeeeiiiioooouuuuncAAAAEEEEIIIIOOOOUUUUNC")
    kept = F.regexp_replace(F.regexp_replace(folded, r"\|+", "-"), r"[^A-Za-z0-9\s-]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), r"^-+|-+$", ""))


# --- referrers -------------------------------------------------------------------------------

# A small default referrer table (host, name, type); a full one is an input.
REFERRERS = (
    ("google.com", "Google", "search"), ("bing.com", "Bing", "search"), ("duckduckgo.com", "DuckDuckGo", "search"), ("yahoo.com", "Yahoo!", "search"),
    ("baidu.com", "Baidu", "search"), ("ecosia.org", "Ecosia", "search"), ("twitter.com", "Twitter", "social"), ("x.com", "Twitter", "social"),
    ("t.co", "Twitter", "social"), ("facebook.com", "Facebook", "social"), ("instagram.com", "Instagram", "social"), ("linkedin.com", "LinkedIn", "social"),
    ("reddit.com", "Reddit", "social"), ("youtube.com", "YouTube", "social"), ("pinterest.com", "Pinterest", "social"), ("github.com", "GitHub", "tech"),
    ("news.ycombinator.com", "Hacker News", "social"), ("mail.google.com", "Gmail", "email"), ("outlook.live.com", "Outlook.com", "email"),
)


def referrer_table(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = REFERRERS) -> DataFrame:
    return spark.createDataFrame(list(rows), "host string, name string, type string")


def with_referrer(df: DataFrame, table: DataFrame, url: str = "referrer") -> DataFrame:
    """Add referrer_name and referrer_type by host, with or without www., and strip trailing slashes of the address. The table is
    matched by an equi-join without a hint; its size decides how."""
    known = table.groupBy("host").agg(F.min(F.struct("name", "type")).alias("_r"))
    www = table.select(F.concat(F.lit("www."), F.col("host")).alias("host"), F.struct("name", "type").alias("_r")).join(known.select("host"), "host", "left_anti")
    hosts = known.unionByName(www.groupBy("host").agg(F.min("_r").alias("_r")))
    out = df.withColumn("_host", host(F.col(url))).join(hosts.withColumnRenamed("host", "_host"), "_host", "left")
    return (out.withColumn("referrer_name", F.coalesce("_r.name", F.lit(""))).withColumn("referrer_type", F.coalesce("_r.type", F.lit("")))
            .withColumn(url, strip_slashes(F.coalesce(F.col(url), F.lit("")))).drop("_r", "_host"))


def with_campaign(df: DataFrame, table: DataFrame, params: str = "query_params") -> DataFrame:
    """Add campaign_name and campaign_type from utm_source, ref or utm_referrer, in that order: the value matches a host, a host
    without .com or a name. Unknown sources keep their own text; rows without one get nulls."""
    source = F.lower(F.coalesce(F.col(params)["utm_source"], F.col(params)["ref"], F.col(params)["utm_referrer"], F.lit("")))
    forms = table.select(F.explode(F.array(
        F.struct(F.col("host").alias("key"), F.lit(1).alias("rank")), F.struct(F.regexp_replace("host", r"\.com$", "").alias("key"), F.lit(2).alias("rank")),
        F.struct(F.lower("name").alias("key"), F.lit(3).alias("rank")))).alias("f"), "host", "name", "type").select("f.*", "host", "name", "type")
    keyed = forms.where((F.col("rank") != 2) | F.col("host").endswith(".com")).groupBy("key").agg(F.min(F.struct("rank", "host", "name", "type")).alias("_m"))
    out = df.withColumn("_source", source).join(keyed.withColumnRenamed("key", "_source"), "_source", "left")
    given = F.col("_source") != ""
    return (out.withColumn("campaign_name", F.when(given, F.coalesce("_m.name", "_source")))
            .withColumn("campaign_type", F.when(given, F.coalesce("_m.type", F.lit("")))).drop("_m", "_source"))


# --- crawlers --------------------------------------------------------------------------------

# Crawlers whose requests are not recorded.
CRAWLERS = ("Googlebot", "BingPreview", "GPTBot", "Screaming Frog")


def is_crawler(ua: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(ua).contains(c.lower()) for c in CRAWLERS]), F.lit(False))


def _any(lower: Column, patterns: Sequence[str]) -> Column:
    return lower.rlike("|".join(f"({p})" for p in patterns))


# --- event names -----------------------------------------------------------------------------

RESERVED = ("session_start", "session_end")
# Text that marks an event name as an attack or a scan.
BLOCKED = (
    "oastify.com", "burpcollaborator", "interact.sh", "oast.me", "pg_sleep", "waitfor delay", "xp_dirtree", "load_file(", "extractvalue(", "dbms_pipe.receive_message", "union select",
    "nslookup ", "/bin/sleep", "/bin/bash", "cmd.exe", "wget+http", "wget http", "chmod+777", "chmod 777", "processbuilder", "runtime.getruntime", "java.lang.processbuilder", "eval-stdin.php",
    "../", "..\\", "%2e%2e", "%u002e%u002e", "/etc/passwd", "/etc/shadow", "win.ini", "system.ini", "${", "%{", "<!doctype", "<!entity", "<xi:include", "xsi:schemalocation", "\r\n", "bcc:",
    "phpinfo.php", "wp-config.php", ".git/config", ".env.backup", ".env.bak", "/vendor/phpunit/", "mozi.m", "/setup.cgi?", "/cgi-bin/", "#<article:0x", "#<video:0x", "#<brand:0x",
    "exec master.dbo", "declare @", "' and '", "' or '", "') or ", "')and ",
)
SCANS = (r"^/[a-z_-]+\.(php|env|yml|yaml|json|xml|config|ini|bak|sql|log)", r"^/\.[a-z]", r"^/(wp-|wordpress)", r"^/phpmyadmin", r"^/.+\.php$")


def is_blocked_name(name: Column) -> Column:
    """Longer than 80 characters, with line breaks, or with text of an attack or path scan."""
    lower = F.lower(name)
    bad = F.exists(F.array(*[F.lit(b) for b in BLOCKED]), lambda b: lower.contains(b))
    return (F.length(name) > 80) | name.contains("\n") | name.contains("\r") | bad | _any(lower, SCANS)


def is_valid_track(name: Column, revenue: Column) -> Column:
    """Names that are set, not reserved and not blocked; ``revenue`` events need a whole, non-negative amount if they carry one. ``revenue``
    is the JSON text of the property."""
    amount = F.coalesce(revenue.rlike(r"^(0|[1-9][0-9]*)(\.0+)?$"), F.lit(True))
    return (name != "") & ~name.isin(*RESERVED) & ~is_blocked_name(name) & ((name != "revenue") | amount)
