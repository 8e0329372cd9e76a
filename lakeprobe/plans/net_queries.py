"""Address, request, robots, well-known and status queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import net, urls
from lakeprobe.operators import crawl
from lakeprobe.session import table


def k():
    return F.col("page_id")


def ips(spark: SparkSession, d: str) -> DataFrame:
    e, n = table(spark, d, "events"), F.col("event_id")
    first = F.element_at(F.lit([10, 127, 172, 192, 169, 8, 224, 300, 100, 0]), (n % 10 + 1).cast("int"))
    second = F.element_at(F.lit([0, 16, 168, 254, 64, 31]), (n % 6 + 1).cast("int"))
    return e.select("event_id", F.concat_ws(".", first.cast("string"), second.cast("string"), (n % 256).cast("string"), (n % 7).cast("string")).alias("ip"))


def curls(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(k() % 3 == 0, " -X put -H 'Accept: a' -H \"X-B: c\"").when(k() % 3 == 1, " --data 'q=1' -H 'B: x'").otherwise("")
    parts = net.curl(F.concat(F.lit("curl '"), F.col("url"), F.lit("'"), tail))
    return table(spark, d, "pages").select("page_id", *[(F.array_join(c, ",") if n == "headers" else c).alias(n) for n, c in parts.items() if n != "header_values"])


def robots(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", urls.bare_host(F.col("url")).alias("host"), urls.part(F.col("url"), urls.PATH).alias("path"))
    hosts = pages.select("host").distinct()
    rules = hosts.select("host", F.explode(F.array(
        F.struct(F.lit("/en/").alias("prefix"), (F.length("host") % 2 == 0).alias("allow")), F.struct(F.lit("/").alias("prefix"), (F.length("host") % 3 > 0).alias("allow")),
        F.struct(F.lit("/en/4").alias("prefix"), F.lit(True).alias("allow")),
    )).alias("r")).select("host", "r.*")
    return net.allowed(pages, rules).select("page_id", "allowed")


def statuses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(k() % 11 == 0, 404).when(k() % 7 == 0, 301).when(k() % 13 == 0, 500).otherwise(200)
    error = F.when(k() % 17 == 0, "timeout")
    return crawl.statuses(table(spark, d, "pages").select(status.alias("status"), (k() % 7 == 0).alias("redirected"), error.alias("error")))


#: A robots.txt that every second host has.
ROBOTS = "# rules\nUser-agent: other\nDisallow: /\nUser-agent: *\nAllow: /en/4\nDisallow: /en/ # all\nDisallow:\nDisallow: /de\nUser-agent: last\nDisallow: /fr\n"


def parsed_robots(spark: SparkSession, d: str) -> DataFrame:
    """Which pages the robots.txt of their host allows."""
    pages = table(spark, d, "pages").select("page_id", urls.bare_host(F.col("url")).alias("host"), urls.part(F.col("url"), urls.PATH).alias("path"))
    files = pages.select("host").distinct().filter(F.length("host") % 2 == 0).withColumn("text", F.lit(ROBOTS))
    return net.allowed(pages, net.robots_rules(files)).select("page_id", "allowed")


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of both kinds, by turns."""
    kinds = ["::1", "fe80::1%eth0", "2001:4860:4860::8888", "::ffff:10.0.0.1", "2002:7f00:0001::", "ff02::1", "fd00::1", "192.0.2.7", "198.18.5.5", "8.8.8.8", "zzz::"]
    return table(spark, d, "events").select("event_id", net.ip_class(F.get(F.lit(kinds), (F.col("event_id") % len(kinds)).cast("int"))).alias("kind"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests as curl commands, with their secrets hidden."""
    headers = F.create_map(F.lit("Accept"), F.lit("a/b"), F.lit("X-Api-Key"), F.lit("secret"))
    url = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/a?token=t&x="), k().cast("string"))
    return table(spark, d, "pages").select("page_id", net.to_curl(F.when(k() % 2 == 0, "post").otherwise("get"), url, headers, F.when(k() % 2 == 0, "it's")).alias("command"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as Python scripts."""
    headers = F.create_map(F.lit("Accept"), F.lit("a/b"), F.lit("X-Api-Key"), F.lit("secret"))
    url = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/a?token=t&x="), k().cast("string"))
    return table(spark, d, "pages").select("page_id", net.to_python(F.when(k() % 2 == 0, "post").otherwise("get"), url, headers, F.when(k() % 2 == 0, 'say "it"')).alias("script"))


def favorites(spark: SparkSession, d: str) -> DataFrame:
    """Lists of part ids as text, with the ids that do not exist."""
    lists = table(spark, d, "customer").select(F.col("c_custkey").alias("list"), F.concat_ws(",", F.col("c_custkey") * 3, F.col("c_custkey") * 2 + 1, F.lit("9999999")).alias("ids"))
    wanted = lists.select("list", F.explode(F.split("ids", ",")).alias("id")).select("list", F.col("id").cast("long").alias("id"))
    return wanted.join(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "left_anti").select("list", "id")


QUERIES = {
    "ip_classify": lambda s, d: ips(s, d).select("event_id", net.ip_class(F.col("ip")).alias("kind")),
    "parse_curl": curls,
    "robots_allowed": robots,
    "robots_parsed": parsed_robots,
    "ip_classify_all": addresses,
    "request_to_curl": requests,
    "request_to_python": scripts,
    "crawl_status_histogram": statuses,
    "favorites_missing": favorites,
}
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"
ORACLES = {
    "ip_classify": """WITH i AS (SELECT event_id, [10, 127, 172, 192, 169, 8, 224, 300, 100, 0][event_id % 10 + 1] AS a, [0, 16, 168, 254, 64, 31][event_id % 6 + 1] AS b, event_id % 256 AS c, event_id % 7 AS d FROM events)
        SELECT event_id, CASE WHEN a = 300 THEN 'invalid' WHEN a = 127 THEN 'loopback' WHEN a = 0 OR a = 10 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 192 AND b = 0 AND c IN (0, 2) OR a >= 240 THEN 'private'
          WHEN a = 169 AND b = 254 THEN 'link_local' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'shared' WHEN a BETWEEN 224 AND 239 THEN 'multicast' ELSE 'global' END AS kind FROM i""",
    "parse_curl": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'PUT' WHEN 1 THEN 'POST' ELSE 'GET' END AS method, url, CASE page_id % 3 WHEN 0 THEN 'accept,x-b' WHEN 1 THEN 'b' ELSE '' END AS headers, CASE page_id % 3 WHEN 1 THEN 'q=1' ELSE '' END AS body FROM pages""",
    "robots_allowed": f"""WITH p AS (SELECT page_id, length({HOST}) AS n, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, CASE WHEN starts_with(path, '/en/4') THEN true WHEN starts_with(path, '/en/') THEN n % 2 = 0 WHEN starts_with(path, '/') THEN n % 3 > 0 ELSE true END AS allowed FROM p""",
    "robots_parsed": f"""WITH p AS (SELECT page_id, length({HOST}) AS n, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, CASE WHEN n % 2 = 1 OR starts_with(path, '/en/4') THEN true WHEN starts_with(path, '/en/') OR starts_with(path, '/de') THEN false ELSE true END AS allowed FROM p""",
    "ip_classify_all": "SELECT event_id, ['loopback', 'private', 'global', 'private', 'private', 'multicast', 'private', 'private', 'private', 'global', 'invalid'][event_id % 11 + 1] AS kind FROM events",
    "request_to_curl": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'curl -X POST ' ELSE 'curl -X GET ' END || chr(39) || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a?token=***&x=' || page_id || chr(39) || ' -H ' || chr(39) || 'Accept: a/b' || chr(39) || ' -H ' || chr(39) || 'X-Api-Key: $X_API_KEY' || chr(39) ||
          CASE WHEN page_id % 2 = 0 THEN ' --data-raw ' || chr(39) || 'it' || chr(39) || chr(92) || chr(39) || chr(39) || 's' || chr(39) ELSE '' END AS command FROM pages""",
    "request_to_python": r"""SELECT page_id, 'import os' || chr(10) || chr(10) || 'import requests' || chr(10) || chr(10) || 'answer = requests.request(' || CASE WHEN page_id % 2 = 0 THEN '"POST", "' ELSE '"GET", "' END || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a?token=***&x=' || page_id
          || '", headers={"Accept": "a/b", "X-Api-Key": os.environ["X_API_KEY"]}' || CASE WHEN page_id % 2 = 0 THEN ', data="say \"it\"".encode()' ELSE '' END || ', timeout=15)' || chr(10) || 'answer.raise_for_status()' || chr(10) || 'print(answer.text)' || chr(10) AS script FROM pages""",
    "crawl_status_histogram": """WITH s AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 7 = 0 THEN 301 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS status FROM pages)
        SELECT status, count(*) AS pages, count(*) FILTER (status >= 400) AS broken, count(*) FILTER (page_id % 7 = 0) AS redirects, count(*) FILTER (page_id % 17 = 0) AS errors FROM s GROUP BY 1""",
    "favorites_missing": """WITH w AS (SELECT c_custkey AS list, unnest([c_custkey * 3, c_custkey * 2 + 1, 9999999]) AS id FROM customer) SELECT list, id FROM w WHERE id NOT IN (SELECT p_partkey FROM part)""",
}
