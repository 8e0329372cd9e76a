"""Addresses, requests, robots rules and well-known texts as column expressions."""

from __future__ import annotations

import ipaddress
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lakeprobe.functions.json_ops import is_json
from lakeprobe.functions import urls

#: Blocks of IPv4 addresses that are not global, as first and last number, in the order they are told.
BLOCKS = (
    ("loopback", 2130706432, 2147483647), ("private", 0, 16777215), ("private", 167772160, 184549375), ("private", 2886729728, 2887778303), ("private", 3232235520, 3232301055),
    ("private", 3221225472, 3221225727), ("private", 3221225984, 3221226239), ("private", 3323068416, 3323199487), ("private", 3325256704, 3325256959), ("private", 3405803776, 3405804031),
    ("private", 4026531840, 4294967295), ("link_local", 2851995648, 2852061183), ("shared", 1681915904, 1686110207), ("multicast", 3758096384, 4026531839),
)


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a number, or null."""
    octets = F.split(c, r"\.")
    parts = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    good = c.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(good, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def ip4_class(c: Column) -> Column:
    """global, the block an IPv4 address lies in, or invalid; with built-in functions."""
    n, out = ipv4_number(c), F.lit("global")
    for name, low, high in reversed(BLOCKS):
        out = F.when(n.between(low, high), name).otherwise(out)
    return F.when(n.isNull(), "invalid").otherwise(out)


def _classes(addresses: pd.Series) -> pd.Series:
    def one(text: str | None) -> str:
        try:
            a = ipaddress.ip_address((text or "").split("%", 1)[0])
        except ValueError:
            return "invalid"
        inner = [x for x in (getattr(a, "ipv4_mapped", None), getattr(a, "sixtofour", None)) if x is not None]
        for x in (a, *inner):
            for name in ("loopback", "private", "link_local", "multicast", "reserved", "unspecified"):
                if getattr(x, f"is_{name}"):
                    return name
            if not x.is_global:
                return "shared"
        return "global"

    return addresses.map(one)


def ip_class(c: Column) -> Column:
    """The class of an address: IPv4 by ip4_class(); IPv6 (with what it wraps, and without its zone) by the standard library, in batches, where there are any."""
    return F.when(c.contains(":"), F.pandas_udf(_classes, StringType())(c)).otherwise(ip4_class(c))


def curl(c: Column) -> dict[str, Column]:
    """Method, address, header names and body of a curl command."""
    arg = lambda flags: F.regexp_extract(c, rf"\s(?:{flags})\s+(?:'([^']*)'|\"([^\"]*)\"|(\S+))", 0)
    value = lambda flags: F.regexp_replace(arg(flags), rf"^\s(?:{flags})\s+['\"]?|['\"]$", "")
    body = value("-d|--data|--data-raw|--data-binary")
    method = F.upper(value("-X|--request"))
    lines = F.regexp_extract_all(c, F.lit(r"(?:-H|--header)\s+(?:'([^']*)'|\"([^\"]*)\")"), 0)
    pairs = F.transform(lines, lambda h: F.regexp_replace(h, r"^(?:-H|--header)\s+['\"]|['\"]$", ""))
    headers = F.transform(pairs, lambda h: F.lower(F.trim(F.split_part(h, F.lit(":"), F.lit(1)))))
    values = F.transform(pairs, lambda h: F.struct(F.trim(F.split_part(h, F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_replace(h, "^[^:]*:", "")).alias("value")))
    return {
        "method": F.when(method != "", method).when(body != "", "POST").otherwise("GET"), "url": F.regexp_extract(c, r"['\"]?(https?://[^'\"\s]+)", 1),
        "headers": F.array_sort(headers), "body": body, "header_values": values,
    }


def input_kind(c: Column) -> Column:
    """curl, url, json, html or unknown: what somebody has pasted."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(t.rlike(r"^curl([ \t]|$)"), "curl").when(t.rlike(r"(?i)^https?://\S+$"), "url").when(t.rlike(r"^[\[{]") & is_json(t), "json")
        .when(t.rlike(r"(?i)<!doctype html|<html|<body|<div|<table|<ul|<a\s|<p[\s>]"), "html").otherwise("unknown")
    )


def charset(content_type: Column, body: Column) -> Column:
    """The charset that a header names, else the one that the head of the page declares, else utf-8."""
    named = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1)
    declared = F.regexp_extract(F.substring(body, 1, 2048), r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)
    return F.lower(F.coalesce(F.nullif(named, F.lit("")), F.nullif(declared, F.lit("")), F.lit("utf-8")))


def source_kind(content_type: Column, body: Column) -> Column:
    """html, jsonl, json, xml, csv, binary, text or unknown: the body says more than the header."""
    sample = F.substring(F.coalesce(body, F.lit("")), 1, 4096)
    low, start = F.lower(F.regexp_replace(sample, r"^\s+", "")), F.regexp_replace(sample, r"^\s+", "")
    lines = F.slice(F.filter(F.split(sample, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 5)
    jsonl = (F.size(lines) >= 2) & F.forall(lines, is_json)
    even = lambda d: F.size(F.array_distinct(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))))) == 1
    csv = F.lit(False)
    for d in (",", ";", "\t"):
        csv = csv | (even(d) & F.get(lines, F.lit(0)).contains(d))
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    by_header = F.when(ct.contains("ld+json") | ct.contains("html"), "html").when(ct.contains("json"), "json").when(ct.contains("xml"), "xml").when(ct.contains("csv"), "csv").when(ct.startswith("text/"), "text")
    return (
        F.when(ct.rlike("^(image/|audio/|video/|font/|application/(octet-stream|pdf|zip))"), "binary")
        .when(low.rlike("^(<!doctype html|<html)") | F.substring(low, 1, 200).contains("<html"), "html").when(jsonl, "jsonl").when(start.rlike(r"^[\[{]"), "json").when(start.startswith("<?xml"), "xml")
        .when(start.startswith("<"), F.when(low.rlike("^<(html|!doctype|div|body|head)"), "html").otherwise("xml")).when((F.size(lines) >= 2) & csv, "csv")
        .when(by_header.isNotNull(), by_header).when(start != "", "text").otherwise("unknown")
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """Rows (host, prefix, allow) of the robots.txt files (host, text): the rules for all agents. A file is small, and read as lines."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    start = F.struct(F.lit(False).alias("mine"), F.lit(False).alias("rules"), F.array().cast("array<struct<prefix:string,allow:boolean>>").alias("out"))

    def turn(acc: Column, p: Column) -> Column:
        # agents that follow one another form a group; rules end it
        agent, rule = p["k"] == "user-agent", p["k"].isin("allow", "disallow")
        mine = F.when(agent, (p["v"] == "*") | (acc["mine"] & ~acc["rules"])).otherwise(acc["mine"])
        more = F.array(F.struct(p["v"].alias("prefix"), (p["k"] == "allow").alias("allow")))
        return F.struct(mine.alias("mine"), F.when(agent, False).otherwise(acc["rules"] | rule).alias("rules"), F.when(rule & acc["mine"] & (p["v"] != ""), F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    return files.select("host", F.explode(F.aggregate(pairs, start, turn, lambda acc: acc["out"])).alias("r")).select("host", "r.*")


def _inflated(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
    def one(body: bytes | None, encoding: str | None) -> bytes | None:
        kind = (encoding or "").strip().lower()
        if body is None or kind not in ("gzip", "x-gzip", "deflate"):
            return body
        for bits in (31,) if "gzip" in kind else (15, -15):
            try:
                return zlib.decompress(body, bits)
            except zlib.error:
                continue
        return body

    return pd.Series([one(b, e) for b, e in zip(bodies, encodings, strict=True)])


def inflated(body: Column, encoding: Column) -> Column:
    """A body without its gzip or deflate encoding (raw deflate too); as it is where it cannot be read so."""
    return F.pandas_udf(_inflated, BinaryType())(body, encoding)


def to_curl(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """A curl command for a request (headers: a map), with secrets as placeholders."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    lines = F.transform(F.array_sort(F.map_entries(urls.mask_headers(headers))), lambda e: F.concat(F.lit(" -H "), quoted(F.concat(e["key"], F.lit(": "), F.replace(e["value"], F.lit("***"), F.concat(F.lit("$"), F.upper(F.regexp_replace(e["key"], "[^A-Za-z0-9]+", "_")))))))  )
    data = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(" --data-raw "), quoted(body))).otherwise("")
    return F.concat(F.lit("curl -X "), F.upper(method), F.lit(" "), quoted(urls.mask(url)), F.array_join(lines, ""), data)


def _literal(c: Column) -> Column:
    """A text as a JSON string, which is a Python string too."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")


def to_python(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """A Python script for a request (headers: a map): secrets are read from the environment, under the names that a curl command has as placeholders."""
    secret = F.map_filter(headers, lambda k, v: F.lower(k).isin(*urls.SECRET_HEADERS))
    variable = lambda k: F.upper(F.regexp_replace(k, "[^A-Za-z0-9]+", "_"))
    value = lambda e: F.when(F.map_contains_key(secret, e["key"]), F.concat(F.lit("os.environ["), _literal(variable(e["key"])), F.lit("]"))).otherwise(_literal(e["value"]))
    items = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(_literal(e["key"]), F.lit(": "), value(e)))
    data = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(", data="), _literal(body), F.lit(".encode()"))).otherwise("")
    call = F.concat(F.lit("answer = requests.request("), _literal(F.upper(method)), F.lit(", "), _literal(urls.mask(url)), F.lit(", headers={"), F.array_join(items, ", "), F.lit("}"), data, F.lit(", timeout=15)"))
    return F.concat_ws("\n", F.lit("import os"), F.lit(""), F.lit("import requests"), F.lit(""), call, F.lit("answer.raise_for_status()"), F.lit("print(answer.text)"), F.lit(""))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path) with `allowed`: the longest rule (host, prefix, allow) that the path begins with decides; without one it is allowed."""
    hit = pages.join(rules, "host").filter(F.startswith("path", F.col("prefix")))
    best = hit.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return pages.join(best, "page_id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


