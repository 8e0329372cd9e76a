"""URLs as column expressions: parts, normal forms, masking, scope and pagination."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME, USER, HOST, PORT, PATH, QUERY, FRAGMENT = range(1, 8)
#: A query key that holds one of these has its value hidden, and so has one of these headers.
SECRET = r"token|api[_-]?key|access[_-]?key|secret|password|passwd|pwd|sig|signature"
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "x-amz-security-token")
#: Parts of the names of job parameters that must not hold secrets.
SECRET_HINTS = ("authorization", "cookie", "api_key", "apikey", "api-key", "token", "password", "secret")
#: Paths under which interfaces are usually described.
WELL_KNOWN = (
    "/openapi.json", "/swagger.json", "/swagger/v1/swagger.json", "/api/openapi.json", "/api/schema", "/api/docs", "/docs/openapi.json", "/.well-known/openapi.json",
    "/graphql", "/api", "/api/v1", "/rest/api", "/sitemap.xml", "/feed", "/rss",
)
#: What the address of an interface contains, and endings of those that are none.
API_HINTS = ("/api/", "/rest/", "/graphql", "/v1/", "/v2/", ".json", "/rpc/", "/query")
NOT_API = (".js", ".css", ".png", ".jpg", ".jpeg", ".svg", ".webp", ".woff", ".woff2", ".ico")
#: JSON members that name the next page.
NEXT_KEYS = ("next", "next_url", "nextUrl", "next_page", "nextPage", "links.next", "meta.next")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def normalize(url: Column) -> Column:
    """Without fragment, scheme and host in lower case, the path at least a slash."""
    port = F.when(part(url, PORT) != "", F.concat(F.lit(":"), part(url, PORT))).otherwise("")
    path = F.when(part(url, PATH) == "", "/").otherwise(part(url, PATH))
    return F.concat(F.lower(part(url, SCHEME)), F.lit("://"), F.lower(part(url, HOST)), port, path, part(url, QUERY))


def port(url: Column) -> Column:
    """The port, by default that of the scheme."""
    own = part(url, PORT)
    return F.when(own != "", own.cast("int")).when(F.lower(part(url, SCHEME)) == "https", 443).when(F.lower(part(url, SCHEME)) == "http", 80)


def origin(url: Column) -> Column:
    return F.concat_ws("|", F.lower(part(url, SCHEME)), F.lower(part(url, HOST)), port(url).cast("string"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, HOST)), r"^www\.", "")


def mask(url: Column) -> Column:
    """User information and the values of secret query keys hidden; the rest as it was."""
    return F.regexp_replace(F.regexp_replace(url, r"://[^/?#]*@", "://***@"), rf"(?i)([?&][^=&#]*(?:{SECRET})[^=&#]*=)[^&#]*", "$1***")


def mask_headers(headers: Column) -> Column:
    """A header map with the values of secret headers hidden."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), "***").otherwise(v))


def secret_params(params: Column) -> Column:
    """The keys of a map that must not be kept with a job, for they name a secret."""
    return F.filter(F.map_keys(params), lambda k: F.lower(k).rlike("|".join(SECRET_HINTS)))


def _folded(segments: Column) -> Column:
    """A path's segments without dot segments: `..` takes the one before away, at the root nothing; a dot segment at the end leaves a folder."""
    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)))
    return F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def resolve(base: Column, href: Column) -> Column:
    """An address as seen from a page: absolute ones as they are, others from the scheme, the root, the query or the page's folder, without dot segments, however many there are."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"#.*$", "")
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.split(F.regexp_replace(F.regexp_extract(part(base, PATH), r"^(.*/)[^/]*$", 1), "/$", ""), "/")
    merged = F.concat(folder, F.split(path, "/"))
    # empty segments in the middle of a merged path go; a path from the root keeps them
    merged = F.filter(merged, lambda s, i: (s != "") | (i == 0) | (i == F.size(folder) + F.size(F.split(path, "/")) - 1))
    joined = F.array_join(_folded(F.when(href.startswith("/"), F.split(path, "/")).otherwise(merged)), "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), href)).when(href.startswith("#"), F.concat(bare, href)).when(href == "", base)
        .otherwise(F.concat(root, F.when(joined.startswith("/"), "").otherwise("/"), joined, rest))
    )


def is_api(url: Column) -> Column:
    """Whether an absolute address may be one of an interface: http or https, with a hint in it, not a file of a page, 4 to 300 characters."""
    hint = F.lit(False)
    for h in API_HINTS:
        hint = hint | url.contains(h)
    return hint & F.lower(url).rlike("^https?://") & ~F.lower(url).rlike("(" + "|".join(x.replace(".", r"\.") for x in NOT_API) + ")$") & F.length(url).between(4, 300)


def api_confidence(url: Column, source: Column) -> Column:
    """high where the page says so itself or a link's address does, medium for such an address in a script, else low."""
    plain = url.contains("/api/") | url.contains("/graphql") | url.endswith(".json")
    return F.when(source.isin("link_alternate_json", "json_ld"), "high").when(plain, F.when(source == "html", "high").otherwise("medium")).otherwise("low")


def in_scope(url: Column, root: Column, subdomains: bool = True) -> Column:
    """Whether a URL has the scheme, port and host of a root, or a subdomain of that host."""
    host, of = F.lower(part(url, HOST)), F.lower(part(root, HOST))
    same = host == of
    if subdomains:
        same = same | host.endswith(F.concat(F.lit("."), of))
    return same & (F.lower(part(url, SCHEME)) == F.lower(part(root, SCHEME))) & port(url).eqNullSafe(port(root))


def is_safe(url: Column) -> Column:
    """http or https, the usual ports, a host, no user information, no private or local host name."""
    host = F.lower(part(url, HOST))
    local = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)|\.local$|^\[")
    return F.lower(part(url, SCHEME)).isin("http", "https") & port(url).isin(80, 443) & (part(url, USER) == "") & (host != "") & ~local


def stepped(url: Column) -> dict[str, Column]:
    """The address with its page number one higher, and with its offset higher by its limit; null without them."""
    page = F.regexp_extract(url, r"[?&](?:page|p|pagenum|pageindex)=(\d+)", 1)
    offset, limit = F.regexp_extract(url, r"[?&]offset=(\d+)", 1), F.regexp_extract(url, r"[?&]limit=(\d+)", 1)
    by = lambda pattern, value: F.concat(F.regexp_extract(url, pattern, 1), value.cast("string"), F.regexp_extract(url, pattern, 3))
    turned = by(r"^(.*?[?&](?:page|p|pagenum|pageindex)=)(\d+)(.*)$", page.try_cast("long") + 1)
    moved = by(r"^(.*?[?&]offset=)(\d+)(.*)$", offset.try_cast("long") + limit.try_cast("long"))
    return {"query_page": F.when(page != "", turned), "offset_limit": F.when((offset != "") & (limit != ""), moved)}


def next_page(url: Column) -> Column:
    """The next page by the address alone."""
    return F.coalesce(*stepped(url).values())


def next_link(url: Column, link_header: Column, body: Column, kind: Column) -> Column:
    """struct<kind, url> of the next page: the Link header, then a JSON body's member or a page's rel=next, then the address."""
    header = F.regexp_extract(F.get(F.filter(F.split(F.coalesce(link_header, F.lit("")), ","), lambda x: x.rlike(r"rel=\"?next\"?")), F.lit(0)), "<([^>]+)>", 1)
    member = lambda k: F.nullif(F.trim(F.when(F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit("")).rlike(r"^[\[{]"), "").otherwise(F.get_json_object(body, f"$.{k}"))), F.lit(""))
    json = F.when(kind.isin("json", "jsonl"), F.coalesce(*[member(k) for k in NEXT_KEYS]))
    tag = F.regexp_extract(body, r"(?is)<(?:a|link)\b[^>]*\srel\s*=\s*[\"']?next\b[^>]*>", 0)
    rel = F.when(~kind.isin("json", "jsonl"), F.nullif(F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")))
    found = {"link_header": F.nullif(F.coalesce(header, F.lit("")), F.lit("")), "json_next": json, "rel_next": rel}
    each = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), resolve(url, v).alias("url"))) for k, v in found.items()]
    each += [F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("url"))) for k, v in stepped(url).items()]
    return F.coalesce(*each)


def _safe(urls: pd.Series) -> pd.Series:
    def one(url: str | None) -> str | None:
        if url is None:
            return None
        m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?", url)
        if not m:
            return None
        try:
            host = m[3].encode("idna").decode().lower() if not m[3].isascii() else m[3].lower()
        except UnicodeError:
            return None
        quoted = lambda t, safe: quote(t or "", safe=safe + "%")
        user = f"{m[2]}@" if m[2] is not None else ""
        return f"{m[1].lower()}://{user}{host}{m[4] or ''}{quoted(m[5], '/:@!$&()*+,;=~-._' + chr(39)) or '/'}{quoted(m[6], '?/:@!$&()*+,;=~-._' + chr(39))}"

    return urls.map(one)


def http_form(url: Column) -> Column:
    """An address as it goes over the wire: host in IDNA, path and query percent-encoded (what is so already stays), no fragment; null where it is none. Spark has no function for IDNA."""
    return F.pandas_udf(_safe, StringType())(url)
