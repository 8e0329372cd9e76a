"""Security queries, each with its SQL.

The pages and addresses are the tables' own; the headers, cookies, redirects,
certificates and files that a crawl would add are the literal rows below, planted by
turns. Both sides read the same rows; the rules stand in the library and, again, in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import urls
from lakeprobe.operators import security
from lakeprobe.session import table
from lakeprobe.streaming import jobs

#: Planted responses: the headers of each, then its cookies, then what stands at the end of its page.
HEADERS = (
    {"Strict-Transport-Security": "max-age=1", "X-Content-Type-Options": "NoSniff", "Referrer-Policy": "no-referrer", "Permissions-Policy": "camera=()", "X-Frame-Options": "DENY", "Cross-Origin-Opener-Policy": "same-origin",
     "Cross-Origin-Resource-Policy": "same-site", "Cross-Origin-Embedder-Policy": "require-corp", "Content-Security-Policy": "default-src 'self'"},
    {"X-Content-Type-Options": "other", "Content-Security-Policy": "default-src 'self'; script-src 'unsafe-inline'", "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Credentials": "TRUE", "Server": "nginx/1.2"},
    {"Content-Security-Policy": "default-src *; object-src 'none'", "Access-Control-Allow-Origin": "*", "Server": "nginx", "X-Powered-By": "PHP"},
    {"Content-Security-Policy": "script-src 'unsafe-eval' http://c.example; frame-ancestors 'none'", "Access-Control-Allow-Origin": "null", "X-Runtime": "0.1", "Referrer-Policy": ""},
    {"Access-Control-Allow-Origin": "https://o.example", "Access-Control-Allow-Credentials": "true", "X-AspNet-Version": "4", "X-Generator": "g"},
    {"Access-Control-Allow-Origin": "https://o.example", "Access-Control-Allow-Credentials": "true", "Vary": "Accept, Origin", "X-Drupal-Cache": "HIT", "X-AspNetMvc-Version": "5"},
    {"Content-Security-Policy": "base-uri *", "Permissions-Policy": "x"},
    {"server": "nginx/9.9", "Server": "quiet", "x-frame-options": "", "X-Frame-Options": "DENY", "Content-Security-Policy": "default-src *; img-src 'self'; Default-Src 'self'"},
)
COOKIES = (
    (), ("a=1; Secure; HttpOnly; SameSite=Lax",), ("a=1; SameSite=None", "b=2; HttpOnly"), ("__Host-s=1; Path=/app; Domain=x.example; HttpOnly",), ("__Secure-t=1; SameSite=Strict; HttpOnly", "__Host-u=1; Secure; Path=/; HttpOnly; SameSite=Lax"),
)
PAGES = (
    "", '<img src="http://i.example/x.png">', '<form method="post" action="http://f.example/a">', '<form action="/a"><input name=p type="password"></form>', '<script src="https://s.example/x.js"></script>', "<pre>Traceback (most recent call last)</pre>",
    '<meta name="generator" content="Site 1.0">', "Whoops, looks like something went wrong",
)
#: Planted redirect chains (address, location), with where they ended; certificates; and files.
CHAINS = (
    (), (("http://a.example/", "https://a.example/"),), (("https://a.example/", "http://b.example/"),), (("https://a.example/", "https://b.example/"), ("https://b.example/", "https://a.example/"), ("https://a.example/", "https://c.example/")),
    tuple((f"https://a.example/{i}", f"https://a.example/{i + 1}") for i in range(8)),
)
CERTIFICATES = (
    ("TLSv1.3", "2024-12-31", "a.example", ("a.example", "b.example"), True, None), ("TLSv1.1", "2024-06-29", "a.example", ("*.example",), True, None), ("TLSv1.2", "2024-07-10", "x.a.example", ("*.a.example",), False, None),
    ("SSLv3", None, "x.y.a.example", ("*.a.example",), True, "handshake failure"), ("TLSv1.2", "2024-07-21", "A.example.", ("a.Example",), None, None),
)
FILES = (
    (200, "Contact: mailto:a@b.example\nExpires: 2030-01-01T00:00:00Z\n", "text/plain"), (200, "Expires: 2023-01-01T00:00:00Z\n", "text/plain"), (404, "Contact: x", "text/plain"), (200, "<html></html>", "text/html"), (None, None, None), (200, "words", "text/plain; charset=utf-8"),
)
ALLOWS = ("GET, HEAD", "get, put,TRACE", "", None, "DELETE , post")
NOW = "2024-06-30"


def turn(options: list, kind: str, salt: int = 0) -> Column:
    """One of the options for each page, by turns."""
    made = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    return F.get(made, ((F.col("page_id") + salt) % len(options)).cast("int")).cast(kind)


def responses(pages: DataFrame) -> DataFrame:
    """Pages with site, headers, cookies and what is planted at the end of their text."""
    headers = [F.create_map(*[F.lit(x) for pair in h.items() for x in pair]) for h in HEADERS]
    cookies = [F.lit(list(c)) if c else F.array().cast("array<string>") for c in COOKIES]
    site = urls.bare_host(F.col("url"))
    # every third page by http
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https:", "http:")).otherwise(F.regexp_replace("url", "^http:", "https:"))
    return pages.select("page_id", url.alias("url"), site.alias("site"), turn(list(PAGES), "string").alias("html"), turn(headers, "map<string,string>").alias("headers"), turn(cookies, "array<string>").alias("cookies"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return security.findings(responses(table(spark, d, "pages")))


def exploded(spark: SparkSession, d: str, made: Column) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(made).alias("f")).select("page_id", "f.finding", "f.severity")


def chains(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<url:string,location:string>>"
    hops = [F.array(*[F.struct(F.lit(a).alias("url"), F.lit(b).alias("location")) for a, b in c]).cast(kind) if c else F.array().cast(kind) for c in CHAINS]
    last = [c[-1][1] if c else "https://a.example/" for c in CHAINS]
    asked = [c[0][0] if c else "https://a.example/" for c in CHAINS]
    return exploded(spark, d, security.redirects(turn(hops, kind), turn(asked, "string"), turn(last, "string")))


def certificates(spark: SparkSession, d: str) -> DataFrame:
    version, until, host, names, trusted, error = zip(*CERTIFICATES, strict=True)
    names = [F.lit(list(n)) for n in names]
    made = security.certificate(turn(list(version), "string"), turn(list(until), "string").cast("timestamp"), F.lit(NOW).cast("timestamp"), turn(list(host), "string"), turn(names, "array<string>"), turn(list(trusted), "boolean"), turn(list(error), "string"))
    return exploded(spark, d, made)


def security_txt(spark: SparkSession, d: str) -> DataFrame:
    status, text, kind = zip(*FILES, strict=True)
    return exploded(spark, d, security.security_txt(turn(list(status), "int"), turn(list(text), "string"), turn(list(kind), "string"), F.lit(NOW).cast("timestamp")))


def robots(spark: SparkSession, d: str) -> DataFrame:
    status, text, _ = zip(*FILES, strict=True)
    return exploded(spark, d, security.robots(turn(list(status), "int"), turn(list(text), "string")))


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Findings about the sites: of their pages' disclosures and of their files, each once."""
    pages = table(spark, d, "pages").select("page_id", urls.bare_host(F.col("url")).alias("site"))
    probes = security_txt(spark, d).unionByName(robots(spark, d)).unionByName(exploded(spark, d, security.methods(turn(list(ALLOWS), "string"))))
    return security.origin_findings(probes.join(pages, "page_id"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    """Header maps with their secrets hidden, a row for each header."""
    pages = table(spark, d, "pages")
    made = F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("page_id").cast("string")), F.lit("X-Api-Key"), F.lit("k"), F.lit("Accept"), F.lit("text/html"), F.lit("Set-Cookie"), F.lit("a=1"), F.lit("X-Request-Id"), F.col("page_id").cast("string"))
    return pages.select("page_id", F.explode(urls.mask_headers(made)).alias("name", "value"))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    return jobs.audit(responses(jobs.stream(spark, d, "pages")))


QUERIES = {
    "sec_findings": lambda s, d: found(s, d).select("page_id", "site", "finding", "severity"),
    "sec_site_report": lambda s, d: security.site_report(found(s, d)),
    "sec_summary": lambda s, d: security.summary(found(s, d)),
    "sec_origin": origins,
    "sec_redirects": chains,
    "sec_tls": certificates,
    "sec_security_txt": security_txt,
    "sec_robots": robots,
    "sec_methods": lambda s, d: exploded(s, d, security.methods(turn(list(ALLOWS), "string"))),
    "sec_mask_headers": masked,
    "stream_security_audit": streamed,
}


def _q(value: object) -> str:
    """A planted value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (tuple, list)):
        return "[" + ", ".join(map(_q, value)) + "]::VARCHAR[]"
    return "'" + str(value).replace("'", "''") + "'"


def _rows(names: str, rows: list[tuple]) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, (i, *r))) + ')' for i, r in enumerate(rows))}) AS v(i, {names}))"


_NAMES = sorted({k.lower() for h in HEADERS for k in h})
_COLUMNS = ", ".join(f'"{n}"' for n in _NAMES)
_LOWER = [{k.lower(): v for k, v in h.items()} for h in HEADERS]
_SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"
FETCH = "default-src|script-src|script-src-elem|script-src-attr|style-src|style-src-elem|img-src|connect-src|font-src|frame-src|child-src|object-src|media-src|worker-src"
FOUND = f"""
r AS (SELECT page_id, {_SITE} AS site, page_id % 3 <> 0 AS https, h.* EXCLUDE (i), c.cookies, t.html FROM pages
  JOIN {_rows(_COLUMNS, [tuple(h.get(n) for n in _NAMES) for h in _LOWER])} h ON h.i = page_id % {len(HEADERS)}
  JOIN {_rows("cookies", [(c,) for c in COOKIES])} c ON c.i = page_id % {len(COOKIES)} JOIN {_rows("html", [(p,) for p in PAGES])} t ON t.i = page_id % {len(PAGES)}),
p AS (SELECT *, lower(coalesce("content-security-policy", '')) AS csp, "access-control-allow-origin" AS acao, lower(coalesce("access-control-allow-credentials", '')) = 'true' AS creds FROM r),
ck AS (SELECT page_id, site, https, unnest(cookies) AS line FROM p),
k AS (SELECT *, split_part(line, '=', 1) AS name, regexp_matches(line, '(?i); *secure *(;|$)') AS secure FROM ck),
one AS (
  SELECT page_id, site, 'no_https' AS finding, 'high' AS severity FROM p WHERE NOT https
  UNION ALL SELECT page_id, site, 'missing_hsts', 'medium' FROM p WHERE https AND coalesce("strict-transport-security", '') = ''
  UNION ALL SELECT page_id, site, 'missing_nosniff', 'low' FROM p WHERE lower(coalesce("x-content-type-options", '')) <> 'nosniff'
  UNION ALL SELECT page_id, site, 'missing_referrer_policy', 'low' FROM p WHERE coalesce("referrer-policy", '') = ''
  UNION ALL SELECT page_id, site, 'missing_permissions_policy', 'info' FROM p WHERE coalesce("permissions-policy", '') = ''
  UNION ALL SELECT page_id, site, 'missing_frame_protection', 'medium' FROM p WHERE coalesce("x-frame-options", '') = '' AND NOT contains(csp, 'frame-ancestors')
  UNION ALL SELECT page_id, site, 'missing_coop', 'info' FROM p WHERE coalesce("cross-origin-opener-policy", '') = ''
  UNION ALL SELECT page_id, site, 'missing_corp', 'info' FROM p WHERE coalesce("cross-origin-resource-policy", '') = ''
  UNION ALL SELECT page_id, site, 'missing_coep', 'info' FROM p WHERE coalesce("cross-origin-embedder-policy", '') = ''
  UNION ALL SELECT page_id, site, 'missing_csp', 'medium' FROM p WHERE csp = ''
  UNION ALL SELECT page_id, site, 'csp_unsafe_inline', 'medium' FROM p WHERE contains(csp, '''unsafe-inline''')
  UNION ALL SELECT page_id, site, 'csp_unsafe_eval', 'medium' FROM p WHERE contains(csp, '''unsafe-eval''')
  UNION ALL SELECT page_id, site, 'csp_wildcard_source', 'medium' FROM p WHERE len(list_filter(string_split(csp, ';'), lambda x, i: regexp_matches(x, '^ *({FETCH}) (.* )?\\*( |$)') AND NOT list_contains(list_transform(string_split(csp, ';')[i + 1 :], lambda y: regexp_extract(y, '^ *([^ ]+)', 1)), regexp_extract(x, '^ *([^ ]+)', 1)))) > 0
  UNION ALL SELECT page_id, site, 'csp_insecure_scheme', 'medium' FROM p WHERE contains(csp, 'http://')
  UNION ALL SELECT page_id, site, 'cookie_no_secure', 'medium' FROM k WHERE https AND NOT secure
  UNION ALL SELECT page_id, site, 'cookie_no_httponly', 'low' FROM k WHERE NOT regexp_matches(line, '(?i); *httponly *(;|$)')
  UNION ALL SELECT page_id, site, 'cookie_no_samesite', 'low' FROM k WHERE NOT regexp_matches(line, '(?i); *samesite')
  UNION ALL SELECT page_id, site, 'cookie_samesite_none_insecure', 'medium' FROM k WHERE regexp_matches(line, '(?i); *samesite *= *none') AND NOT secure
  UNION ALL SELECT page_id, site, 'cookie_host_prefix_insecure', 'medium' FROM k WHERE name LIKE '\\_\\_Host-%' ESCAPE '\\' AND NOT secure
  UNION ALL SELECT page_id, site, 'cookie_host_prefix_domain', 'medium' FROM k WHERE name LIKE '\\_\\_Host-%' ESCAPE '\\' AND regexp_matches(line, '(?i); *domain *=')
  UNION ALL SELECT page_id, site, 'cookie_host_prefix_path', 'low' FROM k WHERE name LIKE '\\_\\_Host-%' ESCAPE '\\' AND NOT regexp_matches(line, '(?i); *path *= */ *(;|$)')
  UNION ALL SELECT page_id, site, 'cookie_secure_prefix_insecure', 'medium' FROM k WHERE name LIKE '\\_\\_Secure-%' ESCAPE '\\' AND NOT secure
  UNION ALL SELECT page_id, site, 'cors_wildcard_credentials', 'high' FROM p WHERE acao = '*' AND creds
  UNION ALL SELECT page_id, site, 'cors_wildcard', 'low' FROM p WHERE acao = '*' AND NOT creds
  UNION ALL SELECT page_id, site, 'cors_null_origin', 'medium' FROM p WHERE acao = 'null'
  UNION ALL SELECT page_id, site, 'cors_reflect_no_vary', 'medium' FROM p WHERE acao NOT IN ('*', 'null') AND creds AND NOT contains(lower(coalesce(vary, '')), 'origin')
  UNION ALL SELECT page_id, site, 'mixed_content', 'medium' FROM p WHERE https AND regexp_matches(html, '<img [^>]*src="http://')
  UNION ALL SELECT page_id, site, 'form_action_http', 'medium' FROM p WHERE regexp_matches(html, '<form [^>]*action="http://')
  UNION ALL SELECT page_id, site, 'form_over_http', 'medium' FROM p WHERE NOT https AND contains(html, '<form')
  UNION ALL SELECT page_id, site, 'password_over_http', 'high' FROM p WHERE NOT https AND contains(html, 'type="password"')
  UNION ALL SELECT page_id, site, 'external_scripts', 'info' FROM p WHERE regexp_matches(html, '<script src="https?://')
  UNION ALL SELECT page_id, site, 'debug_disclosure', 'medium' FROM p WHERE html ILIKE '%traceback (most recent call last)%' OR html ILIKE '%whoops, looks like%'
  UNION ALL SELECT page_id, site, 'server_version', 'low' FROM p WHERE regexp_matches(server, '[0-9]')
  UNION ALL SELECT page_id, site, 'server_header', 'info' FROM p WHERE server <> '' AND NOT regexp_matches(server, '[0-9]')
  UNION ALL SELECT page_id, site, 'powered_by', 'low' FROM p WHERE "x-powered-by" <> ''
  UNION ALL SELECT page_id, site, 'tech_header_x-aspnet-version', 'info' FROM p WHERE "x-aspnet-version" <> '' UNION ALL SELECT page_id, site, 'tech_header_x-aspnetmvc-version', 'info' FROM p WHERE "x-aspnetmvc-version" <> ''
  UNION ALL SELECT page_id, site, 'tech_header_x-runtime', 'info' FROM p WHERE "x-runtime" <> '' UNION ALL SELECT page_id, site, 'tech_header_x-generator', 'info' FROM p WHERE "x-generator" <> ''
  UNION ALL SELECT page_id, site, 'tech_header_x-drupal-cache', 'info' FROM p WHERE "x-drupal-cache" <> '' UNION ALL SELECT page_id, site, 'generator_meta', 'info' FROM p WHERE contains(html, 'name="generator"'))"""
_CHAINS = _rows("froms, tos, final", [([a for a, _ in c], [b for _, b in c], c[-1][1] if c else "https://a.example/") for c in CHAINS])
_TXT = """f AS (SELECT page_id, v.* FROM pages JOIN {rows} v ON v.i = page_id % {n}),
g AS (SELECT *, coalesce(status < 400, false) AND (contains(lower(text), 'contact:') OR contains(lower(text), 'expires:') OR kind LIKE 'text/plain%' AND text <> '') AS there FROM f),
txt AS (SELECT page_id, CASE WHEN there THEN 'security_txt_present' ELSE 'security_txt_missing' END AS finding, 'info' AS severity FROM g UNION ALL SELECT page_id, 'security_txt_no_contact', 'low' FROM g WHERE there AND NOT contains(lower(text), 'contact:')
  UNION ALL SELECT page_id, 'security_txt_expired', 'low' FROM g WHERE there AND TRY_CAST(regexp_extract(text, 'Expires: *([0-9-]+)', 1) AS DATE) < DATE '2024-06-30'),
rob AS (SELECT page_id, CASE WHEN status < 400 AND text IS NOT NULL THEN 'robots_present' ELSE 'robots_missing' END AS finding, 'info' AS severity FROM f)""".format(rows=_rows("status, text, kind", list(FILES)), n=len(FILES))
_ALLOW = f"""a AS (SELECT page_id, list_filter(list_transform(string_split(upper(coalesce(v.allow, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS m FROM pages JOIN {_rows("allow", [(x,) for x in ALLOWS])} v ON v.i = page_id % {len(ALLOWS)}),
allowed AS (SELECT page_id, 'http_methods_allowed' AS finding, 'info' AS severity FROM a WHERE len(m) > 0 UNION ALL SELECT page_id, 'http_trace_declared', 'low' FROM a WHERE list_contains(m, 'TRACE')
  UNION ALL SELECT page_id, 'http_write_methods_declared', 'low' FROM a WHERE list_has_any(m, ['PUT', 'DELETE', 'PATCH']))"""
_ORDER = "list_position(['high', 'medium', 'low', 'info'], severity)"
ORACLES = {
    "sec_findings": f"WITH {FOUND} SELECT * FROM one",
    "sec_site_report": f"""WITH {FOUND}, u AS (SELECT DISTINCT site, finding, severity, page_id FROM one)
        SELECT site, finding, severity, count(*) AS pages, min(page_id) AS first_page, list_slice(list_sort(list(page_id)), 1, 5) AS examples FROM u GROUP BY ALL""",
    "sec_summary": f"WITH {FOUND} SELECT severity, count(*) AS findings, count(DISTINCT page_id) AS pages FROM one GROUP BY 1",
    "sec_origin": f"""WITH {_TXT}, {_ALLOW}, every AS (SELECT * FROM txt UNION ALL SELECT * FROM rob UNION ALL SELECT * FROM allowed) SELECT DISTINCT {_SITE} AS site, finding, severity FROM every JOIN pages USING (page_id)""",
    "sec_redirects": f"""WITH c AS (SELECT page_id, v.* FROM pages JOIN {_CHAINS} v ON v.i = page_id % {len(CHAINS)})
        SELECT page_id, 'redirect_downgrade' AS finding, 'high' AS severity FROM c WHERE len(list_filter(list_zip(froms, tos), lambda x: x[1] LIKE 'https:%' AND x[2] LIKE 'http:%')) > 0
        UNION ALL SELECT page_id, 'redirect_loop', 'high' FROM c WHERE len(list_distinct(froms)) < len(froms) UNION ALL SELECT page_id, 'redirect_too_many', 'low' FROM c WHERE len(froms) >= 8
        UNION ALL SELECT page_id, 'redirect_cross_origin', 'info' FROM c WHERE len(froms) > 0 AND regexp_extract(froms[1], '^[a-z]+://[^/]+') <> regexp_extract(final, '^[a-z]+://[^/]+')""",
    "sec_tls": f"""WITH c AS (SELECT page_id, v.* FROM pages JOIN {_rows("version, until, host, names, trusted, error", list(CERTIFICATES))} v ON v.i = page_id % {len(CERTIFICATES)}),
        e AS (SELECT *, until::DATE - DATE '{NOW}' AS days, rtrim(lower(host), '.') AS h FROM c)
        SELECT page_id, 'tls_handshake_failed' AS finding, 'high' AS severity FROM e WHERE error <> '' UNION ALL SELECT page_id, 'tls_version_obsolete', 'medium' FROM e WHERE version IN ('SSLv2', 'SSLv3', 'TLSv1', 'TLSv1.1')
        UNION ALL SELECT page_id, 'tls_cert_expired', 'high' FROM e WHERE days < 0 UNION ALL SELECT page_id, 'tls_cert_expiring_soon', 'medium' FROM e WHERE days BETWEEN 0 AND 20
        UNION ALL SELECT page_id, 'tls_cert_hostname_mismatch', 'high' FROM e WHERE len(list_filter(names, lambda n: lower(n) = h OR lower(n) LIKE '*.%' AND substr(lower(n), 2) = regexp_extract(h, '^[^.]+([.].*)$', 1))) = 0
        UNION ALL SELECT page_id, 'tls_cert_untrusted', 'high' FROM e WHERE NOT trusted""",
    "sec_security_txt": f"WITH {_TXT} SELECT * FROM txt",
    "sec_robots": f"WITH {_TXT} SELECT * FROM rob",
    "sec_methods": f"WITH {_ALLOW} SELECT * FROM allowed",
    "sec_mask_headers": """WITH h AS (SELECT page_id, unnest(['Authorization', 'X-Api-Key', 'Accept', 'Set-Cookie', 'X-Request-Id']) AS name FROM pages)
        SELECT page_id, name, CASE name WHEN 'Accept' THEN 'text/html' WHEN 'X-Request-Id' THEN page_id::VARCHAR ELSE '***' END AS value FROM h""",
    "stream_security_audit": f"WITH {FOUND} SELECT site, finding, severity, count(DISTINCT page_id) AS pages FROM one GROUP BY ALL",
}
