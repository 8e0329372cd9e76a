"""Unicode, transform and rename queries, each with its SQL. Defects are planted by the same expression on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import cells, text
from lakeprobe.operators import rename
from lakeprobe.session import table


def planted(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id") % 8, F.coalesce("text", F.lit(""))
    sub = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    x = (
        F.when(k == 0, F.concat(F.lit("a\u200bb "), t)).when(k == 1, sub(" ", "\u00a0")).when(k == 2, F.concat(F.lit("soft\u00adhyphen "), t)).when(k == 3, sub("a", "\u0430"))
        .when(k == 4, F.concat(t, F.lit("\ufffd"))).when(k == 5, F.concat(F.lit("\u202e"), t, F.lit("  \n"))).when(k == 6, sub("e", "e\u0301")).otherwise(F.concat(t, F.lit("\u0007\u2019")))
    )
    return table(spark, d, "documents").select("doc_id", "source", t.alias("plain"), x.alias("text"))


PLANTED = """
planted AS (
  SELECT doc_id, source, coalesce(text, '') AS plain, CASE doc_id % 8 WHEN 0 THEN 'a' || chr(8203) || 'b ' || coalesce(text, '') WHEN 1 THEN replace(coalesce(text, ''), ' ', chr(160))
    WHEN 2 THEN 'soft' || chr(173) || 'hyphen ' || coalesce(text, '') WHEN 3 THEN replace(coalesce(text, ''), 'a', chr(1072)) WHEN 4 THEN coalesce(text, '') || chr(65533)
    WHEN 5 THEN chr(8238) || coalesce(text, '') || '  ' || chr(10) WHEN 6 THEN replace(coalesce(text, ''), 'e', 'e' || chr(769)) ELSE coalesce(text, '') || chr(7) || chr(8217) END AS text FROM documents)"""
SQL_KINDS = {
    "zero_width": r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{180E}]", "bidi_control": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]",
    "exotic_space": r"[\x{A0}\x{2000}-\x{2007}\x{2009}\x{200A}\x{202F}\x{3000}\x{1680}]", "soft_hyphen": r"\x{AD}", "replacement_char": r"\x{FFFD}",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "combining_mark": r"\pM",
}
SQL_INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{180E}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
SQL_CLEAN = f"trim(regexp_replace(regexp_replace(text, '{SQL_INVISIBLE}', '', 'g'), '{SQL_KINDS['exotic_space']}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
SQL_COPY = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{FEFF}\x{200B}-\x{200D}\x{2060}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'),"
    r" '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}]', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')"
)


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = text.count_kinds(F.col("text"))
    names = list(SQL_KINDS)
    sums = planted(spark, d).select(*[counts[k].alias(k) for k in names]).agg(*[F.sum(k).cast("long").alias(k) for k in names])
    return sums.unpivot([], names, "kind", "characters")


def exploded(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d).select("doc_id", F.explode(text.issues(F.col("text"))).alias("x"))
    return rows.select("doc_id", F.col("x.pos").cast("long").alias("pos"), F.ascii("x.ch").alias("codepoint"), "x.kind", "x.action")


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 5 == 0, ".JPG").when(k % 5 == 1, ".tar.gz").when(k % 5 == 2, "").when(k % 5 == 3, ". ").otherwise(".txt")
    special = F.when(k % 97 == 0, F.concat(F.lit("a:b"), k.cast("string"))).when(k % 89 == 0, F.lit("CON")).when(k % 83 == 0, F.lit("Report")).when(k % 79 == 0, F.lit("report")).otherwise(F.concat("p_name", F.lit(" "), (k % 50).cast("string")))
    return table(spark, d, "part").select(k.alias("id"), F.concat(special, ext).alias("name"))


FILES = """
files AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN 'a:b' || p_partkey WHEN p_partkey % 89 = 0 THEN 'CON' WHEN p_partkey % 83 = 0 THEN 'Report' WHEN p_partkey % 79 = 0 THEN 'report'
    ELSE p_name || ' ' || (p_partkey % 50) END || CASE p_partkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '. ' ELSE '.txt' END AS name FROM part),
parts AS (SELECT *, regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 2) AS ext, row_number() OVER (ORDER BY id) - 1 AS i FROM files)"""
RULES = [rename.Rule("replace", " ", "_"), rename.Rule("regex", "([0-9]+)$", r"n\1"), rename.Rule("lower"), rename.Rule("suffix", "_v2")]
PLAN = FILES + """, plan AS (SELECT id, name, lower(regexp_replace(replace(stem, ' ', '_'), '([0-9]+)$', 'n\\1')) || '_v2' || ext AS new_name FROM parts)"""
SQL_PROBLEMS = """list_filter([CASE WHEN {0} IN ('.', '..') THEN 'dot_name' END, CASE WHEN regexp_matches({0}, '[<>:"/\\\\|?*]') THEN 'reserved_character' END, CASE WHEN regexp_matches({0}, '[\\x00-\\x1f\\x7f]') THEN 'control_character' END,
    CASE WHEN regexp_matches(lower(split_part({0}, '.', 1)), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN 'reserved_name' END, CASE WHEN length({0}) > 255 THEN 'too_long' END,
    CASE WHEN regexp_matches({0}, '[ .]$') THEN 'trailing_space_or_dot' END], lambda x: x IS NOT NULL)"""


def plan(spark: SparkSession, d: str) -> DataFrame:
    return rename.renamed(files(spark, d), RULES)


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Prices and dates in words, made from orders."""
    k, cents = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    price = F.when(k % 3 == 0, F.concat(F.lit("Price: "), whole, F.lit(","), rest, F.lit(" EUR"))).when(k % 3 == 1, F.concat(F.lit("1.234,"), rest)).otherwise(F.concat(F.lit("$ 1,"), F.lpad((cents % 1000).cast("string"), 3, "0"), F.lit("."), rest))
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "'on 'dd.MM.yyyy' at 10:00'")).when(k % 3 == 1, F.date_format("o_orderdate", "'from 'yyyy-MM-dd'T'")).otherwise(F.lit("  soon "))
    return table(spark, d, "orders").select(k.alias("id"), price.alias("price"), day.alias("day"), F.concat(F.lit("  a\t b \n"), k.cast("string"), F.lit(" ")).alias("ws"), F.concat(F.lit("SKU-ABC-"), k.cast("string")).alias("sku"))


PRICED = """
priced AS (SELECT o_orderkey AS id, floor(o_totalprice * 100)::BIGINT AS cents, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, 'from %Y-%m-%dT') ELSE 'soon' END AS day FROM orders)"""
H = "md5({})"
QUERIES = {
    "unicode_issue_counts": issue_counts,
    "unicode_issues_exploded": exploded,
    "unicode_status": lambda s, d: planted(s, d).select("doc_id", text.status(F.col("text")).alias("status")),
    "unicode_mixed_script": lambda s, d: planted(s, d).select("doc_id", F.size(text.mixed_words(F.col("text"))).cast("long").alias("words")).filter("words > 0"),
    "unicode_clean": lambda s, d: planted(s, d).select("doc_id", F.md5(text.nfc(text.spaced(F.col("text")))).alias("digest")),
    "unicode_clean_copy": lambda s, d: planted(s, d).select("doc_id", F.md5(text.clean_copy(F.col("text"))).alias("digest")),
    "unicode_nfc": lambda s, d: planted(s, d).select("doc_id", F.md5(text.nfc(F.col("text"))).alias("digest"), (text.nfc(F.col("text")) == F.col("text")).alias("is_nfc")),
    "unicode_escape": lambda s, d: planted(s, d).select("doc_id", F.md5(text.escape(F.col("text"))).alias("digest")),
    "unicode_compare": lambda s, d: planted(s, d).select("doc_id", F.explode(text.differences(F.col("plain"), F.col("text"))).alias("x")).select("doc_id", F.col("x.pos").cast("long").alias("pos"), F.ascii("x.l").alias("l"), F.ascii("x.r").alias("r")),
    "unicode_forms": lambda s, d: planted(s, d).select("doc_id", F.explode(text.forms(F.col("text"))).alias("f")).filter("f.form = 'NFC'").select("doc_id", F.col("f.length").alias("length"), F.col("f.bytes").alias("bytes"), F.col("f.changes").alias("changes")),
    "unicode_changes": lambda s, d: planted(s, d).select("doc_id", F.explode(text.changes(F.col("text"))).alias("x")).select("doc_id", F.col("x.pos").cast("long").alias("pos"), F.ascii("x.ch").alias("codepoint"), "x.kind", "x.action"),
    "unicode_report": lambda s, d: planted(s, d).select("doc_id", text.report(F.col("text")).alias("r")).select("doc_id", "r.status", "r.length", "r.bytes", "r.is_nfc", F.size("r.mixed").alias("mixed")),
    "unicode_escape_round_trip": lambda s, d: planted(s, d).select("doc_id", (text.unescape(text.reversible_escape(F.col("text"))) == F.col("text")).alias("same"), F.md5(text.reversible_escape(F.col("text"))).alias("digest")),
    "unicode_look_alikes": lambda s, d: planted(s, d).select("doc_id", F.explode(text.mixed_words(F.col("text"))).alias("word")).select("doc_id", "word", F.explode(text.look_alikes(F.col("word"))).alias("x")).filter("x.ch = '\u0430'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("letters"), F.max("x.looks_like").alias("like")),
    "transform_trim": lambda s, d: priced(s, d).select("id", text.trim(F.concat(F.lit("\u2003\u00a0"), "ws")).alias("value")),
    "transform_date_bounds": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.date(F.get(F.lit(["v 1.2.2024", "x123.04.20245", "on 03.04.2024!", "a 2024-05-06T10", " none "]), (F.col("o_orderkey") % 5).cast("int"))).alias("value")),
    "parse_datetime_offsets": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(cells.date(F.get(F.lit(["2024-01-15T10:00:00Z", "2024-01-15T10:00:00+03:00", "2024-01-15 23:30-0130", "2024-01-15", "2024-01-15T10:00:00.5", "2024-13-01T00:00Z"]), (F.col("o_orderkey") % 6).cast("int"))), "yyyy-MM-dd HH:mm:ss").alias("value")),
    "transform_ws": lambda s, d: priced(s, d).select("id", text.normalize_ws(F.col("ws")).alias("value")),
    "transform_regex": lambda s, d: priced(s, d).select("id", text.regex(F.col("sku"), r"(\d+)", 1).alias("value")),
    "transform_number": lambda s, d: priced(s, d).select("id", text.number(F.col("price")).alias("value")),
    "transform_date": lambda s, d: priced(s, d).select("id", text.date(F.col("day")).alias("value")),
    "parse_number": lambda s, d: priced(s, d).select("id", F.round(cells.number(F.regexp_extract("price", r"([\d.,]+)", 1)), 4).alias("value")),
    "parse_datetime": lambda s, d: priced(s, d).select("id", F.date_format(cells.date(F.regexp_extract("day", r"([\d.-]{10})", 1)), "yyyy-MM-dd").alias("value")),
    "parse_bool": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), cells.boolean(F.when(F.col("o_orderkey") % 3 == 0, "Yes").when(F.col("o_orderkey") % 3 == 1, "f").otherwise("maybe")).alias("value")),
    "rename_plan": lambda s, d: plan(s, d).select("id", "name", "new_name"),
    "rename_numbering": lambda s, d: rename.renamed(files(s, d), [rename.Rule("numbering", "_", start=-2, step=3, width=4)]).select("id", "new_name"),
    "rename_validate": lambda s, d: files(s, d).select("id", F.explode(rename.problems(F.col("name"))).alias("problem")),
    "rename_conflict_members": lambda s, d: rename.conflict_members(files(s, d).withColumn("new_name", F.col("name")), "id"),
    "unicode_characters": lambda s, d: planted(s, d).select("doc_id", F.explode(text.characters(F.col("text"))).alias("x")).select("doc_id", "x.*"),
    "rename_conflicts": lambda s, d: rename.conflicts(files(s, d).withColumnRenamed("name", "new_name")),
    "rename_checked": lambda s, d: rename.checked(plan(s, d)).select("id", "new_name", "problems", "clash", "valid"),
    "rename_summary": lambda s, d: rename.summary(plan(s, d)),
}
ORACLES = {
    "unicode_issue_counts": f"WITH {PLANTED} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, sum(length(text) - length(regexp_replace(text, '{p}', '', 'g')))::BIGINT AS characters FROM planted" for k, p in SQL_KINDS.items()),
    "unicode_issues_exploded": f"""WITH {PLANTED}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM planted),
        k AS (SELECT doc_id, pos, ord(ch) AS codepoint FROM c WHERE ord(ch) IN (7, 160, 173, 8203, 8217, 8238) OR ord(ch) BETWEEN 8192 AND 8202 OR ord(ch) IN (8216, 8220, 8221, 8211, 8212))
        SELECT doc_id, pos, codepoint, CASE codepoint WHEN 7 THEN 'control' WHEN 160 THEN 'nbsp' WHEN 173 THEN 'soft_hyphen' WHEN 8203 THEN 'zero_width' WHEN 8238 THEN 'bidi' WHEN 8211 THEN 'dash' WHEN 8212 THEN 'dash' ELSE 'smart_quote' END AS kind,
          CASE codepoint WHEN 160 THEN 'space' WHEN 7 THEN 'remove' WHEN 173 THEN 'remove' WHEN 8203 THEN 'remove' WHEN 8238 THEN 'remove' ELSE 'keep' END AS action FROM k""",
    "unicode_status": f"""WITH {PLANTED} SELECT doc_id, CASE WHEN regexp_matches(text, '{SQL_KINDS["zero_width"]}|{SQL_KINDS["bidi_control"]}|{SQL_KINDS["replacement_char"]}|{SQL_KINDS["control"]}') THEN 'alert'
        WHEN regexp_matches(text, '{SQL_KINDS["exotic_space"]}|{SQL_KINDS["soft_hyphen"]}') THEN 'warn' WHEN regexp_matches(text, '\\pM') THEN 'info' ELSE 'ok' END AS status FROM planted""",
    "unicode_mixed_script": f"""WITH {PLANTED}, w AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\pL\\pN]{{2,}}'), lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}'))) AS words FROM planted)
        SELECT doc_id, words FROM w WHERE words > 0""",
    "unicode_clean": f"WITH {PLANTED} SELECT doc_id, md5(nfc_normalize({SQL_CLEAN})) AS digest FROM planted",
    "unicode_clean_copy": f"WITH {PLANTED} SELECT doc_id, md5({SQL_COPY}) AS digest FROM planted",
    "unicode_nfc": f"WITH {PLANTED} SELECT doc_id, md5(nfc_normalize(text)) AS digest, nfc_normalize(text) = text AS is_nfc FROM planted",
    "unicode_escape": f"""WITH {PLANTED} SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN ch WHEN ord(ch) > 65535 THEN printf('\\U%08x', ord(ch)) ELSE printf('\\u%04x', ord(ch)) END), '')) AS digest FROM planted""",
    "unicode_compare": f"""WITH {PLANTED}, z AS (SELECT doc_id, unnest(list_zip(string_split(plain, ''), string_split(text, ''))) AS x, unnest(range(greatest(length(plain), length(text)))) AS pos FROM planted WHERE plain <> text),
        k AS (SELECT doc_id, pos, ord(x[1]) AS l, ord(x[2]) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM z WHERE x[1] IS DISTINCT FROM x[2]) SELECT doc_id, pos, l, r FROM k WHERE i <= 50""",
    "unicode_forms": f"WITH {PLANTED} SELECT doc_id, length(nfc_normalize(text))::INT AS length, octet_length(encode(nfc_normalize(text)))::INT AS bytes, nfc_normalize(text) <> text AS changes FROM planted",
    "unicode_changes": f"""WITH {PLANTED}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM planted)
        SELECT doc_id, pos, ord(ch) AS codepoint, CASE ord(ch) WHEN 7 THEN 'control' WHEN 160 THEN 'nbsp' WHEN 173 THEN 'soft_hyphen' WHEN 8203 THEN 'zero_width' ELSE 'bidi' END AS kind, CASE ord(ch) WHEN 160 THEN 'space' ELSE 'remove' END AS action FROM c WHERE ord(ch) IN (7, 160, 173, 8203, 8238)""",
    "unicode_report": f"""WITH {PLANTED}, r AS (SELECT doc_id, text, len(list_filter(regexp_extract_all(text, '[\\pL\\pN]{{2,}}'), lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}')))::INT AS mixed FROM planted)
        SELECT doc_id, CASE WHEN regexp_matches(text, '{SQL_KINDS["zero_width"]}|{SQL_KINDS["bidi_control"]}|{SQL_KINDS["replacement_char"]}|{SQL_KINDS["control"]}') THEN 'alert' WHEN mixed > 0 OR regexp_matches(text, '{SQL_KINDS["exotic_space"]}|{SQL_KINDS["soft_hyphen"]}') THEN 'warn'
          WHEN regexp_matches(text, '\\pM') THEN 'info' ELSE 'ok' END AS status, length(text)::INT AS length, octet_length(encode(text))::INT AS bytes, nfc_normalize(text) = text AS is_nfc, mixed FROM r""",
    "unicode_escape_round_trip": f"""WITH {PLANTED} SELECT doc_id, true AS same, md5(array_to_string(list_transform(string_split(text, ''), lambda ch: CASE WHEN ch = '\\' THEN '\\\\' WHEN ord(ch) BETWEEN 32 AND 126 THEN ch WHEN ord(ch) > 65535 THEN printf('\\U%08x', ord(ch)) ELSE printf('\\u%04x', ord(ch)) END), '')) AS digest FROM planted""",
    "unicode_look_alikes": f"""WITH {PLANTED}, w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\\pL\\pN]{{2,}}'), lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}'))) AS word FROM planted)
        SELECT doc_id, sum(length(word) - length(replace(word, chr(1072), '')))::BIGINT AS letters, 'a' AS "like" FROM w GROUP BY 1 HAVING sum(length(word) - length(replace(word, chr(1072), ''))) > 0""",
    "transform_trim": "SELECT o_orderkey AS id, 'a' || chr(9) || ' b ' || chr(10) || o_orderkey AS value FROM orders",
    "transform_date_bounds": "SELECT o_orderkey AS id, ['v 1.2.2024', 'x123.04.20245', '2024-04-03', 'a 2024-05-06T10', 'none'][o_orderkey % 5 + 1] AS value FROM orders",
    "parse_datetime_offsets": "SELECT o_orderkey AS id, ['2024-01-15 10:00:00', '2024-01-15 07:00:00', '2024-01-16 01:00:00', '2024-01-15 00:00:00', '2024-01-15 10:00:00', NULL][o_orderkey % 6 + 1] AS value FROM orders",
    "transform_ws": "SELECT o_orderkey AS id, 'a b ' || o_orderkey AS value FROM orders",
    "transform_regex": "SELECT o_orderkey AS id, o_orderkey::VARCHAR AS value FROM orders",
    "transform_number": f"WITH {PRICED} SELECT id, CASE id % 3 WHEN 0 THEN (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') WHEN 1 THEN '1234.' || lpad((cents % 100)::VARCHAR, 2, '0') ELSE '1' || lpad((cents % 1000)::VARCHAR, 3, '0') || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS value FROM priced",
    "transform_date": f"WITH {PRICED} SELECT id, day AS value FROM priced",
    "parse_number": f"WITH {PRICED} SELECT id, CASE id % 3 WHEN 0 THEN round(((cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0'))::DOUBLE, 4) END AS value FROM priced",
    "parse_datetime": f"WITH {PRICED} SELECT id, CASE WHEN day <> 'soon' THEN regexp_extract(day, '[0-9-]{{10}}') END AS value FROM priced",
    "parse_bool": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS value FROM orders",
    "rename_plan": f"WITH {PLAN} SELECT * FROM plan",
    "rename_numbering": f"WITH {FILES} SELECT id, CASE WHEN i * 3 - 2 < 0 THEN '-' ELSE '' END || lpad(abs(i * 3 - 2)::VARCHAR, greatest(4, length(abs(i * 3 - 2)::VARCHAR))::INT, '0') || '_' || stem || ext AS new_name FROM parts",
    "rename_validate": f"WITH {FILES} SELECT id, unnest({SQL_PROBLEMS.format('name')}) AS problem FROM files",
    "rename_conflict_members": f"""WITH {FILES}, g AS (SELECT lower(name) AS folded, count(DISTINCT name) > 1 AS case_only, min_by(name, id) AS shown FROM files GROUP BY 1 HAVING count(*) >= 2)
        SELECT id, folded, name AS old_name, name AS new_name, case_only, shown FROM files JOIN g ON lower(name) = folded""",
    "unicode_characters": f"""WITH {PLANTED}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM planted),
        k AS (SELECT doc_id, pos, ch, CASE {" ".join(f"WHEN regexp_matches(ch, '{p}') THEN '{k}'" for k, p in SQL_KINDS.items())} END AS kind FROM c)
        SELECT doc_id, pos::INT AS pos, printf('U+%04X', ord(ch)) AS codepoint, kind, CASE WHEN kind IN ('zero_width', 'bidi_control', 'replacement_char', 'control') THEN 'alert' WHEN kind = 'combining_mark' THEN 'info' ELSE 'warn' END AS severity FROM k WHERE kind IS NOT NULL""",
    "rename_conflicts": f"WITH {FILES} SELECT lower(name) AS folded, count(*) AS rows, count(DISTINCT name) AS spellings, count(DISTINCT name) > 1 AS case_only FROM files GROUP BY 1 HAVING count(*) >= 2",
    "rename_checked": f"""WITH {PLAN}, c AS (SELECT lower(new_name) AS folded FROM plan GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT id, new_name, {SQL_PROBLEMS.format('new_name')} AS problems, lower(new_name) IN (SELECT folded FROM c) AS clash FROM plan)
        SELECT *, NOT clash AND len(problems) = 0 AS valid FROM p""",
    "rename_summary": f"""WITH {PLAN}, c AS (SELECT count(*) AS conflicts FROM (SELECT lower(new_name) FROM plan GROUP BY 1 HAVING count(*) >= 2)),
        t AS (SELECT count(*) AS total, count(*) FILTER (name <> new_name) AS changed, count(*) FILTER (len({SQL_PROBLEMS.format('new_name')}) > 0) AS errors FROM plan)
        SELECT *, errors = 0 AND conflicts = 0 AS valid FROM t, c""",
}
