"""Unicode forensics and cleaning, and declarative text transforms, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The first engine's classes of characters, as regular-expression ranges; the first that fits wins.
KINDS = {
    "zero_width": "\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{180E}",
    "bidi_control": "\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}",
    "exotic_space": "\\x{A0}\\x{2000}-\\x{2007}\\x{2009}\\x{200A}\\x{202F}\\x{3000}\\x{1680}",
    "soft_hyphen": "\\x{AD}",
    "replacement_char": "\\x{FFFD}",
    "control": "\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}",
    "format_control": "\\p{Cf}",
    "private_use": "\\p{Co}",
    "combining_mark": "\\p{M}",
}
#: How grave a character of each kind is.
SEVERITY = {
    "zero_width": "alert", "bidi_control": "alert", "replacement_char": "alert", "control": "alert", "exotic_space": "warn", "soft_hyphen": "warn",
    "format_control": "warn", "private_use": "warn", "combining_mark": "info",
}
INVISIBLE = "".join(KINDS[k] for k in ("zero_width", "bidi_control", "soft_hyphen", "control"))
#: The second engine's classes and what cleaning does with them.
ACTIONS = {
    "bom": ("\\x{FEFF}", "remove"), "zero_width": ("\\x{200B}-\\x{200D}\\x{2060}", "remove"), "bidi": ("\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200E}\\x{200F}", "remove"),
    "soft_hyphen": ("\\x{AD}", "remove"), "nbsp": ("\\x{A0}", "space"), "unusual_space": ("\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1680}", "space"),
    "smart_quote": ("\\x{2018}\\x{2019}\\x{201C}\\x{201D}", "keep"), "dash": ("\\x{2013}\\x{2014}", "keep"), "control": ("\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}", "remove"),
}


def only(kind: str) -> str:
    """A pattern for characters of a kind and of none before it."""
    if kind not in ("format_control", "private_use", "combining_mark"):
        return f"[{KINDS[kind]}]"
    return f"[{KINDS[kind]}&&[^{INVISIBLE}]]"


def count_kinds(c: Column) -> dict[str, Column]:
    """How many characters of each kind a text holds."""
    return {k: F.regexp_count(c, F.lit(only(k))) for k in KINDS}


def status(c: Column) -> Column:
    """The gravest severity of the characters of a text."""
    worst = lambda s: F.greatest(*[F.regexp_count(c, F.lit(only(k))) for k, v in SEVERITY.items() if v == s], F.lit(0)) > 0
    return F.when(worst("alert"), "alert").when(worst("warn"), "warn").when(worst("info"), "info").otherwise("ok")


def characters(c: Column) -> Column:
    """array<struct<pos, codepoint, kind, severity>> of the characters of a text that have a kind, by place from 0."""
    some = F.lit("[" + "".join(KINDS.values()) + "]")
    each = F.filter(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch"))), lambda x: F.regexp_like(x["ch"], some))

    def told(x: Column) -> Column:
        kind = F.coalesce(*(F.when(F.regexp_like(x["ch"], F.lit(only(k))), k) for k in KINDS))
        code = F.conv(F.hex(F.encode(x["ch"], "UTF-32")), 16, 16)
        return F.struct(x["pos"].alias("pos"), F.concat(F.lit("U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code)).alias("codepoint"), kind.alias("kind"))

    graded = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return F.transform(F.transform(each, told), lambda x: F.struct(x["pos"].alias("pos"), x["codepoint"].alias("codepoint"), x["kind"].alias("kind"), graded[x["kind"]].alias("severity")))


def second_kind(ch: Column) -> Column:
    """The second engine's kind of one character, or null."""
    out = F.lit(None).cast("string")
    for kind, (chars, _) in reversed(ACTIONS.items()):
        out = F.when(ch.rlike(f"[{chars}]"), kind).otherwise(out)
    return out


def issues(c: Column) -> Column:
    """array<struct<pos, ch, kind, action>> of the second engine's characters to look at; text is split once."""
    marked = F.transform(F.split(c, ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch")))
    every = "".join(chars for chars, _ in ACTIONS.values())
    found = F.filter(marked, lambda x: x["ch"].rlike(f"[{every}]"))
    action = F.create_map(*[F.lit(x) for k, (_, a) in ACTIONS.items() for x in (k, a)])
    return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["ch"].alias("ch"), second_kind(x["ch"]).alias("kind"), F.element_at(action, second_kind(x["ch"])).alias("action")))


def mixed_words(c: Column) -> Column:
    """Words of two characters or more that mix Latin and Cyrillic letters."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]{2,})"), 1)
    return F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"\p{IsCyrillic}"))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalized(c: Column, form: str) -> Column:
    """One of the four normal forms; Spark has no function for them."""
    if form not in FORMS:
        raise ValueError(f"unknown normal form: {form}")
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize(form, t)), StringType())(c)


def forms(c: Column) -> Column:
    """array<struct<form, length, bytes, changes>>: what each normal form would make of a text."""
    each = [(f, normalized(c, f)) for f in FORMS]
    return F.array(*[F.struct(F.lit(f).alias("form"), F.length(t).alias("length"), F.octet_length(t).alias("bytes"), (t != c).alias("changes")) for f, t in each])


def names(c: Column) -> Column:
    """The Unicode names of a text's characters, in order; <control> and the like where there is none."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else [unicodedata.name(x, f"<{unicodedata.category(x)}>") for x in t]), ArrayType(StringType()))(c)


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no function for it."""
    return F.pandas_udf(_composed, StringType())(c)


def spaced(c: Column) -> Column:
    """Invisible characters out, exotic spaces to spaces, trimmed; not yet composed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{KINDS['exotic_space']}]", " "), r"(?U)^\s+|\s+$", "")


def clean_copy(c: Column) -> Column:
    """The second engine's cleaning: remove, or space; no blanks at line ends, no newlines at the edges."""
    chars = lambda action: "".join(x for x, a in ACTIONS.values() if a == action)
    t = F.regexp_replace(F.regexp_replace(c, f"[{chars('remove')}]", ""), f"[{chars('space')}]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+(\n|$)", "$1"), r"^\n+|\n+$", "")


def escape(c: Column) -> Column:
    """Every character beyond ASCII as a backslash, u or U, and hex digits."""
    code = lambda ch: F.when(F.ascii(ch) > 0xFFFF, F.format_string("\\U%08x", F.ascii(ch))).otherwise(F.format_string("\\u%04x", F.ascii(ch)))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when((F.ascii(ch) < 128), ch).otherwise(code(ch))), "")


def changes(c: Column) -> Column:
    """array<struct<pos, ch, kind, action>>: what clean_copy() removes from a text or replaces in it."""
    return F.filter(issues(c), lambda x: x["action"] != "keep")


#: Letters that look alike, Cyrillic and Latin.
CYRILLIC = "абвеёкмнорстухѕіјԁһАВЕЁКМНОРСТУХЅІЈ"
LOOKS_LATIN = "a6BeekMHopcTyxsijdhABEEKMHOPCTYXSIJ"
LATIN = "aeopcxyABEKMHOPCTX"
LOOKS_CYRILLIC = "аеорсхуАВЕКМНОРСТХ"


def look_alikes(word: Column) -> Column:
    """array<struct<pos, ch, looks_like>> of a word's letters that look like one of the other script."""
    known = F.create_map(*[F.lit(x) for a, b in ((CYRILLIC, LOOKS_LATIN), (LATIN, LOOKS_CYRILLIC)) for pair in zip(a, b, strict=True) for x in pair])
    marked = F.transform(F.split(word, ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch"), F.element_at(known, ch).alias("looks_like")))
    return F.filter(marked, lambda x: x["looks_like"].isNotNull())


def report(c: Column) -> Column:
    """struct<status, length, bytes, is_nfc, kinds, mixed>: a text's gravest severity, sizes, counts by kind of its suspicious characters, and mixed-script words."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in count_kinds(c).items()]), lambda x: x["n"] > 0)
    mixed = mixed_words(c)
    grave = F.when((F.size(mixed) > 0) & status(c).isin("ok", "info"), "warn").otherwise(status(c))
    return F.struct(grave.alias("status"), F.length(c).alias("length"), F.octet_length(c).alias("bytes"), (nfc(c) == c).alias("is_nfc"), found.alias("kinds"), mixed.alias("mixed"))


def reversible_escape(c: Column) -> Column:
    """Printable ASCII as it is, a backslash doubled, every other character as backslash, u or U, and hex digits."""
    code = lambda ch: F.when(F.ascii(ch) > 0xFFFF, F.format_string("\\U%08x", F.ascii(ch))).otherwise(F.format_string("\\u%04x", F.ascii(ch)))
    one = lambda ch: F.when(ch == "\\", "\\\\").when(F.ascii(ch).between(0x20, 0x7E), ch).otherwise(code(ch))
    return F.when(F.length(c) == 0, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def unescape(c: Column) -> Column:
    """The text that reversible_escape() made this of. Spark has no function from a number to any character."""
    plain = lambda t: re.sub(r"\\(\\|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})", lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), t)
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else plain(t)), StringType())(c)


def differences(left: Column, right: Column, limit: int = 50) -> Column:
    """Places at which two texts differ, at most `limit` of them."""
    pairs = F.arrays_zip(F.split(left, "").alias("l"), F.split(right, "").alias("r"))
    marked = F.transform(pairs, lambda x, i: F.struct(i.alias("pos"), x["l"].alias("l"), x["r"].alias("r")))
    return F.slice(F.filter(marked, lambda x: ~x["l"].eqNullSafe(x["r"])), 1, limit)


def trim(c: Column) -> Column:
    """Without white space of any kind at the edges."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def regex(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or the empty text."""
    return F.regexp_extract(c, pattern, group)


def number(c: Column) -> Column:
    """The first number as text: of comma and point the right-most is the decimal point; a comma alone is one too."""
    raw = F.regexp_replace(F.regexp_extract(c, r"(?U)-?\d[\d\s.,]*", 0), r"(?U)\s", "")
    comma, point = F.length(raw) - F.instr(F.reverse(raw), ","), F.length(raw) - F.instr(F.reverse(raw), ".")
    has = lambda ch: raw.contains(ch)
    both = F.when(comma > point, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    return F.when(has(",") & has("."), both).when(has(","), F.replace(raw, F.lit(","), F.lit("."))).otherwise(raw)


def date(c: Column) -> Column:
    """The first ISO or day-month-year date of whole numbers as ISO text, else the trimmed text."""
    iso, parts = r"(?U)\b(\d{4}-\d{2}-\d{2})\b", r"(?U)\b(\d{2})[./](\d{2})[./](\d{4})\b"
    part = lambda i: F.regexp_extract(c, parts, i)
    return F.when(c.rlike(iso), F.regexp_extract(c, iso, 1)).when(c.rlike(parts), F.concat_ws("-", part(3), part(2), part(1))).otherwise(trim(c))
