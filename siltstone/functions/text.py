"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space as a character class; Java's \s knows ASCII only
SPACE = r"[\t-\r\x1c-\x20\x85   -     　]"
POINT_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of name-based ids
ENTITY_QUESTION = r"(?i)^(who is|what is|what are|who are|define|describe|explain)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def title_and_body(title: Column, body: Column, stripped: bool = True) -> Column:
    """title, blank line, body; the body alone where there is no title."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    if stripped:
        t, b = strip(t), strip(b)
    return F.when(t != "", F.concat_ws("\n\n", t, b)).otherwise(b)


def plain_sentences(text: Column) -> Column:
    """Array of pieces after . ! ? and white space, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"(?<=[.!?]){SPACE}+"), strip), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """The default token counter: white-space words. Additive over joins with white space."""
    return F.size(words(text))


def lex_tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case runs of a-z and 0-9 of at least `least` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda x: F.length(x) >= least))


def lex_overlap(claim: Column, *fields: Column) -> Column:
    """How many distinct tokens of the claim occur in the strings of the array columns; blank and null strings are skipped."""
    each = [F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))) for f in fields]
    return F.size(F.array_intersect(lex_tokens(claim), lex_tokens(F.array_join(F.concat(*each), " "))))


def lex_ratio(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 where either is empty."""
    x, y = lex_tokens(a, 1), lex_tokens(b, 1)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def norm_id(x: Column) -> Column:
    """'' for null and blank; the number of all digits where there are any; else lower case."""
    t = strip(F.coalesce(x, F.lit("")))
    digits = F.regexp_replace(t, r"[^0-9]", "")
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits != "", number).otherwise(F.lower(t))


def signature(chunk_id: Column, text: Column) -> Column:
    return F.concat(chunk_id, F.lit(":"), F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, 12))


def point_id(name: Column) -> Column:
    """Name-based id (version 5) of a string in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def first_lines(text: Column, n: int = 3) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x) != "")
    return F.array_join(F.slice(lines, 1, n), "\n")


def entity_terms(query: Column) -> Column:
    """Terms asked for by a who-is or define question; none for other questions."""
    q = strip(F.coalesce(query, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(q, ENTITY_QUESTION, ""), r"[?., ]+$", "")
    found = F.filter(words(F.lower(rest)), lambda x: F.length(x) >= 2)
    return F.when(q.rlike(ENTITY_QUESTION), found).otherwise(F.array().cast("array<string>"))


def single_line(text: Column) -> Column:
    """White space made one, a quotation mark at either end removed."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))
    return strip(F.regexp_replace(t, "^[\"']|[\"']$", ""))


def doc_id_list(doc_ids: Column, doc_id: Column | None = None) -> Column:
    """doc_ids as strings; else the single doc_id; else an empty list."""
    none = F.array().cast("array<string>")
    many = F.when(F.size(doc_ids) > 0, doc_ids.cast("array<string>"))
    return F.coalesce(many, F.when(doc_id.isNotNull(), F.array(doc_id.cast("string"))), none) if doc_id is not None else F.coalesce(many, none)


def topic_label(topic: Column, terms: Column) -> Column:
    named = F.array_join(F.slice(terms, 1, 4), " | ")
    return F.when(topic == -1, "outlier").when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.concat(F.lit("topic_"), topic.cast("string"))).otherwise(named)


def chunk_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.when(number < 100000, F.lpad(number.cast("string"), 5, "0")).otherwise(number.cast("string")))
