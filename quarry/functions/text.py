"""Text functions as Column builders; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed as X


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def indices(last: Column, first: int = 1) -> Column:
    """``first`` .. ``last``; none if ``last`` is smaller (a bare sequence would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def tokens(text: Column) -> Column:
    """Retrieval tokens: dotted numbers whole, each followed by its prefixes of two and more parts."""

    def with_prefixes(t: Column) -> Column:
        bits = F.split(t, r"\.")
        prefixes = F.transform(indices(F.size(bits) - 1, 2), lambda n: F.array_join(F.slice(bits, F.lit(1), n), "."))
        # Few tokens have a dot; the others are not split.
        return F.when(F.contains(t, F.lit(".")), F.concat(F.array(t), prefixes)).otherwise(F.array(t))

    return F.flatten(F.transform(matches(text, X.TOKEN), with_prefixes))


def content_words(text: Column) -> Column:
    stop = F.array(*map(F.lit, X.STOPWORDS))
    return F.filter(matches(text, X.CONTENT), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def words(text: Column) -> Column:
    return matches(text, X.WORD)


def shingles(w: Column, n: int = 3) -> Column:
    """Distinct ``n``-word shingles of an array of words, joined by a space."""
    return let(w, lambda v: F.array_distinct(F.transform(indices(F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, F.lit(n)), " "))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared members by the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(F.lit(0.0))


def strip_invisible(text: Column) -> Column:
    """Deletes zero-width characters, byte-order marks and soft hyphens; odd spaces and tabs become spaces."""
    odd = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    return F.translate(text, odd + "\u200b\u200c\u200d\u2060\ufeff\u00ad", " " * len(odd))


def tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, " {2,}", " "))


def flat(text: Column) -> Column:
    """Any run of white space is one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def lead(text: Column) -> Column:
    return F.get(F.split(flat(text), r"(?<=[.!?])\s+"), F.lit(0))


def body_text(text: Column) -> Column:
    """Without the label line, if there is one."""
    return F.when(text.startswith("[") & (F.instr(text, "\n") > 0), F.substring(text, F.locate("\n", text) + 1, F.length(text))).otherwise(text)


def locator(text: Column) -> Column:
    """A citation with cosmetic differences gone: dashes, white space, outer brackets and stops."""
    t = F.regexp_replace(F.regexp_replace(text, "–", "—"), r"\s+-\s+", " — ")
    t = flat(F.regexp_replace(t, r"\s*—\s*", " — "))
    t = F.trim(F.btrim(F.trim(F.btrim(t, F.lit("()"))), F.lit(".,;")))
    return F.regexp_replace(t, r"p\.\s+", "p.")


def cited_locators(text: Column) -> Column:
    """Locators of every citation in round brackets, split at semicolons, in order."""
    inner = F.regexp_extract_all(text, F.lit(X.PARENTHETICAL), 1)
    pieces = F.flatten(F.transform(inner, lambda p: F.split(p, ";")))
    return F.filter(F.transform(pieces, locator), lambda p: p.rlike(X.CITATION))


def unsupported(text: Column, allowed: Column) -> Column:
    return F.array_except(F.array_distinct(cited_locators(text)), allowed)


def citation(title: Column, article: Column, page: Column) -> Column:
    """``(Title — Article n, p.k)``, or without the article."""
    a = F.trim(F.coalesce(article, F.lit("")))
    return F.when(a != "", F.format_string("(%s — Article %s, p.%d)", title, a, page)).otherwise(F.format_string("(%s — p.%d)", title, page))


def finding_cite(title: Column, article: Column, page: Column) -> Column:
    a = F.trim(F.coalesce(article, F.lit("")))
    return F.when(a != "", F.format_string("%s (Article %s, p.%d)", title, a, page)).otherwise(F.format_string("%s (p.%d)", title, page))


def context_label(title: Column, article: Column, heading: Column, part: Column) -> Column:
    """``[Title · Article part § n — heading]``; without an article ``[Title · heading]``."""
    number = F.when(part != "", F.concat(part, F.lit(" § "), article)).otherwise(article)
    tail = F.when(article != "", F.concat(F.lit("Article "), number, F.when(heading != "", F.concat(F.lit(" — "), heading)).otherwise(""))).otherwise(heading)
    return F.concat(F.lit("["), title, F.when(tail != "", F.concat(F.lit(" · "), tail)).otherwise(""), F.lit("]"))


def article_key(article: Column) -> Column:
    """Sorts 2.9 before 2.10, and lettered articles after plain ones."""
    letter = F.regexp_extract(article, "^([A-Za-z]?)", 1)
    numbers = F.transform(F.regexp_extract_all(article, F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    return F.struct((letter != "").cast("int").alias("lettered"), letter.alias("letter"), numbers.alias("numbers"))


def article_parent(article: Column) -> Column:
    return F.when(F.instr(article, ".") > 0, F.regexp_replace(article, r"\.[^.]*$", ""))


def normalise_date(raw: Column) -> Column:
    """ISO dates as they are, ``d Mon yyyy`` by the month's first three letters, as the whole text but for spaces around it and stops at its end; anything else is null.

    Days are not checked against the calendar: a date is what was published.
    """
    x = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"\.+$", "")
    spelled = r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{4})$"
    day, month, year = (F.regexp_extract(x, spelled, k) for k in (1, 2, 3))
    at = F.array_position(F.array(*map(F.lit, X.MONTHS)), F.lower(month))
    told = F.when(at > 0, F.concat(year, F.lit("-"), F.lpad(at.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).otherwise(told)


def month_first_date(raw: Column) -> Column:
    """``July 17, 2026`` as an ISO date."""
    month, day, year = (F.regexp_extract(raw, r"([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),\s*(\d{4})", k) for k in (1, 2, 3))
    at = F.array_position(F.array(*map(F.lit, X.MONTHS)), F.lower(month))
    return F.when(at > 0, F.concat(year, F.lit("-"), F.lpad(at.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))


def url_content_hash(url: Column) -> Column:
    """The parts of the file's stem that are eight or more hexadecimal digits; without any, ``u`` and a digest of the url."""
    name = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "_"), lambda p: p.rlike("^[0-9a-fA-F]{8,}$"))
    return F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(F.concat(F.lit("u"), F.substring(F.sha1(url.cast("binary")), 1, 16)))
