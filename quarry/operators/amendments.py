"""Notices that amend books: sections, quoted rules, targets, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.structure import split_text

#: Characters before and after an article's number in which a book's words may stand, and the most a notice holds unsplit.
BEFORE, AFTER, CAP = 120, 160, 6000
ARTICLE = re.compile(r"\b(?:Article|Section)\s+([A-Za-z]?\d{1,2}(?:\.\d{1,2}){0,4})\b", re.I)


def sections(body: str) -> list[tuple[str, str]]:
    """(heading, text) of a markdown body; what precedes the first heading stands under an empty one."""
    out, heading, held = [], "", []
    for line in body.splitlines():
        if m := re.match(r"#{1,6}\s+(.*)", line):
            out.append((heading, "\n".join(held).strip()))
            heading, held = m[1].strip(), []
        else:
            held.append(line)
    out.append((heading, "\n".join(held).strip()))
    return [s for s in out if s[0] or s[1]]


def quoted_rule(body: str, wanted: str) -> str:
    """Quotes of 40 to 2000 characters in the first section whose heading matches and that has any."""
    for heading, text in sections(body):
        found = re.findall(r"[\"“]([^\"“”]{40,2000})[\"”]", text)
        if found and re.search(wanted, heading, re.I):
            return "\n".join(f.strip() for f in found)
    return ""


def targets(text: str, books: Iterable[tuple[str, frozenset[str]]]) -> list[tuple[str, str]]:
    """(game, article) for each article number with all words of a book's name near it; in order, once each."""
    out: list[tuple[str, str]] = []
    for m in ARTICLE.finditer(text):
        near = set(re.findall("[a-z0-9]+", text[max(0, m.start() - BEFORE) : m.end() + AFTER].lower()))
        for game, words in books:
            if words and words <= near and (game, m[1]) not in out:
                out.append((game, m[1]))
    return out


def amendment_targets(notices: DataFrame, books: list[tuple[str, list[str]]]) -> DataFrame:
    """(notice_id, game, article) of every notice (notice_id, text); ``books`` is the short list of names."""
    known = [(game, frozenset(words)) for game, words in books]

    @F.pandas_udf("array<struct<game:string,article:string>>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"game": g, "article": a} for g, a in targets(t or "", known)])

    return notices.select("notice_id", F.explode(found("text")).alias("t")).select("notice_id", "t.*")


def amendment_chunks(notices: DataFrame, aimed: DataFrame, cap: int = CAP) -> DataFrame:
    """One chunk per notice and target; a notice of more than ``cap`` characters is split."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [t or ""] if len(t or "") <= cap else split_text(t, cap, 0))

    j = notices.join(aimed, "notice_id").select("notice_id", "game", "article", F.posexplode(pieces("text")).alias("n", "piece"))
    return j.withColumn("chunk_id", F.concat_ws(":", F.lit("amendment"), F.col("notice_id").cast("string"), "game", "article", F.col("n").cast("string")))


def status(body: Column, n_targets: Column) -> Column:
    """Why a notice is no amendment, or null."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "no body").when(n_targets == 0, "no target")


def headings_of(body: Column) -> Column:
    """Headings of a notice's sections, an empty one for what precedes the first."""

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [h for h, _ in sections(t or "")])

    return found(body)


def quoted_of(body: Column, wanted: str) -> Column:
    """The rule that a notice quotes: see :func:`quoted_rule`."""

    @F.pandas_udf("string")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: quoted_rule(t or "", wanted))

    return found(body)
