"""Names of books in prose: derived aliases, ambiguity, and matching."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed as X

#: Names of one automaton.
MOST_NAMES = 100_000
_WORD, _TOKENS = re.compile(r"[a-z0-9]"), re.compile(r"[a-z0-9]+|[^a-z0-9]+")


def slugify(text: Column) -> Column:
    """Compatibility decomposition, lower case, runs of anything but a-z and 0-9 one space."""

    @F.pandas_udf("string")
    def decomposed(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))

    return F.trim(F.regexp_replace(F.lower(decomposed(text)), "[^a-z0-9]+", " "))


def unambiguous(aliases: DataFrame) -> DataFrame:
    """(slug, alias) without the aliases that several books carry."""
    own = aliases.distinct()
    single = own.groupBy("alias").agg(F.count("*").alias("n")).where("n = 1").select("alias")
    return own.join(single, "alias", "left_semi").select("slug", "alias")


def derived(books: DataFrame) -> DataFrame:
    """(slug, alias) of the names that books (slug, title, doc_title, detail_url) go by.

    Slug, title and document title, the tail of a page under ``/rulebooks/``,
    and the parts of the slug that are no stop word and not another book's whole
    slug; all of three letters or more, none a stop word alone.  Nulls name nothing.
    """
    tail = F.when(F.col("detail_url").contains("/rulebooks/"), F.substring_index(F.rtrim("detail_url", F.lit("/")), "/", -1))
    whole = books.select("slug", F.explode(F.array_compact(F.array("slug", "title", "doc_title", tail))).alias("name")).select("slug", slugify(F.col("name")).alias("alias"))
    parts = books.select("slug", F.explode(F.split(F.lower("slug"), "[^a-z0-9]+")).alias("alias")).where(~F.col("alias").isin(*X.ALIAS_STOPWORDS))
    others = books.select(F.col("slug").alias("owner"), F.col("slug").alias("alias")).distinct()
    foreign = parts.alias("p").join(F.broadcast(others).alias("o"), (F.col("p.alias") == F.col("o.alias")) & (F.col("p.slug") != F.col("o.owner")), "left_anti")  # a row a book
    every = whole.unionByName(foreign.select("slug", "alias"))
    return every.where((F.length("alias") >= X.ALIAS_MIN) & ~F.col("alias").isin(*X.ALIAS_STOPWORDS)).distinct()


class Phrases:
    """Aho-Corasick automaton over the tokens of many phrases: all of them are found in one pass over a text.

    Tokens are runs of letters and digits, and what lies between such runs, so
    a phrase that begins and ends with a letter or digit is found as whole
    words alone.  Phrases that do not are few, and looked for one by one.
    """

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.follow: list[dict[str, int]] = [{}]
        self.told: list[list[tuple[str, str]]] = [[]]
        self.odd: list[tuple[str, re.Pattern]] = []
        for slug, name in sorted(set(names)):
            tokens = _TOKENS.findall(name)
            if tokens and _WORD.match(tokens[0]) and _WORD.match(tokens[-1]):
                self._add(tokens, slug, name)
            else:
                self.odd.append((slug, re.compile(rf"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])")))
        self._link()

    def _add(self, tokens: list[str], slug: str, name: str) -> None:
        state = 0
        for t in tokens:
            if t not in self.follow[state]:
                self.follow[state][t] = len(self.follow)
                self.follow.append({})
                self.told.append([])
            state = self.follow[state][t]
        self.told[state].append((slug, name))

    def _link(self) -> None:
        """To each state the longest proper end of it that is a state, and the phrases that end there too."""
        self.back, layer = [0] * len(self.follow), list(self.follow[0].values())
        while layer:
            below = []
            for state in layer:
                for t, after in self.follow[state].items():
                    k = self.back[state]
                    while k and t not in self.follow[k]:
                        k = self.back[k]
                    self.back[after] = self.follow[k].get(t, 0)
                    self.told[after] = self.told[after] + self.told[self.back[after]]
                    below.append(after)
            layer = below

    def found(self, text: str) -> set[tuple[int, int, str]]:
        """(start, end, slug) of the phrases in a lower-case text; one phrase's own occurrences do not overlap."""
        hits, ends, state, at = set(), {}, 0, 0
        for t in _TOKENS.findall(text):
            at += len(t)
            while state and t not in self.follow[state]:
                state = self.back[state]
            state = self.follow[state].get(t, 0)
            for slug, name in self.told[state]:
                start = at - len(name)
                if start >= ends.get((slug, name), 0):
                    ends[slug, name] = at
                    hits.add((start, at, slug))
        hits.update((m.start(), m.end(), slug) for slug, pattern in self.odd for m in pattern.finditer(text))
        return hits


def outermost(hits: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without those that lie within a longer one of another book, in order; one pass over them by start."""
    out, reach = [], []  # the two farthest ends so far, of two books
    groups: dict[tuple[int, int], list[str]] = {}
    for start, end, slug in hits:
        groups.setdefault((start, -end), []).append(slug)
    for (start, back), slugs in sorted(groups.items()):
        end = -back
        out += [(start, end, s) for s in slugs if not any(o != s and far >= end for far, o in reach)]
        for s in slugs:
            best = max([end, *(far for far, o in reach if o == s)])
            reach = sorted([(best, s), *(r for r in reach if r[1] != s)], reverse=True)[:2]
    return sorted(out)


_HITS = "array<struct<start:int,end:int,slug:string>>"


def _told(hits: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": a, "end": b, "slug": s} for a, b, s in hits]


def _finder(automaton: Phrases, alone: bool):
    @F.pandas_udf(_HITS)
    def found(text: pd.Series) -> pd.Series:
        each = (automaton.found((t or "").lower()) for t in text)
        return pd.Series([_told(outermost(h) if alone else sorted(h)) for h in each])

    return found


def phrase_hits(texts: DataFrame, aliases: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(id, start, end, slug) of whole-word phrases in texts (id, text), each id once; one within a longer one of another book goes.

    ``aliases``: (slug, alias), in lower case.  ``most`` names make one
    automaton, which every task gets; more are taken slice by slice, and what
    each slice finds in a text is put together.
    """
    names = aliases.select("slug", "alias").where("slug is not null and alias <> ''").distinct()
    slices = max(1, -(-names.count() // most))
    parts = None
    for k in range(slices):
        rows = names.where(F.pmod(F.xxhash64("slug", "alias"), F.lit(slices)) == k).collect()  # about ``most`` rows
        automaton = Phrases([(r["slug"], r["alias"]) for r in rows])
        part = texts.select("id", _finder(automaton, slices == 1)("text").alias("h"))
        parts = part if parts is None else parts.unionByName(part)
    if slices > 1:

        @F.pandas_udf(_HITS)
        def kept(hits: pd.Series) -> pd.Series:
            return hits.map(lambda h: _told(outermost({(x["start"], x["end"], x["slug"]) for x in h})))

        parts = parts.groupBy("id").agg(F.flatten(F.collect_list("h")).alias("h")).select("id", kept("h").alias("h"))
    return parts.select("id", F.explode("h").alias("h")).select("id", "h.*")


def mismatch(mentioned: Column, searched: Column) -> Column:
    """Books that a question mentions and that were not searched; the global one is always searched."""
    return F.array_sort(F.array_except(F.array_except(mentioned, searched), F.array(F.lit("global"))))


def misattribution(asked: Column, said: Column, searched: Column) -> Column:
    """Books that were not searched, named by the question and by the answer's prose."""
    return F.array_sort(F.array_intersect(mismatch(asked, searched), mismatch(said, searched)))


def named_titles(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, slug): books of which a variant's words are all in the text; a book goes if another matched strictly more.

    ``texts``: (id, words); ``variants``: (slug, words), a short list that is broadcast.
    """
    v = variants.select("slug", F.array_sort(F.array_distinct("words")).alias("v"))
    first = v.withColumn("w", F.get("v", F.lit(0)))
    # A text meets the variants by one of their words, not all of them by all.
    hits = texts.select("id", "words", F.explode(F.array_distinct("words")).alias("w")).join(F.broadcast(first), "w").where(F.size(F.array_except("v", "words")) == 0)
    best = hits.groupBy("id", "slug").agg(F.max_by("v", F.size("v")).alias("v"))
    a, b = best.alias("a"), best.alias("b")
    larger = (F.col("a.id") == F.col("b.id")) & (F.col("a.slug") != F.col("b.slug")) & (F.size("a.v") < F.size("b.v")) & (F.size(F.array_except("a.v", "b.v")) == 0)
    return a.join(b, larger, "left_anti").select("id", "slug")


def phrase_matches(text: str, aliases: dict[str, list[str]]) -> list[tuple[int, int, str]]:
    """(start, end, slug) of whole-word phrases in one lower-case text; one inside a longer one of another book goes."""
    return outermost(Phrases([(slug, n) for slug, names in aliases.items() for n in names]).found(text))
