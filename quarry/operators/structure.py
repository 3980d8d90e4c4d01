"""Document structure: boilerplate, headings, contents listings, sequence, segments, chunks.

Counting and joining are DataFrame operations; the sequential scans over the
lines of one document run over its lines where they lie, in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X

LINE, ALONE, RUN_IN = re.compile(X.ARTICLE_LINE), re.compile(X.ARTICLE_ALONE), re.compile(X.RUN_IN, re.S)
ASIDE, BARE, LEADER = re.compile(X.ASIDE), re.compile(X.BARE_NUMBER), re.compile(X.DOT_LEADER)
PART, PART_ALONE = re.compile(X.PART, re.I), re.compile(X.PART_ALONE, re.I)


def strip_boilerplate(lines: DataFrame) -> DataFrame:
    """Lines (doc, line_no, page, pos, n_in_page, page_count, text) without running heads and feet.

    Goes: a line among the first or last three of a page whose lower-case text
    is there on max(4, half of the pages) pages or more; a bare number of at most
    four digits among the first or last two; leaders of four dots or more;
    titles of contents listings.
    """
    from_end = F.col("n_in_page") - 1 - F.col("pos")
    band = (F.col("pos") < X.BAND) | (from_end < X.BAND)
    key = F.lower("text")
    common = lines.where(band).groupBy("doc", key.alias("key")).agg(F.countDistinct("page").alias("pages"), F.max("page_count").alias("of")).where(F.col("pages") >= F.greatest(F.lit(X.LEAST_PAGES), F.floor(F.col("of") / 2))).select("doc", "key", F.lit(True).alias("running"))
    edge = (F.col("pos") < 2) | (from_end < 2)
    bare = edge & F.col("text").rlike(X.BARE_NUMBER)
    leader = F.col("text").rlike(X.DOT_LEADER)
    contents = F.lower(F.trim("text")).rlike(X.CONTENTS)
    j = lines.withColumn("key", key).join(common, ["doc", "key"], "left")
    return j.where(~(F.coalesce("running", F.lit(False)) & band) & ~bare & ~leader & ~contents).drop("key", "running")


@dataclass(frozen=True)
class Heading:
    """A heading at line ``at`` that takes ``lines`` lines; ``begun`` is what its line says after it."""

    at: int
    lines: int
    article: str
    title: str
    begun: str = ""


def heading_shape(text: str) -> bool:
    """Could the text be a title, whatever its case: 2 to 90 characters, two letters at least and 40 % of them, no dot leader, not an aside alone?"""
    letters = sum(map(str.isalpha, text))
    return 2 <= len(text) <= X.MAX_HEADING and letters >= max(2, 0.4 * len(text)) and not (LEADER.search(text) or ASIDE.match(text))


def plausible_heading(text: str) -> bool:
    """A title that begins with a capital, a quotation mark or a bracket."""
    return heading_shape(text) and (text[0].isupper() or text[0] in "“\"'(")


def unfinished(line: str) -> bool:
    """Does the line end in mid-sentence, so that the next one goes on with it?"""
    return line[-1:] not in ("", *".;:!?”\"'")


def plausible_subheading(text: str, article: str, before: str) -> bool:
    """Under a dotted number a title may begin as it likes, unless the line before the number is unfinished."""
    return "." in article and heading_shape(text) and not unfinished(before)


def run_in_heading(text: str) -> tuple[str, str] | None:
    """A leading sentence of at most twelve words that reads as a title, and what follows it."""
    m = RUN_IN.match(text)
    if m is None:
        return None
    title, begun = m[1].strip(), m[2].strip()
    return (title, begun) if len(title.split()) <= X.MOST_HEADING_WORDS and plausible_heading(title) else None


def titled(text: str, article: str, before: str) -> tuple[str, str] | None:
    """(title, what is begun after it) if the text heads the article: as a whole or, failing that, by its first sentence."""
    if plausible_heading(text) or plausible_subheading(text, article, before):
        return text, ""
    return run_in_heading(text)


class HeadingScan:
    """An automaton over the lines of one document that reports headings.

    Its state is the place, the line before it, and whether a line is used up:
    a line that a heading has taken starts none.  A number with text on its
    line is tried first, then a number alone with the line after it.
    """

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.at, self.before = lines, 0, ""

    def __iter__(self) -> Iterator[Heading]:
        while self.at < len(self.lines):
            found = self._here()
            if found:
                yield found
            self._pass(found.lines if found else 1)

    def _pass(self, n: int) -> None:
        self.at += n
        self.before = self.lines[self.at - 1]

    def _here(self) -> Heading | None:
        line = self.lines[self.at]
        if len(line) >= X.MAX_LINE or LEADER.search(line):
            return None
        for article, text, n in self._forms(line):
            if told := titled(text, article, self.before):
                return Heading(self.at, n, article, *told)
        return None

    def _forms(self, line: str) -> Iterator[tuple[str, str, int]]:
        if m := LINE.match(line):
            yield m[1], m[2].strip(), 1
        if (m := ALONE.match(line)) and self.at + 1 < len(self.lines):
            yield m[1] or m[2], self.lines[self.at + 1], 2


def heading_candidates(lines: list[str]) -> list[Heading]:
    """The headings of lines that are trimmed and not blank, scanning forward."""
    return list(HeadingScan(lines))


def article_key(article: str) -> tuple:
    """Orders 2.9 before 2.10; lettered articles come after plain ones."""
    letter = article[:1] if article[:1].isalpha() else ""
    return (1 if letter else 0, letter, *map(int, re.findall(r"\d+", article)))


def longest_increasing(keys: list) -> list[int]:
    """Indices of a longest strictly increasing subsequence: piles with the least last key, linked backwards."""
    tops: list = []
    at: list[int] = []
    link: list[int] = []
    for i, key in enumerate(keys):
        k = bisect_left(tops, key)
        link.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(key)
            at.append(i)
        else:
            tops[k], at[k] = key, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = link[i]
    return out[::-1]


def enforce_sequence(headings: list[Heading], parts: list[int]) -> list[Heading]:
    """Headings whose articles rise within their part; dotted ones stay whatever their order."""
    kept: set[int] = set()
    groups: dict[int, list[int]] = {}
    for k, h in enumerate(headings):
        groups.setdefault(bisect_right(parts, h.at), []).append(k)
    for members in groups.values():
        kept.update(members[j] for j in longest_increasing([article_key(headings[k].article) for k in members]))
    return [h for k, h in enumerate(headings) if k in kept or "." in h.article]


def heading_runs(lines: list[str], headings: list[Heading]) -> list[list[Heading]]:
    """Headings in runs without text between them; bare numbers are no text, nor is what a heading's own line begins."""
    runs: list[list[Heading]] = []
    open_run = False
    for h, after in zip(headings, [*(h.at for h in headings[1:]), len(lines)], strict=False):
        if open_run:
            runs[-1].append(h)
        else:
            runs.append([h])
        open_run = all(BARE.match(x) for x in lines[h.at + h.lines : after])
    return runs


def listed(run: list[Heading], headings: list[Heading]) -> list[Heading]:
    """The part of a run that is a contents listing: five or more, 60 % dotted, of which 35 % occur again after it.

    Where numbers start anew, what follows the last such place is text, unless it is as long as a listing itself.
    """
    anew = [k for k in range(1, len(run)) if article_key(run[k].article) <= article_key(run[k - 1].article)]
    if len(run) >= X.TOC_RUN_MIN and anew and len(run) - anew[-1] < X.TOC_RUN_MIN:
        run = run[: anew[-1]]
    if len(run) < X.TOC_RUN_MIN or sum("." in h.article for h in run) < 0.6 * len(run):
        return []
    again = {h.article for h in headings if h.at > run[-1].at}
    return run if sum(h.article in again for h in run) >= 0.35 * len(run) else []


def contents_lines(lines: list[str], headings: list[Heading]) -> set[int]:
    """Lines of contents listings: headings that a page number follows, those of listed runs, and the numbers after either."""

    def number_after(h: Heading) -> bool:
        return h.at + h.lines < len(lines) and BARE.match(lines[h.at + h.lines]) is not None

    gone = {h.at: h for run in heading_runs(lines, headings) for h in listed(run, headings)} | {h.at: h for h in headings if number_after(h)}
    return {x for h in gone.values() for x in range(h.at, h.at + h.lines + number_after(h))}


def part_marks(lines: list[str], first: int) -> dict[int, tuple[str, int]]:
    """Place of each appendix marker after the first heading to its label and how many lines it takes: its title is on its line, or alone on the next."""
    out = {}
    for i in range(first, len(lines)):
        line, title = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if len(line) > X.MAX_PART or ". " in line or line.endswith((",", ";")):
            continue
        label = re.sub(" {2,}", " ", line).rstrip(".")
        if PART.match(line):
            out[i] = label, 1
        elif PART_ALONE.match(line) and 3 <= len(title) <= X.MAX_PART_TITLE and (title[0].isupper() or title[0] in "“\"'(") and not (BARE.match(title) or LINE.match(title) or ALONE.match(title) or title.endswith((",", ";", "."))):
            out[i] = f"{label} - {title}", 2
    return out


def join_lines(begun: str, lines: list[str], pages: list[int], page: int) -> tuple[str, list[tuple[int, int]]]:
    """The body, and (offset in it, page) of each of its lines; what was begun on the heading's line comes first."""
    rows = [(begun, page)] if begun else []
    rows += [(t, p) for t, p in zip(lines, pages, strict=True) if t]
    offsets, at = [], 0
    for t, p in rows:
        offsets.append((at, p))
        at += len(t) + 1
    return "\n".join(t for t, _ in rows), offsets


def page_at(offsets: list[tuple[int, int]], at: int, page: int) -> int:
    """The page of the last line that begins at ``at`` or before it; ``page`` if none does."""
    k = bisect_right(offsets, at, key=lambda o: o[0])
    return offsets[k - 1][1] if k else page


def segments_of(lines: list[str], pages: list[int]) -> list[dict]:
    """Front matter, articles and appendix preambles of one document, with their pages and the offsets of their lines; blank lines are none."""
    held = [(t, p) for t, p in zip((x.strip() for x in lines), pages, strict=True) if t]
    lines = [t for t, _ in held]
    first = heading_candidates(lines)
    dead = contents_lines(lines, first)
    live = [i for i in range(len(lines)) if i not in dead]
    text, page = [lines[i] for i in live], [held[i][1] for i in live]
    # Places move as listings go, so headings are found again among what is left.
    found = heading_candidates(text) if dead else first
    parts = part_marks(text, found[0].at if found else len(text))
    starts = sorted(parts)
    found = enforce_sequence(found, starts)
    inside = {x for h in found for x in range(h.at, h.at + h.lines)}
    marks = sorted([(h.at, h.lines, h.article, h.title, h.begun) for h in found] + [(i, used, "", text[i], "") for i, (_, used) in parts.items() if i not in inside])
    if not marks or marks[0][0] > 0:
        marks.insert(0, (0, 0, "", "Front matter", ""))
    out = []
    for (at, used, article, heading, begun), end in zip(marks, [*(m[0] for m in marks[1:]), len(text)], strict=True):
        label = parts[starts[k - 1]][0] if (k := bisect_right(starts, at)) else ""
        own = page[at] if page else 1
        body, offsets = join_lines(begun, text[at + used : end], page[at + used : end], own)
        if article or body.strip():
            last = page[end - 1] if end > at + used else own
            out.append({"ordinal": len(out), "article": article, "heading": heading, "part": label, "body": body, "page": own, "page_end": last, "offsets": [{"at": a, "page": p} for a, p in offsets]})
    return out


SEGMENT = "ordinal int, article string, heading string, part string, body string, page int, page_end int, offsets array<struct<at:int,page:int>>"
_SEGMENT = pa.schema([("ordinal", pa.int32()), ("article", pa.string()), ("heading", pa.string()), ("part", pa.string()), ("body", pa.string()), ("page", pa.int32()), ("page_end", pa.int32()), ("offsets", pa.list_(pa.struct([("at", pa.int32()), ("page", pa.int32())])))])
#: Segments that are handed on at a time.
_BATCH = 1_000


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []

        def full() -> pa.RecordBatch:
            own = pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)
            return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(ids, pa.int64())), *own.columns], names=["doc", *own.schema.names])  # noqa: B023

        for i in range(batch.num_rows):
            lines = batch.column("lines")[i].as_py() or []
            found = segments_of([x["text"] or "" for x in lines], [x["page"] for x in lines])
            ids += [i] * len(found)
            rows += found
            if len(rows) >= _BATCH:
                yield full()
                ids, rows = [], []
        if rows:
            yield full()


def segment(docs: DataFrame) -> DataFrame:
    """Segments of every document (doc, lines: array of struct<text, page> in order), each where it lies: no row a line and no shuffle.

    A null text is an empty line.  A document without lines, or null, has no
    segment; rows with one id, or none, are documents of their own.
    """
    d = docs.select("doc", F.expr("transform(lines, x -> named_struct('text', cast(x.text as string), 'page', cast(x.page as int)))").alias("lines"))
    return d.mapInArrow(_segmented, f"doc {d.schema['doc'].dataType.simpleString()}, {SEGMENT}")


def paged_lines(text: Column, per_page: int) -> Column:
    """The lines of a text that has no pages of its own, ``per_page`` to a page."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("text"), (F.floor(i / per_page) + 1).cast("int").alias("page")))


def above(article: Column, itself: bool = True) -> Column:
    """The articles that a dotted number lies under, the outermost first."""
    bits = F.split(article, r"\.")
    n = F.size(bits) - (0 if itself else 1)
    return F.when((article != "") & (n > 0), F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(bits, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def breadcrumbs(segments: DataFrame) -> DataFrame:
    """(doc, ordinal, heading_path) of every segment: number and heading of each article above it and its own, by " > ".

    Of several segments with one number in a part the last one's heading
    counts.  Articles without a heading are left out; without any, the path is
    the segment's own heading.
    """
    named = segments.where("article <> ''").groupBy("doc", "part", F.col("article").alias("over")).agg(F.max_by("heading", "ordinal").alias("title")).where("title <> ''")
    up = segments.select("doc", "ordinal", "part", F.posexplode(above(F.col("article"))).alias("depth", "over"))
    paths = up.join(named, ["doc", "part", "over"]).groupBy("doc", "ordinal").agg(F.sort_array(F.collect_list(F.struct("depth", F.concat_ws(" ", "over", "title").alias("t"))))["t"].alias("path"))
    return segments.select("doc", "ordinal", "heading").join(paths, ["doc", "ordinal"], "left").select("doc", "ordinal", F.coalesce(F.nullif(F.array_join("path", " > "), F.lit("")), F.col("heading")).alias("heading_path"))


def rescue_thin(segments: DataFrame, least: int = X.MIN_BODY) -> DataFrame:
    """The segments to be stored, with ``rescued``: those with text enough, and those without that have an article and no other below it in their part.

    A thin article below another is either stored or has one below it that is,
    so the articles below need no order.
    """
    size = F.length(F.trim(F.regexp_replace(F.col("body"), r"(?U)^\s+|\s+$", "")))
    rows = segments.withColumn("rescued", size < least)
    parents = segments.select("doc", "part", F.explode(above(F.col("article"), itself=False)).alias("article")).distinct()
    thin = rows.where("rescued AND article <> ''").join(parents, ["doc", "part", "article"], "left_anti").select(*rows.columns)
    return rows.where("NOT rescued").unionByName(thin)


#: What a chunk has of its book, null where the book does not say.
BOOK = {"game": "string", "game_title": "string", "scope": "string", "authority": "int", "version": "string", "effective_date": "string", "source_url": "string", "doc_title": "string", "supersedes": "string", "external_host": "boolean", "source_path": "string"}
CHUNK = [*BOOK, "article", "article_id", "heading", "heading_path", "part", "page", "page_end", "chunk", "chunk_of", "chunk_id", "n_chars"]


def assemble_chunks(segments: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks (``CHUNK`` and ``text``) of segments (see :func:`segment`) and their books (doc and columns of ``BOOK``, of which game and title must be there).

    A body of more than ``MAX_CHARS`` is split.  The first piece stands on its
    heading's page, a later one on the page that its own text starts on.  A
    thin segment that nothing below repeats is its heading.  A chunk id that a
    document gives again gets the chunk's place among all its chunks.
    """
    kept = rescue_thin(segments).join(breadcrumbs(segments), ["doc", "ordinal"])

    @F.pandas_udf("array<struct<piece:string,page:int>>")
    def pieces(body: pd.Series, whole: pd.Series, offsets: pd.Series, page: pd.Series) -> pd.Series:
        out = []
        for text, source, places, own in zip(body, whole, offsets, page, strict=True):
            at, rows = 0, []
            lines = [(o["at"], o["page"]) for o in places]
            for k, piece in enumerate(split_text(text) or [""]):
                probe = piece.strip()[:40]
                found = source.find(probe, at) if probe else -1
                at = found if found >= 0 else at
                rows.append({"piece": piece, "page": own if k == 0 else page_at(lines, at, own)})
            out.append(rows)
        return pd.Series(out)

    body = F.regexp_replace(F.col("body"), r"(?U)^\s+|\s+$", "")
    promoted = F.when(F.col("rescued"), F.array_join(F.filter(F.array("heading", body), lambda x: x != ""), "\n")).otherwise(body)
    cut = kept.withColumn("p", pieces(promoted, "body", "offsets", "page")).select("doc", "ordinal", "article", "heading", "heading_path", "part", "page_end", F.size("p").alias("chunk_of"), F.posexplode("p").alias("chunk", "p"))
    known = books.select("doc", *((F.col(c) if c in books.columns else F.lit(None)).cast(kind).alias(c) for c, kind in BOOK.items()))
    known = known.withColumns({"doc_title": F.coalesce(F.nullif("doc_title", F.lit("")), F.col("game_title")), "external_host": F.coalesce("external_host", F.lit(False))})
    known = known.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in BOOK.items() if kind == "string"})
    article_id = F.when((F.col("part") != "") & (F.col("article") != ""), F.concat_ws(" § ", "part", "article")).otherwise(F.col("article"))
    rows = cut.join(known, "doc").withColumn("article_id", article_id)
    rows = rows.withColumn("base", F.concat_ws(":", "game", F.coalesce(F.nullif("article_id", F.lit("")), F.lit("front")), F.col("chunk").cast("string")))
    emitted = W.partitionBy("doc").orderBy("ordinal", "chunk")
    seen = F.row_number().over(W.partitionBy("doc", "base").orderBy("ordinal", "chunk"))
    rows = rows.withColumns({"nth": F.row_number().over(emitted) - 1, "seen": seen})
    label = F.when(F.col("article") != "", F.concat(F.lit("["), "game_title", F.lit(" · Article "), "article_id", F.lit(" — "), "heading", F.lit("]"))).otherwise(F.concat(F.lit("["), "game_title", F.lit(" · "), "heading", F.lit("]")))
    return rows.select(
        "doc", "ordinal", *BOOK, "article", "article_id", "heading", "heading_path", "part", F.col("p.page").alias("page"), "page_end", "chunk", "chunk_of",
        F.when(F.col("seen") > 1, F.concat_ws(":", "base", F.col("nth").cast("string"))).otherwise(F.col("base")).alias("chunk_id"), F.length("p.piece").alias("n_chars"), F.concat(label, F.lit("\n"), "p.piece").alias("text"))


#: What no chunk may lack, and the kinds of its values.
REQUIRED = {"game": "string", "game_title": "string", "scope": "string", "authority": "int", "article": "string", "heading": "string", "page": "int", "version": "string", "effective_date": "string", "source_url": "string", "chunk": "int"}


def violations(chunks: DataFrame, required: dict[str, str] = REQUIRED) -> DataFrame:
    """(chunk_id, violation), one row each: a key that is missing, null or of another kind, a page below 1, an id given again, text without a label.

    Of the rows with one id those after the first by page, chunk and text are
    reported.  A key that is missing, or of another kind, is so in every row.
    """
    kinds = dict(chunks.dtypes)
    found = [F.lit(f"{c} missing") for c in required if c not in kinds]
    found += [F.lit(f"{c} is {kinds[c]}") for c, kind in required.items() if c in kinds and kinds[c] != kind]
    found += [F.when(F.col(c).isNull(), f"{c} is null") for c in required if c in kinds]
    found += [F.when(F.col("page") < 1, "page below 1")] if "page" in kinds else []
    found += [F.when(~F.coalesce(F.col("text").startswith("["), F.lit(False)), "no label")]
    bad = chunks.select("chunk_id", F.explode(F.array_compact(F.array(*found))).alias("violation"))
    again = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k"))
    return bad.unionByName(again.select("chunk_id", F.lit("id given again").alias("violation")))


def union_corpora(documents: DataFrame, amendments: DataFrame, games: list[str] | None = None) -> DataFrame:
    """The chunks of the books and those of the notices; a build of some games alone has no notices."""
    if games:
        return documents.where(F.col("game").isin(*games))
    return documents.unionByName(amendments, allowMissingColumns=True)


def split_text(text: str, size: int = X.MAX_CHARS, overlap: int = X.OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves, each beginning with the end of the one before."""
    if len(text) <= size:
        return [text] if text else []
    sep = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(sep) + 1 :]
    units = [text[i : i + size] for i in range(0, len(text), size)] if sep == "" else text.split(sep)
    small: list[str] = []
    for u in units:
        small.extend([u] if len(u) <= size else split_text(u, size, overlap, finer))
    out, held = [], []
    for u in small:
        if held and sum(map(len, held)) + len(sep) * len(held) + len(u) > size:
            out.append(sep.join(held))
            while held and (sum(map(len, held)) + len(sep) * (len(held) - 1) > overlap or sum(map(len, held)) + len(sep) * len(held) + len(u) > size):
                held.pop(0)
        held.append(u)
    if held:
        out.append(sep.join(held))
    return [x.strip() for x in out if x.strip()]


def split_bodies(segments: DataFrame) -> DataFrame:
    """One row per piece of a segment's body."""

    @F.pandas_udf("array<string>")
    def pieces(body: pd.Series) -> pd.Series:
        return body.map(lambda b: split_text(b or "") or [""])

    return segments.select("*", F.posexplode(pieces("body")).alias("chunk", "piece"))


def islands(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Maximal runs of rows whose ``flag`` holds: (key, first, last, n)."""
    w = W.partitionBy(key).orderBy(order)
    broken = rows.withColumn("island", F.sum((~F.col(flag)).cast("int")).over(w))
    return broken.where(flag).groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def line_offsets(lines: DataFrame) -> DataFrame:
    """(doc, line_no, page, at) of the lines with text (doc, line_no, page, text): where each begins in the body that they make, joined by line ends."""
    before = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return lines.where("text <> ''").select("doc", "line_no", "page", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("at"))


def page_of(offsets: Column, at: Column, page: Column) -> Column:
    """The page of the last of ``offsets`` (array of struct(at, page), in order) that is not beyond ``at``; else ``page``."""
    return F.coalesce(F.element_at(F.filter(offsets, lambda o: o["at"] <= at), -1)["page"], page)
