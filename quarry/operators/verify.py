"""Checks that hold an answer to its evidence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T


def strip_citations(text: str) -> str:
    """Without the round brackets that hold nothing but citations."""

    def drop(m: re.Match) -> str:
        pieces = [normalise_locator(p) for p in m.group(1).split(";")]
        return "" if all(re.match(X.CITATION, p) for p in pieces) else m.group(0)

    return re.sub(X.PARENTHETICAL, drop, text)


def normalise_locator(piece: str) -> str:
    """The Python twin of :func:`quarry.functions.text.locator`, for spans."""
    dashed = re.sub(r"\s+-\s+", " — ", piece.replace("–", "—"))
    one = " ".join(re.sub(r"\s*—\s*", " — ", dashed).split())
    return re.sub(r"p\.\s+", "p.", one.strip("()").strip().strip(".,;").strip())


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def claims_silence(sentence: str, aliases: list[str]) -> bool:
    """Does the sentence say that one of the books named is silent: book then phrase, or phrase then book?"""
    low = sentence.lower()
    for phrase in re.finditer(X.SILENCE, low):
        for alias in aliases:
            at = low.rfind(alias, 0, phrase.start())
            if at < 0:
                continue
            between = low[at + len(alias) : phrase.start()]
            if len(between) <= X.SUBJECT_WINDOW and not re.search(X.SUBJECT_SHIFT, between):
                return True
    for phrase in re.finditer(X.SILENCE_BEFORE_BOOK, low):
        if any(0 <= low.find(alias, phrase.end()) - phrase.end() <= X.OBJECT_WINDOW for alias in aliases):
            return True
    return False


def find_silence(answer: str, books: list[str]) -> list[str]:
    aliases = sorted({b.lower() for b in books} | {"global rulebook" for b in books if b.lower().startswith("global")})
    return [" ".join(s.split()) for s in sentences(strip_citations(answer)) if claims_silence(s, aliases)]


def gap_sentences(answer: str) -> list[tuple[str, list[str]]]:
    """Each excerpt-framed gap claim and its content words, the first sixteen; claims with fewer than three are no claim."""
    out = []
    for s in sentences(strip_citations(answer)):
        hit = re.search(X.EXCERPT_FRAMED, s, re.I)
        if hit:
            words = [w for w in re.findall(X.CONTENT, s[hit.end() :].lower()) if len(w) > 1 and w not in X.STOPWORDS][: X.GAP_SUBJECT_WORDS]
            if len(set(words)) >= X.GAP_MIN_TERMS:
                out.append((s, words))
    return out


def find_gap_subjects(answer: str) -> list[list[str]]:
    return [words for _, words in gap_sentences(answer)]


class Runs:
    """Suffix automaton of a word sequence: after any words read, the state of the longest run of them that the sequence has."""

    def __init__(self, words: list[str]) -> None:
        self.after: list[dict[str, int]] = [{}]
        self.shorter, self.longest = [-1], [0]
        last = 0
        for w in words:
            last = self._grow(last, w)

    def _state(self, after: dict[str, int], shorter: int, longest: int) -> int:
        self.after.append(after)
        self.shorter.append(shorter)
        self.longest.append(longest)
        return len(self.after) - 1

    def _grow(self, last: int, w: str) -> int:
        new, p = self._state({}, 0, self.longest[last] + 1), last
        while p >= 0 and w not in self.after[p]:
            self.after[p][w] = new
            p = self.shorter[p]
        if p >= 0:
            q = self.after[p][w]
            if self.longest[q] > self.longest[p] + 1:  # q also stands for longer runs: part the shorter ones off
                part = self._state(dict(self.after[q]), self.shorter[q], self.longest[p] + 1)
                while p >= 0 and self.after[p].get(w) == q:
                    self.after[p][w] = part
                    p = self.shorter[p]
                self.shorter[q] = q = part
            self.shorter[new] = q
        return new

    def longest_in(self, words: list[str]) -> tuple[int, int]:
        """Length of the longest run of ``words`` that the sequence has, and where the first such ends."""
        best, end, state, length = 0, 0, 0, 0
        for i, w in enumerate(words, 1):
            while state and w not in self.after[state]:
                state = self.shorter[state]
                length = self.longest[state]
            if w in self.after[state]:
                state, length = self.after[state][w], length + 1
            if length > best:
                best, end = length, i
        return best, end


def common_run(a: list[str], b: list[str]) -> tuple[int, int]:
    """Length of the longest run of words common to both and where it ends in ``a`` (the first such), in time linear in both."""
    return Runs(b).longest_in(a)


def silence_violations(answer: Column, books: Column) -> Column:
    @F.pandas_udf("array<string>")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([find_silence(x or "", list(y)) for x, y in zip(a, b, strict=True)])

    return udf(answer, books)


def excerpt_framed_subjects(answer: Column) -> Column:
    @F.pandas_udf("array<array<string>>")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: find_gap_subjects(x or ""))

    return udf(answer)


def longest_common_run(a: Column, b: Column, words: str = X.CONTENT) -> Column:
    """struct(run, passage): the longest run of words of ``a`` that ``b`` has too."""

    @F.pandas_udf("run long, passage string")
    def udf(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            own = re.findall(words, (p or "").lower())
            run, end = common_run(own, re.findall(words, (q or "").lower()))
            rows.append((run, " ".join(own[end - run : end])))
        return pd.DataFrame(rows, columns=["run", "passage"])

    return udf(a, b)


def verbatim_runs(answers: DataFrame, evidence: DataFrame, words: str = X.CONTENT) -> DataFrame:
    """(query_id, run, passage, place): the longest run of words that an answer shares with one excerpt, the first best in reading order."""
    place = F.concat_ws(" ", F.concat_ws(":", "game", F.coalesce(F.nullif("article", F.lit("")), F.lit("-"))), F.concat(F.lit("p."), "page"))
    e = evidence.select("query_id", "read_pos", "text", place.alias("place")).join(answers.select("query_id", "answer"), "query_id")
    r = e.select("query_id", "read_pos", "place", longest_common_run(F.col("answer"), F.col("text"), words).alias("x"))
    best = r.groupBy("query_id").agg(F.max_by(F.struct("x.run", "x.passage", "place"), F.struct("x.run", -F.col("read_pos"))).alias("b"))
    return best.select("query_id", "b.run", "b.passage", "b.place")


def citation_spans(answer: str) -> list[dict]:
    """Each citation's place in the answer; the locators are those of ``cited_locators``, in order."""
    out = []
    for m in re.finditer(X.PARENTHETICAL, answer):
        at = m.start(1)
        for piece in m.group(1).split(";"):
            locator = normalise_locator(piece)
            seen = piece.strip().rstrip(".,; ")
            if seen and re.match(X.CITATION, locator):
                start = at + len(piece) - len(piece.lstrip())
                out.append({"start": start, "end": start + len(seen), "text": seen, "locator": locator})
            at += len(piece) + 1
    return out


def claim_segments(answer: str) -> list[tuple[str, str]]:
    """(kind, text) pieces, citations apart, which join to the answer again."""
    out, at = [], 0
    for s in citation_spans(answer):
        if s["start"] > at:
            out.append(("text", answer[at : s["start"]]))
        out.append(("cite", answer[s["start"] : s["end"]]))
        at = s["end"]
    if at < len(answer):
        out.append(("text", answer[at:]))
    return out


def cited_articles(answers: DataFrame) -> DataFrame:
    """(query_id, locator, game_title, article) of the citations in answers (query_id, answer) that name an article."""
    c = answers.select("query_id", F.explode(F.array_distinct(T.cited_locators(F.col("answer")))).alias("locator"))
    book, article = F.regexp_extract("locator", X.LOCATOR, 1), F.regexp_extract("locator", X.LOCATOR, 2)
    return c.withColumns({"game_title": F.trim(book), "article": F.regexp_replace(F.trim(article), r"\.+$", "")}).where("article <> ''")


def allowed_citations(evidence: DataFrame) -> DataFrame:
    """(query_id, allowed): the citations that the evidence supports."""
    own = T.locator(T.citation(F.col("game_title"), F.col("article"), F.col("page")))
    return evidence.groupBy("query_id").agg(F.array_sort(F.collect_set(own)).alias("allowed"))


def skipped_siblings(evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, game_title, article, skipped): articles ranked high that an answer leaves out although it cites as many siblings as make a ladder.

    Only citations that the evidence supports count.  ``skipped`` names the
    first excerpt of the article.
    """
    own = ["query_id", "game_title", "article"]
    cited = cited_articles(answers).join(allowed_citations(evidence), "query_id").where(F.array_contains("allowed", F.col("locator"))).select(*own).distinct()
    ladder = cited.withColumn("parent", T.article_parent(F.col("article"))).where("parent is not null").groupBy("query_id", "game_title", "parent").agg(F.count("*").alias("n")).where(F.col("n") >= X.SIBLINGS_IN_USE).drop("n")
    high = evidence.where(F.coalesce("rel_rank", F.lit(X.MISSING_RANK)) <= X.ACCOUNTABLE_RANK).withColumn("article", F.trim("article")).where("article <> ''")
    said = F.concat("game_title", F.lit(" Article "), "article", F.lit(" — "), F.coalesce(F.nullif("heading", F.lit("")), F.lit("(no heading)")), F.lit(" (p."), "page", F.lit(")"))
    first = high.withColumn("said", said).groupBy(*own).agg(F.min_by("said", "read_pos").alias("skipped"), F.min("read_pos").alias("at")).withColumn("parent", T.article_parent(F.col("article")))
    return first.join(ladder, ["query_id", "game_title", "parent"], "left_semi").join(cited, own, "left_anti").select(*own, "skipped", "at")


def gap_claims(answers: DataFrame) -> DataFrame:
    """(query_id, n, sentence, words): claims that the excerpts lack something, with the distinguishing words of what; fewer than three make none."""

    @F.pandas_udf("array<struct<sentence:string,words:array<string>>>")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: [{"sentence": s, "words": w} for s, w in gap_sentences(x or "")])

    return answers.select("query_id", F.posexplode(udf("answer")).alias("n", "x")).select("query_id", "n", "x.*")


def false_gaps(answers: DataFrame, evidence: DataFrame, frequency: DataFrame, n_corpus: int, tops: DataFrame) -> DataFrame:
    """(query_id, gap): gap claims that the evidence contradicts.

    ``frequency``: (word, df) over the corpus of ``n_corpus`` chunks; ``tops``:
    (query_id, top_findings).  An answer without citations that claims a gap or
    silence is contradicted by any finding on the excerpt ranked first.  Any
    other gap claim is contradicted by one excerpt with so much of its words,
    weighted by how rare they are.
    """
    @F.pandas_udf("string")
    def denial(a: pd.Series) -> pd.Series:
        return a.map(lambda x: next((" ".join(s.split())[:200] for s in sentences(strip_citations(x or "")) if re.search(X.EXCERPT_FRAMED, s, re.I) or re.search(X.SILENCE, s, re.I)), None))

    blanket = answers.join(tops, "query_id").where((F.size(T.cited_locators(F.col("answer"))) == 0) & (F.size("top_findings") > 0)).withColumn("said", denial("answer")).where("said is not null")
    blanket = blanket.select("query_id", F.lit(-1).alias("n"), F.concat("said", F.lit("  [nothing cited, yet the excerpt ranked first supports: "), F.array_join("top_findings", "; "), F.lit("]")).alias("gap"))

    claims = gap_claims(answers)
    wanted = claims.select("query_id", "n", F.explode(F.array_distinct("words")).alias("word"))
    known = frequency.join(wanted.select("word").distinct(), "word", "left_semi")
    weighed = wanted.join(known, "word", "left").withColumn("idf", F.log((n_corpus + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    total = weighed.groupBy("query_id", "n").agg(F.sum("idf").alias("total")).where("total > 0")
    place = F.concat("game_title", F.lit(" Article "), F.coalesce(F.nullif("article", F.lit("")), F.lit("-")), F.lit(" p."), "page")
    held = evidence.join(claims.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "read_pos", place.alias("place"), F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("word"))
    covered = held.join(weighed, ["query_id", "word"]).groupBy("query_id", "n", "read_pos", "place").agg(F.sum("idf").alias("got")).join(total, ["query_id", "n"]).where(F.col("got") / F.col("total") >= X.GAP_COVERAGE)
    first = covered.groupBy("query_id", "n").agg(F.min_by("place", "read_pos").alias("place")).join(claims, ["query_id", "n"])
    said = F.concat(F.substring(T.flat(F.col("sentence")), 1, 200), F.lit("  [contradicted by "), "place", F.lit("]"))
    every = blanket.unionByName(first.select("query_id", "n", said.alias("gap")))
    return every.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "gap")))["gap"].alias("gap"))


def faults(answers: DataFrame, evidence: DataFrame, frequency: DataFrame, n_corpus: int, tops: DataFrame) -> DataFrame:
    """(query_id, answer, cites, silence, gap, skipped, verbatim): what each check finds wrong with an answer; empty arrays where nothing is."""
    none = T.empty_strings()
    books = evidence.groupBy("query_id").agg(F.array_sort(F.collect_set("game_title")).alias("books"))
    skipped = skipped_siblings(evidence, answers).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "skipped")))["skipped"].alias("skipped"))
    copied = verbatim_runs(answers, evidence).where(F.col("run") > X.VERBATIM_LIMIT).select("query_id", F.array(F.concat(F.col("run"), F.lit(" words of "), "place", F.lit(": "), "passage")).alias("verbatim"))
    j = answers.select("query_id", "answer")
    for other in (allowed_citations(evidence), books, false_gaps(answers, evidence, frequency, n_corpus, tops), skipped, copied):
        j = j.join(other, "query_id", "left")
    return j.select("query_id", "answer", T.unsupported(F.col("answer"), F.coalesce("allowed", none)).alias("cites"), silence_violations(F.col("answer"), F.coalesce("books", none)).alias("silence"), *(F.coalesce(c, none).alias(c) for c in ("gap", "skipped", "verbatim")))


FAULTS = {"cites": "unsupported citation", "silence": "false claim of silence", "gap": "false claim of a gap", "skipped": "skipped sibling", "verbatim": "over-quoting"}


def any_fault(names: tuple[str, ...] = tuple(FAULTS)) -> Column:
    """Is there a fault?  The first three make an answer untrue, the others only partial or badly written."""
    out = F.lit(False)
    for c in names:
        out = out | (F.size(c) > 0)
    return out


def describe() -> Column:
    """All faults of an answer in one line."""

    def told(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.concat(F.lit(f"{kind}: "), x))

    return F.array_join(F.flatten(F.array(*(told(c, kind) for c, kind in FAULTS.items()))), "; ")


def unattributable_hedges(answer: Column, texts: Column) -> Column:
    """The hedges of an answer, if none of its excerpts (an array of texts) hedges in any of the words."""
    said = F.filter(F.array(*map(F.lit, X.HEDGES)), lambda h: F.regexp_instr(F.lower(answer), F.concat(F.lit(r"\b"), h, F.lit(r"\b"))) > 0)
    hedged = F.exists(texts, lambda t: F.lower(t).rlike("|".join(X.HEDGES)))
    return F.when(F.coalesce(hedged, F.lit(False)), T.empty_strings()).otherwise(said)


def outcome(answer: Column, n_evidence: Column) -> Column:
    return F.when(n_evidence == 0, "no_evidence").when(F.size(T.cited_locators(answer)) > 0, "answered").otherwise("uncited")


def usable_spans(answer: str, spans: list[dict]) -> list[dict]:
    """Spans within the answer whose text is there, in order, each after the end of the one before."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if at <= s["start"] < s["end"] <= len(answer) and answer[s["start"] : s["end"]] == s["text"]:
            out.append(s)
            at = s["end"]
    return out


def paragraph_ranges(answer: str) -> list[tuple[int, int]]:
    """Paragraphs with the blank lines after them: gapless from the start to the end."""
    cuts = [0, *(m.end() for m in re.finditer(r"\n{2,}", answer)), len(answer)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def copy_payload(answer: str, scope: str, fingerprint: str, faults: list[str]) -> str:
    """What is put on the clipboard: the answer, what was searched, and what the checks said."""
    return "\n".join([answer.strip(), "", f"Searched: {scope}", f"Corpus: {fingerprint}", *(f"Check: {f}" for f in faults or ["no fault found"])])


SPAN = "start int, end int, text string, locator string, chunk_ids array<string>"


def spans_of(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, n, start, end, text, locator, chunk_ids): the citations of answers with the excerpts that each may mean, in reading order."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string,locator:string>>")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: citation_spans(x or ""))

    s = answers.select("query_id", F.posexplode(udf("answer")).alias("n", "x")).select("query_id", "n", "x.*")
    own = T.locator(T.citation(F.col("game_title"), F.col("article"), F.col("page")))
    held = evidence.groupBy("query_id", own.alias("locator")).agg(F.sort_array(F.collect_list(F.struct("read_pos", "chunk_id")))["chunk_id"].alias("chunk_ids"))
    return s.join(held, ["query_id", "locator"], "left").select("query_id", "n", "start", "end", "text", "locator", "chunk_ids")


def stripped(answer: Column) -> Column:
    @F.pandas_udf("string")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else strip_citations(x))

    return udf(answer)


def segments_of(answer: Column) -> Column:
    """array of struct(kind, text): text and citations, which join to the answer again."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: [{"kind": k, "text": t} for k, t in claim_segments(x or "")])

    return udf(answer)


def usable(answer: Column, spans: Column) -> Column:
    """The spans (array of struct(start, end, text)) that can be shown: see :func:`usable_spans`."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def udf(a: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([usable_spans(x or "", [dict(y) for y in z]) for x, z in zip(a, s, strict=True)])

    return udf(answer, spans)


def paragraphs(answer: Column) -> Column:
    """array of struct(start, end): see :func:`paragraph_ranges`; a null answer has none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def udf(a: pd.Series) -> pd.Series:
        return a.map(lambda x: [{"start": i, "end": j} for i, j in paragraph_ranges(x or "")])

    return udf(answer)


def copied(answer: Column, scope: Column, fingerprint: Column, found: Column) -> Column:
    """The text that is put on the clipboard; ``found``: what the checks said."""
    checks = F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no fault found"))), lambda f: F.concat(F.lit("Check: "), f))
    return F.array_join(F.concat(F.array(F.trim(answer), F.lit(""), F.concat(F.lit("Searched: "), scope), F.concat(F.lit("Corpus: "), fingerprint)), checks), "\n")
