"""The whole question pipeline: route, retrieve, resolve, answer, check.

Each stage is a DataFrame in, a DataFrame out.  Where the stages would ask a
model (routing, writing) they take a function of columns; the defaults are
deterministic and need none.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import precedence as P
from quarry.operators import verify as V
from quarry.sources import store

Router = Callable[[DataFrame, DataFrame], DataFrame]
Writer = Callable[[DataFrame], Column]


def alias_router(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, routed): the one book whose slug the question names; none if none or several."""
    words = questions.select("query_id", F.explode(F.array_distinct(T.words(F.col("question")))).alias("slug"))
    hit = words.join(F.broadcast(catalog.select("slug").distinct()), "slug")  # a row a book
    return hit.groupBy("query_id").agg(F.collect_set("slug").alias("s")).where(F.size("s") == 1).select("query_id", F.col("s")[0].alias("routed"))


def route(questions: DataFrame, catalog: DataFrame, router: Router = alias_router) -> DataFrame:
    """A forced game must be in the catalog and bypasses the router."""
    known = catalog.select(F.col("slug").alias("game"), F.lit(True).alias("known")).distinct()
    forced = questions.where("game is not null").join(F.broadcast(known), "game", "left")
    checked = forced.withColumn("game", F.when(F.coalesce("known", F.lit(False)), F.col("game")).otherwise(F.raise_error(F.concat(F.lit("unknown book "), "game")))).drop("known")
    free = questions.where("game is null").drop("game")
    routed = free.join(router(free, catalog), "query_id", "left").withColumnRenamed("routed", "game")
    return checked.select("query_id", "question", "game").unionByName(routed.select("query_id", "question", "game"))


def quoting_writer(drafts: DataFrame) -> Column:
    """Answers by naming the excerpt read first, cited."""
    return F.concat(F.lit("The rule on this stands in "), F.col("top.game_title"), F.lit(" "), T.citation(F.col("top.game_title"), F.col("top.article"), F.col("top.page")), F.lit("."))


def corrections(found: DataFrame) -> DataFrame:
    """``found`` (see :func:`quarry.operators.verify.faults`) with ``correction``: what a second draft is told, one block for each kind of fault in fixed order.

    Only unsupported citations can leave nothing standing, so only they offer to
    say that the question is not covered.
    """

    def block(col: str, said: str) -> Column:
        return F.when(F.size(col) > 0, F.concat(F.lit(said), F.array_join(col, "; ")))

    blocks = F.concat_ws(
        "\n",
        F.when(F.size("cites") > 0, F.concat(F.lit("Not in evidence: "), F.array_join("cites", "; "), F.coalesce(F.concat(F.lit(". Cite only: "), F.array_join("allowed", "; ")), F.lit("")))),
        block("silence", "In evidence, yet called silent: "),
        block("gap", "Called missing, yet in an excerpt: "),
        block("skipped", "Passed over, say in a clause what it adds or that it does not matter: "),
        block("verbatim", "Word for word, say it in other words: "),
        F.when(F.size("cites") > 0, F.lit("If nothing is left, say that the question is not covered and what was searched.")),
    )
    return found.withColumn("correction", blocks)


def scope_text(game: Column, title: Column) -> Column:
    """What was searched, in words."""
    return F.when(game.isNull(), "the global rulebook and its amendments").otherwise(F.concat(F.coalesce(title, game), F.lit(", the global rulebook and its amendments")))


def answer(questions: DataFrame, evidence: DataFrame, frequency: DataFrame, n_corpus: int, found: DataFrame, writer: Writer = quoting_writer, rewriter: Writer | None = None) -> DataFrame:
    """(query_id, answer, outcome, errors, retried): a draft held to its evidence by five checks, rewritten once if one fails.

    ``frequency``: (word, df) of the corpus of ``n_corpus`` chunks; ``found``:
    the findings of :func:`quarry.operators.precedence.resolve`.  Writers make a
    column from query_id, question, top (the excerpt read first) and, the second
    time, ``answer`` and ``correction``.  A second draft that is still untrue
    (citations, silence, gaps) is withheld; one that only skips siblings says
    so at its end; one that only quotes too much goes out as it is.
    """
    held = evidence.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "game_title", "article", "page", "text"), "read_pos").alias("top"), F.count("*").alias("n"))
    drafts = questions.join(held, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = drafts.where("n > 0")
    tops = P.top_findings(found)

    def checked(answers: DataFrame) -> DataFrame:
        got = V.faults(answers, evidence, frequency, n_corpus, tops)
        return corrections(got.join(V.allowed_citations(evidence), "query_id", "left")).withColumn("described", V.describe())

    first = store.written(checked(some.select("query_id", writer(some).alias("answer"))), "drafts")  # read three times
    good = first.where(~V.any_fault()).select("query_id", "answer", V.outcome(F.col("answer"), F.lit(1)).alias("outcome"), T.empty_strings().alias("errors"), F.lit(False).alias("retried"))
    told = some.join(first.where(V.any_fault()).select("query_id", "answer", "correction", F.col("described").alias("before")), "query_id")
    again = told.select("query_id", "before", (rewriter or writer)(told).alias("answer"))
    second = checked(again).join(again.select("query_id", "before"), "query_id")
    untrue = V.any_fault(("cites", "silence", "gap"))
    withheld = F.concat(F.lit("The draft could not be squared with the excerpts and is withheld. Faults: "), "described", F.lit(". Excerpts retrieved: "), F.array_join("allowed", "; "))
    disclosed = F.when(F.size("skipped") > 0, F.concat("answer", F.lit("\n\nAlso retrieved and not covered above: "), F.array_join("skipped", "; "), F.lit("."))).otherwise(F.col("answer"))
    errors = F.array_compact(F.array(F.concat(F.lit("attempt 1: "), "before"), F.when(V.any_fault(), F.concat(F.lit("attempt 2: "), "described"))))
    final = F.when(untrue, withheld).otherwise(disclosed)
    redone = second.select("query_id", final.alias("answer"), F.when(untrue, "withheld").otherwise(V.outcome(disclosed, F.lit(1))).alias("outcome"), errors.alias("errors"), F.lit(True).alias("retried"))
    none = drafts.where("n = 0").select("query_id", F.lit("The retrieved text does not cover this; no excerpt matched.").alias("answer"), F.lit("no_evidence").alias("outcome"), T.empty_strings().alias("errors"), F.lit(False).alias("retried"))
    return good.unionByName(redone).unionByName(none)


def coverage_note(evidence: DataFrame) -> DataFrame:
    """(query_id, note): the excerpts that retrieval ranked highest, as a checklist in reading order."""
    line = F.concat(F.lit("["), "read_pos", F.lit("] "), "game_title", F.lit(" Article "), F.coalesce(F.nullif("article", F.lit("")), F.lit("-")))
    top = evidence.where(F.col("rel_rank") <= X.ACCOUNTABLE_RANK)
    return top.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("read_pos", line.alias("l"))))["l"], "; ").alias("note"))


Retriever = Callable[[DataFrame], DataFrame]


def search(questions: DataFrame, catalog: DataFrame, retriever: Retriever, router: Router = alias_router) -> dict[str, DataFrame]:
    """Route, retrieve, resolve, and stop: the tables ``routed``, ``evidence``, ``findings`` and ``notes``.  Nothing is written."""
    routed = route(questions, catalog, router)
    evidence = retriever(routed)
    found = P.resolve(evidence)
    return {"routed": routed, "evidence": evidence, "findings": found, "notes": P.render_note(found, evidence)}


def ask(questions: DataFrame, catalog: DataFrame, retriever: Retriever, frequency: DataFrame, n_corpus: int, router: Router = alias_router, writer: Writer = quoting_writer, rewriter: Writer | None = None) -> dict[str, DataFrame]:
    """The whole chain: what :func:`search` gives, and ``answers``."""
    state = search(questions, catalog, retriever, router)
    return state | {"answers": answer(state["routed"], state["evidence"], frequency, n_corpus, state["findings"], writer, rewriter)}


def instrumented(steps: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Runs each step to its end, once, and keeps its time; a step that fails is a record with its error, and the later ones have no time.

    What a step gives is written, and the tables returned are those: its rows
    are counted from the files' footers, and nothing that reads it runs it again.
    """
    tables, records, failed = {}, [], False
    for name, step in steps:
        began, error, rows = time.perf_counter(), None, None
        if not failed:
            try:
                tables[name] = store.written(step(), "step")
                rows = tables[name].count()
            except Exception as e:  # an error is data here: the run's record holds it
                error, failed = f"{type(e).__name__}: {str(e)[:200]}", True
        else:
            began = None
        records.append({"node": name, "seconds": None if began is None or error else time.perf_counter() - began, "rows": rows, "error": error})
    return tables, records
