"""Retrieval from a service: which query is asked, each search once, records by rank and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.shared import settled


def query_choice(manual: Column, model: Column, keyword: Column) -> Column:
    """struct(source, query): a manual override, else the model's query, else the keyword query; blank ones count as none."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    named = lambda source, c: F.struct(F.lit(source).alias("source"), c.alias("query"))
    return F.when(given(manual), named("manual", manual)).when(given(model), named("model", model)).when(given(keyword), named("keyword", keyword))


def searched_once(requests: DataFrame, search, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """(requests with the results of their queries, distinct searches made): an identical search is not repeated.

    search: a function from a frame of distinct queries to one row of results for
    each.  The results are settled, so using them again searches nothing again.
    A request without a query keeps null results.
    """
    distinct = settled(requests.select(query).filter(F.col(query).isNotNull()).distinct())
    found = settled(search(distinct))
    return requests.join(found, query, "left"), distinct


def key_space(reformulator: Column, prompt_digest: Column, request: Column) -> Column:
    """The cache key of a request: the same store holds several reformulators, whose keys never meet."""
    return F.sha2(F.concat_ws("\x1f", reformulator, prompt_digest, request), 256)


def ranked_records(hits: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The first k distinct ids of each question with their records; a missing record leaves a gap in the ranks.

    hits: question_id, pmid, position (0-based in the service's order).
    """
    first = hits.groupBy("question_id", "pmid").agg(F.min("position").alias("position"))
    listed = first.groupBy("question_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "pmid"))), 1, k).alias("v"))
    each = listed.select("question_id", F.posexplode("v").alias("at", "x")).select("question_id", (F.col("at") + 1).alias("doc_rank"), "x.pmid")
    return each.join(records, "pmid")


def search_counters(hits: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """For each question: ids returned, distinct ones, those among the first k, and records found and missing of these."""
    per = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("returned"), F.count_distinct("pmid").alias("distinct_ids"))
    found = ranked_records(hits, records.select("pmid"), k).groupBy("question_id").agg(F.count(F.lit(1)).alias("found"))
    asked = F.least(F.col("distinct_ids"), F.lit(k).cast("long"))
    both = per.join(found, "question_id", "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    return both.select("question_id", "returned", "distinct_ids", asked.alias("asked"), "found", (asked - F.col("found")).alias("missing"))


def search_audit(searches: DataFrame) -> DataFrame:
    """By stage: searches, those that the cache answered, and matches in all.  searches: stage, cache_hit, count."""
    return searches.groupBy("stage").agg(F.count(F.lit(1)).alias("searches"), F.count_if("cache_hit").alias("cache_hits"), F.sum("count").alias("matches"))


def upgraded(records: DataFrame, parse, version: int, parsed: list[str]) -> DataFrame:
    """Cached records with the parsed columns made anew from their raw text where the parser's version is older; fetch times stay.

    parse: a function from the raw column to a struct of the parsed columns.
    """
    stale = F.coalesce(F.col("parser_version") < version, F.lit(True))
    fresh = records.withColumn("_new", F.when(stale, parse(F.col("raw"))))
    columns = {c: F.when(stale, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in parsed}
    return fresh.withColumns(columns | {"parser_version": F.when(stale, F.lit(version)).otherwise(F.col("parser_version")), "reparsed": stale}).drop("_new")


def stem_checked(cached: DataFrame, questions: DataFrame) -> DataFrame:
    """Cached queries joined to the question stems whose SHA-256 they carry; what does not agree is an error when the result is used."""
    both = cached.join(questions.select("question_id", "question"), "question_id", "left")
    same = F.coalesce(F.sha2("question", 256) == F.col("stem_sha"), F.lit(False))
    return both.filter(F.assert_true(same, F.concat(F.lit("stem differs for "), F.col("question_id").cast("string"))).isNull())


def retrieve(questions: DataFrame, search, records: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(evidence, report): the whole way from questions to ranked records, each distinct query searched once.

    questions: question_id, manual, model and keyword queries; search: from
    distinct queries to query and ids (an array in the service's order, null
    where the search failed); records: pmid and what is known of it.  Evidence
    has the first k distinct ids with a record, at their own ranks: a missing
    record leaves a gap.  The report has every question, with its query's source,
    the ids returned, distinct, asked for, found and missing, and a status:
    NO_QUERY, SEARCH_FAILED, EMPTY, INCOMPLETE or OK.
    """
    chosen = questions.select("question_id", query_choice(F.col("manual"), F.col("model"), F.col("keyword")).alias("c")).select("question_id", "c.source", "c.query")
    asked, _ = searched_once(chosen, search)
    asked = settled(asked)
    hits = asked.select("question_id", F.posexplode("ids").alias("position", "pmid"))
    evidence = ranked_records(hits, records, k)
    per = search_counters(hits, records, k)
    report = asked.select("question_id", "source", "query", F.col("ids").isNull().alias("_failed")).join(per, "question_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("returned", "distinct_ids", "asked", "found", "missing")}
    status = (
        F.when(F.col("query").isNull(), "NO_QUERY").when(F.col("_failed"), "SEARCH_FAILED").when(F.col("asked") == 0, "EMPTY").when(F.col("missing") > 0, "INCOMPLETE").otherwise("OK")
    )
    return evidence, report.withColumns(counts).withColumn("status", status).drop("_failed")
