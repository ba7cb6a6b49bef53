"""Registered queries of versioned tables, exports, collection, saved replies, verified inputs, ranges and audits, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import columns as C
from quorumlake.functions import frozen
from quorumlake.functions.columns import STANCES
from quorumlake.operators import audit, evaluate, inputs, ranges, sampling, searching, uncertainty
from quorumlake.plans.projection import SEEDS
from quorumlake.queries import F1_SQL, query
from quorumlake.record_queries import fresh, n
from quorumlake.shared import settled
from quorumlake.sources import exports, loaders, pinned, replies
from quorumlake.sources.versions import VersionedTable
from quorumlake.streaming import collect, runs

# --- versioned tables ------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey), v AS (SELECT unnest([1, 2, 3]) AS version)
SELECT CAST(version AS INTEGER) AS version, count(*) AS customers, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT v.version, o_custkey, arg_min(o_orderkey, o_orderkey % 3) AS o_orderkey FROM v JOIN (SELECT o_custkey, o_orderkey % 3 AS third, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) ON third < v.version GROUP BY ALL) GROUP BY version""",
    views=False,
)
def versioned_merge(t):
    # Orders come in three lots, each of them twice; a customer keeps the order of the first lot that has one.
    table = VersionedTable(t.spark, fresh(t, "orders"))
    for third in range(3):
        lot = t.orders.filter(F.col("o_orderkey") % 3 == third).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
        for _ in range(2):
            table.merge(lot, ["o_custkey"])
    out = None
    for version in range(1, 4):
        one = table.read(min(version, table.latest())).agg(F.lit(version).alias("version"), n().alias("customers"), F.sum("o_orderkey").alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", views=False)
def export_round_trip(t):
    table, back = VersionedTable(t.spark, fresh(t, "orders")), VersionedTable(t.spark, fresh(t, "restored"))
    keys = ["o_orderkey"]
    table.merge(t.orders, keys)
    back.merge(t.orders.filter("o_orderkey % 4 = 1"), keys)
    at = fresh(t, "export")
    exports.export_table(table, at, keys)
    exports.restore_table(at, back)
    return back.read().groupBy("o_orderstatus").agg(n().alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT CASE WHEN c_custkey % 10 = 3 THEN 'NEW' WHEN c_custkey % 10 = 4 THEN 'KEPT' WHEN c_custkey % 10 = 5 AND c_acctbal <> 0 THEN 'CONFLICT' ELSE 'SAME' END AS state, count(*) AS n FROM customer GROUP BY state", views=False)
def restore_states(t):
    k = F.col("c_custkey") % 10
    own = t.customer.filter(k != 3).withColumn("c_acctbal", F.when(k == 5, -F.col("c_acctbal")).otherwise(F.col("c_acctbal")))
    return exports.conflicts(t.customer.filter(k != 4), own, ["c_custkey"]).groupBy("state").agg(n().alias("n"))


def upper_case():
    """A service that answers in capitals and fails on every eleventh digit sum; for trying collection without one."""

    def call(request: str) -> str:
        if sum(map(int, filter(str.isdigit, request))) % 11 == 0:
            raise ValueError("no answer")
        return request.upper()

    return call


@query(
    """WITH r AS (SELECT 'k' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS cache_key, c_name || '/' || c_mktsegment AS request, row_number() OVER (ORDER BY c_custkey) AS place, count(*) OVER () AS n FROM customer),
s AS (SELECT *, list_sum(list_transform(regexp_extract_all(request, '[0-9]'), lambda d: CAST(d AS BIGINT))) % 11 = 0 AS bad FROM r)
SELECT cache_key, CASE WHEN bad THEN 'FAILED' ELSE 'VALID' END AS status, CASE WHEN NOT bad THEN upper(request) END AS response, CASE WHEN place <= n // 3 THEN 'first' ELSE 'second' END AS run, CAST(1 AS BIGINT) AS calls FROM s WHERE place <= n // 3 + n // 2""",
    views=False,
)
def bounded_collection(t):
    """Two runs over a stream of requests, the first of a third of them, the second of half; the first is started twice."""
    table, source = VersionedTable(t.spark, fresh(t, "outcomes")), fresh(t, "requests")
    requests = t.customer.select(F.format_string("k%09d", "c_custkey").alias("cache_key"), F.concat_ws("/", "c_name", "c_mktsegment").alias("request"))
    requests.coalesce(1).write.parquet(source)
    total = requests.count()
    for run, most in (("first", total // 3), ("first", total // 3), ("second", total // 2)):
        stream = t.spark.readStream.schema("cache_key string, request string").parquet(source)
        q = collect.collect_bounded(stream, table, upper_case, fresh(t, "offsets"), run=run, most_new=most, every=max(total // 4, 1), pause=0.0, lanes=4)
        q.awaitTermination()
    return collect.outcomes_of(table).select("cache_key", "status", "response", "run", "calls")


# --- saved replies ---------------------------------------------------------------------------------------------------

PAGE = 20


def searches(t) -> DataFrame:
    """Saved pages of one search for each supplier: the parts that it sells, most expensive first, in pages of PAGE; every seventh lost a page, every fifth fails."""
    sold = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    listed = sold.groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("ids"))
    pages = listed.select("s", F.size("ids").alias("total"), "ids", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(PAGE))).alias("start"))
    kept = pages.filter(~((F.col("s") % 7 == 0) & (F.col("start") == PAGE)))
    ids = F.transform(F.slice("ids", F.col("start") + 1, F.lit(PAGE)), lambda x: x.cast("string"))
    result = F.struct(F.col("total").cast("string").alias("count"), F.col("start").cast("string").alias("retstart"), ids.alias("idlist"), F.when(F.col("s") % 5 == 0, F.lit("busy")).alias("ERROR"))
    at = fresh(t, "searches")
    kept.select(F.to_json(F.struct(F.concat(F.lit("supplier "), F.col("s")).alias("query"), F.col("start").alias("retstart"), F.to_json(F.struct(result.alias("esearchresult"))).alias("reply"))).alias("value")).write.text(at)
    return replies.saved_replies(t.spark, at, "search", 1 << 16)


SEARCH_SQL = """WITH sold AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), got AS (
  SELECT 'supplier ' || s AS query, s, count(*) AS total, min(p) AS first_id, max(p) AS last_id, CASE WHEN s % 5 = 0 THEN 'FAILED' WHEN s % 7 = 0 AND count(*) > 40 THEN 'TORN' ELSE 'OK' END AS status,
    CASE WHEN s % 7 = 0 AND count(*) > 20 THEN 20 ELSE count(*) END AS some FROM sold GROUP BY s)
"""


@query(SEARCH_SQL + "SELECT query, CASE WHEN status <> 'FAILED' THEN total END AS total, status, CASE WHEN status = 'OK' THEN CASE WHEN s % 7 = 0 THEN least(total, 20) ELSE total END END AS ids FROM got", views=False)
def saved_searches(t):
    """Whole results from pages; a lost last page cannot be told from a short result by places alone, the total tells it to a reader."""
    whole = replies.whole_results(searches(t))
    return whole.select("query", "total", "status", F.when(F.col("status") == "OK", F.size("ids").cast("long")).alias("ids"))


@query(SEARCH_SQL + "SELECT 'supplier ' || s AS query, l.p AS pmid FROM (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS place FROM sold) l WHERE s IN (1, 3, 8) AND place <= 3", views=False)
def pushed_searches(t):
    """Three searches chosen in the source itself; their first three ids."""
    some = searches(t).filter(F.col("query").isin("supplier 1", "supplier 3", "supplier 8") & (F.col("position") < 3))
    return some.select("query", F.col("pmid").cast("long").alias("pmid"))


@query(
    """WITH w AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_linenumber = 1) SELECT CASE WHEN p % 6 = 0 THEN 'absent' WHEN p % 6 = 1 THEN 'again' ELSE 'record' END AS what, count(*) AS n, CAST(sum(p) AS BIGINT) AS keys FROM w WHERE p % 6 <> 2 GROUP BY what""",
    views=False,
)
def saved_fetches(t):
    """Records in batches of 50 ids: a sixth is not in the service, a sixth comes in replies that break off, a sixth is known already."""
    wanted = t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").cast("string").alias("pmid"))
    known = t.part.filter("p_partkey % 6 = 2").select(F.col("p_partkey").cast("string").alias("pmid"))
    none = t.spark.createDataFrame([], "pmid string, asked_at timestamp")
    ask = settled(replies.still_to_fetch(wanted, known, none, "2026-01-01 00:00:00")).withColumn("p", F.col("pmid").cast("long"))
    record = F.when(F.col("p") % 6 != 0, F.concat(F.lit("<PubmedArticle><PMID>"), "pmid", F.lit("</PMID></PubmedArticle>"))).otherwise("")
    lots = ask.groupBy((F.col("p") % 6 == 1).alias("broken"), F.floor(F.col("p") / 50).alias("lot")).agg(F.array_sort(F.collect_list("pmid")).alias("ids"), F.array_join(F.collect_list(record), "").alias("body"))
    reply = F.concat(F.lit("<PubmedArticleSet>"), "body", F.when(F.col("broken"), "").otherwise("</PubmedArticleSet>"))
    at = fresh(t, "fetches")
    lots.select(F.to_json(F.struct("ids", reply.alias("reply"))).alias("value")).write.text(at)
    rows = settled(replies.saved_replies(t.spark, at, "fetch", 1 << 16))
    best, gone = replies.settled_fetches(rows, "2026-01-01 00:00:00")
    left = replies.still_to_fetch(wanted, known.unionByName(best.select("pmid")), gone, "2026-01-02 00:00:00")
    told = lambda df, what: df.select(F.lit(what).alias("what"), F.col("pmid").cast("long").alias("p"))
    return told(best, "record").unionByName(told(gone, "absent")).unionByName(told(left, "again")).groupBy("what").agg(n().alias("n"), F.sum("p").alias("keys"))


@query(
    """WITH q AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' WHEN o_orderkey % 4 = 1 THEN 'model' WHEN o_orderkey % 4 = 2 THEN 'keyword' END AS source, o_custkey % 100 AS s FROM orders),
hits AS (SELECT s, list(l_partkey ORDER BY l_orderkey, l_linenumber)[:30] AS ids FROM (SELECT l_suppkey % 100 AS s, l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 100 <> 7) GROUP BY s),
d AS (SELECT s, ids, list_distinct(ids) AS parts FROM hits), f AS (SELECT s, len(ids) AS returned, len(parts) AS distinct_ids,
  len(list_filter(list_transform(list_sort(list_transform(parts, lambda p: struct_pack(at := list_position(ids, p), p := p)))[:5], lambda x: x.p), lambda p: p % 10 <> 0)) AS found FROM d)
SELECT question_id, source, coalesce(returned, 0) AS returned, coalesce(distinct_ids, 0) AS distinct_ids, coalesce(found, 0) AS found,
  CASE WHEN source IS NULL THEN 'NO_QUERY' WHEN f.s IS NULL THEN 'SEARCH_FAILED' WHEN found < least(distinct_ids, 5) THEN 'INCOMPLETE' ELSE 'OK' END AS status
FROM q LEFT JOIN f ON f.s = q.s AND source IS NOT NULL""",
    views=False,
)
def retrieve_report(t):
    """Every order asks for a supplier's parts, by one of three queries or none; part ids that end in 0 have no record."""
    k, text = F.col("o_orderkey") % 4, F.concat(F.lit("supplier "), F.col("o_custkey") % 100)
    questions = t.orders.select(F.col("o_orderkey").alias("question_id"), F.when(k == 0, text).alias("manual"), F.when(k <= 1, F.when(k == 1, text).otherwise("other")).alias("model"), F.when(k <= 2, F.when(k == 2, text).otherwise("other")).alias("keyword"))
    sold = t.lineitem.filter("l_suppkey % 100 <> 7").select(F.concat(F.lit("supplier "), F.col("l_suppkey") % 100).alias("query"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("x"))
    service = sold.groupBy("query").agg(F.slice(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l_partkey"]), 1, 30).alias("ids"))
    records = t.part.filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("pmid"), "p_name")
    _, report = searching.retrieve(questions, lambda asked: asked.join(service, "query", "left"), records, 5)
    return report.select("question_id", "source", "returned", "distinct_ids", "found", "status")


# --- verified inputs -------------------------------------------------------------------------------------------------


def five_sources(t) -> tuple:
    """Samples, counts, evidence, texts and weights of the top pairs, made apart from the same tables."""
    top = t.top_evidence()
    text = F.concat_ws(" ", "evidence_type", F.col("doc_id"))
    evidence = top.select("question_id", "doc_id", "doc_rank", "evidence_type", "quality", F.sha2(text, 256).alias("text_sha"))
    texts = top.select("question_id", "doc_id", text.alias("text"))
    counts = t.pairs().select("question_id", "idx", "doc_id", "n_s", "n_c", "n_i")
    return t.samples().select("question_id", "idx", "doc_id", "seed", "stance"), counts, evidence, texts, t.weights().select("evidence_type", "quality")


@query("SELECT count(*) AS pairs, CAST(sum(n_s) AS BIGINT) AS n_s, CAST(sum(n_c) AS BIGINT) AS n_c, CAST(sum(n_i) AS BIGINT) AS n_i, count(DISTINCT question_id) AS questions FROM q_pair")
def verified_pairs(t):
    """Five sources that agree, loaded by one job."""
    pairs, _ = inputs.load_pairs(*five_sources(t), list(SEEDS))
    return pairs.agg(n().alias("pairs"), *[F.sum(c).alias(c) for c in ("n_s", "n_c", "n_i")], F.count_distinct("question_id").alias("questions"))


@query(
    """, p AS (SELECT *, question_id % 50 AS k FROM q_pair), a AS (SELECT count(*) FILTER (k = 1 AND idx = 0 AND doc_rank = 1) AS samples_missing, count(*) FILTER (k = 2 AND idx = 1 AND doc_rank = 1) AS counts_missing, count(*) FILTER (k = 3 AND idx = 2) AS counts_differ,
  count(*) FILTER (k = 4 AND doc_rank = 1) AS text_differs, count(*) FILTER (k = 5 AND tier <> 9) AS weight_differs, count(*) FILTER (k = 6 AND idx = 4) AS seeds_differ, count(*) FILTER (k = 7 AND doc_rank = 1) AS evidence_missing FROM p)
UNPIVOT a ON COLUMNS(*) INTO NAME fault VALUE n"""
)
def input_faults(t):
    """Seven faults planted in fiftieths of the questions; what an observed pass counts of each."""
    samples, counts, evidence, texts, weights = five_sources(t)
    k, first = F.col("question_id") % 50, F.col("doc_id").endswith("-1")
    samples = samples.filter(~((k == 1) & (F.col("idx") == 0) & first)).withColumn("seed", F.when((k == 6) & (F.col("idx") == 4), F.col("seed") + 50).otherwise(F.col("seed")))
    counts = counts.filter(~((k == 2) & (F.col("idx") == 1) & first)).withColumn("n_s", F.when((k == 3) & (F.col("idx") == 2), F.col("n_s") + 1).otherwise(F.col("n_s")))
    texts = texts.withColumn("text", F.when((k == 4) & first, F.lit("another")).otherwise(F.col("text")))
    evidence = evidence.withColumn("quality", F.when((k == 5) & (F.col("quality") > 0), F.lit(0.123)).otherwise(F.col("quality"))).filter(~((k == 7) & first))
    placed, faults = inputs.matched_pairs(samples, counts, evidence, texts, weights, list(SEEDS))
    names = ["samples_missing", "counts_missing", "counts_differ", "text_differs", "weight_differs", "seeds_differ", "evidence_missing"]
    found = placed.agg(*[F.count_if(faults[f]).alias(f) for f in names])
    return found.unpivot([], names, "fault", "n")


@query(
    """SELECT count(*) AS rows, count(*) FILTER (toxic <> 1 AND quality <> 1) AS missing_reference, count(*) FILTER (n_chars % 4 = 0) AS missing_hard, count(*) FILTER (toxic <> 1 AND quality = 1 AND n_chars % 4 = 1) AS agree
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    views=False,
)
def reference_pairs(t):
    both = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    stance = F.when(F.col("toxic") == 1, "CONTRADICT").when(F.col("quality") == 1, "SUPPORT").otherwise(" ")
    reference = both.select(F.col("doc_id").alias("pair_id"), "lang", "source", F.col("source").alias("batch"), stance.alias("stance"))
    guess = F.element_at(F.array(F.lit(""), F.lit("SUPPORT"), F.lit("CONTRADICT"), F.lit("IRRELEVANT")), (F.col("n_chars") % 4 + 1).cast("int"))
    hard = both.select(F.col("doc_id").alias("pair_id"), "lang", "source", guess.alias("stance"), F.when(F.trim(stance) != "", stance).alias("reference_stance"))
    # The identity of a document's pair is its id.
    named = lambda df: df.withColumn("question_id", F.concat_ws("/", "lang", "source", "pair_id"))
    rows, counters = inputs.reference_join(named(reference), named(hard), ["question_id"])
    return rows.agg(n().alias("rows"), F.lit(counters["missing_reference"]).cast("long").alias("missing_reference"), F.lit(counters["missing_hard"]).cast("long").alias("missing_hard"), F.count_if((F.col("reference_stance") == "SUPPORT") & (F.col("hard_stance") == "SUPPORT")).alias("agree"))


@query(
    """, e AS (SELECT question_id, idx, doc_id, n_s, n_c, n_i, CASE WHEN question_id % 3 = 0 THEN 'SUPPORT' WHEN question_id % 3 = 1 THEN 'CONTRADICT' ELSE 'IRRELEVANT' END AS ref, label, question_id % 7 <> 0 AS known FROM q_dist)
SELECT CAST(0 AS BIGINT) AS incomplete, count(*) FILTER (known AND label IS NOT NULL) AS n, count(*) FILTER (known AND label IS NOT NULL AND ref <> label) AS errors, round(avg(CASE WHEN ref <> label THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (known AND label IS NOT NULL), 9) AS prevalence FROM e"""
)
def evaluated_samples(t):
    q = t.questions().filter("question_id % 7 <> 0").select("question_id", F.element_at(F.array(*map(F.lit, STANCES)), (F.col("question_id") % 3 + 1).cast("int")).alias("reference_stance"))
    pairs = t.top_evidence().select("question_id", "doc_id", F.explode(t.options()).alias("idx")).join(q, "question_id")
    _, metrics = inputs.evaluate_samples(t.samples(), pairs.select("question_id", "idx", "doc_id", "reference_stance"), list(SEEDS))
    return metrics.select("incomplete", "n", "errors", F.round("prevalence", 9).alias("prevalence"))


METHODS = ["once", "twice", "shifted", "constant"]


def guesses(t) -> tuple[DataFrame, DataFrame]:
    """Four methods' guesses for each labelled document, and its batch and reference."""
    rows = t.errors()
    at = lambda x: F.element_at(F.array(*map(F.lit, STANCES)), (x % 3 + 1).cast("int"))
    each = [F.col("guess"), at(F.col("doc_id") * 2 + F.col("n_chars")), at(F.col("n_chars") + F.floor(F.col("doc_id") / 3)), F.lit("IRRELEVANT")]
    long = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), g.alias("guess")) for m, g in zip(METHODS, each)])).alias("x")).select("doc_id", "x.*")
    batch = F.when(F.col("doc_id") % 2 == 0, "structural").otherwise("directional")
    return long, rows.select("doc_id", batch.alias("batch"), "ref")


GUESS_SQL = """, m AS (SELECT doc_id, ref, CASE WHEN doc_id % 2 = 0 THEN 'structural' ELSE 'directional' END AS batch, guess AS once, list_extract(['SUPPORT', 'CONTRADICT', 'IRRELEVANT'], CAST((doc_id * 2 + n_chars) % 3 + 1 AS BIGINT)) AS twice,
  list_extract(['SUPPORT', 'CONTRADICT', 'IRRELEVANT'], CAST((n_chars + doc_id // 3) % 3 + 1 AS BIGINT)) AS shifted, 'IRRELEVANT' AS constant FROM q_errors), b AS (SELECT * FROM m UNION ALL SELECT * REPLACE ('combined' AS batch) FROM m),
l AS (SELECT batch, ref, 'once' AS method, once AS guess FROM b UNION ALL SELECT batch, ref, 'twice', twice FROM b UNION ALL SELECT batch, ref, 'shifted', shifted FROM b UNION ALL SELECT batch, ref, 'constant', constant FROM b)
"""


@query(GUESS_SQL + f"SELECT batch, method, count(*) AS n, round(count(*) FILTER (ref = guess) / count(*), 9) AS accuracy, {F1_SQL} AS macro_f1 FROM l GROUP BY batch, method")
def batch_metrics(t):
    return evaluate.batch_metrics(evaluate.side_by_side(*guesses(t), ["doc_id"], METHODS), METHODS)


@query(
    GUESS_SQL
    + "SELECT batch, count(*) AS pairs, count(*) FILTER (once = ref AND twice = ref AND shifted = ref AND constant = ref) AS all_right, count(*) FILTER (once <> ref AND twice <> ref AND shifted <> ref AND constant <> ref) AS all_wrong, count(*) FILTER (NOT (once = twice AND twice = shifted AND shifted = constant)) AS differ FROM b GROUP BY batch"
)
def batch_agreement(t):
    return evaluate.agreement(evaluate.side_by_side(*guesses(t), ["doc_id"], METHODS), METHODS)


@query(GUESS_SQL + 'SELECT batch, CAST((once = ref)::INT + 2 * (twice = ref)::INT + 4 * (shifted = ref)::INT + 8 * (constant = ref)::INT AS INTEGER) AS "right", count(*) AS pairs FROM b GROUP BY ALL')
def batch_patterns(t):
    return evaluate.right_patterns(evaluate.side_by_side(*guesses(t), ["doc_id"], METHODS))


@query(GUESS_SQL + "SELECT ref, method, guess, count(*) AS pairs FROM l WHERE batch = 'combined' AND (ref = 'CONTRADICT' OR guess = 'CONTRADICT') GROUP BY ALL")
def contradiction_patterns(t):
    return evaluate.contradictions(evaluate.side_by_side(*guesses(t), ["doc_id"], METHODS), METHODS)


# --- files, metadata, ranges, audits, runs ---------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT event_id, user_id % 4 AS f, octet_length(encode(event_type || ' ' || props)) AS bytes FROM events)
SELECT CAST(f AS INTEGER) AS f, count(*) AS lines, CAST(sum(bytes + 1) AS BIGINT) AS bytes, f = 2 AS altered FROM x GROUP BY f""",
    views=False,
)
def pinned_files(t):
    """Four folders of lines, pinned, then read as pinned; one has a letter changed since and is the only one that differs."""
    out = None
    for f in range(4):
        at, pins = fresh(t, f"lines{f}"), fresh(t, f"pins{f}")
        rows = t.events.filter(F.col("user_id") % 4 == f).select("event_id", F.concat_ws(" ", "event_type", "props").alias("value"))
        placed = rows.coalesce(1).sortWithinPartitions("event_id")
        placed.select("value").write.text(at)
        pinned.pin(t.spark, at, pins)
        now = at
        if f == 2:
            # The same file but for one letter of its last line.
            now = fresh(t, "changed")
            last = rows.agg(F.max("event_id")).first()[0]
            placed.select(F.when(F.col("event_id") == last, F.overlay("value", F.lit("#"), F.lit(2))).otherwise(F.col("value")).alias("value")).write.text(now)
        tree = lambda x: pinned.leaves(t.spark, x).select("leaf", "lines", "bytes", "digest")
        then = t.spark.read.parquet(pins).select("leaf", F.col("digest").alias("_then"))
        one = tree(now).join(then, "leaf", "full_outer").agg(F.lit(f).alias("f"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.max(~F.col("digest").eqNullSafe(F.col("_then"))).alias("altered"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT p_partkey, path, fault FROM (SELECT p_partkey, '$.deep.list[1].value.price' AS path, 'NOT_FINITE' AS fault FROM part WHERE p_partkey % 9 = 1
  UNION ALL SELECT p_partkey, '$.deep. ', 'BLANK_KEY' FROM part WHERE p_partkey % 9 = 2 UNION ALL SELECT p_partkey, '$.deep.list[0]', 'NOT_JSON' FROM part WHERE p_partkey % 9 = 3 UNION ALL SELECT p_partkey, '$', 'NOT_AN_OBJECT' FROM part WHERE p_partkey % 9 = 4)""",
    views=False,
)
def metadata_faults(t):
    """Nested metadata of parts: prices that are no numbers five levels down, blank names, dates, and values that are no mapping."""
    k = F.col("p_partkey") % 9
    price = F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    tree = lambda first, name: F.to_variant_object(F.struct(F.struct(F.array(first, F.to_variant_object(F.struct(F.struct(price.alias("price"), "p_size").alias("value")))).alias("list"), F.col("p_brand").alias(name)).alias("deep"), "p_type"))
    word, day = F.col("p_name").cast("variant"), F.date_add(F.lit("2020-01-01"), F.col("p_size")).cast("variant")
    rows = t.part.select("p_partkey", F.when(k == 4, word).when(k == 2, tree(word, " ")).when(k == 3, tree(day, "brand")).otherwise(tree(word, "brand")).alias("meta"))
    return frozen.metadata_faults(rows, "p_partkey", "meta")


@query(
    """WITH p AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS part FROM orders)
SELECT part, CASE WHEN part < 3 THEN 'first' ELSE 'second' END AS run, count(*) AS rows, CAST(min(o_orderkey) AS VARCHAR) AS first, CAST(max(o_orderkey) AS VARCHAR) AS last, count(*) FILTER (o_orderkey % 100 = 0) AS failed FROM p GROUP BY part""",
    views=False,
)
def range_runs(t):
    """Orders in parts of 1,000, computed by two runs: the first does three parts, the second what is missing, a third finds nothing."""
    out, lineage = fresh(t, "parts"), VersionedTable(t.spark, fresh(t, "lineage"))
    compute = lambda rows: rows.select("part", "o_orderkey", (F.col("o_totalprice") * 2).alias("double"), (F.col("o_orderkey") % 100 == 0).alias("failed"))
    for run, most in (("first", 3), ("second", None), ("third", None)):
        ranges.resume(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, compute, out, lineage, run, most_parts=most)
    rows = ranges.combined(t.spark, out, lineage).groupBy("part", "run").agg(n().alias("rows"))
    return rows.join(lineage.read().select("part", "first", "last", "failed"), "part").select("part", "run", "rows", "first", "last", "failed")


@query(
    """WITH e AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 500 AS block, value, event_id FROM events) SELECT block, 'BODY' AS fault FROM e GROUP BY block HAVING count(*) FILTER (event_id % 1777 = 5) > 0""",
    views=False,
)
def audit_faults(t):
    """Events as an audit in blocks of 500, sealed; then some values are changed."""
    entries = t.events.select("event_id", "user_id", "event_type", "value")
    seals = settled(audit.chained(entries, ["event_id"], 500))
    changed = entries.withColumn("value", F.when(F.col("event_id") % 1777 == 5, F.coalesce(F.col("value"), F.lit(0.0)) + 1).otherwise(F.col("value")))
    return audit.audit_faults(changed, seals, ["event_id"], 500)


@query("SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS keys FROM documents GROUP BY source", views=False)
def sample_provenance(t):
    return audit.provenance(t.documents, ["doc_id"], ["source"]).select("source", "rows", "keys")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS planned, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'COMPLETE' ELSE 'COMPLETE_WITH_FAILURES' END AS status FROM events GROUP BY user_id""",
    views=False,
)
def run_reports(t):
    """Every user's events as a run: planned, begun and ended items in a stream; the last report of each."""
    source, out = fresh(t, "run_events"), fresh(t, "reports")
    item, run = F.col("event_id").cast("string"), F.col("user_id").cast("string").alias("run_id")
    none = lambda kind: F.lit(None).cast(kind)
    plan = t.events.groupBy("user_id").agg(n().alias("c"), F.min("ts").alias("ts")).select(run, F.lit("PLAN").alias("kind"), none("string").alias("item"), F.col("c").alias("planned"), none("string").alias("error"), F.col("ts").alias("at"))
    start = t.events.select(run, F.lit("START").alias("kind"), item.alias("item"), none("long").alias("planned"), none("string").alias("error"), F.col("ts").alias("at"))
    bad = F.col("event_type") == "error"
    end = t.events.select(run, F.when(bad, "FAIL").otherwise("OK").alias("kind"), item.alias("item"), none("long").alias("planned"), F.when(bad, F.lit("error")).alias("error"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("at"))
    plan.unionByName(start).unionByName(end).write.parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    runs.use_rocksdb(t.spark)
    try:
        stream = t.spark.readStream.schema(runs.EVENT).parquet(source)
        q = runs.run_reports(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh(t, "offsets")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        t.spark.conf.set(name, before)
    told = t.spark.read.schema(runs.REPORT).parquet(out).filter("item IS NULL")
    last = told.groupBy("run_id").agg(F.max_by(F.struct("planned", "ok", "failed", "status"), F.col("ok") + F.col("failed")).alias("r"))
    return last.select("run_id", "r.*")


# --- verified loaders ------------------------------------------------------------------------------------------------


#: Rows of a file that only a whole task can read.
FILE_ROWS = 500_000


@query("SELECT count(*) AS pairs, CAST(sum(n_s) AS BIGINT) AS n_support, CAST(sum(n_i) AS BIGINT) AS n_irrelevant, round(sum(p_s), 2) AS p_support, count(*) FILTER (n_s = 10 OR n_c = 10 OR n_i = 10) AS certain FROM q_dist")
def uncertainty_file(t):
    """Uncertainties of all pairs written as CSV and loaded with every check."""
    d = uncertainty.pair_uncertainty(t.pairs())
    names = {"n_s": "n_support", "n_c": "n_contradict", "n_i": "n_irrelevant", "p_s": "p_support", "p_c": "p_contradict", "p_i": "p_irrelevant"}
    rows = d.withColumnsRenamed(names).select("question_id", "option", "doc_id", F.concat_ws("|", "question_id", "option", "doc_id").alias("pair_id"), F.lit("True").alias("evaluation_included"), *names.values(), "u_3", "u_directional", "relevance", "directional_score")
    at = fresh(t, "uncertainty")
    # Lines may go on inside quotes, so a file is read whole by one task: files are kept small.
    rows.write.option("header", True).option("maxRecordsPerFile", FILE_ROWS).csv(at)
    got = loaders.uncertainty_table(t.spark, at, ["question_id", "option", "doc_id"])
    certain = F.greatest("n_support", "n_contradict", "n_irrelevant") == 10
    return got.agg(n().alias("pairs"), F.sum("n_support").alias("n_support"), F.sum("n_irrelevant").alias("n_irrelevant"), F.round(F.sum("p_support"), 2).alias("p_support"), F.count_if(certain & (F.col("u_3") == 0)).alias("certain"))


@query(
    """WITH e AS (SELECT *, event_type || '/' || user_id AS said FROM events) SELECT event_id, CASE WHEN user_id % 5 <> 0 AND event_type <> 'error' AND event_id % 9 <> 0 THEN said END AS text,
  CASE WHEN event_type = 'error' THEN 'the service reports an error' WHEN user_id % 5 = 0 THEN 'incomplete generation' WHEN event_id % 9 = 0 THEN 'no generated text' END AS error FROM e""",
    views=False,
)
def completions(t):
    said = F.when(F.col("event_id") % 9 == 0, F.lit(" ")).otherwise(F.concat_ws("/", "event_type", "user_id"))
    reply = F.to_json(F.struct(said.alias("response"), (F.col("user_id") % 5 != 0).alias("done"), F.when(F.col("event_type") == "error", F.col("props")).alias("error")))
    return t.events.select("event_id", loaders.completion(reply).alias("c")).select("event_id", "c.*")


@query(
    """WITH l AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, p_partkey % 7 / 2.0::DOUBLE AS b, p_size % 3 * 1.0::DOUBLE AS c FROM part), s AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM l)
SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN round(ea / (ea + eb + ec), 6) END AS p_s, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN a > b AND a > c THEN 'SUPPORT' WHEN b > a AND b > c THEN 'CONTRADICT' WHEN c > a AND c > b THEN 'IRRELEVANT' END END AS label,
  CASE WHEN p_partkey % 11 <> 0 THEN greatest(a, b, c) IN (CASE WHEN a = b THEN a END, CASE WHEN b = c THEN b END, CASE WHEN a = c THEN a END) IS TRUE END AS is_tied, CASE WHEN p_partkey % 11 = 0 THEN 'scores must sum to one' END AS error FROM s""",
    views=False,
)
def scored_results(t):
    """Logits from parts, their softmax as a model would give it, and every eleventh a little too large."""
    a, b, c = F.col("p_size") / F.lit(10.0), F.col("p_partkey") % 7 / F.lit(2.0), (F.col("p_size") % 3).cast("double")
    logits = F.array(a, b, c)
    scores = F.array(*C.softmax3(a, b, c))
    off = F.when(F.col("p_partkey") % 11 == 0, F.transform(scores, lambda x: x * 1.001)).otherwise(scores)
    mapping = F.create_map(*[F.lit(x) for kv in zip("012", STANCES) for x in kv])
    got = t.part.select("p_partkey", C.scored_result(logits, off, mapping).alias("x")).select("p_partkey", "x.*")
    return got.select("p_partkey", F.round("p_s", 6).alias("p_s"), "label", "is_tied", "error")


# --- samples ---------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents), g AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS doc_id, CAST([] AS VARCHAR[]) AS langs, CAST([] AS VARCHAR[]) AS pairs
  UNION ALL SELECT n + 1, f.place, f.doc_id, list_append(langs, f.lang), list_append(pairs, f.pair) FROM (
    SELECT g.n, g.langs, g.pairs, min({'place': r.place, 'doc_id': r.doc_id, 'lang': coalesce(r.lang, ''), 'pair': coalesce(r.lang, '') || '/' || coalesce(r.source, '')}) AS f FROM g JOIN r
    ON r.place > g.place AND g.n < 60 AND len(list_filter(g.langs, lambda x: x = coalesce(r.lang, ''))) < 25 AND len(list_filter(g.pairs, lambda x: x = coalesce(r.lang, '') || '/' || coalesce(r.source, ''))) < 5 GROUP BY ALL))
SELECT doc_id, CAST(n AS INTEGER) AS position FROM g WHERE n > 0""",
    views=False,
)
def greedy_sample(t):
    """Sixty of the shortest documents, at most 25 of a language and five of a language and source."""
    caps, keys = {"lang": 25, "pair": 5}, {"lang": ("lang",), "pair": ("lang", "source")}
    return sampling.greedy_sample(t.documents.select("doc_id", "lang", "source", "n_chars"), ["n_chars", "doc_id"], caps, keys, 60, ahead=64).select("doc_id", "position")


@query()
def structural_sample(t):
    """Thirty blind pairs of ten questions; the generator's draws are beyond SQL."""
    docs = t.evidence().groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    pools = docs.select(F.col("question_id").alias("question"), F.array(*map(F.lit, "ABCDE")).alias("labels"), "docs")
    return sampling.structural_sample(pools)
