"""Registered queries of sources, checks, states and prompts, with DuckDB SQL; some write files first and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import columns as C
from quorumlake.functions import prompts
from quorumlake.functions import text as X
from quorumlake.operators import identity, payload, retrieval, searching, stance, state, uncertainty, validate
from quorumlake.plans.projection import SQL as VIEWS
from quorumlake.queries import CLAIM_SQL, INVENTORY_SQL, inventory, query, wide
from quorumlake.shared import folder
from quorumlake.sources import articles, connectors, records, sinks


def n() -> Column:
    return F.count(F.lit(1))


def fresh(t, name: str) -> str:
    return f"{folder(t.spark)}/quorumlake-{name}-{uuid.uuid4().hex}"


def picked(values: list, at: Column) -> Column:
    """The value at a 0-based place of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- scans ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT CASE WHEN c_custkey % 10 = 0 THEN 'invalid JSON' WHEN c_custkey % 10 = 1 THEN 'not an object' WHEN c_custkey % 10 = 2 THEN 'invalid JSON' ELSE 'record' END AS kind, count(*) AS n,
  CAST(coalesce(sum(CASE WHEN c_custkey % 10 > 2 THEN c_custkey END), 0) AS BIGINT) AS key_sum FROM customer GROUP BY kind""",
    views=False,
)
def scan_json_lines(t):
    k = F.col("c_custkey")
    good = F.to_json(F.struct(k.alias("k"), F.col("c_name").alias("name")))
    line = F.when(k % 10 == 0, F.lit("{not json")).when(k % 10 == 1, F.lit("[1]")).when(k % 10 == 2, F.lit('{"k": 1, "k": 2}')).otherwise(good)
    at = fresh(t, "lines")
    t.customer.select(line.alias("value")).write.text(at)
    ok, bad = records.json_records(t.spark, at)
    kept = ok.agg(F.lit("record").alias("kind"), n().alias("n"), F.sum(F.try_variant_get("record", "$.k", "long")).alias("key_sum"))
    return kept.unionByName(bad.groupBy(F.col("reason").alias("kind")).agg(n().alias("n"), F.lit(0).cast("long").alias("key_sum")))


QUESTION_REASONS = [None, "question must be a nonblank string", "at least two options", "answer is no option", None, None, None]


@query(
    f"SELECT coalesce(list_extract({listed(QUESTION_REASONS)}, CAST(p_partkey % 7 + 1 AS BIGINT)), 'question') AS kind, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 7 IN (0, 4, 5, 6) THEN CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS answers FROM part GROUP BY kind",
    views=False,
)
def scan_questions(t):
    # By key: label of a mapping, faults, text of a list's option, index of a list, label of a list.
    shape = ['{"A":"one","B":"two"}', '{"A":"one","B":"two"}', '["one"]', '["one","two"]', '["one","two","three"]', '["one","two","three"]', '["one","two"]']
    answer = ['"B"', '"A"', "0", '"four"', '"one"', "2", '"B"']
    k = F.col("p_partkey")
    stem = F.when(k % 7 == 1, F.lit(" ")).otherwise(F.concat(F.lit("What of "), k.cast("string")))
    line = F.format_string('{"id":"q%d","question":"%s","options":%s,"answer":%s}', k, stem, picked(shape, k), picked(answer, k))
    at = fresh(t, "questions")
    t.part.select(line.alias("value")).write.text(at)
    ok, bad = records.questions(t.spark, at)
    kept = ok.agg(F.lit("question").alias("kind"), n().alias("n"), F.sum("answer_index").cast("long").alias("answers"))
    return kept.unionByName(bad.groupBy(F.col("reason").alias("kind")).agg(n().alias("n"), F.lit(0).cast("long").alias("answers")))


@query(
    """SELECT CASE s_suppkey % 6 WHEN 1 THEN 'rank must be 1 or more' WHEN 2 THEN 'retrieval_score must be finite' WHEN 3 THEN 'schema_version' WHEN 4 THEN 'blank field' ELSE 'evidence' END AS kind, count(*) AS n,
  round(CAST(coalesce(sum(CASE WHEN s_suppkey % 6 IN (0, 5) THEN s_suppkey * 0.5 END), 0) AS DOUBLE), 6) AS score_sum, count(*) FILTER (s_suppkey % 6 IN (0, 5) AND s_suppkey % 2 = 0) AS supporting FROM supplier GROUP BY kind""",
    views=False,
)
def scan_evidence(t):
    k = F.col("s_suppkey")
    line = F.format_string(
        '{"schema_version":"%s","question_id":"q%d","doc_id":"d%d","rank":%d,"text":"%s","source":"s","evidence_type":"other","retrieval_score":%s,"annotated_stances":{"A":"%s"}}',
        F.when(k % 6 == 3, "1").otherwise("2.0"), k, k, F.when(k % 6 == 1, 0).otherwise(1), F.when(k % 6 == 4, " ").otherwise("t"),
        F.when(k % 6 == 2, F.lit('"high"')).otherwise((k * 0.5).cast("string")), F.when(k % 2 == 0, "SUPPORT").otherwise("IRRELEVANT"),
    )
    at = fresh(t, "evidence")
    t.supplier.select(line.alias("value")).write.text(at)
    ok, bad = records.evidence(t.spark, at)
    kept = ok.agg(F.lit("evidence").alias("kind"), n().alias("n"), F.round(F.sum("retrieval_score"), 6).alias("score_sum"), F.count_if(F.col("stances")["A"] == "SUPPORT").alias("supporting"))
    return kept.unionByName(bad.groupBy(F.col("reason").alias("kind")).agg(n().alias("n"), F.lit(0.0).alias("score_sum"), F.lit(0).cast("long").alias("supporting")))


@query("SELECT 'q' || s_suppkey AS question_id, 'Of ' || s_name AS question, 'Z=last,A=first' AS options, CAST(s_suppkey % 2 AS INTEGER) AS answer_index FROM supplier", views=False)
def question_round_trip(t):
    pair = lambda label, text: F.struct(F.lit(label).alias("label"), F.lit(text).alias("text"))
    rows = t.supplier.select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("question_id"), F.concat(F.lit("Of "), F.col("s_name")).alias("question"), F.array(pair("Z", "last"), pair("A", "first")).alias("options"), (F.col("s_suppkey") % 2).cast("int").alias("answer_index"))
    at = fresh(t, "written-questions")
    sinks.write_questions(rows, at)
    good, _ = records.questions(t.spark, at)
    return good.select("question_id", "question", F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["label"], o["text"])), ",").alias("options"), "answer_index")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY sha256('7|' || s_suppkey), s_suppkey) AS place FROM supplier", views=False)
def shuffled_rows(t):
    from quorumlake.operators.sampling import shuffled

    return shuffled(t.supplier.select("s_suppkey"), ["s_suppkey"], 7).select("s_suppkey", F.col("place").cast("long").alias("place"))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, count(*) FILTER (c_custkey % 5 = 0) AS empty_cells FROM customer GROUP BY c_mktsegment", views=False)
def csv_round_trip(t):
    at = fresh(t, "csv")
    # Quotes, commas and line ends inside cells, and empty cells.
    note = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('say "x", '), F.col("c_name"), F.lit("\nend")))
    sinks.write_csv_checked(t.customer.select("c_custkey", "c_mktsegment", note.alias("note")), at)
    back = records.csv_table(t.spark, at, "c_custkey long, c_mktsegment string, note string")
    blank = F.coalesce(F.col("note"), F.lit("")) == ""
    return back.groupBy("c_mktsegment").agg(n().alias("n"), F.sum("c_custkey").alias("keys"), F.count_if(blank).alias("empty_cells"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0", views=False)
def prefer_first_source(t):
    first = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("value"))
    second = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("value"))
    return records.prefer(first, second, ["c_custkey"], "value")


@query("SELECT question_id, query FROM (SELECT 'q' || s_suppkey AS question_id, CASE WHEN s_suppkey % 2 = 0 THEN 'a AND b' ELSE 'c' END || s_suppkey AS query FROM supplier)", views=False)
def query_overrides(t):
    at = fresh(t, "overrides")
    each = F.collect_list(F.format_string('"q%d": "%s%d"', "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "a AND b").otherwise("c"), "s_suppkey"))
    t.supplier.agg(F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}")).alias("value")).write.text(at)
    return records.overrides(t.spark, at)


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS pmid, 'About ' || s_name AS title, CASE s_suppkey % 3 WHEN 0 THEN 'AIM: To see' || chr(10) || 'that it works' WHEN 1 THEN 'other text' ELSE '' END AS abstract,
  CASE s_suppkey % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'other_abstract' ELSE 'none' END AS abstract_source, CASE WHEN s_suppkey % 2 = 0 THEN '2020-May' ELSE 'Spring 1999' END AS publication_date, 'Review,Editorial' AS types,
  'Doe|Jane|,Roe||R' AS people FROM supplier WHERE s_suppkey % 11 <> 0""",
    views=False,
)
def article_records(t):
    k = F.col("s_suppkey")
    own = '<Abstract><AbstractText Label="AIM">To  see</AbstractText><AbstractText>that <b>it</b> works</AbstractText></Abstract>'
    other = '<OtherAbstract Language="eng"><AbstractText>other text</AbstractText></OtherAbstract>'
    authors = "<AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><LastName>Roe</LastName><Initials>R</Initials></Author></AuthorList>"
    date = F.when(k % 2 == 0, "<Year>2020</Year><Month>May</Month>").otherwise("<MedlineDate>Spring 1999</MedlineDate>")
    # Every eleventh has no title and is no record.
    title = F.when(k % 11 != 0, F.concat(F.lit("<ArticleTitle>About <i>"), F.col("s_name"), F.lit("</i></ArticleTitle>"))).otherwise(F.lit(""))
    one = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), k.cast("string"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue></Journal>"), title,
        F.when(k % 3 == 0, own).otherwise(F.lit("")), F.lit(authors + "<PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Editorial</PublicationType></PublicationTypeList></Article>"),
        F.when(k % 3 == 1, other).otherwise(F.lit("")), F.lit("</MedlineCitation></PubmedArticle>"),
    )
    at = fresh(t, "articles")
    whole = t.supplier.select((k % 7).alias("file"), one.alias("x")).groupBy("file").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</PubmedArticleSet>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(at)
    people = F.transform("people", lambda p: F.concat_ws("|", F.coalesce(p["last"], F.lit("")), F.coalesce(p["fore"], F.lit("")), F.coalesce(p["initials"], F.lit(""))))
    trimmed = F.transform(people, lambda p: F.regexp_replace(p, r"^(Doe\|Jane)\|$", "$1|"))
    return articles.articles(t.spark, at).select("pmid", "title", "abstract", "abstract_source", "publication_date", F.array_join("publication_types", ",").alias("types"), F.array_join(trimmed, ",").alias("people"))


# --- checks --------------------------------------------------------------------------------------------------------


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 13 = 0 THEN 'UNKNOWN_QUESTION' WHEN i = 3 THEN 'UNKNOWN_OPTION' WHEN (c_custkey + i) % 7 = 0 THEN 'TEXT_DIFFERS' ELSE 'OK' END AS status
FROM customer, (SELECT unnest(range(0, 4)) AS i)) GROUP BY status""",
    views=False,
)
def claim_identity(t):
    k = F.col("c_custkey")
    label = lambda i: F.char(F.lit(65) + i)
    options = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(label(i).alias("label"), F.concat("c_mktsegment", i.cast("string")).alias("text")))
    questions = t.customer.filter(k % 13 != 0).select(k.alias("question_id"), options.alias("options"))
    each = t.customer.select(k.alias("question_id"), "c_mktsegment", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    claim = F.concat("c_mktsegment", F.col("i").cast("string"), F.when((F.col("question_id") + F.col("i")) % 7 == 0, "!").otherwise(""))
    claims = each.select("question_id", label(F.col("i")).alias("option"), claim.alias("claim"))
    return identity.claim_status(claims, questions).groupBy("status").agg(n().alias("n"))


MAPPINGS = [
    ("0:entailment,1:neutral,2:contradiction", "0"), ("0:CONTRADICTION,1:Neutral,2: Entailment ", "2"), ("0:LABEL_0,1:LABEL_1,2:LABEL_2", None), ("0:entailment,1:entailment,2:neutral", None), ("1:entailment,2:neutral,3:contradiction", None), ("0:entailment,1:contradiction", None),
]


@query(f"SELECT p_partkey, list_extract({listed([s for _, s in MAPPINGS])}, CAST(p_partkey % 6 + 1 AS BIGINT)) AS supports FROM part", views=False)
def label_mappings(t):
    got = identity.label_mapping(F.str_to_map(picked([m for m, _ in MAPPINGS], F.col("p_partkey"))))
    return t.part.select("p_partkey", F.get(F.map_keys(F.map_filter(got, lambda k, v: v == "SUPPORT")), F.lit(0)).alias("supports"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 AND c_custkey % 97 BETWEEN 1 AND 30 THEN CAST(c_custkey % 97 AS INTEGER) END AS number FROM customer", views=False)
def development_ids(t):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 3, F.format_string("medqa-us-dev-%05d", k % 97)).otherwise(F.format_string("medqa-us-dev-%06d", k % 97))
    return t.customer.select("c_custkey", identity.development_id(name).alias("number"))


@query(
    """SELECT reason, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(coalesce(sum(answer_index), 0) AS BIGINT) AS answers, min(question_id) AS first_id FROM (SELECT c_custkey + 1 AS line, CASE c_custkey % 6 WHEN 1 THEN 'question must be a nonblank string' WHEN 2 THEN 'at least two options'
  WHEN 3 THEN 'answer_idx must be an option''s label' WHEN 4 THEN 'answer and answer_idx differ' END AS reason, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 5 THEN 1 END AS answer_index,
  CASE WHEN c_custkey % 6 IN (0, 5) THEN 'medqa-us-dev-' || lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0') END AS question_id FROM customer) GROUP BY reason""",
    views=False,
)
def upstream_records(t):
    k = F.col("c_custkey")
    options = F.when(k % 6 == 2, F.create_map(F.lit("A"), F.lit("x"))).otherwise(F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y")))
    rows = t.customer.select(
        (k + 1).alias("line"), F.when(k % 6 == 1, " ").otherwise("stem").alias("question"), options.alias("options"), F.when(k % 6 == 3, "C").when(k % 6 == 5, "B").otherwise("A").alias("answer_idx"),
        F.when(k % 6 == 4, "z").when(k % 6 == 5, "y").otherwise("x").alias("answer"),
    )
    return identity.adapted(rows).groupBy("reason").agg(n().alias("n"), F.sum("line").alias("lines"), F.coalesce(F.sum("answer_index"), F.lit(0)).cast("long").alias("answers"), F.min("question_id").alias("first_id"))


COUNTS = [("12", 12), ("007", 7), ("-1", None), ("1.5", None), ("", None), ("x", None), ("0", 0), ("٣", None), ("1\n", None)]


@query(f"SELECT event_id, CAST(list_extract({listed([c for _, c in COUNTS])}, CAST(event_id % 9 + 1 AS BIGINT)) AS BIGINT) AS matches FROM events", views=False)
def match_counts(t):
    return t.events.select("event_id", identity.match_count(picked([c for c, _ in COUNTS], F.col("event_id"))).alias("matches"))


CACHED = [
    ('{"idlist": ["1", "22"]}', '{"pmid": "1", "title": "t", "abstract": "", "journal": "j", "publication_date": null, "publication_types": ["Review"], "pubmed_metadata": {}}', True, True),
    ('{"idlist": []}', '{"pmid": "1", "title": "t", "abstract": "a", "journal": "j", "publication_date": "2020", "publication_types": [], "pubmed_metadata": {"k": 1}}', True, True),
    ('{"idlist": ["1"], "error": "x"}', '{"pmid": "2", "title": "t", "abstract": "a", "journal": "j", "publication_date": "2020", "publication_types": [], "pubmed_metadata": {}}', False, False),
    ('{"idlist": ["a1"]}', '{"pmid": "1", "title": 5, "abstract": "a", "journal": "j", "publication_date": "2020", "publication_types": [], "pubmed_metadata": {}}', False, False),
    ('{"ids": ["1"]}', '{"pmid": "1", "title": "t", "abstract": "a", "journal": "j", "publication_types": [], "pubmed_metadata": {}}', False, False),
    ("broken", '{"pmid": "1", "title": "t", "abstract": "a", "journal": "j", "publication_date": "2020", "publication_types": "Review", "pubmed_metadata": {}}', False, False),
]


@query(f"SELECT event_id, list_extract({listed([r[2] for r in CACHED])}, CAST(event_id % 6 + 1 AS BIGINT)) AS search_ok, list_extract({listed([r[3] for r in CACHED])}, CAST(event_id % 6 + 1 AS BIGINT)) AS article_ok FROM events", views=False)
def cache_validity(t):
    k = F.col("event_id")
    return t.events.select("event_id", identity.search_result_ok(picked([r[0] for r in CACHED], k)).alias("search_ok"), identity.article_record_ok(picked([r[1] for r in CACHED], k), F.lit("1")).alias("article_ok"))


@query("SELECT event_id, event_type = 'click' AND event_id % 3 <> 0 AS allowed FROM events", views=False)
def outbound_guard(t):
    # Every third payload carries one field more.
    more = F.when(F.col("event_id") % 3 == 0, F.lit(', "user": "1"')).otherwise("")
    sent = F.format_string('{"model": "m", "kind": "%s"%s}', "event_type", more)
    return t.events.select("event_id", identity.payload_ok(sent, {"model": "m", "kind": "click"}).alias("allowed"))


@query("SELECT * FROM (SELECT 'seen' AS name, 'flag' AS kind, count(*) FILTER (c_custkey % 50 = 7) AS n FROM customer UNION ALL SELECT 'c_acctbal', 'field', count(*) FROM customer)", views=False)
def leakage_audit(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 50 == 7).alias("seen"), F.lit(False).alias("labelled"))
    return identity.leaks(rows, ["c_custkey", "c_name"], ["seen", "labelled"])


@query(
    """SELECT coalesce(l.k, r.k) AS c_custkey, CASE WHEN r.k IS NULL THEN 'only left' WHEN l.k IS NULL THEN 'only right' ELSE concat_ws(',', CASE WHEN l.a <> r.a THEN 'c_name' END, CASE WHEN l.b <> r.b THEN 'c_mktsegment' END) END AS difference
FROM (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 11 <> 0) l FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_name END AS a, CASE WHEN c_custkey % 7 = 0 THEN 'y' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 13 <> 0) r ON l.k = r.k
WHERE r.k IS NULL OR l.k IS NULL OR l.a <> r.a OR l.b <> r.b""",
    views=False,
)
def verified_inputs(t):
    k = F.col("c_custkey")
    left = t.customer.filter(k % 11 != 0)
    right = t.customer.filter(k % 13 != 0).withColumns({"c_name": F.when(k % 5 == 0, "x").otherwise(F.col("c_name")), "c_mktsegment": F.when(k % 7 == 0, "y").otherwise(F.col("c_mktsegment"))})
    return identity.differences(left, right, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 30", views=False)
def first_distinct_rows(t):
    rows = t.customer.withColumn("less", -F.col("c_acctbal"))
    return identity.first_distinct(rows, ["less", "c_custkey"], 30, "c_name").select("c_custkey", "c_name", F.col("place").cast("long").alias("place"))


@query("SELECT w.position, w.k AS c_custkey, c_name, c_name IS NOT NULL AS found FROM (VALUES (0, 5::BIGINT), (1, 3), (2, 1000000000), (3, 8)) w(position, k) LEFT JOIN customer ON c_custkey = w.k", views=False)
def chosen_rows(t):
    return identity.chosen(t.customer.select("c_custkey", "c_name"), [(5,), (3,), (1_000_000_000,), (8,)], ["c_custkey"]).select("position", "c_custkey", "c_name", "found")


@query("SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 0 AS allowed FROM events", views=False)
def identity_guard(t):
    seen = t.events.withColumn("model", F.when(F.col("event_type") == "error", "other").otherwise("m"))
    return identity.unchanged_until(seen, "user_id", ["ts", "event_id"], "model", F.lit("m")).select("event_id", "allowed")


QUERIES_RAW = [('  "heart  failure AND x" \n', "heart failure AND x"), ("a\nb", None), ("- a", None), ("Query: a", None), ('{"q": 1}', None), ("'one'", "one"), ("```x```", None), ("plain", "plain"), ("", None)]


@query(f"SELECT p_partkey, list_extract({listed([q for _, q in QUERIES_RAW])}, CAST(p_partkey % 9 + 1 AS BIGINT)) AS query FROM part", views=False)
def one_line_queries(t):
    return t.part.select("p_partkey", validate.one_line_query(picked([r for r, _ in QUERIES_RAW], F.col("p_partkey"))).alias("query"))


@query("SELECT count(*) AS pairs, count(*) FILTER (n_s % 4 <> 1) AS valid FROM q_pair")
def frequency_checks(t):
    good = uncertainty.pair_uncertainty(t.pairs())
    # A quarter of the counts is off by one, without its probabilities.
    rows = good.withColumn("n_s", F.when(F.col("n_s") % 4 == 1, F.col("n_s") + 1).otherwise(F.col("n_s")))
    return rows.agg(n().alias("pairs"), F.count_if(validate.frequency_ok()).alias("valid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'missing' ELSE 'unexpected' END AS difference FROM customer WHERE c_custkey % 6 IN (2, 4, 3)", views=False)
def key_inventory(t):
    k = F.col("c_custkey")
    return validate.key_differences(t.customer.filter(k % 2 == 0), t.customer.filter(k % 3 == 0), ["c_custkey"])


# --- stances, sentences and prompts --------------------------------------------------------------------------------

ANSWERS = [
    ('{"SUPPORT": 0.5, "CONTRADICT": 0.25, "IRRELEVANT": 0.25}', 0.5), (' {"IRRELEVANT": 0, "CONTRADICT": 0, "SUPPORT": 1}\n', 1.0), ('{"SUPPORT": 0.5, "SUPPORT": 0.5, "CONTRADICT": 0.25, "IRRELEVANT": 0.25}', None), ('Answer: {"SUPPORT": 1, "CONTRADICT": 0, "IRRELEVANT": 0}', None),
    ('{"SUPPORT": NaN, "CONTRADICT": 0, "IRRELEVANT": 0}', None), ('{"SUPPORT": true, "CONTRADICT": 0, "IRRELEVANT": 0}', None), ('{"SUPPORT": 0.5, "CONTRADICT": 0.5}', None), ('{"SUPPORT": 0.5, "CONTRADICT": 0.4, "IRRELEVANT": 0.2}', None), ("", None),
]


@query(f"SELECT event_id, list_extract({listed([p for _, p in ANSWERS])}::DOUBLE[], CAST(event_id % 9 + 1 AS BIGINT)) AS p_s, event_id % 9 > 1 AS rejected FROM events", views=False)
def strict_answers(t):
    got = t.events.select("event_id", stance.strict_distribution(picked([a for a, _ in ANSWERS], F.col("event_id"))).alias("x"))
    return got.select("event_id", "x.p_s", F.col("x.error").isNotNull().alias("rejected"))


CODED = [(" 1\n", "SUPPORT"), ("2", "CONTRADICT"), ("3 ", "IRRELEVANT"), ("4", None), ("1.", None), ("one", None), ("", None)]


@query(f"SELECT event_id, list_extract({listed([s for _, s in CODED])}, CAST(event_id % 7 + 1 AS BIGINT)) AS stance FROM events", views=False)
def class_codes(t):
    return t.events.select("event_id", stance.class_code(F.trim(F.regexp_replace(picked([c for c, _ in CODED], F.col("event_id")), r"\s+", " "))).alias("stance"))


@query(
    """WITH l AS (SELECT vec_id, label AS pair, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
e AS (SELECT *, exp(a - greatest(a, b, c)) AS x, exp(b - greatest(a, b, c)) AS y, exp(c - greatest(a, b, c)) AS z FROM l), p AS (SELECT pair, i, x / (x + y + z) AS s, y / (x + y + z) AS c FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY greatest(s, c) DESC, i) AS place FROM p)
SELECT pair, CASE WHEN pair % 4 = 3 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN pair % 4 <> 3 THEN CAST(i AS INTEGER) END AS sentence_index, CASE WHEN pair % 4 <> 3 THEN round(s, 6) END AS p_s, CASE WHEN pair % 4 <> 3 THEN round(c, 6) END AS p_c FROM o WHERE place = 1""",
    views=False,
)
def sentence_max_pairs(t):
    from pyspark.sql import Window

    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    p = dict(zip(("p_s", "p_c", "p_i"), C.softmax3(*x)))
    at = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("sentence_index")
    # In every fourth pair one sentence has failed, and with it the pair.
    failed = F.when((F.col("pair") % 4 == 3) & (F.col("sentence_index") == 0), "FAILED").otherwise("SUCCESS")
    rows = t.embeddings.select(F.col("label").alias("pair"), at, *[v.alias(k) for k, v in p.items()]).withColumn("status", failed)
    return stance.sentence_max(rows, ["pair"]).select("pair", "status", "sentence_index", F.round("p_s", 6).alias("p_s"), F.round("p_c", 6).alias("p_c"))


@query(
    """SELECT s_suppkey, i AS sentence_index, CASE WHEN i = 0 THEN 'title' ELSE 'abstract' END AS source, CASE WHEN i > 0 THEN CAST(i - 1 AS INTEGER) END AS abstract_index,
  CASE i WHEN 0 THEN s_name WHEN 1 THEN 'Dr. Ray gave 3.5 mg!' WHEN 2 THEN 'Does no. ' || s_suppkey || ' help?' ELSE 'J. Doe et al. agree' END AS text FROM supplier, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i)""",
    views=False,
)
def evidence_sentence_list(t):
    abstract = F.format_string("Dr. Ray gave 3.5 mg! Does no. %d help?\n J. Doe et al. agree", "s_suppkey")
    got = prompts.evidence_sentences(F.concat(F.lit(" "), F.col("s_name")), X.sentences(abstract))
    return t.supplier.select("s_suppkey", F.explode(got).alias("x")).select("s_suppkey", "x.*")


@query(
    f"""SELECT s_suppkey, '{prompts.CODE}' || chr(10) || '{{"candidate_option_text":"' || s_nationkey || '","evidence_abstract":null,"evidence_title":"' || s_name || '","question_stem":"a \\"b\\""}}' AS prompt,
  '{prompts.SEARCHES["core"]}' || chr(10) || '{{"earlier_queries":["x","y"],"question_id":"' || s_suppkey || '","question_stem":"a \\"b\\""}}' AS search FROM supplier""",
    views=False,
)
def prompt_texts(t):
    stem = F.lit('a "b"')
    one = prompts.stance_prompt(stem, F.col("s_nationkey").cast("string"), F.col("s_name"), F.lit(None).cast("string"), prompts.CODE)
    two = prompts.search_prompt("core", F.col("s_suppkey").cast("string"), stem, F.array(F.lit("x"), F.lit("y")))
    return t.supplier.select("s_suppkey", one.alias("prompt"), two.alias("search"))


@query("SELECT doc_id, n_chars AS tokens, n_chars > least(512, 200 + doc_id % 600) AS truncated, greatest(n_chars - least(512, 200 + doc_id % 600), 0) AS lost FROM documents", views=False)
def truncation_counts(t):
    least, _ = stance.truncation(F.col("n_chars"), [F.lit(512), (F.col("doc_id") % 600 + 200)])
    return t.documents.select("doc_id", prompts.untruncated_length(F.col("n_chars"), least).alias("x")).select("doc_id", "x.tokens", "x.truncated", F.col("x.lost").alias("lost"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'T ' || o_custkey ELSE 'T ' || o_custkey || chr(10) || 'A' END AS premise, 'Stem ' || o_orderkey || ' B' AS hypothesis FROM orders", views=False)
def pair_texts(t):
    title = F.concat(F.lit(" T "), F.col("o_custkey").cast("string"))
    abstract = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(" A ")
    return t.orders.select("o_orderkey", X.premise(title, abstract).alias("premise"), X.hypothesis(F.concat(F.lit("Stem "), F.col("o_orderkey").cast("string")), F.lit(" B ")).alias("hypothesis"))


@query("SELECT s_suppkey, sha256('name ' || s_name) AS digest, CASE WHEN s_suppkey % 3 = 0 THEN sha256('name ' || s_name) END AS bare, 'Timeout_2' AS failure FROM supplier", views=False)
def digests(t):
    own = F.sha2(F.concat(F.lit("name "), F.col("s_name")), 256)
    given = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" sha256:"), F.upper(own))).otherwise(F.substr(own, F.lit(1), F.lit(63)))
    return t.supplier.select("s_suppkey", own.alias("digest"), X.digest_of(F.regexp_replace(given, "SHA256", "sha256")).alias("bare"), X.error_class(F.lit("Time-out!_2")).alias("failure"))


# --- retrieval from services ---------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'manual' WHEN c_custkey % 3 = 0 THEN 'model' WHEN c_custkey % 5 <> 0 THEN 'keyword' END AS source,
  CASE WHEN c_custkey % 4 = 0 THEN 'm' WHEN c_custkey % 3 = 0 THEN 'l' WHEN c_custkey % 5 <> 0 THEN 'k' END || CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS query FROM customer""",
    views=False,
)
def query_priority(t):
    k = F.col("c_custkey")
    named = lambda c, x, other: F.when(c, F.concat(F.lit(x), k.cast("string"))).otherwise(other)
    got = searching.query_choice(named(k % 4 == 0, "m", F.lit(None)), named(k % 3 == 0, "l", F.lit("  ")), named(k % 5 != 0, "k", F.lit(None)))
    return t.customer.select("c_custkey", got.alias("x")).select("c_custkey", "x.source", "x.query")


@query("SELECT c_custkey, c_nationkey AS asked, n_regionkey AS result, (SELECT count(DISTINCT c_nationkey) FROM customer) AS searches FROM customer JOIN nation ON c_nationkey = n_nationkey", views=False)
def searches_once(t):
    look = lambda q: q.join(t.nation.select(F.col("n_nationkey").alias("query"), F.col("n_regionkey").alias("result")), "query", "left")
    got, made = searching.searched_once(t.customer.select("c_custkey", F.col("c_nationkey").alias("query")), look)
    return got.crossJoin(F.broadcast(made.agg(n().alias("searches")))).select("c_custkey", F.col("query").alias("asked"), "result", "searches")


HIT_SQL = """WITH h AS (SELECT l_orderkey AS question_id, l_partkey AS pmid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position FROM lineitem), f AS (SELECT question_id, pmid, min(position) AS position FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position) AS doc_rank FROM f)
"""


def hits(t) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("pmid"), (F.row_number().over(w) - 1).alias("position"))


@query(HIT_SQL + "SELECT question_id, CAST(doc_rank AS INTEGER) AS doc_rank, pmid, p_size FROM r JOIN part ON pmid = p_partkey WHERE doc_rank <= 3 AND p_partkey % 6 <> 0", views=False)
def ranked_records(t):
    # Every sixth record is missing: the ranks keep their gap.
    found = t.part.filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("pmid"), "p_size")
    return searching.ranked_records(hits(t), found, 3).select("question_id", "doc_rank", "pmid", "p_size")


@query(
    HIT_SQL
    + """SELECT h.question_id, count(*) AS returned, count(DISTINCT pmid) AS distinct_ids, least(count(DISTINCT pmid), 3) AS asked, coalesce(max(found), 0) AS found, least(count(DISTINCT pmid), 3) - coalesce(max(found), 0) AS missing
FROM h LEFT JOIN (SELECT question_id, count(*) AS found FROM r WHERE doc_rank <= 3 AND pmid % 6 <> 0 GROUP BY ALL) f ON h.question_id = f.question_id GROUP BY h.question_id""",
    views=False,
)
def search_counters(t):
    return searching.search_counters(hits(t), t.part.filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("pmid")), 3)


@query("SELECT event_type AS stage, count(*) AS searches, count(*) FILTER (user_id % 3 = 0) AS cache_hits, CAST(sum(event_id % 40) AS BIGINT) AS matches FROM events GROUP BY event_type", views=False)
def search_audits(t):
    return searching.search_audit(t.events.select(F.col("event_type").alias("stage"), (F.col("user_id") % 3 == 0).alias("cache_hit"), (F.col("event_id") % 40).alias("count")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'old' ELSE s_name END AS title, 2 AS parser_version, s_suppkey % 3 <> 2 AS reparsed, s_suppkey * 10 AS fetched_at FROM supplier", views=False)
def record_upgrade(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("<t>"), F.col("s_name"), F.lit("</t>")).alias("raw"), F.lit("old").alias("title"), F.when(k % 3 == 0, 1).when(k % 3 == 2, 2).alias("parser_version"), (k * 10).alias("fetched_at"))
    parse = lambda raw: F.struct(F.xpath_string(raw, F.lit("/t")).alias("title"))
    return searching.upgraded(rows, parse, 2, ["title"]).select("s_suppkey", "title", "parser_version", "reparsed", "fetched_at")


@query("SELECT o_orderkey AS question_id, 'Stem ' || o_custkey AS question, 'q' || o_orderkey AS query FROM orders", views=False)
def stem_joins(t):
    questions = t.orders.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("Stem "), F.col("o_custkey").cast("string")).alias("question"))
    cached = questions.select("question_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("query"), F.sha2("question", 256).alias("stem_sha"))
    return searching.stem_checked(cached, questions).select("question_id", "question", "query")


@query("SELECT l_partkey AS pmid, CAST((place - 1) // 200 AS BIGINT) AS batch, CAST((place - 1) % 200 AS BIGINT) AS slot FROM (SELECT l_partkey, row_number() OVER (ORDER BY min(l_orderkey), l_partkey) AS place FROM lineitem GROUP BY l_partkey)", views=False)
def fetch_batches(t):
    return identity.id_batches(t.lineitem.select(F.col("l_partkey").alias("pmid"), F.col("l_orderkey").alias("asked")), "pmid", ["asked"])


@query(
    """SELECT source, status, count(*) AS n, CAST(sum(length(response)) AS BIGINT) AS characters FROM (SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'cache' ELSE 'call' END AS source, CASE WHEN c_nationkey % 3 <> 0 AND c_nationkey % 5 = 1 THEN 'FAILED' ELSE 'VALID' END AS status,
  CASE WHEN c_nationkey % 3 = 0 THEN 'kept' WHEN c_nationkey % 5 <> 1 THEN upper('ask ' || c_nationkey) END AS response FROM (SELECT DISTINCT c_nationkey FROM customer)) GROUP BY ALL""",
    views=False,
)
def cached_responses(t):
    def backend():
        def call(request: str) -> str:
            if int(request.split()[1]) % 5 == 1:
                raise ValueError("refused")
            return request.upper()

        return call

    k = F.col("c_nationkey")
    requests = t.customer.select(F.concat(F.lit("k"), k.cast("string")).alias("cache_key"), F.concat(F.lit("ask "), k.cast("string")).alias("request"), (k % 3).alias("m"))
    known = requests.filter("m < 2").distinct().select("cache_key", "request", F.lit("kept").alias("response"), F.lit("VALID").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), "m")
    # One third of the cache was altered after it was sealed, so it is asked again.
    cache = connectors.sealed(known.drop("m")).join(known.select("cache_key", "m"), "cache_key").withColumn("digest", F.when(F.col("m") == 0, F.col("digest")).otherwise(F.lit("forged"))).drop("m")
    every, made = connectors.cached_calls(requests.drop("m"), cache, backend, pause=0.0)
    source = F.when(F.col("asked"), "call").otherwise("cache")
    told = every.join(made.select("cache_key", F.lit(True).alias("asked")), "cache_key", "left")
    return told.groupBy(source.alias("source"), "status").agg(n().alias("n"), F.sum(F.length("response")).alias("characters"))


# --- states --------------------------------------------------------------------------------------------------------

STATE = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'VALID' WHEN c_custkey % 3 = 0 THEN 'FAILED' WHEN c_custkey % 5 = 0 THEN 'INTERRUPTED' ELSE 'MISSING' END AS status FROM customer"""


def states(t) -> DataFrame:
    some = lambda m: t.customer.filter(F.col("c_custkey") % m == 0).select("c_custkey")
    return state.scan_states(t.customer.select("c_custkey"), some(2), some(3), some(5), ["c_custkey"])


@query(STATE, views=False)
def sample_states(t):
    return states(t).select("c_custkey", "status")


@query(f"SELECT c_custkey FROM ({STATE}) WHERE status NOT IN ('VALID', 'FAILED')", views=False)
def pending_keys(t):
    return state.pending(t.customer.select("c_custkey"), states(t), keys=["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0", views=False)
def unsettled_intents(t):
    some = lambda m: t.customer.filter(F.col("c_custkey") % m == 0).select("c_custkey")
    return identity.unsettled(some(3), some(2), ["c_custkey"])


@query("SELECT user_id, arg_max(event_type, event_id) AS value, max(event_id) AS revision FROM events GROUP BY user_id", views=False)
def journal_fold(t):
    return state.fold_journal(t.events.select("user_id", F.col("event_type").alias("value"), F.col("event_id").alias("revision")), ["user_id"])


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id", views=False)
def first_writers(t):
    return state.first_writer(t.events.select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(
    """WITH c AS (SELECT c_custkey AS revision, CASE WHEN c_custkey % 97 = 5 THEN 'lost' ELSE 's' || (c_custkey - 1) END AS parent, lag('s' || c_custkey) OVER (ORDER BY c_custkey) AS before FROM customer)
SELECT revision FROM c WHERE parent IS DISTINCT FROM before""",
    views=False,
)
def broken_links(t):
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    chain = t.customer.select(k.alias("revision"), name(k).alias("sha"), F.when(k % 97 == 5, "lost").otherwise(name(k - 1)).alias("parent_sha"))
    return state.broken_links(chain).select("revision")


@query(
    """WITH w AS (SELECT user_id, event_id, event_type, event_type IN ('click', 'purchase') AS ok, first_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM events)
SELECT event_id FROM w WHERE kept IS NOT NULL AND event_type <> kept""",
    views=False,
)
def overwritten_values(t):
    rows = t.events.select("user_id", "event_id", F.col("event_type").alias("value"), F.when(F.col("event_type").isin("click", "purchase"), "VALID").otherwise("FAILED").alias("status"))
    return state.overwritten_valid(rows, ["user_id"], revision="event_id").select("event_id")


@query("SELECT s_suppkey AS path, s_suppkey % 50 AS valid FROM supplier WHERE s_suppkey % 50 >= 10 ORDER BY s_suppkey % 50 DESC, s_suppkey % 50 + s_suppkey % 7 DESC, s_suppkey % 3 DESC, s_suppkey DESC LIMIT 1", views=False)
def best_checkpoint(t):
    k = F.col("s_suppkey")
    return state.best_checkpoint(t.supplier.select(k.alias("path"), (k % 50).alias("valid"), (k % 7).alias("failed"), (k % 3).alias("created_at")), 10).select("path", "valid")


@query("SELECT s_suppkey AS path FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0", views=False)
def changed_files(t):
    k = F.col("s_suppkey")
    before = t.supplier.filter(k % 7 != 0).select(k.alias("path"), F.col("s_name").alias("sha"))
    after = t.supplier.filter((k % 11 != 0) | (k % 7 == 0)).select(k.alias("path"), F.when(k % 5 == 0, "x").otherwise(F.col("s_name")).alias("sha"))
    return state.changed_files(before, after).select("path")


# --- whole runs ----------------------------------------------------------------------------------------------------


@query(
    """SELECT "group", field, count(v) AS n, round(avg(v), 9) AS mean, round(median(v), 9) AS median, min(v) AS least, max(v) AS largest, round(CASE WHEN count(v) = 1 THEN 0.0 ELSE stddev_samp(v) END, 9) AS deviation FROM (
  SELECT unnest(CASE WHEN error THEN ['all', 'incorrect'] ELSE ['all', 'correct'] END) AS "group", f.field, CASE f.field WHEN 'u' THEN u ELSE CAST(n_chars AS DOUBLE) END AS v FROM q_errors, (VALUES ('u'), ('n_chars')) f(field)) GROUP BY ALL"""
)
def evaluation_groups(t):
    return payload.grouped_description(t.errors(), ["u", "n_chars"])


@query("SELECT ref, count(*) AS n, count(*) FILTER (error) AS errors, round(avg(u), 9) AS mean_u, round(count(*) FILTER (NOT error) / count(*), 9) AS accuracy FROM q_errors GROUP BY ref")
def evaluation_by_reference(t):
    return payload.by_reference(t.errors(), ["u"])


@query(
    INVENTORY_SQL
    + "SELECT expected, valid, CASE WHEN valid = expected THEN 'FINAL_EVALUATION' ELSE 'PARTIAL_DIAGNOSTIC' END AS mode FROM (SELECT count(*) AS expected, count(*) FILTER (status = 'VALID') AS valid FROM q_inventory UNION ALL SELECT count(*), count(*) FROM q_inventory WHERE status = 'VALID')"
)
def run_gates(t):
    rows = inventory(t)
    both = uncertainty.status_summary(rows).unionByName(uncertainty.status_summary(rows.filter("status = 'VALID'")))
    return payload.run_gate(both).select("expected", "valid", "mode")


@query("SELECT error, count(*) AS n, count(*) FILTER (ref <> guess) AS changed, count(*) FILTER (ref = guess) AS agreed, round(100.0 * count(*) FILTER (n_chars > 2000) / count(*), 6) AS truncated_percent FROM q_errors GROUP BY error")
def run_comparison(t):
    return t.errors().groupBy("error").agg(*payload.compared(F.col("ref"), F.col("guess"), F.col("n_chars") > 2000))


@query("SELECT CAST(c_custkey % 4 + 2 AS INTEGER) AS n_options, count(*) AS questions, CAST(sum(c_custkey % 4 + 2) AS BIGINT) AS claims, min(c_custkey) AS first_id FROM customer GROUP BY c_custkey % 4", views=False)
def question_inspection(t):
    options = F.array_repeat(F.lit("x"), (F.col("c_custkey") % 4 + 2).cast("int"))
    return payload.inspected(t.customer.select(F.col("c_custkey").alias("question_id"), options.alias("options")))


@query(CLAIM_SQL + "SELECT count(*) AS claims, count(*) FILTER (abs(score_c - score_d) > 1e-12) AS violations FROM q_wide WHERE weighted = 1 AND score_c IS NOT NULL AND score_d IS NOT NULL")
def single_contributors(t):
    return payload.cancelled(wide(t), F.size(F.filter("diagnostics", lambda x: x["quality"] > 0)))


@query("SELECT CAST(question_id AS VARCHAR) AS question_id, '[' || string_agg('\"' || doc_id || '\"', ',' ORDER BY doc_rank) || ']' AS docs, CASE WHEN count(*) > 2 THEN 'many' ELSE '' END AS note FROM q_evidence GROUP BY question_id")
def flat_export(t):
    listed_ = t.evidence().groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    return payload.flat(listed_.withColumn("note", F.when(F.size("docs") > 2, "many")))


@query(
    """WITH e AS (SELECT c_acctbal AS u, c_custkey % 7 = 0 AS error FROM customer), b AS (SELECT u, count(*) FILTER (error) AS e, count(*) FILTER (NOT error) AS c FROM e GROUP BY u), r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(e) OVER (ORDER BY u DESC) AS ce, sum(e + c) OVER (ORDER BY u DESC) AS cn FROM b)
SELECT round(CAST(sum(e * (below + c / 2.0)) / (sum(e) * sum(c)) AS DOUBLE), 9) AS auroc, round(CAST(sum(e * (ce / cn)) / sum(e) AS DOUBLE), 9) AS average_precision FROM r""",
    views=False,
)
def eval_continuous_score(t):
    # As many distinct scores as rows: sums run over ranges of scores, not in one task.
    from quorumlake.operators import evaluate

    rows = t.customer.select(F.col("c_acctbal").alias("u"), (F.col("c_custkey") % 7 == 0).alias("error"))
    return evaluate.error_detection(rows).select(F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))
