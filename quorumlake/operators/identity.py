"""Checks of identity: claims, labels, ids, cached responses, outgoing payloads and runs that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.evaluate import ranked

#: The prefix of ids made from physical lines, how many are open for development, and labels of inference models by stance.
ID_PREFIX, OPEN_IDS = "medqa-us-dev-", 30
SEMANTICS = {"entailment": "SUPPORT", "contradiction": "CONTRADICT", "neutral": "IRRELEVANT"}


def claim_status(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """claims with status: OK where the claim is its question's own option, else what differs.

    claims: question_id, option (label), claim (text); questions: question_id and
    options, an array of (label, text).  A claim without a question stays.
    """
    met = claims.join(questions.select("question_id", "options"), "question_id", "left")
    own = F.get(F.filter("options", lambda o: o["label"] == F.col("option")), F.lit(0))
    status = F.when(F.col("options").isNull(), "UNKNOWN_QUESTION").when(own.isNull(), "UNKNOWN_OPTION").when(~F.col("claim").eqNullSafe(own["text"]), "TEXT_DIFFERS").otherwise("OK")
    return met.withColumn("status", status).drop("options")


def same_identity(*pairs: tuple[Column, Column]) -> Column:
    """Whether the ids of question, claim and evidence that are to be scored together agree; null agrees with nothing."""
    ok = F.lit(True)
    for a, b in pairs:
        ok = ok & F.coalesce(a == b, F.lit(False))
    return ok


def label_mapping(names: Column) -> Column:
    """map of index to stance from a model's map of index to label; null unless it is one to one onto the three meanings."""
    low = F.transform_values(names, lambda k, v: F.lower(F.trim(v)))
    keys, values = F.array_sort(F.map_keys(names)), F.array_sort(F.map_values(low))
    fits = (keys == F.array(*map(F.lit, "012"))) & (values == F.array(*map(F.lit, sorted(SEMANTICS))))
    known = F.create_map(*[F.lit(x) for kv in SEMANTICS.items() for x in kv])
    return F.when(F.coalesce(fits, F.lit(False)), F.transform_values(low, lambda k, v: F.element_at(known, v)))


def development_id(value: Column, prefix: str = ID_PREFIX, most: int = OPEN_IDS) -> Column:
    """The number of an id that is open for development (1 to most, six digits), else null."""
    number = F.regexp_extract(value, rf"^{prefix}(\d{{6}})$", 1).try_cast("int")
    return F.when(number.between(1, most), number)


def adapted(rows: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Upstream records (line, question, options map, answer_idx, answer) as questions, with the reason where one is malformed.

    The id is the physical line; the answer's label must be an option's, and its
    text that option's.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    text = F.try_element_at("options", F.col("answer_idx"))
    reason = (
        F.when(blank(F.col("question")), "question must be a nonblank string").when(F.col("options").isNull() | (F.size("options") < 2), "at least two options")
        .when(blank(F.col("answer_idx")) | text.isNull(), "answer_idx must be an option's label").when(~F.col("answer").eqNullSafe(text), "answer and answer_idx differ")
    )
    index = (F.array_position(F.map_keys("options"), F.col("answer_idx")) - 1).cast("int")
    named = F.format_string(prefix + "%06d", F.col("line"))
    return rows.select(F.when(reason.isNull(), named).alias("question_id"), "line", "question", "options", F.when(reason.isNull(), index).alias("answer_index"), reason.alias("reason"))


def match_count(value: Column) -> Column:
    """A service's number of matches, given as text: ASCII digits only; null is not a count."""
    return F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast("long"))


def search_result_ok(value: Column) -> Column:
    """Whether a cached search (JSON) has no error and a list of ids that are digits."""
    v = F.try_parse_json(value)
    ids = F.try_variant_get(v, "$.idlist", "array<string>")
    kind = F.schema_of_variant(F.variant_get(v, "$.idlist", "variant"))
    error = F.variant_get(v, "$.error", "variant").isNotNull()
    return F.coalesce(~error & kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(ids, lambda x: x.rlike(r"\A[0-9]+\z")), F.lit(False))


def article_record_ok(value: Column, pmid: Column) -> Column:
    """Whether a cached article (JSON) is the one asked for and has the fields of a record."""
    v = F.try_parse_json(value)
    kind = lambda name: F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    ok = F.try_variant_get(v, "$.pmid", "string") == pmid
    for name in ("title", "abstract", "journal"):
        ok = ok & (kind(name) == "STRING")
    return F.coalesce(ok & kind("publication_date").isin("STRING", "VOID") & kind("publication_types").isin("ARRAY<STRING>", "ARRAY<VOID>") & kind("pubmed_metadata").startswith("OBJECT"), F.lit(False))


def payload_ok(payload: Column, fields: dict[str, str]) -> Column:
    """Whether an outgoing JSON object has exactly these fields with these scalar values: nothing else may leave."""
    got = F.from_json(payload, "map<string,string>")
    ok = F.size(got) == len(fields)
    for k, v in fields.items():
        ok = ok & (F.try_element_at(got, F.lit(k)) == F.lit(v))
    return F.coalesce(ok, F.lit(False))


def leaks(rows: DataFrame, allowed: list[str], flags: list[str]) -> DataFrame:
    """Columns that are not allowed, and flags that some row has not as false, with their numbers of rows."""
    extra = [c for c in rows.columns if c not in allowed and c not in flags]
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.lit(1)).alias(c) for c in extra], *[F.count_if(~F.coalesce(~F.col(c), F.lit(False))).alias(c) for c in flags])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit("field" if c in extra else "flag").alias("kind"), F.col(c).alias("n")) for c in [*extra, *flags]]).cast("array<struct<name:string,kind:string,n:bigint>>"))
    return counts.select(each.alias("x")).select("x.*").filter("kind = 'field' OR n > 0")


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys on which two sources disagree: only one has it, or which columns differ (comma-joined)."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_right"))
    both = left.select(*keys, *columns, F.lit(True).alias("_left")).join(r, keys, "full_outer")
    changed = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns])
    what = F.when(F.col("_right").isNull(), "only left").when(F.col("_left").isNull(), "only right").otherwise(changed)
    return both.select(*keys, what.alias("difference")).filter("difference <> ''")


def first_distinct(rows: DataFrame, order: list[str], n: int, key: str) -> DataFrame:
    """The first n rows in order, which must have n different keys; an error when the result is used otherwise."""
    placed = ranked(rows, order).filter(F.col("place") <= n)
    again = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    return placed.withColumn("_again", again).filter(F.assert_true(~F.col("_again"), F.lit(f"repeated {key}")).isNull()).drop("_again")


def chosen(rows: DataFrame, wanted: list[tuple], keys: list[str]) -> DataFrame:
    """Rows of an ordered list of keys, with their place in it; a key that is missing stays as a row with found = false."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    listed = rows.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(wanted)], f"position int, {kinds}")
    return F.broadcast(listed).join(rows.withColumn("_found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def unchanged_until(calls: DataFrame, run: str, order: list[str], observed: str, expected: Column) -> DataFrame:
    """Calls of each run with allowed: false from the first on whose observed identity is not the expected one."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    off = F.max((~F.col(observed).eqNullSafe(expected)).cast("int")).over(w)
    return calls.withColumn("allowed", off == 0)


def unsettled(intents: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Intents whose outcome is not in the cache: those that are valid there are done, however the run ended."""
    return intents.join(valid.select(*keys).distinct(), keys, "left_anti")


def id_batches(rows: DataFrame, key: str, order: list[str], size: int = 200) -> DataFrame:
    """Distinct ids in the order in which they first appear, in batches of `size` from 0."""
    rest = F.struct(*order)
    first = rows.groupBy(key).agg(F.min(rest).alias("_first"))
    return ranked(first, ["_first", key]).select(key, F.floor((F.col("place") - 1) / size).cast("long").alias("batch"), F.pmod(F.col("place") - 1, F.lit(size)).cast("long").alias("slot"))
