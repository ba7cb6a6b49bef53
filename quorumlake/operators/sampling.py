"""Annotation samples: seeded structural pairs, lexical features and greedy capped selection."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.text import relations, tokens, units
from quorumlake.operators.evaluate import ranked
from quorumlake.shared import settled


def structural_pairs(pools: list[tuple[str, list[str], list[str]]], seed: int = 42, questions: int = 10, options: int = 3) -> list[tuple[str, str, str, str]]:
    """Blind pairs (pair_id, question, option, document): of `questions` with three documents or more, distinct options with the first, middle and last document.

    The Mersenne Twister runs on the driver, over the questions' ids and not
    their evidence, so one seed gives one sample.
    """
    r = random.Random(seed)
    eligible = sorted((p for p in pools if len(p[2]) >= 3), key=lambda p: p[0])
    if len(eligible) < questions:
        raise ValueError("too few eligible questions")
    pairs = []
    for question, labels, docs in sorted(r.sample(eligible, questions)):
        chosen = r.sample(labels, options)
        pairs += [(question, o, d) for o, d in zip(chosen, (docs[0], docs[len(docs) // 2], docs[-1]))]
    r.shuffle(pairs)
    return [(f"pair-{k:03d}", *p) for k, p in enumerate(pairs, 1)]


def structural_sample(pools: DataFrame, seed: int = 42, questions: int = 10, options: int = 3) -> DataFrame:
    """structural_pairs over a frame of any size: question, labels (array) and docs (array in rank order); pair_id, question, option, document.

    The generator draws places among the eligible questions, as it would draw
    from their sorted list; questions are numbered by ranges, and only the drawn
    ones come to the driver.
    """
    eligible = settled(ranked(pools.filter(F.size("docs") >= 3).select("question"), ["question"]))
    n, r = eligible.count(), random.Random(seed)
    if n < questions:
        raise ValueError("too few eligible questions")
    drawn = [k + 1 for k in sorted(r.sample(range(n), questions))]
    ends = F.array(F.col("docs")[0], F.col("docs")[F.floor(F.size("docs") / 2).cast("int")], F.element_at("docs", -1))
    rows = pools.join(F.broadcast(eligible.filter(F.col("place").isin(drawn))), "question").select("place", "question", "labels", ends.alias("ends")).collect()
    pairs = []
    for row in sorted(rows, key=lambda x: x.place):
        pairs += [(row.question, o, d) for o, d in zip(r.sample(row.labels, options), row.ends)]
    r.shuffle(pairs)
    kind = {c: pools.schema[c].dataType for c in ("question", "labels", "docs")}
    schema = f"pair_id string, question {kind['question'].simpleString()}, option {kind['labels'].elementType.simpleString()}, document {kind['docs'].elementType.simpleString()}"
    return pools.sparkSession.createDataFrame([(f"pair-{k:03d}", *x) for k, x in enumerate(pairs, 1)], schema)


def document_frequencies(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """token, df and idf = ln((N + 1) / (df + 1)) + 1 over distinct documents."""
    each = docs.dropDuplicates(keys).select(*keys, tokens(F.col(text)).alias("t"))
    n = each.agg(F.count(F.lit(1)).alias("n"))
    counts = each.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("token", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def pair_features(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """Overlap of candidate and evidence for each pair: pair_id, candidate, title, abstract, doc_rank.

    Adds shared terms, their share and weight, title overlap and the relations
    stated in units that hold a shared term.  Unknown terms weigh 1.
    """
    full = F.concat(F.col("title"), F.lit("\n"), F.col("abstract"))
    own = pairs.select("*", tokens(F.col("candidate")).alias("_c"), tokens(full).alias("_e"), tokens(F.col("title")).alias("_t"), units(full).alias("_u"))
    shared = own.withColumn("shared", F.array_sort(F.array_intersect("_c", "_e")))
    near = F.filter("_u", lambda u: F.arrays_overlap(tokens(u), F.col("shared")))
    told = shared.withColumns({
        "terms": F.size("_c"), "coverage": F.coalesce(F.try_divide(F.size("shared").cast("double"), F.size("_c")), F.lit(0.0)), "shared_title": F.array_sort(F.array_intersect("_c", "_t")),
        "relations": F.array_sort(F.array_distinct(F.flatten(F.transform(near, relations)))),
    }).drop("_c", "_e", "_t", "_u")
    weight = told.select("pair_id", F.explode("shared").alias("token")).join(idf, "token", "left").groupBy("pair_id").agg(F.sum(F.coalesce("idf", F.lit(1.0))).alias("overlap_weight"))
    return told.join(weight, "pair_id", "left").withColumn("overlap_weight", F.coalesce("overlap_weight", F.lit(0.0)))


def greedy(rows: list[dict], caps: dict[str, int], keys: dict[str, tuple[str, ...]], total: int) -> list[dict]:
    """Rows in order, each taken if none of its groups is full; stops at total.

    caps and keys share names: a group's limit and the fields that make its key.
    Each choice depends on all before it, so this runs in one place.
    """
    used: dict[str, Counter] = {name: Counter() for name in caps}
    out = []
    for row in rows:
        at = {name: tuple(row[f] for f in keys[name]) for name in caps}
        if all(used[n][k] < caps[n] for n, k in at.items()):
            out.append(row)
            for n, k in at.items():
                used[n][k] += 1
            if len(out) == total:
                break
    return out


def greedy_sample(rows: DataFrame, order: list[str], caps: dict[str, int], keys: dict[str, tuple[str, ...]], total: int, ahead: int = 256) -> DataFrame:
    """greedy over a frame of any size: the taken rows with position, from 1.

    Each round takes the first `ahead` rows in order behind the last one looked
    at whose groups are not full, and goes through them one by one; a full group
    stays full, so what a round leaves out would not have been taken.  A round
    takes one row at least, so there are at most `total` of them; the driver holds
    `ahead` rows and the keys of full groups, and rows are never sorted whole.
    The order columns must tell all rows apart and not be null.
    """
    fields = sorted({f for k in keys.values() for f in k} | set(order))
    narrow = settled(rows.select(*fields))
    used: dict[str, Counter] = {name: Counter() for name in caps}
    taken: list = []
    last = None
    at = F.struct(*order)
    while len(taken) < total:
        left = narrow if last is None else narrow.filter(at > F.struct(*[F.lit(last[c]).cast(narrow.schema[c].dataType).alias(c) for c in order]))
        for name, cap in caps.items():
            full = [k for k, n in used[name].items() if n >= cap]
            for key in full:
                same = F.lit(True)
                for f, v in zip(keys[name], key):
                    same = same & F.col(f).eqNullSafe(F.lit(v).cast(narrow.schema[f].dataType))
                left = left.filter(~same)
        some = left.orderBy(*order).limit(ahead).collect()
        if not some:
            break
        for row in some:
            groups = {name: tuple(row[f] for f in keys[name]) for name in caps}
            if all(used[n][k] < caps[n] for n, k in groups.items()):
                taken.append(row)
                for n, k in groups.items():
                    used[n][k] += 1
                if len(taken) == total:
                    break
        last = some[-1]
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in order)
    chosen = rows.sparkSession.createDataFrame([(k, *[row[c] for c in order]) for k, row in enumerate(taken, 1)], f"position int, {kinds}")
    return rows.join(F.broadcast(chosen), order)


#: The caps of the directional sample and its size.
CAPS = {"question": 3, "question_option": 2, "question_article": 2, "label": 10}
KEYS = {"question": ("question_id",), "question_option": ("question_id", "option"), "question_article": ("question_id", "doc_id"), "label": ("option",)}


def candidates(features: DataFrame, excluded: DataFrame, keys: list[str], order: list, most_per_question: int) -> DataFrame:
    """Features without excluded keys, at most so many for a question, in order: what greedy may see.

    greedy takes at most three of a question but may pass over some, so the
    bound leaves room for every option and article of one.
    """
    left = features.join(excluded.select(*keys).distinct(), keys, "left_anti")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return left.withColumn("_p", place).filter(F.col("_p") <= most_per_question).drop("_p")


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """rows with place, 1 to n, in an order that the seed and the keys alone decide: reruns and other partitions give the same."""
    if seed < 0:
        raise ValueError("a seed is 0 or more")
    return ranked(rows.withColumn("_luck", F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256)), ["_luck", *keys]).drop("_luck")
