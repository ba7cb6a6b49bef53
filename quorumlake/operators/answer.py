"""Answer selection with abstention, and metrics over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.columns import TIE, bound, ratio


def eligibility(score, decision):
    """Why an option may or may not be an answer."""
    return (
        F.when(score.isNull(), "ZERO_DENOMINATOR").when(decision == "ABSTAIN", "NATIVE_CLAIM_ABSTENTION")
        .when(F.isnan(score) | (score <= 0) | (decision != "SUPPORT"), "NONPOSITIVE_SCORE").otherwise("POSITIVE_SUPPORT")
    )


def select_answers(questions: DataFrame, options: DataFrame, keys: list[str] = ["method"], incomplete: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """One row for each question and key: ANSWERED only with a unique highest eligible option.

    options: question_id, idx, score, decision and keys.  Questions without
    options keep a row for each key: EMPTY_EVIDENCE_POOL.  incomplete lists
    question_ids whose samples are not complete: INCOMPLETE, whatever the scores.
    cases lists the keys' values; without it they are read from options, which
    computes options twice.
    """
    listed = options.groupBy("question_id", *keys).agg(F.collect_list(F.struct("idx", "score", "decision")).alias("_options"))
    grid = questions.select("question_id").crossJoin(F.broadcast(cases if cases is not None else options.select(*keys).distinct()))
    every = grid.join(listed, ["question_id", *keys], "left")
    if incomplete is not None:
        every = every.join(incomplete.select("question_id", F.lit(True).alias("_open")).distinct(), "question_id", "left")
    open_ = F.coalesce("_open", F.lit(False)) if incomplete is not None else F.lit(False)
    return every.withColumn("_a", chosen(F.col("_options"), open_)).select("question_id", *keys, "_a.*")


def chosen(options: Column, open_: Column | None = None) -> Column:
    """struct(state, reason, answer, ranking) of the options of one question, an array of idx, score and decision in any order; null where there are none."""
    ok = lambda x: eligibility(x["score"], x["decision"]) == "POSITIVE_SUPPORT"
    ranked = F.array_sort(F.transform(F.filter(options, lambda x: x["score"].isNotNull()), lambda x: F.struct((-x["score"]).alias("s"), F.char(F.lit(65) + x["idx"]).alias("option"))))
    good = F.array_sort(F.transform(F.filter(options, ok), lambda x: F.struct((-x["score"]).alias("s"), x["idx"].alias("idx"))))
    open_ = F.lit(False) if open_ is None else open_

    def told(g: Column) -> Column:
        near = F.size(F.filter(g["good"], lambda x: -x["s"] >= -F.get(g["good"], F.lit(0))["s"] - TIE))
        some, one = F.size(g["good"]) > 0, near == 1
        state = F.when(open_, "INCOMPLETE").when(some & one, "ANSWERED").otherwise("ABSTAIN")
        reason = (
            F.when(open_, "INCOMPLETE_SAMPLES").when(g["ranked"].isNull(), "EMPTY_EVIDENCE_POOL").when(~some, "NO_POSITIVE_ELIGIBLE_SCORE")
            .when(~one, "TIED_HIGHEST_POSITIVE_SCORES").otherwise("UNIQUE_HIGHEST_POSITIVE_SCORE")
        )
        answer = F.when(~open_ & some & one, F.get(g["good"], F.lit(0))["idx"])
        return F.struct(state.alias("state"), reason.alias("reason"), answer.cast("int").alias("answer"), F.concat_ws("", F.transform(F.coalesce(g["ranked"], F.array()), lambda x: x["option"])).alias("ranking"))

    return bound(F.struct(good.alias("good"), ranked.alias("ranked")), told)


def long_answers(wide: DataFrame, kept: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each question and method, of rows with `answers`, an array of struct(method, state, reason, answer, ranking)."""
    return wide.select("question_id", *kept, F.explode("answers").alias("_a")).select("question_id", "_a.*", *kept)


def _correct(a: Column | None = None) -> Column:
    at = F.col if a is None else a.__getitem__
    return F.when(at("state") == "ANSWERED", at("answer") == F.col("gold"))


def with_gold(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold joins after the answers are made; correct is null unless ANSWERED."""
    return answers.join(gold.select("question_id", "gold"), "question_id").withColumn("correct", _correct())


def judged(wide: DataFrame, gold: DataFrame) -> DataFrame:
    """with_gold of long_answers, joined while a question is still one row."""
    return long_answers(wide.join(gold.select("question_id", "gold"), "question_id"), ["gold"]).withColumn("correct", _correct())


def answer_metrics(judged: DataFrame, keys: list[str] = ["method"]) -> DataFrame:  # noqa: B006
    """Counts and rates by method; what has no answers has no answered accuracy and no selective risk."""
    answered, right = F.count_if(F.col("state") == "ANSWERED"), F.count_if("correct")
    n = F.count(F.lit(1))
    return judged.groupBy(*keys).agg(
        n.alias("questions"), answered.alias("answered"), right.alias("right"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if(F.col("state") == "ABSTAIN").alias("abstained"),
        F.round(ratio(right, n), 9).alias("accuracy"), F.round(ratio(answered, n), 9).alias("coverage"),
        F.round(ratio(right, answered), 9).alias("answered_accuracy"), F.round(1 - ratio(right, answered), 9).alias("selective_risk"),
    )


def transitions(judged: DataFrame, left: str, right: str, key: str = "method") -> DataFrame:
    """How each question's answer changes from one method to another."""
    side = lambda m, s: judged.filter(F.col(key) == m).select("question_id", F.col("state").alias(f"state_{s}"), F.col("answer").alias(f"answer_{s}"), F.col("correct").alias(f"correct_{s}"))
    return _moved(side(left, "l").join(side(right, "r"), "question_id"))


def transitions_in_row(wide: DataFrame, gold: DataFrame, left: str, right: str) -> DataFrame:
    """transitions of rows that have all methods' answers: gold is joined to them, no answer to another."""
    rows = wide.join(gold.select("question_id", "gold"), "question_id")
    for m, s in ((left, "l"), (right, "r")):
        rows = rows.withColumn("_a", F.get(F.filter("answers", lambda a: a["method"] == m), F.lit(0)))  # noqa: B023
        rows = rows.withColumns({f"state_{s}": F.col("_a.state"), f"answer_{s}": F.col("_a.answer"), f"correct_{s}": _correct(F.col("_a"))})
    return _moved(rows.drop("answers", "gold", "_a"))


def _moved(both: DataFrame) -> DataFrame:
    l, r = F.col("state_l") == "ANSWERED", F.col("state_r") == "ANSWERED"  # noqa: E741
    kind = F.when(~l & ~r, "both_abstain").when(~l, "abstain_to_answer").when(~r, "answer_to_abstain").when(F.col("answer_l") == F.col("answer_r"), "same_answer").otherwise("answer_change")
    return both.withColumn("transition", kind)
