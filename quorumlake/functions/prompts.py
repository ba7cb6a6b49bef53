"""Prompts: instructions, then the texts as one canonical JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names under which the four texts of a judgement stand in its prompt, in canonical (sorted) order.
TEXTS = ("candidate_option_text", "evidence_abstract", "evidence_title", "question_stem")
DISTRIBUTION = "Judge whether the evidence supports, contradicts or does not bear on the option as an answer to the question. Answer with one JSON object of the three probabilities."
CODE = "Judge whether the evidence supports (1), contradicts (2) or does not bear on (3) the option as an answer to the question. Answer with the number alone."
SEARCHES = {
    "primary": "Write one search query for articles that answer the question. Answer with the query alone.",
    "core": "The query found too few articles. Write one with the core concepts only. Answer with the query alone.",
    "minimal": "The queries found too few articles. Write one with the single most specific concept. Answer with the query alone.",
}


def canonical(**texts: Column) -> Column:
    """A JSON object with sorted keys, without spaces; null texts stay as null."""
    return F.to_json(F.struct(*[texts[k].alias(k) for k in sorted(texts)]), {"ignoreNullFields": "false"})


def stance_prompt(question: Column, option: Column, title: Column, abstract: Column, instructions: str = DISTRIBUTION) -> Column:
    """The prompt for a distribution over the stances (or, with other instructions, for a class code)."""
    four = canonical(question_stem=question, candidate_option_text=option, evidence_title=title, evidence_abstract=abstract)
    return F.concat(F.lit(instructions + "\n"), four)


def search_prompt(stage: str, question_id: Column, stem: Column, earlier: Column | None = None, instructions: dict[str, str] = SEARCHES) -> Column:
    """The prompt of a stage of query reformulation; later stages also show the queries tried before (an array)."""
    texts = {"question_id": question_id, "question_stem": stem} | ({"earlier_queries": earlier} if earlier is not None else {})
    return F.concat(F.lit(instructions[stage] + "\n"), canonical(**texts))


def evidence_sentences(title: Column, sentences: Column) -> Column:
    """array of (sentence_index, source, abstract_index, text): the title is 0, the abstract's sentences follow."""
    head = F.struct(F.lit(0).alias("sentence_index"), F.lit("title").alias("source"), F.lit(None).cast("int").alias("abstract_index"), F.trim(title).alias("text"))
    rest = F.transform(sentences, lambda s, i: F.struct((i + 1).alias("sentence_index"), F.lit("abstract").alias("source"), i.alias("abstract_index"), s.alias("text")))
    return F.concat(F.array(head), rest)


def untruncated_length(tokens: Column, limit: Column) -> Column:
    """struct(tokens, truncated, lost): the whole length of a text in tokens against a model's limit; no limit truncates nothing."""
    lost = F.greatest(F.coalesce(tokens - limit, F.lit(0)), F.lit(0))
    return F.struct(tokens.alias("tokens"), (lost > 0).alias("truncated"), lost.alias("lost"))
