"""Text rules: concepts and queries, evidence types, tokens, relations, sentences and identities."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.functions.columns import bound

#: Publication types by study design, strongest first; exact labels only.
DESIGNS = [
    ("meta_analysis", ["meta-analysis", "network meta-analysis"]),
    ("systematic_review", ["systematic review"]),
    ("evidence_based_guideline", ["practice guideline", "guideline", "evidence-based guideline"]),
    ("randomized_controlled_trial", ["randomized controlled trial"]),
    ("non_randomized_controlled_trial", ["non-randomized controlled trial", "nonrandomized controlled trial", "non-randomised controlled trial", "nonrandomised controlled trial"]),
    ("cohort_study", ["cohort study", "cohort studies", "prospective cohort study", "prospective cohort studies", "retrospective cohort study", "retrospective cohort studies"]),
    ("case_series_or_study", ["case series", "case study", "case studies"]),
    ("individual_case_report", ["individual case report", "single case report"]),
    ("expert_opinion", ["editorial", "expert opinion"]),
]
#: Words that say nothing about a claim.
STOPWORDS = """
a an the of to in on at by for from with without into and or but as is are was were
be been being do does did can could may might will would should must have has had
it its this that these those their them they he she his her we our you your which
what when where how who why than then there here only most more less many some any
all each other another same such also both either neither one two three four five
first second third following about between after before during through within
patient patients man men woman women child children year years old age aged
clinical medical physician doctor diagnosis diagnosed disease diseases syndrome
condition conditions symptom symptoms treatment therapy management study studies
result results finding findings evidence group groups report reported reports
case cases level levels normal abnormal high low increased decreased primary
secondary specific general significant significantly effect effects compared
comparison associated association mechanism mechanisms due caused causes cause
increase increases decrease decreases prevent prevents prevention not no effective
ineffective contraindicated versus using used use include includes including
usually commonly several can likely best appropriate indicated recommended
""".split()
#: Relations and their patterns, in any case.
RELATIONS = {
    "not": r"\bnot\b",
    "ineffective": r"\bineffective\b",
    "contraindicated": r"\bcontraindicated\b",
    "associated with": r"\bassociated\s+with\b",
    "increases": r"\bincreas(?:e|es|ed|ing)\b",
    "decreases": r"\bdecreas(?:e|es|ed|ing)\b",
    "prevents": r"\bprevent(?:s|ed|ing)?\b",
    "causes": r"\bcaus(?:e|es|ed|ing)\b",
    "treatment of": r"\btreatment\s+of\b",
    "management of": r"\bmanagement\s+of\b",
    "mechanism": r"\bmechanisms?\b",
}
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "dr. mr. mrs. ms. prof. vs. fig. figs. ref. refs. no. nos. al. e.g. i.e. etc. p.o. i.v. approx.".split()


def spaced(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def evidence_type(labels: Column) -> Column:
    """The strongest design that a label names exactly, but for case and white space; else other.  Null and empty arrays are other."""
    normal = F.transform(labels, lambda x: F.lower(spaced(x)))
    found = F.lit("other")
    for name, aliases in reversed(DESIGNS):
        found = F.when(F.arrays_overlap(normal, F.array(*map(F.lit, aliases))), name).otherwise(found)
    return found


def tokens(text: Column) -> Column:
    """Distinct informative tokens: runs of a-z of three or more letters, no stopwords, plurals cut."""
    stop = F.array(*map(F.lit, STOPWORDS))
    raw = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    kept = F.filter(raw, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))

    def stem(w: Column) -> Column:
        plural = w.endswith("s") & ~w.endswith("ss") & ~w.endswith("is") & ~w.endswith("us")
        return F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((F.length(w) > 4) & plural, F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.array_sort(F.array_except(F.array_distinct(F.transform(kept, stem)), stop))


def relations(text: Column) -> Column:
    """Names of the relations a text states, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), n) for n, p in RELATIONS.items()])))


def units(text: Column) -> Column:
    """Context units: cut after a sentence mark and white space, and at line ends."""
    return F.split(text, r"(?<=[.!?])\s+|[\r\n]+")


#: What a single full stop may belong to: an abbreviation, dotted letters or a capital initial, after opening marks.  A look-behind has to be bounded: eight opening marks and twenty dotted letters.
GUARDED = r"(?:^|\s)[(\[\"'“‘]{0,8}(?:(?i:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")|(?:[A-Za-z]\.){2,20}|[A-Z]\.)"


def sentences(text: Column) -> Column:
    """Sentences of a text.

    A mark followed by white space ends one, but for a single full stop after an
    abbreviation, a capital initial or dotted letters.  A tail without a mark is
    a sentence; null and blank texts have none.
    """
    mark = "\u0001"
    # A single full stop that ends a sentence stands behind nothing that guards it; several marks, or others, always end one.
    single = rf"(?<![.!?])\.(?<!{GUARDED})[\"'”’)\]]*(?=\s|\z)"
    other = r"(?:[.!?]*[!?][.!?]*|(?<![.!?])\.[.!?]+)[\"'”’)\]]*(?=\s|\z)"
    cut = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), mark, " "), f"(?U)({single}|{other})", f"$1{mark}")
    return F.filter(F.transform(F.split(cut, mark), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no NaN: the text whose digest identifies a record."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def identity(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def error_class(c: Column) -> Column:
    """Letters, digits and underscores, 80 at most."""
    return F.substr(F.regexp_replace(c, "[^A-Za-z0-9_]", ""), F.lit(1), F.lit(80))


def digest_of(c: Column) -> Column:
    """64 lower-case hexadecimal digits without their prefix; null if it is none."""
    bare = F.lower(F.regexp_replace(F.trim(c), "^sha256:", ""))
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def hypothesis(stem: Column, option: Column) -> Column:
    return F.concat(F.trim(stem), F.lit(" "), F.trim(option))


def premise(title: Column, abstract: Column) -> Column:
    return F.when(F.trim(abstract) == "", F.trim(title)).otherwise(F.concat(F.trim(title), F.lit("\n"), F.trim(abstract)))


def query_terms(terms: Column) -> Column:
    """A boolean search of all terms that leaves out books and what has no abstract; null without terms."""
    joined = lambda ts: F.concat_ws(" AND ", F.transform(ts, lambda t: F.concat(F.lit("("), t, F.lit(")"))))
    return bound(terms, lambda ts: F.when(F.size(ts) > 0, F.concat(F.lit("(("), joined(ts), F.lit(') NOT "pubmed books"[sb]) AND hasabstract'))))
