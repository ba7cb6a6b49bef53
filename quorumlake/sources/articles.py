"""Article XML: nested records with abstracts, dates, authors and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "PubmedArticle"


def flat(c: Column) -> Column:
    """Text of mixed content, white space collapsed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def article_xml(spark: SparkSession, path: str) -> DataFrame:
    """file and xml of each article element.

    Files are read in splits: the end of an article is the end of a record, so a
    large file is as many tasks as it has blocks.  A file with an error element,
    one whose first element is no set of articles, and an article that does not
    end are errors when the result is used.
    """
    ends = f"</{ROW}>"
    records = spark.read.option("lineSep", ends).text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    # What stands before the article: the head of the file, or white space between two articles.
    body = F.regexp_extract("value", rf"(?s)<{ROW}(?:\s[^>]*)?>.*\z", 0)
    root = F.regexp_extract("value", r"(?s)\A(?:\s|<\?.*?\?>|<!.*?>)*<(/?[A-Za-z]+)", 1)
    before = F.substr("value", F.lit(1), F.length("value") - F.length(body))
    fault = (
        F.when(before.contains("<ERROR>"), F.concat(F.lit("the service reports an error in "), F.col("file")))
        .when(~root.isin(f"{ROW}Set", ROW, f"/{ROW}Set"), F.concat(F.lit("root is not a set of articles in "), F.col("file")))
        .when(body.contains(f"</{ROW}Set>"), F.concat(F.lit("an article does not end in "), F.col("file")))
    )
    ok = records.filter(F.assert_true(fault.isNull(), fault).isNull()).filter(body != "")
    return ok.select("file", F.concat(body, F.lit(ends)).alias("xml"))


def _people() -> Column:
    """Authors as structs of last name, fore name, initials and collective name; absent parts are null."""
    each = F.regexp_extract_all("xml", F.lit(r"(?s)<Author(?:\s[^>]*)?>.*?</Author>"), 0)
    part = lambda x, name: F.nullif(flat(F.xpath_string(x, F.lit(f"string(/Author/{name})"))), F.lit("")).alias
    names = {"last": "LastName", "fore": "ForeName", "initials": "Initials", "collective": "CollectiveName"}
    return F.transform(each, lambda x: F.struct(*[part(x, tag)(k) for k, tag in names.items()]))


def _date(path: str) -> Column:
    """struct(year, month, day, season, words) of a date element; absent parts are null."""
    part = lambda tag: F.nullif(_text(f"string({path}/{tag})"), F.lit(""))
    return F.struct(part("Year").alias("year"), part("Month").alias("month"), part("Day").alias("day"), part("Season").alias("season"), part("MedlineDate").alias("words"))


def _text(path: str) -> Column:
    return flat(F.xpath_string("xml", F.lit(path)))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each article that has an id and a title: pmid, title, abstract, journal, date, types, headings.

    The abstract is its labelled sections by line, or the first English or
    unmarked other abstract; a date in words wins over its parts, which also
    stand in `published`, as authors do in `people`.
    """
    raw = article_xml(spark, path)
    base = "MedlineCitation/Article"
    own = F.element_at(F.split("xml", "<OtherAbstract"), 1)
    main = F.regexp_extract_all(own, F.lit(r"(?s)<AbstractText(?:\s[^>]*)?(?:/>|>.*?</AbstractText>)"), 0)

    def joined(parts: Column) -> Column:
        label = lambda x: F.regexp_extract(x, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1)
        body = lambda x: flat(F.xpath_string(x, F.lit("string(/AbstractText)")))
        full = F.transform(parts, lambda x: F.when(body(x) == "", F.lit("")).when(label(x) != "", F.concat(label(x), F.lit(": "), body(x))).otherwise(body(x)))
        return F.array_join(F.filter(full, lambda x: x != ""), "\n")

    others = F.regexp_extract_all("xml", F.lit(r"(?s)<OtherAbstract(?:\s[^>]*)?>.*?</OtherAbstract>"), 0)
    language = lambda x: F.regexp_extract(x, r'^<OtherAbstract[^>]*\bLanguage="([^"]*)"', 1)
    english = F.filter(others, lambda x: F.lower(language(x)).isin("", "eng", "en"))
    other = F.coalesce(F.get(F.filter(F.transform(english, lambda x: joined(F.regexp_extract_all(x, F.lit(r"(?s)<AbstractText(?:\s[^>]*)?(?:/>|>.*?</AbstractText>)"), 0))), lambda t: t != ""), F.lit(0)), F.lit(""))
    date = f"{base}/Journal/JournalIssue/PubDate"
    parts = F.filter(F.array(*[_text(f"string(/{ROW}/{date}/{p})") for p in ("Year", "Month", "Day")]), lambda x: x != "")
    words = _text(f"string(/{ROW}/{date}/MedlineDate)")
    found = raw.select(
        "file", _text(f"string(/{ROW}/MedlineCitation/PMID)").alias("pmid"), _text(f"string(/{ROW}/{base}/ArticleTitle)").alias("title"), _text(f"string(/{ROW}/{base}/Journal/Title)").alias("journal"),
        joined(main).alias("_main"), other.alias("_other"), F.nullif(F.when(words != "", words).otherwise(F.array_join(parts, "-")), F.lit("")).alias("publication_date"),
        F.transform(F.xpath("xml", F.lit(f"/{ROW}/{base}/PublicationTypeList/PublicationType/text()")), flat).alias("publication_types"),
        F.transform(F.xpath("xml", F.lit(f"/{ROW}/MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName/text()")), flat).alias("mesh_headings"),
        F.transform(F.xpath("xml", F.lit(f"/{ROW}/{base}/AuthorList/Author/LastName/text()")), flat).alias("authors"),
        _people().alias("people"), _date(f"/{ROW}/{date}").alias("published"),
    )
    kept = found.filter("pmid <> '' AND title <> ''").withColumns({
        "abstract": F.when(F.col("_main") != "", F.col("_main")).otherwise(F.col("_other")),
        "abstract_source": F.when(F.col("_main") != "", "abstract").when(F.col("_other") != "", "other_abstract").otherwise("none"),
    })
    return kept.drop("_main", "_other")
