"""A slice of an Open Library dump: eligible works, their first edition in a wanted language, their authors' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluation import sample

WORK = "title string, subtitle string, subjects array<string>, authors array<struct<author: struct<key: string>>>"
EDITION = "works array<struct<key: string>>, languages array<struct<key: string>>, isbn_13 array<string>, publishers array<string>, number_of_pages int"


def eligible_works(dump: DataFrame, least_description: int = 80, least_subjects: int = 2) -> DataFrame:
    """dump (key, json) -> work_key, title, subtitle, description (4,000 characters at most), subjects (12 at most), author_keys of
    the works with a title, enough description and enough subjects. Texts may be strings or objects with a value."""
    j = F.from_json("json", WORK)
    rows = dump.select(F.col("key").alias("work_key"), "json", j.alias("j"))
    text = lambda f: T.strip(F.coalesce(T.text_value(F.col("json"), f), F.lit("")))
    subjects = F.filter(F.transform(T.or_empty(F.col("j.subjects")), lambda s: T.strip(s)), lambda s: s != "")
    authors = F.transform(F.filter(F.coalesce("j.authors", F.array().cast("array<struct<author:struct<key:string>>>")), lambda a: a["author"].isNotNull()), lambda a: a["author"]["key"])
    out = rows.select("work_key", text("title").alias("title"), text("subtitle").alias("subtitle"), text("description").alias("description"), subjects.alias("subjects"), authors.alias("author_keys"))
    out = out.where((F.length("description") >= least_description) & (F.size("subjects") >= least_subjects) & (F.col("title") != ""))
    return out.withColumns({"description": F.left("description", F.lit(4000)), "subjects": F.slice("subjects", 1, 12)})


def first_editions(dump: DataFrame, works: DataFrame, languages: list[str]) -> DataFrame:
    """dump (key, json) -> the first edition by key of each work that has an accepted language and an ISBN-13: work_key, edition_key,
    isbn13, language, publisher, year, pages, edition_title."""
    rows = dump.select(F.col("key").alias("edition_key"), "json", F.from_json("json", EDITION).alias("j"))
    text = lambda f: T.strip(F.coalesce(T.text_value(F.col("json"), f), F.lit("")))
    isbns = T.isbn13s(T.or_empty(F.col("j.isbn_13")))
    keys = F.transform(F.coalesce("j.languages", F.array().cast("array<struct<key:string>>")), lambda x: x["key"])
    rows = rows.select(
        F.get("j.works", F.lit(0))["key"].alias("work_key"),
        "edition_key",
        F.get(isbns, F.lit(0)).alias("isbn13"),
        T.first_accepted(keys, languages).alias("language"),
        F.coalesce(F.get("j.publishers", F.lit(0)), F.lit("")).alias("publisher"),
        T.edition_year(text("publish_date")).alias("year"),
        F.col("j.number_of_pages").alias("pages"),
        text("title").alias("edition_title"),
    )
    rows = rows.where(F.col("language").isNotNull() & F.col("isbn13").isNotNull()).join(works.select("work_key"), "work_key", "left_semi")
    first = Window.partitionBy("work_key").orderBy("edition_key")
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def slice_of(works_dump: DataFrame, editions_dump: DataFrame, authors_dump: DataFrame, languages: list[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """The records of a slice: work and edition fields, and the authors' names in their order, unknown ones left out. n: a seeded
    sample of the eligible works."""
    works = eligible_works(works_dump)
    works = works if n is None else sample(works, n, seed, "work_key")
    both = works.join(first_editions(editions_dump, works, languages), "work_key")
    names = authors_dump.select(F.col("key").alias("author_key"), T.strip(F.coalesce(T.text_value(F.col("json"), "name"), F.lit(""))).alias("name")).where("name <> ''")
    wanted = both.select("work_key", F.posexplode("author_keys").alias("place", "author_key")).join(names, "author_key")
    listed = wanted.groupBy("work_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("authors"))
    return both.join(listed, "work_key", "left").withColumn("authors", T.or_empty(F.col("authors"))).drop("author_keys")
