"""True spellings from a vocabulary table, and the e-mail domain a table mostly uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.emails import email_domain, restore_domain
from burnish.functions.text import lower_strip, strip
from burnish.operators.ordering import Plain
from burnish.session import settle


def canonicalize(df: DataFrame, column: str, vocabulary: DataFrame, spelling: str) -> DataFrame:
    """Replace ``column`` by the spelling in ``vocabulary`` that equals it up to case and padding.

    Unknown values stay, stripped. Two spellings of one word would multiply
    rows, so the first in text order is taken. The words are settled first: both
    sides of the join are plain shuffles, and Spark splits the rows of a hot word.
    """
    plain, words = Plain.of(df), Plain.of(vocabulary)
    cell, listed = plain.name(column), F.col(words.name(spelling))
    known = (
        words.table.select(lower_strip(listed).alias("word"), strip(listed).alias("spelling"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.min("spelling").alias("spelling"))
    )
    found = plain.table.join(settle(known, "words"), lower_strip(cell) == F.col("word"), "left")
    fixed = F.coalesce("spelling", strip(cell))
    return plain.back(found.select(*((fixed if c == cell else F.col(c)).alias(c) for c in plain.table.columns)))


def _shortened(word: Column) -> Column:
    """All texts that are the word without one of its characters."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))


def _neighbours(word: Column, distance: int) -> Column:
    """The word, and what is left of it without up to ``distance`` of its characters."""
    every = last = F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _shortened)))
        every = F.array_union(every, last)
    return every


def canonicalize_typos(
    df: DataFrame, column: str, vocabulary: DataFrame, spelling: str, distance: int = 1, shortest: int = 4
) -> DataFrame:
    """As ``canonicalize``, and misspelt words become the one word within ``distance`` edits.

    An edit puts a character in, takes one out or replaces one. A value with two nearest words is left alone, as are
    values and words of fewer than ``shortest`` characters. Two words within the distance have a text in common that
    both become by leaving out characters; distinct unknown values and words are joined by these texts, then their
    distance is checked, so the cost goes with distinct values, not with rows or with values times words.
    """
    if distance < 1:
        raise ValueError("a distance of no edits is canonicalize")
    plain, words = Plain.of(df), Plain.of(vocabulary)
    cell, listed = plain.name(column), F.col(words.name(spelling))
    known = words.table.select(lower_strip(listed).alias("word"), strip(listed).alias("spelling")).where("word <> ''")
    known = settle(known.groupBy("word").agg(F.min("spelling").alias("spelling")), "words")
    values = plain.table.select(lower_strip(cell).alias("value")).where("value <> ''").distinct()
    strange = values.join(known, values["value"] == known["word"], "left_anti")

    def spread(words: DataFrame, word: str) -> DataFrame:
        long = words.where(F.length(word) >= shortest)
        return long.select(word, F.explode(_neighbours(F.col(word), distance)).alias(f"{word}_part"))

    met = spread(strange, "value").join(spread(known, "word"), F.col("value_part") == F.col("word_part"))
    edits = F.levenshtein("value", "word", distance)
    met = met.select("value", "word").distinct().withColumn("edits", edits).where("edits > 0")
    nearest = met.groupBy("value", "edits").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word"))
    nearest = nearest.groupBy("value").agg(F.min_by(F.struct("n", "word"), "edits").alias("best")).where("best.n = 1")
    mended = nearest.select("value", F.col("best.word").alias("of")).join(known, F.col("of") == F.col("word"))
    fixes = known.select(F.col("word").alias("value"), "spelling").unionByName(mended.select("value", "spelling"))
    found = plain.table.join(settle(fixes, "fixes"), lower_strip(cell) == F.col("value"), "left")
    fixed = F.coalesce("spelling", strip(cell))
    return plain.back(found.select(*((fixed if c == cell else F.col(c)).alias(c) for c in plain.table.columns)))


def most_common_domain(df: DataFrame, column: str) -> DataFrame:
    """One row: the domain most valid addresses have; ties go to the first in text order."""
    plain = Plain.of(df)
    counts = plain.table.groupBy(email_domain(plain.name(column)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("domain").isNotNull(), F.struct(-F.col("n"), F.col("domain")))
    return counts.agg(F.min_by("domain", rank).alias("domain"))


def repair_domains(df: DataFrame, column: str) -> DataFrame:
    """Give addresses with a broken domain the most common one of the column."""
    modal, plain = most_common_domain(df, column).scalar(), Plain.of(df)
    cell = plain.name(column)
    fixed = F.coalesce(restore_domain(cell, modal), lower_strip(cell)).alias(cell)
    return plain.back(plain.table.select(*[fixed if c == cell else F.col(c) for c in plain.table.columns]))
