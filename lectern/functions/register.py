"""Functions and a table function for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="sent_id int, sentence string")
class Sentences:
    """sentences(text): the sentences of a text, one a row."""

    def eval(self, text: str):
        import regex

        from lectern.operators.segment import BREAK, marks

        held = text or ""
        for pattern, replacement in marks():
            held = regex.sub(pattern.replace(r"\z", r"\Z"), regex.sub(r"\$(\d)", r"\\g<\1>", replacement), held)
        pieces = (p.strip(" \t\n\r") for p in held.split(BREAK))
        yield from enumerate(p for p in pieces if p)


def register(spark: SparkSession) -> None:
    """Registers sentences(text), and word_count(text) and takes_an(word) as SQL functions without Python."""
    spark.udtf.register("sentences", Sentences)
    from lectern.functions.text import takes_an_sql

    spark.sql(f"create or replace temporary function takes_an(word string) returns boolean return {takes_an_sql('word')}")
    spark.sql(r"create or replace temporary function word_count(t string) returns int return size(regexp_extract_all(t, '[\\p{L}\\p{N}]+(?:[\'’][\\p{L}\\p{N}]+)*(?:-[\\p{L}\\p{N}]+)*', 0))")
