"""Checks on the block relation: headings, paragraphs and lists. Findings are blocks: (doc_id, block_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import chunk_count


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("block_id")


def headings(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'heading'").select("doc_id", "block_id", "level", "text")


def heading_increment(blocks: DataFrame) -> DataFrame:
    """Headings more than one level below the one before; adds from_level."""
    return headings(blocks).withColumn("from_level", F.lag("level").over(_by_doc())).where("level > from_level + 1")


def single_h1(blocks: DataFrame) -> DataFrame:
    """Every H1 after the first; adds the count of all."""
    of_doc = Window.partitionBy("doc_id")
    h1 = headings(blocks).where("level = 1").withColumns({"n": F.row_number().over(_by_doc()), "total": F.count(F.lit(1)).over(of_doc)})
    return h1.where("n > 1").select("doc_id", "block_id", "level", "text", "total")


def _with_next(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"next_kind": F.lead("kind").over(_by_doc()), "next_level": F.lead("level").over(_by_doc()), "next_text": F.lead("text").over(_by_doc())}).where("kind = 'heading'")


def empty_section(blocks: DataFrame) -> DataFrame:
    """Headings followed at once by one of the same or a higher rank, or by nothing. Code counts as content."""
    return _with_next(blocks).where("next_kind is null or (next_kind = 'heading' and next_level <= level)").select("doc_id", "block_id", "level", "text")


def stacked_headings(blocks: DataFrame) -> DataFrame:
    """Headings followed at once by a deeper one; adds its text."""
    return _with_next(blocks).where("next_kind = 'heading' and next_level > level").select("doc_id", "block_id", "level", "text", "next_text")


def lone_subsection(blocks: DataFrame) -> DataFrame:
    """Headings that are the only ones of their level under their parent, the last heading before of a smaller level.

    Parents come from one running array of the last heading of each level, so that no join is needed.
    """
    h = headings(blocks)
    over = _by_doc().rowsBetween(Window.unboundedPreceding, -1)
    last = {f"last{k}": F.last(F.when(F.col("level") <= k, F.col("block_id")), ignorenulls=True).over(over) for k in range(1, 6)}
    parent = F.lit(None).cast("int")
    for k in range(1, 6):
        parent = F.when(F.col("level") == k + 1, F.col(f"last{k}")).otherwise(parent)
    placed = h.withColumns(last).withColumn("parent", parent).join(h.select("doc_id", F.col("block_id").alias("parent"), F.col("level").alias("parent_level")), ["doc_id", "parent"])
    group = Window.partitionBy("doc_id", "parent")
    return placed.where("level = parent_level + 1").withColumn("n", F.count(F.lit(1)).over(group)).where("n = 1").select("doc_id", "block_id", "level", "text")


def depth(blocks: DataFrame, most: int = 4) -> DataFrame:
    return headings(blocks).where(F.col("level") > most)


def wall_of_text(blocks: DataFrame, words: int = 450, paragraphs: int = 5) -> DataFrame:
    """Unbroken runs of paragraphs and quotes over a number of words or of blocks: islands between other kinds."""
    prose = F.col("kind").isin("paragraph", "quote")
    runs = blocks.withColumn("island", F.sum((~prose).cast("int")).over(_by_doc())).where(prose)
    total = runs.groupBy("doc_id", "island").agg(F.min("block_id").alias("block_id"), F.count(F.lit(1)).alias("n_blocks"), F.sum(chunk_count(F.col("text"))).alias("n_words"))
    return total.where((F.col("n_words") > words) | (F.col("n_blocks") > paragraphs)).drop("island")


def one_line_paragraphs(blocks: DataFrame, sentences: DataFrame, words: int = 8, least: int = 3, share: float = 0.4) -> DataFrame:
    """Paragraphs of one short sentence, in documents where they are many."""
    of = sentences.where("kind = 'paragraph'").groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_words").alias("n_words"))
    short = of.withColumn("short", (F.col("n_sentences") == 1) & (F.col("n_words") <= words))
    doc = Window.partitionBy("doc_id")
    counted = short.withColumns({"n_short": F.sum(F.col("short").cast("int")).over(doc), "n_all": F.count(F.lit(1)).over(doc)})
    return counted.where(F.col("short") & (F.col("n_short") >= least) & (F.col("n_short") >= share * F.col("n_all"))).select("doc_id", "block_id", "n_words", "n_short", "n_all")


def bold_lead_ins(blocks: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """The first item of lists whose items mostly open with a bold label."""
    items = blocks.where("kind = 'list-item'").withColumn("bold", F.col("text").rlike(r"^(\*\*|__)[^*_]+(\*\*|__)"))
    per = items.groupBy("doc_id", "list_id").agg(F.min("block_id").alias("block_id"), F.sum(F.col("bold").cast("int")).alias("n_bold"), F.count(F.lit(1)).alias("n_items"))
    return per.where((F.col("n_bold") >= least) & (F.col("n_bold") >= share * F.col("n_items"))).drop("list_id")


def paragraph_length(blocks: DataFrame, sentences: DataFrame, words: int = 150, most_sentences: int | None = None) -> DataFrame:
    """Paragraphs over a number of words or of sentences."""
    per = sentences.where("kind = 'paragraph'").groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    sized = blocks.where("kind = 'paragraph'").select("doc_id", "block_id", chunk_count(F.col("text")).alias("n_words")).join(per, ["doc_id", "block_id"])
    over = F.col("n_words") > words
    return sized.where(over if most_sentences is None else over | (F.col("n_sentences") > most_sentences))


def vague_lead(blocks: DataFrame, pattern: str) -> DataFrame:
    """First paragraphs, of the text and of each H1 or H2 section, that match a scene-setting pattern and have no concrete sign: a digit,
    a quotation mark or a name inside a sentence."""
    from lectern.operators.kinds import lead_blocks

    leads = blocks.join(lead_blocks(blocks), ["doc_id", "block_id"], "left_semi")
    return leads.where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"[0-9“\"]|[\p{Ll},] \p{Lu}")).select("doc_id", "block_id", "text")


def unnumbered_steps(blocks: DataFrame, verbs: list[str], sequence: str = r"\b(first|then|next|after|finally)\b") -> DataFrame:
    """Bulleted lists of three or more items that all open with one of the verbs, with a sequence word in an item or in the block before."""
    before = blocks.withColumn("before_text", F.lag("text").over(_by_doc()))
    items = before.where("kind = 'list-item' and not ordered").withColumn("verb", F.lower(F.regexp_extract("text", r"^(\p{L}+)", 1)).isin(verbs))
    per = items.groupBy("doc_id", "list_id").agg(F.min("block_id").alias("block_id"), F.count(F.lit(1)).alias("n_items"), F.min(F.col("verb").cast("int")).alias("all_verbs"), F.max(F.lower("text").rlike(sequence).cast("int")).alias("inside"), F.min_by(F.lower("before_text"), "block_id").alias("intro"))
    return per.where((F.col("n_items") >= 3) & (F.col("all_verbs") == 1) & ((F.col("inside") == 1) | F.coalesce(F.col("intro").rlike(sequence), F.lit(False)))).select("doc_id", "block_id", "n_items")


def conclusion_at_end(blocks: DataFrame, pattern: str = r"(?i)^(conclusions?|summary|wrapping up|final thoughts)$") -> DataFrame:
    """The last of two or more H2 headings where it announces a conclusion."""
    per = headings(blocks).where("level = 2").groupBy("doc_id").agg(F.max("block_id").alias("block_id"), F.max_by("text", "block_id").alias("text"), F.count(F.lit(1)).alias("n"))
    return per.where((F.col("n") >= 2) & F.col("text").rlike(pattern)).drop("n")


def form_of(text):
    """A shallow form of a heading or list item: labelled, question, infinitive, gerund, imperative or noun phrase."""
    from lectern.operators.shallow import VERBS

    first = F.lower(F.regexp_extract(text, r"^(\p{L}+)", 1))
    return (
        F.when(text.rlike(r":$|^(\*\*)?[^:.]{1,30}:"), "labelled")
        .when(text.rlike(r"\?$"), "question")
        .when(first == "to", "infinitive")
        .when(first.rlike(r"^\p{L}{2,}ing$"), "gerund")
        .when(first.isin(VERBS), "imperative")
        .otherwise("noun-phrase")
    )


def parallel(blocks: DataFrame, of: str, least: int = 3, majority: float = 0.75) -> DataFrame:
    """Sibling headings (of = headings) or items of a list (of = list-items) that don't have the group's majority form."""
    if of == "headings":
        each = headings(blocks).withColumn("section", F.sum((F.col("level") == 1).cast("int")).over(_by_doc())).withColumn("grp", F.concat_ws("/", "section", "level"))
    else:
        each = blocks.where("kind = 'list-item'").withColumn("grp", F.col("list_id").cast("string"))
    each = each.withColumn("form", form_of(F.col("text")))
    group = Window.partitionBy("doc_id", "grp")
    counted = each.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "grp", "form"))).withColumns({"total": F.count(F.lit(1)).over(group), "most": F.max(F.struct("same", "form")).over(group)})
    return counted.where((F.col("total") >= least) & (F.col("form") != F.col("most.form")) & (F.col("most.same") >= majority * F.col("total"))).select("doc_id", "block_id", "text", "form", F.col("most.form").alias("wanted"))
