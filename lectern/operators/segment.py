"""Sentences and tokens of blocks, as relations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WORD, match_all, running, word_count

# Abbreviations that stand before a name or a number and never end a sentence.
TITLES = [
    "Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Rev", "Hon", "Gov", "Pres", "Sen", "Rep", "Gen", "Col", "Lt", "Sgt", "Capt", "Maj", "St", "Mt",
    "No", "Nos", "Fig", "Figs", "Vol", "Vols", "pp", "Ch", "Eq", "cf", "vs", "ca", "approx", "Dept", "Est",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
]
# Other abbreviations, which end a sentence only before a word that opens one.
ABBREVIATIONS = ["etc", "al", "Co", "Corp", "Inc", "Ltd", "Jr", "Sr", "Bros", "Univ", "Ave", "Blvd", r"e\.g", r"i\.e", "viz", "resp", "incl", "min", "max", "hrs", "mins", "secs", r"Ph\.D", r"B\.Sc", r"M\.Sc", r"B\.A", r"M\.A"]
# Words that often open a sentence.
OPENERS = [
    "I", "You", "He", "She", "It", "We", "They", "The", "A", "An", "This", "That", "These", "Those", "There", "Here", "How", "What", "Why", "When", "Where", "Who",
    "Which", "But", "And", "So", "Then", "If", "In", "On", "At", "After", "Before", "However", "Please", "My", "Our", "His", "Her", "Their", "Its", "Your", "Did", "Do", "Does",
]
BREAK, HOLD, UNSURE, REAL = "\x01", "\x02", "\x03", "\x04"  # a break; a dot that ends no sentence, may end one, does end one
_OPEN = r"[\"“‘'(\[]*"
_BEFORE = r"(^|[^\p{L}\p{N}.])"


def marks() -> list[tuple[str, str]]:
    """(pattern, replacement) in order: dots that end no sentence become HOLD, then breaks are marked. No pattern looks around."""
    return [
        # Titles, months and initials; `I` is no initial after a word that begins in lower case.
        (rf"{_BEFORE}({_any_case(TITLES)}|[A-HJ-Z])\.", f"$1$2{HOLD}"),
        (r"(^|(?:^|[ \t\n])[^\p{Ll} \t\n][^ \t\n]*[ \t\n]+)I\.", f"$1I{HOLD}"),
        # Other abbreviations, unless an opener follows.
        (rf"{_BEFORE}({_any_case(ABBREVIATIONS)})\.", f"$1$2{UNSURE}"),
        (rf"{UNSURE}([ \t\n\r]+{_OPEN}(?:{'|'.join(OPENERS)})(?:[^\p{{L}}\p{{N}}]|\z))", ".$1"),
        # Three dots; spaced ones unless there are four before a capital.
        (r"(^|[^.])\.\.\.([^.]|\z)", f"$1..{HOLD}$2"),
        (r"(\.[ \t]+\.[ \t]+\.[ \t]+)\.([ \t\n]+[\p{Lu}])", f"$1{REAL}$2"),
        (r"([ \t])\.([ \t]+[^ \t])", f"$1{HOLD}$2"),
        # The number of a list item at the beginning of a line.
        (r"((?:^|\n)[ \t]*(?:[0-9]{1,3}|[a-z]))\.([ \t])", f"$1{HOLD}$2"),
        (REAL, "."),
        (rf"([.!?…][\"”’')\]]*)([ \t\n\r]+)({_OPEN}[\p{{Lu}}0-9])", f"$1{BREAK}$2$3"),
        (f"[{HOLD}{UNSURE}]", "."),
    ]


def broken(text: Column) -> Column:
    """The text with a mark before the blanks of each sentence break.

    A break follows `.`, `!`, `?` or an ellipsis, with closing marks, before a capital or a digit; not after titles, initials,
    ellipses of three dots, numbers of list items, nor after other abbreviations unless an opener follows.
    """
    held = text
    for pattern, replacement in marks():
        held = F.regexp_replace(held, pattern, replacement)
    return F.when(rare(text), held).otherwise(F.regexp_replace(text, _ONCE, f"$1{BREAK}$2$3"))


def rare(text: Column) -> Column:
    """Texts in which marks() of one step may show in another: with the lone `I`, dots in a row or apart, marks of their own, far
    indented lines and abbreviations right after a dot."""
    parts = functools.reduce(lambda a, b: a | b, (text.contains(part) for part in ("I.", "...", " .", "\t.", HOLD, UNSURE, REAL)))
    return parts | text.rlike(rf"\.(?:{_any_case(ABBREVIATIONS)})\.|\n[ \t]{{4}}")


def _any_case(words: list[str]) -> str:
    return "|".join(f"[{w[0].upper()}{w[0].lower()}]{w[1:]}" for w in words)


# Breaks of a text that is not rare(), in one pass that looks around each dot.
_EDGE = r"(?:^|[^\p{L}\p{N}.])"
_TITLE = rf"(?<!{_EDGE}(?:{_any_case(TITLES)}|[A-HJ-Z])\.)"
_SHORT = rf"(?!(?<={_EDGE}(?:{_any_case(ABBREVIATIONS)})\.)(?![ \t\n\r]+{_OPEN}(?:{'|'.join(OPENERS)})(?:[^\p{{L}}\p{{N}}]|\z)))"
_NUMBER = r"(?!(?<=(?:^|\n)[ \t]{0,3}(?:[0-9]{1,3}|[a-z])\.)[ \t])"
_ONCE = rf"([.!?…]{_TITLE}{_SHORT}{_NUMBER}[\"”’')\]]*)([ \t\n\r]+)({_OPEN}[\p{{Lu}}0-9])"


def sentences(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, sent_id, kind, begin, text, n_words); headings and table cells are one sentence, code has none.

    sent_id counts the sentences of a block from 0; begin is the offset in the document.
    """
    keep = [c for c in ("doc_id", "block_id", "kind", "begin") if c in blocks.columns]
    marked = F.when(F.col("kind").isin("heading", "table-cell"), F.array("text")).otherwise(F.split(broken(F.col("text")), BREAK, -1))
    parts = once(blocks.where("kind <> 'code'").select(*keep, marked.alias("parts")), "parts")
    # The pieces of a block add up to its text, so that a running sum of lengths gives their ends.
    parts = parts.withColumn("starts", running(F.transform("parts", F.length), F.col("begin") if "begin" in keep else None))
    each = parts.select(*keep, "starts", F.posexplode_outer("parts").alias("sent_id", "piece"))
    begin = F.get("starts", F.col("sent_id") + 1) - F.length(F.ltrim(F.col("piece"), F.lit(" \t\n\r")))
    text = F.btrim(F.col("piece"), F.lit(" \t\n\r"))
    out = each.select("doc_id", "block_id", "sent_id", "kind", begin.cast("int").alias("begin"), text.alias("text")).where("text <> ''")
    return out.withColumn("n_words", word_count(F.col("text")))


def once(df: DataFrame, name: str) -> DataFrame:
    """The rows with one column computed behind a generator, so that what reads it several times does not compute it again."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(name)).alias(name))


def worded(sents: DataFrame) -> DataFrame:
    """Sentences with their words: `forms`, `gaps` (what stands before each, and the rest) and `stops` (after where each begins to count, the first)."""
    cut = once(once(sents.withColumns({"forms": match_all(F.col("text"), WORD), "gaps": F.split(F.col("text"), WORD, -1)}), "forms"), "gaps")
    sizes = F.zip_with("forms", F.slice("gaps", F.lit(1), F.size("forms")), lambda f, g: F.length(f) + F.length(g))
    return cut.withColumn("stops", running(sizes, F.col("begin")))


def placed(rows: DataFrame, *others: str | Column) -> DataFrame:
    """(..., tok_id, form, begin, stop, gap) of worded() sentences, with the arrays and what `others` names; neighbours are read from the arrays."""
    keys = ["doc_id", "block_id", "sent_id", *others, "forms", "gaps", "stops"]
    each = rows.select(*keys, F.posexplode_outer("forms").alias("tok_id", "form")).where("form is not null")
    stop = F.get("stops", F.col("tok_id") + 1)
    return each.withColumns({"begin": (stop - F.length("form")).cast("int"), "stop": stop.cast("int"), "gap": F.get("gaps", F.col("tok_id"))})


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, block_id, sent_id, tok_id, form, begin, stop, gap): words of sentences; gap is what stands before a word."""
    return placed(worded(sents)).drop("forms", "gaps", "stops")


class Corpus:
    """The relations of one set of documents; each is a plan, nothing is computed before it is used."""

    def __init__(self, docs: DataFrame, blocks: DataFrame | None = None):
        from lectern.sources.blocks import blocks_of

        self._whole = blocks is None and "format" not in docs.columns
        # Dealt by document once: whole texts are the least there is to move, and all that groups by document stays in place.
        self.docs = docs if blocks is not None else docs.repartition("doc_id")
        self.blocks = blocks_of(self.docs) if blocks is None else blocks
        self.sentences = sentences(self.blocks)
        self.tokens = tokens(self.sentences)
        self._kept: list[DataFrame] = []

    def placed(self, *others: str | Column, where: Column | None = None) -> DataFrame:
        """placed() of the sentences that `where` takes."""
        return placed(worded(self.sentences if where is None else self.sentences.where(where)), *others)

    def texts(self, where: str = "true") -> DataFrame:
        """(doc_id, texts): what the words of each document are found in, without their places: its blocks, or the whole text where blocks only part it."""
        if self._whole:
            return self.docs.select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("texts"))
        return self.blocks.where("kind <> 'code'").where(where).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def keep(self, df: DataFrame) -> DataFrame:
        """Persists a relation until release()."""
        self._kept.append(df.persist())
        return self._kept[-1]

    def persist(self) -> Corpus:
        """Keeps the relations that every rule reads, in memory and beyond it on disk; lost parts are computed again."""
        if not self._kept:
            self.blocks = self.keep(self.blocks)
            self.sentences = self.keep(sentences(self.blocks))
            # Words are many times their sentences: each reader cuts those that it needs.
            self.tokens = tokens(self.sentences)
        return self

    def release(self) -> None:
        """Frees what persist() and the checks kept; results computed later read the documents again."""
        while self._kept:
            self._kept.pop().unpersist()
