"""Shallow grammar in place of a parse: a suffix tagger, runs of tags and patterns over neighbours.

All kinds here approximate what a grammar would prove and are marked shallow in the README.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WORD, edges, match_all
from lectern.operators.segment import Corpus, once, worded

# Closed classes and small verb lists of English.
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no"]
PREPOSITIONS = ["of", "in", "on", "at", "by", "for", "from", "with", "into", "over", "under", "about", "after", "before", "between", "through"]
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"]
CONJUNCTIONS = ["and", "or", "but", "nor"]
BE = ["am", "is", "are", "was", "were", "be", "been", "being"]
MODALS = ["can", "could", "may", "might", "must", "shall", "should", "will", "would"]
PARTICIPLES = ["done", "made", "given", "taken", "seen", "known", "written", "built", "held", "kept", "found", "sent", "set", "put", "told", "shown"]
NEGATIONS = ["not", "no", "never", "none", "nothing", "nobody", "neither", "nor", "cannot", "without"]
VERBS = ["add", "ask", "build", "call", "change", "check", "choose", "click", "close", "copy", "create", "delete", "do", "draw", "enter", "fill", "find", "get", "give", "go", "install", "keep", "make", "move", "open", "pick", "press", "put", "read", "remove", "run", "save", "select", "send", "set", "start", "stop", "take", "test", "turn", "type", "use", "write"]


def _in_sentence():
    return Window.partitionBy("doc_id", "block_id", "sent_id").orderBy("tok_id")


def tag(form: Column, first: Column, low: Column | None = None) -> Column:
    """A Penn-like tag from closed classes, shape and endings, in this order."""
    low = F.lower(form) if low is None else low
    return (
        F.when(form.rlike(r"^[0-9]"), "CD")
        .when(low.isin(DETERMINERS), "DT")
        .when(low.isin(PREPOSITIONS), "IN")
        .when(low.isin(PRONOUNS), "PRP")
        .when(low.isin(CONJUNCTIONS), "CC")
        .when(low == "to", "TO")
        .when(low.isin(MODALS), "MD")
        .when(low.isin("is", "was", "has", "does"), "VBZ")
        .when(low.isin(BE), "VBP")
        .when(low.isin(NEGATIONS), "RB")
        .when(low.isin(PARTICIPLES), "VBN")
        .when(form.rlike(r"^\p{Lu}") & ~first, F.when(form.rlike("s$"), "NNPS").otherwise("NNP"))
        .when(low.rlike("ly$"), "RB")
        .when(low.rlike(r"\p{L}{2,}ing$"), "VBG")
        .when(low.rlike(r"\p{L}{2,}ed$"), "VBN")
        .when(low.rlike("(ous|ful|ive|able|ible|al|ic|less|ary|ish)$"), "JJ")
        .when(low.rlike("(ss|us|is)$"), "NN")
        .when(low.rlike("s$"), "NNS")
        .otherwise("NN")
    )


def tagged(corpus: Corpus) -> DataFrame:
    return corpus.tokens.withColumn("tag", tag(F.col("form"), F.col("tok_id") == 0))


def _flagged(corpus: Corpus, flag: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Sentences with their words as arrays and `flags`, a letter for each word by flag(form, tag, joined): what runs of words are read
    from, in place of a window. joined: only blanks stand before the word."""
    rows = once(worded(corpus.sentences).withColumn("lows", F.transform("forms", F.lower)), "lows")
    tags = once(rows.withColumn("tags", F.transform("forms", lambda f, i: tag(f, i == 0, F.get("lows", i)))), "tags")
    letters = F.transform("tags", lambda t, i: flag(F.get("forms", i), t, F.get("gaps", i).rlike(r"^[ \t\n]*$")))
    return tags.withColumn("flags", F.array_join(letters, ""))


def _runs(rows: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, block_id, sent_id, begin, stop, n, match) of the matches of a pattern over the flags."""
    from lectern.functions.text import spans

    rows = rows.where(F.col("flags").rlike(pattern)).select("doc_id", "block_id", "sent_id", "forms", "stops", F.explode(spans(F.col("flags"), pattern)).alias("s"))
    rows = rows.withColumns({"at": F.col("s.begin"), "n": F.length("s.match")})
    begin = F.get("stops", F.col("at") + 1) - F.length(F.get("forms", F.col("at")))
    return rows.select("doc_id", "block_id", "sent_id", begin.cast("int").alias("begin"), F.get("stops", F.col("at") + F.col("n")).cast("int").alias("stop"), F.col("n").cast("long").alias("n"), F.array_join(F.slice("forms", F.col("at") + 1, F.col("n")), " ").alias("match"))


def chunks(corpus: Corpus) -> DataFrame:
    """tokens with tag and base chunk (B-NP, I-NP, B-VP, I-VP, B-PP, B-ADVP or O): a class of each tag, and B where the class changes."""
    kind = (
        F.when(F.col("tag").isin("DT", "JJ", "NN", "NNS", "NNP", "NNPS", "CD", "PRP"), "NP")
        .when(F.col("tag").isin("MD", "VBZ", "VBP", "VBN", "VBG", "TO"), "VP")
        .when(F.col("tag") == "IN", "PP")
        .when(F.col("tag") == "RB", "ADVP")
    )
    rows = tagged(corpus).withColumn("class", kind)
    begins = (F.lag("class").over(_in_sentence()).eqNullSafe(F.col("class"))) & ~F.col("tag").isin("DT", "PRP", "IN") & ~F.col("gap").contains(",")
    return rows.withColumn("chunk", F.when(F.col("class").isNull(), "O").otherwise(F.concat(F.when(begins, "I-").otherwise("B-"), "class"))).drop("class")


def noun_stacks(corpus: Corpus, least: int = 3, most: int | None = None, tags: tuple[str, ...] = ("NN", "NNS")) -> DataFrame:
    """Runs of lower-case nouns with only blanks between."""
    letter = lambda form, t, joined: F.when(t.isin(*tags) & (F.lower(form) == form), F.when(joined, "n").otherwise("N")).otherwise("-")
    out = _runs(_flagged(corpus, letter), f"[nN]n{{{max(least - 1, 0)},}}")
    return out if most is None else out.where(F.col("n") <= most)


def adjective_stacks(corpus: Corpus, least: int = 3) -> DataFrame:
    """Runs of `least` adjectives or more with only blanks between that stand right before a noun."""
    letter = lambda form, t, joined: F.when(t == "JJ", F.when(joined, "j").otherwise("J")).when(t.startswith("NN") & joined, "n").otherwise("-")
    return _runs(_flagged(corpus, letter), f"[jJ]j{{{max(least - 1, 0)},}}(?=n)").drop("match")


def modifier_density(corpus: Corpus, least: int = 5, ratio: float = 0.3) -> DataFrame:
    """Sentences with many adjectives and adverbs."""
    per = tagged(corpus).groupBy("doc_id", "block_id", "sent_id").agg(F.sum(F.col("tag").isin("JJ", "RB").cast("int")).alias("n_modifiers"), F.count(F.lit(1)).alias("n_words"))
    return per.where((F.col("n_modifiers") >= least) & (F.col("n_modifiers") >= ratio * F.col("n_words")))


def passives(corpus: Corpus, window: int = 3, agentless: bool = False) -> DataFrame:
    """A form of be with a participle among the next `window` words, all between adverbs; agentless: with no `by` later in the sentence."""
    gate = F.col("text").rlike("(?i)" + "|".join(BE))
    rows = corpus.placed(where=gate).where(F.lower("form").isin(BE))
    at = F.col("tok_id")
    rows = rows.withColumn("ahead", F.transform(F.slice("forms", at + 2, F.lit(window)), lambda f: tag(f, F.lit(False))))
    verb = F.array_position("ahead", "VBN").cast("int")
    rows = rows.withColumn("at", verb).where((F.col("at") > 0) & F.forall(F.slice("ahead", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), lambda t: t == "RB"))
    if agentless:
        rows = rows.where(~F.exists(F.slice("forms", at + 2, F.size("forms")), lambda f: F.lower(f) == "by"))
    return rows.select("doc_id", "block_id", "sent_id", "begin", F.get("stops", at + F.col("at") + 1).cast("int").alias("stop"), F.get("forms", at + F.col("at")).alias("participle"))


def coordinations(corpus: Corpus, least: int = 3, most: int | None = 3) -> DataFrame:
    """`X, Y and Z` of single words: sentences' lists with at least `least` members."""
    from lectern.functions.text import spans

    pattern = r"\p{L}+(?:, \p{L}+)+,? (?:and|or) \p{L}+"
    each = corpus.sentences.where(F.col("text").rlike(pattern)).select("doc_id", "block_id", "sent_id", F.col("begin").alias("at"), F.explode(spans(F.col("text"), pattern)).alias("s"))
    n = F.size(F.regexp_extract_all(F.regexp_replace("s.match", r",? (and|or) ", ", "), F.lit(r"\p{L}+"), F.lit(0)))
    out = each.select("doc_id", "block_id", "sent_id", (F.col("at") + F.col("s.begin")).alias("begin"), F.col("s.match").alias("match"), n.alias("n")).where(F.col("n") >= least)
    return out if most is None else out.where(F.col("n") <= most)


def stacked_negations(corpus: Corpus, least: int = 2) -> DataFrame:
    """Sentences with several negation words."""
    per = corpus.tokens.where(F.lower("form").isin(NEGATIONS) | F.lower("form").rlike("n['’]t$")).groupBy("doc_id", "block_id", "sent_id").agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") >= least)


def bare_demonstratives(corpus: Corpus) -> DataFrame:
    """Sentences that open with This or That as a whole noun phrase: before a form of be, a modal or a common verb."""
    pattern = r"^(?:This|That) (?:is|was|will|can|may|might|must|should|would|means|makes|gives|shows|has|does)\b"
    pattern = edges(pattern)
    found = corpus.sentences.where(F.col("text").rlike(pattern))
    return found.select("doc_id", "block_id", "sent_id", "begin", F.regexp_extract("text", pattern, 0).alias("match"))


def missing_comparands(corpus: Corpus) -> DataFrame:
    """be + comparative with no `than` later in the sentence."""
    pattern = r"\b(?:is|are|was|were|be) (?:more \p{Ll}+|(?:bett|few|great|small|larg|fast|slow|high|low)er)\b"
    found = corpus.sentences.where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"\bthan\b"))
    return found.select("doc_id", "block_id", "sent_id", "begin", F.regexp_extract("text", pattern, 0).alias("match"))


def tense_shifts(corpus: Corpus, least: int = 3, share: float = 2 / 3) -> DataFrame:
    """Sentences whose tense is not that of most tensed sentences of their block. Tense: was, were, had or did is past; is, are, has or does present."""
    low = F.lower("text")
    past, present = low.rlike(edges(r"\b(was|were|had|did)\b")), low.rlike(edges(r"\b(is|are|has|does)\b"))
    tense = corpus.sentences.where(past != present).select("doc_id", "block_id", "sent_id", "begin", past.cast("int").alias("past"))
    block = Window.partitionBy("doc_id", "block_id")
    rated = tense.withColumns({"n": F.count(F.lit(1)).over(block), "n_past": F.sum("past").over(block)})
    minority = F.when(F.col("n_past") >= share * F.col("n"), F.col("past") == 0).when(F.col("n") - F.col("n_past") >= share * F.col("n"), F.col("past") == 1)
    return rated.where((F.col("n") >= least) & minority).select("doc_id", "block_id", "sent_id", "begin", "past", "n", "n_past")


def restatements(corpus: Corpus, least: int = 4, percent: int = 80) -> DataFrame:
    """Sentences that share `percent` of the content words (four letters or more) of an earlier sentence of their document.

    A sentence of n words that shares k = ceil(n * percent / 100) of them with another shares one of any n - k + 1: each looks
    for partners by its rarest words alone, counted in the document, and the words of both decide. The earliest partner is kept.
    """
    order = F.struct("block_id", "sent_id").alias("of")
    forms = F.filter(match_all(F.col("text"), WORD), lambda w: F.length(w) >= 4)
    # Behind a generator, so that neither the filter nor the size finds the words again.
    words = corpus.sentences.select("doc_id", order, F.explode(F.array(F.array_distinct(F.transform(forms, F.lower)))).alias("words")).where(F.size("words") >= least)
    each = words.select("doc_id", "of", F.size("words").alias("n"), F.explode("words").alias("word"))
    # Words of one sentence of the document meet nothing; they come first among the rarest.
    shared = each.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "word"))).where("times > 1")
    ranked = shared.groupBy("doc_id", "of", "n").agg(F.sort_array(F.collect_list(F.struct("times", "word"))).alias("rarest"))
    alone = F.col("n") - F.size("rarest")
    most = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100) - 1e-9) + 1 - alone).cast("int")
    probes = ranked.where(most > 0).select("doc_id", F.col("of").alias("later"), F.explode(F.slice("rarest", F.lit(1), most)).alias("w")).select("doc_id", "later", F.col("w.word").alias("word"))
    met = probes.join(shared.select("doc_id", "word", F.col("of").alias("earlier")), ["doc_id", "word"])
    pairs = met.where("earlier < later").select("doc_id", "later", "earlier").distinct()
    side = lambda name: words.select("doc_id", F.col("of").alias(name), F.col("words").alias(f"{name}_words"))
    both = pairs.join(side("later"), ["doc_id", "later"]).join(side("earlier"), ["doc_id", "earlier"])
    near = both.where(F.size(F.array_intersect("later_words", "earlier_words")) * 100 >= F.size("later_words") * percent)
    return near.groupBy("doc_id", "later").agg(F.min("earlier").alias("earlier")).select("doc_id", F.col("later.block_id").alias("block_id"), F.col("later.sent_id").alias("sent_id"), F.col("earlier.block_id").alias("of_block"), F.col("earlier.sent_id").alias("of_sent"))


def vacuous(corpus: Corpus, abstract: DataFrame, least: int = 3, percent: int = 80) -> DataFrame:
    """Sentences whose content words (four letters or more) are mostly abstract (word), with no name and no number."""
    rows = tagged(corpus)
    per = ["doc_id", "block_id", "sent_id"]
    name = F.col("tag").isin("NNP", "NNPS", "CD")
    # Names, numbers and content words alone decide, so that no other word is looked up.
    rows = rows.where(name | (F.length("form") >= 4)).select(*per, F.lower("form").alias("low"), (F.length("form") >= 4).alias("content"), name.alias("name"))
    marked = rows.join(F.broadcast(abstract.select(F.col("word").alias("abstract_word"))), F.col("low") == F.col("abstract_word"), "left")
    per = marked.groupBy(*per).agg(F.sum(F.col("content").cast("int")).alias("n"), F.sum((F.col("content") & F.col("abstract_word").isNotNull()).cast("int")).alias("n_abstract"), F.max(F.col("name").cast("int")).alias("concrete"))
    return per.where((F.col("n") >= least) & (F.col("n_abstract") * 100 >= F.col("n") * percent) & (F.col("concrete") == 0)).drop("concrete")


def aphorisms(corpus: Corpus, most: int = 7) -> DataFrame:
    """Short sentences of bare lower-case words around one present verb: `Speed is trust.`"""
    pattern = r"^\p{Lu}\p{Ll}+ (?:is|beats|means|makes|builds) (?:\p{Ll}+ ?)+\.$"
    return corpus.sentences.where((F.col("n_words") <= most) & F.col("text").rlike(pattern)).select("doc_id", "block_id", "sent_id", "begin", F.col("text").alias("match"))


#: (rule, pattern, replacement): agreement errors that hold without a parse.
AGREEMENT = [
    ("modal-verb-s", r"\b(can|could|may|might|must|should|would|will) (make|give|take|show|need|help|keep|work|run)s\b", "$1 $2"),
    ("pronoun-verb-s", r"\b(I|[Ww]e|[Yy]ou|[Tt]hey) (make|give|take|show|need|help|keep|work|run)s\b", "$1 $2"),
    ("be-have", r"\b(is|are|was|were) (have)\b", "$1 having"),
    ("could-of", r"\b(could|should|would|must) of\b", "$1 have"),
]


def agreement(corpus: Corpus) -> DataFrame:
    """All AGREEMENT patterns in one pass over the sentences; `rule` and `fixed` with each match."""
    from lectern.functions.text import spans

    def found(rule: str, pattern: str, fix: str) -> Column:
        return F.transform(spans(F.col("text"), pattern), lambda s: F.struct(F.lit(rule).alias("rule"), s["begin"].alias("begin"), s["match"].alias("match"), F.regexp_replace(s["match"], pattern, fix).alias("fixed")))

    per = [found(*a) for a in AGREEMENT]
    each = corpus.sentences.where(F.col("text").rlike("|".join(p for _, p, _ in AGREEMENT))).select("doc_id", "block_id", "sent_id", F.col("begin").alias("at"), F.explode(F.flatten(F.array(*per))).alias("m"))
    return each.select("doc_id", "block_id", "sent_id", (F.col("at") + F.col("m.begin")).alias("begin"), F.col("m.match").alias("match"), F.col("m.rule").alias("rule"), F.col("m.fixed").alias("fixed"))


def ambiguities(readings: DataFrame, temperature: float = 1.0, least: float = 0.25) -> DataFrame:
    """Sentences (sent_key) whose second meaning keeps `least` of the probability. readings (sent_key, score, dependencies array):
    softmax of the scores, summed over readings with the same set of dependencies."""
    of = Window.partitionBy("sent_key")
    weight = F.exp((F.col("score") - F.max("score").over(of)) / temperature)
    grouped = readings.withColumn("weight", weight).groupBy("sent_key", F.array_sort(F.array_distinct("dependencies")).alias("meaning")).agg(F.sum("weight").alias("weight"))
    share = F.col("weight") / F.sum("weight").over(of)
    ranked = grouped.withColumn("share", share).withColumn("rank", F.row_number().over(of.orderBy(F.desc("share"), "meaning")))
    return ranked.where((F.col("rank") == 2) & (F.col("share") >= least)).select("sent_key", "share")
