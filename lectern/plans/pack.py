"""Rule packs: TOML files compiled into plans.

All pattern rules of a pack run in one pass over the sentences, behind one alternation that skips sentences none can match; all
phrase rules are one join on n-grams. Other kinds are one plan each. Unknown kinds, missing fields and bad patterns are errors at load time.
"""

from __future__ import annotations

import dataclasses
import pathlib
import re
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import kinds, post, shallow, structure
from lectern.operators.segment import Corpus
from lectern.sources.blocks import to_source

SEVERITIES = ("error", "warning", "suggestion", "info")
SCOPES = ("all", "heading", "body", "paragraph", "list-item", "lead")
#: kind -> fields it needs.
KINDS = {
    "words": ["words"], "regex": ["pattern"], "existence": ["tokens"], "substitution": ["swap"], "sentence-pair": ["pattern", "next"], "sentence-length": ["max"], "density": ["max"],
    "tell-density": ["of", "max"], "repeated-word": [], "articles": [], "consistency": ["variants"], "variants": [], "acronyms": ["check"], "spelling": [], "coined-words": [], "concept-names": [],
    "hyphen-chain": [], "ly-hyphen": [], "noun-stack": [], "modifier-density": [], "passive": [], "coordination": [], "stacked-negation": [], "bare-demonstrative": [], "missing-comparand": [], "tense-shift": [], "restatement": [], "aphorism": [], "agreement": [], "structure": ["check"], "parallel": ["of"],
}


class PackError(ValueError):
    """A pack that cannot be loaded."""


@dataclasses.dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    severity: str
    message: str
    params: dict
    scope: str = "all"
    yields_to: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    acceptable: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...]
    quoted: bool = False


def parse(text: str) -> Pack:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PackError(str(e)) from None
    name, rules = raw.get("name"), []
    if not name:
        raise PackError("a pack needs a name")
    for r in raw.get("rule", []):
        own = {k: r.pop(k) for k in ("id", "kind", "severity", "message") if k in r}
        where = f"{name}.{own.get('id', '?')}"
        if len(own) < 4:
            raise PackError(f"{where}: id, kind, severity and message are needed")
        if own["kind"] not in KINDS:
            raise PackError(f"{where}: unknown kind {own['kind']}")
        if own["severity"] not in SEVERITIES or r.get("scope", "all") not in SCOPES:
            raise PackError(f"{where}: unknown severity or scope")
        if missing := [f for f in KINDS[own["kind"]] if f not in r]:
            raise PackError(f"{where}: {', '.join(missing)} is missing")
        for field in ("pattern", "next", "unless"):
            if field in r:
                try:
                    re.compile(re.sub(r"\\p\{L\w?\}|\\p\{N\}|\\x\{[0-9A-Fa-f]+\}", "x", r[field]))
                except re.error as e:
                    raise PackError(f"{where}: {field}: {e}") from None
        lists = {k: tuple(r.pop(k, ())) for k in ("yields_to", "examples", "acceptable")}
        rules.append(Rule(where, own["kind"], own["severity"], own["message"], r, r.pop("scope", "all"), **lists))
    return Pack(name, tuple(rules), bool(raw.get("quoted", False)))


def built_in(names: list[str] | None = None) -> list[Pack]:
    folder = pathlib.Path(__file__).parent.parent / "packs"
    return [parse(p.read_text()) for p in sorted(folder.glob("*.toml")) if names is None or p.stem in names]


_MATCH = "array<struct<rule:string,severity:string,template:string,at:int,match:string,replacement:string>>"


def _matches_of(rule: Rule) -> tuple[Column, str]:
    """The matches of a regex or existence rule in a sentence (text, masked, word_set), and its pattern."""
    p = rule.params
    pattern = p["pattern"] if rule.kind == "regex" else ("(?i)" if p.get("ignorecase") else "") + kinds.bounded(p["tokens"])
    wanted = F.lit(True)
    if p.get("needs"):
        wanted = F.arrays_overlap(F.col("word_set"), F.array(*map(F.lit, p["needs"])))
    if p.get("unless"):
        wanted = wanted & ~F.col("text").rlike(p["unless"])
    of = F.col("masked") if rule.kind == "existence" or p.get("needs") else F.col("text")

    def row(s: Column) -> Column:
        fixed = F.regexp_replace(s["match"], pattern, p["replace"]) if "replace" in p else F.lit(None).cast("string")
        return F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("template"), s["begin"].alias("at"), s["match"].alias("match"), fixed.alias("replacement"))

    found = F.transform(X.spans(of, pattern), lambda s: row(s))
    if p.get("exceptions"):
        listed = [e.lower() for e in p["exceptions"]]
        found = F.filter(found, lambda m: ~F.lower(m["match"]).isin(listed))
    return F.when(wanted, found.cast(_MATCH)).otherwise(F.array().cast(_MATCH)), pattern


def _patterns(corpus: Corpus, rules: list[Rule]) -> DataFrame:
    """All regex and existence rules of one scope in one pass."""
    per, gates = map(list, zip(*map(_matches_of, rules), strict=True))
    sents = kinds.in_scope(corpus, rules[0].scope).where(F.col("text").rlike("|".join(f"(?:{g})" for g in gates)))
    sents = sents.withColumns({"masked": kinds.mask_code(F.col("text")), "word_set": X.word_set(F.col("text"))})
    each = sents.select("doc_id", "block_id", "sent_id", F.col("begin").alias("s"), F.explode(F.flatten(F.array(*per))).alias("m"))
    begin = F.col("s") + F.col("m.at")
    rows = each.select("doc_id", "m.rule", "m.severity", F.replace(F.col("m.template"), F.lit("{match}"), F.col("m.match")).alias("message"), begin.cast("int").alias("begin"), (begin + F.length("m.match")).cast("int").alias("stop"), "m.match", "m.replacement", F.array().cast("array<string>").alias("suggestions"), "block_id", "sent_id")
    return rows.select(*kinds.FINDINGS)


def _phrases(corpus: Corpus, rules: list[Rule]) -> DataFrame:
    """All words and substitution rules of a scope in one join; overlaps are resolved within each rule."""
    items, meta = [], []
    for r in rules:
        swap = r.params["swap"] if r.kind == "substitution" else dict.fromkeys(r.params["words"]) | dict(r.params.get("replace", {}))
        for item in sorted(swap):
            meta.append((len(items), r.id, r.severity, r.message))
            items.append((item, swap[item]))
    spark = corpus.docs.sparkSession
    rules_of = spark.createDataFrame(meta, "item_id int, rule string, severity string, template string")
    table = kinds.phrase_items(spark, items).join(rules_of.select("item_id", "rule"), "item_id")
    most = max(len(re.findall(r"\S+", i)) for i, _ in items)
    hits = kinds.words(corpus, F.broadcast(table), most).join(F.broadcast(rules_of.drop("rule")), "item_id")
    if rules[0].scope != "all":
        hits = hits.join(kinds.in_scope(corpus, rules[0].scope).select("doc_id", "block_id", "sent_id"), ["doc_id", "block_id", "sent_id"], "left_semi")
    single = F.when(~F.col("fixed").contains("|"), F.col("fixed"))
    choices = F.when(F.col("fixed").isNull(), F.array().cast("array<string>")).otherwise(F.split("fixed", r"\|"))
    hits = hits.where(F.coalesce(F.col("fixed") != F.col("match"), F.lit(True)))
    return hits.select("doc_id", "rule", "severity", F.replace(F.col("template"), F.lit("{match}"), F.col("match")).alias("message"), "begin", "stop", "match", single.alias("replacement"), choices.alias("suggestions"), "block_id", "sent_id").select(*kinds.FINDINGS)


_STRUCTURE = {
    "heading-increment": structure.heading_increment, "single-h1": structure.single_h1, "empty-section": structure.empty_section, "stacked-headings": structure.stacked_headings, "lone-subsection": structure.lone_subsection, "conclusion-at-end": structure.conclusion_at_end,
}


def _blocks(corpus: Corpus, rule: Rule) -> DataFrame:
    p, b, s = rule.params, corpus.blocks, corpus.sentences
    if rule.kind == "parallel":
        found = structure.parallel(b, p["of"], p.get("min_items", 3), p.get("majority", 0.75))
    elif p["check"] in _STRUCTURE:
        found = _STRUCTURE[p["check"]](b)
    else:
        found = {
            "depth": lambda: structure.depth(b, p.get("max", 4)),
            "wall-of-text": lambda: structure.wall_of_text(b, p.get("max_words", 450), p.get("max_paragraphs", 5)),
            "one-line-paragraphs": lambda: structure.one_line_paragraphs(b, s, p.get("max_words", 8), p.get("min", 3), p.get("share", 0.4)),
            "bold-lead-ins": lambda: structure.bold_lead_ins(b, p.get("min", 3), p.get("share", 0.5)),
            "paragraph-length": lambda: structure.paragraph_length(b, s, p.get("max_words", 150), p.get("max_sentences")),
            "vague-lead": lambda: structure.vague_lead(b, p["pattern"]),
            "unnumbered-steps": lambda: structure.unnumbered_steps(b, shallow.VERBS),
        }[p["check"]]()
    keyed = found.select("doc_id", "block_id").distinct().join(b.select("doc_id", "block_id", "begin", F.col("text").alias("match")), ["doc_id", "block_id"])
    return kinds.findings(keyed.withColumn("stop", F.col("begin") + F.length("match")), rule.id, rule.severity, rule.message)


def _one(corpus: Corpus, rule: Rule) -> DataFrame:
    p = rule.params
    if rule.kind in ("structure", "parallel"):
        return _blocks(corpus, rule)
    known = lambda: kinds.lexicon(corpus, p.get("min_docs", 20))
    found = {
        "sentence-pair": lambda: kinds.sentence_pair(corpus, p["pattern"], p["next"]),
        "sentence-length": lambda: kinds.sentence_length(corpus, p["max"]),
        "density": lambda: kinds.density(corpus, p.get("chars", []), p.get("words", []), p.get("per", 100), p["max"]),
        "repeated-word": lambda: kinds.double_article(corpus) if p.get("articles") else kinds.repeated_word(corpus),
        "articles": lambda: kinds.articles(corpus),
        "consistency": lambda: kinds.consistency(corpus, F.broadcast(corpus.docs.sparkSession.createDataFrame([tuple(v) for v in p["variants"]], "word string, axis string, variety string, other string"))),
        "variants": lambda: kinds.variants(corpus, p.get("min_length", 5)),
        "acronyms": lambda: kinds.acronyms(corpus, p["check"], p.get("known", [])),
        "spelling": lambda: kinds.spelling(corpus, known(), p.get("min_length", 4)),
        "coined-words": lambda: kinds.coined_words(corpus, known()),
        "concept-names": lambda: kinds.concept_names(corpus),
        "hyphen-chain": lambda: kinds.hyphen_chain(corpus, p.get("except", [])),
        "ly-hyphen": lambda: kinds.ly_hyphen(corpus),
        "noun-stack": lambda: shallow.noun_stacks(corpus, p.get("min", 3), p.get("max")),
        "adjective-stack": lambda: shallow.adjective_stacks(corpus, p.get("min", 3)),
        "passive": lambda: shallow.passives(corpus, p.get("window", 3), p.get("agentless", False)),
        "coordination": lambda: shallow.coordinations(corpus, p.get("min", 3), p.get("max")),
        "bare-demonstrative": lambda: shallow.bare_demonstratives(corpus),
        "missing-comparand": lambda: shallow.missing_comparands(corpus),
        "aphorism": lambda: shallow.aphorisms(corpus),
        "agreement": lambda: shallow.agreement(corpus).drop("rule"),
        "stacked-negation": lambda: shallow.stacked_negations(corpus),
        "modifier-density": lambda: shallow.modifier_density(corpus),
        "tense-shift": lambda: shallow.tense_shifts(corpus).drop("n"),
        "restatement": lambda: shallow.restatements(corpus),
    }[rule.kind]()
    if "begin" not in found.columns:
        whole = corpus.sentences.select("doc_id", "block_id", "sent_id", "begin")
        found = found.join(whole, ["doc_id", "block_id", "sent_id"])
    if "match" not in found.columns:
        found = found.join(corpus.sentences.select("doc_id", "block_id", "sent_id", F.col("text").alias("match")), ["doc_id", "block_id", "sent_id"])
    if "stop" not in found.columns:
        found = found.withColumn("stop", F.col("begin") + F.length("match"))
    return kinds.findings(found, rule.id, rule.severity, rule.message, F.col("fixed") if "fixed" in found.columns else None, F.col("choices") if "choices" in found.columns else None)


def check(corpus: Corpus, packs: list[Pack], quotes: DataFrame | None = None) -> DataFrame:
    """The findings of all packs: quoted text is left out (unless a pack takes it), then rules yield, then densities of findings are judged.

    Offsets are those of the documents. The corpus keeps what several rules read until corpus.release().
    """
    corpus.persist()
    quotes = corpus.keep(quotes) if quotes is not None else None
    found: list[DataFrame] = []
    for pack in packs:
        own: list[DataFrame] = []
        for scope in SCOPES:
            if rules := [r for r in pack.rules if r.kind in ("regex", "existence") and r.scope == scope]:
                own.append(_patterns(corpus, rules))
            if rules := [r for r in pack.rules if r.kind in ("words", "substitution") and r.scope == scope]:
                own.append(_phrases(corpus, rules))
        own += [_one(corpus, r) for r in pack.rules if r.kind not in ("regex", "existence", "words", "substitution", "tell-density")]
        if own:
            rows = own[0]
            for more in own[1:]:
                rows = rows.unionByName(more)
            rows = to_source(rows, corpus.blocks)
            rows = post.quote_filter(rows, quotes) if quotes is not None and not pack.quoted else rows
            found.append(corpus.keep(rows))  # read again by precedence and densities; planned once
    if not found:
        raise PackError("no rules")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [(r.id, o) for p in packs for r in p.rules for o in r.yields_to]
    if order:
        rows = post.yields_to(rows, corpus.docs.sparkSession.createDataFrame(order, "rule string, over string"))
    for r in (r for p in packs for r in p.rules if r.kind == "tell-density"):
        dense = post.tell_density(rows, corpus.sentences, r.params["of"], r.params.get("per", 100), r.params["max"], r.params.get("min", 5))
        dense = dense.withColumns({"stop": F.col("begin"), "match": F.lit("")})
        rows = rows.unionByName(kinds.findings(dense, r.id, r.severity, r.message))
    return rows
