"""What happens to findings: quote filter, precedence, density of findings, order, fixes, reports and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import indels_only, running
from lectern.operators.segment import once

# Ranks of severities; info is another name of suggestion.
RANKS = {"error": 0, "warning": 1, "suggestion": 2, "info": 2}


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), severity)


def at_least(found: DataFrame, severity: str) -> DataFrame:
    return found.where(severity_rank(F.col("severity")) <= RANKS[severity])


def enabled(found: DataFrame, disabled: list[str]) -> DataFrame:
    """Without rules that are disabled by id or by `prefix*`."""
    from lectern.functions.text import glob

    for pattern in disabled:
        found = found.where(~glob(F.col("rule"), pattern))
    return found


def quote_filter(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """Findings that don't lie entirely inside a quoted span of their document."""
    rows = found.withColumns({"_at": F.col("begin"), "_late": F.lit(1)})
    q = quotes.select("doc_id", F.col("begin").alias("_at"), F.lit(0).alias("_late"), F.col("stop").alias("_stop"))
    # The furthest end of the quotations that begin before a finding or with it: one running maximum in place of a join on ranges.
    order = Window.partitionBy("doc_id").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(q, allowMissingColumns=True).withColumn("_end", F.max("_stop").over(order)).where("_late = 1")
    inside = (F.col("stop") <= F.col("_end")) & (F.col("begin") < F.col("stop")) & F.col("doc_id").isNotNull()
    return both.where(~F.coalesce(inside, F.lit(False))).select(*found.columns)


def yields_to(found: DataFrame, precedence: DataFrame) -> DataFrame:
    """Findings that overlap none of a rule they yield to. precedence (rule, over): judged on the set before removal, so both sides may go.

    Each finding stands at its end, and those that others yield to also at their begin: a running maximum of their ends tells whether
    one that begins before a finding's end reaches beyond its begin. The pairs of rules are few and pass through the driver.
    """
    pairs: dict[str, list[str]] = {}
    for row in precedence.select("rule", "over").distinct().collect():
        pairs.setdefault(row["over"], []).append(row["rule"])
    if not pairs:
        return found
    own = F.struct(F.col("stop").alias("_at"), F.lit(0).alias("_strong"))
    strong = F.when(F.col("rule").isin(list(pairs)), F.struct(F.col("begin").alias("_at"), F.lit(1).alias("_strong")))
    rows = found.select(*found.columns, F.explode(F.array_compact(F.array(own, strong))).alias("_e")).select(*found.columns, "_e.*")
    order = Window.partitionBy("doc_id").orderBy("_at", "_strong").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overs = sorted(pairs)
    rows = rows.withColumns({f"_end{k}": F.max(F.when((F.col("_strong") == 1) & (F.col("rule") == over), F.col("stop"))).over(order) for k, over in enumerate(overs)}).where("_strong = 0")
    lost = F.lit(False)
    for k, over in enumerate(overs):
        lost = lost | (F.col("rule").isin(pairs[over]) & F.coalesce(F.col(f"_end{k}") > F.col("begin"), F.lit(False)))
    return rows.where(~(lost & F.col("doc_id").isNotNull())).select(*found.columns)


def tell_density(found: DataFrame, sentences: DataFrame, prefixes: list[str], per: int = 100, most: float = 2.0, least: int = 5) -> DataFrame:
    """Documents with `least` or more findings of rules with one of the prefixes, more than `most` in `per` words; reported on the first sentence."""
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col("rule").startswith(p)
    counts = found.where(starts).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = sentences.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.min("begin").alias("begin"))
    return counts.join(total, "doc_id").where((F.col("n") >= least) & (F.col("n") * per / F.greatest("n_words", F.lit(1)) > most))


def dedup_sorted(found: DataFrame) -> DataFrame:
    """One finding of each rule and span, with its place in the order of begin, severity and rule in the document.

    Equal findings that others separate in that order also become one here.
    """
    one = found.dropDuplicates(["doc_id", "rule", "begin", "stop"])
    order = Window.partitionBy("doc_id").orderBy("begin", severity_rank(F.col("severity")), "rule", "stop")
    return one.withColumn("place", F.row_number().over(order))


def apply_fixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fixed, n_fixes): replacements from left to right; one that begins before the end of the last is skipped, touching is allowed.

    A fold over the sorted fixes of a document, exact as the order demands.
    """
    fixes = found.where("replacement is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "stop", "replacement"))).alias("fixes"))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(state: Column, fix: Column) -> Column:
        taken = F.struct(fix["stop"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, fix["begin"] - state["at"]), fix["replacement"]).alias("out"), (state["n"] + 1).alias("n"))
        return F.when(fix["begin"] < state["at"], state).otherwise(taken)

    folded = F.aggregate("fixes", start, step)
    out = docs.join(fixes, "doc_id", "left").withColumn("folded", folded)
    rest = F.concat(F.col("folded.out"), F.substring(text, F.col("folded.at") + 1, F.length(text)))
    return out.select("doc_id", F.when(F.col("fixes").isNull(), text).otherwise(rest).alias("fixed"), F.coalesce("folded.n", F.lit(0)).alias("n_fixes"))


def located(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings with 1-based line and column of both ends."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    starts = once(docs.select("doc_id", lines.alias("lines")), "lines").select("doc_id", running(F.transform("lines", lambda x: F.length(x) + 1)).alias("starts"))
    # Each line's begin goes with a finding, not the text; the last sum is behind the end.
    out = found.join(starts.withColumn("starts", F.slice("starts", F.lit(1), F.size("starts") - 1)), "doc_id")
    line = lambda offset: F.size(F.filter("starts", lambda at: at <= F.col(offset)))
    column = lambda offset, of: F.col(offset) - F.get("starts", F.col(of) - 1) + 1
    out = out.withColumns({"line": line("begin"), "end_line": line("stop")})
    return out.withColumns({"column": column("begin", "line"), "end_column": column("stop", "end_line")}).drop("starts")


def report_lines(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, place, line): `id:line:column: severity [rule] message`."""
    rows = dedup_sorted(located(found, docs))
    return rows.select("doc_id", "place", F.format_string("%s:%d:%d: %s [%s] %s", F.col("doc_id").cast("string"), "line", "column", "severity", "rule", "message").alias("line"))


def report_json(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, json): one object a document with its findings in order."""
    rows = dedup_sorted(located(found, docs))
    item = F.struct("place", "rule", "severity", "message", F.col("begin").alias("start"), F.col("stop").alias("end"), "line", "column", "end_line", "end_column", F.col("match").alias("text"), F.col("replacement").alias("fix"), "suggestions")
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    bare = F.transform("items", lambda i: i.dropFields("place"))
    return per.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), bare.alias("diagnostics"))).alias("json"))


def sarif_results(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, place, result): SARIF 2.1.0 result objects, one a finding; suggestions become notes."""
    rows = dedup_sorted(located(found, docs))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity").isin("suggestion", "info"), "note").otherwise(F.col("severity"))
    fix = F.when(F.col("replacement").isNotNull(), F.array(F.struct(F.array(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), F.array(F.struct(region.alias("deletedRegion"), F.struct(F.col("replacement").alias("text")).alias("insertedContent"))).alias("replacements"))).alias("artifactChanges"))))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), fix.alias("fixes"))
    return rows.select("doc_id", "place", "rule", F.to_json(result).alias("result"))


def sarif_log(results: DataFrame) -> DataFrame:
    """(sarif): one log for all documents. Its size follows the findings, so it is a sink for reports of one project, not of a corpus."""
    runs = results.agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_list(F.struct("doc_id", "place", "result"))).alias("results"))
    rules = F.array_join(F.transform("rules", lambda r: F.concat(F.lit('{"id":"'), r, F.lit('"}'))), ",")
    items = F.array_join(F.transform("results", lambda r: r["result"]), ",")
    return runs.select(F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"lectern","rules":['), rules, F.lit("]}},\"results\":["), items, F.lit("]}]}")).alias("sarif"))


def severity_rollup(found: DataFrame) -> DataFrame:
    """Counts by rule and severity, with totals of each rule and of all."""
    per = found.groupBy("doc_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return per.rollup("rule", "severity").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def rule_rates(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """Findings of each rule in 1,000 words."""
    total = sentences.agg(F.sum("n_words").alias("n_words"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("rule", "n", (F.lit(1000.0) * F.col("n") / F.col("n_words")).alias("per_1000"))


def calibration(judged: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, accuracy, brier, nll) of (p, right): reliability of probabilities by equal bins."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-9)), F.lit(1e-9))
    right = F.col("right").cast("double")
    per = judged.withColumns({"bin": F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"), "brier": (F.col("p") - right) ** 2, "nll": -F.when(F.col("right") == 1, F.log(p)).otherwise(F.log(1 - p))})
    return per.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(right).alias("accuracy"), F.avg("brier").alias("brier"), F.avg("nll").alias("nll"))


def rewrite_candidates(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, block_id, sent_id, ord, candidate, n_fixes): the sentence as it is, with each fix alone, and with all that don't overlap."""
    key = ["doc_id", "block_id", "sent_id"]
    fixes = found.where("replacement is not null").select(*key, "begin", "stop", "rule", "match", "replacement")
    fixes = fixes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("begin", "stop", "rule", "replacement", "match"))).alias("fixes"))
    # Sentences stream past the few that have fixes, so that neither side's texts are sorted.
    rows = sentences.select(*key, F.col("begin").alias("s_begin"), "text").join(fixes.hint("shuffle_hash"), key)
    start = F.struct(F.col("s_begin").alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(state: Column, fix: Column) -> Column:
        kept = F.substring(F.col("text"), state["at"] - F.col("s_begin") + 1, fix["begin"] - state["at"])
        stop = fix["begin"] + F.length(fix["match"])
        taken = F.struct(stop.alias("at"), F.concat(state["out"], kept, fix["replacement"]).alias("out"), (state["n"] + 1).alias("n"), (state["most"] + F.levenshtein(fix["match"], fix["replacement"])).alias("most"))
        return F.when(fix["begin"] < state["at"], state).otherwise(taken)

    # The fold goes by begin, end and replacement; the order of candidates by begin, end and rule.
    by_text = F.array_sort(F.transform("fixes", lambda f: F.struct(f["begin"].alias("begin"), (f["begin"] + F.length(f["match"])).alias("stop"), f["replacement"].alias("replacement"), f["match"].alias("match"))))
    rows = rows.withColumn("all", F.aggregate(by_text, start, step))
    whole = F.struct(F.lit(0).alias("ord"), F.concat(F.col("all.out"), F.substring(F.col("text"), F.col("all.at") - F.col("s_begin") + 1, F.length("text"))).alias("candidate"), F.col("all.n").alias("n_fixes"), F.col("all.most").alias("most"))

    def alone(fix: Column, i: Column) -> Column:
        at = fix["begin"] - F.col("s_begin")
        text = F.concat(F.substring(F.col("text"), F.lit(1), at), fix["replacement"], F.substring(F.col("text"), at + F.length(fix["match"]) + 1, F.length("text")))
        return F.struct((i + 1).alias("ord"), text.alias("candidate"), F.lit(1).alias("n_fixes"), F.levenshtein(fix["match"], fix["replacement"]).alias("most"))

    each = rows.select(*key, F.col("text").alias("original"), F.explode(F.concat(F.array(whole), F.transform("fixes", alone))).alias("c"))
    return each.select(*key, "c.*", "original").where("n_fixes > 0")


def choose_rewrites(candidates: DataFrame, originals: DataFrame, score: Column) -> DataFrame:
    """The best candidate of each sentence: highest score, then most fixes, then the smaller edit, then the order.

    The edits of single fixes bound the distance of a candidate (`most`), so that long sentences are compared in a narrow band.
    """
    key = ["doc_id", "block_id", "sent_id"]
    rows = candidates if "original" in candidates.columns else candidates.join(originals.select(*key, F.col("text").alias("original")), key)
    edit = F.expr("levenshtein(candidate, original, most)") if "most" in rows.columns else F.levenshtein("candidate", "original")
    rows = rows.withColumn("score", score).withColumn("edit", edit)
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("n_fixes"), "edit", "ord"))
    return rows.withColumn("best", best).where("best = 1").drop("best", "original", "most")


def decide(units: DataFrame, model, options: list[str], flag: str, threshold: float = 0.8) -> DataFrame:
    """Units (doc_id, block_id, sent_id, text) for which a model gives an option at least `threshold` of the probability.

    model: text -> one score an option; it runs in Arrow batches on the executors. The options are also asked in reversed order and
    the two answers averaged, against a bias for a place.
    """
    import math

    at = options.index(flag)

    def run(frames):
        for frame in frames:
            def share(text: str) -> float:
                total = 0.0
                for order in (options, options[::-1]):
                    scores = dict(zip(order, model(text, order)))
                    best = max(scores.values())
                    weights = {o: math.exp(s - best) for o, s in scores.items()}
                    total += weights[options[at]] / sum(weights.values())
                return total / 2

            frame["probability"] = [share(t or "") for t in frame["text"]]
            yield frame

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInPandas(run, f"{fields}, probability double").where(F.col("probability") >= threshold)


def fit_temperature(samples: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 17, rounds: int = 6) -> float:
    """The temperature under which the right answers are likeliest; samples (scores array<double>, right int). 1 without samples.

    The likelihood has one peak over the temperature's logarithm, so each round judges a grid of `points` in one aggregate
    and the next one lies between the neighbours of the best.
    """
    import math

    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * k / (points - 1) for k in range(points)]
        row = samples.agg(*(F.sum(_loss(math.exp(x))) for x in grid)).first()
        if row[0] is None:
            return 1.0
        best = min(range(points), key=lambda k: row[k])
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return math.exp((a + b) / 2)


def _loss(temperature: float) -> Column:
    """Negative log likelihood of the right answer by a softmax at a temperature."""
    scaled = F.transform("scores", lambda s: s / F.lit(temperature))
    top = F.array_max(scaled)
    return top + F.log(F.aggregate(scaled, F.lit(0.0), lambda n, s: n + F.exp(s - top))) - F.get(scaled, F.col("right"))


def surroundings(sentences: DataFrame) -> DataFrame:
    """(doc_id, block_id, sent_id, context): the sentences before and after each, as context for a question about it."""
    order = Window.partitionBy("doc_id").orderBy("block_id", "sent_id")
    before, after = F.concat(F.lit("Before it: "), F.lag("text").over(order)), F.concat(F.lit("After it: "), F.lead("text").over(order))
    return sentences.select("doc_id", "block_id", "sent_id", F.concat_ws("\n", before, after).alias("context"))


def words_in(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens that overlap spans (doc_id, begin, stop), with the span as span_begin and span_stop: an equi-join by document with a range."""
    at = spans.select("doc_id", F.col("begin").alias("span_begin"), F.col("stop").alias("span_stop"))
    return tokens.join(at, "doc_id").where("begin < span_stop and span_begin < stop")


def released(found: DataFrame, least: int = 6) -> DataFrame:
    """Findings that stand without a model: those that need none, and misspellings without capitals whose only suggestion drops or adds letters."""
    only = (F.size("suggestions") == 1) & (F.length("match") >= least) & ~F.col("match").rlike(r"\p{Lu}")
    return found.where(~F.coalesce("needs_model", F.lit(False)) | (only & indels_only(F.col("match"), F.get("suggestions", F.lit(0)))))
