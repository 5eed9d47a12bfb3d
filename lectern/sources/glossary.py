"""Glossaries as terms (concept, term, status, exact): from TOML, TBX and accept/reject word lists, and back to TBX and TOML."""

from __future__ import annotations

import re
import tomllib
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "concept string, term string, status string, exact boolean"
# Administrative statuses of TBX and what they mean here.
STATUSES = {"preferredTerm-admn-sts": "preferred", "admittedTerm-admn-sts": "admitted", "deprecatedTerm-admn-sts": "deprecated", "supersededTerm-admn-sts": "deprecated", "preferred": "preferred", "admitted": "admitted", "notRecommended": "deprecated", "obsolete": "deprecated"}


def _capital(term: str) -> bool:
    return term != term.lower()


def from_toml(spark: SparkSession, text: str) -> DataFrame:
    """`[[concept]]` tables with an id and terms (text, status, case); the status is preferred and the case exact with a capital by default."""
    rows = []
    for c in tomllib.loads(text).get("concept", []):
        for t in c.get("term", []):
            term = t["text"]
            rows.append((c["id"], term, t.get("status", "preferred"), t["case"] == "exact" if "case" in t else _capital(term)))
    return spark.createDataFrame(rows, SCHEMA)


def from_tbx(spark: SparkSession, text: str, language: str = "en") -> DataFrame:
    """English sections of TBX, with or without name spaces, in the styles of version 3 and of Basic."""
    local = lambda e: e.tag.rpartition("}")[2]
    rows = []
    for number, entry in enumerate(e for e in ET.fromstring(text).iter() if local(e) in ("conceptEntry", "termEntry")):
        for section in (e for e in entry.iter() if local(e) in ("langSec", "langSet")):
            if not section.get("{http://www.w3.org/XML/1998/namespace}lang", "").lower().startswith(language):
                continue
            for unit in (e for e in section.iter() if local(e) in ("termSec", "tig", "ntig")):
                term = next((e.text or "" for e in unit.iter() if local(e) == "term"), "").strip()
                notes = [e.text or "" for e in unit.iter() if e.get("type") == "administrativeStatus" or local(e) == "administrativeStatus"]
                if term:
                    rows.append((entry.get("id") or str(number), term, STATUSES.get(notes[0].strip(), "preferred") if notes else "preferred", _capital(term)))
    return spark.createDataFrame(rows, SCHEMA)


def from_word_lists(spark: SparkSession, accept: str, reject: str = "") -> tuple[DataFrame, list[str]]:
    """Accepted and rejected words, one a line; `[Pp]ython` means a word whose first letter may be a capital. Also the lines left out, which are
    other patterns."""
    rows, left = [], []
    for status, text in (("preferred", accept), ("deprecated", reject)):
        for line in filter(None, map(str.strip, text.splitlines())):
            if line.startswith("#"):
                continue
            either = re.fullmatch(r"\[(\w)(\w)\](.*)", line)
            word = either[2] + either[3] if either and either[1].lower() == either[2].lower() else line
            if re.search(r"[\\\[\](){}|?*+^$]", word):
                left.append(line)
            else:
                rows.append((word.lower(), word, status, _capital(word) and not either))
    return spark.createDataFrame(rows, SCHEMA), left


def to_toml(terms: DataFrame) -> DataFrame:
    """(concept, toml): one `[[concept]]` table each."""
    quoted = F.replace(F.replace(F.col("term"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.format_string('{ text = "%s", status = "%s", case = "%s" }', quoted, F.col("status"), F.when(F.col("exact"), "exact").otherwise("any"))
    per = terms.withColumn("line", line).groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list("line")), ",\n  ").alias("lines"))
    return per.select("concept", F.format_string('[[concept]]\nid = "%s"\nterm = [\n  %s\n]\n', "concept", "lines").alias("toml"))


def to_tbx(terms: DataFrame) -> DataFrame:
    """(concept, tbx): one concept entry each."""
    safe = F.replace(F.replace(F.col("term"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("preferred", "preferredTerm-admn-sts", "admitted", "admittedTerm-admn-sts", "deprecated", "deprecatedTerm-admn-sts")]), F.col("status"))
    unit = F.format_string('<termSec><term>%s</term><termNote type="administrativeStatus">%s</termNote></termSec>', safe, status)
    per = terms.withColumn("unit", unit).groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list("unit")), "").alias("units"))
    return per.select("concept", F.format_string('<conceptEntry id="%s"><langSec xml:lang="en">%s</langSec></conceptEntry>', "concept", "units").alias("tbx"))
