"""License scan by ordered signature rules. DataFrame functions only.

A text becomes a line of words: A-Z lower-cased, everything between words a single blank. Base phrases are
counted wherever their words stand one after the other. Beside them, some hundred regular expressions
over the line of words tell licenses apart. Each rule has a keyword, and its expression only runs on
texts that hold it; texts without any license word are not looked at. Detections overlap ("apache
license" stands in "apache license version 2"): one is suppressed if another of higher priority, or of
the same priority and longer, or equal and listed earlier, covers its interval. What is left gives labels.

Rules are made from names, versions and forms (see license_rules), so that a new license is a line.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import doc_key, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that are always counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Priorities: a tag or an address names a license for sure, a name with a version more surely than without.
TAG, ADDRESS, VERSIONED, NAMED = 4, 3, 2, 1
CONFIDENCE = {TAG: 1.0, ADDRESS: 0.95, VERSIONED: 0.9, NAMED: 0.6}
BASE_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression over words with single blanks; keyword: a literal part of all that it matches."""

    label: str
    keyword: str
    pattern: str
    priority: int


#: (label, names as (pattern, keyword), versions). Labels of versions are label-version.
FAMILIES = (
    ("gpl", (("(?:gnu )?gpl", "gpl"), ("(?:gnu )?general public licen[cs]e", "general public")), ("1", "2", "3")),
    ("lgpl", (("(?:gnu )?lgpl", "lgpl"), ("(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public")), ("2", "2.1", "3")),
    ("agpl", (("(?:gnu )?agpl", "agpl"), ("(?:gnu )?affero general public licen[cs]e", "affero")), ("1", "3")),
    ("gfdl", (("(?:gnu )?gfdl", "gfdl"), ("(?:gnu )?free documentation licen[cs]e", "free documentation")), ("1.1", "1.2", "1.3")),
    ("apache", (("apache(?: software)? licen[cs]e", "apache"), ("asl", "asl")), ("1", "1.1", "2")),
    ("mpl", (("mpl", "mpl"), ("mozilla public licen[cs]e", "mozilla")), ("1", "1.1", "2")),
    ("epl", (("epl", "epl"), ("eclipse public licen[cs]e", "eclipse")), ("1", "2")),
    ("cddl", (("cddl", "cddl"), ("common development and distribution licen[cs]e", "common development")), ("1", "1.1")),
    ("cpl", (("common public licen[cs]e", "common public"),), ("1",)),
    ("eupl", (("eupl", "eupl"), ("european union public licen[cs]e", "european union")), ("1", "1.1", "1.2")),
    ("osl", (("open software licen[cs]e", "open software"),), ("1", "1.1", "2", "2.1", "3")),
    ("afl", (("academic free licen[cs]e", "academic free"),), ("1.1", "1.2", "2", "2.1", "3")),
    ("artistic", (("artistic licen[cs]e", "artistic"),), ("1", "2")),
    ("ofl", (("(?:sil )?ofl", "ofl"), ("(?:sil )?open font licen[cs]e", "open font")), ("1", "1.1")),
    ("lppl", (("lppl", "lppl"), ("latex project public licen[cs]e", "latex project")), ("1", "1.1", "1.2", "1.3")),
    ("odbl", (("odbl", "odbl"), ("open database licen[cs]e", "open database")), ("1",)),
    ("odc-by", (("odc by", "odc by"), ("open data commons attribution licen[cs]e", "data commons attribution")), ("1",)),
    ("pddl", (("pddl", "pddl"), ("public domain dedication and licen[cs]e", "dedication and")), ("1",)),
    ("qpl", (("q public licen[cs]e", "q public"),), ("1",)),
    ("zpl", (("zope public licen[cs]e", "zope"),), ("1.1", "2", "2.1")),
    ("ecl", (("educational community licen[cs]e", "educational community"),), ("1", "2")),
    ("bsl", (("boost software licen[cs]e", "boost"),), ("1",)),
    ("psf", (("python software foundation licen[cs]e", "python software"), ("psf licen[cs]e", "psf")), ("2",)),
    ("php", (("php licen[cs]e", "php"),), ("3", "3.01")),
    ("w3c", (("w3c(?: software(?: notice)?)? licen[cs]e", "w3c"),), ()),
    ("upl", (("universal permissive licen[cs]e", "universal permissive"),), ("1",)),
    ("cecill", (("cecill(?: free software)?(?: licen[cs]e)?", "cecill"),), ("1", "1.1", "2", "2.1")),
    ("mit", (("mit licen[cs]e", "mit"), ("mit x11 licen[cs]e", "mit"), ("expat licen[cs]e", "expat")), ()),
    ("bsd", (("bsd licen[cs]e", "bsd"), ("bsd style licen[cs]e", "bsd")), ()),
    ("bsd-0-clause", (("(?:0|zero) clause bsd(?: licen[cs]e)?", "clause bsd"), ("0bsd", "0bsd")), ()),
    ("bsd-2-clause", (("(?:2|two) clause bsd(?: licen[cs]e)?", "clause bsd"), ("bsd (?:2|two) clause(?: licen[cs]e)?", "bsd"), ("(?:simplified|freebsd) bsd(?: licen[cs]e)?", "bsd")), ()),
    ("bsd-3-clause", (("(?:3|three) clause bsd(?: licen[cs]e)?", "clause bsd"), ("bsd (?:3|three) clause(?: licen[cs]e)?", "bsd"), ("(?:new|modified|revised) bsd(?: licen[cs]e)?", "bsd")), ()),
    ("bsd-4-clause", (("(?:4|four) clause bsd(?: licen[cs]e)?", "clause bsd"), ("bsd (?:4|four) clause(?: licen[cs]e)?", "bsd"), ("original bsd(?: licen[cs]e)?", "bsd")), ()),
    ("isc", (("isc licen[cs]e", "isc"),), ()),
    ("zlib", (("zlib(?: libpng)? licen[cs]e", "zlib"),), ()),
    ("ncsa", (("(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),), ()),
    ("openssl", (("openssl licen[cs]e", "openssl"),), ()),
    ("postgresql", (("postgresql licen[cs]e", "postgresql"),), ()),
    ("ruby", (("ruby licen[cs]e", "ruby"),), ()),
    ("vim", (("vim licen[cs]e", "vim"),), ()),
    ("ms-pl", (("microsoft public licen[cs]e", "microsoft public"), ("ms pl", "ms pl")), ()),
    ("ms-rl", (("microsoft reciprocal licen[cs]e", "microsoft reciprocal"), ("ms rl", "ms rl")), ()),
    ("unlicense", (("the unlicense", "unlicense"),), ()),
    ("wtfpl", (("wtfpl", "wtfpl"), ("do what the fuck you want to public licen[cs]e", "you want to public")), ("1", "2")),
    ("public-domain", (("(?:in|into|to) the public domain", "public domain"), ("public domain dedication", "public domain")), ()),
    ("all-rights-reserved", (("all rights reserved", "rights reserved"),), ()),
)
#: Elements of the shared attribution licenses: (label, abbreviation, name).
SHARED = (
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative|ativework|ative work)s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative|ativework|ative work)s?"),
)
SHARED_VERSIONS = ("1", "2", "2.5", "3", "4")
#: Addresses after their scheme, as words, and what they name.
ADDRESSES = (
    ("opensource org licenses mit", "mit"), ("opensource org licenses isc", "isc"), ("opensource org licenses zlib", "zlib"),
    ("opensource org licenses bsd 2 clause", "bsd-2-clause"), ("opensource org licenses bsd 3 clause", "bsd-3-clause"),
    ("apache org licenses license 2 0", "apache-2"), ("apache org licenses license 1 1", "apache-1.1"),
    ("gnu org licenses gpl 2 0", "gpl-2"), ("gnu org licenses gpl 3 0", "gpl-3"), ("gnu org licenses lgpl 2 1", "lgpl-2.1"),
    ("gnu org licenses lgpl 3 0", "lgpl-3"), ("gnu org licenses agpl 3 0", "agpl-3"), ("gnu org licenses fdl 1 3", "gfdl-1.3"),
    ("mozilla org mpl 2 0", "mpl-2"), ("eclipse org legal epl 2 0", "epl-2"), ("eclipse org legal epl v10", "epl-1"),
    ("unlicense org", "unlicense"), ("creativecommons org publicdomain zero 1 0", "cc0"), ("boost org license 1 0", "bsl-1"), ("scripts sil org ofl", "ofl"),
    ("opendatacommons org licenses odbl", "odbl"), ("opendatacommons org licenses by", "odc-by"), ("opendatacommons org licenses pddl", "pddl"),
)


def _version(version: str) -> str:
    """A version as words: 2 also stands for 2.0, which the line of words has as "2 0"."""
    words = version.replace(".", " ")
    return f"(?:version |v |ver )?v?{words}" + ("(?: 0)?" if "." not in version else "")


def license_rules() -> tuple[Rule, ...]:
    """All rules in order. Of equal detections the rule listed first stays."""
    rules = []
    for label, names, versions in FAMILIES:
        for version in versions:
            v = _version(version)
            for name, keyword in names:
                rules.append(Rule(f"{label}-{version}-or-later", keyword, f"{name} {v}(?: of the license)? or (?:any )?(?:later|newer)(?: version)?", VERSIONED))
                rules.append(Rule(f"{label}-{version}", keyword, f"{name} {v}", VERSIONED))
            tag = f"{label} {version}".replace("-", " ").replace(".", " ")
            rules.append(Rule(f"{label}-{version}", "spdx", f"spdx license identifier {tag}(?: 0)?(?: only| or later)?", TAG))
        for name, keyword in names:
            rules.append(Rule(label, keyword, name, NAMED))
        rules.append(Rule(label, "spdx", f"spdx license identifier {label.replace('-', ' ')}", TAG if not versions else VERSIONED))
    for label, short, long in SHARED:
        for version in SHARED_VERSIONS:
            v = _version(version)
            rules.append(Rule(f"{label}-{version}", f"cc {short}", f"cc {short} {v}", VERSIONED))
            rules.append(Rule(f"{label}-{version}", "creative commons", f"creative commons {long} {v}", VERSIONED))
            rules.append(Rule(f"{label}-{version}", "spdx", f"spdx license identifier cc {short} {version.replace('.', ' ')}(?: 0)?", TAG))
            rules.append(Rule(f"{label}-{version}", "creativecommons", f"creativecommons org licenses {short} {version.replace('.', ' ')}(?: 0)?", ADDRESS))
        rules.append(Rule(label, f"cc {short}", f"cc {short}", NAMED))
        rules.append(Rule(label, "creative commons", f"creative commons {long}", NAMED))
    rules += [Rule("cc0", "cc0", "cc0(?: 1 0)?", VERSIONED), Rule("cc0", "creative commons zero", "creative commons zero(?: 1 0)?", VERSIONED)]
    rules += [Rule(label, words, words, ADDRESS) for words, label in ADDRESSES]
    return tuple(rules)


def word_line(text: Column) -> Column:
    """"." and then every word with a blank before it, and a blank at the end: " w1 w2 " after the dot. Null: no words."""
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " ")
    return F.concat(F.lit(". "), F.ltrim(flat), F.when(flat.endswith(" ") | (F.ltrim(flat) == ""), "").otherwise(" "))


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def base_places(line: Column, phrases: Sequence[tuple[str, str]] = BASE) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the array base of labels, from a line of words.

    The line is cut where a phrase begins (it may overlap itself), so the words before the first and the
    last cut are where the phrase starts first and last.
    """
    counts, firsts, lasts, labels = [], [], [], []
    total = _blanks(line)
    for phrase, label in phrases:
        has = F.contains(line, F.lit(f" {phrase} "))
        pieces = F.split(line, f"(?= {phrase} )")
        counts.append(F.when(has, F.size(pieces) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, _blanks(F.element_at(pieces, 1))))
        lasts.append(F.when(has, total - _blanks(F.element_at(pieces, -1))))
        labels.append(F.when(has, F.lit(label)))
    n = counts[0]
    for c in counts[1:]:
        n = n + c
    least, greatest = (F.least, F.greatest) if len(phrases) > 1 else (F.coalesce, F.coalesce)
    # a line without words is ". ": its blank belongs to no word
    return {
        "n_words": F.greatest(total - 1, F.lit(0)).cast("long"), "n_base": n, "first_word": least(*firsts).cast("long"),
        "last_word": greatest(*lasts).cast("long"), "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def _keyword_pattern(rules: Sequence[Rule]) -> str:
    """One expression for texts as they are that finds any keyword; keywords with one first letter share a branch."""
    by_letter: dict[str, list[str]] = {}
    for keyword in sorted({r.keyword for r in rules}):
        by_letter.setdefault(keyword[0], []).append(keyword[1:].replace(" ", BETWEEN_ANY_CASE))
    branches = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?i)(?<![a-z0-9])(?:{branches})(?![a-z0-9])"


def detections(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(_did, _th, start, end, number, priority, label) of every match in docs (_did, _th, line); each once for equal rows.

    A rule's expression marks its matches, and the line is cut at the marks: the lengths before a cut
    give its place. Cuts are rows, so a text with very many matches is no large array.
    """
    known = json.dumps([{"number": i, **asdict(r)} for i, r in enumerate(rules)])
    known = F.from_json(F.lit(known), "array<struct<number:int,label:string,keyword:string,pattern:string,priority:int>>")
    able = F.filter(known, lambda r: F.contains(F.col("line"), r["keyword"]))
    ran = docs.select("_did", "_th", "line", F.explode(able).alias("r"))
    marked = F.regexp_replace(F.col("line"), F.concat(F.lit("(?<= )("), F.col("r.pattern"), F.lit(")(?= )")), F.lit("\x01$1\x02"))
    cut = ran.where(F.expr("regexp_like(line, concat('(?<= )(?:', r.pattern, ')(?= )'))")).select("_did", "_th", "r", F.posexplode(F.split(marked, "\x01")).alias("k", "piece"))
    end = F.instr("piece", "\x02")  # the match's length and one
    cut = cut.select("_did", "_th", F.col("r.number").alias("number"), F.col("r.priority").alias("priority"), F.col("r.label").alias("label"), "k",
                     F.greatest(end - 1, F.lit(0)).cast("long").alias("size"), (F.length("piece") - (end > 0).cast("int")).cast("long").alias("length")).distinct()
    before = Window.partitionBy("_did", "_th", "number").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.where("k > 0").select("_did", "_th", "start", (F.col("start") + F.col("size")).alias("end"), "number", "priority", "label")


def surviving(found: DataFrame) -> DataFrame:
    """Detections that no other of their text suppresses.

    In order of start, longest first, then by priority and rule, whatever can cover a detection comes
    before it; so a running greatest end for each priority tells whether it is covered.
    """
    order = Window.partitionBy("_did", "_th").orderBy("start", F.desc("end"), F.desc("priority"), "number").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(CONFIDENCE)
    reached = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in levels}
    covered = F.lit(False)
    for p in levels:
        covered = covered | ((F.col("priority") == p) & F.coalesce(reached[p] >= F.col("end"), F.lit(False)))
    return found.withColumn("covered", covered).where("NOT covered").drop("covered")


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = BASE, rules: Sequence[Rule] | None = None) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and characters beyond ASCII. n_base counts the places of the
    phrases, first_word and last_word are the smallest and largest of their first words (null without
    any). base_labels are those of the phrases found, labels those of the rules too; both distinct,
    sorted and joined by commas, empty for none. score is the confidence of the surest label, 0 without
    one. Null and empty texts have no words. Equal rows get equal results; a null doc_id stays null.
    Other columns are ignored.
    """
    rules = license_rules() if rules is None else rules
    keyed = docs.select("doc_id", *doc_key(), F.col("text").cast("string").alias("text"))
    out = keyed.select("doc_id", "_did", "_th", word_line(F.col("text")).alias("line"))
    out = out.select("doc_id", "_did", "_th", *[c.alias(n) for n, c in base_places(F.col("line"), phrases).items()])
    if rules:
        lines = keyed.where(F.col("text").rlike(_keyword_pattern(rules))).select("_did", "_th", word_line(F.col("text")).alias("line"))
        left = surviving(detections(lines, rules))
        sure = F.lit(0.0)
        for p, c in CONFIDENCE.items():
            sure = F.when(F.col("priority") == p, c).otherwise(sure)
        labels = written(left.groupBy(F.col("_did").alias("_d"), F.col("_th").alias("_t")).agg(F.collect_set("label").alias("more"), F.max(sure).alias("sure")))
        out = out.join(labels, (F.col("_did") == F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    else:
        out = out.withColumns({"more": F.array().cast("array<string>"), "sure": F.lit(0.0)})
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    by_base = F.when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(by_base, F.coalesce("sure", F.lit(0.0))).alias("score"))
