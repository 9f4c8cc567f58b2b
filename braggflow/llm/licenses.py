r"""License scans: ordered signature rules over normalised words, in DataFrame expressions only.

A text is lower-cased and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; each word is written as
``" word "``, so a phrase is a plain string and neighbouring phrases share no blank.

* Base phrases are counted in every text: places, first and last place, labels.
* Signature rules are regexes over whole words, ordered by tier (name, version and clause; name and
  version; name; mention). A text is looked at further only if it has a rule's keyword. Its words that
  occur in any rule form *regions* of neighbouring words; each region meets only the rules whose
  keyword it has, and gives every match as an interval of words.
* A match is suppressed if it lies within a match of the same or a stronger tier that begins no later
  (the longer, then the stronger, then the earlier rule first). What is left gives labels and score.

A text's rows go to one task by one shuffle of small rows; texts are never shuffled. Matching has no
unbounded repetition, so neither long texts nor long runs of rule words cost more than linear time.

Defined results: a null text counts as empty; repeated rows are scanned each for itself; other columns
are ignored; a text without any match has the score 0 and empty labels; empty tables give empty results.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braggflow.llm.common import literal_table

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_LICENSE = "(license|licence)"
#: label: (keyword, names, versions). A token is a word or (a|b); a trailing ? makes it optional.
FAMILIES: dict[str, tuple[str, list[str], list[str]]] = {
    "gpl": ("general", [f"gnu? general public {_LICENSE}"], ["1", "2", "3"]),
    "gpl#": ("gpl", ["gnu? gpl"], ["1", "2", "3"]),
    "lgpl": ("general", [f"gnu? (lesser|library) general public {_LICENSE}"], ["2", "2.1", "3"]),
    "lgpl#": ("lgpl", ["gnu? lgpl"], ["2", "2.1", "3"]),
    "agpl": ("affero", [f"gnu? affero general public {_LICENSE}"], ["1", "3"]),
    "agpl#": ("agpl", ["gnu? agpl"], ["1", "3"]),
    "gfdl": ("documentation", [f"gnu? free documentation {_LICENSE}"], ["1.1", "1.2", "1.3"]),
    "gfdl#": ("gfdl", ["gnu? gfdl"], ["1.1", "1.2", "1.3"]),
    "apache": ("apache", [f"apache software? {_LICENSE}", "apache"], ["1.0", "1.1", "2.0"]),
    "mit": ("mit", [f"mit {_LICENSE}", f"mit x11? style? {_LICENSE}"], []),
    "bsd": ("bsd", [f"bsd {_LICENSE}", f"bsd style {_LICENSE}"], []),
    "bsd-2-clause": ("bsd", ["bsd 2 clause", "simplified bsd", "freebsd bsd"], []),
    "bsd-3-clause": ("bsd", ["bsd 3 clause", "(new|modified|revised) bsd"], []),
    "bsd-4-clause": ("bsd", ["bsd 4 clause", "original bsd"], []),
    "mpl": ("mozilla", [f"mozilla public {_LICENSE}"], ["1.0", "1.1", "2.0"]),
    "mpl#": ("mpl", ["mpl"], ["1.0", "1.1", "2.0"]),
    "epl": ("eclipse", [f"eclipse public {_LICENSE}"], ["1.0", "2.0"]),
    "epl#": ("epl", ["epl"], ["1.0", "2.0"]),
    "cddl": ("cddl", ["cddl"], ["1.0", "1.1"]),
    "cddl#": ("development", [f"common development and distribution {_LICENSE}"], ["1.0", "1.1"]),
    "eupl": ("eupl", ["eupl"], ["1.0", "1.1", "1.2"]),
    "eupl#": ("european", [f"european union public {_LICENSE}"], ["1.0", "1.1", "1.2"]),
    "artistic": ("artistic", [f"artistic {_LICENSE}", f"perl artistic {_LICENSE}"], ["1.0", "2.0"]),
    "bsl": ("boost", [f"boost software {_LICENSE}"], ["1.0"]),
    "busl": ("business", [f"business source {_LICENSE}"], ["1.1"]),
    "isc": ("isc", [f"isc {_LICENSE}"], []),
    "zlib": ("zlib", [f"zlib {_LICENSE}", f"zlib libpng {_LICENSE}"], []),
    "unlicense": ("unlicense", ["the unlicense", "unlicense"], []),
    "wtfpl": ("wtfpl", ["wtfpl"], ["1", "2"]),
    "psf": ("python", [f"python software foundation {_LICENSE}"], ["2"]),
    "psf#": ("psf", [f"psf {_LICENSE}"], ["2"]),
    "ofl": ("font", [f"sil? open font {_LICENSE}"], ["1.0", "1.1"]),
    "odbl": ("odbl", ["odbl", "odc odbl"], ["1.0"]),
    "cc0": ("cc0", ["cc0"], ["1.0"]),
    "cc0#": ("zero", ["creative commons zero"], ["1.0"]),
    "public-domain": ("domain", ["public domain", "dedicated to the public domain"], []),
    "all-rights-reserved": ("reserved", ["all rights reserved"], []),
    "proprietary": ("proprietary", [f"proprietary {_LICENSE}", "proprietary and confidential"], []),
} | {
    # Creative Commons: short and long spelling of each set of conditions
    f"cc-{short.replace(' ', '-')}{mark}": (key, [f"{pre} {spelt} {tail}".strip()], ["1.0", "2.0", "2.5", "3.0", "4.0"])
    for short, long in {
        "by": "attribution",
        "by sa": "attribution (sharealike|share) alike?",
        "by nd": "attribution (noderivatives|noderivs|no) (derivatives|derivs)?",
        "by nc": "attribution (noncommercial|non) commercial?",
        "by nc sa": "attribution (noncommercial|non) commercial? (sharealike|share) alike?",
        "by nc nd": "attribution (noncommercial|non) commercial? (noderivatives|noderivs|no) (derivatives|derivs)?",
    }.items()
    for mark, key, pre, spelt, tail in (("", "cc", "cc", short, ""), ("#", "creative", "creative commons", long, f"{_LICENSE}?"))
}
#: Clauses that may follow a version, and the label part they add.
CLAUSES = {"or (later|newer)": "-or-later", "or any later version": "-or-later", "or at your option any later version": "-or-later", "only": "-only"}
COPYLEFT = ("gpl", "lgpl", "agpl", "gfdl")
#: Weakest tier: mentions, which name no license.
MENTIONS = {
    "license": ("license", ["license", "under the terms of the license", "see the license file", "license file"]),
    "license#": ("licence", ["licence", "under the terms of the licence", "see the licence file", "licence file"]),
    "licensed": ("licensed", ["licensed under", "dual licensed", "licensed to"]),
    "spdx": ("spdx", ["spdx (license|licence) identifier"]),
}
CONFIDENCE = [1.0, 0.95, 0.8, 0.3]


def _regex(tokens: str) -> str:
    """A rule in words as a regex over the text in which each word is written ' word '."""
    return "".join(f"(?: (?:{t.rstrip('?').strip('()')}) )" + "?" * t.endswith("?") for t in tokens.split())


def _versions(version: str) -> list[str]:
    major, _, minor = version.partition(".")
    minor = f"{minor}?" if minor in ("", "0") else minor
    rest = "0?" if minor == "?" else minor
    return [f"(version|v|ver)? {major} {rest}", f"v{major} {rest}"]


def rules() -> list[tuple[int, int, str, str, str]]:
    """(order, tier, keyword, label, tokens) of every signature rule, the strongest tier first."""
    out = []
    for label, (key, names, versions) in FAMILIES.items():
        label = label.rstrip("#")
        for name in names:
            bare = name == "apache"
            for version, form in ((v, f) for v in versions for f in _versions(v)):
                if label in COPYLEFT:
                    out += [(0, key, f"{label}-{version}{add}", f"{name} {form} {clause}") for clause, add in CLAUSES.items()]
                out.append((1, key, f"{label}-{version}", f"{name} {form}"))
            if not bare:
                out.append((2, key, label, name))
    out += [(3, key, label.rstrip("#"), name) for label, (key, names) in MENTIONS.items() for name in names]
    out.sort(key=lambda r: r[0])
    return [(i, *r) for i, r in enumerate(out)]


def vocabulary() -> list[str]:
    """Every word that some rule can match."""
    return sorted({w for rule in rules() for w in re.findall(r"\w+", rule[4])})


def normalised(text: Column) -> Column:
    """Words as ' word ', lower-cased, with one more blank at either end.

    lower() also folds letters beyond A-Z; of these only the Kelvin sign becomes an ASCII letter, a k,
    which no base phrase has. Word counts are the same either way.
    """
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.regexp_replace(padded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")


def _count(s: Column) -> Column:
    """Words in a piece; the odd blank at either end of a text does not count."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
    spark, table = docs.sparkSession, rules()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("s")
    ).withColumn("n_words", _count(F.col("s")) - 1)
    # Base phrases: the pieces between places give counts and positions.
    places = []
    for phrase, label in BASE.items():
        coded = "".join(f" {w} " for w in phrase.split())
        parts = F.split("s", coded)
        places.append(
            F.when(
                F.contains("s", F.lit(coded)),
                F.struct(
                    (F.size(parts) - 1).cast("long").alias("n"),
                    _count(F.element_at(parts, 1)).alias("first"),
                    (F.col("n_words") - _count(F.element_at(parts, -1)) - len(phrase.split())).alias("last"),
                    F.lit(label).alias("label"),
                ),
            )
        )
    keywords = sorted({r[2] for r in table})
    spotted = F.col("s").rlike(" (?:" + "|".join(keywords) + ") ")
    words = F.split(F.trim("s"), "  ")
    known = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary()))
    rows = rows.withColumn("base", F.array_compact(F.array(*places))).select(
        "row",
        "id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_sort(F.transform("base", lambda b: b["label"])).alias("base_labels"),
        F.explode(
            F.concat(F.array(F.lit(None).cast("struct<at:int,word:string>")), F.when(spotted, known).otherwise(F.array().cast("array<struct<at:int,word:string>>")))
        ).alias("w"),
    )
    text = ["row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    # Regions: runs of neighbouring rule words. The row without a word stands for the text itself.
    by_row = rows.repartition("row")
    island = F.col("w.at") - F.row_number().over(Window.partitionBy("row").orderBy(F.asc_nulls_first("w.at")))
    regions = (
        by_row.withColumn("island", island)
        .groupBy(*text, "island")
        .agg(F.min("w.at").alias("begin"), F.array_sort(F.collect_list("w")).alias("ws"))
        .withColumn("region", F.array_join(F.transform("ws", lambda w: F.concat(F.lit(" "), w["word"], F.lit(" "))), ""))
        .withColumn("key", F.explode_outer(F.array_distinct(F.filter(F.transform("ws", lambda w: w["word"]), lambda w: w.isin(keywords)))))
    )
    signature = literal_table(spark, [(o, t, k, lab, _regex(p)) for o, t, k, lab, p in table], "ord int, tier int, r_key string, label string, pattern string")
    met = regions.join(F.broadcast(signature), F.col("key") == F.col("r_key"), "left")  # the rule table is a constant of this module
    pieces, found = F.split("region", F.col("pattern")), F.regexp_extract_all("region", F.col("pattern"), F.lit(0))
    hits = F.when(F.col("pattern").isNotNull(), F.filter(F.arrays_zip(pieces.alias("gap"), found.alias("match")), lambda x: x["match"].isNotNull()))
    met = met.select(*text, "island", "begin", "ord", "tier", "label", F.posexplode_outer(hits).alias("k", "hit"))
    run = Window.partitionBy("row", "island", "ord").orderBy("k")
    gap, match = _count(F.coalesce("hit.gap", F.lit(""))), _count(F.coalesce("hit.match", F.lit("")))
    ends = F.col("begin") + F.sum(gap + match).over(run)
    spans = met.withColumn("end", F.when(F.col("hit").isNotNull(), ends)).withColumn("start", F.col("end") - match)
    # Containment: what precedes in this order begins no later; its furthest end by tier decides.
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "tier", "ord").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.coalesce(*[F.when(F.col("tier") == t, F.max(F.when(F.col("tier") <= t, F.col("end"))).over(order)) for t in range(len(CONFIDENCE))])
    left = spans.withColumn("over", furthest)
    alive = F.col("end").isNotNull() & F.coalesce(F.col("over") < F.col("end"), F.lit(True))
    weight = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("tier") + 1)
    out = left.groupBy(*text).agg(F.collect_set(F.when(alive, F.col("label"))).alias("found"), F.max(F.when(alive, weight)).alias("score"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", "found"))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
