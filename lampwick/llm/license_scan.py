"""Licence scans by canonical digests."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Spellings that count as equal: of one word, and of several.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licencee": "licensee", "licencees": "licensees", "licences": "licenses",
    "licencing": "licensing", "relicence": "relicense", "relicencing": "relicensing", "sublicence": "sublicense", "sublicenced": "sublicensed", "sublicences": "sublicenses", "sublicencing": "sublicensing", "unlicence": "unlicense",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
PHRASES = {"copyright owner": "copyright holder", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}
#: A line that only says who holds the rights.
COPYRIGHT = r"^\s*(copyright\s*(\(c\)|©|[0-9]{4}|by |\[yyyy\]|<year>)|\(c\)|©|all rights reserved)"
#: The same with a name alone, as it is written: nothing but capitalised words.
NAMED = r"^\s*Copyright( [A-Z][\w.&'-]*)+[.,]?\s*$"

#: Whole licences, by file name.
TEXTS = Path(__file__).parent / "licenses"
#: Lines that often stand above a text of the file.
TITLES = {
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "MIT-0": ("MIT No Attribution",), "Zlib": ("zlib License",),
}
#: What may be left out of a text: all that stands from these words on.
APPENDIX = {"Apache-2.0": "APPENDIX: How to apply", "GPL-2.0": "How to Apply These Terms", "GPL-3.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms"}
#: One-line notices.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def _spelled(words: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.transform(words, lambda w: F.when(w.isin(*SPELLINGS), F.element_at(table, w)).otherwise(w))


def _phrases(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), PHRASES.items(), F.concat(F.lit(" "), text, F.lit(" ")))


def canonical_line(line: Column) -> Column:
    """Lower case; a copyright line is empty; what is neither letter nor digit is one space; equal spellings are one."""
    low = F.lower(line)
    plain = F.trim(F.regexp_replace(low, r"[^\p{L}\p{Nd}]+", " "))
    text = F.when(low.rlike(COPYRIGHT) | line.rlike(NAMED), "").otherwise(F.array_join(_spelled(F.split(plain, " ")), " "))
    return F.trim(_phrases(text))


def with_lines(docs: DataFrame) -> DataFrame:
    """Adds ``_lines``: canonical lines of the whole text, empty ones left out."""
    lines = F.transform(F.split(text_of(), "\r\n|\r|\n"), canonical_line)
    return docs.withColumn("_lines", F.filter(lines, lambda x: x != ""))


def digest(lines: Column) -> Column:
    """SHA-256 of the joined lines; null where there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.trim(_phrases(F.array_join(lines, " "))), 256))


def catalogue() -> list[tuple[str, str]]:
    """(license_id, text): the notices, and each whole licence as it stands, under its titles, and without its appendix."""
    rows = list(NOTICES.items())
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        rows += [(path.stem, f"{title}{text}") for title in ("", *(f"{t}\n\n" for t in TITLES.get(path.stem, ())))]
        if path.stem in APPENDIX:
            rows.append((path.stem, text[: text.index(APPENDIX[path.stem])]))
    return rows


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, known_digest), one row for each text: a fixed catalogue."""
    rows = list(texts.items()) if texts else catalogue()
    df = with_lines(spark.createDataFrame(rows, "license_id string, text string"))
    return df.select("license_id", digest(F.col("_lines")).alias("known_digest")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, license_id, notices.

    license_id is the licence that the whole canonical text is; notices, sorted
    and comma-joined, are those that one of its lines is by itself. Both are
    hash joins of digests with the catalogue, which is a fixed table of this
    module or one that the caller bounds, and is broadcast. A text of copyright
    lines or of nothing, null too, has a null digest and no licence; repeated
    rows are scanned each; other columns are ignored.
    """
    sent = F.broadcast(known)
    ready = with_lines(docs.select("doc_id", "text"))
    units = F.array_distinct(F.transform("_lines", lambda x: F.sha2(x, 256)))
    each = ready.select("doc_id", digest(F.col("_lines")).alias("digest"), F.posexplode_outer(units).alias("at", "unit"))
    hits = each.join(sent, F.col("unit") == F.col("known_digest"), "left").where(F.coalesce(F.col("at"), F.lit(0)).eqNullSafe(0) | F.col("license_id").isNotNull())
    hits = materialise(hits.select("doc_id", "digest", F.coalesce("at", F.lit(0)).alias("at"), F.col("license_id").alias("notice")), "hits")
    own = F.struct("doc_id", "digest").alias("own")  # equal ids and digests have equal lines, so they may share their notices
    notices = hits.where("notice IS NOT NULL").groupBy(own).agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    rows = hits.where("at = 0").select("doc_id", "digest", own).join(notices.hint("merge"), "own", "left")
    found = rows.join(sent, F.col("digest") == F.col("known_digest"), "left")
    return found.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
