"""Licence scan: TF-IDF cosine of notices to templates, and inheritance from directories.

A notice is a line with a licence cue, and so is a whole block with one (a paragraph, the
inside of a comment, adjacent comment lines), each sentence of these, each SPDX
identifier, and the whole text of what may be a licence file. A term's weight is ``1 +
ln(count)``, so that long prose isn't likened to a long licence by its commonest words,
times how few lines with a cue have it (``ln((1 + lines) / (1 + lines with the term)) +
1``). Each distinct notice is compared with one-sentence notices, and with the titles,
headers and whole texts of ``license_texts``. A file's own licence is that of its closest notice,
at a cosine of ``LEAST_COSINE`` or more; ties go to the template listed first. An SPDX
identifier is one term, without ``-only``, ``-or-later`` and ``+``.

Equal notices are one row, known by a 64-bit key, and terms are counted inside the row. A
notice's terms outside the templates' vocabulary weigh at least ``1 + ln(count)``, which
bounds its cosine from above: only notices that may reach ``LEAST_COSINE`` are weighed
in full. The join with the templates' vocabulary is a broadcast bounded by the templates.

A licence file also speaks for its directory: a file without a licence of its own takes
that of the nearest directory above it that has one. Whether a file is one may be told by
its name (``is_license_file``); where that is null its content says so: a notice with a
licence holds ``SPEAKING_SHARE`` of its terms or more. Directories, not files, are joined
with their ancestors. Of several licence files in a directory the closest match counts,
then the smallest path.

Built-in DataFrame functions only. A null or empty text has no notice; very long texts,
of whatever characters, are read whole. A null path is in no directory and inherits
nothing. Repeated rows each get a row. Without any notice all licences are null, and an
empty table stays empty. All other columns are kept, whatever their names; only those
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm import license_texts
from salescast.llm.scratch import stored

# A short notice of each licence, in order of preference on equal cosine.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}
CUE = "(?i)licen[cs]e|copyright|public domain|creative commons"
# What a block, sentence or whole text has that may be a licence's.
WIDE_CUE = f"{CUE}|spdx|permission|redistribution|free software|unencumbered"
COMMENT_LINE = r"[ \t]*(?:#|//|--|;|%|\*|!|/\*|<!--|dnl\b)"
SPDX_LINE = r"(?i)SPDX-License-Identifier:([^\n]*)"
SPDX_TERM = "spdx:"  # no term of a text has a colon
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*+"
LEAST_COSINE = 0.7
SPEAKING_SHARE = 0.5
# Distinct notices with a licence are broadcast up to this many (about 100 bytes each), and salted beyond.
BROADCAST_NOTICES = 200_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _inside_comments(text):
    """The insides of delimited comments."""
    opened = F.split(text, r"/\*|<!--")
    return F.transform(F.slice(opened, 2, F.size(opened)), lambda part: F.split(part, r"\*/|-->")[0])


def _comment_runs(text):
    """Stretches of adjacent comment lines."""
    return F.split(F.regexp_replace(text, rf"(?m)^(?!{COMMENT_LINE}).*$", "\u0001"), "\u0001")


def _paragraphs(text):
    """Stretches between lines without a letter or digit; a comment's ends are such lines too."""
    return F.split(F.regexp_replace(text, r"/\*|\*/|<!--|-->", "\n\n"), r"\n[^\p{L}\p{N}]*\n")


def _sentences(parts):
    return F.flatten(F.transform(parts, lambda part: F.split(part, r"(?<=[.!?;:])\s+")))


def _spdx(text):
    """Each SPDX identifier as a term."""
    lower = F.translate(F.array_join(F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1)), " "), _UPPER, _LOWER)
    names = F.regexp_extract_all(lower, F.lit("[a-z0-9][a-z0-9.+-]*"), F.lit(0))
    return F.transform(names, lambda n: F.concat(F.lit(SPDX_TERM), F.regexp_replace(n, r"(?:-only|-or-later|\+)$", "")))


def notices(files: DataFrame) -> DataFrame:
    """Notices of each file: file_no, key, notice (its terms, joined by a space), is_line, share.

    A row for each line with a cue, and one for each other distinct notice of the file.
    ``share`` is that of the file's terms.
    """
    found = files.where(F.col("text").rlike(WIDE_CUE))
    found = found.select("file_no", "is_license_file", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    blocks = F.concat(_inside_comments(F.col("text")), _comment_runs(F.col("text")), _paragraphs(F.col("text")))
    found = found.withColumns({"lines": F.split("text", "\n"), "blocks": F.filter(blocks, lambda b: b.rlike(WIDE_CUE))})
    joined = lambda part: F.array_join(terms(part), " ")
    found = found.withColumn("whole", joined(F.col("text")))
    whole = F.when(F.coalesce("is_license_file", F.lit(True)), F.array("whole")).otherwise(F.array().cast("array<string>"))
    parts = F.concat("blocks", F.filter(_sentences(F.concat("blocks", "lines")), lambda p: p.rlike(WIDE_CUE)))
    others = F.array_distinct(F.concat(F.transform(parts, joined), _spdx(F.col("text")), whole))
    lines = F.transform(F.filter("lines", lambda line: line.rlike(CUE)), joined)
    row = lambda is_line: lambda notice: F.struct(notice.alias("notice"), F.lit(is_line).alias("is_line"))
    rows = F.concat(F.transform(lines, row(True)), F.transform(F.array_except(others, lines), row(False)))
    length = lambda told: F.size(F.split(told, " "))
    found = found.select("file_no", length("whole").alias("length"), F.explode(rows).alias("row")).where("row.notice != ''")
    share = length("row.notice") / F.col("length")
    return found.select("file_no", F.xxhash64("row.notice").alias("key"), "row.*", share.alias("share"))


def _damped(count):
    return 1 + F.log(count.cast("double"))


def _counted(notice: str):
    """The distinct terms of a notice's sorted terms in ``notice``, each with 1 + ln(count), in one pass."""
    first = F.filter(F.sequence(F.lit(0), F.size(notice) - 1), lambda i: (i == 0) | (F.get(notice, i) != F.get(notice, i - 1)))
    after = F.concat(F.slice(first, F.lit(2), F.size(notice)), F.array(F.size(notice)))
    # What a lambda refers to is evaluated for each element: only the row's array may be.
    return F.zip_with(first, after, lambda at, end: F.struct(F.get(notice, at).alias("term"), _damped(end - at).alias("tf")))


def _templates(templates: Mapping[str, str], texts: Iterable[tuple[str, str]]) -> list[tuple]:
    """(template_order, license, telling, terms as one text) of all templates."""
    told = [*templates.items(), *texts]
    names = dict.fromkeys(name for name, _ in told)
    rows = [(name, True, text) for name, text in told]
    rows += [(name, True, SPDX_TERM + name.lower()) for name in names]
    rows += [(name, False, text) for name, text in license_texts.OPENINGS if name in names]
    return [(order, *row) for order, row in enumerate(rows)]


def _rarity(total: int, df: str = "df"):
    return F.log((1 + F.lit(total)) / (1 + F.coalesce(df, F.lit(0)))) + 1


def notice_licenses(
    found: DataFrame, templates: Mapping[str, str] = TEMPLATES, texts: Iterable[tuple[str, str]] | None = None
) -> DataFrame:
    """The template closest to each distinct notice that has one: key, license, cosine, telling, preferred."""
    texts = license_texts.texts() if texts is None else texts
    times = F.count(F.when(F.col("is_line"), 1)).alias("times")
    distinct = found.groupBy("key").agg(F.first("notice").alias("notice"), times)
    distinct = distinct.select("key", "times", F.sort_array(F.split("notice", " ")).alias("sorted"))
    distinct = stored(distinct.select("key", "times", _counted("sorted").alias("terms")), "license-distinct")
    words = distinct.select("key", "times", F.inline("terms"))
    known = words.where("times > 0").groupBy("term").agg(F.sum("times").alias("df"))
    known = stored(known, "license-terms")
    total = distinct.agg(F.sum("times")).first()[0] or 0  # one row

    listed = _templates(templates, texts)
    by = ["template_order", "license", "telling"]
    table = found.sparkSession.createDataFrame(listed, "template_order int, license string, telling boolean, text string")
    spdx = F.col("text").startswith(SPDX_TERM)
    in_template = F.when(spdx, F.array("text")).otherwise(terms(F.col("text")))
    vocabulary = table.select("template_order", F.explode(in_template).alias("term"))
    vocabulary = vocabulary.groupBy("template_order", "term").agg(_damped(F.count("*")).alias("tf")).join(known, "term", "left")
    vocabulary = stored(vocabulary.withColumn("rarity", _rarity(total)).drop("df"), "license-templates")
    weight = F.col("tf") * F.col("rarity")
    norms = vocabulary.groupBy("template_order").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    units = vocabulary.join(F.broadcast(norms), "template_order")
    # One row for each term of the templates, one column for each template.
    unit = [F.sum(F.when(F.col("template_order") == t[0], weight / F.col("norm"))).alias(f"unit_{t[0]}") for t in listed]
    units = units.groupBy("term").agg(F.first("rarity").alias("rarity"), *unit)

    # Dot products with all templates, and what the terms of the templates add to the norm, in one pass.
    shared = words.join(F.broadcast(units), "term")
    dots = [F.coalesce(F.sum(weight * F.col(f"unit_{t[0]}")), F.lit(0.0)) for t in listed]
    dots = shared.groupBy("key").agg(
        F.sum(weight * weight).alias("known_square"), F.sum(F.col("tf") * F.col("tf")).alias("known_tf"), F.array(*dots).alias("dots")
    )
    all_tf = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["tf"] * t["tf"])
    dots = dots.join(distinct.select("key", all_tf.alias("all_tf"), "terms"), "key")
    least_norm = F.sqrt(F.col("known_square") + F.col("all_tf") - F.col("known_tf"))
    hopeful = dots.where(F.array_max("dots") / least_norm >= LEAST_COSINE - 1e-6)
    hopeful = stored(hopeful.select("key", "dots", "terms"), "license-hopeful")
    weighed = hopeful.select("key", F.inline("terms")).join(known, "term", "left").withColumn("rarity", _rarity(total))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    cosines = hopeful.join(norms, "key").select("key", "norm", F.posexplode("dots").alias("template_order", "dot"))
    cosines = cosines.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= LEAST_COSINE)
    cosines = cosines.join(F.broadcast(table.select(*by)), "template_order")
    best = F.max(F.struct("telling", "cosine", (-F.col("template_order")).alias("preferred"), "license")).alias("best")
    return cosines.groupBy("key").agg(best).select("key", "best.*")


def own_licenses(files: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Closest licence of each file that has a notice: file_no, own_license, own_cosine, share.

    ``share`` is the largest share of the file's terms that a notice with a licence holds.
    """
    found = stored(notices(files), "license-notices")
    chosen = stored(notice_licenses(found, templates), "license-chosen")
    found = found.select("file_no", "key", "share")
    if chosen.count() <= BROADCAST_NOTICES:
        found = found.join(F.broadcast(chosen), "key")
    else:  # a notice may be that of a third of all files
        salt = F.pmod(F.xxhash64("file_no"), F.lit(SALTS)).cast("int")
        spread = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("salt", salt).join(spread, ["key", "salt"])
    best = F.max(F.struct("telling", "cosine", "preferred", "license")).alias("best")
    found = found.groupBy("file_no").agg(best, F.max(F.when(F.col("telling"), F.col("share"))).alias("share"))
    return found.select("file_no", F.col("best.license").alias("own_license"), F.col("best.cosine").alias("own_cosine"), "share")


def directory(path: str):
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited_licenses(files: DataFrame) -> DataFrame:
    """Nearest licence above each directory: directory, inherited_license, license_directory.

    ``files`` has path, directory, is_license_file, own_license and own_cosine.
    """
    speaking = files.where(F.col("is_license_file") & F.col("own_license").isNotNull() & F.col("path").isNotNull())
    first = F.min(F.struct(-F.col("own_cosine"), "path", "own_license")).alias("first")
    granted = speaking.groupBy("directory").agg(first)
    granted = granted.select(F.col("directory").alias("license_directory"), F.col("first.own_license").alias("granted"))
    parts = F.split("directory", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name"))
    )
    directories = files.where("directory IS NOT NULL").select("directory").distinct()
    pairs = directories.select("directory", F.explode(above).alias("above"))
    found = pairs.join(granted, F.col("above.name") == F.col("license_directory"))
    nearest = found.groupBy("directory").agg(F.max(F.struct("above.depth", "license_directory", "granted")).alias("n"))
    return nearest.select(
        "directory",
        F.col("n.granted").alias("inherited_license"),
        F.col("n.license_directory").alias("license_directory"),
    )


RESULTS = ["own_license", "own_cosine", "license", "license_directory"]


def license_scan(files: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``files`` (path, text, and is_license_file if names tell it) without text, with the licence of each.

    Adds own_license, own_cosine, license (own, else inherited) and license_directory
    (where an inherited one comes from).
    """
    kept = [c for c in files.columns if c not in ("text", *RESULTS)]
    named = F.col("is_license_file") if "is_license_file" in files.columns else F.lit(None)
    texts = F.when(F.col("text").rlike(WIDE_CUE), F.col("text"))
    rows = files.select(
        F.monotonically_increasing_id().alias("file_no"),
        F.struct(*kept).alias("file"),
        "path",
        named.cast("boolean").alias("is_license_file"),
        texts.alias("text"),
    )
    rows = stored(rows, "license-files")
    own = stored(own_licenses(rows.where("text IS NOT NULL"), templates), "license-own")
    rows = rows.drop("text").withColumn("directory", directory("path")).join(own, "file_no", "left")
    speaks = F.coalesce("is_license_file", F.col("share") >= SPEAKING_SHARE, F.lit(False))
    rows = stored(rows.withColumn("is_license_file", speaks), "license-rows")
    result = rows.join(inherited_licenses(rows), "directory", "left")
    license_ = F.coalesce("own_license", "inherited_license").alias("license")
    origin = F.when(F.col("own_license").isNull(), F.col("license_directory")).alias("license_directory")
    return result.select("file.*", "own_license", "own_cosine", license_, origin)
