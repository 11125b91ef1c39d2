"""Known licences by the digest of a normalised text; built-in column functions only."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Mapping, Sequence
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence matching treats as one, applied to lower-case words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment",
    "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog",
    "centre": "center", "customise": "customize", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "merchantibility": "merchantability", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "noncommercial": "non commercial",
    "sublicence": "sublicense", "sublicences": "sublicenses", "http": "https",
}
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
          "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
          "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
              "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
              "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
              "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
              "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Texts and notices of known licences, (name, text).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
            "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
              "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
              "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
              "sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
            "all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n\n" + _ISC_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at\n\n"
                   "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


SHORT = 3000  # texts of fewer characters are found however their lines are wrapped
_COPYRIGHT_LINE = re.compile(r"^[^a-z\n]*(?:copyright|\(c\)|©)[^\n]*(?:\n|$)", re.I | re.M)


def _layouts(text: str) -> list[str]:
    """A text as it stands, with a line per paragraph, and a short one wrapped at every usual width.

    Wrapping matters as ``normalised`` drops any line that starts with "copyright", also one of a licence's own
    sentences. Layouts that leave the same words are one.
    """
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    made = [text, "\n\n".join(paragraphs) + "\n"]
    for width in range(50, 121) if len(text) < SHORT else ():
        for indent in (0, 2, 3, 4):
            # the numbered paragraphs of a licence are indented, the others are not
            made.append("\n\n".join(textwrap.fill(
                p, width, subsequent_indent=" " * indent * p[0].isdigit(), break_long_words=False, break_on_hyphens=False)
                for p in paragraphs if p) + "\n")
    return list({" ".join(_COPYRIGHT_LINE.sub("\n", t).split()): t for t in made}.values())


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of whole licences: the files of ``license_texts`` and the longer texts of ``KNOWN``.

    Each comes with and without its title, with other usual titles, with and without what follows its terms (how to
    apply them, exhibits), and in the layouts of ``_layouts``. Not one is a single line, so none is a notice.
    """
    texts = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(
        (files(__package__) / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]
    texts += [(n, t) for n, t in KNOWN if "\n" in t]
    titles = {"MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("The ISC License",),
              "MIT-0": ("MIT-0",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
              "BSD-3-Clause": ("The 3-Clause BSD License", "New BSD License"), "Unlicense": ("The Unlicense",),
              "BSD-2-Clause": ("The 2-Clause BSD License", "Simplified BSD License")}
    titled = {"Unlicense", "0BSD"}  # these texts start without a title
    made = []
    for name, text in texts:
        text = text.strip("\n").replace("\r\n", "\n") + "\n"
        notice = text.lstrip().startswith("Licensed under")
        bare = text if name in titled or notice else re.split(r"\n\s*\n", text, maxsplit=1)[1]
        heads = [text, bare, *[f"{t}\n\n{bare}" for t in titles.get(name, ())]]
        if name in titles:
            # what stays of "Copyright (c) ... / All rights reserved." in two lines
            heads += [t.replace(bare, "All rights reserved.\n\n" + bare) for t in heads]
        for whole in dict.fromkeys(heads):
            end = re.search(r"END OF TERMS AND CONDITIONS\n|^Exhibit A - |^\s+How to Apply These Terms", whole, re.M)
            cuts = [whole] if end is None or notice else [
                whole, whole[:end.start()] + "\n", whole[:end.end()] + "\n" if "END" in end[0] else whole]
            made += [(name, t) for cut in dict.fromkeys(cuts) for t in _layouts(cut)]
    return tuple(made)


def normalised(text: Column) -> Column:
    """Lower-case words with single spaces between them.

    Copyright lines go, so do punctuation and marks; words of ``SPELLINGS`` get their usual form. Null stays null.
    """
    without = F.regexp_replace(text, r"(?im)^[^\p{L}\n]*(?:copyright|\(c\)|©)[^\n]*(?:\n|$)", "\n")
    plain = F.trim(F.regexp_replace(F.lower(without), r"[^\p{L}\p{N}]+", " "))
    pattern = r"\b(" + "|".join(SPELLINGS) + r")\b"
    usual = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(usual, w), w))
    return F.when(plain.rlike(pattern), F.array_join(words, " ")).otherwise(plain)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(digest, license) of the known texts, one row per digest."""
    table = spark.createDataFrame(list(known), "license string, known string")
    return table.groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license").alias("license"))


def scan(df: DataFrame, text: str = "text", out: str = "license", notices: str = "notices",
         known: tuple[tuple[str, str], ...] | Mapping = KNOWN,
         full: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with the licence whose text a whole document is, and the licences whose notice one of its lines is.

    ``out`` is null where the whole text is no known licence; ``notices`` is a sorted array, empty where no line is one.
    Whole documents are looked up in ``known`` and in ``full``, by default ``full_texts()``; lines in ``known`` alone.
    Their digests, fixed lists in the program, are joined by hash; the documents are not shuffled. Null
    and empty texts, and texts without letters or digits, match nothing. Existing columns of these names are replaced.
    """
    pairs = tuple(known.items()) if isinstance(known, Mapping) else tuple(known)
    lookup = known_digests(df.sparkSession, [*pairs, *(full_texts() if full is None else full)]).where(F.col("digest") != F.sha2(F.lit(""), 256))
    base = df.drop(out, notices).withColumn("_digest", digest(F.col(text)))
    # the list is part of the program, so its size is known before any data is
    joined = base.join(F.broadcast(lookup.withColumnRenamed("digest", "_digest").withColumnRenamed("license", out)),
                       "_digest", "left").drop("_digest")
    # every notice has one of these words, so other lines need no digest
    hint = r"(?i)licen[sc]e|released under|permission"
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda line: line.rlike(hint))
    by_digest = F.create_map(*[F.lit(x) for d, name in _line_digests(df.sparkSession, pairs) for x in (d, name)])
    found = F.transform(lines, lambda line: F.try_element_at(by_digest, digest(line)))
    names = F.array_sort(F.array_distinct(F.filter(found, lambda name: name.isNotNull())))
    return joined.withColumn(notices, F.coalesce(names, F.lit([]).cast("array<string>")))


def _line_digests(spark, pairs) -> list[tuple[str, str]]:
    """(digest, name) of the known texts that are a single line."""
    single = tuple(p for p in pairs if "\n" not in p[1]) or (("none", ""),)
    return [(r["digest"], r["license"]) for r in known_digests(spark, single).collect()]
