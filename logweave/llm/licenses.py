"""License scans (operator 8): ordered signature rules, with DataFrame functions only.

The rules are written signatures: sentences of notices, titles and addresses, passages of license bodies, SPDX identifiers
(any operand of a tag's expression), and license names with their forms of notice and versions. A cheap gate on the raw text picks the documents that can hold any; a keyword picks the rules that can match in them; each match is an
interval of the normalised words. Within a document an interval is suppressed by one that contains it and whose rule has
at least its priority, so "licensed under the apache license version 2 0" leaves one detection and not four.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned one by one; other columns are
ignored; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import settled, table

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: A word once A-Z are lower-cased, and the same before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: keyword, regex of the name in normalised words, label.
FAMILIES = [
    ("gnu", "gnu general public licen[sc]e", "gpl"),
    ("gnu", "gnu (?:lesser|library) general public licen[sc]e", "lgpl"),
    ("gnu", "gnu affero general public licen[sc]e", "agpl"),
    ("gnu", "gnu free documentation licen[sc]e", "gfdl"),
    ("apache", "apache (?:software )?licen[sc]e", "apache"),
    ("mit", "mit licen[sc]e", "mit"),
    ("expat", "expat licen[sc]e", "mit"),
    ("bsd", "(?:2 clause |3 clause |4 clause |simplified |new |modified )?bsd licen[sc]e", "bsd"),
    ("mozilla", "mozilla public licen[sc]e", "mpl"),
    ("eclipse", "eclipse public licen[sc]e", "epl"),
    ("common", "common development and distribution licen[sc]e", "cddl"),
    ("common", "common public licen[sc]e", "cpl"),
    ("european", "european union public licen[sc]e", "eupl"),
    ("microsoft", "microsoft public licen[sc]e", "ms-pl"),
    ("microsoft", "microsoft reciprocal licen[sc]e", "ms-rl"),
    ("boost", "boost software licen[sc]e", "bsl"),
    ("isc", "isc licen[sc]e", "isc"),
    ("zlib", "zlib (?:libpng )?licen[sc]e", "zlib"),
    ("artistic", "(?:perl )?artistic licen[sc]e", "artistic"),
    ("python", "python (?:software foundation )?licen[sc]e", "psf"),
    ("academic", "academic free licen[sc]e", "afl"),
    ("open", "open software licen[sc]e", "osl"),
    ("open", "(?:sil )?open font licen[sc]e", "ofl"),
    ("open", "open database licen[sc]e", "odbl"),
    ("php", "php licen[sc]e", "php"),
    ("ruby", "ruby licen[sc]e", "ruby"),
    ("postgresql", "postgresql licen[sc]e", "postgresql"),
    ("vim", "vim licen[sc]e", "vim"),
    ("w3c", "w3c (?:software )?licen[sc]e", "w3c"),
    ("openssl", "openssl licen[sc]e", "openssl"),
    ("cc", "cc by", "cc-by"),
    ("cc", "cc by sa", "cc-by-sa"),
    ("cc", "cc by nc", "cc-by-nc"),
    ("cc", "cc by nd", "cc-by-nd"),
    ("cc", "cc by nc sa", "cc-by-nc-sa"),
    ("cc", "cc by nc nd", "cc-by-nc-nd"),
    ("creative", "creative commons attribution", "cc-by"),
    ("creative", "creative commons attribution share ?alike", "cc-by-sa"),
    ("creative", "creative commons attribution non ?commercial", "cc-by-nc"),
    ("creative", "creative commons zero", "cc0"),
    ("cc0", "cc0", "cc0"),
    ("public", "public domain", "public-domain"),
    ("gpl", "gpl", "gpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("agpl", "agpl", "agpl"),
]
#: What stands before a name (empty: nothing), the rule's priority and its confidence.
FORMS = [("", 1, 0.5), ("(?:licen[sc]ed|released|distributed|available|published) under (?:an? |the )?(?:terms of (?:an? |the )?)?", 2, 0.9)]
#: What stands after it, whether the version goes to the label.
VERSIONS = [("", False), (" (?:version |v )?[0-9]+(?: [0-9]+)?(?= )", True)]
#: SPDX identifiers in normalised words, label, whether the identifier has a version.
SPDX = [
    ("mit", "mit", False), ("apache", "apache", True), ("0bsd", "bsd", False), ("bsd [1-4] clause", "bsd", False), ("isc", "isc", False), ("zlib", "zlib", False),
    ("gpl", "gpl", True), ("lgpl", "lgpl", True), ("agpl", "agpl", True), ("gfdl", "gfdl", True), ("mpl", "mpl", True), ("epl", "epl", True),
    ("cddl", "cddl", True), ("cpl", "cpl", True), ("eupl", "eupl", True), ("ms pl", "ms-pl", False), ("ms rl", "ms-rl", False), ("bsl", "bsl", True),
    ("artistic", "artistic", True), ("(?:python|psf)", "psf", True), ("afl", "afl", True), ("osl", "osl", True), ("ofl", "ofl", True), ("odbl", "odbl", True),
    ("php", "php", True), ("ruby", "ruby", False), ("postgresql", "postgresql", False), ("vim", "vim", False), ("w3c", "w3c", False), ("openssl", "openssl", False),
    ("unlicense", "unlicense", False), ("cc0", "cc0", True), ("cc by", "cc-by", True), ("cc by sa", "cc-by-sa", True), ("cc by nc", "cc-by-nc", True),
    ("cc by nd", "cc-by-nd", True), ("cc by nc sa", "cc-by-nc-sa", True), ("cc by nc nd", "cc-by-nc-nd", True),
]
SPDX_VERSION = " [0-9](?: [0-9]{1,2})?"


def _up_to(n: int, piece: str) -> str:
    """At most n pieces, as Java's look-behind takes them."""
    return f"(?:{piece}{_up_to(n - 1, piece)})?" if n else ""


#: An operand before the one looked for, with its AND or OR.
OPERAND = f"(?:{'|'.join(n for n, _, _ in reversed(SPDX))})(?:{SPDX_VERSION})?(?: only| or later)?(?: with {_up_to(4, '[^ ]{1,20} ')}exception(?:{SPDX_VERSION})?)? (?:and|or) "
#: keyword, passage in normalised words, label, whether it ends with a version.
FREE = "is free software you can redistribute it and or modify it under the terms of the gnu "
BODIES = [
    ("hereby", "permission is hereby granted free of charge to any person obtaining a copy", "mit", False),
    ("hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy", "bsl", False),
    ("hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that", "isc", False),
    ("hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software", "bsd", False),
    ("hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", False),
    ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", False),
    ("plainly", "altered source versions must be plainly marked as such", "zlib", False),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", False),
    ("deed", "associated a work with this deed has dedicated the work to the public domain", "cc0", False),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one", "mpl", False),
    ("applicable", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "apache", False),
]
for _kind, _label in (("", "gpl"), ("(?:lesser|library) ", "lgpl"), ("affero ", "agpl")):
    BODIES.append(("gnu", f"{FREE}{_kind}general public licen[sc]e", _label, False))
    BODIES.append(("gnu", f"{FREE}{_kind}general public licen[sc]e as published by the free software foundation either version [0-9](?: [0-9])?", _label, True))
#: Sentences of notices, titles and addresses: keyword, regex in normalised words, label.
SIGNATURES = [
    ("apache", "apache org licen[sc]es licen[sc]e 2 0", "apache-2.0"),
    ("apache", "apache org licen[sc]es licen[sc]e 1 1", "apache-1.1"),
    ("apache", "opensource org licen[sc]es apache 2 0", "apache-2.0"),
    ("apache", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "apache"),
    ("apache", "the asf licen[sc]es this file to you under the apache licen[sc]e version 2 0", "apache-2.0"),
    ("apache", "apache licen[sc]e version 2 0 january 2004", "apache-2.0"),
    ("apache", "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http www apache org", "apache"),
    ("asl", "asl 2 0 licen[sc]ed", "apache-2.0"),
    ("specific", "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", "apache"),
    ("grant", "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants", "apache"),
    ("mit", "opensource org licen[sc]es mit(?: licen[sc]e)?(?: php| html)?", "mit"),
    ("mit", "the mit licen[sc]e mit", "mit"),
    ("mit", "mit licen[sc]e copyright c (?:19|20)[0-9]{2}", "mit"),
    ("mit", "(?:use of this source code is governed by|subject to the terms of) (?:an |the )?mit licen[sc]e", "mit"),
    ("mit", "dual licen[sc]ed (?:under )?mit (?:and|or) ", "mit"),
    ("mit", "choosealicense com licenses mit", "mit"),
    ("x11", "x11 licen[sc]e", "mit"),
    ("sell", "rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software", "mit"),
    ("noninfringement", "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim .{0,80}licen[sc]e", "mit"),
    ("bsd", "opensource org licen[sc]es bsd [23] clause", "bsd"),
    ("bsd", "opensource org licen[sc]es bsd licen[sc]e(?: php)?", "bsd"),
    ("bsd", "(?:use of this source code is|is) governed by a bsd style licen[sc]e", "bsd"),
    ("bsd", "bsd style licen[sc]e that can be found in the licen[sc]e file", "bsd"),
    ("freebsd", "the freebsd (?:copyright|documentation) licen[sc]e", "bsd"),
    ("redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer .{0,400}licen[sc]e", "bsd"),
    ("endorse", "may be used to endorse or promote products derived from this software without specific prior written permission .{0,400}licen[sc]e", "bsd"),
    ("gnu", "gnu org licen[sc]es gpl 3 0(?: en)?(?: html| txt)?", "gpl-3.0"),
    ("gnu", "gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0(?: en)?(?: html| txt)?", "gpl-2.0"),
    ("gnu", "gnu org licen[sc]es gpl(?: html| txt)?", "gpl"),
    ("gnu", "gnu org copyleft gpl(?: html)?", "gpl"),
    ("gnu", "gnu org licen[sc]es lgpl 3 0(?: en)?(?: html| txt)?", "lgpl-3.0"),
    ("gnu", "gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1(?: en)?(?: html| txt)?", "lgpl-2.1"),
    ("gnu", "gnu org licen[sc]es lgpl(?: html| txt)?", "lgpl"),
    ("gnu", "gnu org copyleft lesser(?: html)? licen[sc]e", "lgpl"),
    ("gnu", "gnu org licen[sc]es agpl 3 0(?: en)?(?: html| txt)?", "agpl-3.0"),
    ("gnu", "gnu org licen[sc]es agpl(?: html| txt)?", "agpl"),
    ("gnu", "gnu org licen[sc]es fdl(?: 1 [123])?(?: html| txt)?", "gfdl"),
    ("gnu", "gnu general public licen[sc]e version 3 29 june 2007", "gpl-3.0"),
    ("gnu", "gnu general public licen[sc]e version 2 june 1991", "gpl-2.0"),
    ("gnu", "gnu lesser general public licen[sc]e version 3 29 june 2007", "lgpl-3.0"),
    ("gnu", "gnu lesser general public licen[sc]e version 2 1 february 1999", "lgpl-2.1"),
    ("gnu", "gnu library general public licen[sc]e version 2 june 1991", "lgpl-2.0"),
    ("gnu", "gnu affero general public licen[sc]e version 3 19 november 2007", "agpl-3.0"),
    ("gnu", "you should have received a copy of the gnu general public licen[sc]e", "gpl"),
    ("gnu", "you should have received a copy of the gnu lesser general public licen[sc]e", "lgpl"),
    ("gnu", "you should have received a copy of the gnu library general public licen[sc]e", "lgpl"),
    ("gnu", "you should have received a copy of the gnu affero general public licen[sc]e", "agpl"),
    ("gnu", "see the gnu general public licen[sc]e for more details", "gpl"),
    ("gnu", "see the gnu lesser general public licen[sc]e for more details", "lgpl"),
    ("gnu", "see the gnu affero general public licen[sc]e for more details", "agpl"),
    ("gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "gfdl"),
    ("gnu", "may be distributed under the terms of the gnu general public licen[sc]e", "gpl"),
    ("gnu", "as a special exception .{0,300}gnu general public licen[sc]e", "gpl"),
    ("gplv2", "gplv2(?: or later| only)?", "gpl-2.0"),
    ("gplv3", "gplv3(?: or later| only)?", "gpl-3.0"),
    ("lgplv2", "lgplv2(?: 1)?(?: or later| only)?", "lgpl-2.1"),
    ("lgplv3", "lgplv3(?: or later| only)?", "lgpl-3.0"),
    ("agplv3", "agplv3(?: or later| only)?", "agpl-3.0"),
    ("gpl2", "gpl2", "gpl-2.0"),
    ("gpl3", "gpl3", "gpl-3.0"),
    ("module", "module licen[sc]e gpl(?: v2)?", "gpl"),
    ("dual", "dual bsd gpl", "bsd"),
    ("dual", "dual mit gpl", "mit"),
    ("mozilla", "mozilla org mpl 2 0", "mpl-2.0"),
    ("mozilla", "mozilla org (?:en us )?mpl", "mpl"),
    ("mozilla", "subject to the terms of the mozilla public licen[sc]e v 2 0", "mpl-2.0"),
    ("mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mpl-1.1"),
    ("mozilla", "mozilla public licen[sc]e version 2 0 1 definitions", "mpl-2.0"),
    ("incompatible", "this source code form is incompatible with secondary licen[sc]es", "mpl"),
    ("eclipse", "eclipse org legal epl v10(?: html)? .{0,40}public", "epl-1.0"),
    ("eclipse", "eclipse org legal epl 2 0 .{0,40}public", "epl-2.0"),
    ("eclipse", "made available under the terms of the eclipse public licen[sc]e", "epl"),
    ("common", "common development and distribution licen[sc]e version 1 0", "cddl-1.0"),
    ("cddl", "cddl(?: version)? 1 [01] licen[sc]e", "cddl"),
    ("opensource", "opensource org licen[sc]es cddl 1 0", "cddl-1.0"),
    ("eupl", "licen[sc]ed under the eupl", "eupl"),
    ("eupl", "eupl (?:v(?:ersion)? ?)?1 [012] licen[sc]e", "eupl"),
    ("ec", "joinup ec europa eu .{0,60}licen[sc]e eupl", "eupl"),
    ("boost", "boost org licen[sc]e 1 0(?: txt)?", "bsl-1.0"),
    ("boost", "distributed under the boost software licen[sc]e version 1 0", "bsl-1.0"),
    ("isc", "opensource org licen[sc]es isc(?: licen[sc]e)?(?: txt)?", "isc"),
    ("isc", "the isc licen[sc]e copyright", "isc"),
    ("zlib", "zlib net zlib licen[sc]e(?: html)?", "zlib"),
    ("zlib", "opensource org licen[sc]es zlib(?: licen[sc]e)?(?: php)?", "zlib"),
    ("misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software .{0,300}plainly", "zlib"),
    ("artistic", "opensource org licen[sc]es artistic licen[sc]e 2 0(?: php)?", "artistic-2.0"),
    ("perl", "under the same terms as perl itself .{0,80}licen[sc]e", "artistic"),
    ("python", "python software foundation licen[sc]e version 2", "psf-2"),
    ("psf", "psf licen[sc]e agreement for python", "psf"),
    ("academic", "licen[sc]ed under the academic free licen[sc]e version [123] [01]", "afl"),
    ("open", "licen[sc]ed under the open software licen[sc]e version 3 0", "osl-3.0"),
    ("scripts", "scripts sil org ofl .{0,60}licen[sc]e", "ofl"),
    ("sil", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", "ofl-1.1"),
    ("sil", "sil open font licen[sc]e version 1 1 26 february 2007", "ofl-1.1"),
    ("opendatacommons", "opendatacommons org licen[sc]es odbl(?: 1 0)?", "odbl"),
    ("opendatacommons", "opendatacommons org licen[sc]es pddl(?: 1 0)?", "pddl"),
    ("opendatacommons", "opendatacommons org licen[sc]es by(?: 1 0)?", "odc-by"),
    ("php", "php net licen[sc]e 3 0[01]?(?: txt)?", "php-3"),
    ("php", "this source file is subject to version [23] [0-9]{1,2} of the php licen[sc]e", "php"),
    ("postgresql", "postgresql database management system .{0,80}licen[sc]e", "postgresql"),
    ("w3", "w3 org consortium legal .{0,60}licen[sc]e", "w3c"),
    ("w3c", "w3c software notice and licen[sc]e", "w3c"),
    ("openssl", "this product includes software developed by the openssl project .{0,200}licen[sc]e", "openssl"),
    ("unlicense", "unlicense org", "unlicense"),
    ("unlicense", "the unlicense", "unlicense"),
    ("dedicate", "the author or authors of this software dedicate any and all copyright (?:interest )?to this software to the public domain", "public-domain"),
    ("publicdomain", "creativecommons org publicdomain zero 1 0(?: legalcode)?", "cc0-1.0"),
    ("publicdomain", "creativecommons org publicdomain mark 1 0", "public-domain"),
    ("waived", "has waived all copyright and related or neighboring rights .{0,120}public", "cc0"),
    ("creativecommons", "creativecommons org licen[sc]es by [1-4] [05]", "cc-by"),
    ("creativecommons", "creativecommons org licen[sc]es by sa [1-4] [05]", "cc-by-sa"),
    ("creativecommons", "creativecommons org licen[sc]es by nc [1-4] [05]", "cc-by-nc"),
    ("creativecommons", "creativecommons org licen[sc]es by nd [1-4] [05]", "cc-by-nd"),
    ("creativecommons", "creativecommons org licen[sc]es by nc sa [1-4] [05]", "cc-by-nc-sa"),
    ("creativecommons", "creativecommons org licen[sc]es by nc nd [1-4] [05]", "cc-by-nc-nd"),
    ("creative", "creative commons attribution 4 0 international", "cc-by-4.0"),
    ("creative", "creative commons attribution 3 0 unported", "cc-by-3.0"),
    ("creative", "creative commons attribution share ?alike 4 0 international", "cc-by-sa-4.0"),
    ("creative", "creative commons attribution share ?alike 3 0 unported", "cc-by-sa-3.0"),
    ("creative", "creative commons attribution non ?commercial 4 0 international", "cc-by-nc-4.0"),
    ("creative", "creative commons attribution no ?deriv(?:ative)?s", "cc-by-nd"),
    ("creative", "creative commons attribution non ?commercial share ?alike", "cc-by-nc-sa"),
    ("creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc-by-nc-nd"),
    ("fuck", "do what the fuck you want to public licen[sc]e", "wtfpl"),
    ("beer", "the beer ?ware licen[sc]e", "beerware"),
    ("beerware", "beerware licen[sc]e", "beerware"),
    ("microsoft", "microsoft public licen[sc]e ms pl", "ms-pl"),
    ("microsoft", "microsoft software licen[sc]e terms", "proprietary"),
    ("elastic", "elastic licen[sc]e 2 0", "elastic-2.0"),
    ("elastic", "licen[sc]ed under the elastic licen[sc]e", "elastic"),
    ("server", "server side public licen[sc]e(?: version 1)?", "sspl"),
    ("business", "business source licen[sc]e 1 1", "busl-1.1"),
    ("commons", "commons clause licen[sc]e condition v(?:ersion)? ?1 0", "commons-clause"),
    ("university", "university of illinois ncsa open source licen[sc]e", "ncsa"),
    ("universal", "universal permissive licen[sc]e (?:v |version )?1 0", "upl-1.0"),
    ("blue", "blue oak model licen[sc]e 1 0 0", "blueoak-1.0.0"),
    ("cecill", "cecill(?: [bc])? (?:free software )?licen[sc]e", "cecill"),
    ("ibm", "ibm public licen[sc]e version 1 0", "ipl-1.0"),
    ("sun", "sun public licen[sc]e version 1 0", "spl-1.0"),
    ("netscape", "netscape public licen[sc]e", "npl"),
    ("q", "q public licen[sc]e version 1 0", "qpl-1.0"),
    ("latex", "latex project public licen[sc]e", "lppl"),
    ("reserved", "all rights reserved (?:this (?:file|software|material) is )?(?:not (?:to be )?licen[sc]ed|proprietary and confidential) .{0,80}licen[sc]e", "proprietary"),
]
#: Raw lower-case pieces of which every rule needs one.
GATES = ["licen", "gpl", "creative", "public", "spdx", "cc0", "hereby", "redistribution", "plainly", "mpl"]
CC_BY = rf"(?i)(?<!{RAW_WORD[:-1]})cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by(?!{RAW_WORD[:-1]})"


def rules() -> list[tuple[int, str, str, str, bool, int, float]]:
    """id, keyword, regex, label, whether it ends with a version, priority, confidence: for each family, form and version, each
    SPDX identifier with and without version, each passage of a body, and each signature. An identifier is looked up behind its own end, so
    only where one stands."""
    out = []
    for keyword, name, label in FAMILIES:
        for before, priority, sure in FORMS:
            for after, versioned in VERSIONS:
                out.append((len(out), keyword, f"(?<= ){before}{name}{after}(?= )", label, versioned, priority, min(1.0, sure + 0.1 * versioned)))
    for name, label, has_version in SPDX:
        for version in ("", SPDX_VERSION)[: 1 + has_version]:
            behind = f"(?<= spdx licen[sc]e identifier {_up_to(3, OPERAND)}{name}{version})"
            out.append((len(out), "spdx", f"(?<= ){name}{version}(?= ){behind}", label, bool(version), 3, 1.0))
    for keyword, passage, label, versioned in BODIES:
        out.append((len(out), keyword, f"(?<= ){passage}(?= )", label, versioned, 2, 0.9))
    for keyword, sentence, label in SIGNATURES:
        out.append((len(out), keyword, f"(?<= ){sentence}(?= )", label, False, 2, 0.95))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    lower = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    gate = F.col("text").rlike(CC_BY)
    for piece in reversed(GATES):
        gate = F.col("low").contains(piece) | gate
    plain = F.translate("text", UPPER, LOWER)
    words = F.when(gate, F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)))
    counted = lower.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), words.alias("words"))
    rows = settled(counted.withColumn("uid", F.monotonically_increasing_id()), "licenses")  # fixed once it is written
    some = rows.filter("size(words) > 0")

    def places(phrase: str) -> F.Column:
        want = phrase.split()
        at = lambda i: [F.get("words", (i + k).cast("int")) == w for k, w in enumerate(want)]

        def all_of(i):
            first, *rest = at(i)
            for x in rest:
                first = first & x
            return first

        return F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1), all_of)

    base = some.select("uid", *[places(p).alias(f"p{i}") for i, p in enumerate(BASE)])
    found = F.flatten(F.array(*[f"p{i}" for i in range(len(BASE))]))
    names = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(v)) for i, v in enumerate(BASE.values())]), lambda x: x.isNotNull())
    base = base.select("uid", F.size(found).cast("long").alias("n_base"), F.array_min(found).alias("first_word"), F.array_max(found).alias("last_word"), F.array_sort(F.array_distinct(names)).alias("base"))

    table_of = spark.createDataFrame(rules(), "rule int, keyword string, regex string, label string, versioned boolean, priority int, sure double")
    keywords = sorted({r[1] for r in rules()})
    norm = some.select("uid", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("norm"))
    keyed = norm.withColumn("keyword", F.explode(F.filter(F.array(*[F.when(F.col("norm").contains(f" {k} "), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())))
    tried = keyed.join(F.broadcast(table_of), "keyword").filter(F.expr("norm rlike regex"))  # a fixed table of some hundred rules
    pieces = tried.withColumn("m", F.expr("regexp_extract_all(norm, regex, 0)")).withColumn("p", F.expr("split(norm, regex, -1)"))
    each = pieces.select("uid", "rule", "label", "versioned", "priority", "sure", F.posexplode(F.arrays_zip("m", "p")).alias("i", "z")).filter("z.m is not null")
    so_far = Window.partitionBy("uid", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("z.m") + F.length("z.p")).over(so_far), F.lit(0)) + F.length("z.p")
    version = F.regexp_extract("z.m", r"([0-9]+(?: [0-9]+)?)$", 1)
    label = F.when(F.col("versioned"), F.concat_ws("-", "label", F.translate(version, " ", "."))).otherwise(F.col("label"))
    spans = each.select("uid", "rule", label.alias("label"), "priority", "sure", start.alias("start"), (start + F.length("z.m")).alias("end"))
    earlier = Window.partitionBy("uid").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r[5] for r in rules()}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(earlier)
        inside = inside | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    left = spans.withColumn("inside", inside).filter("not inside").groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("sure").alias("sure"))

    none = F.array().cast("array<string>")
    out = rows.select("uid", "doc_id", "n_words").join(base, "uid", "left").join(left, "uid", "left")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", none), F.coalesce("more", none))))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.array_join(F.coalesce("base", none), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
