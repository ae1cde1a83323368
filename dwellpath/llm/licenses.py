"""License scans by sentence rules.

A text without any word of the hints has no licence sentence and is passed over. Others are cut into sentences, which are normalised (lower case, letters, digits and dots
only) and looked up among known licence sentences. Lines are joined before the cut, so a sentence
can be wrapped; one that isn't a full sentence of a standard notice is cut again at its line
breaks, and these parts are looked up among the short sentences. The sequence of known identifiers
of a text is then matched against ordered rules: a licence is found where a rule's identifiers
follow each other in that order, with only unknown sentences in between. A sentence that is none of
these but says that something is licensed (released, distributed ...) under a licence it names has
an identifier for that licence. Lines with an SPDX expression give an identifier for each known
licence in it, after those of the sentences; what stands after WITH is an exception, not a licence.

The SQL knows no full notices and joins no lines; it agrees wherever a text holds no full notice
and no wrapped sentence.

Defined results: a null, empty or licence-free text has no identifiers and no licences; repeated
sentences count each time; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (identifier, normalised sentence), public licence notices.
SENTENCES = (
    ("apache-notice", "licensed under the apache license version 2.0"),
    ("apache-grant", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("gpl3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-notice", "licensed under the gnu general public license version 3"),
    ("gpl2-notice", "licensed under the gnu general public license version 2"),
    ("gpl-redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-version3", "either version 3 of the license or at your option any later version"),
    ("gpl-version2", "either version 2 of the license or at your option any later version"),
    ("cc-by-nc4-notice", "licensed under cc by nc 4.0"),
    ("cc-by4-notice", "licensed under cc by 4.0"),
    ("cc-by-sa4-notice", "licensed under cc by sa 4.0"),
    ("cc0-notice", "dedicated to the public domain under cc0 1.0"),
    ("bsd-redistribute", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("mpl2-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("rights", "all rights reserved"),
)

#: A title and a copyright line that no mark or blank line parts from the sentence after them.
_COPY = r"(?:(?:[a-z0-9.]+ ){0,6}copyright (?:[a-z0-9.]+ ){0,30})?"
#: The number or letter of an item of a list.
_ITEM = r"(?:[0-9a-d] )?"
_GPL = r"(?:[a-z0-9.]+ ){1,16}is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_FSF = r"(?: as published by the free software foundation)?"
_CC = r"(?:[a-z0-9.]+ ){0,16}licensed under (?:a |the )?creative commons attribution"
#: Fixed values: (identifiers, pattern of a whole normalised sentence), the sentences of the standard notices.
NOTICES = (
    (("apache-notice",), _COPY + r"licensed under the apache license version 2\.0 the license"),
    (("apache-grant",), r"you may not use this file except in compliance with the license"),
    (("apache-copy",), r"you may obtain a copy of the license at(?: https? www\.apache\.org licenses license 2\.0)?(?: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied)?"),
    (("mit-grant",), _COPY + r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (("as-is",), r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (("gpl-redistribute", "gpl-version3"), _COPY + _GPL + r" as published by the free software foundation either version 3 of the license or at your option any later version"),
    (("gpl-redistribute", "gpl-version2"), _COPY + _GPL + r" as published by the free software foundation either version 2 of the license or at your option any later version"),
    (("gpl3-notice",), _COPY + _GPL + r" (?:as published by the free software foundation version 3(?: of the license)?|version 3 as published by the free software foundation)"),
    (("gpl2-notice",), _COPY + _GPL + r" (?:as published by the free software foundation version 2(?: of the license)?|version 2 as published by the free software foundation)"),
    (("cc-by-nc4-notice",), _CC + r" non ?commercial 4\.0 international(?: public)? license"),
    (("cc-by4-notice",), _CC + r" 4\.0 international(?: public)? license"),
    (("cc-by-sa4-notice",), _CC + r" share ?alike 4\.0 international(?: public)? license"),
    (("cc0-notice",), r"to the extent possible under law (?:[a-z0-9.]+ ){1,20}waived all copyright and related or neighboring rights to [a-z0-9.]+(?: [a-z0-9.]+){0,20}"),
    (("bsd-redistribute",), _COPY + r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (("bsd-source",), _ITEM + r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (("bsd-binary",), _ITEM + r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (("bsd-endorse",), _ITEM + r"neither the name of (?:[a-z0-9.]+ ){1,16}nor the names of (?:its|his|her|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (("mpl2-notice",), _COPY + r"this source code form is subject to the terms of the mozilla public license v\.? ?2\.0"),
    (("isc-grant",), _COPY + r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (("rights",), r"(?:[a-z0-9.]+ ){0,6}copyright (?:[a-z0-9.]+ ){1,30}all rights reserved"),
    (("lgpl21-notice",), _COPY + _GPL.replace("general", "lesser general") + _FSF + r" either version 2\.1 of the license or at your option any later version"),
    (("lgpl3-notice",), _COPY + _GPL.replace("general", "lesser general") + _FSF + r" either version 3 of the license or at your option any later version"),
    (("agpl3-notice",), _COPY + _GPL.replace("general", "affero general") + _FSF + r" either version 3 of the license or at your option any later version"),
    (("unlicense-notice",), r"(?:the unlicense )?this is free and unencumbered software released into the public domain"),
    (("zlib-grant",), r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    (("epl2-notice",), _COPY + r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v\.? ?)?2\.0(?: which(?: [a-z0-9.]+){1,20})?"),
    (("epl1-notice",), _COPY + r"(?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v\.? ?)?1\.0(?: which(?: [a-z0-9.]+){1,20})?"),
    (("boost-notice",), _COPY + r"distributed under the boost software license version 1\.0"),
    (("boost-grant",), _COPY + r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (?:[a-z0-9.]+ ){20,80}all subject to the following"),
    (("bsd-advertise",), _ITEM + r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (("artistic2-notice",), r"(?:[a-z0-9.]+ ){1,40}under the terms of the artistic license (?:version |v\.? ?)?2\.0"),
)

_V2, _V3 = r"(?: version| v\.?)? ?2(?:\.0)?", r"(?: version| v\.?)? ?3(?:\.0)?"
#: Fixed values: (licence, pattern of its name in a normalised sentence), of which the first that fits counts.
NAMES = (
    ("Apache-2.0", r"apache(?: software)?(?: licen[sc]e)?" + _V2), ("MIT", r"mit"), ("AGPL-3.0", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)" + _V3),
    ("LGPL-2.1", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v\.?)? ?2\.1"), ("LGPL-3.0", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)" + _V3),
    ("GPL-2.0", r"(?:gnu )?(?:gpl|general public licen[sc]e)" + _V2), ("GPL-3.0", r"(?:gnu )?(?:gpl|general public licen[sc]e)" + _V3),
    ("BSD-2-Clause", r"(?:simplified bsd|bsd 2 clause|(?:2|two) clause bsd)"), ("BSD-3-Clause", r"(?:(?:new|modified) bsd|bsd 3 clause|(?:3|three) clause bsd)"), ("BSD-4-Clause", r"(?:original bsd|bsd 4 clause|(?:4|four) clause bsd)"),
    ("MPL-2.0", r"(?:mpl|mozilla public licen[sc]e)" + _V2), ("EPL-2.0", r"(?:epl|eclipse public licen[sc]e)" + _V2), ("EPL-1.0", r"(?:epl|eclipse public licen[sc]e)(?: version| v\.?)? ?1(?:\.0)?"),
    ("ISC", r"isc"), ("Zlib", r"zlib"), ("Unlicense", r"unlicense"), ("BSL-1.0", r"boost software licen[sc]e(?:(?: version| v\.?)? ?1(?:\.0)?)?"), ("Artistic-2.0", r"artistic licen[sc]e" + _V2),
    ("CC0-1.0", r"(?:cc0|creative commons zero)(?: 1\.0)?"), ("CC-BY-NC-4.0", r"cc by nc 4\.0"), ("CC-BY-SA-4.0", r"cc by sa 4\.0"), ("CC-BY-4.0", r"cc by 4\.0"),
)
#: What a sentence says before the name of a licence that it puts something under.
SAID = r"(?:^| )(?:licen[sc]ed|released|distributed|available|published|modify it|used) under (?:the |an? )?(?:(?:terms|conditions|terms and conditions) of )?(?:the |an? )?"
_SPDX = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"

#: Fixed values: (licence, identifiers in order). A text can have several licences.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-keep")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl-redistribute", "gpl-version3")),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL-2.0", ("gpl-redistribute", "gpl-version2")),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("ISC", ("isc-grant",)),
    ("All-Rights-Reserved", ("rights",)),
    ("LGPL-2.1", ("lgpl21-notice",)),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("Unlicense", ("unlicense-notice",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("Artistic-2.0", ("artistic2-notice",)),
    *((name, (f"{how}-{name}",)) for name, _ in NAMES for how in ("says", "spdx")),
)

#: A sentence over joined lines ends at a blank line (one of comment signs is blank), or at a mark of an
#: end with white space or the text's end after it, but not at the point of 'v. 2.0'.
STOP = re.compile(r"(?<!\b[vV])[.!?]+(?=\s|\Z)|[;:]+(?=\s|\Z)|\n[\s*#/;%>|-]*\n", re.ASCII)
#: What a colon or semicolon inside the GPL's notice follows; at most _REACH characters.
INSIDE = re.compile(r"\b(?:free[\s*#/]{1,20}software|software[\s*#/]{1,20}foundation)\Z", re.ASCII | re.IGNORECASE)
_REACH = 40
#: A part of a sentence ends at a line break, or at a mark of an end with white space or the text's end after it.
END = re.compile(r"[.!?;:]+(?=\s|\Z)|\n+", re.ASCII)
#: Sentences without any of these are no licence sentences.
HINTS = ("licen", "permission", "redistribut", "rights reserved", "public domain", "warranty", "as is", "contributors", "advertising materials", "released under", "distributed under")
#: Whole notices can have this one too.
ALSO = "waived"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9.]+", " ", sentence.lower()).strip(" ")


def _sure(pattern: str) -> str:
    """The longest stretch of plain text that every match of a pattern holds: tested before the pattern is."""
    depth, pieces, at = 0, [""], 0
    while at < len(pattern):
        c, step = pattern[at], 1
        if c == "\\":
            c, step = pattern[at + 1], 2
        if c in "()" and step == 1:
            depth += 1 if c == "(" else -1
            pieces.append("")
        elif not depth:
            if at + step < len(pattern) and pattern[at + step] in "?{*":
                pieces.append("")
                step += len(pattern[at + step :].split("}")[0]) + 1 if pattern[at + step] == "{" else 1
            elif step == 1 and c in "?{[":  # after a group
                step = len(pattern[at:].split("}")[0]) + 1 if c == "{" else 1
                pieces.append("")
            else:
                pieces[-1] += c
        at += step
    return max(pieces, key=len)


_SHORT = {sentence: name for name, sentence in SENTENCES}
_WHOLE = tuple((names, _sure(pattern), re.compile(pattern)) for names, pattern in NOTICES)
_SAYS = re.compile(SAID)
_SAYS_NAME = tuple((f"says-{name}", re.compile(f"{SAID}{pattern}(?: |$)")) for name, pattern in NAMES)
_SPDX_LINE, _WITH, _SUFFIX = re.compile(_SPDX), re.compile(r"\bwith\s+\S+", re.ASCII), re.compile(r"(?:-only|-or-later|\+)\Z")
_SPDX_NAMES = {name.lower(): f"spdx-{name}" for name, _ in NAMES}


def sentences(text: str) -> list[str]:
    """A text's sentences over joined lines."""
    out, at = [], 0
    for m in STOP.finditer(text):
        start, end = m.span()
        if text[start] in ";:" and INSIDE.search(text, max(0, start - _REACH), start):
            # of several marks only the first follows the words
            start += 1
            if start == end:
                continue
        out.append(text[at:start])
        at = end
    return [*out, text[at:]]


def hinted(text: str, *more: str) -> bool:
    low = text.lower()
    return any(h in low for h in (*HINTS, *more))


def said(sentence: str) -> list[str]:
    """Identifiers of the licences that a normalised sentence says something is under."""
    return [name for name, pattern in _SAYS_NAME if pattern.search(sentence)] if _SAYS.search(sentence) else []


def spdx(text: str) -> list[str]:
    """Identifiers of the known licences in a text's SPDX expressions, in order."""
    found = (re.split(r"[\s()]+", _WITH.sub("", e.lower()), flags=re.ASCII) for e in _SPDX_LINE.findall(text))
    return [_SPDX_NAMES[w] for words in found for w in (_SUFFIX.sub("", x) for x in words) if w in _SPDX_NAMES]


def of_part(part: str) -> list[str]:
    """The identifier of a short sentence, or what it says."""
    s = normalised(part)
    return [_SHORT[s]] if s in _SHORT else said(s)


def of_sentence(sentence: str) -> list[str]:
    """The identifiers of a sentence over joined lines: a short one, a notice's, or those of its parts, in order."""
    s = normalised(sentence)
    if s in _SHORT:
        return [_SHORT[s]]
    parts = [x for p in END.split(sentence) if hinted(p) for x in of_part(p)]
    for names, sure, pattern in reversed(_WHOLE):
        if sure in s and pattern.fullmatch(s):
            # what a notice's first lines say is kept ahead of it
            return [*(x for x in parts if x not in names and not x.startswith("says-")), *names]
    return parts or said(s)


def identify(text: str) -> list[str]:
    """The identifiers of a text's known sentences, in order, then those of its SPDX lines."""
    if not hinted(text, ALSO):
        return []
    return [x for s in sentences(text) if hinted(s, ALSO) for x in of_sentence(s)] + spdx(text)


def identifiers(text: Column) -> Column:
    """The identifiers of each text; none of a null text."""

    @F.arrow_udf("array<string>")
    def of_texts(texts: pa.Array) -> pa.Array:
        return pa.array([identify(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    return of_texts(text)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids and licenses (comma-joined, licences in name order)."""
    d = documents.select("doc_id", identifiers(F.col("text")).alias("ids")).withColumn("chain", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    by_name: dict[str, list] = {}
    for name, chain in RULES:
        by_name.setdefault(name, []).append(F.col("chain").contains("," + ",".join(chain) + ","))
    hits = []
    for name in sorted(by_name):
        test = by_name[name][0]
        for other in by_name[name][1:]:
            test = test | other
        hits.append(F.when(test, F.lit(name)))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.concat_ws(",", *hits).alias("licenses"))


def oracle() -> str:
    """The scan as DuckDB SQL."""
    known: dict[str, list[str]] = {}
    for name, sentence in SENTENCES:
        known.setdefault(name, []).append(sentence)
    case = " ".join(f"WHEN s IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in reversed(known.items()))
    by_name: dict[str, list[str]] = {}
    for name, chain in RULES:
        by_name.setdefault(name, []).append(f"contains(chain, ',{','.join(chain)},')")
    hits = ", ".join(f"CASE WHEN {' OR '.join(v)} THEN '{k}' END" for k, v in sorted(by_name.items()))
    says = ", ".join(f"CASE WHEN regexp_matches(s, '{SAID}{name}(?: |$)') THEN 'says-{licence}' END" for licence, name in NAMES)
    spdx_names = ", ".join(f"'{name.lower()}': 'spdx-{name}'" for name, _ in NAMES)
    # RE2 has no look-ahead: a marked end and the white space after it are split off together,
    # which only moves white space that normalising trims
    return f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid, regexp_split_to_array(coalesce(text, ''), '[.!?;:]+(\\s|$)|\\n+') AS sentences FROM documents
), normal AS (
  SELECT rid, doc_id, text, list_transform(list_filter(sentences, lambda x: regexp_matches(lower(x), '{'|'.join(HINTS)}')),
    lambda x: trim(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'))) AS sentences FROM parts
), named AS (
  SELECT rid, doc_id, text, flatten(list_transform(sentences, lambda s: CASE WHEN (CASE {case} END) IS NOT NULL THEN [CASE {case} END] WHEN regexp_matches(s, '{SAID}') THEN list_filter([{says}], lambda x: x IS NOT NULL) ELSE [] END)) AS said,
    flatten(list_transform(regexp_extract_all(text, '{_SPDX}', 1), lambda e: string_split_regex(regexp_replace(lower(e), '\\bwith\\s+\\S+', '', 'g'), '[\\s()]+'))) AS words FROM normal
), found AS (
  SELECT doc_id, list_concat(said, list_filter(list_transform(words, lambda w: MAP {{{spdx_names}}}[regexp_replace(w, '(?:-only|-or-later|\\+)$', '')]), lambda x: x IS NOT NULL)) AS ids FROM named
), chained AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS chain FROM found
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, concat_ws(',', {hits}) AS licenses FROM chained
"""
