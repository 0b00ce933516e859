"""Licence scan by sentence rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full names as notices write them, by identifier.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "MIT": ("mit license", "mit licence", "terms of the mit license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license version 3.0", "gnu gpl version 3", "gpl 3.0 license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license version 2.0", "gnu gpl version 2", "gpl 2.0 license"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1",),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license version 3.0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license version 3.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal license"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",),
    "CC-BY-ND-4.0": ("cc by nd 4.0",),
}
#: What notices put before a name.
LEADS = (
    "licensed under", "licensed under the", "released under", "released under the", "this work is licensed under",
    "this work is licensed under the", "this work is licensed under a", "this project is licensed under the",
    "this software is licensed under the", "this file is licensed under the", "distributed under the",
    "available under the", "this program is distributed under the", "published under",
)

#: Sentences of full licence texts and headers, by the identifier of the sentence.
SENTENCES = {
    "apacheGrant": "licensed under the apache license version 2.0 the license",
    "apacheComply": "you may not use this file except in compliance with the license",
    "mitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the rights to"
    " use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the"
    " software is furnished to do so subject to the following conditions",
    "mitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met",
    "bsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution",
    "bsdNames": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission",
    "iscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted provided that the above copyright notice and this permission notice appear in all copies",
    "gplFree": "this program is free software",
    "gplModify3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
    " free software foundation either version 3 of the license or at your option any later version",
    "gplModify2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
    " free software foundation either version 2 of the license or at your option any later version",
    "mplForm": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "publicDomain": "this is free and unencumbered software released into the public domain",
}

#: Ordered rules over sentence identifiers: an earlier rule takes its sentences away from the later ones.
RULES = (
    (("apacheGrant", "apacheComply"), "Apache-2.0"),
    (("apacheGrant",), "Apache-2.0"),
    (("mitGrant", "mitNotice", "mitAsIs"), "MIT"),
    (("mitGrant", "mitNotice"), "MIT"),
    (("mitGrant",), "MIT-style"),
    (("bsdGrant", "bsdSource", "bsdBinary", "bsdNames"), "BSD-3-Clause"),
    (("bsdGrant", "bsdSource", "bsdBinary"), "BSD-2-Clause"),
    (("bsdGrant",), "BSD-style"),
    (("iscGrant",), "ISC"),
    (("gplFree", "gplModify3"), "GPL-3.0-or-later"),
    (("gplFree", "gplModify2"), "GPL-2.0-or-later"),
    (("gplModify3",), "GPL-3.0-or-later"),
    (("gplModify2",), "GPL-2.0-or-later"),
    (("mplForm",), "MPL-2.0"),
    (("publicDomain",), "Unlicense"),
    *(((f"named:{name}",), name) for name in NAMES),
)

#: Every known sentence holds one of these; texts without them have none.
CUE = "licen[cs]e|licensed|redistribut|permission|free software|public domain|warranty|apache|mozilla|published under|released under|distributed under|available under"


def known_sentences() -> dict[str, str]:
    """Normalised sentence → identifier: the fixed sentences, notices (a lead and a name), and identifier lines."""
    table = {f"{lead} {name}": f"named:{key}" for key, names in NAMES.items() for name in names for lead in LEADS}
    table |= {f"spdx license identifier {normal_id(key)}": f"named:{key}" for key in NAMES}
    return table | {sentence: key for key, sentence in SENTENCES.items()}


#: Sentences as the cut by paragraphs gives them, besides those that the SQL knows.
CUT_SENTENCES = {
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mplForm",
}
#: What a blank line may hold in a comment.
_MARKS = r"[\s*#/;-]*"
#: Lines that end a sentence without a stop: titles and copyright lines, also behind the marks of a comment.
_ALONE = (
    r"(?m)^[ \t*#/;-]*+(?:(?:the )?(?:mit|isc|x11|expat|(?:new |simplified )?bsd(?: [23][ -]clause)?|[23][ -]clause bsd) licen[cs]e(?: \([a-z0-9 -]+\))?\s*$"
    r"|copyright\s+(?:\(c\)|©|[0-9]{4})[^\n]*$|\(c\) copyright[^\n]*$|©[^\n]*$)"
)


def normal_id(key: str) -> str:
    return key.lower().replace("-", " ")


def _normal(segment: Column) -> Column:
    """Letters, digits and dots before digits, one blank between; what stands between a sentence and its full stop goes."""
    words = F.regexp_replace(segment, "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(words, r"\.( |$)", " "))


def _paragraph_sentences(low: Column) -> Column:
    """Sentences that end at a stop, at a blank line (also of a comment), or at a title or copyright line."""
    whole = F.regexp_replace(low, r"\bv\.\s+(?=[0-9])", "v ")
    return F.split(F.regexp_replace(whole, _ALONE, "\n\n"), rf"[.;:!?]\s|\n{_MARKS}\n")


def _identifiers(segments: Column, more: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences among the segments, in order, between commas: ``,a,b,``."""
    pairs = [F.lit(x) for pair in (known_sentences() | (more or {})).items() for x in pair]
    table = F.create_map(*pairs)
    of = F.filter(F.transform(segments, lambda s: F.try_element_at(table, F.trim(_normal(s)))), lambda x: x.isNotNull())
    return F.concat(F.lit(","), F.concat_ws(",", of), F.lit(","))


def _match(sequence: Column) -> Column:
    """Licences of a sequence: rules in order; a rule that matches takes its sentences out."""
    rules = F.array(*[F.struct(F.lit(f",{','.join(r)},").alias("find"), F.lit(name).alias("name")) for r, name in RULES])
    start = F.struct(F.replace(sequence, F.lit(","), F.lit(",,")).alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        find = F.replace(rule["find"], F.lit(","), F.lit(",,"))
        hit = F.contains(state["left"], find)
        return F.struct(
            F.replace(state["left"], find, F.lit(",,")).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(rules, start, apply, lambda state: state["found"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentences, licences) of every row.

    A text is cut into sentences three times: with line breaks as blanks, for texts that are
    wrapped; the same by paragraphs, for licences under a title or copyright line without
    a stop; and line by line, for notices on a line of their own. Normalised
    sentences are mapped to identifiers; of the first two sequences of identifiers the longer one, and that of the lines, are
    matched against ``RULES`` in order. ``sentences`` is the longer sequence,
    comma-joined, ``licences`` the sorted union, comma-joined. Everything happens inside the row: no shuffle,
    whatever the text's length. Null and empty texts have none; repeated rows and null ids stay; extra columns are ignored.
    """
    # an identifier line is one sentence
    low = F.replace(F.lower("text"), F.lit("identifier: "), F.lit("identifier "))
    wrapped = F.split(F.regexp_replace(low, r"\s+", " "), "[.;:!?] ")
    lines = F.split(low, "[.;:!?] |\n")
    cue = F.regexp_replace(F.lower("text"), r"\s+", " ").rlike(CUE)
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(cue, F.col("text")).alias("text")).select(
        "doc_id", *[
            F.coalesce(ids, F.lit(",,")).alias(name)
            for name, ids in (("w", _identifiers(wrapped)), ("p", _identifiers(_paragraph_sentences(low), CUT_SENTENCES)), ("b", _identifiers(lines)))
        ]
    ).select("doc_id", F.when(F.length("p") > F.length("w"), F.col("p")).otherwise(F.col("w")).alias("a"), "b")
    longer = F.when(F.length("a") > F.length("b"), F.col("a")).otherwise(F.col("b"))
    return marked.select(
        "doc_id",
        F.size(F.filter(F.split(longer, ","), lambda x: x != "")).cast("bigint").alias("n_sentences"),
        F.trim(longer, F.lit(",")).alias("sentences"),
        F.array_join(F.array_sort(F.array_union(_match(F.col("a")), _match(F.col("b")))), ",").alias("licences"),
    )


def _sql() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known_sentences().items()) + "}"
    normal = r"trim(trim(regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '\.( |$)', ' ', 'g')))"
    ids = f"',' || coalesce(array_to_string(list_filter(list_transform(%s, lambda s: element_at(k.t, {normal})[1]), lambda x: x IS NOT NULL), ','), '') || ','"

    def steps(name: str) -> str:
        now, parts, found = f"replace({name}, ',', ',,')", [], []
        for i, (rule, licence) in enumerate(RULES):
            find = quote("," + ",".join(rule) + ",").replace(",", ",,")
            parts.append(f"{now} AS {name}{i}, CASE WHEN contains({name}{i}, {find}) THEN {quote(licence)} END AS {name}f{i}")
            now = f"replace({name}{i}, {find}, ',,')"
            found.append(f"{name}f{i}")
        return ", ".join(parts), found

    (a, found_a), (b, found_b) = steps("a"), steps("b")
    return rf"""
WITH known AS (SELECT {table} AS t),
cut AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{CUE}') THEN replace(lower(text), 'identifier: ', 'identifier ') END AS low FROM documents),
ids AS (
  SELECT doc_id,
    coalesce({ids % r"regexp_split_to_array(regexp_replace(low, '\s+', ' ', 'g'), '[.;:!?] ')"}, ',,') AS a,
    coalesce({ids % r"regexp_split_to_array(low, '[.;:!?] |\n')"}, ',,') AS b
  FROM cut, known AS k),
longer AS (SELECT *, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM ids),
steps AS (SELECT *, {a}, {b} FROM longer)
SELECT doc_id,
  CAST(len(list_filter(string_split(l, ','), lambda x: x <> '')) AS BIGINT) AS n_sentences,
  trim(l, ',') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(found_a + found_b)}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM steps
"""


LICENCE_SQL = _sql()
