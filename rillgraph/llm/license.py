"""Licence recognition by sentences, in DataFrame functions only.

A text is cut into sentences at line ends and after `.`, `!`, `?` or `;`; a line that goes on in lower case belongs to the
line before. A sentence is normalised to lower-case ASCII letters and digits, anything else one space. Known licence
sentences have identifiers. The short ones must be a whole sentence of the text; those of `LONG` words or more, and the
headings and phrases of `ANYWHERE`, are found wherever their words follow each other, whatever stands between them (line
ends, capitals, comment marks, quotes). Of phrases that overlap, the longest is taken.

A text becomes the sequence of identifiers of its known sentences. Rules are tried from the longest to the shortest; one
matches if its identifiers occur in that order (a place of a rule may name several), and it consumes them, so the sentences
of a longer licence don't show a shorter one too. One projection without a shuffle, so no key can be hot; a text without
any of the `ANCHORS`, of which each known sentence holds one, is not cut at all.

Defined results: null, empty and licence-free texts give 0, '' and ''; repeated sentences count each time; null ids and
repeated rows come back; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and notices, normalised.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "released under the mit license",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "all rights reserved",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    7: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    8: "licensed under the apache license version 2 0 the license",
    9: "you may not use this file except in compliance with the license",
    10: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    11: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    12: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    13: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    14: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    15: "this source code form is subject to the terms of the mozilla public license v 2 0",
    16: "this is free and unencumbered software released into the public domain",
    17: "spdx license identifier mit",
    18: "spdx license identifier apache 2 0",
    19: "spdx license identifier gpl 3 0 only",
    20: "licensed under the mit license",
    21: "this work is licensed under a creative commons attribution 4 0 international license",
    22: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# Licence and the sentence identifiers that show it, in their order.
RULES = [
    ("Apache-2.0", [1]), ("Apache-2.0", [8, 9, 10]), ("Apache-2.0", [18]), ("MIT", [2]), ("MIT", [20]), ("MIT", [6, 7]), ("MIT", [17]),
    ("GPL-3.0", [3]), ("GPL-3.0", [19]), ("CC-BY-NC-4.0", [4]), ("CC-BY-NC-4.0", [22]), ("CC-BY-4.0", [21]), ("BSD-3-Clause", [11, 12, 13]),
    ("BSD-2-Clause", [11, 13]), ("ISC", [14]), ("MPL-2.0", [15]), ("Unlicense", [16]), ("Proprietary", [5]),
]
# Sentences and notices beyond the driver's SQL, which knows those above only.
MORE_SENTENCES = SENTENCES | {
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    24: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    25: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    26: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    27: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    28: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    29: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    30: "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    31: "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    32: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    33: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    34: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    35: "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    36: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    37: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    38: "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    39: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    40: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    41: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    42: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    43: "apache license version 2 0 january 2004",
    44: "gnu general public license version 3 29 june 2007",
    45: "gnu general public license version 2 june 1991",
    46: "gnu lesser general public license version 2 1 february 1999",
    47: "gnu lesser general public license version 3 29 june 2007",
    48: "gnu affero general public license version 3 19 november 2007",
    49: "mozilla public license version 2 0",
    50: "eclipse public license v 2 0",
    51: "creative commons legal code cc0 1 0 universal",
    52: "boost software license version 1 0 august 17th 2003",
    53: "spdx license identifier bsd 3 clause",
    54: "spdx license identifier bsd 2 clause",
    55: "spdx license identifier isc",
    56: "spdx license identifier mpl 2 0",
    57: "spdx license identifier gpl 2 0 only",
    58: "spdx license identifier gpl 2 0 or later",
    59: "spdx license identifier gpl 3 0 or later",
    60: "spdx license identifier lgpl 2 1 or later",
    61: "spdx license identifier lgpl 3 0 or later",
    62: "spdx license identifier agpl 3 0 or later",
    63: "spdx license identifier agpl 3 0 only",
    64: "spdx license identifier epl 2 0",
    65: "spdx license identifier cc0 1 0",
    66: "spdx license identifier zlib",
    67: "spdx license identifier bsl 1 0",
    68: "spdx license identifier unlicense",
    69: "spdx license identifier bsd 3 clause clear",
    70: "spdx license identifier mit 0",
}
# A tuple in a place of a rule names sentences of which any will do there.
MORE_RULES = [
    *RULES, ("GPL-3.0", [(23, 44, 59)]), ("GPL-2.0", [(24, 41, 45, 57, 58)]), ("LGPL-2.1", [(25, 46, 60)]), ("LGPL-3.0", [(26, 42, 47, 61)]),
    ("AGPL-3.0", [(27, 48, 62, 63)]), ("CC-BY-SA-4.0", [28]), ("CC0-1.0", [(29, 51, 65)]), ("BSD-3-Clause", [11, (12, 30), (13, 31)]), ("BSD-3-Clause", [53]),
    ("BSD-2-Clause", [11, (13, 31)]), ("BSD-2-Clause", [54]), ("Zlib", [(32, 66)]), ("BSL-1.0", [(33, 52, 67)]), ("EPL-2.0", [(34, 50, 64)]), ("EPL-1.0", [35]),
    ("CC-BY-NC-SA-4.0", [36]), ("CC-BY-ND-4.0", [37]), ("CC-BY-NC-ND-4.0", [38]), ("0BSD", [39]), ("WTFPL", [40]), ("Apache-2.0", [43]), ("ISC", [55]),
    ("MPL-2.0", [(49, 56)]), ("Unlicense", [68]), ("BSD-3-Clause-Clear", [69]), ("MIT-0", [70]),
]
#: Known sentences of so many words are found over line ends, and so are these.
LONG, ANYWHERE = 9, frozenset([17, 18, 19, *range(43, 71)])
#: Each known sentence holds one of these words.
ANCHORS = ("license", "software", "reserved", "redistribution", "legal", "merchantability", "eclipse")
GOES_ON = r"([^.!?;:\n])\n([a-z])"
ENDS = r"[.!?;]+\s+|\n"
OTHER = r"[^a-z0-9]+"
#: Between sentences, and between words of a found phrase; neither occurs in normalised text.
BAR, TIE = "|", "_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _spread() -> list[str]:
    found = [s for i, s in MORE_SENTENCES.items() if len(s.split()) >= LONG or i in ANYWHERE]
    return sorted(found, key=lambda s: (-len(s), s))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; a phrase found anywhere is one of its own, its words tied by TIE."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), GOES_ON, "$1 $2")
    parts = F.transform(F.split(whole, ENDS), lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " ")))
    gap = f"[ {BAR}]"

    def bound(joined: Column) -> Column:
        plain = F.regexp_replace(joined, f"{gap}+", " ")
        spread = F.array(*map(F.lit, _spread()))
        hits = let(plain, lambda p: F.filter(spread, lambda s: F.contains(p, F.concat(F.lit(" "), s, F.lit(" ")))))
        pattern = lambda s: F.concat(F.lit(gap), F.replace(s, F.lit(" "), F.lit(f"{gap}+")), F.lit(f"(?={gap})"))
        tied = lambda s: F.concat(F.lit(BAR), F.replace(s, F.lit(" "), F.lit(TIE)), F.lit(BAR))
        return F.aggregate(hits, joined, lambda acc, s: F.regexp_replace(acc, pattern(s), tied(s)))

    joined = F.concat(F.lit(BAR), F.array_join(parts, BAR), F.lit(BAR))
    return F.transform(F.split(let(joined, bound), rf"\{BAR}"), lambda s: F.trim(s))


def sentence_ids(text: Column) -> Column:
    spread = set(_spread())
    known = F.create_map(*(F.lit(x) for i, s in MORE_SENTENCES.items() for x in (s.replace(" ", TIE) if s in spread else s, i)))
    ids = F.filter(F.transform(sentences(text), lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    low = F.lower(text)
    held = F.contains(low, F.lit(ANCHORS[0]))
    for word in ANCHORS[1:]:
        held = held | F.contains(low, F.lit(word))
    return F.when(held, ids).otherwise(F.array().cast("array<int>"))


def ordered_rules() -> list[tuple[str, list[str]]]:
    """(licence, a pattern for each place of identifiers that fit there), the longest rules first."""
    each = lambda places: ["|".join(map(str, p if isinstance(p, tuple) else (p,))) for p in places]
    return [(name, each(places)) for name, places in sorted(MORE_RULES, key=lambda r: -len(r[1]))]


def licenses(ids: Column) -> Column:
    """Licences that the identifiers show, each once, in the order of MORE_RULES.

    A rule takes the first identifier that fits its first place, then the first after it that fits the second, and so on, and begins anew behind
    its last; what it takes, later rules don't see. It can begin up to the last place from which all its places still follow, which is found from
    the end; first places behind that are marked apart, so every try that is made succeeds and time goes by the number of identifiers.
    """
    call, lit = F.call_function, F.lit
    rules = F.array(*(
        F.struct(
            lit(name).alias("name"), F.array(*(lit(f"^(.*)<(?:{p})>") for p in reversed(places[1:])), lit(f"^(.*<(?:{places[0]})>)")).alias("ends"), lit(f"<({places[0]})>").alias("first"),
            lit("(.*?)".join(f"<(?:{p})>" for p in places)).alias("pattern"), lit("".join(f"${k}" for k in range(1, len(places)))).alias("rest"),
        ) for name, places in ordered_rules()
    ))
    marks = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    start = F.struct(marks.alias("marks"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        def taken(head: Column) -> Column:
            tail = F.regexp_replace(F.substr(acc["marks"], F.length(head) + 1), rule["first"], F.lit("{$1}"))
            rest = F.regexp_replace(F.regexp_replace(F.concat(head, tail), rule["pattern"], rule["rest"]), r"\{(\d+)\}", "<$1>")
            return F.when(head == "", acc).otherwise(F.struct(rest.alias("marks"), F.array_append(acc["names"], rule["name"]).alias("names")))

        return let(F.aggregate(rule["ends"], acc["marks"], lambda left, end: call("regexp_extract", left, end, lit(1))), taken)

    names = F.aggregate(rules, start, step)["names"]
    order = F.array(*map(F.lit, dict.fromkeys(n for n, _ in MORE_RULES)))
    shown = let(names, lambda found: F.filter(order, lambda n: F.array_contains(found, n)))
    return F.when(F.size(ids) > 0, F.array_join(shown, ",")).otherwise(F.lit(""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined, in order of the rules) for every document."""
    found = let(sentence_ids(F.col("text")), lambda ids: F.struct(F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("ids"), licenses(ids).alias("names")))
    return docs.select("doc_id", found.alias("found")).select("doc_id", F.col("found.n").alias("n_sentences"), F.col("found.ids").alias("sentence_ids"), F.col("found.names").alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for the rows of scan(documents)."""
    values = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    cases = ", ".join("CASE WHEN marks LIKE '%" + "%".join(f"<{i}>" for i in ids) + f"%' THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH known(s, id) AS (VALUES {values}),
names AS (SELECT map(list(s), list(id)) AS m FROM known),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '{GOES_ON.replace(chr(92) + "n", chr(10))}', '\\1 \\2', 'g'), '{ENDS.replace(chr(92) + "n", chr(10)).replace(chr(92) + "s", "[ " + chr(9) + "-" + chr(13) + "]")}') AS parts FROM documents),
seq AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: m[trim(regexp_replace(lower(p), '{OTHER}', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM cut, names),
marked AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i::VARCHAR || '>'), ''), '') AS marks FROM seq)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{cases}], lambda x, i: x IS NOT NULL AND coalesce(list_position([{cases}], x), 0) = i), ','), '') AS licenses
FROM marked"""
