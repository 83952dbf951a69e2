"""License scans in DataFrame functions alone: ordered signature rules behind a keyword prefilter.

A text is normalised to its words, each between two spaces of its own (" all  rights  reserved "), so that a
phrase is a plain substring and intervals count in words. A rule's regular expression runs only where its
keyword occurs. Detections are intervals with a priority; of overlapping ones the first and longest stays, a
later one replaces it only by a higher priority, and contained ones are suppressed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What separates words: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licences as (label, keyword, name). In names "x?" is optional and "a|b" a choice of words.
FAMILIES = [
    ("agpl", "affero", "gnu? affero general public license|licence"),
    ("lgpl", "lesser", "gnu? lesser general public license|licence"),
    ("lgpl", "library", "gnu library general public license|licence"),
    ("gpl", "general", "gnu? general public license|licence"),
    ("gfdl", "documentation", "gnu? free documentation license|licence"),
    ("apache", "apache", "apache software? license|licence"),
    ("mit", "mit", "mit license|licence"),
    ("mit", "expat", "expat license|licence"),
    ("isc", "isc", "isc license|licence"),
    ("bsd", "bsd", "bsd license|licence"),
    ("bsd-2-clause", "bsd", "2|two clause bsd license|licence"),
    ("bsd-3-clause", "bsd", "3|three clause bsd license|licence"),
    ("mpl", "mozilla", "mozilla public license|licence"),
    ("epl", "eclipse", "eclipse public license|licence"),
    ("eupl", "european", "european union public license|licence"),
    ("cddl", "cddl", "cddl license|licence"),
    ("cddl", "distribution", "common development and distribution license|licence"),
    ("cpl", "common", "common public license|licence"),
    ("boost", "boost", "boost software license|licence"),
    ("zlib", "zlib", "zlib license|licence"),
    ("artistic", "artistic", "artistic license|licence"),
    ("python", "python", "python software foundation license|licence"),
    ("unlicense", "unlicense", "the? unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "font", "sil? open font license|licence"),
    ("odbl", "database", "open database license|licence"),
    ("odc-by", "commons", "open data commons attribution license|licence"),
    ("pddl", "pddl", "pddl"),
    ("cc0", "cc0", "cc0"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "sharealike", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "noderivatives", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-sa", "cc by", "cc by sa"),
    ("cc-by-nc", "cc by", "cc by nc"),
    ("cc-by-nd", "cc by", "cc by nd"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd"),
    ("ms-pl", "microsoft", "microsoft public license|licence"),
    ("postgresql", "postgresql", "postgresql license|licence"),
    ("ecl", "educational", "educational community license|licence"),
    ("upl", "universal", "universal permissive license|licence"),
    ("blueoak", "oak", "blue oak model license|licence"),
]
# What every rule's and every base phrase's text holds one of.
STEMS = ("licen", "cc ", "cc0 ", "gpl", "commons ", "domain ", "wtfpl ", "pddl ", "reserved ", "confidential ", "reproduced ", "reprinted ", "permission ", "redistribut", "noninfringement ", "warrant")
# Sentence frames around a name, with their priority; {name} stands for it.
FRAMES = [
    (60, "{name}"),
    (70, "{name} version? v? 1|2|3|4 0|1? "),
    (80, "licensed|released|distributed|published|available under the? terms? of? the? {name}"),
    (90, "licensed|released|distributed|published|available under the? terms? of? the? {name} version? v? 1|2|3|4 0|1?"),
    (75, "subject to the terms of the? {name}"),
    (95, "spdx license identifier {name}"),
]
# Hand-written rules as (label, keyword, priority, phrase): sentences of licence texts and notices.
SINGLE = [
    ("public-domain", "domain", 60, "in|into the? public domain"),
    ("public-domain", "domain", 70, "dedicated to the public domain"),
    ("public-domain", "dedication", 65, "public domain dedication"),
    ("public-domain", "placed", 72, "placed in|into the public domain"),
    ("public-domain", "released", 72, "released in|into|to the public domain"),
    ("public-domain", "worldwide", 74, "public domain worldwide"),
    ("unlicense", "unencumbered", 90, "free and unencumbered software released into the public domain"),
    ("reserved", "reserved", 50, "all rights reserved"),
    ("reserved", "reserved", 60, "copyright c? 1|2? all rights reserved"),
    ("reserved", "expressly", 66, "all? rights not expressly granted are? reserved"),
    ("reserved", "worldwide", 62, "all rights reserved worldwide"),
    ("cc-some-rights", "some", 60, "some rights reserved"),
    ("cc0", "no", 60, "no rights reserved"),
    ("cc-by", "cc", 55, "cc by"),
    ("cc-by", "cc", 72, "cc by 1|2|3|4 0"),
    ("cc-by", "international", 78, "attribution 4 0 international license|licence"),
    ("cc-by-sa", "sharealike", 82, "attribution sharealike 1|2|3|4 0 international|unported|generic? license|licence"),
    ("cc-by-nc", "noncommercial", 82, "attribution noncommercial 1|2|3|4 0 international|unported|generic? license|licence"),
    ("cc-by-nd", "noderivatives", 82, "attribution noderivatives|noderivs? 4 0 international|unported? license|licence"),
    ("cc-by-sa", "alike", 80, "creative commons attribution share alike"),
    ("cc-by-nc", "commercial", 80, "creative commons attribution non commercial"),
    ("cc-by-nd", "derivatives", 80, "creative commons attribution no derivatives"),
    ("cc", "creative", 58, "creative commons license|licence"),
    ("cc", "creative", 84, "this work is licensed under a creative commons"),
    ("cc-by", "creativecommons", 76, "creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons", 77, "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons", 77, "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", 77, "creativecommons org licenses by nd"),
    ("cc0", "creativecommons", 78, "creativecommons org publicdomain zero"),
    ("cc0", "zero", 70, "creative commons zero"),
    ("cc0", "universal", 76, "cc0 1 0 universal"),
    ("cc-nc-sampling", "sampling", 72, "creative commons sampling plus?"),
    ("proprietary", "confidential", 65, "proprietary and confidential"),
    ("proprietary", "confidential", 65, "confidential and proprietary"),
    ("proprietary", "confidential", 58, "strictly confidential"),
    ("proprietary", "confidential", 62, "confidential information of"),
    ("proprietary", "reproduced", 60, "may not be reproduced"),
    ("proprietary", "part", 76, "no part of this publication|book|document|work|site may be reproduced"),
    ("proprietary", "copied", 70, "may not be copied reproduced"),
    ("proprietary", "permission", 55, "without prior? written permission"),
    ("proprietary", "express", 62, "without the? express written permission"),
    ("proprietary", "publisher", 66, "permission of the publisher"),
    ("proprietary", "holder", 66, "permission of the copyright holder"),
    ("by-permission", "reprinted", 60, "reprinted with|by permission"),
    ("by-permission", "reproduced", 61, "reproduced with|by permission"),
    ("by-permission", "used", 57, "used with|by permission"),
    ("by-permission", "kind", 62, "by|with kind permission"),
    ("permissive-grant", "hereby", 85, "permission is hereby granted free of charge"),
    ("permissive-grant", "redistribution", 85, "redistribution and use in source and binary forms"),
    ("permissive-grant", "granted", 64, "permission is granted to"),
    ("permissive-grant", "document", 74, "permission is granted to copy distribute and or? modify this document"),
    ("permissive-grant", "anyone", 82, "permission is granted to anyone to use this software for any purpose"),
    ("isc", "fee", 92, "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "documentation", 91, "permission to use copy modify and distribute this software and its documentation"),
    ("mit", "noninfringement", 65, "fitness for a particular purpose and noninfringement"),
    ("mit", "sublicense", 88, "use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "substantial", 86, "this permission notice shall be included in all copies or substantial portions"),
    ("mit", "style", 62, "mit style license|licence"),
    ("mit", "massachusetts", 66, "massachusetts institute of technology license|licence"),
    ("mit-0", "attribution", 70, "mit no attribution license|licence"),
    ("bsd", "style", 62, "bsd style license|licence"),
    ("bsd", "retain", 87, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "binary", 87, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 89, "endorse or promote products derived from this software without specific? prior written permission"),
    ("bsd-3-clause", "new", 66, "new bsd license|licence"),
    ("bsd-3-clause", "revised", 66, "revised bsd license|licence"),
    ("bsd-2-clause", "simplified", 66, "simplified bsd license|licence"),
    ("bsd-2-clause", "freebsd", 66, "freebsd license|licence"),
    ("bsd-4-clause", "original", 64, "original bsd license|licence"),
    ("bsd", "zero", 68, "zero clause bsd license|licence"),
    ("apache", "compliance", 88, "you may not use this file except in compliance with the license"),
    ("apache", "unless", 86, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "governing", 86, "see the license for the specific language governing permissions and limitations"),
    ("apache", "org", 74, "apache org licenses license 2 0"),
    ("apache", "irrevocable", 88, "worldwide non exclusive no charge royalty free irrevocable copyright|patent license"),
    ("gpl", "gplv2|gplv3|gpl", 50, "gplv2|gplv3|gpl"),
    ("gpl", "free", 82, "free software you can redistribute it and or modify it"),
    ("gpl", "later", 84, "version 2|3 of the license or at your option any later version"),
    ("gpl", "merchantability", 76, "without even the implied warranty of merchantability or fitness"),
    ("gpl", "received", 90, "you should have received a copy of the gnu general public license"),
    ("gpl", "later", 62, "gpl 2|3 0? or later"),
    ("gpl", "only", 62, "gpl 2|3 0? only"),
    ("gpl", "compatible", 58, "gpl compatible license|licence"),
    ("gpl-exception", "classpath", 70, "gpl v2|2|version? with the? classpath exception"),
    ("gpl-exception", "linking", 66, "gpl linking exception"),
    ("lgpl", "lgpl", 50, "lgpl"),
    ("lgpl", "lgplv3", 52, "lgplv3"),
    ("lgpl", "received", 91, "you should have received a copy of the gnu lesser|library general public license"),
    ("lgpl", "library", 60, "library general public license|licence"),
    ("agpl", "agpl", 50, "agpl"),
    ("agpl", "agplv3", 52, "agplv3"),
    ("agpl", "remote", 78, "remote network interaction use with the gnu general public license"),
    ("dual", "dual", 60, "dual licensed"),
    ("dual", "choice", 58, "at your choice of license|licence"),
    ("mpl", "source", 90, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", 66, "mozilla public license v 2 0"),
    ("epl", "accompanying", 90, "the accompanying materials are made available under the terms of the eclipse public license"),
    ("ofl", "font", 86, "this font software is licensed under the sil open font license"),
    ("wtfpl", "want", 80, "you want to public license"),
    ("beerware", "beerware", 62, "beerware license|licence"),
    ("beerware", "ware", 62, "beer ware license|licence"),
    ("zlib", "express", 70, "provided as is without any express or implied warranty"),
    ("zlib", "libpng", 66, "zlib libpng license|licence"),
    ("libpng", "libpng", 60, "libpng license|licence"),
    ("openssl", "openssl", 60, "openssl license|licence"),
    ("php", "php", 60, "php license|licence"),
    ("ruby", "ruby", 60, "ruby license|licence"),
    ("python", "python", 60, "python license|licence"),
    ("perl", "perl", 64, "same license as perl"),
    ("artistic", "clarified", 66, "clarified artistic license|licence"),
    ("w3c", "w3c", 66, "w3c software notice and license|licence"),
    ("unicode", "unicode", 66, "unicode license agreement"),
    ("afl", "academic", 66, "academic free license|licence"),
    ("osl", "software", 62, "open software license|licence"),
    ("ms-rl", "reciprocal", 66, "microsoft reciprocal license|licence"),
    ("ipl", "ibm", 66, "ibm public license|licence"),
    ("qpl", "q", 62, "q public license|licence"),
    ("apsl", "apple", 66, "apple public source license|licence"),
    ("cecill", "cecill", 62, "cecill b|c? free software license|licence"),
    ("cern-ohl", "hardware", 66, "cern open hardware license|licence"),
    ("ogl", "government", 66, "open government license|licence"),
    ("open-game", "game", 66, "open game license|licence"),
    ("etalab", "etalab", 66, "etalab open license|licence"),
    ("free-art", "art", 64, "free art license|licence"),
    ("sspl", "server", 68, "server side public license|licence"),
    ("busl", "business", 66, "business source license|licence"),
    ("elastic", "elastic", 62, "elastic license|licence"),
    ("parity", "parity", 62, "parity public license|licence"),
    ("polyform", "polyform", 62, "polyform noncommercial|strict|shield? license|licence"),
    ("openrail", "responsible", 66, "responsible ai license|licence|licenses"),
    ("copyleft", "copyleft", 58, "copyleft license|licence"),
    ("open-source", "source", 56, "open source license|licence"),
    ("eula", "end", 68, "end user license|licence agreement"),
    ("eula", "software", 62, "software license|licence agreement"),
    ("eula", "transferable", 66, "non transferable license|licence"),
    ("eula", "exclusive", 60, "non exclusive license|licence"),
    ("eula", "limited", 60, "limited license|licence to use"),
    ("eula", "evaluation", 60, "evaluation license|licence"),
    ("eula", "site", 56, "site license|licence"),
    ("eula", "licensee", 58, "the licensee shall|must|may|agrees"),
    ("eula", "licensor", 60, "licensor grants"),
    ("commercial", "commercial", 58, "commercial license|licence"),
    ("royalty-free", "royalty", 60, "royalty free license|licence"),
    ("no-warranty", "kind", 62, "without warranty of any kind"),
    ("no-warranty", "warranties", 62, "without warranties or conditions of any kind"),
    ("no-warranty", "disclaimed", 74, "implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("no-warranty", "disclaims", 70, "disclaims all warranties with regard to this software"),
]


def pattern(phrase: str) -> str:
    """Regular expression over the normalised text of a phrase with optional words and choices."""
    out = []
    for word in phrase.split():
        optional, word = word.endswith("?"), word.rstrip("?")
        choice = "|".join(f" {w} " for w in word.split("|"))
        out.append(f"(?:{choice})" + "?" * optional if optional or "|" in word else choice)
    return "".join(out)


def _wrapped(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern) of every rule: each licence in each frame, and the single ones.

    Longer names come first in their frame by their higher priority, as they hold shorter ones.
    """
    found = [(label, _wrapped(key), priority + min(len(name.split()), 9), pattern(frame.format(name=name))) for label, key, name in FAMILIES for priority, frame in FRAMES]
    for label, keys, priority, phrase in SINGLE:
        found += [(label, _wrapped(key), priority, pattern(phrase if "|" not in keys else key)) for key in keys.split("|")]
    return found


def _words(x: Column) -> Column:
    return F.shiftright(F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))), 1).cast("bigint")


def normalised(text: Column) -> Column:
    """Each word of a text between two spaces of its own; empty without words."""
    inner = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


#: Detections that are chained by one inner loop; arrays grow by whole chunks, so that long texts cost no squares.
CHUNK = 512
_SPAN = "struct<start:bigint,less_end:bigint,less_priority:int,label:string>"


def _once(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _in_chunks(items: Column, zero: Column, step) -> Column:
    """step(state, chunk) over the items in chunks of CHUNK; no chunk for an empty array."""

    def over(found):
        starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
        return F.when(F.size(found) > 0, F.aggregate(starts, zero, lambda state, c: step(state, F.slice(found, c * CHUNK + 1, CHUNK)))).otherwise(zero)

    return _once(items, over)


def _spans(low: Column) -> Column:
    """All rules' detections as array<struct<start, less_end, less_priority, label>>, in words, sorted."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(priority).alias("priority"), F.lit(rx).alias("rx")) for label, key, priority, rx in rules()])

    def places(r):
        between, hits = F.split(low, r["rx"]), F.regexp_extract_all(low, r["rx"], F.lit(0))
        steps = _once(hits, lambda hit: F.arrays_zip(F.transform(F.slice(between, 1, F.size(hit)), _words).alias("gap"), F.transform(hit, _words).alias("width")))
        spans = F.array().cast(f"array<{_SPAN}>")
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"))

        def one(acc, x):
            start = acc["at"] + x["gap"]
            end = start + x["width"]
            span = F.struct(start.alias("start"), (-end).alias("less_end"), (-r["priority"]).alias("less_priority"), r["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

        def chunk(state, part):
            inner = F.aggregate(part, F.struct(state["at"].alias("at"), spans.alias("found")), one)
            return _once(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["done"], F.array(x["found"])).alias("done")))

        return F.flatten(_in_chunks(steps, zero, chunk)["done"])

    # many rules share a keyword: each one is looked for once
    keys = F.array(*[F.lit(key) for key in dict.fromkeys(key for _, key, _, _ in rules())])
    present = F.filter(keys, lambda key: F.contains(low, key))
    applying = _once(present, lambda found: F.filter(table, lambda r: F.array_contains(found, r["key"]) & F.regexp_like(low, r["rx"])))
    return F.array_sort(F.flatten(F.transform(applying, places)))


def _resolved(spans: Column) -> Column:
    """Detections that stay: disjoint, by start, length and priority."""
    none = F.array().cast(f"array<{_SPAN}>")

    def step(kept, s):
        clash = (F.size(kept) > 0) & (s["start"] < -F.try_element_at(kept, F.lit(-1))["less_end"])
        better = s["less_priority"] < F.try_element_at(kept, F.lit(-1))["less_priority"]
        return F.when(~clash, F.concat(kept, F.array(s))).when(better, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))).otherwise(kept)

    def chunk(state, part):
        # only the last one kept decides on the next; those before it are done
        done = lambda kept: F.struct(F.slice(kept, F.size(kept), 1).alias("last"), F.concat(state["done"], F.array(F.slice(kept, 1, F.size(kept) - 1))).alias("done"))
        return _once(F.aggregate(part, state["last"], step), done)

    zero = F.struct(none.alias("last"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"))
    return _once(_in_chunks(spans, zero, chunk), lambda state: F.concat(F.flatten(state["done"]), state["last"]))


def scan(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_words, the base phrases' places and labels, and the rules' detections.

    detections: array<struct<start, end, priority, label>> in words from 0. A null or empty text has no word and no
    detection; texts of any length are scanned whole; rows that repeat a doc_id are scanned each by itself, null
    ids stay null, other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("words")).withColumn("any_case", F.lower("words"))
    # Unicode lower case is a superset of the A-Z one here: it opens the gate, the exact text decides.
    gate = reduce(or_, [F.contains(F.col("any_case"), F.lit(stem)) for stem in STEMS])
    rows = rows.select("doc_id", _words(F.col("words")).alias("n_words"), F.when(gate, F.translate("words", _UPPER, _LOWER)).alias("low"))
    rows = rows.select("doc_id", "n_words", "low", F.when(F.col("low").isNotNull(), _resolved(_spans(F.col("low")))).alias("kept"))
    count, first, last, label = [], [], [], []
    for phrase, name in BASE.items():
        wrapped = _wrapped(phrase)
        there = F.contains(F.col("low"), F.lit(wrapped))
        count.append(F.when(there, ((F.char_length("low") - F.char_length(F.replace(F.col("low"), F.lit(wrapped), F.lit("")))) / len(wrapped)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        first.append(F.when(there, _words(F.substring_index("low", wrapped, 1))))
        last.append(F.when(there, F.col("n_words") - _words(F.substring_index("low", wrapped, -1)) - len(phrase.split())))
        label.append(F.when(there, F.lit(name)))
    kept = F.coalesce("kept", F.array().cast("array<struct<start:bigint,less_end:bigint,less_priority:int,label:string>>"))
    return rows.select(
        "doc_id",
        "n_words",
        sum(count[1:], count[0]).alias("n_base"),
        F.array_min(F.array(*first)).alias("first_word"),
        F.array_max(F.array(*last)).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*label))).alias("base"),
        F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["less_end"]).alias("end"), (-s["less_priority"]).alias("priority"), s["label"].alias("label"))).alias("detections"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """score is the highest priority among base phrases (50) and detections, of 110."""
    found = scan(common.table(spark, sf_dir, "documents"))
    top = F.greatest(F.coalesce(F.array_max(F.col("detections.priority")), F.lit(0)), F.when(F.col("n_base") > 0, 50).otherwise(0))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.array_distinct(F.col("detections.label"))))).alias("labels"),
        (top / 110.0).alias("score"),
    )
