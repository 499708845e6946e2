"""License scan by ordered signature rules, gated by keywords; overlapping detections are resolved by containment.

DataFrame and SQL functions only, each document in its own row: nothing is shuffled. Rules match a text's words, each
lower-cased (A-Z) and followed by one space, so a rule's expression begins at a word and ends behind one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _common as C

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License names: label, keyword that any match contains, expressions for the name in words (a space behind each word).
NAMES: list[tuple[str, str, str]] = [
    ("mit", "mit", r"mit (?:x11 )?licen[sc]e "),
    ("mit", "expat", r"expat licen[sc]e "),
    ("mit-0", "attribution", r"mit no attribution "),
    ("x11", "x11", r"x11 licen[sc]e "),
    ("isc", "isc", r"isc licen[sc]e "),
    ("zlib", "zlib", r"zlib (?:libpng )?licen[sc]e "),
    ("libpng", "libpng", r"libpng licen[sc]e "),
    ("unlicense", "unlicense", r"unlicense "),
    ("wtfpl", "want", r"do what the \S+ you want to public licen[sc]e "),
    ("0bsd", "zero", r"zero clause bsd (?:licen[sc]e )?"),
    ("bsd-2", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) (?:licen[sc]e )?"),
    ("bsd-3", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) (?:licen[sc]e )?"),
    ("bsd-4", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) (?:licen[sc]e )?"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e "),
    ("apache-1", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 [01] "),
    ("apache-2", "apache", r"apache (?:software )?licen[sc]e (?:version |v |v2 )?2 (?:0 )?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e "),
    ("mpl-1", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 [01] "),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e (?:version |v )?2 (?:0 )?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e "),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e (?:version |v )?1 (?:0 )?"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e (?:version |v )?2 (?:0 )?"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e "),
    ("cddl", "distribution", r"common development and distribution licen[sc]e "),
    ("cpl", "common", r"common public licen[sc]e "),
    ("cpal", "common", r"common public attribution licen[sc]e "),
    ("ipl", "ibm", r"ibm public licen[sc]e "),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e (?:version |v )?3 "),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e "),
    ("lgpl-2", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?2 (?:[01] )?"),
    ("lgpl-2", "library", r"(?:gnu )?library general public licen[sc]e (?:version |v )?2 (?:[01] )?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?3 "),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e "),
    ("gpl-1", "general", r"(?:gnu )?general public licen[sc]e (?:version |v )?1 "),
    ("gpl-2", "general", r"(?:gnu )?general public licen[sc]e (?:version |v )?2 "),
    ("gpl-3", "general", r"(?:gnu )?general public licen[sc]e (?:version |v )?3 "),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e "),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e "),
    ("eupl", "european", r"european union public licen[sc]e "),
    ("cecill", "cecill", r"cecill (?:[bc] )?(?:free software )?licen[sc]e "),
    ("artistic-1", "artistic", r"artistic licen[sc]e (?:version |v )?1 (?:0 )?"),
    ("artistic-2", "artistic", r"artistic licen[sc]e (?:version |v )?2 (?:0 )?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e "),
    ("boost-1", "boost", r"boost software licen[sc]e (?:version |v )?1 (?:0 )?"),
    ("boost", "boost", r"boost software licen[sc]e "),
    ("python-2", "python", r"python (?:software foundation )?licen[sc]e (?:version |v )?2 "),
    ("python-2", "psf", r"psf licen[sc]e (?:version |v )?2 "),
    ("python", "python", r"python (?:software foundation )?licen[sc]e "),
    ("php", "php", r"php licen[sc]e "),
    ("ruby", "ruby", r"ruby licen[sc]e "),
    ("postgresql", "postgresql", r"postgresql licen[sc]e "),
    ("openssl", "openssl", r"openssl licen[sc]e "),
    ("curl", "curl", r"curl licen[sc]e "),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source licen[sc]e "),
    ("afl-3", "academic", r"academic free licen[sc]e (?:version |v )?3 (?:0 )?"),
    ("afl", "academic", r"academic free licen[sc]e "),
    ("osl-3", "open", r"open software licen[sc]e (?:version |v )?3 (?:0 )?"),
    ("osl", "open", r"open software licen[sc]e "),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e "),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e "),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e "),
    ("bsl", "business", r"business source licen[sc]e "),
    ("sspl", "server", r"server side public licen[sc]e "),
    ("elastic", "elastic", r"elastic licen[sc]e "),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e "),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e "),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e "),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail (?:m )?(?:licen[sc]e )?"),
    ("cc0", "cc0", r"cc0 (?:1 0 )?(?:universal )?"),
    ("cc-by-nc-nd", "deriv", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?"),
    ("cc-by-nc-sa", "alike", r"(?:creative commons )?attribution non ?commercial share ?alike "),
    ("cc-by-nc", "commercial", r"(?:creative commons )?attribution non ?commercial (?!no ?deriv|share)"),
    ("cc-by-nd", "deriv", r"(?:creative commons )?attribution no ?deriv(?:ative)?s? "),
    ("cc-by-sa", "alike", r"(?:creative commons )?attribution share ?alike "),
    ("cc-by", "attribution", r"creative commons attribution "),
    ("cc-by-nc-nd", "nd", r"cc by nc nd (?:[1234] [05] )?"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa (?:[1234] [05] )?"),
    ("cc-by-nd", "nd", r"cc by nd (?:[1234] [05] )?"),
    ("cc-by-sa", "sa", r"cc by sa (?:[1234] [05] )?"),
    ("cc-by-nc", "nc", r"cc by nc (?!(?:nd|sa) )(?:[1234] [05] )?"),
    ("cc-by", "cc", r"cc by (?!(?:nc|nd|sa) )(?:[1234] [05] )?"),
    ("cc", "creative", r"creative commons (?:licen[sc]e )?"),
    ("academy-1", "academy", r"academy software foundation licen[sc]e "),
    ("aal", "assurance", r"attribution assurance licen[sc]e "),
    ("adobe", "adobe", r"adobe (?:source code |glyph list )?licen[sc]e "),
    ("adsl", "amazon", r"amazon digital services licen[sc]e "),
    ("amazon", "amazon", r"amazon software licen[sc]e "),
    ("aladdin", "aladdin", r"aladdin free public licen[sc]e "),
    ("antlr", "antlr", r"antlr (?:software rights notice |2 )?licen[sc]e "),
    ("apsl-1", "apple", r"apple public source licen[sc]e (?:version |v )?1 [012] "),
    ("apsl-2", "apple", r"apple public source licen[sc]e (?:version |v )?2 (?:0 )?"),
    ("apsl", "apple", r"apple public source licen[sc]e "),
    ("beerware", "beer", r"beer ?ware licen[sc]e "),
    ("bittorrent", "bittorrent", r"bittorrent open source licen[sc]e "),
    ("blueoak", "blue", r"blue oak model licen[sc]e "),
    ("bsd-protection", "protection", r"bsd protection licen[sc]e "),
    ("bsd-patent", "patent", r"bsd (?:2 clause )?plus patent licen[sc]e "),
    ("bsd-clear", "clear", r"clear bsd licen[sc]e "),
    ("bzip2", "bzip2", r"bzip2 (?:and libbzip2 )?licen[sc]e "),
    ("cal", "autonomy", r"cryptographic autonomy licen[sc]e "),
    ("catosl", "computer", r"computer associates trusted open source licen[sc]e "),
    ("cdla-permissive", "permissive", r"community data licen[sc]e agreement permissive "),
    ("cdla-sharing", "sharing", r"community data licen[sc]e agreement sharing "),
    ("cern-ohl-p", "cern", r"cern open hardware licen[sc]e (?:version |v )?2 permissive "),
    ("cern-ohl-s", "cern", r"cern open hardware licen[sc]e (?:version |v )?2 strongly reciprocal "),
    ("cern-ohl-w", "cern", r"cern open hardware licen[sc]e (?:version |v )?2 weakly reciprocal "),
    ("cern-ohl", "cern", r"cern open hardware licen[sc]e "),
    ("clarified-artistic", "clarified", r"clarified artistic licen[sc]e "),
    ("cnri-python", "cnri", r"cnri (?:open source )?(?:python )?licen[sc]e "),
    ("coil", "copyfree", r"copyfree open innovation licen[sc]e "),
    ("condor", "condor", r"condor public licen[sc]e "),
    ("cpol", "code", r"code project open licen[sc]e "),
    ("cua", "cua", r"cua office public licen[sc]e "),
    ("d-fsl", "deutsche", r"deutsche freie software lizenz (?:licen[sc]e )?"),
    ("ecl-1", "educational", r"educational community licen[sc]e (?:version |v )?1 (?:0 )?"),
    ("ecl-2", "educational", r"educational community licen[sc]e (?:version |v )?2 (?:0 )?"),
    ("ecos", "ecos", r"ecos (?:public )?licen[sc]e "),
    ("efl", "eiffel", r"eiffel forum licen[sc]e "),
    ("entessa", "entessa", r"entessa public licen[sc]e "),
    ("erlang", "erlang", r"erlang public licen[sc]e "),
    ("eudatagrid", "datagrid", r"eu ?datagrid software licen[sc]e "),
    ("fair", "fair", r"fair licen[sc]e "),
    ("fair-source", "source", r"fair source licen[sc]e "),
    ("frameworx", "frameworx", r"frameworx open licen[sc]e "),
    ("freetype", "freetype", r"freetype (?:project )?licen[sc]e "),
    ("gl2ps", "gl2ps", r"gl2ps licen[sc]e "),
    ("glide", "glide", r"3dfx glide licen[sc]e "),
    ("gsoap", "gsoap", r"gsoap public licen[sc]e "),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e "),
    ("hpnd", "historical", r"historical permission notice and disclaimer (?:licen[sc]e )?"),
    ("icu", "icu", r"icu licen[sc]e "),
    ("ijg", "jpeg", r"independent jpeg group licen[sc]e "),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e "),
    ("info-zip", "zip", r"info zip licen[sc]e "),
    ("intel", "intel", r"intel open source licen[sc]e "),
    ("interbase", "interbase", r"interbase public licen[sc]e "),
    ("ipa", "ipa", r"ipa font licen[sc]e "),
    ("jasper", "jasper", r"jasper licen[sc]e "),
    ("jpnic", "jpnic", r"jpnic licen[sc]e "),
    ("json", "json", r"json licen[sc]e "),
    ("latex", "latex", r"latex2e licen[sc]e "),
    ("leptonica", "leptonica", r"leptonica licen[sc]e "),
    ("libtiff", "libtiff", r"libtiff licen[sc]e "),
    ("liliq", "libre", r"licen[sc]e libre du qu[eé]bec "),
    ("lpl", "lucent", r"lucent public licen[sc]e "),
    ("lppl", "latex", r"latex project public licen[sc]e "),
    ("miros", "miros", r"miros licen[sc]e "),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e "),
    ("mulanpsl-1", "mulan", r"mulan permissive software licen[sc]e (?:version |v )?1 "),
    ("mulanpsl-2", "mulan", r"mulan permissive software licen[sc]e (?:version |v )?2 "),
    ("mulanpsl", "mulan", r"mulan permissive software licen[sc]e "),
    ("multics", "multics", r"multics licen[sc]e "),
    ("nasa", "nasa", r"nasa open source agreement (?:licen[sc]e )?"),
    ("naumen", "naumen", r"naumen public licen[sc]e "),
    ("netcdf", "netcdf", r"netcdf licen[sc]e "),
    ("ngpl", "nethack", r"nethack general public licen[sc]e "),
    ("nokia", "nokia", r"nokia open source licen[sc]e "),
    ("nosl", "netizen", r"netizen open source licen[sc]e "),
    ("npl", "netscape", r"netscape public licen[sc]e "),
    ("nposl", "profit", r"non profit open software licen[sc]e "),
    ("ntp", "ntp", r"ntp licen[sc]e "),
    ("oclc", "oclc", r"oclc research public licen[sc]e "),
    ("ogl-uk", "government", r"open government licen[sc]e "),
    ("ogtsl", "group", r"open group test suite licen[sc]e "),
    ("oldap", "openldap", r"openldap public licen[sc]e "),
    ("opl", "publication", r"open publication licen[sc]e "),
    ("oset", "oset", r"oset public licen[sc]e "),
    ("parity", "parity", r"parity public licen[sc]e "),
    ("phorum", "phorum", r"phorum licen[sc]e "),
    ("polyform-noncommercial", "polyform", r"polyform non ?commercial licen[sc]e "),
    ("polyform-perimeter", "polyform", r"polyform perimeter licen[sc]e "),
    ("polyform-small", "polyform", r"polyform small business licen[sc]e "),
    ("polyform-strict", "polyform", r"polyform strict licen[sc]e "),
    ("prosperity", "prosperity", r"prosperity public licen[sc]e "),
    ("qhull", "qhull", r"qhull licen[sc]e "),
    ("qpl", "public", r"q public licen[sc]e "),
    ("realnetworks", "realnetworks", r"realnetworks public source licen[sc]e "),
    ("rpl", "reciprocal", r"reciprocal public licen[sc]e "),
    ("sendmail", "sendmail", r"sendmail licen[sc]e "),
    ("sgi-b", "sgi", r"sgi free software licen[sc]e b "),
    ("simpl", "simple", r"simple public licen[sc]e "),
    ("sissl", "industry", r"sun industry standards source licen[sc]e "),
    ("sleepycat", "sleepycat", r"sleepycat (?:software )?licen[sc]e "),
    ("spl", "sun", r"sun public licen[sc]e "),
    ("sugarcrm", "sugarcrm", r"sugarcrm public licen[sc]e "),
    ("tapr-ohl", "tapr", r"tapr open hardware licen[sc]e "),
    ("tcl", "tcl", r"tcl (?:tk )?licen[sc]e "),
    ("torque", "torque", r"torque (?:software )?licen[sc]e "),
    ("unicode", "unicode", r"unicode (?:data files and software |terms of use )?licen[sc]e "),
    ("upl", "universal", r"universal permissive licen[sc]e "),
    ("vim", "vim", r"vim licen[sc]e "),
    ("vovida", "vovida", r"vovida software licen[sc]e "),
    ("w3c", "w3c", r"w3c (?:software (?:notice )?(?:and )?)?licen[sc]e "),
    ("watcom", "watcom", r"sybase open watcom public licen[sc]e "),
    ("xfree86", "xfree86", r"xfree86 licen[sc]e "),
    ("xnet", "x", r"x net licen[sc]e "),
    ("ypl", "yahoo", r"yahoo public licen[sc]e "),
    ("zend", "zend", r"zend (?:engine )?licen[sc]e "),
    ("zimbra", "zimbra", r"zimbra public licen[sc]e "),
    ("zpl", "zope", r"zope public licen[sc]e "),
    ("bigcode", "bigcode", r"bigcode (?:open ?rail m )?licen[sc]e "),
    ("llama", "llama", r"llama (?:[234] )?(?:community )?licen[sc]e "),
    ("gemma", "gemma", r"gemma (?:terms of use )?licen[sc]e "),
]
#: What may stand before a name: priority (lower wins), confidence, expression.
FORMS: list[tuple[int, float, str]] = [
    (1, 0.99, r"spdx licen[sc]e identifier "),
    (2, 0.95, r"(?:re)?(?:licen[sc]ed|released|distributed|available|provided|published|offered|covered) (?:by|under) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"),
    (3, 0.6, ""),
]
#: Notices that name no license: label, keyword, priority, confidence, expression.
NOTICES: list[tuple[str, str, int, float, str]] = [
    ("proprietary", "reserved", 2, 0.7, r"all rights reserved "),
    ("proprietary", "proprietary", 3, 0.5, r"proprietary and confidential "),
    ("public-domain", "domain", 2, 0.8, r"(?:released into|dedicated to|placed in|in) the public domain "),
    ("mit", "granted", 1, 0.99, r"permission is hereby granted free of charge to any person obtaining a copy "),
    ("isc", "purpose", 1, 0.95, r"permission to use copy modify and (?:or )?distribute this software for any purpose "),
    ("bsd", "binary", 1, 0.95, r"redistribution and use in source and binary forms "),
    ("gpl", "redistribute", 1, 0.9, r"this program is free software you can redistribute it and or modify it "),
    ("zlib", "express", 1, 0.9, r"this software is provided as is without any express or implied warranty "),
    ("unlicense", "unencumbered", 1, 0.95, r"free and unencumbered software released into the public domain "),
    ("unknown", "copyright", 4, 0.2, r"copyright (?:c )?[12][0-9]{3} "),
    ("apache-2", "compliance", 1, 0.95, r"you may not use this file except in compliance with the licen[sc]e "),
    ("apache-2", "basis", 2, 0.6, r"software distributed under the licen[sc]e is distributed on an as is basis "),
    ("mpl-2", "subject", 1, 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0 "),
    ("epl-2", "accompanying", 1, 0.9, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0 "),
    ("boost-1", "accompanying", 1, 0.9, r"see accompanying file licen[sc]e 1 0 txt or copy at "),
    ("gpl", "copy", 2, 0.8, r"you should have received a copy of the gnu general public licen[sc]e "),
    ("lgpl", "copy", 2, 0.8, r"you should have received a copy of the gnu lesser general public licen[sc]e "),
    ("agpl", "copy", 2, 0.8, r"you should have received a copy of the gnu affero general public licen[sc]e "),
    ("mit", "substantial", 2, 0.7, r"this permission notice shall be included in all copies or substantial portions of the software "),
    ("bsd", "disclaimer", 2, 0.6, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "),
    ("bsd-3", "endorse", 2, 0.7, r"may be used to endorse or promote products derived from this software without specific prior written permission "),
    ("ofl", "font", 2, 0.6, r"with reserved font name "),
    ("cc0", "waived", 1, 0.9, r"has waived all copyright and related or neighboring rights "),
    ("gfdl", "documentation", 1, 0.9, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e "),
    ("artistic", "itself", 2, 0.7, r"under the same licen[sc]e (?:terms )?as perl itself "),
    ("wtfpl", "verbatim", 1, 0.9, r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document "),
    ("proprietary", "prohibited", 2, 0.7, r"unauthorized (?:copying|reproduction|distribution) of this file via any medium is strictly prohibited "),
    ("proprietary", "prior", 3, 0.5, r"without the (?:express )?prior written permission of "),
    ("proprietary", "evaluation", 3, 0.5, r"for evaluation purposes only "),
    ("non-commercial", "commercial", 3, 0.5, r"for non ?commercial (?:use|purposes) only "),
    ("dual", "dual", 3, 0.4, r"dual licen[sc]ed "),
    ("multiple", "either", 3, 0.3, r"licen[sc]ed under either "),
]
#: SPDX short names, one word or more after white space and punctuation are gone: label by expression.
SPDX = {
    "mit": "mit", "isc": "isc", "0bsd": "0bsd", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "apache 2 0": "apache-2",
    "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2", "lgpl 3 0": "lgpl-3",
    "agpl 3 0": "agpl-3", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "bsl 1 0": "boost-1", "zlib": "zlib",
    "unlicense": "unlicense", "ofl 1 1": "ofl", "artistic 2 0": "artistic-2", "postgresql": "postgresql", "eupl 1 2": "eupl",
}


class Rule(NamedTuple):
    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str
    also: str = ""  # another string that any match contains


def rules() -> list[Rule]:
    """All rules in order: base phrases, which nothing suppresses, then every form of every name, and notices."""
    out = [Rule(label, label.split("-")[0], 0, 0.9, f"{phrase} ") for phrase, label in BASE.items()]
    out += [Rule(label, name.split(" ")[0], 1, 0.99, rf"spdx licen[sc]e identifier {name} ", "identifier") for name, label in SPDX.items()]
    out += [Rule(label, keyword, priority, confidence, form + name, "identifier" if "identifier" in form else "") for priority, confidence, form in FORMS for label, keyword, name in NAMES]
    out += [Rule(label, keyword, priority, confidence, pattern) for label, keyword, priority, confidence, pattern in NOTICES]
    return [r._replace(pattern=rf"(?<![^ ]){r.pattern}") for r in out]


#: Whether a text can hold any detection: a superset of all rules, tested on the text as it stands.
GATE = r"(?i)licen[sc]|copyright|creative|commons|openrail|public\P{Alnum}+domain|rights\P{Alnum}+reserved|proprietary|permission|redistribut|attribution|cc0|cc\P{Alnum}+by|bsd|provided\P{Alnum}+as|strictly\P{Alnum}+prohibited|evaluation\P{Alnum}+purposes|commercial\P{Alnum}+(?:use|purposes)|reserved\P{Alnum}+font|lizenz|source\P{Alnum}+agreement"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every whole text.

    detections: label, priority, confidence, first word, end word (exclusive), in order. A detection is suppressed if
    one of a better priority, or of the same and longer, contains it; base phrases are all kept. score is the best
    confidence kept, 0 without one. A null text counts as empty: no words, null first_word and last_word, empty
    labels. Rows keep their doc_id, null or repeated; other columns are ignored.
    """
    word = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    table = ", ".join(f"named_struct('label', '{r.label}', 'keyword', '{r.keyword}', 'also', '{r.also}', 'p', {r.priority}, 'c', {r.confidence}D, 'x', r'{r.pattern}')" for r in rules())
    rows = C.documents(docs, "doc_id", "text").select(
        "doc_id",
        F.expr(f"cast(regexp_count(text, '{word}') as long)").alias("n_words"),
        # only gated texts are split into words, lower-cased and searched
        F.expr(f"CASE WHEN text rlike '{GATE.replace(chr(92), chr(92) * 2)}' THEN translate(concat(array_join(regexp_extract_all(text, '{word}', 0), ' '), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END").alias("norm"))
    # each keyword is looked for once; a rule's matches are marked in the text: a match's first word bears \u0001, the word
    # behind its last one \u0002
    keywords = ", ".join(f"'{k}'" for k in sorted({r.keyword for r in rules()}))
    present = f"filter(array({keywords}), k -> contains(norm, k))"  # bound by a lambda, so that it is made once for a text
    rows = rows.withColumn("hits", F.expr(f"""CASE WHEN norm IS NOT NULL THEN transform(
        filter(flatten(transform(array({present}), present -> transform(
            filter(array({table}), r -> array_contains(present, r.keyword) AND contains(norm, r.also)),
            r -> named_struct('r', r, 'marked', regexp_replace(norm, r.x, '{chr(1)}$0{chr(2)}'))))),
               h -> contains(h.marked, '{chr(1)}')),
        h -> named_struct('r', h.r, 'w', split(h.marked, ' '))) END"""))
    at = "filter(transform(h.w, (w, i) -> CASE WHEN contains(w, '{0}') THEN i END), i -> i IS NOT NULL)"
    places = f"""flatten(transform(hits, h -> transform(
        zip_with({at.format(chr(1))}, {at.format(chr(2))}, (s, e) -> named_struct('s', s, 'e', e)),
        o -> named_struct('s', o.s, 'e', -o.e, 'p', h.r.p, 'label', h.r.label, 'c', h.r.c))))"""
    rows = rows.withColumn("listed", F.expr(f"sort_array({places})"))
    rows = rows.withColumn("found", F.expr("filter(listed, (x, i) -> i = 0 OR x != listed[i - 1])"))
    # what contains a detection stands before it in this order, and begins less than `most` words before it, so in the same
    # or the last stretch of `most` words: `near` is the number of detections of the two fullest stretches side by side
    most = max(r.pattern.count(" ") for r in rules())
    rows = rows.withColumn("stretches", F.expr(f"filter(transform(found, (x, i) -> CASE WHEN i = 0 OR x.s div {most} != found[i - 1].s div {most} THEN i END), i -> i IS NOT NULL)"))
    rows = rows.withColumn("near", F.expr("array_max(transform(stretches, (a, i) -> coalesce(get(stretches, i + 2), size(found)) - a))"))
    inside = "exists(slice(found, greatest(1, i + 1 - near), least(i, near)), y -> y.e <= x.e AND (y.p < x.p OR (y.p = x.p AND (y.s < x.s OR y.e < x.e))))"
    rows = rows.withColumn("kept", F.expr(f"coalesce(filter(found, (x, i) -> x.p = 0 OR i = 0 OR NOT {inside}), array())"))
    rows = rows.withColumn("base", F.expr("filter(kept, x -> x.p = 0)"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(base.s) as long)").alias("first_word"), F.expr("cast(array_max(base.s) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(kept.label)), ',')").alias("labels"),
        F.expr("coalesce(array_max(kept.c), 0D)").alias("score"),
        F.expr("transform(kept, x -> named_struct('label', x.label, 'priority', x.p, 'confidence', x.c, 'first_word', x.s, 'end_word', -x.e))").alias("detections"))
