"""Signature rules of the license scan, in order: (priority, label, keywords, pattern, score).

Patterns are written over normalised words with single spaces between them. Every match of a pattern holds at least one
of the rule's keywords as a whole word and spans at most ``MAX_WORDS`` words; the tests expand all patterns to see that.
Priorities: 0 phrases of the contract, 1 identifiers and titles, 2 sentences of licenses and grants, 3 statements that
name a license, 4 mentions.
"""

from __future__ import annotations

MAX_WORDS = 32

LICENSE = ("license", "licence")
LICENSED = ("licensed", "licenced")
STATED = ("licensed", "licenced", "released", "distributed", "published", "available", "provided")
UNDER = "(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?"

# The phrases that the contract names.
BASE = [
    (0, "mit", ("license",), "under the mit license", 1.0),
    (0, "apache-2", ("license",), "apache license version 2", 1.0),
    (0, "cc-by-nc", ("cc",), "cc by nc", 1.0),
]

RULES = [
    # MIT and its relatives
    (1, "mit", ("spdx",), "spdx license identifier mit", 1.0),
    (1, "mit", LICENSE, "the mit licen[sc]e mit", 1.0),
    (1, "mit", ("opensource",), "opensource org licenses? mit(?: license)?", 0.95),
    (2, "mit", ("hereby",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    (2, "mit", ("sublicense",), "use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    (2, "mit", ("substantial",), "included in all copies or substantial portions of the software", 0.85),
    (2, "mit", ("expat",), "(?:the )?expat licen[sc]e(?: terms)?", 0.9),
    (3, "mit", STATED, UNDER + "(?:mit|expat|mit expat|mit x11)(?: licen[sc]e)?", 0.9),
    (3, "mit", ("license", "licence"), "subject to the (?:terms of the )?mit licen[sc]e", 0.85),
    (3, "mit", ("license", "licence"), "licen[sc]e mit", 0.8),
    (3, "mit", ("license", "licence"), "under (?:an? |this )?(?:mit|expat) (?:style )?licen[sc]e", 0.75),
    (4, "mit", ("license", "licence"), "(?:the )?mit licen[sc]e", 0.6),
    (1, "mit-0", ("spdx",), "spdx license identifier mit 0", 1.0),
    (3, "mit-0", ("attribution",), "mit no attribution(?: licen[sc]e)?", 0.85),
    (1, "x11", ("spdx",), "spdx license identifier x11", 1.0),
    (2, "x11", ("consortium",), "the name of the x consortium shall not be used in advertising", 0.9),
    (3, "x11", ("x11",), "(?:the )?x11 licen[sc]e", 0.7),
    (1, "isc", ("spdx",), "spdx license identifier isc", 1.0),
    (2, "isc", ("hereby",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    (3, "isc", STATED, UNDER + "isc(?: licen[sc]e)?", 0.9),
    (4, "isc", ("isc",), "(?:the )?isc licen[sc]e", 0.6),
    # Apache
    (1, "apache-2", ("spdx",), "spdx license identifier apache 2 0", 1.0),
    (1, "apache-2", ("apache",), "apache licen[sc]e version 2 0 january 2004", 1.0),
    (1, "apache-2", ("apache",), "apache org licenses(?: license)? 2 0(?: txt| html)?", 0.95),
    (2, "apache-2", ("apache",), "licensed under the apache license version 2 0 the license", 0.98),
    (2, "apache-2", ("compliance",), "you may not use this file except in compliance with the license", 0.85),
    (2, "apache-2", ("warranties",), "distributed on an as is basis without warranties or conditions of any kind", 0.8),
    (2, "apache-2", ("contributor",), "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.95),
    (3, "apache-2", STATED, UNDER + "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?(?: licen[sc]e)?", 0.9),
    (3, "apache-2", ("apache",), "apache(?: software)? licen[sc]e(?: version)? (?:v2|2)(?: 0)?", 0.8),
    (3, "apache-2", ("apache", "apache2"), "(?:apache (?:v2|2)|apache2)(?: 0)?(?: licen[sc]e)?", 0.7),
    (3, "apache-1.1", ("apache",), "apache(?: software)?(?: licen[sc]e)?(?: version)? 1 1", 0.85),
    (1, "apache-1.1", ("spdx",), "spdx license identifier apache 1 1", 1.0),
    (4, "apache", ("apache",), "(?:the )?apache(?: software)? licen[sc]e", 0.5),
    # BSD
    (1, "bsd-2-clause", ("spdx",), "spdx license identifier bsd 2 clause", 1.0),
    (1, "bsd-3-clause", ("spdx",), "spdx license identifier bsd 3 clause", 1.0),
    (1, "bsd-4-clause", ("spdx",), "spdx license identifier bsd 4 clause", 1.0),
    (1, "0bsd", ("spdx",), "spdx license identifier 0bsd", 1.0),
    (1, "bsd-3-clause", ("opensource",), "opensource org licenses? bsd 3 clause", 0.95),
    (1, "bsd-2-clause", ("opensource",), "opensource org licenses? bsd 2 clause", 0.95),
    (2, "bsd", ("redistribution",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.9),
    (2, "bsd", ("redistributions",), "redistributions of source code must retain the (?:above )?copyright notice", 0.85),
    (2, "bsd", ("redistributions",), "redistributions in binary form must reproduce the (?:above )?copyright notice", 0.85),
    (2, "bsd-3-clause", ("endorse",), "may be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    (2, "bsd-4-clause", ("advertising",), "all advertising materials mentioning features or use of this software must display", 0.95),
    (3, "bsd-2-clause", ("bsd",), "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd bsd)(?: licen[sc]e)?", 0.8),
    (3, "bsd-3-clause", ("bsd",), "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", 0.8),
    (3, "bsd-4-clause", ("bsd",), "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?", 0.8),
    (3, "0bsd", ("bsd", "0bsd"), "(?:zero clause bsd|0bsd)(?: licen[sc]e)?", 0.8),
    (3, "bsd", STATED, UNDER + "bsd(?: style)?(?: licen[sc]e)?", 0.8),
    (4, "bsd", ("bsd",), "(?:the |a )?bsd(?: style)? licen[sc]e", 0.55),
    # GNU
    (1, "gpl-2", ("spdx",), "spdx license identifier gpl 2 0(?: only| or later)?", 1.0),
    (1, "gpl-3", ("spdx",), "spdx license identifier gpl 3 0(?: only| or later)?", 1.0),
    (1, "lgpl-2", ("spdx",), "spdx license identifier lgpl 2 0(?: only| or later)?", 1.0),
    (1, "lgpl-2.1", ("spdx",), "spdx license identifier lgpl 2 1(?: only| or later)?", 1.0),
    (1, "lgpl-3", ("spdx",), "spdx license identifier lgpl 3 0(?: only| or later)?", 1.0),
    (1, "agpl-3", ("spdx",), "spdx license identifier agpl 3 0(?: only| or later)?", 1.0),
    (1, "gfdl-1.3", ("spdx",), "spdx license identifier gfdl 1 3(?: only| or later)?", 1.0),
    (1, "gpl-2", ("gnu",), "gnu general public licen[sc]e version 2 june 1991", 1.0),
    (1, "gpl-3", ("gnu",), "gnu general public licen[sc]e version 3 29 june 2007", 1.0),
    (1, "lgpl-2.1", ("gnu",), "gnu lesser general public licen[sc]e version 2 1 february 1999", 1.0),
    (1, "agpl-3", ("gnu",), "gnu affero general public licen[sc]e version 3 19 november 2007", 1.0),
    (1, "gpl", ("gnu",), "gnu org licenses(?: gpl)?(?: html| txt)?", 0.7),
    (2, "gpl", ("redistribute",), "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.95),
    (2, "gpl-2", ("foundation",), "published by the free software foundation either version 2 of the license or at your option any later version", 0.95),
    (2, "gpl-3", ("foundation",), "published by the free software foundation either version 3 of the license or at your option any later version", 0.95),
    (2, "lgpl", ("redistribute",), "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 0.97),
    (2, "agpl", ("redistribute",), "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 0.97),
    (2, "gpl", ("merchantability",), "without even the implied warranty of merchantability or fitness for a particular purpose", 0.7),
    (2, "gpl", ("gnu",), "you should have received a copy of the gnu general public licen[sc]e", 0.9),
    (2, "lgpl", ("gnu",), "you should have received a copy of the gnu lesser general public licen[sc]e", 0.9),
    (2, "gpl", ("copyleft",), "the gnu general public licen[sc]e is a free copyleft licen[sc]e", 0.9),
    (3, "gpl-2", ("gnu",), "gnu (?:general public licen[sc]e|gpl)(?: version)? (?:v2|2)(?: 0)?(?: only| or later)?", 0.85),
    (3, "gpl-3", ("gnu",), "gnu (?:general public licen[sc]e|gpl)(?: version)? (?:v3|3)(?: 0)?(?: only| or later)?", 0.85),
    (3, "gpl-2", ("gpl", "gplv2", "gpl2"), "(?:gpl(?: version)? (?:v2|2)|gplv2|gpl2)(?: 0)?(?: only| or later)?", 0.8),
    (3, "gpl-3", ("gpl", "gplv3", "gpl3"), "(?:gpl(?: version)? (?:v3|3)|gplv3|gpl3)(?: 0)?(?: only| or later)?", 0.8),
    (3, "lgpl-2.1", ("lgpl", "lgplv2", "lgpl2"), "(?:lgpl(?: version)? (?:v2|2)|lgplv2|lgpl2) 1(?: only| or later)?", 0.8),
    (3, "lgpl-3", ("lgpl", "lgplv3", "lgpl3"), "(?:lgpl(?: version)? (?:v3|3)|lgplv3|lgpl3)(?: 0)?(?: only| or later)?", 0.8),
    (3, "lgpl-2.1", ("gnu",), "gnu lesser general public licen[sc]e(?: version)? (?:v2|2) 1(?: only| or later)?", 0.85),
    (3, "lgpl-3", ("gnu",), "gnu lesser general public licen[sc]e(?: version)? (?:v3|3)(?: 0)?(?: only| or later)?", 0.85),
    (3, "lgpl-2", ("gnu",), "gnu library general public licen[sc]e(?: version)?(?: v2| 2)?(?: 0)?", 0.8),
    (3, "agpl-3", ("agpl", "agplv3", "agpl3"), "(?:agpl(?: version)? (?:v3|3)|agplv3|agpl3)(?: 0)?(?: only| or later)?", 0.8),
    (3, "agpl-3", ("affero",), "(?:gnu )?affero general public licen[sc]e(?: version)? (?:v3|3)(?: 0)?(?: only| or later)?", 0.85),
    (3, "gfdl", ("documentation",), "gnu free documentation licen[sc]e(?: version)?(?: 1 [1-3])?", 0.85),
    (3, "gfdl", ("gfdl",), "gfdl(?: version)?(?: 1 [1-3])?", 0.7),
    (3, "gpl", STATED, UNDER + "(?:gnu )?gpl", 0.75),
    (3, "lgpl", STATED, UNDER + "(?:gnu )?lgpl", 0.75),
    (3, "agpl", STATED, UNDER + "(?:gnu )?agpl", 0.75),
    (4, "gpl", ("gnu",), "gnu general public licen[sc]e", 0.6),
    (4, "lgpl", ("gnu",), "gnu lesser general public licen[sc]e", 0.6),
    (4, "agpl", ("affero",), "(?:gnu )?affero general public licen[sc]e", 0.6),
    (4, "gpl", ("gpl",), "(?:the )?gpl licen[sc]e", 0.5),
    (4, "lgpl", ("lgpl",), "(?:the )?lgpl licen[sc]e", 0.5),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    (1, "mpl-2", ("spdx",), "spdx license identifier mpl 2 0(?: no copyleft exception)?", 1.0),
    (1, "mpl-1.1", ("spdx",), "spdx license identifier mpl 1 1", 1.0),
    (2, "mpl-2", ("mozilla",), "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 0.98),
    (2, "mpl-1.1", ("mozilla",), "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 0.98),
    (2, "mpl-2", ("mpl",), "if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    (1, "mpl-2", ("mozilla",), "mozilla org mpl 2 0", 0.9),
    (3, "mpl-2", ("mozilla",), "mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", 0.85),
    (3, "mpl-2", ("mozilla",), "mozilla public licen[sc]e v2(?: 0)?", 0.85),
    (3, "mpl-1.1", ("mozilla",), "mozilla public licen[sc]e(?: version| v)? ?1 1", 0.85),
    (3, "mpl-2", ("mpl", "mplv2", "mpl2"), "(?:mpl(?: version)? (?:v2|2)|mplv2|mpl2)(?: 0)?", 0.75),
    (3, "mpl-1.1", ("mpl", "mplv1", "mpl1"), "(?:mpl(?: version)? 1|mplv1|mpl1) 1", 0.75),
    (4, "mpl", ("mozilla",), "mozilla public licen[sc]e", 0.55),
    (1, "epl-2", ("spdx",), "spdx license identifier epl 2 0", 1.0),
    (1, "epl-1", ("spdx",), "spdx license identifier epl 1 0", 1.0),
    (2, "epl-2", ("eclipse",), "made available under the terms of the eclipse public licen[sc]e(?: v)? ?2 0", 0.97),
    (2, "epl-1", ("eclipse",), "made available under the terms of the eclipse public licen[sc]e(?: v)? ?1 0", 0.97),
    (3, "epl-2", ("eclipse",), "eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", 0.85),
    (3, "epl-1", ("eclipse",), "eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", 0.85),
    (3, "epl-2", ("epl", "epl2"), "(?:epl(?: version)? (?:v2|2)|epl2)(?: 0)?", 0.7),
    (3, "epl-1", ("epl", "epl1"), "(?:epl(?: version)? (?:v1|1)|epl1)(?: 0)?", 0.7),
    (4, "epl", ("eclipse",), "eclipse public licen[sc]e", 0.55),
    (1, "cddl-1", ("spdx",), "spdx license identifier cddl 1 [01]", 1.0),
    (2, "cddl-1", ("cddl",), "subject to the terms of the common development and distribution licen[sc]e(?: the)? cddl", 0.95),
    (3, "cddl-1", ("development",), "common development and distribution licen[sc]e(?: version| v)?(?: 1)?(?: [01])?", 0.85),
    (3, "cddl-1", ("cddl",), "cddl(?: version| v)?(?: 1)?(?: [01])?", 0.65),
    (1, "eupl-1.2", ("spdx",), "spdx license identifier eupl 1 2", 1.0),
    (3, "eupl-1.2", ("eupl",), "eupl(?: version| v)?(?: 1 [12])?", 0.75),
    (3, "eupl", ("european",), "european union public licen[sc]e(?: version| v)?(?: 1 [12])?", 0.85),
    (3, "cpl-1", ("common",), "common public licen[sc]e(?: version| v)? ?1(?: 0)?", 0.85),
    (3, "ipl-1", ("ibm",), "ibm public licen[sc]e(?: version)?(?: 1 0)?", 0.85),
    (3, "ms-pl", ("microsoft",), "microsoft public licen[sc]e(?: ms pl)?", 0.85),
    (3, "ms-rl", ("microsoft",), "microsoft reciprocal licen[sc]e(?: ms rl)?", 0.85),
    (3, "osl-3", ("open",), "open software licen[sc]e(?: version| v)?(?: 3 0)?", 0.8),
    (3, "afl-3", ("academic",), "academic free licen[sc]e(?: version| v)?(?: 3 0)?", 0.85),
    (3, "qpl-1", ("qpl",), "q public licen[sc]e(?: version)?(?: 1 0)? qpl", 0.8),
    (3, "ecl-2", ("educational",), "educational community licen[sc]e(?: version)?(?: 2 0)?", 0.85),
    (3, "artistic-2", ("artistic",), "artistic(?: licen[sc]e)?(?: version)? 2(?: 0)?", 0.8),
    (1, "artistic-2", ("spdx",), "spdx license identifier artistic 2 0", 1.0),
    (2, "artistic-1", ("artistic",), "under the same terms as perl itself(?: artistic licen[sc]e)|the artistic licen[sc]e preamble", 0.85),
    (4, "artistic", ("artistic",), "(?:the )?artistic licen[sc]e", 0.55),
    # Permissive and public domain
    (1, "zlib", ("spdx",), "spdx license identifier zlib", 1.0),
    (2, "zlib", ("misrepresented",), "the origin of this software must not be misrepresented", 0.95),
    (2, "zlib", ("altered",), "altered source versions must be plainly marked as such", 0.95),
    (3, "zlib", ("zlib",), "(?:the )?zlib(?: libpng)? licen[sc]e", 0.8),
    (3, "zlib", STATED, UNDER + "zlib(?: libpng)?", 0.85),
    (1, "boost-1", ("spdx",), "spdx license identifier bsl 1 0", 1.0),
    (1, "boost-1", ("boost",), "boost org license 1 0 txt", 0.95),
    (2, "boost-1", ("boost",), "distributed under the boost software licen[sc]e version 1 0", 0.97),
    (3, "boost-1", ("boost",), "boost software licen[sc]e(?: version)?(?: 1)?(?: 0)?", 0.85),
    (3, "boost-1", ("bsl",), "bsl(?: version)? 1 0", 0.7),
    (1, "busl-1.1", ("spdx",), "spdx license identifier busl 1 1", 1.0),
    (3, "busl-1.1", ("business",), "business source licen[sc]e(?: version)?(?: 1 1)?", 0.85),
    (3, "busl-1.1", ("bsl", "busl"), "(?:bsl|busl)(?: version)? 1 1", 0.7),
    (1, "unlicense", ("spdx",), "spdx license identifier unlicense", 1.0),
    (1, "unlicense", ("unlicense",), "unlicense org", 0.9),
    (2, "unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain", 0.98),
    (3, "unlicense", ("unlicense",), "(?:the )?unlicense(?: licen[sc]e)?", 0.7),
    (1, "wtfpl", ("spdx",), "spdx license identifier wtfpl", 1.0),
    (3, "wtfpl", ("wtfpl",), "(?:the )?wtfpl(?: version)?(?: 2)?", 0.8),
    (2, "wtfpl", ("want",), "do what the fuck you want to public licen[sc]e", 0.95),
    (3, "psf-2", ("python",), "python software foundation licen[sc]e(?: version)?(?: 2)?", 0.85),
    (3, "psf-2", ("psf",), "psf licen[sc]e(?: version)?(?: 2)?", 0.7),
    (1, "psf-2", ("spdx",), "spdx license identifier (?:psf|python) 2 0", 1.0),
    (3, "php-3", ("php",), "php licen[sc]e(?: version)?(?: 3 0[01]?)?", 0.75),
    (3, "ruby", ("ruby",), "(?:the )?ruby licen[sc]e", 0.7),
    (3, "ncsa", ("illinois",), "university of illinois(?: ncsa)? open source licen[sc]e", 0.85),
    (3, "openssl", ("openssl",), "openssl(?: ssleay)? licen[sc]e", 0.8),
    (3, "vim", ("vim",), "(?:the )?vim licen[sc]e", 0.7),
    (3, "w3c", ("w3c",), "w3c software(?: notice and)?(?: document)? licen[sc]e", 0.85),
    (3, "upl-1", ("universal",), "universal permissive licen[sc]e(?: version| v)?(?: 1 0)?", 0.85),
    (3, "postgresql", ("postgresql",), "(?:the )?postgresql licen[sc]e", 0.8),
    (3, "curl", ("curl",), "(?:the )?curl licen[sc]e", 0.7),
    (3, "json", ("evil",), "the software shall be used for good not evil", 0.95),
    (3, "beerware", ("beer", "beerware"), "(?:the )?(?:beer ware|beerware) licen[sc]e", 0.8),
    (3, "mulan-psl-2", ("mulan",), "mulan psl v2|mulan permissive software licen[sc]e(?: version)?(?: 2)?", 0.85),
    (2, "public-domain", ("domain",), "(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.85),
    (2, "public-domain", ("domain",), "(?:this work|this file|this code|it) is in the public domain", 0.85),
    (3, "public-domain", ("domain",), "public domain dedication", 0.8),
    (4, "public-domain", ("domain",), "public domain licen[sc]e", 0.6),
    # Creative Commons
    (1, "cc0", ("spdx",), "spdx license identifier cc0 1 0", 1.0),
    (1, "cc0", ("creativecommons",), "creativecommons org publicdomain zero 1 0", 0.97),
    (2, "cc0", ("waived",), "waived all copyright and related or neighboring rights to this work", 0.95),
    (3, "cc0", ("commons",), "creative commons(?: cc0| zero| public domain dedication)(?: 1 0)?", 0.85),
    (3, "cc0", ("cc0",), "cc0(?: 1 0)?(?: universal)?", 0.75),
    (1, "cc-by", ("creativecommons",), "creativecommons org licenses by [1-4] [05]", 0.97),
    (1, "cc-by-sa", ("creativecommons",), "creativecommons org licenses by sa [1-4] [05]", 0.97),
    (1, "cc-by-nd", ("creativecommons",), "creativecommons org licenses by nd [1-4] [05]", 0.97),
    (1, "cc-by-nc", ("creativecommons",), "creativecommons org licenses by nc [1-4] [05]", 0.97),
    (1, "cc-by-nc-sa", ("creativecommons",), "creativecommons org licenses by nc sa [1-4] [05]", 0.97),
    (1, "cc-by-nc-nd", ("creativecommons",), "creativecommons org licenses by nc nd [1-4] [05]", 0.97),
    (1, "cc-by", ("spdx",), "spdx license identifier cc by [1-4] [05]", 1.0),
    (1, "cc-by-sa", ("spdx",), "spdx license identifier cc by sa [1-4] [05]", 1.0),
    (1, "cc-by-nd", ("spdx",), "spdx license identifier cc by nd [1-4] [05]", 1.0),
    (1, "cc-by-nc", ("spdx",), "spdx license identifier cc by nc [1-4] [05]", 1.0),
    (1, "cc-by-nc-sa", ("spdx",), "spdx license identifier cc by nc sa [1-4] [05]", 1.0),
    (1, "cc-by-nc-nd", ("spdx",), "spdx license identifier cc by nc nd [1-4] [05]", 1.0),
    (2, "cc-by-nc-nd", ("noncommercial", "commercial"), "attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives)(?: [1-4] [05])?(?: international| unported)?", 0.92),
    (2, "cc-by-nc-sa", ("noncommercial", "commercial"), "attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: [1-4] [05])?(?: international| unported)?", 0.92),
    (2, "cc-by-nc", ("noncommercial", "commercial"), "attribution (?:noncommercial|non commercial)(?: [1-4] [05])?(?: international| unported)?", 0.9),
    (2, "cc-by-nd", ("noderivatives", "noderivs", "derivatives"), "attribution (?:noderivatives|noderivs|no derivatives)(?: [1-4] [05])?(?: international| unported)?", 0.9),
    (2, "cc-by-sa", ("sharealike", "alike"), "attribution (?:sharealike|share alike)(?: [1-4] [05])?(?: international| unported)?", 0.9),
    (2, "cc-by", ("commons",), "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", 0.88),
    (3, "cc-by-nc-nd", ("cc", "commons"), "(?:cc|creative commons) by nc nd(?: [1-4] [05])?", 0.85),
    (3, "cc-by-nc-sa", ("cc", "commons"), "(?:cc|creative commons) by nc sa(?: [1-4] [05])?", 0.85),
    (3, "cc-by-nc", ("cc", "commons"), "(?:cc|creative commons) by nc(?: [1-4] [05])?", 0.8),
    (3, "cc-by-nd", ("cc", "commons"), "(?:cc|creative commons) by nd(?: [1-4] [05])?", 0.8),
    (3, "cc-by-sa", ("cc", "commons"), "(?:cc|creative commons) by sa(?: [1-4] [05])?", 0.8),
    (3, "cc-by", ("cc", "commons"), "(?:cc|creative commons) by(?: [1-4] [05])", 0.75),
    (3, "cc-by", STATED, UNDER + "(?:cc|creative commons) by", 0.75),
    (4, "cc", ("commons",), "creative commons licen[sc]e", 0.5),
    # Data and fonts
    (1, "odbl-1", ("spdx",), "spdx license identifier odbl 1 0", 1.0),
    (3, "odbl-1", ("odbl",), "odbl(?: version| v)?(?: 1 0)?", 0.75),
    (3, "odbl-1", ("database",), "open database licen[sc]e(?: version| v)?(?: 1 0)?", 0.85),
    (3, "odc-by-1", ("commons",), "open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?", 0.9),
    (3, "pddl-1", ("pddl",), "(?:odc )?pddl(?: 1 0)?", 0.75),
    (3, "cdla-permissive", ("community",), "community data licen[sc]e agreement permissive", 0.85),
    (3, "ogl-uk-3", ("government",), "open government licen[sc]e(?: version| v)?(?: [123] 0)?", 0.85),
    (1, "ofl-1.1", ("spdx",), "spdx license identifier ofl 1 1", 1.0),
    (2, "ofl-1.1", ("font",), "licensed under the sil open font licen[sc]e version 1 1", 0.97),
    (3, "ofl-1.1", ("font",), "(?:sil )?open font licen[sc]e(?: version| v)?(?: 1 1)?", 0.85),
    (3, "ofl-1.1", ("ofl",), "(?:sil )?ofl(?: version| v)?(?: 1 1)?", 0.7),
    # Models and source-available
    (3, "openrail", ("openrail",), "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?", 0.85),
    (3, "rail", ("responsible",), "responsible ai licen[sc]e(?: rail)?", 0.8),
    (3, "sspl-1", ("sspl",), "sspl(?: version| v)?(?: 1)?(?: 0)?", 0.75),
    (3, "sspl-1", ("side",), "server side public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?", 0.85),
    (3, "elastic-2", ("elastic",), "elastic licen[sc]e(?: version| v)?(?: 2)?(?: 0)?", 0.8),
    (3, "commons-clause", ("clause",), "commons clause licen[sc]e condition(?: v1 0)?", 0.85),
    (3, "polyform-nc", ("polyform",), "polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?", 0.85),
    # Closed
    (2, "proprietary", ("rights",), "all rights reserved(?: worldwide)?", 0.5),
    (2, "proprietary", ("confidential",), "proprietary and confidential|confidential and proprietary", 0.85),
    (2, "proprietary", ("prohibited",), "unauthori[sz]ed copying of this file via any medium is strictly prohibited", 0.95),
    (2, "proprietary", ("reproduced",), "may not be (?:copied|reproduced) or reproduced in whole or in part without (?:the )?prior written (?:consent|permission)", 0.85),
    (2, "proprietary", ("reproduced",), "no part of this (?:publication|book|document|work) may be reproduced", 0.9),
    (3, "proprietary", LICENSE, "(?:a |the )?(?:proprietary|commercial) licen[sc]e", 0.75),
    (3, "proprietary", STATED, UNDER + "(?:a )?(?:proprietary|commercial) licen[sc]e", 0.85),
    (3, "proprietary", ("eula",), "end user licen[sc]e agreement eula", 0.8),
    (3, "proprietary", ("agreement",), "end user licen[sc]e agreement", 0.75),
]
