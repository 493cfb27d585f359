"""License detection by ordered signature rules, in DataFrame functions only.

The signatures below are written by hand: ``NAMES`` spelled out, ``SHORT`` names, ``SPDX`` identifiers, ``URLS``, and ``SENTENCES`` of licence
texts and notices. Names and identifiers also stand in the ``FORMS`` by which texts cite them, each a rule of its own that tells more than the bare
name. A rule runs only where all of its keywords occur; a text is first held against ``ROOTS``, of which every rule's keywords hold one, so that
most texts cost a few plain searches. Detections are resolved by
priority and containment: one that lies inside another goes, and of two over the same span the one of the earlier rule
stays. The four base phrases of ``BASE`` are looked for by words, whatever stands between those, and their labels always stay.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; case counts for nothing within A-Z.

Edge cases: null text is empty; a text without words has n_words 0 and no positions; no detection gives empty labels
and score 0; a null doc_id and repeated rows come out as they came in; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters (told as what they are, which Java matches ten times faster than as what they are not), what separates words, the base
#: phrases and their labels.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_CC = "(?: [1-4]\\.[05])?(?: (?:International|Unported|Generic))?"
#: (label, keywords, names as regular expressions), most specific first. The keywords occur in every name.
NAMES = (
    ("agpl-3.0", "affero", ("GNU Affero General Public License,? (?:version|v)\\.? ?3(?:\\.0)?", "Affero GPL ?v?3")),
    ("agpl", "affero", ("GNU Affero General Public License", "Affero GPL")),
    ("lgpl-2.1", "lesser", ("GNU Lesser General Public License,? (?:version|v)\\.? ?2\\.1", "Lesser GPL ?v?2\\.1")),
    ("lgpl-3.0", "lesser", ("GNU Lesser General Public License,? (?:version|v)\\.? ?3(?:\\.0)?", "Lesser GPL ?v?3")),
    ("lgpl", "lesser", ("GNU Lesser General Public License", "Lesser General Public License")),
    ("gpl-2.0", "gnu", ("GNU General Public License,? (?:version|v)\\.? ?2(?:\\.0)?", "GNU GPL,? ?(?:version |v)?2")),
    ("gpl-3.0", "gnu", ("GNU General Public License,? (?:version|v)\\.? ?3(?:\\.0)?", "GNU GPL,? ?(?:version |v)?3")),
    ("gfdl", "gnu", ("GNU Free Documentation License", "GNU FDL")),
    ("gpl", "gnu", ("GNU General Public License", "GNU GPL")),
    ("apache-1.1", "apache", ("Apache Software License,? (?:version|v)?\\.? ?1\\.1", "Apache License,? (?:version|v)?\\.? ?1\\.1")),
    ("apache-2.0", "apache", ("Apache License,? (?:version|v)?\\.? ?2(?:\\.0)?", "Apache Software License,? (?:version|v)?\\.? ?2(?:\\.0)?")),
    ("apache", "apache", ("Apache License", "Apache Software License")),
    ("bsd-2-clause", "bsd", ("BSD[ -]2[ -]clause(?: license)?", "2[ -]clause BSD(?: license)?")),
    ("bsd-3-clause", "bsd", ("BSD[ -]3[ -]clause(?: license)?", "3[ -]clause BSD(?: license)?")),
    ("bsd", "bsd", ("BSD license", "BSD-style license")),
    ("mit-0", "mit attribution", ("MIT No Attribution",)),
    ("mit", "mit licen", ("MIT License", "MIT/X11 license")),
    ("mpl-1.1", "mozilla", ("Mozilla Public License,? (?:version|v)?\\.? ?1\\.1", "Mozilla PL ?1\\.1")),
    ("mpl-2.0", "mozilla", ("Mozilla Public License,? (?:version|v)?\\.? ?2(?:\\.0)?", "Mozilla PL ?2(?:\\.0)?")),
    ("mpl", "mozilla", ("Mozilla Public License", "Mozilla PL")),
    ("epl-2.0", "eclipse", ("Eclipse Public License,? (?:-|version|v)?\\.? ?2(?:\\.0)?", "Eclipse PL ?2(?:\\.0)?")),
    ("epl", "eclipse", ("Eclipse Public License", "Eclipse Distribution License")),
    ("cddl", "cddl", ("Common Development and Distribution License \\(CDDL\\)", "CDDL")),
    ("isc", "isc licen", ("ISC License", "ISC licence")),
    ("zlib", "zlib licen", ("zlib License", "zlib/libpng license")),
    ("boost", "boost", ("Boost Software License,? (?:-|version|v)? ?1\\.0", "Boost Software License")),
    ("unlicense", "unlicense", ("The Unlicense", "Unlicense")),
    ("wtfpl", "wtfpl", ("WTFPL version 2", "WTFPL")),
    ("artistic-2.0", "artistic", ("Artistic License,? (?:version |v)?2(?:\\.0)?", "Artistic-2\\.0")),
    ("artistic", "artistic", ("Artistic License", "Perl Artistic License")),
    ("python", "python", ("Python Software Foundation License", "Python License")),
    ("eupl", "eupl", ("European Union Public Licence \\(EUPL\\)", "EUPL")),
    ("ofl", "font licen", ("SIL Open Font License,? (?:version|v)?\\.? ?1\\.1", "SIL Open Font License")),
    ("sspl", "server licen", ("Server Side Public License(?:,? (?:version|v)?\\.? ?1)?",)),
    ("elastic-2.0", "elastic licen", ("Elastic License,? (?:version|v)?\\.? ?2(?:\\.0)?",)),
    ("elastic-2.0", "elv2", ("ELv2",)),
    ("elastic", "elastic licen", ("Elastic License",)),
    ("busl-1.1", "business licen", ("Business Source License,? (?:version|v)?\\.? ?1\\.1",)),
    ("busl", "business licen", ("Business Source License",)),
    ("odbl", "database licen", ("(?:Open Data Commons )?Open Database License(?: \\(ODbL\\))?",)),
    ("postgresql", "postgresql licen", ("PostgreSQL License",)),
    ("openssl", "openssl licen", ("OpenSSL License",)),
    ("ruby", "ruby licen", ("Ruby License",)),
    ("x11", "x11 licen", ("X11 License",)),
    ("cc0", "cc0", ("CC0 1\\.0 Universal", "CC0")),
    ("cc-by-nc-nd", "cc", ("CC[ -]BY[ -]NC[ -]ND(?:[ -][1-4]\\.[05])?",)),
    ("cc-by-nc-nd", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution[ -]Non-?Commercial[ -]No-?Deriv(?:ative)?s" + _CC,)),
    ("cc-by-nc-sa", "cc", ("CC[ -]BY[ -]NC[ -]SA(?:[ -][1-4]\\.[05])?",)),
    ("cc-by-nc-sa", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution[ -]Non-?Commercial[ -]Share-?Alike" + _CC,)),
    ("cc-by-nc", "cc", ("CC[ -]BY[ -]NC(?:[ -][1-4]\\.[05])?",)),
    ("cc-by-nc", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution[ -]Non-?Commercial" + _CC,)),
    ("cc-by-nd", "cc", ("CC[ -]BY[ -]ND(?:[ -][1-4]\\.[05])?",)),
    ("cc-by-nd", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution[ -]No-?Deriv(?:ative)?s" + _CC,)),
    ("cc-by-sa", "cc", ("CC[ -]BY[ -]SA(?:[ -][1-4]\\.[05])?",)),
    ("cc-by-sa", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution[ -]Share-?Alike" + _CC,)),
    ("cc-by", "cc", ("CC[ -]BY(?:[ -][1-4]\\.[05])?",)),
    ("cc-by", "commons", ("Creative Commons (?:\\(?CC\\)? )?Attribution" + _CC,)),
    ("creative-commons", "commons", ("Creative Commons license", "Creative Commons")),
    ("public-domain", "domain", ("released into the public domain", "dedicated to the public domain")),
    ("all-rights-reserved", "rights", ("All rights reserved", "rights reserved")),
    ("proprietary", "proprietary", ("proprietary and confidential", "proprietary license")),
)

_ONLY = "(?:-only|-or-later|\\+)?"
#: (label, SPDX identifiers as regular expressions). Those with a version also stand alone, the others only in a form of citation.
SPDX = (
    ("agpl-3.0", (f"AGPL-3\\.0{_ONLY}",)),
    ("agpl", (f"AGPL-1\\.0{_ONLY}",)),
    ("lgpl-2.1", (f"LGPL-2\\.1{_ONLY}",)),
    ("lgpl-3.0", (f"LGPL-3\\.0{_ONLY}",)),
    ("lgpl", (f"LGPL-2\\.0{_ONLY}",)),
    ("gpl-2.0", (f"GPL-2\\.0{_ONLY}",)),
    ("gpl-3.0", (f"GPL-3\\.0{_ONLY}",)),
    ("gpl", (f"GPL-1\\.0{_ONLY}",)),
    ("gfdl", (f"GFDL-1\\.[123](?:-no-invariants|-invariants)?{_ONLY}",)),
    ("apache-1.1", ("Apache-1\\.1",)),
    ("apache-2.0", ("Apache-2\\.0",)),
    ("apache", ("Apache-1\\.0",)),
    ("bsd-2-clause", ("BSD-2-Clause",)),
    ("bsd-3-clause", ("BSD-3-Clause",)),
    ("bsd", ("0BSD", "BSD-4-Clause")),
    ("mit-0", ("MIT-0",)),
    ("mit", ("MIT",)),
    ("mpl-1.1", ("MPL-1\\.1",)),
    ("mpl-2.0", ("MPL-2\\.0",)),
    ("mpl", ("MPL-1\\.0",)),
    ("epl-2.0", ("EPL-2\\.0",)),
    ("epl", ("EPL-1\\.0",)),
    ("cddl", ("CDDL-1\\.[01]",)),
    ("isc", ("ISC",)),
    ("zlib", ("Zlib",)),
    ("boost", ("BSL-1\\.0",)),
    ("artistic-2.0", ("Artistic-2\\.0",)),
    ("artistic", ("Artistic-1\\.0(?:-Perl|-cl8)?",)),
    ("python", ("PSF-2\\.0", "Python-2\\.0(?:\\.1)?")),
    ("eupl", ("EUPL-1\\.[012]",)),
    ("ofl", ("OFL-1\\.[01]",)),
    ("sspl", ("SSPL-1\\.0",)),
    ("elastic-2.0", ("Elastic-2\\.0",)),
    ("busl-1.1", ("BUSL-1\\.1",)),
    ("odbl", ("ODbL-1\\.0",)),
    ("postgresql", ("PostgreSQL",)),
    ("openssl", ("OpenSSL",)),
    ("ruby", ("Ruby",)),
    ("x11", ("X11",)),
    ("cc0", ("CC0-1\\.0",)),
    ("cc-by-nc-nd", ("CC-BY-NC-ND-[1-4]\\.[05]",)),
    ("cc-by-nc-sa", ("CC-BY-NC-SA-[1-4]\\.[05]",)),
    ("cc-by-nc", ("CC-BY-NC-[1-4]\\.[05]",)),
    ("cc-by-nd", ("CC-BY-ND-[1-4]\\.[05]",)),
    ("cc-by-sa", ("CC-BY-SA-[1-4]\\.[05]",)),
    ("cc-by", ("CC-BY-[1-4]\\.[05]",)),
)

_VERSION = "(?: ?,? ?(?:version|v)\\.? ?{0}|[ -]?{0})(?:\\.0)?"
#: (label, keyword, short names as regular expressions). Those that are words of their own in prose only stand in a form of citation.
SHORT = (
    ("agpl-3.0", "agpl", ("(?:GNU )?AGPL" + _VERSION.format("3"),)),
    ("agpl", "agpl", ("(?:GNU )?AGPL",)),
    ("lgpl-2.1", "lgpl", ("(?:GNU )?LGPL(?: ?,? ?(?:version|v)\\.? ?2\\.1| ?2\\.1)",)),
    ("lgpl-3.0", "lgpl", ("(?:GNU )?LGPL" + _VERSION.format("3"),)),
    ("lgpl", "lgpl", ("(?:GNU )?LGPL",)),
    ("lgpl", "gnu", ("GNU Library General Public License",)),
    ("gpl-2.0", "gpl", ("(?:GNU )?GPL" + _VERSION.format("2"),)),
    ("gpl-3.0", "gpl", ("(?:GNU )?GPL" + _VERSION.format("3"),)),
    ("gpl", "gpl", ("(?:GNU )?GPL",)),
    ("apache-2.0", "apache", ("Apache(?:-| ?,? ?(?:version|v)\\.? ?| )2(?:\\.0)?",)),
    ("bsd", "bsd", ("(?:new |modified |simplified |revised |original )?BSD", "BSD-style")),
    ("mpl-2.0", "mpl", ("MPL" + _VERSION.format("2"),)),
    ("mpl", "mpl", ("MPL",)),
    ("epl-2.0", "epl", ("EPL" + _VERSION.format("2"),)),
    ("epl", "epl", ("EPL",)),
    ("mit", "mit", ("MIT", "MIT/X11", "MIT[ -]style")),
    ("mit", "expat", ("Expat",)),
    ("isc", "isc", ("ISC",)),
    ("zlib", "zlib", ("zlib",)),
    ("zlib", "libpng", ("zlib/libpng",)),
    ("boost", "bsl", ("BSL" + _VERSION.format("1"),)),
    ("sspl", "sspl", ("SSPL(?:v1)?",)),
    ("odbl", "odbl", ("ODbL",)),
    ("cc0", "cc", ("CC-?0",)),
    ("public-domain", "domain", ("(?:the )?public domain",)),
)

#: (label, keyword, addresses as regular expressions).
URLS = (
    ("agpl-3.0", "gnu", ("gnu\\.org/licenses/agpl(?:-3\\.0)?",)),
    ("lgpl-2.1", "gnu", ("gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1",)),
    ("lgpl-3.0", "gnu", ("gnu\\.org/licenses/lgpl-3\\.0",)),
    ("lgpl", "gnu", ("gnu\\.org/(?:copyleft|licenses)/(?:lgpl|lesser)",)),
    ("gpl-2.0", "gnu", ("gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0",)),
    ("gpl-3.0", "gnu", ("gnu\\.org/licenses/gpl-3\\.0",)),
    ("gfdl", "gnu", ("gnu\\.org/(?:copyleft|licenses)/fdl(?:-1\\.[123])?",)),
    ("gpl", "gnu", ("gnu\\.org/(?:copyleft|licenses)/gpl", "gnu\\.org/licenses/?")),
    ("apache-1.1", "apache", ("apache\\.org/licenses/LICENSE-1\\.1",)),
    ("apache-2.0", "apache", ("apache\\.org/licenses/LICENSE-2\\.0", "opensource\\.org/licenses?/apache-2\\.0")),
    ("apache", "apache", ("apache\\.org/licenses/?",)),
    ("mit", "opensource", ("opensource\\.org/licenses?/mit",)),
    ("bsd-2-clause", "opensource", ("opensource\\.org/licenses?/bsd-2-clause",)),
    ("bsd-3-clause", "opensource", ("opensource\\.org/licenses?/bsd-3-clause",)),
    ("bsd", "opensource", ("opensource\\.org/licenses?/bsd-license",)),
    ("isc", "opensource", ("opensource\\.org/licenses?/isc",)),
    ("artistic-2.0", "opensource", ("opensource\\.org/licenses?/artistic-2\\.0",)),
    ("mpl-2.0", "mozilla", ("mozilla\\.org/(?:en-US/)?MPL/2\\.0",)),
    ("mpl-1.1", "mozilla", ("mozilla\\.org/(?:en-US/)?MPL/1\\.1", "mozilla\\.org/MPL/MPL-1\\.1")),
    ("mpl", "mozilla", ("mozilla\\.org/(?:en-US/)?MPL/?",)),
    ("epl-2.0", "eclipse", ("eclipse\\.org/legal/epl-(?:v)?2(?:\\.0|0)",)),
    ("epl", "eclipse", ("eclipse\\.org/legal/epl-v10", "eclipse\\.org/org/documents/epl-v10")),
    ("boost", "boost", ("boost\\.org/LICENSE_1_0\\.txt",)),
    ("unlicense", "unlicense", ("unlicense\\.org",)),
    ("wtfpl", "wtfpl", ("wtfpl\\.net", "sam\\.zoy\\.org/wtfpl")),
    ("ofl", "sil.org", ("scripts\\.sil\\.org/OFL",)),
    ("ofl", "licen", ("openfontlicense\\.org",)),
    ("cc0", "creativecommons", ("creativecommons\\.org/publicdomain/zero(?:/1\\.0)?",)),
    ("public-domain", "creativecommons", ("creativecommons\\.org/publicdomain/mark(?:/1\\.0)?",)),
    ("cc-by-nc-nd", "creativecommons", ("creativecommons\\.org/licenses/by-nc-nd(?:/[1-4]\\.[05])?",)),
    ("cc-by-nc-sa", "creativecommons", ("creativecommons\\.org/licenses/by-nc-sa(?:/[1-4]\\.[05])?",)),
    ("cc-by-nc", "creativecommons", ("creativecommons\\.org/licenses/by-nc(?:/[1-4]\\.[05])?",)),
    ("cc-by-nd", "creativecommons", ("creativecommons\\.org/licenses/by-nd(?:/[1-4]\\.[05])?",)),
    ("cc-by-sa", "creativecommons", ("creativecommons\\.org/licenses/by-sa(?:/[1-4]\\.[05])?",)),
    ("cc-by", "creativecommons", ("creativecommons\\.org/licenses/by(?:/[1-4]\\.[05])?",)),
)

#: (label, keyword, sentences of licence texts and notices as regular expressions, score).
SENTENCES = (
    ("mit-0", "permission", ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \\(the \"?Software\"?\\), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so\\.",), 0.7),
    ("mit", "permission", ("Permission is hereby granted, free of charge, to any person obtaining a copy", "The above copyright notice and this permission notice shall be included in all copies or substantial portions"), 0.9),
    ("mit", "noninfringement", ("THE SOFTWARE IS PROVIDED \"?AS IS\"?, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",), 0.8),
    ("isc", "permission", ("Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted",), 0.9),
    ("bsd", "redistribution", ("Redistribution and use in source and binary forms,? with or without modification,? are permitted provided that", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice"), 0.9),
    ("bsd-3-clause", "endorse", ("Neither the names? of (?:[^.]{1,80}) nor the names of (?:its|their) contributors may be used to endorse or promote products",), 0.9),
    ("bsd-4-clause", "advertising", ("All advertising materials mentioning features or use of this software must display the following acknowledge?ment",), 0.9),
    ("bsd", "contributors", ("THIS SOFTWARE IS PROVIDED BY THE (?:COPYRIGHT HOLDERS|REGENTS|AUTHOR) AND CONTRIBUTORS \"?AS IS\"?",), 0.8),
    ("zlib", "altered", ("Altered source versions must be plainly marked as such",), 0.9),
    ("zlib", "implied", ("This software is provided 'as-is', without any express or implied warranty",), 0.9),
    ("boost", "permission", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",), 0.9),
    ("gpl", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU General Public License",), 0.9),
    ("gpl-2.0", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[;,] (?:either )?version 2",), 0.95),
    ("gpl-3.0", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[;,] (?:either )?version 3",), 0.95),
    ("lgpl", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU (?:Lesser|Library) General Public License",), 0.9),
    ("lgpl-2.1", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[;,] (?:either )?version 2\\.1",), 0.95),
    ("lgpl-3.0", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[;,] (?:either )?version 3",), 0.95),
    ("agpl-3.0", "redistribute", ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation[;,] (?:either )?version 3",), 0.95),
    ("gpl", "foundation", ("You should have received a copy of the GNU General Public License along with this program", "published by the Free Software Foundation"), 0.7),
    ("lgpl", "lesser", ("You should have received a copy of the GNU Lesser General Public License along with this library",), 0.8),
    ("agpl", "affero", ("You should have received a copy of the GNU Affero General Public License along with this program",), 0.8),
    ("gfdl", "documentation", ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",), 0.95),
    ("apache-2.0", "compliance", ("you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2\\.0 \\(the \"?License\"?\\)"), 0.9),
    ("apache-2.0", "conditions", ("WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",), 0.8),
    ("mpl-2.0", "subject", ("This Source Code Form is subject to the terms of the Mozilla Public License, v\\. ?2\\.0",), 0.95),
    ("mpl-1.1", "subject", ("The contents of this file are subject to the Mozilla Public License Version 1\\.1",), 0.95),
    ("epl", "accompanying", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License",), 0.9),
    ("cddl", "subject", ("The contents of this file are subject to the terms of the Common Development and Distribution License",), 0.9),
    ("unlicense", "unencumbered", ("This is free and unencumbered software released into the public domain",), 0.95),
    ("unlicense", "anyone", ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",), 0.9),
    ("wtfpl", "fuck", ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",), 0.95),
    ("ofl", "font licen", ("This Font Software is licensed under the SIL Open Font License",), 0.95),
    ("cc0", "waived", ("has waived all copyright and related or neighbou?ring rights",), 0.9),
    ("cc0", "dedicated", ("dedicated (?:this work|the work|all copyright) to the public domain",), 0.8),
    ("cc-by-sa", "licensed", ("This work is licensed under a Creative Commons Attribution-ShareAlike [1-4]\\.0 (?:International|Unported|Generic)? ?License",), 0.95),
    ("cc-by-nc", "licensed", ("This work is licensed under a Creative Commons Attribution-NonCommercial [1-4]\\.0 (?:International|Unported|Generic)? ?License",), 0.95),
    ("cc-by", "licensed", ("This work is licensed under a Creative Commons Attribution [1-4]\\.0 (?:International|Unported|Generic)? ?License",), 0.95),
    ("public-domain", "domain", ("(?:is|are|placed) in the public domain",), 0.8),
    ("public-domain", "copyright", ("no copyright is claimed",), 0.8),
    ("all-rights-reserved", "copyright", ("Copyright (?:\\(c\\)|©)? ?[12][0-9]{3}(?:-[12][0-9]{3})? [^\\n]{1,60}?All rights reserved",), 0.7),
    ("proprietary", "unauthorized", ("unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)[^\\n]{0,60}? is strictly prohibited",), 0.9),
    ("proprietary", "reproduced", ("may not be reproduced[^.\\n]{0,60}? without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)",), 0.8),
    ("proprietary", "confidential", ("confidential and proprietary", "proprietary and confidential information"), 0.8),
)

#: (form of citation around a name, keyword that it needs besides the name's, score), most specific first.
FORMS = (
    ("SPDX-License-Identifier: ?{}", "spdx", 1.0),
    ("licen[sc]e[\"']? ?[:=] ?[\"']?{}", "licen", 0.95),
    ("(?:is |are )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{}", "licen", 0.95),
    ("(?:re)?distributed under (?:the )?(?:terms of (?:the )?)?{}", "distributed", 0.95),
    ("(?:released|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}", "under", 0.9),
    ("under (?:the )?(?:(?:terms|conditions) of (?:the )?)?{}", "under", 0.85),
    ("subject to (?:the )?(?:(?:terms|conditions) of (?:the )?)?{}", "subject", 0.85),
    ("{}(?: (?:public )?licen[sc]e)", "licen", 0.8),
    ("{}[,;.]? see (?:the )?(?:file )?[\"'`]?licen[sc]e", "licen", 0.8),
    ("{}", "", 0.6),
)
#: What a text says not to be its license: such a span is longer than those it holds, which go with it, and has no label of its own.
DENIED = "(?:not|never|nor|neither|(?:is|are|was|were|be|been|has|have)n['’]t|cannot be) (?:(?:be|been|yet|itself|re) ?){0,2}(?:(?:licen[sc]ed|(?:re)?distributed|released|available|published|provided|used) )?under (?:the )?(?:(?:terms|conditions) of (?:the )?)?{}(?: (?:public )?licen[sc]e)?"
NO_LABEL = ""
#: Identifiers and short names that prose may hold by chance: only in a form of citation.
ONLY_CITED = {"PostgreSQL", "OpenSSL", "Ruby", "X11", "MPL" + _VERSION.format("2"), "EPL" + _VERSION.format("2"), "BSL" + _VERSION.format("1"), "MIT", "ISC", "Zlib", "zlib", "MPL", "EPL", "MIT/X11", "MIT[ -]style", "Expat", "(?:the )?public domain", "CC-?0", "(?:new |modified |simplified |revised |original )?BSD", "BSD-style"}

#: A text that holds none of these and does not match UNDER holds no rule's keywords in a form of the rule and no base phrase.
ROOTS = (
    "licen", "gpl", "gnu", "apache", "cc", "creative", "mozilla", "eclipse", "boost", "bsd", "spdx", "opensource", "copyright", "permission", "distribut", "domain", "rights",
    "proprietary", "confidential", "wtfpl", "cddl", "eupl", "gfdl", "artistic", "affero", "lesser", "ofl-", "sil.org", "expat", "foundation", "python", "commons",
    "contributors", "endorse", "advertising", "altered", "compliance", "conditions", "subject", "accompanying", "anyone", "waived", "dedicated", "noninfringement",
    "mit-0", "implied", "sspl", "elastic-", "elv2", "busl-", "odbl", "mpl-", "epl-", "bsl-", "libpng", "attribution", "documentation", "unauthorized", "reproduced", "unencumbered", "psf-", "fuck",
)
#: What stands between words: blanks, and where a line ends the marks with which a comment's next line begins.
_SEPARATOR = "(?:[^\\S\\n]++|\\n\\s*+(?:[*#;%>]++|/{2,}+|-{2,}+)?+)"
#: Names that are words or parts of words in prose, for which a citation is asked.
UNDER_NAMES = ("mit", "isc", "zlib", "mpl", "epl", "bsl", "postgresql", "openssl", "ruby", "x11")
UNDER = "under_(?:the_)?(?:(?:terms|conditions)_of_(?:the_)?)?(?:".replace("_", _SEPARATOR + "++") + "|".join(UNDER_NAMES) + ")"


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: str
    score: float


def _spaced(pattern: str) -> str:
    """Blanks stand for any run of separators that prose and comments put between words, optional blanks for none as well."""
    told = {" ?": _SEPARATOR + "*+", " ": _SEPARATOR + "++", "[ -]": f"(?:-|{_SEPARATOR}++)", "[ -]?": f"(?:-|{_SEPARATOR}++)?+"}
    return re.sub("\\[ -\\]\\??| \\??", lambda m: told[m[0]], pattern)


def _rule(label: str, keywords: tuple[str, ...], pattern: str, score: float) -> Rule:
    return Rule(label, tuple(" ".join(keywords).split()), "(?i)(?<![A-Za-z0-9])(?:" + _spaced(pattern) + ")(?![A-Za-z0-9])", score)


def _named(form: str) -> tuple[tuple[str, str, str], ...]:
    """(label, keywords, name) of what stands in a form: spelled-out names, identifiers, whose keyword is what precedes their first special character, and,
    but for the identifiers' own form, short names."""
    names = tuple((label, keyword, name) for label, keyword, several in NAMES for name in several)
    spdx = tuple((label, re.split(r"[\\(\[]", name)[0].lower(), name) for label, several in SPDX for name in several)
    return names + spdx + tuple((label, keyword, name) for label, keyword, several in SHORT for name in several if "SPDX" not in form)


def _rules() -> tuple[Rule, ...]:
    said = [_rule(label, (keyword,), sentence, score) for label, keyword, several, score in SENTENCES for sentence in several]
    cited = [
        _rule(label, (keyword, form_keyword), form.format(f"(?:{name})"), score)
        for form, form_keyword, score in FORMS
        for label, keyword, name in _named(form)
        if form != "{}" or name not in ONLY_CITED
    ]
    denied = [_rule(NO_LABEL, (keyword, "under"), DENIED.replace("{}", f"(?:{name})"), 0.0) for label, keyword, name in _named("")]
    linked = [_rule(label, (keyword,), "(?:https?://)?(?:www\\.)?" + url, 0.9) for label, keyword, several in URLS for url in several]
    return (*denied, *said, *cited, *linked)


RULES = _rules()
KEYWORDS = tuple(sorted({k for r in RULES for k in r.keywords}))
_RULE = "array<struct<rank:int,label:string,keywords:array<string>,pattern:string,score:double>>"
_SPAN = "array<struct<start:int,end:int,rank:int,label:string,score:double>>"
_BASE_PATTERN = "(?i)(?<!" + WORD + ")(?:" + "|".join((GAP + "++").join(p.split(" ")) for p, _ in BASE) + ")(?!" + WORD + ")"


def _rule_array() -> Column:
    """All rules as one constant: parsed once by the optimizer, where hundreds of literals would be compiled into every plan."""
    rows = [{"rank": i, "label": r.label, "keywords": r.keywords, "pattern": r.pattern, "score": r.score} for i, r in enumerate(RULES)]
    return F.from_json(F.lit(json.dumps(rows)), _RULE)


def rooted(lowered: Column) -> Column:
    """Whether a lower-case text may hold a rule's keywords or a base phrase: plain searches, no pattern."""
    found = F.contains(lowered, F.lit(ROOTS[0]))
    for root in ROOTS[1:]:
        found = found | F.contains(lowered, F.lit(root))
    return found | (F.contains(lowered, F.lit("under")) & lowered.rlike(UNDER))


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "++")).cast("long")


def _ascii_lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rule_spans(text: Column, rule: Column) -> Column:
    """array of spans of one rule's matches, in code points."""
    acc = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["before"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

    def located(found: Column) -> Column:
        between = F.slice(F.call_function("split", text, rule["pattern"], F.lit(-1)), F.lit(1), F.size(found))
        spans = F.aggregate(F.arrays_zip(between.alias("before"), found.alias("match")), acc, step, lambda a: a["out"])
        return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))

    return _let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), located)


def detections(text: Column, lowered: Column) -> Column:
    """array<struct<start, end, rank, label, score>> that stay, by start. Runs the rules whose keywords the lower-case text has."""
    present = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(lowered, k))
    gated = _let(present, lambda words: F.filter(_rule_array(), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(words, k))))
    found = F.flatten(F.transform(gated, lambda r: _rule_spans(text, r)))
    # by start, longest first, earlier rule first: a span then lies inside one before it exactly if it ends no later than the furthest end so far
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"), s["label"].alias("label"), s["score"].alias("score"))))
    acc = F.struct(F.lit(-1).alias("reach"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, s: Column) -> Column:
        end = -s["back"]
        kept = F.struct(s["start"].alias("start"), end.alias("end"), s["rank"].alias("rank"), s["label"].alias("label"), s["score"].alias("score"))
        return F.when(end > a["reach"], F.struct(end.alias("reach"), F.array_append(a["out"], kept).alias("out"))).otherwise(a)

    return F.filter(F.aggregate(keyed, acc, step, lambda a: a["out"]), lambda s: s["label"] != NO_LABEL)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, detections) for each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    lowered = docs.select("doc_id", text.alias("t"), F.lower(text).alias("low"))
    rows = lowered.select("doc_id", "t", "low", rooted(F.col("low")).alias("rooted"), words_in(F.col("t")).alias("n_words"))
    base = F.when(F.col("rooted"), F.regexp_extract_all("t", F.lit(_BASE_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("rooted"), detections(F.col("t"), F.col("low"))).otherwise(F.array().cast(_SPAN))
    rows = rows.select("doc_id", "t", "n_words", base.alias("base"), found.alias("detections"))
    parts = F.split("t", _BASE_PATTERN, -1)
    any_base = F.size("base") > 0
    plain = F.transform("base", lambda m: _ascii_lower(F.regexp_replace(m, GAP + "+", " ")))
    labels = F.array_sort(F.array_distinct(F.transform(plain, lambda p: F.coalesce(*[F.when(p == phrase, label) for phrase, label in BASE]))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(any_base, words_in(parts[0])).alias("first_word"),
        F.when(any_base, F.col("n_words") - words_in(F.element_at(parts, -1)) - words_in(F.element_at(F.col("base"), -1))).alias("last_word"),
        labels.alias("base_labels"),
        "detections",
    )


def op4_license_rules(docs: DataFrame) -> DataFrame:
    rows = scan(docs)
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, 0.6).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
