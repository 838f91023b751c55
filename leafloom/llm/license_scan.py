"""License scan by ordered signature rules.

A rule is a regular expression over the words of a text, with a label, a weight, and keywords: strings
one of which stands in all that the rule matches. One Aho-Corasick pass over a text finds the keywords
in it, at the beginning of a word or, for those written with a star, anywhere; only their rules are
run. Rules are ordered: notices and headers first, then addresses and identifiers, then phrases that
name a license, then bare names.

Overlapping detections are resolved in two steps. A detection inside a longer one goes, and of
detections of equal extent the one of the earlier rule stays. Of those left that overlap in part, the
one of the earlier rule stays, then the longer, then the first.

Rules for notices, addresses and spellings are written one by one (``NOTICES``, ``ADDRESSES``,
``SPELLINGS``); the names of licenses (``LICENSES``) are put into each of the phrases in which a
license is named. Texts are scanned where they lie; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Rules see lower-case words of letters, digits and non-ASCII signs, parted by single spaces: "GPL-2.0+"
# is read as "gpl 2 0", "https://opensource.org/licenses/MIT" as "https opensource org licenses mit".

# Label, keywords, pattern, weight: sentences of license texts and of the notices put above files.
NOTICES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "permission", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.9),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1.0),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-2", "apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", 1.0),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.8),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 0.8),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", "endorse", r"the names? of (?:\S+ ){1,8}may not be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgements?", 1.0),
    ("bsd-0-clause", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: with or)? without fee is hereby granted", 1.0),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 1.0),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("gpl-2-or-later", "general", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: inc)? either version 2(?: 0)? of the license or at your option any later version", 1.0),
    ("gpl-3-or-later", "general", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: inc)? either version 3(?: 0)? of the license or at your option any later version", 1.0),
    ("gpl-2", "general", r"under the terms of (?:the )?gnu general public license(?: as published by the free software foundation(?: inc)?)? version 2(?: 0)?(?: only)?", 1.0),
    ("gpl-3", "general", r"under the terms of (?:the )?gnu general public license(?: as published by the free software foundation(?: inc)?)? version 3(?: 0)?(?: only)?", 1.0),
    ("lgpl-2.1-or-later", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation(?: inc)? either version 2 1 of the license or at your option any later version", 1.0),
    ("lgpl-3-or-later", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation(?: inc)? either version 3(?: 0)? of the license or at your option any later version", 1.0),
    ("lgpl-2-or-later", "library", r"under the terms of the gnu library general public license as published by the free software foundation(?: inc)? either version 2(?: 0)? of the license or at your option any later version", 1.0),
    ("agpl-3-or-later", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation(?: inc)? either version 3(?: 0)? of the license or at your option any later version", 1.0),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license(?: as published by the free software foundation(?: inc)?)? version 3(?: 0)?", 1.0),
    ("gpl", "general", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)", 0.8),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file|package)", 0.8),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file|package)", 0.8),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1", "eclipse", r"are made available under the terms of the eclipse public license v ?1 0", 1.0),
    ("epl-2", "eclipse", r"are made available under the terms of the eclipse public license (?:v ?)?2 0", 1.0),
    ("cddl-1", "development", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl-1", "common", r"are made available under the terms of the common public license v ?1 0", 1.0),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0", 1.0),
    ("boost-1", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "public", r"do what (?:the fuck )?you want to public license", 1.0),
    ("cc0-1", "waived", r"to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights", 1.0),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("artistic-2", "artistic", r"redistribute it and or modify it under the(?: terms of the)? artistic license(?: version)? 2 0", 1.0),
    ("perl", "perl", r"(?:you can redistribute it and or modify it )?under the same terms as perl(?: 5)? itself", 1.0),
    ("ruby", "ruby", r"under the (?:same )?terms (?:as|of) ruby(?: s license)?", 0.9),
    ("vim", "vim", r"under the (?:same )?terms (?:as|of) (?:the )?vim(?: license)?(?: itself)?", 0.9),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 1.0),
    ("json", "evil", r"the software shall be used for good not evil", 1.0),
    ("proprietary", "proprietary", r"(?:this is )?(?:unpublished )?proprietary (?:and confidential|source code|software|information)", 0.7),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))* of this (?:file|software|program|document|material)", 0.7),
    ("no-commercial", "commercial*", r"(?:for )?non ?commercial use only", 0.6),
    ("evaluation", "evaluation", r"for evaluation (?:purposes )?only", 0.5),
]

# Label, keywords, pattern, weight: addresses and identifiers.
ADDRESSES = [
    ("mit", "opensource", r"opensource org licenses? mit(?: license)?(?: php| html)?", 1.0),
    ("apache-2", "apache", r"apache org licenses license 2 0", 1.0),
    ("apache-2", "opensource", r"opensource org licenses? apache ?2 0", 1.0),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause", 1.0),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause", 1.0),
    ("bsd", "opensource", r"opensource org licenses? bsd license", 0.9),
    ("isc", "opensource", r"opensource org licenses? isc(?: license)?", 1.0),
    ("zlib", "opensource", r"opensource org licenses? zlib", 1.0),
    ("gpl-2", "opensource", r"opensource org licenses? gpl 2 0", 1.0),
    ("gpl-3", "opensource", r"opensource org licenses? gpl 3 0", 1.0),
    ("lgpl-2.1", "opensource", r"opensource org licenses? lgpl 2 1", 1.0),
    ("lgpl-3", "opensource", r"opensource org licenses? lgpl 3 0", 1.0),
    ("agpl-3", "opensource", r"opensource org licenses? agpl(?: v3| 3 0)", 1.0),
    ("mpl-2", "opensource", r"opensource org licenses? mpl 2 0", 1.0),
    ("artistic-2", "opensource", r"opensource org licenses? artistic license 2 0", 1.0),
    ("gpl-2", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0", 1.0),
    ("gpl-3", "gnu", r"gnu org licenses gpl 3 0", 1.0),
    ("gpl", "gnu", r"gnu org licenses gpl(?: html| txt)?", 0.9),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1", 1.0),
    ("lgpl-3", "gnu", r"gnu org licenses lgpl 3 0", 1.0),
    ("lgpl", "gnu", r"gnu org licenses lgpl(?: html| txt)?", 0.9),
    ("agpl-3", "gnu", r"gnu org licenses agpl 3 0", 1.0),
    ("agpl", "gnu", r"gnu org licenses agpl(?: html| txt)?", 0.9),
    ("gfdl-1.3", "gnu", r"gnu org licenses fdl 1 3", 1.0),
    ("gfdl", "gnu", r"gnu org licenses fdl(?: html| txt)?", 0.9),
    ("gnu", "gnu", r"see (?:https? )?(?:www )?gnu org licenses", 0.6),
    ("mpl-2", "mozilla", r"mozilla org (?:en us )?mpl 2 0", 1.0),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1", 1.0),
    ("epl-1", "eclipse", r"eclipse org legal epl v10", 1.0),
    ("epl-2", "eclipse", r"eclipse org legal epl (?:v20|2 0)", 1.0),
    ("boost-1", "boost", r"boost org license 1 0", 1.0),
    ("unlicense", "unlicense", r"unlicense org", 1.0),
    ("wtfpl", "wtfpl", r"wtfpl net", 1.0),
    ("cc0-1", "creativecommons", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("ofl-1.1", "scripts", r"scripts sil org ofl", 1.0),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl", 1.0),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by", 1.0),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl", 1.0),
    ("php-3", "php", r"php net license 3 0", 1.0),
    ("cecill-2.1", "cecill", r"cecill info licences licence cecill v2 1", 1.0),
    ("cecill", "cecill", r"cecill info licences?", 0.9),
    ("eupl", "joinup", r"joinup ec europa eu (?:\S+ ){0,3}eupl", 0.9),
    ("mit", "spdx", r"spdx license identifier mit", 1.0),
    ("mit-0", "spdx", r"spdx license identifier mit 0", 1.0),
    ("isc", "spdx", r"spdx license identifier isc", 1.0),
    ("zlib", "spdx", r"spdx license identifier zlib", 1.0),
    ("unlicense", "spdx", r"spdx license identifier unlicense", 1.0),
    ("wtfpl", "spdx", r"spdx license identifier wtfpl", 1.0),
    ("apache-2", "spdx", r"spdx license identifier apache 2 0", 1.0),
    ("bsd-0-clause", "spdx", r"spdx license identifier 0bsd", 1.0),
    ("bsd-1-clause", "spdx", r"spdx license identifier bsd 1 clause", 1.0),
    ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?: patent)?", 1.0),
    ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?: clear)?", 1.0),
    ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause", 1.0),
    ("gpl-2", "spdx", r"spdx license identifier gpl 2 0(?: only)?", 1.0),
    ("gpl-2-or-later", "spdx", r"spdx license identifier gpl 2 0 or later", 1.0),
    ("gpl-3", "spdx", r"spdx license identifier gpl 3 0(?: only)?", 1.0),
    ("gpl-3-or-later", "spdx", r"spdx license identifier gpl 3 0 or later", 1.0),
    ("lgpl-2", "spdx", r"spdx license identifier lgpl 2 0(?: only)?", 1.0),
    ("lgpl-2-or-later", "spdx", r"spdx license identifier lgpl 2 0 or later", 1.0),
    ("lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only)?", 1.0),
    ("lgpl-2.1-or-later", "spdx", r"spdx license identifier lgpl 2 1 or later", 1.0),
    ("lgpl-3", "spdx", r"spdx license identifier lgpl 3 0(?: only)?", 1.0),
    ("lgpl-3-or-later", "spdx", r"spdx license identifier lgpl 3 0 or later", 1.0),
    ("agpl-3", "spdx", r"spdx license identifier agpl 3 0(?: only)?", 1.0),
    ("agpl-3-or-later", "spdx", r"spdx license identifier agpl 3 0 or later", 1.0),
    ("mpl-2", "spdx", r"spdx license identifier mpl 2 0", 1.0),
    ("epl-2", "spdx", r"spdx license identifier epl 2 0", 1.0),
    ("boost-1", "spdx", r"spdx license identifier bsl 1 0", 1.0),
    ("cc0-1", "spdx", r"spdx license identifier cc0 1 0", 1.0),
    ("ofl-1.1", "spdx", r"spdx license identifier ofl 1 1", 1.0),
    ("artistic-2", "spdx", r"spdx license identifier artistic 2 0", 1.0),
    ("postgresql", "spdx", r"spdx license identifier postgresql", 1.0),
    ("eupl-1.2", "spdx", r"spdx license identifier eupl 1 2", 1.0),
]

# Label, keywords, pattern, weight: short spellings of a license that stand by themselves.
SPELLINGS = [
    ("gpl-2-or-later", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?2(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("gpl-3-or-later", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("lgpl-2.1-or-later", "lgpl", r"(?:gnu )?lgpl ?(?:v ?|version )?2 1 or (?:any )?later(?: version)?", 0.9),
    ("lgpl-3-or-later", "lgpl", r"(?:gnu )?lgpl ?(?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("agpl-3-or-later", "agpl", r"(?:gnu )?agpl ?(?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("gpl-2", "gpl", r"gpl 2 0 only", 0.9),
    ("gpl-3", "gpl", r"gpl 3 0 only", 0.9),
    ("gpl-2", "gpl", r"gplv2", 0.8),
    ("gpl-3", "gpl", r"gplv3", 0.8),
    ("lgpl-2.1", "lgpl", r"lgplv2 1", 0.8),
    ("lgpl-2", "lgpl", r"lgplv2", 0.8),
    ("lgpl-3", "lgpl", r"lgplv3", 0.8),
    ("agpl-3", "agpl", r"agplv3", 0.8),
    ("mpl-2", "mpl", r"mplv2(?: 0)?", 0.8),
    ("gpl-2-classpath", "classpath", r"gpl ?(?:v ?|version )?2(?: 0)? (?:only )?with (?:the )?classpath exception", 1.0),
    ("gpl-3-gcc", "gcc", r"gpl ?(?:v ?|version )?3(?: 0)? with (?:the )?gcc (?:runtime library )?exception", 1.0),
    ("mit-or-apache-2", "mit", r"(?<!identifier )(?<!or )(?<!and )mit (?:or|and) apache(?: license)?(?: version)? ?2(?: 0)?", 0.9),
    ("mit-or-apache-2", "apache", r"(?<!identifier )(?<!or )(?<!and )apache(?: license)?(?: version)? ?2(?: 0)? (?:or|and) mit", 0.9),
    ("mit-or-gpl", "mit", r"(?:dual licensed|licensed) under (?:both )?(?:the )?mit (?:or|and) (?:the )?gpl(?: version ?[23])?(?: licenses?)?", 0.9),
    ("bsd-2-clause", "bsd", r"bsd 2 clause", 0.8),
    ("bsd-3-clause", "bsd", r"bsd 3 clause", 0.8),
    ("bsd-4-clause", "bsd", r"bsd 4 clause", 0.8),
    ("bsd-0-clause", "0bsd", r"0bsd", 0.8),
    ("apache-2", "apache", r"apache ?(?:license )?v2", 0.8),
    ("apache-2", "apache", r"apache 2 0", 0.7),
    ("cc0-1", "cc0", r"cc0 1 0(?: universal)?", 0.9),
    ("cc0", "cc0", r"cc0(?: universal)?", 0.8),
    ("cc0", "zero", r"creative commons zero", 0.8),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:into |in |to )?the public domain", 0.8),
    ("public-domain", "domain", r"public domain (?:dedication|work|software)", 0.6),
    ("all-rights-reserved", "reserved", r"all rights reserved", 0.5),
    ("gpl", "general", r"gnu general public license", 0.6),
    ("lgpl", "lesser", r"gnu lesser general public license", 0.6),
    ("lgpl", "library", r"gnu library general public license", 0.6),
    ("agpl", "affero", r"gnu affero general public license", 0.6),
    ("gfdl", "documentation", r"gnu free documentation license", 0.6),
    ("mpl", "mozilla", r"mozilla public license", 0.6),
    ("epl", "eclipse", r"eclipse public license", 0.6),
    ("gpl-1", "general", r"gnu general public license(?: version| v)? ?1(?: 0)?", 0.8),
    ("gpl-2", "general", r"gnu general public license(?: version| v)? ?2(?: 0)?(?: only)?", 0.8),
    ("gpl-3", "general", r"gnu general public license(?: version| v)? ?3(?: 0)?(?: only)?", 0.8),
    ("gpl-2-or-later", "general", r"gnu general public license(?: version| v)? ?2(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("gpl-3-or-later", "general", r"gnu general public license(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?", 0.9),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license(?: version| v)? ?2 1(?: only)?", 0.8),
    ("lgpl-3", "lesser", r"gnu lesser general public license(?: version| v)? ?3(?: 0)?(?: only)?", 0.8),
    ("lgpl-2", "library", r"gnu library general public license(?: version| v)? ?2(?: 0)?(?: only)?", 0.8),
    ("agpl-3", "affero", r"gnu affero general public license(?: version| v)? ?3(?: 0)?(?: only)?", 0.8),
    ("gpl-2", "gnu", r"gnu gpl ?(?:version |v ?)?2(?: 0)?(?: only)?", 0.8),
    ("gpl-3", "gnu", r"gnu gpl ?(?:version |v ?)?3(?: 0)?(?: only)?", 0.8),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v ?)?2 1(?: only)?", 0.8),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?(?: only)?", 0.8),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?(?: only)?", 0.8),
    ("gpl", "gpl", r"gpl", 0.4),
    ("lgpl", "lgpl", r"lgpl", 0.4),
    ("agpl", "agpl", r"agpl", 0.4),
    ("artistic-2", "artistic", r"artistic license(?: version| v)? ?2(?: 0)?", 0.8),
    ("elastic-2", "elastic", r"elastic license(?: version| v)? ?2(?: 0)?", 0.8),
    ("elastic", "elastic", r"elastic license", 0.6),
    ("sspl-1", "sspl", r"sspl ?(?:version |v ?)?1(?: 0)?", 0.8),
    ("sspl", "side", r"server side public license", 0.8),
    ("busl-1.1", "business", r"business source license(?: version| v)? ?1 1", 0.9),
    ("busl", "business", r"business source license", 0.7),
    ("mulan-psl-2", "mulan", r"mulan (?:permissive software license|psl)(?: version| v)? ?2(?: 0)?", 0.9),
    ("blueoak-1", "blue", r"blue oak model license(?: version| v)? ?1(?: 0)?(?: 0)?", 0.9),
    ("upl-1", "universal", r"universal permissive license(?: version| v)? ?1(?: 0)?", 0.9),
    ("polyform-noncommercial-1", "polyform", r"polyform non ?commercial license(?: version| v)? ?1(?: 0)?(?: 0)?", 0.9),
    ("openrail", "openrail", r"(?:creativeml )?(?:big ?science )?openrail(?: ?m)?", 0.8),
]

# Label, keywords, and the spellings of the license's name, to be put into each of ``PHRASES``.
LICENSES = [
    ("mit", "mit expat x11", r"(?:mit|expat|mit x11|x11)"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? v?1 1"),
    ("apache-2", "apache asl", r"(?:apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?|asl ?2(?: 0)?)"),
    ("bsd-2-clause", "bsd*", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd*", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd*", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("gpl-1", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?1"),
    ("gpl-2", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2"),
    ("gpl-3", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?"),
    ("lgpl-2", "lgpl", r"(?:gnu )?lgpl ?(?:version |v ?)?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v ?)?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license (?:version|v) ?2 1"),
    ("lgpl-3", "lesser", r"gnu lesser general public license (?:version|v) ?3"),
    ("lgpl-2", "library", r"gnu library general public license (?:version|v) ?2"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?"),
    ("agpl-3", "affero", r"gnu affero general public license (?:version|v) ?3"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl ?(?:version |v ?)?1 1"),
    ("mpl-2", "mpl", r"mpl ?(?:version |v ?)?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "development", r"common development and distribution license(?: version| v)? ?1(?: 0)?"),
    ("cddl-1", "cddl", r"cddl ?(?:version |v ?)?1(?: 0)?"),
    ("cpl-1", "common", r"common public license(?: version| v)? ?1(?: 0)?"),
    ("artistic-1", "artistic", r"artistic license(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic license(?: version| v)? ?2(?: 0)?"),
    ("boost-1", "boost", r"boost software license(?: version| v)? ?1(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("eupl-1.1", "union", r"european union public licen[cs]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "union", r"european union public licen[cs]e(?: version| v)? ?1 2"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: version| v)? ?1 1"),
    ("odbl-1", "database", r"open (?:data commons open )?database license(?: version| v)? ?1(?: 0)?"),
    ("pddl-1", "dedication", r"public domain dedication and license(?: version| v)? ?1(?: 0)?"),
    ("psf-2", "python", r"python software foundation license(?: version| v)? ?2(?: 0)?"),
    ("php-3", "php", r"php license(?: version| v)? ?3(?: 0| 01)?"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("osl-3", "open", r"open software license(?: version| v)? ?3(?: 0)?"),
    ("afl-3", "academic", r"academic free license(?: version| v)? ?3(?: 0)?"),
    ("gfdl-1.2", "documentation", r"gnu free documentation license(?: version| v)? ?1 2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation license(?: version| v)? ?1 3"),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("sspl-1", "side", r"server side public license(?: version| v)? ?1(?: 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("mpl", "mpl", r"mpl"),
    ("epl", "epl", r"epl"),
    ("artistic", "artistic", r"artistic"),
]

# The parts of the Creative Commons names, and the versions.
CC_PARTS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:s|atives)"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives)")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# The phrases in which a license is named, with their weight and a string that all of them hold.
PHRASES = [
    (r"spdx license identifier {}", 1.0, "licen"),
    (r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{}", 0.95, " under "),
    (r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{} licen[cs]e", 0.9, " under "),
    (r"licen[cs]e {}", 0.8, "licen"),
    (r"{} licen[cs]ed?", 0.7, "licen"),
]


#: How an identifier begins.
SPDX = "spdx license identifier "
# Labels and spellings of the exceptions that follow "with" in an identifier's expression.
EXCEPTIONS = [("classpath-exception", "classpath exception 2 0"), ("gcc-exception", "gcc exception 3 1"), ("llvm-exception", "llvm exception"), ("linux-syscall-note", "linux syscall note")]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]  # one of them stands in all that the rule matches
    pattern: str
    priority: int  # 0 is best; rules of one place in the order are told apart by their number
    weight: float
    also: str = ""  # a second string without which the rule can't match


def keywords_of(spelled: str) -> tuple[str, ...]:
    """"gpl" stands at the beginning of a word, "bsd*" anywhere."""
    return tuple(k[:-1] if k.endswith("*") else f" {k}" for k in spelled.split())


def rules() -> list[Rule]:
    """All rules in order of priority."""
    out: list[Rule] = []
    for at, own in enumerate((NOTICES, ADDRESSES)):
        out += [Rule(label, keywords_of(keywords), pattern, at, weight) for label, keywords, pattern, weight in own]
    for part, _ in CC_PARTS:
        for v in CC_VERSIONS:
            out.append(Rule(f"cc-{part}-{v.replace(' ', '.')}", (" creativecommons",), rf"creativecommons org licenses {part.replace('-', ' ')} {v}", 1, 1.0))
    names = list(LICENSES)
    for part, name in CC_PARTS:
        short = part.replace("-", " ")
        for v in CC_VERSIONS:
            label = f"cc-{part}-{v.replace(' ', '.')}"
            names.append((label, "cc", rf"cc {short} {v}"))
            names.append((label, "creative", rf"creative commons {name}(?: {v}|(?: international| unported)? licen[cs]e {v})"))
    for at, (phrase, weight, also) in enumerate(PHRASES, 2):
        for label, keywords, name in names:
            out.append(Rule(label, keywords_of(keywords), phrase.format(name), at, weight, also))
    last = 2 + len(PHRASES)
    # Behind the first name of an identifier's expression stand others; a detection is the name alone.
    named = [(r.label, r.pattern.removeprefix(SPDX)) for r in out if r.priority == 1 and r.pattern.startswith(SPDX)]
    first = "|".join(sorted((p for _, p in named), key=len, reverse=True))
    for label, name in [*named, *EXCEPTIONS]:
        out.append(Rule(label, (" spdx",), rf"{SPDX}(?:(?:{first}) (?:or|and|with) )(?:(?:{first}|{'|'.join(p for _, p in EXCEPTIONS)}) (?:or|and|with) ){{0,6}}(?P<name>{name})", last, 1.0))
    for part, name in CC_PARTS:
        for v in CC_VERSIONS:
            label = f"cc-{part}-{v.replace(' ', '.')}"
            out.append(Rule(label, (" attribution",), rf"{name} {v}(?: international| unported| generic)?(?: public)? licen[cs]e", last, 0.8))
    for part, name in CC_PARTS:
        out.append(Rule(f"cc-{part}", (" cc",), rf"cc {part.replace('-', ' ')}(?: \d \d)?", last, 0.7))
        out.append(Rule(f"cc-{part}", (" creative",), rf"creative commons {name}", last, 0.7))
    out += [Rule(label, keywords_of(keywords), pattern, last + 1, weight) for label, keywords, pattern, weight in SPELLINGS]
    return out


# Of the bytes of lower-case UTF-8 text, digits, letters and all of non-ASCII belong to words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Scanner:
    """Compiled rules behind one keyword automaton. Matches are whole words."""

    def __init__(self, own: list[Rule]):
        self.own = own
        self.compiled = [re.compile(rf"(?<= ){r.pattern}(?= )") for r in own]
        self.named = ["name" if "name" in c.groupindex else 0 for c in self.compiled]  # where a detection lies
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(own):
            for keyword in r.keywords:
                by.setdefault(keyword, []).append(i)
        for phrase in BASE_PHRASES:
            by.setdefault(f" {phrase} ", [])
        for keyword, numbers in by.items():
            self.automaton.add_word(keyword, (keyword, numbers))
        self.automaton.make_automaton()
        self.also = sorted({r.also for r in own} - {""})

    def __call__(self, text: bytes | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """(words, base places, first and last start, base labels, all labels, score)."""
        found = words(text)
        plain = b" " + b" ".join(found) + b" "
        line = plain.decode()
        gates = dict(x[1] for x in self.automaton.iter(line))
        if not gates:
            return len(found), 0, None, None, [], [], 0.0
        starts, base = [], set()
        for phrase, label in BASE_PHRASES.items():
            if f" {phrase} " in gates:
                starts += [m.start() for m in re.finditer(rf"(?= {phrase} )", line)]
                base.add(label)
        first, last = (line.count(" ", 0, at(starts)) if starts else None for at in (min, max))
        hits = [(m.start(self.named[i]), m.end(self.named[i]), self.own[i].priority, i) for i in self.open(gates, line) for m in self.compiled[i].finditer(line)]
        kept = suppress(hits)
        labels = base | {self.own[h[3]].label for h in kept}
        score = max([1.0] * bool(base) + [self.own[h[3]].weight for h in kept], default=0.0)
        return len(found), len(starts), first, last, sorted(base), sorted(labels), score

    def open(self, gates: dict[str, list[int]], line: str) -> list[int]:
        """The rules one of whose keywords is there, and their second string too."""
        there = {"", *(x for x in self.also if x in line)}
        return sorted({i for numbers in gates.values() for i in numbers if self.own[i].also in there})


def suppress(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, end, priority, rule) that stay, by start: none inside a longer one, of equal
    extents the first by priority and rule; and of those that overlap in part the first by priority,
    then the longer, then the first in the text."""
    outer: list[tuple[int, int, int, int]] = []
    reach = -1
    for h in sorted(hits, key=lambda h: (h[0], -h[1], h[2], h[3])):
        if h[1] > reach:
            outer.append(h)
            reach = h[1]
    # None holds another, so starts and ends rise together, and a detection meets its neighbours only.
    place = {h: i for i, h in enumerate(outer)}
    gone: set[int] = set()
    kept: list[tuple[int, int, int, int]] = []
    for h in sorted(outer, key=lambda h: (h[2], h[0] - h[1], h[0])):
        i = place[h]
        if i in gone:
            continue
        kept.append(h)
        for step in (-1, 1):
            k = i + step
            while 0 <= k < len(outer) and outer[k][0] < h[1] and h[0] < outer[k][1]:
                gone.add(k)
                k += step
    return sorted(kept)


_TYPES = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_ARROW = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules())
    for batch in batches:
        rows = [scanner(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows)) if rows else [[] for _ in _ARROW]
        cols[4:6] = [[",".join(x) for x in c] for c in cols[4:6]]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, (_, t) in zip(cols, _ARROW))], ["id", *(n for n, _ in _ARROW)])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start in words, else null),
    ``base_labels`` and ``labels`` (distinct, sorted, comma-joined) and ``score``: 1 for a base
    phrase, else the largest weight of a detection that stays, 0 without any.

    Defined cases: null, empty and wordless texts have no words, no labels and a score of 0; null and
    repeated ids are rows of their own; an empty table gives an empty table. Other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(_scan, f"id {kind}, {_TYPES}").withColumnRenamed("id", id_col)
