"""Signature rules of the license scan, written by hand, in their order.

A rule is (label, keywords, pattern, priority, confidence). Patterns are of lower-case words joined by one space and match
whole words; of its keywords each matching text holds one at least. Smaller priorities go first: 0 for identifiers that
machines read, 1 for sentences of license texts and notices, 2 for names with a version and for links, 3 for bare names,
4 for hints.
"""

IDENTIFIERS = [
    ("mit", ("spdx",), r"spdx licen[sc]e identifier mit(?: 0)?", 0, 1.0),
    ("apache", ("spdx",), r"spdx licen[sc]e identifier apache (?:2 0|1 1|1 0)", 0, 1.0),
    ("gpl", ("spdx",), r"spdx licen[sc]e identifier gpl [123] 0(?: only| or later)?", 0, 1.0),
    ("lgpl", ("spdx",), r"spdx licen[sc]e identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?", 0, 1.0),
    ("agpl", ("spdx",), r"spdx licen[sc]e identifier agpl [13] 0(?: only| or later)?", 0, 1.0),
    ("gfdl", ("spdx",), r"spdx licen[sc]e identifier gfdl 1 [123](?: only| or later)?", 0, 1.0),
    ("bsd", ("spdx",), r"spdx licen[sc]e identifier (?:bsd [0234] clause|0bsd)(?: patent| clear)?", 0, 1.0),
    ("isc", ("spdx",), r"spdx licen[sc]e identifier isc", 0, 1.0),
    ("mpl", ("spdx",), r"spdx licen[sc]e identifier mpl (?:1 0|1 1|2 0)", 0, 1.0),
    ("epl", ("spdx",), r"spdx licen[sc]e identifier epl [12] 0", 0, 1.0),
    ("edl", ("spdx",), r"spdx licen[sc]e identifier edl 1 0", 0, 1.0),
    ("cddl", ("spdx",), r"spdx licen[sc]e identifier cddl 1 [01]", 0, 1.0),
    ("eupl", ("spdx",), r"spdx licen[sc]e identifier eupl 1 [012]", 0, 1.0),
    ("ms-pl", ("spdx",), r"spdx licen[sc]e identifier ms pl", 0, 1.0),
    ("ms-rl", ("spdx",), r"spdx licen[sc]e identifier ms rl", 0, 1.0),
    ("artistic", ("spdx",), r"spdx licen[sc]e identifier artistic [12] 0", 0, 1.0),
    ("zlib", ("spdx",), r"spdx licen[sc]e identifier zlib", 0, 1.0),
    ("bsl", ("spdx",), r"spdx licen[sc]e identifier bsl 1 0", 0, 1.0),
    ("busl", ("spdx",), r"spdx licen[sc]e identifier busl 1 1", 0, 1.0),
    ("sspl", ("spdx",), r"spdx licen[sc]e identifier sspl 1 0", 0, 1.0),
    ("elastic", ("spdx",), r"spdx licen[sc]e identifier elastic 2 0", 0, 1.0),
    ("wtfpl", ("spdx",), r"spdx licen[sc]e identifier wtfpl", 0, 1.0),
    ("unlicense", ("spdx",), r"spdx licen[sc]e identifier unlicense", 0, 1.0),
    ("psf", ("spdx",), r"spdx licen[sc]e identifier (?:psf 2 0|python 2 0)", 0, 1.0),
    ("php", ("spdx",), r"spdx licen[sc]e identifier php 3 0[1]?", 0, 1.0),
    ("zpl", ("spdx",), r"spdx licen[sc]e identifier zpl (?:1 1|2 0|2 1)", 0, 1.0),
    ("postgresql", ("spdx",), r"spdx licen[sc]e identifier postgresql", 0, 1.0),
    ("ncsa", ("spdx",), r"spdx licen[sc]e identifier ncsa", 0, 1.0),
    ("openssl", ("spdx",), r"spdx licen[sc]e identifier openssl", 0, 1.0),
    ("curl", ("spdx",), r"spdx licen[sc]e identifier curl", 0, 1.0),
    ("w3c", ("spdx",), r"spdx licen[sc]e identifier w3c", 0, 1.0),
    ("x11", ("spdx",), r"spdx licen[sc]e identifier x11", 0, 1.0),
    ("ofl", ("spdx",), r"spdx licen[sc]e identifier ofl 1 [01]", 0, 1.0),
    ("odbl", ("spdx",), r"spdx licen[sc]e identifier odbl 1 0", 0, 1.0),
    ("cc-by", ("spdx",), r"spdx licen[sc]e identifier cc by [1234] [05]", 0, 1.0),
    ("cc-by-sa", ("spdx",), r"spdx licen[sc]e identifier cc by sa [1234] [05]", 0, 1.0),
    ("cc-by-nc", ("spdx",), r"spdx licen[sc]e identifier cc by nc [1234] [05]", 0, 1.0),
    ("cc-by-nd", ("spdx",), r"spdx licen[sc]e identifier cc by nd [1234] [05]", 0, 1.0),
    ("cc-by-nc-sa", ("spdx",), r"spdx licen[sc]e identifier cc by nc sa [1234] [05]", 0, 1.0),
    ("cc-by-nc-nd", ("spdx",), r"spdx licen[sc]e identifier cc by nc nd [1234] [05]", 0, 1.0),
    ("cc0", ("spdx",), r"spdx licen[sc]e identifier cc0 1 0", 0, 1.0),
    ("mulan", ("spdx",), r"spdx licen[sc]e identifier mulanpsl [12] 0", 0, 1.0),
    ("mit", ("osi approved",), r"licen[sc]e osi approved mit licen[sc]e", 0, 1.0),
    ("apache", ("osi approved",), r"licen[sc]e osi approved apache software licen[sc]e", 0, 1.0),
    ("bsd", ("osi approved",), r"licen[sc]e osi approved bsd licen[sc]e", 0, 1.0),
    ("gpl", ("osi approved",), r"licen[sc]e osi approved gnu general public licen[sc]e(?: v[23])?(?: or later)?", 0, 1.0),
    ("mpl", ("osi approved",), r"licen[sc]e osi approved mozilla public licen[sc]e 2 0", 0, 1.0),
    ("psf", ("osi approved",), r"licen[sc]e osi approved python software foundation licen[sc]e", 0, 1.0),
]

SENTENCES = [
    ("mit", ("hereby granted",), r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?", 1, 1.0),
    ("mit", ("sell copies",), r"rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software", 1, 1.0),
    ("mit", ("substantial portions",), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1, 1.0),
    ("mit", ("authors or copyright holders",), r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 1, 0.9),
    ("mit", ("mit licen",), r"(?:is )?(?:distributed|released|available|provided|published|shared) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e", 1, 0.95),
    ("mit", ("mit licen",), r"(?:dual )?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e", 1, 0.95),
    ("json", ("good not evil",), r"the software shall be used for good not evil", 1, 1.0),
    ("x11", ("x consortium",), r"except as contained in this notice the name of the x consortium shall not be used in advertising", 1, 1.0),
    ("hpnd", ("without fee",), r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?and without fee", 1, 0.9),
    ("isc", ("with or without fee",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1, 1.0),
    ("0bsd", ("with or without fee",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted without conditions", 1, 1.0),
    ("bsd", ("source and binary forms",), r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 1, 1.0),
    ("bsd", ("redistributions of source code",), r"redistributions of source code must retain the above copyright notice this list of conditions", 1, 1.0),
    ("bsd", ("redistributions in binary form",), r"redistributions in binary form must reproduce the above copyright notice", 1, 1.0),
    ("bsd", ("endorse or promote",), r"neither the name of (?:the )?\w+(?: \w+){0,8} nor the names of its contributors may be used to endorse or promote products", 1, 1.0),
    ("bsd", ("advertising materials",), r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment", 1, 1.0),
    ("bsd", ("bsd",), r"use of this source code is governed by a bsd style licen[sc]e", 1, 1.0),
    ("bsd", ("bsd",), r"(?:is )?(?:licen[sc]ed|distributed|released|available) under (?:the )?(?:terms of )?(?:the )?(?:new |modified |simplified |revised |[234] clause )?bsd(?: [234] clause)? licen[sc]e", 1, 0.95),
    ("apache", ("apache",), r"licen[sc]ed under the apache licen[sc]e(?: version 2 0| 2 0)?(?: the licen[sc]e)?", 1, 1.0),
    ("apache", ("apache",), r"(?:is )?(?:distributed|released|available|provided|published|shared) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e", 1, 0.95),
    ("apache", ("except in compliance",), r"you may not use this file except in compliance with the licen[sc]e", 1, 0.9),
    ("apache", ("distributed on an as is basis",), r"distributed on an as is basis without warranties or conditions of any kind", 1, 0.9),
    ("apache", ("apache software foundation",), r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 1, 1.0),
    ("gpl", ("free software",), r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1, 1.0),
    ("gpl", ("gnu general public",), r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file)", 1, 1.0),
    ("gpl", ("general public",), r"either version [123] of the licen[sc]e or at your option any later version of the (?:gnu )?general public licen[sc]e", 1, 0.9),
    ("gpl", ("general public",), r"(?:is )?(?:licen[sc]ed|distributed|released|available|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e", 1, 0.95),
    ("gpl", ("gpl",), r"(?:is )?(?:licen[sc]ed|distributed|released|available) under (?:the )?(?:gnu )?gpl(?:v?[123]| v[123]| version [123])?", 1, 0.9),
    ("lgpl", ("lesser general public",), r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation", 1, 1.0),
    ("lgpl", ("library general public",), r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation", 1, 1.0),
    ("lgpl", ("lgpl",), r"(?:is )?(?:licen[sc]ed|distributed|released|available) under (?:the )?(?:gnu )?lgpl(?:v?[23]| v[23](?: 1)?)?", 1, 0.9),
    ("agpl", ("affero",), r"under the terms of the gnu affero general public licen[sc]e(?: as published by the free software foundation)?", 1, 1.0),
    ("agpl", ("agpl",), r"(?:is )?(?:licen[sc]ed|distributed|released|available) under (?:the )?(?:gnu )?agpl(?:v?3| v3)?", 1, 0.9),
    ("gfdl", ("free documentation",), r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1, 1.0),
    ("mpl", ("mozilla public",), r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1, 1.0),
    ("mpl", ("mozilla public",), r"the contents of this file are subject to the mozilla public licen[sc]e(?: version 1 [01])?", 1, 1.0),
    ("epl", ("eclipse public",), r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 1, 1.0),
    ("edl", ("eclipse distribution",), r"under the terms of the eclipse distribution licen[sc]e", 1, 1.0),
    ("cddl", ("common development",), r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1, 1.0),
    ("cpl", ("common public licen",), r"made available under the terms of the common public licen[sc]e", 1, 1.0),
    ("ibm-pl", ("ibm public",), r"provided under the terms of this ibm public licen[sc]e", 1, 1.0),
    ("eupl", ("eupl", "european union public"), r"licen[sc]ed under the (?:eupl|european union public licen[sc]e)(?: version)?(?: 1 [012])?", 1, 1.0),
    ("ms-pl", ("microsoft public",), r"this (?:source code|software) is subject to the terms of the microsoft public licen[sc]e", 1, 1.0),
    ("ms-rl", ("microsoft reciprocal",), r"this (?:source code|software) is subject to the terms of the microsoft reciprocal licen[sc]e", 1, 1.0),
    ("artistic", ("perl itself", "same terms as perl"), r"redistribute it and or modify it under the same terms as perl(?: itself)?", 1, 1.0),
    ("artistic", ("artistic",), r"under the terms of the (?:perl )?artistic licen[sc]e", 1, 0.95),
    ("zlib", ("altered source versions",), r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 1.0),
    ("zlib", ("origin of this software",), r"the origin of this software must not be misrepresented", 1, 1.0),
    ("zlib", ("held liable for any damages",), r"in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.9),
    ("bsl", ("boost software",), r"distributed under the boost software licen[sc]e(?: version 1 0)?", 1, 1.0),
    ("bsl", ("machine executable object code",), r"solely in the form of machine executable object code generated by a source language processor", 1, 1.0),
    ("busl", ("change date",), r"on the change date or the fourth anniversary of the first publicly available distribution", 1, 1.0),
    ("sspl", ("service source code",), r"make the service source code available via network download to everyone at no charge", 1, 1.0),
    ("elastic", ("hosted or managed service",), r"you may not provide the software to third parties as a hosted or managed service", 1, 1.0),
    ("commons-clause", ("right to sell",), r"does not grant to you the right to sell the software", 1, 1.0),
    ("wtfpl", ("just do what the f",), r"you just do what the f\w+ you want to", 1, 1.0),
    ("wtfpl", ("verbatim or modified copies of this",), r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", 1, 0.9),
    ("beerware", ("beer",), r"you can buy me a beer in return", 1, 1.0),
    ("unlicense", ("unencumbered",), r"this is free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", ("compiled binary",), r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 1, 1.0),
    ("psf", ("python software foundation", "psf hereby"), r"psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e|licen[sc]e agreement is between the python software foundation", 1, 1.0),
    ("ruby", ("ruby",), r"under the same terms as ruby(?: itself)?|under the terms of the ruby licen[sc]e", 1, 0.95),
    ("php", ("php licen",), r"this source file is subject to version 3 01 of the php licen[sc]e", 1, 1.0),
    ("zpl", ("zope public",), r"this software is subject to the provisions of the zope public licen[sc]e", 1, 1.0),
    ("postgresql", ("university of california be liable",), r"in no event shall the university of california be liable to any party", 1, 0.9),
    ("ncsa", ("with the software without restriction",), r"to deal with the software without restriction including without limitation the rights", 1, 1.0),
    ("openssl", ("openssl",), r"this product includes software developed by the openssl project", 1, 1.0),
    ("curl", ("curl",), r"this software is licen[sc]ed as described in the file copying(?: which)?(?: you should have received)?(?: as part of this distribution)?(?: the terms are also available at https curl se docs copyright html)", 1, 1.0),
    ("w3c", ("w3c",), r"this work is (?:being )?provided by the copyright holders under the following licen[sc]e w3c", 1, 1.0),
    ("ofl", ("open font",), r"this font software is licen[sc]ed under the sil open font licen[sc]e(?: version 1 1)?", 1, 1.0),
    ("ofl", ("reserved font name",), r"with reserved font name", 1, 0.9),
    ("odbl", ("open database",), r"(?:made )?available under the open database licen[sc]e", 1, 1.0),
    ("odc-by", ("open data commons attribution",), r"(?:made )?available under the open data commons attribution licen[sc]e", 1, 1.0),
    ("pddl", ("public domain dedication and licen",), r"(?:made )?available under the public domain dedication and licen[sc]e", 1, 1.0),
    ("ogl", ("open government",), r"contains public sector information licen[sc]ed under the open government licen[sc]e", 1, 1.0),
    ("open-game", ("open game content",), r"designation of open game content", 1, 0.9),
    ("osl", ("open software licen",), r"licen[sc]ed under the open software licen[sc]e(?: version)?(?: [123] 0)?", 1, 1.0),
    ("afl", ("academic free",), r"licen[sc]ed under the academic free licen[sc]e(?: version)?(?: [123] [01])?", 1, 1.0),
    ("ecl", ("educational community",), r"licen[sc]ed under the educational community licen[sc]e(?: version)?(?: [12] 0)?", 1, 1.0),
    ("apsl", ("apple public source",), r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e", 1, 1.0),
    ("vim", ("vim licen",), r"distributed under the vim licen[sc]e", 1, 0.95),
    ("cecill", ("cecill",), r"this software is governed by the cecill(?: [abc])? licen[sc]e under french law", 1, 1.0),
    ("mulan", ("mulan",), r"is licen[sc]ed under mulan psl v[12]", 1, 1.0),
    ("openrail", ("responsible ai",), r"licen[sc]ed under (?:a |the )?responsible ai licen[sc]e", 1, 1.0),
    ("llama", ("llama",), r"llama \d(?: \d)? is licen[sc]ed under the llama \d(?: \d)? community licen[sc]e", 1, 1.0),
    ("gemma", ("gemma",), r"gemma is provided under and subject to the gemma terms of use", 1, 1.0),
    ("cc-by", ("creative commons attribution",), r"licen[sc]ed under (?:a |the )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc-by-sa", ("attribution sharealike", "attribution share alike"), r"licen[sc]ed under (?:a |the )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc-by-nc", ("attribution noncommercial", "attribution non commercial"), r"licen[sc]ed under (?:a |the )?creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc-by-nd", ("attribution noderiv", "attribution no deriv"), r"licen[sc]ed under (?:a |the )?creative commons attribution no ?deriv(?:ative|atives|s)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc-by-nc-sa", ("commercial sharealike", "commercial share alike"), r"licen[sc]ed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc-by-nc-nd", ("commercial noderiv", "commercial no deriv"), r"licen[sc]ed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0),
    ("cc0", ("cc0", "waived all copyright"), r"(?:dedicated|released|available) (?:to the public domain )?under (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?|has waived all copyright and related or neighboring rights to this work", 1, 1.0),
    ("public-domain", ("public domain",), r"(?:released|placed|dedicated|contributed) (?:in|into|to) the public domain", 2, 0.9),
    ("public-domain", ("no copyright",), r"no copyright is claimed(?: in the united states)?", 2, 0.8),
    ("proprietary", ("all rights reserved",), r"all rights reserved", 3, 0.7),
    ("proprietary", ("without",), r"may not be (?:copied|reproduced|distributed|published|broadcast|rewritten)(?: or \w+| \w+ or \w+)* without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 2, 0.9),
    ("proprietary", ("proprietary and confidential",), r"(?:this \w+ is )?proprietary and confidential", 2, 0.9),
    ("proprietary", ("unauthorized copying",), r"unauthorized copying of this (?:file|software|document|work)(?: via any medium)?(?: is)?(?: strictly)?(?: prohibited)?", 2, 0.9),
    ("proprietary", ("end user licen",), r"(?:subject to|governed by|read) (?:the |this )?end user licen[sc]e agreement", 2, 0.9),
    ("proprietary", ("trade secret",), r"contains (?:the )?(?:valuable )?(?:confidential information and )?trade secrets?(?: of| belonging to)", 2, 0.8),
    ("proprietary", ("for internal use only",), r"for internal use only(?: do not distribute)?", 2, 0.6),
    ("proprietary", ("personal",), r"for (?:your )?personal (?:non commercial )?use only", 2, 0.6),
    ("non-commercial", ("commercial",), r"(?:for )?non ?commercial (?:use|purposes) only", 2, 0.8),
    ("non-commercial", ("commercial use is",), r"commercial use is (?:strictly )?(?:prohibited|not permitted|not allowed|forbidden)", 2, 0.8),
    ("research-only", ("academic", "research"), r"for (?:academic|research)(?: and (?:educational|research))? (?:use|purposes) only", 2, 0.8),
    ("royalty-free", ("royalty free",), r"(?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?royalty free(?: irrevocable)? (?:copyright |patent )?licen[sc]e", 3, 0.5),
    ("copyright", ("copyright",), r"copyright (?:c )?(?:19|20)\d\d", 4, 0.3),
    ("copyright", ("protected by copyright",), r"protected by copyright(?: law| laws)?", 4, 0.4),
    ("copyright", ("used with permission", "reprinted with permission"), r"(?:used|reprinted) with permission(?: of the author| from the publisher)?", 4, 0.4),
    ("public-domain", ("public domain",), r"public domain", 4, 0.4),
]

LINKS = [
    ("mit", ("opensource org",), r"opensource org licen[sc]es? mit", 2, 0.9),
    ("apache", ("apache org",), r"(?:www )?apache org licen[sc]es(?: licen[sc]e 2 0)?", 2, 0.9),
    ("gpl", ("gnu org",), r"(?:www )?gnu org (?:licen[sc]es|copyleft)(?: gpl)?(?: [23] 0)?", 2, 0.9),
    ("lgpl", ("gnu org",), r"(?:www )?gnu org licen[sc]es(?: old licen[sc]es)? lgpl(?: [23] [01])?", 2, 0.9),
    ("agpl", ("gnu org",), r"(?:www )?gnu org licen[sc]es agpl(?: 3 0)?", 2, 0.9),
    ("gfdl", ("gnu org",), r"(?:www )?gnu org licen[sc]es fdl(?: 1 [123])?", 2, 0.9),
    ("bsd", ("opensource org",), r"opensource org licen[sc]es? bsd(?: [23] clause| licen[sc]e php)?", 2, 0.9),
    ("isc", ("opensource org",), r"opensource org licen[sc]es? isc", 2, 0.9),
    ("mpl", ("mozilla org",), r"(?:www )?mozilla org mpl(?: [12] [01])?", 2, 0.9),
    ("epl", ("eclipse org",), r"(?:www )?eclipse org legal epl(?: v10| 2 0| v20)?", 2, 0.9),
    ("edl", ("eclipse org",), r"(?:www )?eclipse org org documents edl v10", 2, 0.9),
    ("eupl", ("joinup ec europa eu",), r"joinup ec europa eu \w+(?: \w+)* eupl", 2, 0.9),
    ("bsl", ("boost org",), r"(?:www )?boost org licen[sc]e 1 0", 2, 0.9),
    ("unlicense", ("unlicense org",), r"(?:www )?unlicense org", 2, 0.9),
    ("wtfpl", ("wtfpl net",), r"(?:www )?wtfpl net", 2, 0.9),
    ("psf", ("docs python org",), r"docs python org 3 licen[sc]e", 2, 0.9),
    ("ofl", ("scripts sil org", "openfontlicense org"), r"scripts sil org ofl|openfontlicense org", 2, 0.9),
    ("odbl", ("opendatacommons org",), r"opendatacommons org licen[sc]es odbl", 2, 0.9),
    ("odc-by", ("opendatacommons org",), r"opendatacommons org licen[sc]es by", 2, 0.9),
    ("pddl", ("opendatacommons org",), r"opendatacommons org licen[sc]es pddl", 2, 0.9),
    ("ogl", ("nationalarchives gov uk",), r"nationalarchives gov uk doc open government licen[sc]e", 2, 0.9),
    ("cc-by", ("creativecommons org",), r"creativecommons org licen[sc]es by(?: [1234] [05])?", 2, 0.9),
    ("cc-by-sa", ("creativecommons org",), r"creativecommons org licen[sc]es by sa(?: [1234] [05])?", 2, 0.9),
    ("cc-by-nc", ("creativecommons org",), r"creativecommons org licen[sc]es by nc(?: [1234] [05])?", 2, 0.9),
    ("cc-by-nd", ("creativecommons org",), r"creativecommons org licen[sc]es by nd(?: [1234] [05])?", 2, 0.9),
    ("cc-by-nc-sa", ("creativecommons org",), r"creativecommons org licen[sc]es by nc sa(?: [1234] [05])?", 2, 0.9),
    ("cc-by-nc-nd", ("creativecommons org",), r"creativecommons org licen[sc]es by nc nd(?: [1234] [05])?", 2, 0.9),
    ("cc0", ("creativecommons org",), r"creativecommons org publicdomain zero(?: 1 0)?", 2, 0.9),
    ("public-domain", ("creativecommons org",), r"creativecommons org publicdomain mark(?: 1 0)?", 2, 0.9),
]

NAMES = [
    ("mit", ("mit",), r"(?:the )?mit(?: x11)? licen[sc]e", 3, 0.6),
    ("mit", ("expat",), r"(?:the )?expat(?: mit)? licen[sc]e", 3, 0.6),
    ("apache", ("apache",), r"apache(?: software)? licen[sc]e(?: version| v)? ?(?:2 0|1 1|1 0)", 2, 0.85),
    ("apache", ("apache",), r"apache(?: software)? licen[sc]e", 3, 0.6),
    ("agpl", ("affero",), r"(?:gnu )?affero general public licen[sc]e(?: version 3| v3)", 2, 0.85),
    ("agpl", ("affero",), r"(?:gnu )?affero general public licen[sc]e", 3, 0.6),
    ("lgpl", ("lesser", "library"), r"(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version (?:2 1|2|3)| v(?:2 1|2|3))", 2, 0.85),
    ("lgpl", ("lesser", "library"), r"(?:gnu )?(?:lesser|library) general public licen[sc]e", 3, 0.6),
    ("gpl", ("general public",), r"(?:gnu )?general public licen[sc]e(?: version [123]| v[123])(?: or later)?", 2, 0.85),
    ("gpl", ("general public",), r"(?:gnu )?general public licen[sc]e", 3, 0.6),
    ("gpl", ("gpl",), r"(?:gnu )?gpl ?v?[23](?: 0)?(?: only| or later)?", 3, 0.6),
    ("gfdl", ("free documentation",), r"(?:gnu )?free documentation licen[sc]e(?: version 1 [123])?", 2, 0.85),
    ("bsd", ("bsd",), r"(?:new|modified|simplified|revised|original) bsd licen[sc]e", 2, 0.85),
    ("bsd", ("bsd",), r"(?:[234] clause bsd|bsd [234] clause) licen[sc]e", 2, 0.85),
    ("bsd", ("bsd",), r"bsd(?: style| like| type)? licen[sc]e", 3, 0.6),
    ("isc", ("isc",), r"isc licen[sc]e", 3, 0.6),
    ("mpl", ("mozilla public",), r"mozilla public licen[sc]e(?: version| v)? ?(?:2 0|1 1|1 0)", 2, 0.85),
    ("mpl", ("mozilla public",), r"mozilla public licen[sc]e", 3, 0.6),
    ("epl", ("eclipse public",), r"eclipse public licen[sc]e(?: version| v)? ?[12] 0", 2, 0.85),
    ("epl", ("eclipse public",), r"eclipse public licen[sc]e", 3, 0.6),
    ("edl", ("eclipse distribution",), r"eclipse distribution licen[sc]e", 3, 0.6),
    ("cddl", ("common development",), r"common development and distribution licen[sc]e(?: version 1 [01])?", 2, 0.85),
    ("cpl", ("common public licen",), r"common public licen[sc]e(?: version 1 0)?", 3, 0.6),
    ("cpal", ("common public attribution",), r"common public attribution licen[sc]e(?: version 1 0)?", 2, 0.85),
    ("ibm-pl", ("ibm public",), r"ibm public licen[sc]e(?: version 1 0)?", 3, 0.6),
    ("eupl", ("european union public",), r"european union public licen[sc]e(?: v? ?1 [012])?", 2, 0.85),
    ("ms-pl", ("microsoft public",), r"microsoft public licen[sc]e", 3, 0.6),
    ("ms-rl", ("microsoft reciprocal",), r"microsoft reciprocal licen[sc]e", 3, 0.6),
    ("artistic", ("artistic",), r"(?:perl )?artistic licen[sc]e(?: version| v)? ?[12] 0", 2, 0.85),
    ("artistic", ("artistic",), r"(?:perl |the )?artistic licen[sc]e", 3, 0.6),
    ("zlib", ("zlib",), r"zlib(?: libpng)? licen[sc]e", 3, 0.6),
    ("libpng", ("libpng",), r"libpng licen[sc]e(?: version 2)?", 3, 0.6),
    ("bsl", ("boost software",), r"boost software licen[sc]e(?: version 1 0| 1 0)?", 2, 0.85),
    ("busl", ("business source",), r"business source licen[sc]e(?: 1 1)?", 2, 0.85),
    ("sspl", ("server side public",), r"server side public licen[sc]e(?: version 1| v1)?", 2, 0.85),
    ("elastic", ("elastic licen",), r"elastic licen[sc]e(?: 2 0)?", 3, 0.6),
    ("commons-clause", ("commons clause",), r"commons clause licen[sc]e condition(?: v1 0)?", 2, 0.85),
    ("wtfpl", ("do what the f",), r"do what the f\w+ you want to public licen[sc]e", 2, 0.85),
    ("wtfpl", ("wtfpl",), r"wtfpl(?: licen[sc]e| version 2| v2)", 3, 0.6),
    ("unlicense", ("unlicense",), r"the unlicense", 3, 0.6),
    ("beerware", ("beerware", "beer ware"), r"beer ?ware licen[sc]e", 2, 0.85),
    ("psf", ("python",), r"python software foundation licen[sc]e(?: version 2)?", 2, 0.85),
    ("psf", ("python",), r"python licen[sc]e", 3, 0.5),
    ("ruby", ("ruby",), r"(?:the )?ruby licen[sc]e", 3, 0.6),
    ("php", ("php",), r"php licen[sc]e(?: version 3 0(?: 1)?| v3 01)?", 3, 0.6),
    ("zend", ("zend",), r"zend(?: engine)? licen[sc]e(?: version 2 0)?", 3, 0.6),
    ("zpl", ("zope public",), r"zope public licen[sc]e(?: version (?:1 1|2 [01]))?", 2, 0.85),
    ("postgresql", ("postgresql",), r"postgresql licen[sc]e", 3, 0.6),
    ("ncsa", ("ncsa",), r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", 3, 0.6),
    ("openssl", ("openssl",), r"openssl(?: and ssleay)? licen[sc]e", 3, 0.6),
    ("curl", ("curl",), r"curl licen[sc]e", 3, 0.6),
    ("w3c", ("w3c",), r"w3c (?:software|document)(?: notice)?(?: and)? licen[sc]e", 2, 0.85),
    ("w3c", ("w3c",), r"w3c licen[sc]e", 3, 0.6),
    ("x11", ("x11",), r"x11 licen[sc]e", 3, 0.6),
    ("hpnd", ("historical permission",), r"historical permission notice and disclaimer", 2, 0.85),
    ("json", ("json licen",), r"json licen[sc]e", 3, 0.6),
    ("ofl", ("open font",), r"sil open font licen[sc]e(?: version 1 1| 1 1)?", 2, 0.85),
    ("ofl", ("open font",), r"open font licen[sc]e", 3, 0.6),
    ("odbl", ("open database",), r"open database licen[sc]e(?: v1 0| 1 0)?", 2, 0.85),
    ("odc-by", ("open data commons",), r"open data commons attribution licen[sc]e(?: v1 0| 1 0)?", 2, 0.85),
    ("pddl", ("public domain dedication",), r"public domain dedication and licen[sc]e(?: v1 0| 1 0)?", 2, 0.85),
    ("ogl", ("open government",), r"open government licen[sc]e(?: v[123](?: 0)?| version [123](?: 0)?)?", 2, 0.85),
    ("open-game", ("open game", "open gaming"), r"open gam(?:e|ing) licen[sc]e(?: version 1 0a)?", 2, 0.85),
    ("osl", ("open software licen",), r"open software licen[sc]e(?: version [123] 0| [123] 0)?", 3, 0.6),
    ("afl", ("academic free",), r"academic free licen[sc]e(?: [123] [0123])?", 2, 0.85),
    ("ecl", ("educational community",), r"educational community licen[sc]e(?: [12] 0)?", 2, 0.85),
    ("apsl", ("apple public source",), r"apple public source licen[sc]e(?: [12] [012])?", 2, 0.85),
    ("qpl", ("q public", "qpl"), r"q public licen[sc]e(?: version 1 0)?|qpl licen[sc]e", 2, 0.85),
    ("sleepycat", ("sleepycat",), r"sleepycat licen[sc]e", 3, 0.6),
    ("vim", ("vim",), r"vim licen[sc]e", 3, 0.6),
    ("cecill", ("cecill",), r"cecill(?: [abc])?(?: free software)? licen[sc]e(?: agreement)?", 2, 0.85),
    ("mulan", ("mulan",), r"mulan permissive software licen[sc]e(?: v?[12])?", 2, 0.85),
    ("openrail", ("openrail", "open rail"), r"(?:creativeml )?open ?rail(?: m| \+\+)? licen[sc]e", 2, 0.85),
    ("openrail", ("responsible ai",), r"responsible ai licen[sc]es?", 3, 0.6),
    ("llama", ("llama",), r"llama \d(?: \d)? community licen[sc]e(?: agreement)?", 2, 0.85),
    ("gemma", ("gemma terms",), r"gemma terms of use", 2, 0.85),
    ("cc-by-nc-sa", ("by nc sa",), r"(?:cc|creative commons) by nc sa(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.85),
    ("cc-by-nc-nd", ("by nc nd",), r"(?:cc|creative commons) by nc nd(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.85),
    ("cc-by-nc", ("by nc",), r"(?:cc|creative commons) by nc(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.8),
    ("cc-by-sa", ("by sa",), r"(?:cc|creative commons) by sa(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.85),
    ("cc-by-nd", ("by nd",), r"(?:cc|creative commons) by nd(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.85),
    ("cc-by", ("cc by", "creative commons by"), r"(?:cc|creative commons) by(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.75),
    ("cc-by-sa", ("sharealike", "share alike"), r"creative commons attribution share ?alike(?: [1234] [05])?", 2, 0.85),
    ("cc-by-nc", ("noncommercial", "non commercial"), r"creative commons attribution non ?commercial(?: [1234] [05])?", 2, 0.8),
    ("cc-by", ("creative commons attribution",), r"creative commons attribution(?: [1234] [05])?(?: licen[sc]e)?", 2, 0.75),
    ("cc0", ("cc0",), r"cc0(?: 1 0)? universal(?: public domain dedication)?|cc0 1 0|cc0 licen[sc]e", 3, 0.6),
    ("shareware", ("shareware",), r"(?:this (?:program|software) is |distributed as )shareware", 2, 0.7),
    ("freeware", ("freeware",), r"(?:this (?:program|software) is |distributed as )freeware", 2, 0.7),
]

SIGNATURES = [*IDENTIFIERS, *SENTENCES, *LINKS, *NAMES]
