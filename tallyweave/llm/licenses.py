"""License scans by ordered signature rules, in Catalyst expressions only.

Rules are regular expressions over normalised words: signatures written for one license each (its text, its title,
its address), and phrases around the names of licenses. A group of rules is tried on a document only if one of its
keywords stands in it, and one of its phrase's anchors, and if the union of its patterns matches. Detections are intervals
of words; one that lies within another, or covers the same words with lower priority, is suppressed. Everything
happens inside the row: no shuffle, no Python, and time in proportion to the text.
"""

from __future__ import annotations

import json
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that are always reported, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label | keywords, of which a text must hold one | name in normalised words | SPDX identifier in normalised words.
NAMES = r"""
mit | mit/expat | (?:mit|expat)(?: x11)? | mit
mit-0 | mit | mit no attribution | mit 0
apache-1 | apache | apache (?:software )?licen[cs]e (?:version |v)?1(?: [01])? | apache 1 [01]
apache-2 | apache | apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)? | apache 2 0
apache | apache | apache(?: software)? | apache
bsd-2 | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) | bsd 2 clause
bsd-3 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) | bsd 3 clause
bsd-4 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd) | bsd 4 clause
bsd-0 | bsd | (?:zero clause bsd|bsd zero clause|0bsd) | 0bsd
bsd | bsd | bsd(?: style)? | bsd
gpl-1 | gpl/general public | (?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2 | gpl/general public | (?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3 | gpl/general public | (?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?3(?: 0)? | gpl 3 0(?: only| or later)?
gpl | gpl/general public | (?:gnu (?:gpl|general public)|gpl|general public) | gpl
lgpl-2 | lgpl/general public | (?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e) ?(?:version |v)?2(?: [01])? | lgpl 2 [01](?: only| or later)?
lgpl-3 | lgpl/general public | (?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v)?3(?: 0)? | lgpl 3 0(?: only| or later)?
lgpl | lgpl/general public | (?:gnu )?(?:lgpl|(?:lesser|library) general public) | lgpl
agpl-3 | agpl/affero | (?:gnu )?(?:agpl|affero general public licen[cs]e) ?(?:version |v)?3(?: 0)? | agpl 3 0(?: only| or later)?
agpl | agpl/affero | (?:gnu )?(?:agpl|affero general public) | agpl
gfdl | gfdl/free documentation | (?:gfdl|gnu free documentation) | gfdl 1 [123](?: only| or later)?
mpl-1 | mpl/mozilla | (?:mpl|mozilla public licen[cs]e) ?(?:version |v)?1(?: [01])? | mpl 1 [01]
mpl-2 | mpl/mozilla | (?:mpl|mozilla public licen[cs]e) ?(?:version |v)?2(?: 0)? | mpl 2 0
mpl | mpl/mozilla | (?:mpl|mozilla public) | mpl
epl-1 | epl/eclipse | (?:epl|eclipse public licen[cs]e) ?(?:version |v)?1(?: 0)? | epl 1 0
epl-2 | epl/eclipse | (?:epl|eclipse public licen[cs]e) ?(?:version |v)?2(?: 0)? | epl 2 0
epl | epl/eclipse | eclipse public | epl
edl | edl/eclipse | eclipse distribution | edl 1 0
cddl | cddl/common development | (?:cddl|common development and distribution) | cddl 1 [01]
cpl | cpl/common public | common public | cpl 1 0
eupl | eupl/european union | (?:eupl|european union public) | eupl 1 [012]
cecill | cecill | cecill(?: [bc])? | cecill(?: [bc12])?(?: \d)?
isc | isc | isc | isc
zlib | zlib | zlib(?: libpng)? | zlib
libpng | libpng | libpng | libpng
unlicense | unlicense | unlicense | unlicense
wtfpl | wtfpl/do what | (?:wtfpl|do what the fuck you want to public) | wtfpl
boost | boost/bsl | (?:boost software|bsl) | bsl 1 0
artistic | artistic | (?:perl )?artistic | artistic [12] 0
python | python/psf | (?:python software foundation|psf) | (?:psf|python) 2 0
ruby | ruby | ruby | ruby
php | php | php | php 3 0 ?1?
postgresql | postgresql | postgresql | postgresql
openssl | openssl | openssl | openssl
curl | curl | curl | curl
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? | ncsa
ms-pl | ms pl/microsoft | (?:ms pl|microsoft public) | ms pl
ms-rl | ms rl/microsoft | (?:ms rl|microsoft reciprocal) | ms rl
osl | osl/open software | (?:osl|open software) | osl 3 0
afl | afl/academic | (?:afl|academic free) | afl 3 0
qpl | qpl/q public | (?:qpl|q public) | qpl 1 0
lppl | lppl/latex | (?:lppl|latex project public) | lppl 1 [0-3]c?
ofl | ofl/open font | (?:ofl|(?:sil )?open font) | ofl 1 [01]
upl | upl/universal | (?:upl|universal permissive) | upl 1 0
vim | vim | vim | vim
w3c | w3c | w3c(?: software)? | w3c
x11 | x11 | x11 | x11
odbl | odbl/open database | (?:odbl|open database|open data commons open database) | odbl 1 0
odc-by | odc/open data commons | (?:odc by|open data commons attribution) | odc by 1 0
pddl | pddl/public domain | (?:pddl|public domain dedication and) | pddl 1 0
bsl | busl/business source | business source | busl 1 1
sspl | sspl/server side | (?:sspl|server side public) | sspl 1 0
elastic | elastic | elastic(?: 2 0)? | elastic 2 0
polyform | polyform | polyform (?:noncommercial|small business|shield|strict) | polyform noncommercial 1 0 0
rail | rail | (?:creativeml )?(?:open )?rail(?: m)? | (?:open )?rail
llama | llama | llama(?: [23])? community | llama ?[23]?
cc0 | cc0/cc zero/creative commons | (?:cc0|cc zero|creative commons zero) | cc0 1 0
cc-by-nc-nd | cc by/creative commons | (?:cc by nc nd|creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives))(?: [1-4] [05])? | cc by nc nd [1-4] [05]
cc-by-nc-sa | cc by/creative commons | (?:cc by nc sa|creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike))(?: [1-4] [05])? | cc by nc sa [1-4] [05]
cc-by-nc | cc by/creative commons | (?:cc by nc|creative commons attribution (?:noncommercial|non commercial))(?: [1-4] [05])? | cc by nc [1-4] [05]
cc-by-nd | cc by/creative commons | (?:cc by nd|creative commons attribution (?:noderivatives|noderivs|no derivatives))(?: [1-4] [05])? | cc by nd [1-4] [05]
cc-by-sa | cc by/creative commons | (?:cc by sa|creative commons attribution (?:sharealike|share alike))(?: [1-4] [05])? | cc by sa [1-4] [05]
cc-by | cc by/creative commons | (?:cc by|creative commons attribution)(?: [1-4] [05])? | cc by [1-4] [05]
"""

# Label | priority | weight | keywords, of which a text must hold one | signature of that license.
SIGNATURES = r"""
mit | 1 | 0.95 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | 0.8 | mit | opensource org licenses? mit(?: license)?(?: php)?
mit | 4 | 0.7 | mit | (?:dual|triple|tri) licen[cs]ed (?:under )?mit
mit-0 | 3 | 0.8 | mit 0 | opensource org licenses? mit 0
apache-2 | 1 | 0.95 | apache | licen[cs]ed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 3 | 0.8 | apache | apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?
apache-2 | 2 | 0.85 | apache | apache licen[cs]e version 2 0 january 2004
apache-2 | 4 | 0.7 | apache | (?:apl|asl|al) ?2 0 apache|apache (?:v2|2)(?: 0)? licen[cs]ed
apache-1 | 3 | 0.8 | apache | apache org licen[cs]es licen[cs]e 1 [01](?: txt)?
bsd-2 | 3 | 0.8 | bsd | opensource org licenses? bsd 2 clause(?: php)?
bsd-3 | 3 | 0.8 | bsd | opensource org licenses? bsd 3 clause(?: php)?
bsd-3 | 1 | 0.9 | endorse or promote | neither the name of (?:the )?(?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4 | 1 | 0.9 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd | 4 | 0.6 | bsd | bsd style licen[cs]e|use of this source code is governed by a bsd
bsd-0 | 1 | 0.9 | copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
gpl-1 | 3 | 0.8 | gpl | gnu org licen[cs]es gpl 1 0
gpl-2 | 3 | 0.8 | gpl | gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0
gpl-3 | 3 | 0.8 | gpl | gnu org licen[cs]es gpl 3 0
gpl | 3 | 0.7 | gpl | gnu org (?:copyleft|licen[cs]es) gpl(?: html| txt)?
gpl-2 | 1 | 0.95 | general public | (?:under the terms of the )?gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3 | 1 | 0.95 | general public | (?:under the terms of the )?gnu general public license as published by the free software foundation (?:either )?version 3
gpl-2 | 2 | 0.9 | general public | gnu general public license version 2 june 1991
gpl-3 | 2 | 0.9 | general public | gnu general public license version 3 29 june 2007
gpl | 1 | 0.9 | general public | you should have received a copy of the gnu general public license
lgpl-2 | 1 | 0.95 | general public | (?:under the terms of the )?gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version 2(?: [01])?
lgpl-3 | 1 | 0.95 | general public | (?:under the terms of the )?gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-2 | 2 | 0.9 | general public | gnu lesser general public license version 2 1 february 1999
lgpl-2 | 2 | 0.9 | general public | gnu library general public license version 2 june 1991
lgpl | 3 | 0.7 | lgpl | gnu org (?:copyleft|licen[cs]es) (?:old licen[cs]es )?lgpl(?: [23])?(?: [01])?
lgpl | 1 | 0.9 | general public | you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3 | 1 | 0.95 | affero | (?:under the terms of the )?gnu affero general public license as published by the free software foundation (?:either )?version 3
agpl-3 | 2 | 0.9 | affero | gnu affero general public license version 3 19 november 2007
agpl-3 | 3 | 0.8 | agpl | gnu org licen[cs]es agpl(?: 3 0)?
gfdl | 1 | 0.95 | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 3 | 0.8 | fdl | gnu org (?:copyleft|licen[cs]es) fdl(?: 1 [123])?
mpl-2 | 1 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 3 | 0.8 | mpl | mozilla org (?:en us )?mpl 2 0
mpl-1 | 1 | 0.95 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1 | 3 | 0.8 | mpl | mozilla org mpl mpl 1 [01]
epl-1 | 3 | 0.8 | epl | eclipse org (?:legal |org documents )?epl v10
epl-2 | 3 | 0.8 | epl | eclipse org (?:legal |org documents )?epl (?:2 0|v20)
epl-1 | 2 | 0.9 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | 2 | 0.9 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v 2 0|2 0)
edl | 3 | 0.8 | edl | eclipse org org documents edl v10
cddl | 1 | 0.9 | common development | the contents of this file are subject to the terms of the common development and distribution license
cddl | 3 | 0.8 | cddl | opensource org licenses? cddl(?: 1 0)?
cpl | 3 | 0.8 | cpl | opensource org licenses? cpl(?: 1 0)?
eupl | 1 | 0.95 | eupl | licen[cs]ed under the eupl(?: version 1 [012])?
eupl | 3 | 0.8 | eupl | joinup ec europa eu (?:\S+ ){0,4}eupl
cecill | 1 | 0.9 | cecill | governed by the cecill(?: [bc])? license under french law
cecill | 3 | 0.8 | cecill | cecill info licences(?: licence cecill)?
isc | 1 | 0.95 | copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 3 | 0.8 | isc | opensource org licenses? isc(?: license)?
zlib | 1 | 0.95 | express or implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | 3 | 0.8 | zlib | (?:opensource org licenses?|zlib net) zlib(?: license)?(?: html)?
unlicense | 1 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 3 | 0.8 | unlicense | unlicense org
wtfpl | 1 | 0.95 | do what | you just do what the fuck you want to
wtfpl | 3 | 0.8 | wtfpl | wtfpl net
boost | 1 | 0.95 | boost | distributed under the boost software license version 1 0
boost | 3 | 0.8 | boost | boost org licen[cs]e 1 0(?: txt)?
boost | 2 | 0.9 | boost | boost software license version 1 0 august 17th 2003
artistic | 2 | 0.9 | artistic | the artistic license 2 0 copyright
artistic | 1 | 0.9 | perl itself | this (?:library|program|module|software|code) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself
artistic | 3 | 0.8 | artistic | opensource org licenses? artistic licen[cs]e(?: 2 0)?
python | 2 | 0.9 | python | python software foundation license version 2
python | 3 | 0.8 | python | docs python org (?:\S+ ){0,2}license
ruby | 1 | 0.8 | ruby | (?:under the same terms as ruby|ruby s licen[cs]e)
php | 3 | 0.8 | php | php net licen[cs]e 3 01(?: txt)?
php | 1 | 0.9 | php | this source file is subject to version 3 01 of the php license
postgresql | 3 | 0.8 | postgresql | opensource org licenses? postgresql
openssl | 1 | 0.9 | openssl | this product includes software developed by the openssl project
curl | 3 | 0.8 | curl | curl (?:haxx )?se docs copyright
ncsa | 1 | 0.9 | ncsa | university of illinois ncsa open source license copyright
ms-pl | 3 | 0.8 | ms pl | opensource org licenses? ms pl
ms-rl | 3 | 0.8 | ms rl | opensource org licenses? ms rl
osl | 1 | 0.9 | open software | licen[cs]ed under the open software license version 3 0
afl | 1 | 0.9 | academic free | licen[cs]ed under the academic free license version [23] [01]
lppl | 1 | 0.95 | latex project | may be distributed and or modified under the conditions of the latex project public license
lppl | 3 | 0.8 | lppl | latex project org lppl
ofl | 1 | 0.95 | open font | this font software is licensed under the sil open font license version 1 [01]
ofl | 3 | 0.8 | ofl | (?:scripts sil org|openfontlicense org)(?: ofl)?
upl | 1 | 0.9 | universal permissive | the universal permissive license upl version 1 0
w3c | 2 | 0.9 | w3c | w3c software (?:and document )?notice and license
w3c | 3 | 0.8 | w3c | w3 org consortium legal (?:\S+ ){0,2}copyright software
x11 | 1 | 0.8 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
odbl | 1 | 0.95 | open database | made available under the open database license
odbl | 3 | 0.8 | odbl | opendatacommons org licenses odbl(?: 1 0)?
odc-by | 3 | 0.8 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl | 3 | 0.8 | pddl | opendatacommons org licenses pddl(?: 1 0)?
bsl | 2 | 0.9 | business source | business source license 1 1 parameters
bsl | 3 | 0.8 | bsl11 | mariadb com bsl11
sspl | 2 | 0.9 | server side | server side public license version 1 october 16 2018
sspl | 3 | 0.8 | mongodb | mongodb com (?:legal )?licensing server side public license
elastic | 2 | 0.9 | elastic | licensed under the elastic license 2 0 you may not use this file
elastic | 3 | 0.8 | elastic | elastic co licensing elastic license
polyform | 3 | 0.8 | polyform | polyformproject org licenses (?:noncommercial|small business|shield|strict) 1 0 0
rail | 2 | 0.9 | rail | creativeml open rail m dated august 22 2022
rail | 3 | 0.8 | responsible ai | responsible ai licen[cs]es?
llama | 2 | 0.9 | llama | llama [23] (?:[12] )?community license agreement
llama | 3 | 0.8 | llama | built with (?:meta )?llama(?: [23])?
cc0 | 1 | 0.95 | cc0 | to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
cc0 | 3 | 0.85 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 3 | 0.8 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | 3 | 0.85 | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | 3 | 0.85 | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | 3 | 0.85 | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | 3 | 0.85 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 3 | 0.85 | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 3 | 0.85 | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc-by | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution [1-4] [05] (?:international|unported|generic) license
cc-by-sa | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) license
cc-by-nc | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) license
cc-by-nc-sa | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic) license
cc-by-nd | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution no ?(?:derivatives|derivs) [1-4] [05] (?:international|unported|generic) license
cc-by-nc-nd | 2 | 0.9 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?(?:derivatives|derivs) [1-4] [05] (?:international|unported|generic) license
ogl | 1 | 0.9 | open government | contains public sector information licen[cs]ed under the open government licence(?: v[123] 0)?
ogl | 3 | 0.8 | open government | nationalarchives gov uk doc open government licence
proprietary | 2 | 0.8 | trade secret | (?:confidential and proprietary|proprietary and confidential)(?: information)? (?:and )?(?:\S+ ){0,3}trade secrets?
proprietary | 3 | 0.7 | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|document|work|software|material) )?(?:\S+ ){0,4}(?:is )?strictly prohibited
all-rights-reserved | 3 | 0.7 | no part of this | no part of this (?:publication|book|document|work|website) may be reproduced
"""

# What is not the name of one license.
OTHERS = r"""
public-domain | public domain | (?:dedicated to|placed in|released (?:in)?to|in|within) the public domain
all-rights-reserved | rights reserved | all rights reserved
proprietary | proprietary | (?:proprietary and confidential|proprietary licen[cs]e)
copyleft | copyleft | copyleft
as-is | warranty | (?:provided )?as is without warranty of any kind
mit-text | permission | permission is hereby granted free of charge to any person obtaining a copy
bsd-text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc-text | permission | permission to use copy modify and or distribute this software for any purpose
zlib-text | misrepresented | the origin of this software must not be misrepresented
gpl-text | redistribute | you can redistribute it and or modify it under the terms of the gnu
unlicense-text | unencumbered | this is free and unencumbered software released into the public domain
"""

# Priority | weight | anchors, of which a text must hold one | phrase around {name}, or around the identifier {spdx}.
PHRASES = r"""
1 | 1.0 | spdx licen | spdx licen[cs]e identifier {spdx}
2 | 0.95 | ed under/able under/to you under | (?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|issued|offered|shared) (?:to you )?under (?:a |an |the )?(?:terms (?:and conditions )?of (?:a |an |the )?)?{name}(?: international)?(?: public)?(?: licen[cs]es?)?
3 | 0.85 | licen | (?:subject to|governed by|in accordance with|permitted by|compatible with|under) (?:a |an |the )?(?:terms (?:and conditions )?of (?:a |an |the )?)?{name}(?: international)?(?: public)? licen[cs]es?
4 | 0.7 | licen | (?:this )?licen[cs]e (?:is |type |name |used )?{name}
5 | 0.5 | licen | (?:a |an |the )?{name}(?: international)?(?: public)? licen[cs]es?
"""


class Rule(NamedTuple):
    label: str
    keywords: list[str]
    pattern: str
    priority: int
    weight: float
    base: bool
    anchors: list[str] = []


def _rows(table: str) -> list[list[str]]:
    """Cells of a table above; a bar inside brackets is the pattern's own, and has no spaces around it."""
    return [line.split(" | ") for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules, base phrases first, then by priority and in the order of the tables."""
    whole = "(?<![^ ])(?:{})(?![^ ])".format
    out = [Rule(label, [phrase], whole(phrase), 0, 1.0, True) for phrase, label in BASE.items()]
    for priority, weight, anchors, phrase in _rows(PHRASES):
        for label, keywords, name, spdx in _rows(NAMES):
            pattern = phrase.replace("{name}", f"(?:{name})").replace("{spdx}", spdx)
            out.append(Rule(label, keywords.split("/"), whole(pattern), int(priority), float(weight), False, anchors.split("/")))
    out += [Rule(label, keywords.split("/"), whole(pattern), 6, 0.6, False) for label, keywords, pattern in _rows(OTHERS)]
    out += [Rule(label, keywords.split("/"), whole(pattern), int(priority), float(weight), False) for label, priority, weight, keywords, pattern in _rows(SIGNATURES)]
    return out


_RULES_TYPE = "array<struct<label:string,keywords:array<string>,pattern:string,priority:int,weight:double,base:boolean>>"


def normal(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, between single spaces."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _intervals(norm: Column, rule: Column) -> Column:
    """Detections of one rule: its matches are set between marks, and the marks' places among the words are read."""
    words = F.split(F.call_function("regexp_replace", norm, rule["pattern"], F.lit("\x01 $0 \x02")), " ", -1)

    def places(mark: str) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == mark, i)), lambda x: x.isNotNull())
        return F.transform(at, lambda x, k: x - 2 * k)

    return F.transform(
        F.arrays_zip(places("\x01").alias("first"), places("\x02").alias("after")),
        lambda x: F.struct(
            x["first"].cast("long").alias("first"), (F.lit(1) - x["after"]).cast("long").alias("minus_last"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")
        ),
    )


def _held(words: tuple[str, ...]) -> str:
    """SQL: whether the normalised text holds one of these."""
    return " OR ".join(f"contains(norm, '{x}')" for x in words)


def scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """Licenses named in each row of docs, which needs doc_id and text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (smallest and largest of their first words; null without), base_labels and labels
    (distinct, sorted, comma-joined; labels has those of detections that are not
    suppressed too), score (the largest weight of such a detection, 0 without) and
    detections (first and last word, label, weight; before suppression). Null and empty
    texts have no words. Repeated rows give repeated rows; other columns are not read.
    """
    groups: dict[tuple, list[Rule]] = {}
    for r in own or rules():
        groups.setdefault((tuple(r.anchors), tuple(r.keywords)), []).append(r)
    out = docs.select(F.col("doc_id").alias("doc_id"), normal(F.col("text")).alias("norm"))
    spaces = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    # One literal table of all rules, and numbers of the groups whose cheap tests and union of patterns say that a rule may match.
    table = F.from_json(F.lit(json.dumps([[r._asdict() for r in group] for group in groups.values()])), f"array<{_RULES_TYPE}>")
    anchored = {a: f"anchored{k}" for k, a in enumerate(sorted({a for a, _ in groups if a}))}
    out = out.select("*", *(F.expr(_held(a)).alias(name) for a, name in anchored.items()))
    tests = []
    for k, ((anchors, keywords), group) in enumerate(groups.items()):
        gate = [*([anchored[anchors]] if anchors else []), f"({_held(keywords)})", f"rlike(norm, r'{'|'.join(r.pattern for r in group)}')"]
        tests.append(f"CASE WHEN {' AND '.join(gate)} THEN {k} END")
    tried = F.flatten(F.transform(F.expr(f"array_compact(array({', '.join(tests)}))"), lambda k: F.get(table, k)))
    found = F.array_sort(F.flatten(F.transform(tried, lambda r: _intervals(F.col("norm"), r))))
    out = out.select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"),
        found.alias("found"),
    )
    # In order of first word, then of the longer, then of priority: a detection is within an earlier one if it ends no later than the furthest.
    start = F.struct(F.lit(-1).cast("long").alias("furthest"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        stays = -x["minus_last"] > acc["furthest"]
        return F.struct(
            F.greatest(acc["furthest"], -x["minus_last"]).alias("furthest"),
            F.when(stays, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(stays, F.greatest(acc["score"], x["weight"])).otherwise(acc["score"]).alias("score"),
        )

    base = F.filter("found", lambda x: x["base"])
    out = out.select("doc_id", "n_words", "found", base.alias("base"), F.aggregate("found", start, step).alias("kept"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept.labels"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("kept.score")).alias("score"),
        F.transform("found", lambda x: F.struct(x["first"].alias("first"), (-x["minus_last"]).alias("last"), x["label"].alias("label"), x["weight"].alias("weight"))).alias("detections"),
    )
