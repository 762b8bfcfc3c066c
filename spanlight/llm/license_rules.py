"""Signatures of licenses, written by hand from the public texts of the licenses and the SPDX list.

One line is one signature: label | pattern. A blank is any gap between words, ``LIC`` is license or licence, ``LIC:`` a field of that
name, ``VER`` a version that may follow, ``NUM`` a number; the rest is a regular expression over lower-cased text.
Kinds stand from the best priority to the worst, with the confidence of a detection.
"""

from __future__ import annotations

#: Sentences that stand in a license or in the notice that names it.
NOTICES = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | permission is hereby granted free of charge to any person obtaining a copy
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | the above copyright notice and this permission notice shall be included
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
boost | permission is hereby granted free of charge to any person or organization
boost | the copyright notices in the software and this entire statement
bsd | redistribution and use in source and binary forms with or without modification
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd | this software is provided by the copyright holders and contributors as is
bsd | this software is provided by the (?:regents|author|authors) (?:and contributors )?as is
bsd-3-clause | neither the name of .{1,60}? nor the names of (?:its|any) contributors
bsd-3-clause | the names? of the (?:authors?|contributors) may not be used to endorse or promote products
bsd-4-clause | all advertising materials mentioning features or use of this software
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
isc | the author disclaims all warranties with regard to this software
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose
hpnd | the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
zlib | this software is provided as is without any express or implied warranty in no event
zlib | the origin of this software must not be misrepresented
zlib | altered source versions must be plainly marked as such
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl | you just do what the fuck you want to
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
apache | unless required by applicable law or agreed to in writing software distributed under the LIC
apache | you may not use this file except in compliance with the LIC
apache | licensed to the apache software foundation asf under one or more contributor
apache | this product includes software developed (?:by|at) the apache software foundation
gpl | you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl | you should have received a copy of the gnu general public LIC
gpl | the licenses for most software are designed to take away your freedom to share and change it
gpl | gnu general public LIC terms and conditions
lgpl | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC
lgpl | you should have received a copy of the gnu (?:lesser|library) general public LIC
lgpl | this license the lesser general public LIC applies to some specially designated software packages
agpl | you can redistribute it and or modify it under the terms of the gnu affero general public LIC
agpl | you should have received a copy of the gnu affero general public LIC
agpl | users interacting with it remotely through a computer network
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
gfdl | with no invariant sections no front cover texts and no back cover texts
mpl | this source code form is subject to the terms of the mozilla public LIC
mpl | the contents of this file are subject to the mozilla public LIC
mpl | if a copy of the mpl was not distributed with this file
epl | this program and the accompanying materials are made available under the terms of the eclipse public LIC
epl | the accompanying program is provided under the terms of this eclipse public LIC
edl | made available under the terms of the eclipse distribution LIC
cddl | the contents of this file are subject to the terms of the common development and distribution LIC
cddl | you can obtain a copy of the LIC at usr src opensolaris
cpl | the accompanying program is provided under the terms of this common public LIC
cpal | the contents of this file are subject to the common public attribution LIC
apsl | this file contains original code and or modifications of original code as defined in
eupl | licensed under the eupl
eupl | unless required by applicable law or agreed to in writing software distributed under the eupl
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic | the package is the collection of files distributed by the copyright holder
perl | you may distribute (?:it|this module) under the same terms as perl itself
perl | it under the same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself
python | this license agreement is between the python software foundation
python | psf hereby grants licensee a nonexclusive royalty free world wide LIC
php | this product includes php software freely available from
ruby | you may make and give away verbatim copies of the source form of the software without restriction
openssl | this product includes software developed by the openssl project
ssleay | this product includes cryptographic software written by eric young
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that
vim | vim is charityware
tcl | this software is copyrighted by the regents of the university of california sun microsystems
x11 | except as contained in this notice the name of the x consortium shall not be used
ncsa | neither the names of .{1,60}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
icu | unicode inc hereby grants the right to freely use the information supplied
postgresql | in no event shall the university of california be liable to any party
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
qpl | you may distribute your modifications in the form of patches
w3c | by obtaining using and or copying this work you the licensee agree
ms-pl | if you use the software you accept this LIC if you do not accept the LIC do not use the software
cecill | ce logiciel est r.{1,2}gi par la licence cecill
cecill | this software is governed by the cecill(?: b| c)? LIC
mulan | you can use this software according to the terms and conditions of the mulan psl
ofl | this font software is licensed under the sil open font LIC
ofl | reserved font name refers to any names specified as such
cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | to the extent possible under law .{1,80}? has waived all copyright
cc-by | this work is licensed under (?:a|the) creative commons attribution NUM international LIC
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same LIC
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
odbl | this .{1,60}? is made available under the open database LIC
odc-by | this .{1,60}? is made available under the open data commons attribution LIC
elastic | you may not provide the software to third parties as a hosted or managed service
sspl | if you make the functionality of the program or a modified version available to third parties as a service
busl | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl | change LIC gpl
openrail | you agree not to use the model or derivatives of the model
llama | llama NUM is licensed under the llama
llama | built with (?:meta )?llama
gemma | gemma is provided under and subject to the gemma terms of use
public-domain | released into the public domain
public-domain | dedicated to the public domain
public-domain | placed in(?:to)? the public domain
public-domain | this (?:file|work|software|code) is in the public domain
public-domain | in the public domain
proprietary | all rights reserved
proprietary | proprietary and confidential
proprietary | unauthorized copying of this file
proprietary | may not be reproduced without (?:prior )?(?:written )?permission
proprietary | no part of this (?:publication|document|book) may be reproduced
proprietary | this software is the confidential and proprietary information of
proprietary | for internal use only
"""

#: Links to the text of a license.
LINKS = r"""
mit | opensource\.org/licenses?/mit
mit | choosealicense\.com/licenses/mit
apache | apache\.org/licenses
apache | opensource\.org/licenses?/apache
gpl | gnu\.org/licenses/(?:old-licenses/)?gpl
gpl | gnu\.org/copyleft/gpl
gpl | opensource\.org/licenses?/gpl
lgpl | gnu\.org/licenses/(?:old-licenses/)?lgpl
lgpl | gnu\.org/copyleft/lesser
agpl | gnu\.org/licenses/agpl
gfdl | gnu\.org/licenses/(?:old-licenses/)?fdl
mpl | mozilla\.org/(?:en-us/)?mpl
mpl | opensource\.org/licenses?/mpl
epl | eclipse\.org/legal/epl
edl | eclipse\.org/org/documents/edl
bsd | opensource\.org/licenses?/bsd
isc | opensource\.org/licenses?/isc
artistic | opensource\.org/licenses?/artistic
unlicense | unlicense\.org
wtfpl | wtfpl\.net
ofl | scripts\.sil\.org/ofl
ofl | openfontlicense\.org
cc0 | creativecommons\.org/publicdomain/zero
public-domain | creativecommons\.org/publicdomain/mark
cc-by | creativecommons\.org/licenses/by/
cc-by-sa | creativecommons\.org/licenses/by-sa/
cc-by-nc | creativecommons\.org/licenses/by-nc/
cc-by-nd | creativecommons\.org/licenses/by-nd/
cc-by-nc-sa | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | creativecommons\.org/licenses/by-nc-nd/
boost | boost\.org/license
zlib | zlib\.net/zlib_license
python | python\.org/psf/license
php | php\.net/license
openssl | openssl\.org/source/license
curl | curl\.(?:se|haxx\.se)/docs/copyright
eupl | joinup\.ec\.europa\.eu/.{0,40}eupl
cddl | opensolaris\.org/os/licensing
odbl | opendatacommons\.org/licenses/odbl
odc-by | opendatacommons\.org/licenses/by
pddl | opendatacommons\.org/licenses/pddl
elastic | elastic\.co/licensing/elastic-license
sspl | mongodb\.com/licensing/server-side-public-license
busl | mariadb\.com/bsl
mulan | license\.coscl\.org\.cn/mulan
cecill | cecill\.info
llama | ai\.meta\.com/llama/license
gemma | ai\.google\.dev/gemma/terms
"""

#: SPDX tags: identifiers of the SPDX list.
TAGS = r"""
mit | spdx LIC identifier mit
mit-0 | spdx LIC identifier mit 0
apache | spdx LIC identifier apache NUM
apache-1.1 | spdx LIC identifier apache 1 1
gpl | spdx LIC identifier gpl NUM
lgpl | spdx LIC identifier lgpl NUM
agpl | spdx LIC identifier agpl NUM
gfdl | spdx LIC identifier gfdl NUM
0bsd | spdx LIC identifier 0bsd
bsd-2-clause | spdx LIC identifier bsd 2 clause
bsd-3-clause | spdx LIC identifier bsd 3 clause
bsd-4-clause | spdx LIC identifier bsd 4 clause
mpl | spdx LIC identifier mpl NUM
epl | spdx LIC identifier epl NUM
cddl | spdx LIC identifier cddl NUM
cpl | spdx LIC identifier cpl NUM
eupl | spdx LIC identifier eupl NUM
isc | spdx LIC identifier isc
zlib | spdx LIC identifier zlib
libpng | spdx LIC identifier libpng
boost | spdx LIC identifier bsl NUM
artistic | spdx LIC identifier artistic NUM
python | spdx LIC identifier (?:python|psf) NUM
ruby | spdx LIC identifier ruby
php | spdx LIC identifier php NUM
w3c | spdx LIC identifier w3c
unlicense | spdx LIC identifier unlicense
wtfpl | spdx LIC identifier wtfpl
beerware | spdx LIC identifier beerware
ofl | spdx LIC identifier ofl NUM
afl | spdx LIC identifier afl NUM
osl | spdx LIC identifier osl NUM
apsl | spdx LIC identifier apsl NUM
ncsa | spdx LIC identifier ncsa
ms-pl | spdx LIC identifier ms pl
ms-rl | spdx LIC identifier ms rl
openssl | spdx LIC identifier openssl
curl | spdx LIC identifier curl
x11 | spdx LIC identifier x11
hpnd | spdx LIC identifier hpnd
postgresql | spdx LIC identifier postgresql
cecill | spdx LIC identifier cecill
mulan | spdx LIC identifier mulanpsl
odbl | spdx LIC identifier odbl
cc0 | spdx LIC identifier cc0
cc-by | spdx LIC identifier cc by NUM
cc-by-sa | spdx LIC identifier cc by sa
cc-by-nc | spdx LIC identifier cc by nc NUM
cc-by-nd | spdx LIC identifier cc by nd
cc-by-nc-sa | spdx LIC identifier cc by nc sa
cc-by-nc-nd | spdx LIC identifier cc by nc nd
elastic | spdx LIC identifier elastic
sspl | spdx LIC identifier sspl
busl | spdx LIC identifier busl
"""

#: Names as they stand in titles and running text.
TITLES = r"""
mit | (?:expat|mit) LIC
mit | mit style LIC
mit | massachusetts institute of technology LIC
mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat)
mit-0 | mit no attribution(?: LIC)?
apache | apache (?:software )?LIC VER
apache | apache NUM LIC
apache | asl 2 0
apache | (?:licensed|released|distributed|available) under (?:the )?apache
apache-1.1 | apache (?:software )?LIC (?:v(?:ersion)? ?)?1 1
gpl | (?:gnu )?general public LIC VER
gpl | gnu gpl VER
gpl | gpl ?v[123]
gpl | gpl LIC
gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl
lgpl | (?:gnu )?(?:lesser|library) general public LIC VER
lgpl | gnu lgpl VER
lgpl | lgpl ?v[23]
lgpl | lgpl LIC
lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl
agpl | (?:gnu )?affero general public LIC VER
agpl | gnu agpl VER
agpl | agpl ?v[13]
agpl | agpl LIC
agpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agpl
gfdl | gnu free documentation LIC VER
gfdl | gfdl LIC
bsd | bsd (?:style )?LIC
bsd | berkeley software distribution LIC
bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd
bsd-2-clause | (?:simplified|freebsd|2 clause|two clause) bsd LIC
bsd-2-clause | bsd 2 clause(?: LIC)?
bsd-2-clause | freebsd LIC
bsd-3-clause | (?:new|modified|revised|3 clause|three clause) bsd LIC
bsd-3-clause | bsd 3 clause(?: LIC)?
bsd-4-clause | (?:original|old|4 clause|four clause) bsd LIC
bsd-4-clause | bsd 4 clause(?: LIC)?
0bsd | (?:zero clause bsd|bsd zero clause|0bsd) LIC
mpl | mozilla public LIC VER
mpl | mpl ?(?:v ?)?[12] [01]
mpl | mpl LIC
epl | eclipse public LIC VER
epl | epl (?:v )?[12] 0
edl | eclipse distribution LIC VER
cddl | common development and distribution LIC VER
cddl | cddl LIC
cpl | common public LIC VER
cpal | common public attribution LIC VER
ipl | ibm public LIC VER
eupl | european union public LIC(?:ence)? VER
eupl | eupl (?:v )?1 [0-2]
isc | isc LIC
isc | internet systems consortium LIC
zlib | zlib(?: libpng)? LIC
libpng | libpng LIC
boost | boost software LIC VER
boost | bsl 1 0 LIC
artistic | (?:clarified )?artistic LIC VER
perl | perl artistic LIC
python | python software foundation LIC VER
python | psf LIC
python | python LIC VER
ruby | ruby LIC
php | php LIC VER
w3c | w3c software(?: notice and)? LIC
w3c | w3c document LIC
unlicense | the unlicense
wtfpl | do what the fuck you want to public LIC
wtfpl | wtfpl VER
beerware | beer ?ware LIC
ofl | sil open font LIC VER
ofl | open font LIC VER
afl | academic free LIC VER
osl | open software LIC VER
nposl | non profit open software LIC VER
aladdin | aladdin free public LIC
apsl | apple public source LIC VER
ncsa | university of illinois (?:ncsa )?(?:open source )?LIC
ncsa | ncsa open source LIC
ms-pl | microsoft public LIC
ms-rl | microsoft reciprocal LIC
qpl | q public LIC
sleepycat | sleepycat LIC
openssl | openssl LIC
ssleay | ssleay LIC
curl | curl LIC
vim | vim LIC
tcl | tcl tk LIC
x11 | x11 LIC
x11 | x consortium LIC
hpnd | historical permission notice and disclaimer
icu | icu LIC
icu | unicode LIC
postgresql | postgresql LIC
cecill | cecill(?: b| c)? LIC
mulan | mulan permissive software LIC VER
odbl | open database LIC VER
odc-by | open data commons attribution LIC
pddl | public domain dedication and LIC
cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | creative commons zero(?: LIC)?
cc-by | creative commons attribution(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by | cc by NUM
cc-by-sa | creative commons attribution share ?alike(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by-sa | cc by sa(?: NUM)?
cc-by-nc | creative commons attribution non ?commercial(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by-nc | cc by nc(?: NUM)?
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s?(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by-nd | cc by nd(?: NUM)?
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by-nc-sa | cc by nc sa(?: NUM)?
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: NUM)?(?: international| unported)?(?: LIC)?
cc-by-nc-nd | cc by nc nd(?: NUM)?
elastic | elastic LIC VER
sspl | server side public LIC VER
busl | business source LIC VER
openrail | (?:big ?code |creativeml )?open ?rail(?: m| s| d)? LIC
openrail | responsible ai LIC
llama | llama NUM community LIC
llama | llama community LIC
gemma | gemma terms of use
"""

#: Fields of manifests and headers.
FIELDS = r"""
mit | LIC: mit
apache | LIC: apache
gpl | LIC: gpl
lgpl | LIC: lgpl
agpl | LIC: agpl
bsd | LIC: bsd
mpl | LIC: mpl
mpl | LIC: mozilla
epl | LIC: epl
isc | LIC: isc
zlib | LIC: zlib
boost | LIC: (?:boost|bsl)
artistic | LIC: artistic
python | LIC: (?:python|psf)
unlicense | LIC: unlicense
wtfpl | LIC: wtfpl
cc0 | LIC: cc0
cc-by | LIC: cc by
ofl | LIC: ofl
eupl | LIC: eupl
public-domain | LIC: public domain
proprietary | LIC: (?:proprietary|commercial|unlicensed)
"""

#: kind, signatures, confidence.
KINDS = [("notice", NOTICES, 1.0), ("link", LINKS, 1.0), ("tag", TAGS, 1.0), ("title", TITLES, 0.9), ("field", FIELDS, 0.8)]

#: Words that stand in texts of any kind; they gate a signature only where it has no rarer one.
COMMON = set(
    """a about all an and any are be by code copies copy copyright distribute distributed distribution document file for form free from general in is
    it its made modify names no not notice of on or out part permission product program provided public redistribution redistributions
    released right same set software source terms that the this to under use used version warranties warranty which with without work you""".split()
)
