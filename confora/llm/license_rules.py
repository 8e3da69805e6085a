"""Signature rules of licenses, in order: earlier rules have priority.

A line is ``label | keyword | expression``. Expressions match the words of a text (lower-cased, digits and letters only) joined by
one space; ``~`` stands for up to three words in between. The keyword is a string that every match contains. Tiers go from
statements that name their license outright, over names and abbreviations, to wording that only hints at one.
"""

from __future__ import annotations

#: (confidence, rules) by tier.
TIERS = (
    (1.0, r"""
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
gpl-2.0-only | spdx | spdx license identifier gpl 2 0( only)?(?! or later)
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0( only)?(?! or later)
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1( only)?(?! or later)
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0( only)?(?! or later)
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | spdx | spdx license identifier agpl 3 0( only)?(?! or later)
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
eupl-1.1 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | spdx | spdx license identifier sspl 1 0
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-3.0 | spdx | spdx license identifier cc by 3 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-3.0 | spdx | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4 0
postgresql | spdx | spdx license identifier postgresql
python-2.0 | spdx | spdx license identifier (python|psf) 2 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
ncsa | spdx | spdx license identifier ncsa
upl-1.0 | spdx | spdx license identifier upl 1 0
x11 | spdx | spdx license identifier x11
ecl-2.0 | spdx | spdx license identifier ecl 2 0
afl-3.0 | spdx | spdx license identifier afl 3 0
osl-3.0 | spdx | spdx license identifier osl 3 0
openssl | spdx | spdx license identifier openssl
vim | spdx | spdx license identifier vim
ruby | spdx | spdx license identifier ruby
php-3.01 | spdx | spdx license identifier php 3 01
odbl-1.0 | spdx | spdx license identifier odbl 1 0
mulan-psl-2.0 | spdx | spdx license identifier mulanpsl 2 0
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
apache-2 | you may not use this file | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | apache license | apache license version 2 0 january 2004
apache-2 | contributor hereby grants | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license
bsd-3-clause | endorse or promote | neither the name of ~ nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
gpl-2.0-or-later | general public license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | general public license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | general public license | gnu general public license ~ as published by the free software foundation(?! either)
gpl-3.0 | general public license | gnu general public license version 3 29 june 2007
gpl-2.0 | general public license | gnu general public license version 2 june 1991
lgpl-2.1-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | library general public | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | affero general public | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | affero general public | gnu affero general public license version 3 19 november 2007
mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | incompatible with secondary | this source code form is incompatible with secondary licenses
epl-2.0 | eclipse public license | (are made available under|distributed under|subject to) the terms of the eclipse public license (v ?)?2 0
epl-1.0 | eclipse public license | (are made available under|distributed under|subject to) the terms of the eclipse public license (v ?)?1 0
cddl-1.0 | common development | subject to the terms of the common development and distribution license
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
cc0-1.0 | waiving all of | dedicated the work to the public domain by waiving all of (his|her|their|his or her) rights
wtfpl | what the | you just do what the fuck you want to
ofl-1.1 | open font license | this font software is licensed under the sil open font license version 1 1
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used
python-2.0 | python software foundation | this license agreement is between the python software foundation
postgresql | university of california | in no event shall the university of california be liable to any party
json | good not evil | the software shall be used for good not evil
beerware | beer | you can buy me a beer in return
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
busl-1.1 | business source license | use of this software is governed by the business source license
sspl-1.0 | server side public | server side public license version 1
commons-clause | commons clause | commons clause license condition
proprietary | confidential | (this|the) (software|document|file|material) ~ (is )?(proprietary and confidential|confidential and proprietary)
proprietary | strictly prohibited | unauthorized (copying|use|reproduction|distribution) of this ~ strictly prohibited
"""),
    (0.9, r"""
mit | mit license | (the )?mit license
mit | expat license | (the )?expat license
mit-0 | mit no attribution | mit no attribution( license)?
apache-2 | apache | apache (software )?license (version |v ?)?2( 0)?
apache-2 | asl | asl (version |v ?)?2 0
apache-1.1 | apache | apache (software )?license (version |v ?)?1 1
apache-1.0 | apache | apache (software )?license (version |v ?)?1 0
bsd-3-clause | clause bsd | (3|three) clause bsd( license)?
bsd-2-clause | clause bsd | (2|two) clause bsd( license)?
bsd-4-clause | clause bsd | (4|four) clause bsd( license)?
bsd-3-clause | bsd 3 | bsd 3 clause( license)?
bsd-2-clause | bsd 2 | bsd 2 clause( license)?
bsd-4-clause | bsd 4 | bsd 4 clause( license)?
bsd-3-clause | bsd | (new|modified|revised) bsd license
bsd-2-clause | bsd | (simplified|freebsd) bsd license
0bsd | zero clause bsd | (bsd )?zero clause bsd( license)?
bsd-3-clause-clear | clear bsd | clear bsd license
isc | isc license | (the )?isc license
gpl-1.0 | general public license | gnu general public license (version |v ?)?1( 0)?
gpl-2.0 | general public license | gnu general public license (version |v ?)?2( 0)?
gpl-3.0 | general public license | gnu general public license (version |v ?)?3( 0)?
lgpl-2.0 | library general public | gnu library general public license (version |v ?)?2( 0)?
lgpl-2.1 | lesser general public | gnu lesser general public license (version |v ?)?2 1
lgpl-3.0 | lesser general public | gnu lesser general public license (version |v ?)?3( 0)?
agpl-3.0 | affero general public | (gnu )?affero general public license (version |v ?)?3( 0)?
agpl-1.0 | affero general public | affero general public license (version |v ?)?1( 0)?
gfdl-1.1 | free documentation | gnu free documentation license (version |v ?)?1 1
gfdl-1.2 | free documentation | gnu free documentation license (version |v ?)?1 2
gfdl-1.3 | free documentation | gnu free documentation license (version |v ?)?1 3
mpl-1.0 | mozilla public license | mozilla public license (version |v ?)?1 0
mpl-1.1 | mozilla public license | mozilla public license (version |v ?)?1 1
mpl-2.0 | mozilla public license | mozilla public license (version |v ?)?2( 0)?
epl-1.0 | eclipse public license | eclipse public license (version |v ?)?1( 0)?
epl-2.0 | eclipse public license | eclipse public license (version |v ?)?2( 0)?
edl-1.0 | eclipse distribution | eclipse distribution license (version |v ?)?1 0
cddl-1.0 | common development | common development and distribution license (version |v ?)?1 0
cddl-1.1 | common development | common development and distribution license (version |v ?)?1 1
cpl-1.0 | common public license | common public license (version |v ?)?1 0
ipl-1.0 | ibm public license | ibm public license (version |v ?)?1 0
eupl-1.1 | european union public | european union public licen[cs]e (version |v ?)?1 1
eupl-1.2 | european union public | european union public licen[cs]e (version |v ?)?1 2
cecill-2.1 | cecill | cecill (free software license agreement )?(version |v ?)?2 1
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
osl-3.0 | open software license | open software license (version |v ?)?3 0
afl-3.0 | academic free license | academic free license (version |v ?)?3 0
afl-2.1 | academic free license | academic free license (version |v ?)?2 1
artistic-1.0 | artistic license | (original|clarified) artistic license|artistic license (version |v ?)?1 0
artistic-2.0 | artistic license | artistic license (version |v ?)?2 0
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license
ncsa | ncsa | (university of illinois )?ncsa open source license
upl-1.0 | universal permissive | universal permissive license
unlicense | unlicense | (the )?unlicense
wtfpl | wtfpl | wtfpl( version 2| v2)?
zlib | zlib | (the )?zlib (libpng )?license
libpng | libpng license | (the )?libpng license
bsl-1.0 | boost software license | boost software license(?! version 1 0)
busl-1.1 | business source license | business source license (version |v ?)?1 1
elastic-2.0 | elastic license | elastic license (version |v ?)?2( 0)?
sspl-1.0 | sspl | sspl (v)?1( 0)?
polyform | polyform | polyform (noncommercial|small business|shield|strict|perimeter) license
postgresql | postgresql licen | postgresql licen[cs]e
python-2.0 | python software foundation | python software foundation license
php-3.01 | php license | php license (version |v ?)?3 01
ruby | ruby license | (the )?ruby license
vim | vim license | (the )?vim license
openssl | openssl license | (the )?openssl license
ofl-1.1 | open font license | (sil )?open font license(?! version 1 1)
qpl-1.0 | q public license | q public license (version |v ?)?1 0
rpl-1.5 | reciprocal public license | reciprocal public license (version |v ?)?1 5
ecl-2.0 | educational community | educational community license (version |v ?)?2 0
nasa-1.3 | nasa open source | nasa open source agreement (version |v ?)?1 3
mulan-psl-2.0 | mulan | mulan (permissive software license|psl) (version |v)?2
cc0-1.0 | cc0 | cc0 1 0( universal)?
cc-by-1.0 | attribution | creative commons attribution 1 0( (generic|international|unported))?
cc-by-2.0 | attribution | creative commons attribution 2 0( (generic|international|unported))?
cc-by-2.5 | attribution | creative commons attribution 2 5( (generic|international|unported))?
cc-by-3.0 | attribution | creative commons attribution 3 0( (generic|international|unported))?
cc-by-4.0 | attribution | creative commons attribution 4 0( (generic|international|unported))?
cc-by-sa-2.0 | sharealike | creative commons attribution sharealike 2 0
cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0
cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0
cc-by-sa-3.0 | share alike | creative commons attribution share alike 3 0
cc-by-sa-4.0 | share alike | creative commons attribution share alike 4 0
cc-by-nc-3.0 | noncommercial | creative commons attribution noncommercial 3 0
cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4 0
cc-by-nc-sa-3.0 | noncommercial | creative commons attribution noncommercial sharealike 3 0
cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial sharealike 4 0
cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial noderiv(ative)?s 4 0
cc-by-nd-4.0 | noderiv | creative commons attribution noderiv(ative)?s 4 0
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
odbl-1.0 | open database license | (odc |open data commons )?open database license
odc-by-1.0 | open data commons | open data commons attribution license
pddl-1.0 | public domain dedication | (open data commons )?public domain dedication and licen[cs]e
openrail | rail | (creativeml |bigscience |bigcode )?(open rail|openrail)( m| plus plus m)?( license)?
llama | llama | llama [2-9]( [0-9])? community licen[cs]e( agreement)?
"""),
    (0.8, r"""
mit | opensource org | opensource org licenses mit( license)?
apache-2 | apache org licenses | apache org licenses license 2 0
apache-2 | opensource org | opensource org licenses apache 2 0
bsd-2-clause | opensource org | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org | opensource org licenses bsd 3 clause
isc | opensource org | opensource org licenses isc
gpl-2.0 | gnu org licenses | gnu org licenses (old licenses )?gpl 2 0
gpl-3.0 | gnu org licenses | gnu org licenses gpl 3 0
lgpl-2.1 | gnu org licenses | gnu org licenses (old licenses )?lgpl 2 1
lgpl-3.0 | gnu org licenses | gnu org licenses lgpl 3 0
agpl-3.0 | gnu org licenses | gnu org licenses agpl 3 0
gfdl | gnu org licenses | gnu org licenses fdl
mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
epl-1.0 | eclipse org | eclipse org legal epl v10
epl-2.0 | eclipse org | eclipse org legal epl (2 0|v20)
bsl-1.0 | boost org | boost org license 1 0
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | creativecommons org | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | creativecommons org | creativecommons org licenses by nd 4 0
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | creativecommons org | creativecommons org publicdomain mark 1 0
odbl-1.0 | opendatacommons org | opendatacommons org licenses odbl
ofl-1.1 | scripts sil org | scripts sil org ofl
gpl-2.0-or-later | gpl | gpl ?v?2( 0)?( plus| or later)
gpl-3.0-or-later | gpl | gpl ?v?3( 0)?( plus| or later)
gpl-2.0 | gpl | gpl ?v?2( 0)?( only)?
gpl-3.0 | gpl | gpl ?v?3( 0)?( only)?
lgpl-2.1-or-later | lgpl | lgpl ?v?2 1( plus| or later)
lgpl-3.0-or-later | lgpl | lgpl ?v?3( 0)?( plus| or later)
lgpl-2.1 | lgpl | lgpl ?v?2 1( only)?
lgpl-3.0 | lgpl | lgpl ?v?3( 0)?( only)?
agpl-3.0 | agpl | agpl ?v?3( 0)?( only| or later)?
mpl-2.0 | mpl | mpl ?v?2( 0)?
epl-2.0 | epl | epl ?v?2( 0)?
eupl-1.2 | eupl | eupl ?v?1 2
mit | under mit | (licensed|released|available|distributed) under mit
mit | mit licensed | mit licensed
apache-2 | under apache | (licensed|released|available|distributed) under apache 2( 0)?
bsd | under bsd | (licensed|released|available|distributed) under bsd
cc-by-nc-sa | cc by nc sa | cc by nc sa(?! [0-9])
cc-by-nc-nd | cc by nc nd | cc by nc nd(?! [0-9])
cc-by-nc | cc by nc | cc by nc(?! (sa|nd|[0-9]))
cc-by-sa | cc by sa | cc by sa(?! [0-9])
cc-by-nd | cc by nd | cc by nd(?! [0-9])
cc0-1.0 | cc0 | cc0(?! 1 0)
"""),
    (0.6, r"""
gpl | general public licen | gnu general public licen[cs]e
lgpl | general public licen | (gnu )?(lesser|library) general public licen[cs]e
agpl | affero | (gnu )?affero general public licen[cs]e
gfdl | free documentation | (gnu )?free documentation license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
cddl | common development | common development and distribution license
apache | apache | apache (software )?license
bsd | bsd | bsd (style )?license
bsd | berkeley software | berkeley software distribution license
artistic | artistic license | artistic license
eupl | european union public | european union public licen[cs]e
elastic | elastic license | elastic license
cc | creative commons | (under|by) a creative commons( attribution| sharealike| noncommercial)* licen[cs]e
cc-by-sa | by sa | (licen[cs]e|under) by sa [1-4] [05]
cc-by-nc | non commercial | creative commons attribution non commercial
x11 | x11 license | x11 license
proprietary | end user licen | end user licen[cs]e agreement
proprietary | eula | (this|the) eula
proprietary | proprietary | proprietary (software )?licen[cs]e
proprietary | all rights reserved | all rights reserved
public-domain | public domain | (in|into|to) the public domain
dual | dual licensed | dual licensed under
"""),
    (0.3, r"""
unknown-license | licensed under | (is |are )?licensed under( the)?( terms of)?
unknown-license | released under | released under (the|a) ~ licen[cs]e
unknown-license | distributed under | distributed under (the|a) ~ licen[cs]e
unknown-license | licen | (see|read) the (file )?licen[cs]e( file| md| txt)
unknown-license | permission is | permission is (hereby )?granted
unknown-license | without warranty | without warranty of any kind
unknown-license | as is | provided as is without
unknown-license | merchantability | (implied )?warrant(y|ies) of merchantability
copyright | copyright | copyright (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])*
"""),
)

#: (phrase, label) whose every place is a base detection.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
