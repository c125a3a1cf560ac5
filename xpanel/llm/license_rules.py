"""Signature rules of the licence scan, in order: priority | label | keyword | words; identifiers and where they stand.

Words are separated by blanks; a word is a regular expression, and a last "?" makes it optional. A rule runs only on texts with its
keyword, a whole word of every match. Priorities: 0 a certain licence and version, 1 a licence, 2 a mention, 3 a sign of some licence.
"""

RULES = """
0 | gpl-1.0-or-later | gnu | gnu general public licen[cs]e version|v? v?1⁺
0 | gpl-2.0-or-later | gnu | gnu general public licen[cs]e version|v? v?2⁺
0 | gpl-3.0-or-later | gnu | gnu general public licen[cs]e version|v? v?3⁺
0 | gpl-1.0 | gnu | gnu general public licen[cs]e version|v? v?1
0 | gpl-2.0 | gnu | gnu general public licen[cs]e version|v? v?2
0 | gpl-3.0 | gnu | gnu general public licen[cs]e version|v? v?3
0 | gpl-1.0-or-later | published | gnu general public licen[cs]e as published by the free software foundation either version? v?1 or at your option any later version
0 | gpl-2.0-or-later | published | gnu general public licen[cs]e as published by the free software foundation either version? v?2 of the licen[cs]e or at your option any later version
0 | gpl-3.0-or-later | published | gnu general public licen[cs]e as published by the free software foundation either version? v?3 of the licen[cs]e or at your option any later version
0 | gpl-2.0-only | published | gnu general public licen[cs]e version? v?2 as published by the free software foundation
0 | gpl-3.0-only | published | gnu general public licen[cs]e version? v?3 as published by the free software foundation
1 | gpl | gnu | gnu general public licen[cs]e
1 | gpl | distributed | distributed under the terms of the gpl licen[cs]e?
2 | gpl | gpl | licensed under the? gpl
2 | gpl | gplv2 | licensed under the? gplv2
2 | gpl | gplv3 | licensed under the? gplv3
2 | gpl | gpl | gpl licen[cs]e
0 | gpl-classpath-exception | exception | gnu classpath exception to the general public licen[cs]e
1 | gpl-linking-exception | permission | the copyright holders give you permission to link this library with independent modules to produce an executable
3 | gpl | program | this program is free software you can redistribute it and or modify it
3 | gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
3 | gpl | received | you should have received a copy of the gnu general public licen[cs]e
1 | gpl-3.0 | copyleft | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
1 | gpl-2.0 | freedom | the licenses for most software are designed to take away your freedom to share and change it
2 | gpl | covered | activities other than copying distribution and modification are not covered by this licen[cs]e they are outside its scope
0 | agpl-3.0 | affero | gnu? affero general public licen[cs]e version|v? v?3
0 | agpl-3.0-or-later | affero | gnu affero general public licen[cs]e as published by the free software foundation either version? v?3
0 | agpl-1.0 | affero | affero general public licen[cs]e version? v?1
1 | agpl | affero | gnu? affero general public licen[cs]e
2 | agpl | agpl | licensed under the? agpl
2 | agpl | agplv3 | licensed under the? agplv3
1 | agpl-3.0 | affero | the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
0 | lgpl-2.0 | library | gnu library general public licen[cs]e version|v? v?2
0 | lgpl-2.1 | lesser | gnu lesser general public licen[cs]e version|v? v?2 1
0 | lgpl-3.0 | lesser | gnu lesser general public licen[cs]e version|v? v?3
0 | lgpl-2.1-or-later | lesser | gnu lesser general public licen[cs]e as published by the free software foundation either version? v?2 1
0 | lgpl-3.0-or-later | lesser | gnu lesser general public licen[cs]e as published by the free software foundation either version? v?3
1 | lgpl | lesser | gnu? lesser general public licen[cs]e
1 | lgpl | library | gnu? library general public licen[cs]e
2 | lgpl | lgpl | licensed under the? lgpl
2 | lgpl | lgpl | lgpl licen[cs]e
1 | lgpl-3.0 | lesser | this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3
0 | gfdl-1.1 | documentation | gnu free documentation licen[cs]e version? v?1 1
0 | gfdl-1.2 | documentation | gnu free documentation licen[cs]e version? v?1 2
0 | gfdl-1.3 | documentation | gnu free documentation licen[cs]e version? v?1 3
1 | gfdl | documentation | gnu? free documentation licen[cs]e
3 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts a copy of the licen[cs]e
0 | apache-1.0 | apache | apache software? licen[cs]e version? v?1 0
0 | apache-1.1 | apache | apache software? licen[cs]e version? v?1 1
0 | apache-2.0 | apache | apache software? licen[cs]e version|v? v?2 0?
0 | apache-2.0 | apache | apache software? licen[cs]e 2 0
0 | apache-2.0 | apache | licensed under the apache licen[cs]e version? v?2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
0 | apache-2.0 | licenses | apache org licenses license 2 0
1 | apache | apache | apache software? licen[cs]e
2 | apache | apache | licensed under the? apache
1 | apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e to reproduce
1 | apache-2.0 | patent | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent licen[cs]e
1 | apache-1.1 | acknowledgment | the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation
2 | apache | trademarks | this licen[cs]e does not grant permission to use the trade names trademarks service marks or product names of the licensor
3 | apache | permissions | see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
3 | apache | agreed | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
0 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
0 | mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
0 | mit-0 | attribution | mit no attribution licen[cs]e
0 | mit | licenses | opensource org licenses mit
0 | mit-advertising | advertising | mit licen[cs]e with advertising clause
0 | mit-cmu | cmu | cmu licen[cs]e
0 | x11 | consortium | x consortium licen[cs]e
0 | x11 | x11 | mit x11 licen[cs]e
1 | mit | mit | mit licen[cs]e
1 | mit | expat | expat licen[cs]e
2 | mit | mit | licensed under the? mit
2 | mit | mit | released under the? mit licen[cs]e
3 | mit | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
3 | mit | tort | whether in an action of contract tort or otherwise arising from out of or in connection with the software
2 | mit | publish | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies
0 | bsd-2-clause | bsd | bsd 2|two clause licen[cs]e
0 | bsd-2-clause | bsd | 2|two clause bsd licen[cs]e
0 | bsd-2-clause | bsd | simplified bsd licen[cs]e
0 | bsd-2-clause | freebsd | freebsd licen[cs]e
0 | bsd-3-clause | bsd | bsd 3|three clause licen[cs]e
0 | bsd-3-clause | bsd | 3|three clause bsd licen[cs]e
0 | bsd-3-clause | bsd | new|revised|modified bsd licen[cs]e
0 | bsd-3-clause | endorse | neither the name of the? [^<>]+ nor the names of its contributors may be used to endorse or promote products derived from this software
0 | bsd-3-clause | holder | neither the name of the copyright holder nor the names of its contributors may be used
0 | bsd-4-clause | bsd | original|old bsd licen[cs]e
0 | bsd-4-clause | bsd | bsd 4|four clause licen[cs]e
0 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
0 | 0bsd | bsd | zero clause bsd licen[cs]e
1 | bsd | bsd | bsd style? licen[cs]e
1 | bsd | forms | redistribution and use in source and binary forms with or without modification are permitted
2 | bsd | retain | redistributions of source code must retain the above copyright notice this list of conditions
2 | bsd | reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions
2 | bsd | bsd | licensed under the? bsd
3 | bsd | holders | this software is provided by the copyright holders and contributors as is
3 | bsd | consequential | in no event shall the copyright holder|owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages
0 | isc | fee | permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
1 | isc | isc | isc licen[cs]e
2 | isc | internet | internet systems consortium licen[cs]e
2 | isc | author | the software is provided as is and the author disclaims all warranties with regard to this software
0 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
0 | zlib | misrepresented | the origin of this software must not be misrepresented
1 | zlib | zlib | zlib licen[cs]e
1 | libpng | libpng | zlib? libpng licen[cs]e
3 | zlib | express | this software is provided as is without any express or implied warranty
0 | mpl-1.0 | mozilla | mozilla public licen[cs]e version|v? v?1 0
0 | mpl-1.1 | mozilla | mozilla public licen[cs]e version|v? v?1 1
0 | mpl-2.0 | mozilla | mozilla public licen[cs]e version|v? v?2 0?
0 | mpl-2.0 | source | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
0 | mpl-2.0-no-copyleft-exception | incompatible | incompatible with secondary licenses as defined by the mozilla public licen[cs]e
1 | mpl | mozilla | mozilla public licen[cs]e
1 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
1 | npl | netscape | netscape public licen[cs]e
0 | epl-1.0 | eclipse | eclipse public licen[cs]e version|v? v?1 0
0 | epl-2.0 | eclipse | eclipse public licen[cs]e version|v? v?2 0
1 | epl | eclipse | eclipse public licen[cs]e
1 | edl-1.0 | eclipse | eclipse distribution licen[cs]e
1 | cpl-1.0 | common | common public licen[cs]e
1 | ipl-1.0 | ibm | ibm public licen[cs]e
0 | cddl-1.0 | cddl | common development and distribution licen[cs]e cddl version? v?1 0
0 | cddl-1.1 | cddl | common development and distribution licen[cs]e cddl version? v?1 1
1 | cddl | development | common development and distribution licen[cs]e
1 | cpal-1.0 | attribution | common public attribution licen[cs]e
0 | eupl-1.1 | eupl | european union public licen[cs]e eupl v 1 1
0 | eupl-1.2 | eupl | european union public licen[cs]e eupl v 1 2
1 | eupl | union | european union public licen[cs]e
0 | osl-3.0 | open | open software licen[cs]e version|v? v?3 0
1 | osl | open | open software licen[cs]e
0 | afl-2.1 | academic | academic free licen[cs]e version? v?2 1
0 | afl-3.0 | academic | academic free licen[cs]e version? v?3 0
1 | afl | academic | academic free licen[cs]e
0 | artistic-1.0 | artistic | artistic licen[cs]e 1 0
0 | artistic-2.0 | artistic | artistic licen[cs]e version? 2 0
1 | artistic | artistic | artistic licen[cs]e
2 | artistic | perl | licensed under the same terms as perl itself
0 | bsl-1.0 | boost | boost software licen[cs]e version? v?1 0
1 | bsl-1.0 | boost | boost software licen[cs]e
0 | bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
0 | busl-1.1 | business | business source licen[cs]e 1 1
1 | busl | business | business source licen[cs]e
0 | psf-2.0 | python | python software foundation licen[cs]e version? v?2
1 | psf | python | python software foundation licen[cs]e
1 | cnri-python | cnri | cnri open source licen[cs]e agreement
0 | php-3.01 | php | php licen[cs]e version? v?3 01
1 | php | php | php licen[cs]e
1 | ruby | ruby | ruby licen[cs]e
1 | openssl | openssl | openssl licen[cs]e
0 | openssl | toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
1 | ssleay | ssleay | original ssleay licen[cs]e
1 | postgresql | postgresql | postgresql licen[cs]e
0 | postgresql | documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 | vim | vim | vim licen[cs]e
1 | curl | curl | curl licen[cs]e
1 | tcl | tcl | tcl tk licen[cs]e
1 | ntp | ntp | ntp licen[cs]e
0 | ofl-1.1 | font | sil open font licen[cs]e version? v?1 1
1 | ofl | font | sil? open font licen[cs]e
1 | ofl | font | neither the font software nor any of its individual components in original or modified versions may be sold by itself
1 | ms-pl | microsoft | microsoft public licen[cs]e
2 | ms-pl | accept | if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software
1 | ms-rl | microsoft | microsoft reciprocal licen[cs]e
1 | ncsa | illinois | university of illinois ncsa? open source licen[cs]e
0 | ecl-2.0 | educational | educational community licen[cs]e version? v?2 0
1 | ecl | educational | educational community licen[cs]e
1 | upl-1.0 | permissive | universal permissive licen[cs]e
1 | upl-1.0 | collectively | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the software
1 | qpl-1.0 | q | q public licen[cs]e
0 | zpl-2.1 | zope | zope public licen[cs]e version? v?2 1
1 | zpl | zope | zope public licen[cs]e
1 | w3c | w3c | w3c software notice? and? licen[cs]e
1 | sleepycat | sleepycat | sleepycat licen[cs]e
1 | rpl | reciprocal | reciprocal public licen[cs]e
0 | sspl-1.0 | server | server side public licen[cs]e version? v?1
1 | sspl | server | server side public licen[cs]e
0 | elastic-2.0 | elastic | elastic licen[cs]e 2 0
1 | elastic | elastic | elastic licen[cs]e
1 | odbl-1.0 | database | open database licen[cs]e
1 | odc-by-1.0 | commons | open data commons attribution licen[cs]e
1 | pddl-1.0 | dedication | public domain dedication and licen[cs]e
1 | cdla-permissive | community | community data licen[cs]e agreement permissive
1 | cdla-sharing | community | community data licen[cs]e agreement sharing
0 | cecill-2.1 | cecill | cecill free software licen[cs]e agreement version? v?2 1
1 | cecill-b | cecill | cecill b licen[cs]e
1 | cecill-c | cecill | cecill c licen[cs]e
1 | cecill | cecill | cecill licen[cs]e
0 | mulan-2.0 | mulan | mulan permissive software licen[cs]e v2
1 | mulan | mulan | mulan permissive software licen[cs]e
1 | json | json | json licen[cs]e
0 | json | evil | the software shall be used for good not evil
1 | unicode | unicode | unicode licen[cs]e agreement
1 | openrail-m | openrail | creative ml openrail m licen[cs]e
1 | openrail-m | rail | creative ml open rail m licen[cs]e
1 | llama-community | llama | llama [0-9]+? [0-9]+? community licen[cs]e
1 | beerware | beer | the beer ware licen[cs]e
0 | cc0-1.0 | cc0 | cc0 1 0 universal?
1 | cc0 | cc0 | cc0
1 | cc0 | zero | creative commons zero
1 | cc0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
0 | cc-by-1.0 | cc | cc by 1 0
0 | cc-by-2.0 | cc | cc by 2 0
0 | cc-by-2.5 | cc | cc by 2 5
0 | cc-by-3.0 | cc | cc by 3 0
0 | cc-by-4.0 | cc | cc by 4 0
0 | cc-by-4.0 | attribution | creative commons attribution 4 0 international
0 | cc-by-3.0 | attribution | creative commons attribution 3 0
1 | cc-by | cc | cc by
1 | cc-by | attribution | creative commons attribution
0 | cc-by-sa-3.0 | cc | cc by sa 3 0
0 | cc-by-sa-4.0 | cc | cc by sa 4 0
0 | cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0
0 | cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0
1 | cc-by-sa | cc | cc by sa
1 | cc-by-sa | sharealike | creative commons attribution sharealike
0 | cc-by-nc-3.0 | cc | cc by nc 3 0
0 | cc-by-nc-4.0 | cc | cc by nc 4 0
1 | cc-by-nc | cc | cc by nc
1 | cc-by-nc | noncommercial | creative commons attribution noncommercial
0 | cc-by-nd-4.0 | cc | cc by nd 4 0
1 | cc-by-nd | cc | cc by nd
1 | cc-by-nd | commons | creative commons attribution noderiv(s|atives)
0 | cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
0 | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
1 | cc-by-nc-sa | cc | cc by nc sa
1 | cc-by-nc-sa | sharealike | creative commons attribution noncommercial sharealike
0 | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
1 | cc-by-nc-nd | cc | cc by nc nd
1 | cc-by-nc-nd | noncommercial | creative commons attribution noncommercial noderiv(s|atives)
2 | creative-commons | commons | creative commons
0 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | unlicense | unlicense | the? unlicense
0 | unlicense | software | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
0 | wtfpl | fuck | do what the fuck you want to public licen[cs]e
1 | wtfpl | wtfpl | wtfpl
0 | cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
1 | public-domain | domain | released|dedicated|placed into|in|to the public domain
2 | public-domain | domain | public domain
2 | proprietary | rights | all rights reserved
2 | proprietary | confidential | confidential and proprietary software
2 | proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
2 | proprietary | evaluation | licensed for evaluation purposes only
3 | copyright | copyright | copyright c? (19|20)[0-9]{2}
3 | unknown-licence | licensed | licensed under a|this|following licen[cs]e
3 | unknown-licence | terms | under the terms of the licen[cs]e
3 | unknown-licence | copying | see copying for details
3 | unknown-licence | full | see licen[cs]e for the full text
3 | warranty | warranty | without warranty of any kind
"""

#: Licence identifiers and their versions. "only", "or later" and "+" may follow a version.
GNU = """
gpl 1.0 2.0 3.0
lgpl 2.0 2.1 3.0
agpl 1.0 3.0
"""
VERSIONED = """
gfdl 1.1 1.2 1.3
apache 1.0 1.1 2.0
mpl 1.0 1.1 2.0
epl 1.0 2.0
cddl 1.0 1.1
eupl 1.0 1.1 1.2
osl 1.0 1.1 2.0 2.1 3.0
afl 1.1 1.2 2.0 2.1 3.0
artistic 1.0 2.0
bsl 1.0
busl 1.1
ofl 1.0 1.1
ecl 1.0 2.0
zpl 1.1 2.0 2.1
cpl 1.0
cpal 1.0
ipl 1.0
upl 1.0
psf 2.0
php 3.0 3.01
libpng 2.0
lppl 1.0 1.1 1.2
sspl 1.0
elastic 2.0
odbl 1.0
pddl 1.0
qpl 1.0
rpl 1.1 1.5
cecill 1.0 2.0 2.1
mulanpsl 1.0 2.0
cc0 1.0
classpath-exception 2.0
bison-exception 2.2
gcc-exception 2.0 3.1
"""
CREATIVE_COMMONS = """
by 1.0 2.0 2.5 3.0 4.0
by-sa 1.0 2.0 2.5 3.0 4.0
by-nc 1.0 2.0 2.5 3.0 4.0
by-nd 1.0 2.0 2.5 3.0 4.0
by-nc-sa 1.0 2.0 2.5 3.0 4.0
by-nc-nd 1.0 2.0 2.5 3.0 4.0
"""
UNVERSIONED = """
mit mit-0 mit-cmu x11 isc zlib 0bsd bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause
ncsa ms-pl ms-rl unlicense wtfpl llvm-exception linux-syscall-note
"""
SHARED = "postgresql openssl curl json vim ruby ntp tcl sleepycat"  #: names of something else too: after an address or "spdx" only

#: Where identifiers, joined by "or", "and" or "with", count: priority, keyword in the text, words before, which identifiers, words after.
CONTEXTS = (
    (0, "<spdx>", "spdx licen[cs]e identifier", "any", ""),
    (0, "<org>", "org licenses|license", "any", ""),
    (0, "<creativecommons>", "creativecommons org licenses", "cc", ""),
    (1, "gpl", "", "gnu", ""),
    (1, "licen", "", "versioned", "licen[cs]e"),
    (2, "licen", "licen[cs]e", "own", ""),
)
