"""Hand-written signatures of licences: sentences and notices of their own texts, as expressions over lower-case words.

A line is: label, priority, expression. Words outside groups stand in all that an expression matches, and its
keywords are taken from them. Punctuation is a blank in the reduced text ("don t", "2 0"), so an expression has
only words, groups and counts. Whole conditions (90 and more) outrank notices (80), notices outrank names and hints.
"""

SIGNATURES = r"""
mit 95 permission is hereby granted free of charge to any person obtaining a copy of this software
mit 94 to deal in the software without restriction including without limitation the rights
mit 94 the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit 92 to permit persons to whom the software is furnished to do so
mit 92 the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit 90 in no event shall the (?:\w+ ){1,12}be liable for any claim damages or other liability whether in an action of contract
mit 80 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit (?:x11 )?licen[cs]e
mit-0 96 permission is hereby granted (?:\w+ ){20,60}to permit persons to whom the software is furnished to do so the software is provided
mit 60 mit x11 licen[cs]e
x11 93 except as contained in this notice the name of (?:\w+ ){1,8}shall not be used in advertising or otherwise to promote the sale
isc 95 permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc 93 provided that the above copyright notice and this permission notice appear in all copies
isc 90 the software is provided as is and the author disclaims all warranties with regard to this software
isc 90 in no event shall the author be liable for any special direct indirect or consequential damages
0bsd 96 permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd 95 redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause 93 redistributions of source code must retain the above copyright notice this list of conditions
bsd-2-clause 93 redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 96 neither the name of (?:\w+ ){1,12}nor the names of (?:its|any|the) (?:\w+ ){0,3}may be used to endorse or promote products
bsd-3-clause 95 the names? of (?:\w+ ){1,8}may not be used to endorse or promote products derived from this software
bsd-4-clause 97 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 91 this software is provided by (?:\w+ ){1,12}as is and any express or implied warranties
bsd 80 (?:use of this source code is )?governed by a bsd style licen[cs]e
bsd-2-clause-patent 97 each contributor (?:\w+ ){0,8}grants to (?:\w+ ){1,20}a perpetual worldwide non exclusive no charge royalty free irrevocable (?:\w+ ){0,10}patent licen[cs]e
apache-1.1 95 the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-1.1 94 this product includes software developed by the apache software foundation
apache-1.1 94 products derived from this software may not be called apache nor may apache appear in their name
apache-2.0 96 licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance
apache-2.0 93 you may obtain a copy of the licen[cs]e at http www apache org licen[cs]es licen[cs]e 2 0
apache-2.0 92 unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-2.0 94 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
apache-2.0 94 subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you
apache-2.0 93 you must cause any modified files to carry prominent notices stating that you changed the files
apache-2.0 93 if the work includes a notice text file as part of its distribution
apache-2.0 90 terms and conditions for use reproduction and distribution
apache-2.0 80 apache licen[cs]e version 2 0 january 2004
apache 60 licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
gpl 90 this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2.0 96 gnu general public licen[cs]e version 2 june 1991
gpl-3.0 96 gnu general public licen[cs]e version 3 29 june 2007
gpl-1.0 96 gnu general public licen[cs]e version 1 february 1989
gpl-2.0 94 under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3.0 94 under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3
gpl-2.0-only 95 as published by the free software foundation version 2 of the licen[cs]e only
gpl-2.0-or-later 95 either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later 95 either version 3 of the licen[cs]e or at your option any later version
gpl 85 you should have received a copy of the gnu general public licen[cs]e along with this program
gpl 82 this program is distributed in the hope that it will be useful but without any warranty
gpl 91 the licen[cs]es for most software are designed to take away your freedom to share and change it
gpl-3.0 93 the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl-2.0 93 activities other than copying distribution and modification are not covered by this licen[cs]e they are outside its scope
gpl-3.0 93 conveying under any other circumstances is permitted solely under the conditions stated below
gpl-3.0 93 no covered work shall be deemed part of an effective technological measure
gpl-2.0 92 accompany it with the complete corresponding machine readable source code
gpl 70 gnu gpl v ?[123](?: 0)?
gpl 60 free software foundation inc (?:51|59) (?:franklin street|temple place)
gpl-classpath 97 as a special exception (?:\w+ ){1,20}linking this library statically or dynamically with other modules
gpl-linking 94 as a special exception the copyright holders (?:\w+ ){1,10}give you permission to link
gpl-openssl 95 permission to link (?:\w+ ){1,12}with the openssl (?:project s )?(?:openssl )?library
gpl-autoconf 94 as a special exception (?:\w+ ){1,30}configure script generated by autoconf
gpl-bison 94 as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gcc-exception 95 gcc runtime library exception
lgpl 90 this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl-2.1 96 gnu lesser general public licen[cs]e version 2 1 february 1999
lgpl-2.0 96 gnu library general public licen[cs]e version 2 june 1991
lgpl-3.0 96 gnu lesser general public licen[cs]e version 3 29 june 2007
lgpl-2.1-or-later 95 gnu lesser general public licen[cs]e (?:\w+ ){1,12}either version 2 1 of the licen[cs]e or at your option any later version
lgpl 85 you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)
lgpl-2.1 93 a work that uses the library (?:\w+ ){0,12}falls outside the scope of this licen[cs]e
lgpl 92 you may copy and distribute verbatim copies of the library s complete source code
agpl-3.0 96 gnu affero general public licen[cs]e version 3 19 november 2007
agpl 94 your modified version must prominently offer all users interacting with it remotely through a computer network
agpl 90 under the terms of the gnu affero general public licen[cs]e as published by
agpl 85 you should have received a copy of the gnu affero general public licen[cs]e
gfdl 95 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 92 with no invariant sections no front cover texts and no back cover texts
gfdl 90 a copy of the licen[cs]e is included in the section entitled gnu free documentation licen[cs]e
mpl-2.0 96 this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 93 if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 93 incompatible with secondary licen[cs]es
mpl-1.1 96 the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-1.0 96 the contents of this file are subject to the mozilla public licen[cs]e version 1 0
mpl-1.1 92 alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e
npl 94 the contents of this file are subject to the netscape public licen[cs]e
epl-1.0 95 this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1 0
epl-2.0 95 this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v |version )?2 0
epl 90 any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cpl 94 this program and the accompanying materials are made available under the terms of the common public licen[cs]e
ibmpl 94 the accompanying program is provided under the terms of this ibm public licen[cs]e
cddl-1.0 95 the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl 92 when distributing covered code include this cddl header notice in each file
cddl 90 you can obtain a copy of the licen[cs]e at (?:\w+ ){0,8}opensolaris licen[cs]e
spl 92 the contents of this file are subject to the sun public licen[cs]e
eupl 95 licensed under the eupl (?:version |v )?1 [012](?: or as soon they will be approved by the european commission)?
eupl 90 the european union public licen[cs]e (?:the )?eupl applies to the work
artistic-1.0 94 the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 95 this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic 85 under the same terms as perl itself
artistic 84 you may distribute under the terms of either the gnu general public licen[cs]e or the artistic licen[cs]e
zlib 95 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 94 permission is granted to anyone to use this software for any purpose including commercial applications
zlib 93 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 93 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng 94 this copyright notice may not be removed or altered from any source or altered source distribution
boost-1.0 96 boost software licen[cs]e version 1 0 august 17th 2003
boost-1.0 94 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost-1.0 90 distributed under the boost software licen[cs]e version 1 0
unlicense 96 this is free and unencumbered software released into the public domain
unlicense 93 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 92 we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl 96 do what the fuck you want to public licen[cs]e
wtfpl 94 you just do what the fuck you want to
beerware 95 as long as you retain this notice you can do whatever you want with this stuff
beerware 90 you can buy me a beer in return
cc0-1.0 95 has (?:\w+ ){0,6}waived all copyright and related (?:or|and) neighboring rights
cc0-1.0 94 overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc0-1.0 85 cc0 1 0 universal
cc-by-4.0 90 creative commons attribution 4 0 international(?: public)? licen[cs]e
cc-by-3.0 90 creative commons attribution 3 0 (?:unported|united states|generic) licen[cs]e
cc-by-sa-4.0 92 creative commons attribution share ?alike 4 0 international(?: public)? licen[cs]e
cc-by-sa-3.0 92 creative commons attribution share ?alike 3 0 unported licen[cs]e
cc-by-nc-4.0 92 creative commons attribution non ?commercial 4 0 international(?: public)? licen[cs]e
cc-by-nc-sa-4.0 94 creative commons attribution non ?commercial share ?alike 4 0 international(?: public)? licen[cs]e
cc-by-nd-4.0 92 creative commons attribution no ?derivatives 4 0 international(?: public)? licen[cs]e
cc-by-nc-nd-4.0 94 creative commons attribution non ?commercial no ?derivatives 4 0 international(?: public)? licen[cs]e
cc-by 84 creativecommons org licen[cs]es by [1-4] [05]
cc-by-sa 86 creativecommons org licen[cs]es by sa [1-4] [05]
cc-by-nc 86 creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nc-sa 88 creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nd 86 creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-nc-nd 88 creativecommons org licen[cs]es by nc nd [1-4] [05]
cc0-1.0 86 creativecommons org publicdomain zero 1 0
cc-pdm 86 creativecommons org publicdomain mark 1 0
cc 70 to view a copy of this licen[cs]e visit (?:http|https) creativecommons org
cc-by 80 (?:this work is )?licensed under a creative commons attribution (?:[1-4] [05] )?(?:\w+ ){0,2}licen[cs]e
python-2.0 95 python software foundation licen[cs]e version 2
python-2.0 93 this licen[cs]e agreement is between the python software foundation psf and the individual or organization
python-2.0 92 psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e
cnri 92 corporation for national research initiatives
bitstream-vera 94 permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[cs]e
ofl-1.1 96 sil open font licen[cs]e version 1 1 26 february 2007
ofl-1.1 93 this font software is licensed under the sil open font licen[cs]e
ofl-1.1 92 the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects
ofl 90 the font software may be sold as part of a larger software package but no copy of one or more of the font typefaces may be sold by itself
odbl-1.0 94 open data commons open database licen[cs]e
odbl-1.0 90 this database is made available under the open database licen[cs]e
odc-by-1.0 94 open data commons attribution licen[cs]e
pddl-1.0 94 open data commons public domain dedication and licen[cs]e
openssl 95 this product includes software developed by the openssl project for use in the openssl toolkit
openssl 93 redistributions of any form whatsoever must retain the following acknowledgment
ssleay 94 this product includes cryptographic software written by eric young
postgresql 95 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
php-3.01 95 this product includes php (?:software )?freely available from
php-3.01 93 this source file is subject to version 3 0 ?1 of the php licen[cs]e
ruby 93 you may make and give away verbatim copies of the source form of the software without restriction
ruby 85 (?:ruby is )?copyrighted free software by yukihiro matsumoto
vim 94 vim is charityware
tcl 94 this software is copyrighted by the regents of the university of california sun microsystems
curl 95 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided (?:\w+ ){1,20}except as contained in this notice
icu 94 permission is hereby granted (?:\w+ ){3,20}copies of the unicode data files
unicode 93 distributed under the terms of use in (?:http|https) www unicode org copyright html
ntp 94 permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
hpnd 94 permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and )?without fee is hereby granted
w3c 94 w3c software (?:and document )?notice and licen[cs]e
w3c 92 by obtaining using and or copying this work you (?:\w+ ){0,3}agree that you have read understood and will comply
ms-pl 95 this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
ms-pl 85 microsoft public licen[cs]e ms pl
ms-rl 95 for any file you distribute that contains code from the software (?:in source code or binary format )?you must provide recipients the source code
ms-rl 86 microsoft reciprocal licen[cs]e ms rl
ms-eula 80 microsoft software licen[cs]e terms
afl-3.0 95 licensed under the academic free licen[cs]e version 3 0
osl-3.0 95 licensed under the open software licen[cs]e version 3 0
ncsa 95 university of illinois ncsa open source licen[cs]e
ncsa 93 redistributions in binary form must reproduce (?:\w+ ){1,20}with the software without specific prior written permission
llvm-exception 95 apache licen[cs]e v ?2 0 with llvm exceptions
sspl-1.0 96 server side public licen[cs]e version 1 october 16 2018
sspl 93 if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 96 business source licen[cs]e 1 1
busl-1.1 93 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 92 effective on the change date or the fourth anniversary of the first publicly available distribution
elastic-2.0 94 you may not provide the software to third parties as a hosted or managed service
elastic-2.0 92 you may not move change disable or circumvent the licen[cs]e key functionality
commons-clause 95 without limiting other conditions in the licen[cs]e the grant of rights under the licen[cs]e will not include (?:\w+ ){0,8}the right to sell the software
cecill 95 ce logiciel est regi par la licence cecill
cecill 94 this software is governed by the cecill (?:[bc] )?licen[cs]e under french law
upl-1.0 95 subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
blueoak-1.0 95 blue oak model licen[cs]e
blueoak-1.0 93 each contributor licenses you to do everything with this software that would otherwise infringe
parity 92 the parity public licen[cs]e
polyform 92 polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) licen[cs]e
json 96 the software shall be used for good not evil
jpeg 93 this software is based in part on the work of the independent jpeg group
freetype 94 portions of this software are copyright (?:\w+ ){1,4}the freetype project
imagemagick 92 imagemagick licen[cs]e
sleepycat 95 redistributions in any form must be accompanied by information on how to obtain complete source code
qpl 94 the q public licen[cs]e version 1 0
lppl 94 this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
lppl 90 the current maintainer of this work is
rpl 93 reciprocal public licen[cs]e
cpal 93 common public attribution licen[cs]e
watcom 93 sybase open watcom public licen[cs]e
apsl 93 apple public source licen[cs]e
nasa 93 nasa open source agreement
nokia 92 nokia open source licen[cs]e
intel 92 intel open source licen[cs]e
oracle 85 oracle binary code licen[cs]e agreement
oracle 82 oracle technology network licen[cs]e
sun 82 sun microsystems inc binary code licen[cs]e agreement
java-research 90 java research licen[cs]e
openldap 94 the openldap public licen[cs]e
mulan-2.0 94 mulan permissive software licen[cs]e
openrail 92 responsible ai licen[cs]e
llama 92 llama (?:[23] )?community licen[cs]e agreement
gemma 90 gemma terms of use
cdla 93 community data licen[cs]e agreement (?:permissive|sharing)
ogl-uk 92 open government licen[cs]e
etalab 90 licence ouverte open licen[cs]e
dl-de 90 datenlizenz deutschland
free-art 90 free art licen[cs]e
public-domain 75 (?:released into|placed in|dedicated to|contributed to) the public domain
public-domain 74 this (?:work|file|software|code) is (?:hereby )?(?:in|released into) the public domain
public-domain 73 no copyright is claimed and the (?:\w+ ){1,6}is in the public domain
us-government 72 this (?:software|work) was (?:developed|prepared|produced) (?:\w+ ){0,12}employees? of the (?:federal|united states|u s) government
proprietary 70 this software is the confidential and proprietary information of
proprietary 68 unauthorized copying of this file via any medium is strictly prohibited
proprietary 66 you may not reverse engineer decompile or disassemble
proprietary 60 may not be reproduced (?:\w+ ){0,12}without (?:the )?prior written permission
proprietary 50 for internal use only
proprietary 40 all rights reserved
dual 72 this (?:software|file|program|code|work) is dual licensed under
dual 70 (?:licensed|available) under either (?:of )?(?:\w+ ){1,10}at your option
trademark 45 is a registered trademark of
export 40 you may not export or re export (?:\w+ ){0,8}except in compliance with
no-warranty 42 the software is provided as is without warranty of any kind express or implied
see-file 55 see the (?:file )?licen[cs]e (?:txt |md )?(?:file )?for (?:details|more information|the full)
see-file 55 licen[cs]e that can be found in the licen[cs]e file
"""


def lines() -> list[tuple[str, int, str]]:
    """(label, priority, expression) of all signatures, in their order."""
    rows = [line.split(" ", 2) for line in SIGNATURES.strip().splitlines()]
    return [(label, int(priority), expression) for label, priority, expression in rows]
