"""Sentences of license texts and notices: label, keyword, regex over lower-cased words, and a sample that it finds."""

from __future__ import annotations

#: Fixed values, written one by one after the licenses' published texts; the more telling ones stand first within a family.
SENTENCES: list[tuple[str, str, str, str]] = [
    # permissive licenses of few sentences
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "as is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'),
    ("mit", "authors or copyright", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("mit", "tort or otherwise", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software", "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software"),
    ("mit", "mit", r"(?:released|distributed|available|licensed) under the (?:terms of the )?mit licen[sc]e", "This library is released under the terms of the MIT license."),
    ("mit", "mit", r"licen[sc]e mit", "License: MIT"),
    ("mit-0", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED"),
    ("mit-advertising", "advertising", r"this software (?:shall|may) not be used in advertising or otherwise to promote the sale", "This software shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation", "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("0bsd", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS"'),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib", "without any express", r"this software is provided as is without any express or implied warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib", "source distribution", r"this notice may not be removed or altered from any source distribution", "This notice may not be removed or altered from any source distribution."),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "do what the", r"do what the f\S+ you want to public licen[sc]e", "DO WHAT THE F*CK YOU WANT TO PUBLIC LICENSE".replace("*", "U")),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("boost-1.0", "boost", r"distributed under the boost software licen[sc]e version 1 0", "Distributed under the Boost Software License, Version 1.0."),
    ("boost-1.0", "machine executable", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor"),
    ("ncsa", "endorse or promote", r"neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the names of the group, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission"),
    ("curl", "copyright holder shall", r"except as contained in this notice the name of a copyright holder shall not be used in advertising", "Except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[sc]e(?: version 1 0 0)?", "Blue Oak Model License, Version 1.0.0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: \(upl\))?(?: version 1 0)?", "The Universal Permissive License, Version 1.0"),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained with the works", "Usage of the works is permitted provided that this instrument is retained with the works"),
    ("postgresql", "without a written", r"for any purpose without fee and without a written agreement is hereby granted", "for any purpose, without fee, and without a written agreement is hereby granted"),
    ("json", "good not evil", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("vim", "vim", r"(?:distributed|available) under the (?:terms of the )?vim licen[sc]e", "It is distributed under the Vim license."),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e", "See the ImageMagick license."),
    ("libpng", "png reference", r"(?:the )?png reference library licen[sc]e", "PNG Reference Library License version 2"),
    ("ftl", "freetype", r"(?:the )?freetype project licen[sc]e", "The FreeType Project LICENSE"),
    ("icu", "unicode", r"unicode inc licen[sc]e agreement data files and software", "UNICODE, INC. LICENSE AGREEMENT - DATA FILES AND SOFTWARE"),
    ("ntp", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("afl-3.0", "academic free", r"licensed under the academic free licen[sc]e version 3 0", "Licensed under the Academic Free License version 3.0"),
    # berkeley kinds
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "binary form must", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd", "copyright holders and", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("bsd", "procurement of", r"including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption", "including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption"),
    ("bsd", "bsd", r"(?:released|distributed|available|licensed) under (?:the terms of )?(?:the|a) bsd(?: style)? licen[sc]e", "It is distributed under a BSD-style license."),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this licen[sc]e", "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE"),
    ("bsd-3-clause-nuclear", "nuclear facility", r"this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "this software is not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit."),
    ("ssleay", "cryptographic software", r"this product includes cryptographic software written by eric young", "This product includes cryptographic software written by Eric Young"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)", "This product includes software developed by the Apache Software Foundation"),
    # apache
    ("apache-2.0", "apache", r"licensed under the apache licen[sc]e version 2 0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache-2.0", "in compliance with", r"you may not use this file except in compliance with the licen[sc]e", "you may not use this file except in compliance with the License."),
    ("apache-2.0", "obtain a copy", r"you may obtain a copy of the licen[sc]e at http s? ?www apache org licenses license 2 0", "You may obtain a copy of the License at https www.apache.org/licenses/LICENSE-2.0".replace("https www", "http s www")),
    ("apache-2.0", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("apache-2.0", "conditions of any kind", r"without warranties or conditions of any kind either express or implied", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "specific language", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "terms and conditions for use", r"terms and conditions for use reproduction and distribution", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-2.0", "perpetual worldwide", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?licen[sc]e", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    # general public licenses
    ("gpl", "free software", r"this program is free software you can redistribute it and(?: or)? modify it under the terms of the gnu general public licen[sc]e", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3.0-or-later", "version 3", r"either version 3 of the licen[sc]e or (?:at your option )?any later version", "either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0-or-later", "version 2", r"either version 2 of the licen[sc]e or (?:at your option )?any later version", "either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0-only", "version 2", r"under the terms of the gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl", "will be useful", r"this program is distributed in the hope that it will be useful but without any warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl", "should have received", r"you should have received a copy of the gnu general public licen[sc]e along with", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e for more details", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "freedom to share", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl-exception-classpath", "exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "As a special exception, the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-exception-gcc", "runtime library exception", r"gcc runtime library exception", "under the terms of the GCC Runtime Library Exception, version 3.1"),
    ("gpl-exception-openssl", "openssl", r"permission to link the code of portions of this program with the openssl library", "permission to link the code of portions of this program with the OpenSSL library"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and(?: or)? modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl-2.1-or-later", "version 2 1", r"either version 2 1 of the licen[sc]e or (?:at your option )?any later version", "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "should have received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("lgpl", "portion of the library", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "A program that contains no derivative of any portion of the Library, but is designed to work with the Library"),
    ("agpl", "free software", r"this program is free software you can redistribute it and(?: or)? modify it under the terms of the gnu affero general public licen[sc]e", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("agpl", "remotely through", r"all users interacting with it remotely through a computer network", "all users interacting with it remotely through a computer network"),
    ("agpl", "should have received", r"you should have received a copy of the gnu affero general public licen[sc]e along with", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and(?: or)? modify this document under the terms of the gnu free documentation licen[sc]e", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("gfdl", "invariant sections", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("fsf-all-permissive", "copying and distribution", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    ("fsf-unlimited", "unlimited permission", r"gives unlimited permission to copy and(?: or)? distribute it with or without modifications as long as this notice is preserved", "gives unlimited permission to copy and/or distribute it, with or without modifications, as long as this notice is preserved."),
    # weak copyleft
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2.0-no-copyleft-exception", "incompatible with secondary", r"this source code form is incompatible with secondary licenses", "This Source Code Form is \"Incompatible With Secondary Licenses\""),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-1.1", "rights and limitations", r"see the licen[sc]e for the specific language governing rights and limitations under the licen[sc]e", "See the License for the specific language governing rights and limitations under the License."),
    ("npl", "netscape", r"the contents of this file are subject to the netscape public licen[sc]e", "The contents of this file are subject to the Netscape Public License"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("epl-2.0", "eclipse", r"which is available at https? (?:www )?eclipse org legal epl 2 0", "which is available at https eclipse.org/legal/epl-2.0"),
    ("epl", "constitutes recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e (?:v|version) ?1 0", "the Eclipse Distribution License v1.0"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cddl", "cddl header", r"when distributing covered code include this cddl header notice in each file", "When distributing Covered Code, include this CDDL HEADER NOTICE in each file"),
    ("eupl", "eupl", r"licensed under the eupl(?: version)?", "Licensed under the EUPL, Version 1.2 or later"),
    ("ms-pl", "accompanying software", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", "This license governs use of the accompanying software. If you use the software, you accept this license."),
    ("osl-3.0", "open software", r"licensed under the open software licen[sc]e version 3 0", "Licensed under the Open Software License version 3.0"),
    ("artistic-2.0", "standard version", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "You are permitted to use the Standard Version and create and use Modified Versions for any purpose without restriction"),
    ("artistic-perl", "perl itself", r"(?:it )?under the same terms as perl itself", "you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("ruby", "ruby", r"(?:it )?under (?:either )?the (?:same )?terms (?:of|as) (?:the )?ruby(?: s)?(?: licen[sc]e| itself)", "under the same terms as Ruby itself"),
    ("cecill", "cecill", r"(?:ce logiciel est )?regi par la licence cecill", "Ce logiciel est regi par la licence CeCILL"),
    ("sleepycat", "complete source code", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the (?:db )?software", "Redistributions in any form must be accompanied by information on how to obtain complete source code for the DB software"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?: version 1 0)?", "the IBM Public License Version 1.0"),
    ("sissl", "sun industry", r"sun industry standards source licen[sc]e", "the Sun Industry Standards Source License"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font licen[sc]e version 1 1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name s", "No Modified Version of the Font Software may use the Reserved Font Name(s)"),
    ("lppl", "latex", r"this work may be distributed and(?: or)? modified under the conditions of the latex project public licen[sc]e", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License"),
    ("python-2.0", "python", r"psf is making python available to licensee on an as is basis", 'PSF is making Python available to Licensee on an "AS IS" basis.'),
    ("cnri-python", "cnri", r"cnri (?:open source )?licen[sc]e agreement", "CNRI LICENSE AGREEMENT FOR PYTHON"),
    # sharing of works and data
    ("cc", "creative commons", r"this work is licensed under (?:a|the) creative commons", "This work is licensed under a Creative Commons licence."),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0 international(?: public)? licen[sc]e", "under the Creative Commons Attribution 4.0 International Public License"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike 4 0 international(?: public)? licen[sc]e", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non ?commercial 4 0 international(?: public)? licen[sc]e", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa-4.0", "creative commons", r"creative commons attribution non ?commercial share ?alike 4 0 international(?: public)? licen[sc]e", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd-4.0", "creative commons", r"creative commons attribution no ?derivatives 4 0 international(?: public)? licen[sc]e", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa-3.0", "creative commons", r"creative commons attribution share ?alike 3 0 unported(?: licen[sc]e)?", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("cc-by-3.0", "creative commons", r"creative commons attribution 3 0 unported(?: licen[sc]e)?", "Creative Commons Attribution 3.0 Unported License"),
    ("cc0", "related or neighboring", r"waived all copyright and related or neighboring rights to this work", "the person has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc-pdm", "creativecommons", r"creativecommons org publicdomain mark 1 0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("odbl-1.0", "open database", r"(?:made )?available under the open database licen[sc]e", "is made available under the Open Database License"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e", "the Open Data Commons Attribution License"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e", "the Open Data Commons Public Domain Dedication and License"),
    ("cdla-permissive-2.0", "community data", r"community data licen[sc]e agreement permissive(?: version)? 2 0", "Community Data License Agreement - Permissive - Version 2.0"),
    ("cdla-sharing-1.0", "community data", r"community data licen[sc]e agreement sharing(?: version)? 1 0", "Community Data License Agreement - Sharing - Version 1.0"),
    ("ogl-uk-3.0", "open government", r"(?:licensed under the )?open government licen[sc]e v(?:ersion)? ?3 0", "licensed under the Open Government Licence v3.0"),
    ("ogl-uk", "public sector information", r"contains public sector information licensed under the open government licen[sc]e", "Contains public sector information licensed under the Open Government Licence."),
    ("etalab-2.0", "etalab", r"(?:licence ouverte|open licen[sc]e) (?:v|version )?2 0 etalab|etalab open licen[sc]e", "Etalab Open License"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland namensnennung (?:version )?2 0", "Datenlizenz Deutschland Namensnennung Version 2.0"),
    ("open-publication", "open publication", r"open publication licen[sc]e(?: v1 0)?", "the Open Publication License, v1.0"),
    ("gutenberg", "ebook", r"this ebook is for the use of anyone anywhere .{0,80}at no cost and with almost no restrictions whatsoever", "This eBook is for the use of anyone anywhere in the world at no cost and with almost no restrictions whatsoever."),
    # models
    ("openrail-m", "rail", r"(?:creativeml |bigscience )?open ?rail\+? ?m licen[sc]e", "the CreativeML OpenRAIL M License"),
    ("rail-use-restrictions", "use the model", r"you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law", "You agree not to use the Model or Derivatives of the Model in any way that violates any applicable national, federal, state, local or international law"),
    ("community-model", "community licen", r"(?:the )?\S+ \S+ community licen[sc]e agreement", "the Some Model Community License Agreement"),
    ("research-only", "research purposes", r"for (?:non ?commercial )?(?:academic )?research purposes only", "The weights are for non-commercial research purposes only."),
    # source available and closed
    ("sspl-1.0", "service source code", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available", "If you make the functionality of the Program or a modified version available to third parties as a service, you must make the Service Source Code available"),
    ("busl-1.1", "change date", r"effective on the change date or the fourth anniversary of the first publicly available distribution", "Effective on the Change Date, or the fourth anniversary of the first publicly available distribution"),
    ("elastic-2.0", "managed service", r"you may not provide the software to third parties as a hosted or managed service", "You may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause licen[sc]e condition", '"Commons Clause" License Condition v1.0'),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial licen[sc]e", "PolyForm Noncommercial License 1.0.0"),
    ("polyform-small-business", "polyform", r"polyform small business licen[sc]e", "PolyForm Small Business License 1.0.0"),
    ("polyform-shield", "polyform", r"polyform shield licen[sc]e", "PolyForm Shield License 1.0.0"),
    ("proprietary", "unauthorized copying", r"unauthorized copying (?:or (?:use|distribution) )?of this (?:file|software|document|program)(?: via any medium)? is strictly prohibited", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("proprietary", "confidential", r"this (?:document|file|software|material) (?:is|contains) (?:confidential|proprietary)(?: and (?:confidential|proprietary))? information", "This document contains confidential and proprietary information of the company."),
    ("proprietary", "reverse engineer", r"you may not (?:copy |modify )?(?:reverse engineer|decompile|disassemble)", "You may not reverse engineer, decompile or disassemble the product."),
    ("proprietary", "prior written", r"no part of this (?:publication|document|book|work) may be reproduced(?: stored| distributed| or)* .{0,80}without the prior written permission", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher"),
    ("proprietary", "end user", r"end user licen[sc]e agreement", "the End User License Agreement"),
    ("proprietary", "trade secret", r"contains (?:valuable )?trade secrets (?:and|of)", "This program contains valuable trade secrets of its owner."),
    ("noncommercial", "commercial use", r"(?:for )?non ?commercial use only", "for non-commercial use only"),
    ("noncommercial", "commercial use", r"commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted|not allowed)", "Commercial use is strictly prohibited."),
    ("personal-use", "personal use", r"(?:for )?personal use only", "free for personal use only"),
    ("freeware", "freeware", r"(?:distributed|released|licensed) as freeware", "It is distributed as freeware."),
    ("shareware", "shareware", r"(?:this (?:program|software) is|distributed as|released as) shareware", "This program is shareware."),
    ("us-government", "a work of the", r"(?:is|as) a work of the u(?:nited)? ?s(?:tates)? government", "This is a work of the United States Government."),
    ("us-government-rights", "restricted rights", r"u s government (?:users )?restricted rights", "U.S. Government Users Restricted Rights"),
    ("public-domain", "public domain", r"(?:has been|is|was|are) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain", "This file has been placed in the public domain."),
    ("public-domain", "disclaim", r"(?:the )?authors? (?:hereby )?disclaims? (?:all )?copyright to this source code", "The author disclaims copyright to this source code."),
    ("no-license", "is granted", r"no licen[sc]e (?:express or implied )?is granted", "No license, express or implied, is granted."),
]

#: Identifiers that a line "SPDX-License-Identifier:" may name.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC "
    "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 "
    "Unlicense UPL-1.0 Vim WTFPL X11 Zlib ZPL-2.1"
).split()
