r"""Licence detection by ordered signature rules.

Hand-written families (a label, a name pattern, an SPDX pattern, versions, web addresses) are put through
hand-written forms (SPDX tag, address, grant, name with version, name with the word licence, bare title),
which gives some hundreds of regexes; beside them stand signatures of licence bodies, file headers, notices, exceptions and
choices. Each has keywords of which one must stand in the text before it is tried (all are looked for in one pass), a
priority by its form, and a confidence. Detections are taken in order of priority, length and place; one whose
interval lies within an accepted one is suppressed.

Base phrases are found apart, by words, and always count.

Defined results: A-Z count as lower case; a null text counts as empty; nothing found gives no label and
score 0; repeated rows are scanned each; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantsieve.llm._shared import LOWER, UPPER

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_CONFIDENCE = 0.6
_SEPARATORS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

# Label, keywords (every match of the name holds one), name, SPDX id, web address (each but the first two a regex on lower-cased text).
FAMILIES = [
    ("mit", "mit", r"(?:the )?mit", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    ("apache", "apache", r"(?:the )?apache(?: software)?", r"apache-[\d.]+", r"apache\.org/licenses"),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public", r"gpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", ("lesser general public", "library general public"), r"(?:the )?(?:gnu )?(?:lesser|library) general public", r"lgpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public", r"agpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "free documentation", r"(?:the )?(?:gnu )?free documentation", r"gfdl-[\d.]+(?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified|2-clause|two-clause|freebsd) bsd|bsd 2-clause", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new|modified|revised|3-clause|three-clause) bsd|bsd 3-clause", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd", "bsd", r"(?:the )?(?:original |4-clause )?bsd", r"bsd-4-clause|0bsd", r"opensource\.org/licenses?/bsd-license"),
    ("isc", "isc", r"(?:the )?isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl", "mozilla", r"(?:the )?mozilla public", r"mpl-[\d.]+", r"mozilla\.org/mpl"),
    ("epl", "eclipse", r"(?:the )?eclipse public", r"epl-[\d.]+", r"eclipse\.org/legal/epl"),
    ("cddl", "common development", r"(?:the )?common development and distribution", r"cddl-[\d.]+", r"opensource\.org/licenses?/cddl"),
    ("cpl", "common public", r"(?:the )?common public", r"cpl-[\d.]+", r"opensource\.org/licenses?/cpl"),
    ("eupl", "european union public", r"(?:the )?european union public", r"eupl-[\d.]+", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic", r"artistic-[\d.]+", r"opensource\.org/licenses?/artistic"),
    ("boost", "boost", r"(?:the )?boost software", r"bsl-1\.0", r"boost\.org/license"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?", r"zlib", r"zlib\.net/zlib_license"),
    ("psf", "python", r"(?:the )?python(?: software foundation)?", r"psf-[\d.]+|python-[\d.]+", r"python\.org/psf/license"),
    ("php", "php", r"(?:the )?php", r"php-[\d.]+", r"php\.net/license"),
    ("ruby", "ruby", r"(?:the )?ruby", r"ruby", r"ruby-lang\.org/\S*licen"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software(?: and document)?)?", r"w3c(?:-[\d]+)?", r"w3\.org/consortium/legal"),
    ("openssl", "openssl", r"(?:the )?openssl", r"openssl", r"openssl\.org/source/license"),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font", r"ofl-[\d.]+", r"scripts\.sil\.org/ofl"),
    ("wtfpl", "do what the", r"(?:the )?do what the f\w+ you want to public", r"wtfpl", r"wtfpl\.net"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("postgresql", "postgresql", r"(?:the )?postgresql", r"postgresql", r"postgresql\.org/about/licence"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft (?:public|reciprocal)", r"ms-(?:pl|rl)", r"opensource\.org/licenses?/ms-"),
    ("odbl", ("open database", "open data commons"), r"(?:the )?open (?:data commons )?(?:open )?database", r"odbl-[\d.]+", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"(?:the )?open data commons attribution", r"odc-by-[\d.]+", r"opendatacommons\.org/licenses/by"),
    ("cc0", ("cc0", "zero"), r"(?:the )?(?:creative commons )?(?:cc0|cc zero)(?: universal)?", r"cc0-[\d.]+", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", ("by-nc-nd", "noncommercial", "non-commercial"), r"(?:cc(?:-| )by-nc-nd|creative commons attribution(?:-| )?non-?commercial(?:-| )?no-?deriv\w+)", r"cc-by-nc-nd-[\d.]+", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", ("by-nc-sa", "noncommercial", "non-commercial"), r"(?:cc(?:-| )by-nc-sa|creative commons attribution(?:-| )?non-?commercial(?:-| )?share-?alike)", r"cc-by-nc-sa-[\d.]+", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", ("by-nc", "noncommercial", "non-commercial"), r"(?:cc(?:-| )by-nc|creative commons attribution(?:-| )?non-?commercial)", r"cc-by-nc-[\d.]+", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", ("by-nd", "noderiv", "no-deriv"), r"(?:cc(?:-| )by-nd|creative commons attribution(?:-| )?no-?deriv\w+)", r"cc-by-nd-[\d.]+", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", ("by-sa", "sharealike", "share-alike"), r"(?:cc(?:-| )by-sa|creative commons attribution(?:-| )?share-?alike)", r"cc-by-sa-[\d.]+", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", ("cc-by", "cc", "attribution"), r"(?:cc(?:-| )by|creative commons attribution)", r"cc-by-[\d.]+", r"creativecommons\.org/licenses/by/"),
    ("public-domain", "public domain", r"(?:the )?public domain", r"public-domain", r"creativecommons\.org/publicdomain/mark"),
    ("proprietary", "proprietary", r"(?:a |the )?proprietary", r"licenseref-proprietary", r"proprietary-license"),
]
_VERSION = r"(?:,? (?:version |v\.?(?: )?)?\d+(?:\.\d+)*(?: or (?:any )?later(?: version)?)?)"
_WORD = r"licen[cs]es?"
# Form, priority, confidence, whether it takes the SPDX id or the address for the name, and the regex around it.
FORMS = [
    ("spdx", 6, 0.99, "spdx", r"spdx-license-identifier:?\s*(?:[()\w.+-]{{1,60}}[\t\x20]+(?:and|or|with)[\t\x20]+){{0,20}}\(*(?P<id>{name})(?![\w-]|\.\w)"),
    ("address", 5, 0.95, "address", r"(?:https?://)?(?:www\.)?(?:{name})"),
    ("grant", 4, 0.9, "name", r"(?:licensed|released|distributed|available|published|licenced|offered|made available|redistributed?) under (?:the terms of )?(?:a |an )?(?:{name})(?: {word})?{version}?"),
    ("field", 4, 0.85, "name", r"\b{word}(?: )?[:=](?: )?[\"']?(?:{name})(?: {word})?{version}?"),
    ("versioned", 3, 0.8, "name", r"\b(?:{name}) {word}{version}"),
    ("dedicated", 3, 0.8, "only public-domain", r"\b(?:dedicated|placed|released) (?:to|in|into) (?:{name})\b"),
    ("title", 2, 0.6, "name", r"\b(?:{name}) {word}\b"),
]


# Label, form, keywords, and words of a licence's own text, of a file's header, of an exception or of a choice of licences.
# A space stands for any white space and comment marks, "..." for up to 80 characters.
TEXTS = [
    ("mit", "body", "permission is hereby granted, free of charge, to any person obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "condition", "permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("boost", "body", "to any person or organization obtaining", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("isc", "body", "permission to use, copy, modify, and", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "body", "permission to use, copy, modify, and", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "body", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "condition", "endorse or promote products", r"neither the names? of ... may be used to endorse or promote products derived from this software"),
    ("bsd", "condition", "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "condition", "binary form must reproduce the above copyright", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "header", "bsd-style", r"governed by a bsd-style licen[cs]e"),
    ("apache", "header", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache", "header", "to you under the apache license", r"licenses this file to you under the apache license"),
    ("apache", "body", "subject to the terms and conditions of this license, each contributor", r"subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual"),
    ("gpl", "header", "this program is free software", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "notice", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license"),
    ("gpl", "body", "intended to guarantee your freedom to share", r"the gnu general public license is intended to guarantee your freedom to share and change"),
    ("lgpl", "header", "this library is free software", r"this library is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "notice", ("copy of the gnu lesser", "copy of the gnu library"), r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "header", "under the terms of the gnu affero", r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("agpl", "notice", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "header", "permission is granted to copy, distribute and/or modify this document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "header", "this source code form is subject to", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "header", "subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license"),
    ("epl", "header", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl", "header", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("cddl", "header", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "header", "licensed under the eupl", r"licensed under the eupl"),
    ("artistic", "header", "same terms as perl itself", r"(?:redistribute it and/or modify it )?under the same terms as perl itself"),
    ("zlib", "body", "without any express or implied warranty. in no event will the authors", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", "condition", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "body", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "body", "you just do what the", r"you just do what the f\w+ you want to"),
    ("cc0", "body", "dedicated the work to the public domain", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "notice", "waived all copyright", r"has waived all copyright and related or neighboring rights to"),
    ("public-domain", "notice", "the public domain", r"(?:is|are|was|were) (?:hereby )?(?:placed|put|released) (?:in|into) the public domain"),
    ("public-domain", "notice", "no copyright is claimed", r"no copyright is claimed"),
    ("ofl", "header", "licensed under the sil open font", r"this font software is licensed under the sil open font license"),
    ("php", "header", "subject to version", r"this source file is subject to version [\d.]+ of the php license"),
    ("python", "body", "psf hereby grants", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license"),
    ("openssl", "condition", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ms-pl", "body", "this license governs use of the accompanying software", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("cc-by", "notice", "this work is licensed under a creative commons", r"this work is licensed under a creative commons attribution [\d.]+"),
    ("cc-by-sa", "notice", "attribution-sharealike", r"this work is licensed under (?:a|the) creative commons attribution-sharealike"),
    ("classpath-exception", "exception", "classpath", r"(?:with|the) (?:the )?(?:gnu )?classpath[-\s]exception"),
    ("gcc-exception", "exception", "gcc runtime library exception", r"gcc runtime library exception"),
    ("llvm-exception", "exception", "llvm", r"(?:with )?(?:the )?llvm[-\s]exceptions?"),
    ("linking-exception", "exception", "special exception", r"as a special exception, ... (?:gives?|give you|have) permission to link"),
    ("autoconf-exception", "exception", "configure script generated by autoconf", r"a configure script generated by autoconf"),
    ("bison-exception", "exception", "bison parser skeleton", r"part or all of the bison parser skeleton"),
    ("font-exception", "exception", "embed this font", r"if you create a document which uses this font, and embed this font"),
    ("linux-syscall-note", "exception", "syscall", r"linux-syscall-note"),
    ("dual", "choice", "dual", r"dual[-\s]licen[cs]ed"),
    ("dual", "choice", "licensed under either of", r"licensed under either of"),
    ("dual", "choice", "alternatively, ", r"alternatively, ... may be (?:used|distributed|licensed) under the terms of"),
    ("proprietary", "notice", "confidential", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "notice", "may be reproduced", r"no part of this ... may be reproduced"),
    ("proprietary", "notice", "unauthorized copying of this file", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    # More of what licences, headers and notices say.
    ("mit", "condition", "to deal in the software without restriction", r"to deal in the software without restriction, including without limitation the rights to use"),
    ("mit", "header", "mit-style", r"governed by an mit-style licen[cs]e"),
    ("mit", "notice", "expat", r"(?:released|licensed|distributed) under the (?:terms of the )?expat licen[cs]e"),
    ("mit", "notice", "x11", r"(?:released|licensed|distributed) under the (?:terms of the )?x11 licen[cs]e"),
    ("mit", "condition", "portions of the software", r"copies or substantial portions of the software"),
    ("bsd-2-clause", "condition", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "condition", "this software is provided by the copyright holders", r"this software is provided by the copyright holders and contributors \"?as is\"? and any express or implied warranties"),
    ("bsd", "condition", "regents", r"this software is provided by the regents and contributors"),
    ("bsd-3-clause", "condition", "contributors may be used to endorse", r"names of its contributors may be used to endorse or promote products"),
    ("bsd", "header", "governed", r"use of this source code is governed by a bsd(?:-style)? licen[cs]e that can be found in the"),
    ("apache", "header", "distributed on an", r"distributed on an \"?as is\"? basis, without warranties or conditions of any kind"),
    ("apache", "header", "contributor license agreements", r"licensed to the apache software foundation (?:\(asf\) )?under one or more contributor license agreements"),
    ("apache", "notice", "asf licenses this file", r"the asf licenses this file to you"),
    ("apache", "notice", "developed by the apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", "condition", "patent license to make", r"royalty-free, irrevocable ... patent license to make, have made, use"),
    ("apache", "condition", "either express or implied", r"without warranties or conditions of any kind, either express or implied"),
    ("gpl", "condition", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("gpl", "header", "either version", r"as published by the free software foundation[;,] either version [\d.]+ of the license"),
    ("gpl", "notice", "temple place", r"free software foundation, inc\., 59 temple place"),
    ("gpl", "notice", "franklin street", r"free software foundation, inc\., 51 franklin street"),
    ("gpl", "body", "preamble", r"preamble the licenses for most software are designed to take away your freedom"),
    ("gpl", "condition", "work based on the program", r"a \"?work based on the program\"? means"),
    ("gpl", "condition", "complete corresponding", r"accompany it with the complete corresponding machine-readable source code"),
    ("gpl", "notice", "gpl", r"\bgpl(?: )?v(?: )?3"),
    ("gpl", "notice", "gpl", r"\bgpl(?: )?v(?: )?2"),
    ("lgpl", "notice", "lgpl", r"\blgpl(?: )?v(?: )?[23]"),
    ("lgpl", "body", "applies to some specially designated", r"this license, the (?:lesser|library) general public license, applies to some specially designated"),
    ("lgpl", "condition", "work that uses the library", r"a \"?work that uses the library\"?"),
    ("lgpl", "header", "library", r"this file is part of the ... library\. this library is free software"),
    ("agpl", "condition", "interacting with it remotely", r"users interacting with it remotely through a computer network"),
    ("agpl", "notice", "agpl", r"\bagpl(?: )?v(?: )?3"),
    ("gfdl", "condition", "invariant sections", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", "condition", "entitled", r"a copy of the license is included in the section entitled \"?gnu free documentation license"),
    ("mpl", "header", "you can obtain one at", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl", "header", "version: mpl", r"version: mpl 1\.1"),
    ("mpl", "condition", "initial developer", r"the initial developer of the original code is"),
    ("mpl", "condition", "secondary licenses", r"incompatible with secondary licenses"),
    ("mpl", "choice", "alternatively,", r"alternatively, the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl", "body", "constitutes recipient", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("epl", "notice", "epl-v", r"eclipse\.org/legal/epl-v[\d]+"),
    ("epl", "notice", "distribution license v1", r"eclipse distribution license v(?: )?\.?1"),
    ("cddl", "condition", "cddl header", r"cddl header start"),
    ("cddl", "notice", "usr/src/opensolaris", r"usr/src/opensolaris\.license"),
    ("cpl", "body", "under this common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("eupl", "header", "version of the eupl", r"subsequent versions of the eupl"),
    ("eupl", "condition", "european commission", r"as soon they will be approved by the european commission"),
    ("artistic", "body", "semblance of artistic control", r"maintains some semblance of artistic control over the development of the package"),
    ("artistic", "condition", "standard version", r"you may make and give away verbatim copies of the source form of the standard version"),
    ("boost", "condition", "machine-executable object code", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("boost", "header", "license_1_0.txt", r"license_1_0\.txt or copy at"),
    ("zlib", "condition", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "condition", "removed or altered from any source", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", "header", "zlib.h", r"for conditions of distribution and use, see copyright notice in zlib\.h"),
    ("python", "body", "beopen", r"beopen python open source license agreement"),
    ("python", "condition", "psf is making python available", r"psf is making python available to licensee on an \"?as is\"? basis"),
    ("php", "condition", "php\" must not be used", r"the name \"?php\"? must not be used to endorse or promote products"),
    ("php", "notice", "includes php software", r"this product includes php software, freely available from"),
    ("ruby", "header", "terms of ruby", r"(?:distributed|released) under the (?:same )?terms (?:as|of) ruby"),
    ("w3c", "body", "w3c software notice", r"w3c software notice and license"),
    ("w3c", "notice", "obtaining,", r"by obtaining, using and/or copying this work, you \(the licensee\) agree"),
    ("openssl", "condition", "cryptographic software written by eric", r"this product includes cryptographic software written by eric young"),
    ("openssl", "exception", "link this program with the openssl", r"link (?:this program|the code of portions of this program) with the openssl library"),
    ("ofl", "body", "goals", r"the goals of the open font license \(ofl\) are to stimulate worldwide development"),
    ("ofl", "condition", "reserved font name", r"with reserved font names?"),
    ("wtfpl", "notice", "wtfpl", r"(?:under|terms of) the wtfpl"),
    ("unlicense", "condition", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "condition", "dedicate any and all copyright", r"dedicate any and all copyright interest in the software to the public domain"),
    ("postgresql", "body", "and without a written agreement", r"without fee, and without a written agreement is hereby granted"),
    ("ms-pl", "condition", "bring a patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed"),
    ("ms-pl", "notice", "microsoft", r"microsoft (?:public|reciprocal) license \(ms-[pr]l\)"),
    ("odbl", "header", "made available under the open database", r"made available under the open database license"),
    ("odc-by", "header", "odc", r"made available under the odc attribution license"),
    ("odc-by", "notice", ("pddl", "dedication"), r"open data commons public domain dedication (?:and|&) licen[cs]e(?: \(pddl\))?|pddl(?:-| )1\.0"),
    ("cc0", "body", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc0", "header", "to the extent possible under law", r"to the extent possible under law, ... (?:has|have) waived"),
    ("cc-by", "condition", "appropriate credit", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-nc", "condition", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "condition", "contributions under the same license", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "condition", "distribute the modified material", r"you may not distribute the modified material"),
    ("cc-by", "notice", "some rights reserved", r"some rights reserved"),
    ("cc-by-sa", "notice", "available", r"text is available under the creative commons attribution-share-?alike license"),
    ("public-domain", "notice", "author disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "notice", "work of the united states government", r"(?:is|as) a work of the (?:united states|u\.s\.) government"),
    ("public-domain", "notice", "not subject to copyright protection", r"not subject to copyright protection (?:in the united states|within the united states)"),
    ("bsl", "body", "business source license", r"business source license 1\.1"),
    ("bsl", "condition", "change date", r"change date: ... change license:"),
    ("sspl", "body", "server side public", r"server side public license"),
    ("elastic", "header", "elastic license", r"elastic license(?: 2\.0)?"),
    ("commons-clause", "condition", "commons clause", r"commons clause(?:\"? license condition| restriction)?"),
    ("json", "condition", "shall be used for good", r"the software shall be used for good, not evil"),
    ("beerware", "body", "beer", r"beer-?ware licen[cs]e|you can buy me a beer in return"),
    ("ftl", "body", "freetype", r"freetype project license|this software is based in part of the work of the freetype team"),
    ("libpng", "condition", "png reference library", r"the png reference library is supplied \"?as is"),
    ("ijg", "notice", "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("icu", "body", "unicode data files", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("curl", "notice", "stenberg", r"copyright and permission notice copyright \(c\) ... daniel stenberg"),
    ("ncsa", "body", "university of illinois", r"university of illinois/ncsa open source license"),
    ("vim", "body", "vim", r"(?:distributed under|same terms as) (?:the )?vim(?: license)?\b"),
    ("ecl", "header", "educational community license", r"licensed under the educational community license"),
    ("afl", "header", "academic free license", r"licensed under the academic free license"),
    ("osl", "header", "open software license", r"licensed under the open software license"),
    ("cecill", "header", "cecill", r"governed by the cecill(?:-[bc])? licen[cs]e"),
    ("proprietary", "notice", "written", r"without (?:the )?(?:express |prior )*written (?:permission|consent) of the (?:copyright holder|copyright owner|author|publisher|company)"),
    ("proprietary", "notice", "trade secrets", r"contains (?:confidential information and )?trade secrets of"),
    ("proprietary", "notice", "internal use only", r"for internal use only"),
    ("proprietary", "body", "end user license agreement", r"end(?:-| )user licen[cs]e agreement"),
    ("universal-foss-exception", "exception", "foss exception", r"universal foss exception"),
    ("swift-exception", "exception", "runtime library exception", r"apache license,? (?:version )?2\.0 with runtime library exception"),
    ("qt-exception", "exception", "qt lgpl exception", r"(?:the )?qt (?:company )?(?:lgpl|gpl) exception"),
    ("openjdk-exception", "exception", "assembly exception", r"openjdk assembly exception"),
    ("dual", "choice", "at your option", r"(?:under|of) the ... licen[cs]e,? (?:or|and) the ... licen[cs]e,? at your option"),
    ("dual", "choice", ("disjunction", "licensed", "licenced"), r"disjunction of the licen[cs]es|multi(?:-| )licen[cs]ed|tri(?:-| )licen[cs]ed"),
    ("all-rights-reserved", "notice", "all rights reserved", r"all rights reserved"),
]
# Form, priority and confidence of TEXTS.
TEXT_FORMS = {"body": (5, 0.95), "header": (5, 0.95), "condition": (3, 0.7), "notice": (3, 0.7), "exception": (3, 0.7), "choice": (2, 0.5)}
_GAP = r"[\s*#/;]+"


def _flexible(text: str) -> str:
    return text.replace(" ... ", r" [^\0]{1,80}? ").replace(" ", _GAP)


def _words(keywords: tuple[str, ...]) -> tuple[str, ...]:
    """Keywords of several words stand in a wrapped text in parts: their longest word is looked for."""
    found = tuple(dict.fromkeys(max(k.split(), key=len, default="") for k in keywords))
    if not all(found):
        raise ValueError("a rule with an empty keyword would never be tried")
    return found


_LOWERED = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """Every family in every form, by priority."""
    made = []
    for label, keywords, name, spdx, address in FAMILIES:
        for form, priority, confidence, kind, around in FORMS:
            if kind.startswith("only ") and kind != f"only {label}":
                continue
            kind = "name" if kind.startswith("only ") else kind
            inner = {"name": name, "spdx": spdx, "address": address}[kind]
            needed = {"name": (keywords,) if isinstance(keywords, str) else keywords, "spdx": ("spdx-",), "address": (re.sub(r"\\", "", re.match(r"(?:[\w-]|\\\.)*", address)[0]),)}[kind]
            made.append(Rule(label, form, priority, confidence, _words(needed), re.compile(_flexible(around.format(name=inner, word=_WORD, version=_VERSION)))))
    for label, form, keywords, text in TEXTS:
        made.append(Rule(label, form, *TEXT_FORMS[form], _words((keywords,) if isinstance(keywords, str) else keywords), re.compile(_flexible(text))))
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def _automaton() -> tuple[ahocorasick.Automaton, tuple[Rule, ...]]:
    """Finds in one pass which keywords a text holds; each leads to the places of its rules."""
    by_keyword: dict[str, list[int]] = {}
    for place, rule in enumerate(rules()):
        for k in rule.keywords:
            by_keyword.setdefault(k, []).append(place)
    made = ahocorasick.Automaton()
    for k, places in by_keyword.items():
        made.add_word(k, (k, places))
    made.make_automaton()
    return made, rules()


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def detect(text: str) -> list[Detection]:
    """Accepted detections in the order of the text."""
    lowered = text.translate(_LOWERED)
    automaton, every = _automaton()
    held = {k: places for _, (k, places) in automaton.iter(lowered)}
    tried = sorted({place for places in held.values() for place in places})
    return accepted(Detection(m.start("id") if "id" in every[place].pattern.groupindex else m.start(), m.end(), every[place]) for place in tried for m in every[place].pattern.finditer(lowered))


def accepted(detections: Iterable[Detection]) -> list[Detection]:
    """Detections less those within one of higher rank, in the order of the text."""
    found = list(detections)
    found.sort(key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label))
    longest = max((d.end - d.start for d in found), default=0)
    kept: list[tuple[int, int, int]] = []  # start, end, place in found: by start, so that only near ones are looked at
    for k, d in enumerate(found):
        at = bisect.bisect_right(kept, (d.start, float("inf"))) - 1
        inside = False
        while at >= 0 and kept[at][0] >= d.start - longest and not inside:
            inside = kept[at][1] >= d.end
            at -= 1
        if not inside:
            bisect.insort(kept, (d.start, d.end, k))
    return [found[k] for _, _, k in kept]


def word_places(text: bytes, phrases: dict[str, str] = BASE_PHRASES) -> tuple[int, list[tuple[int, str]]]:
    """The number of words of a text, and (first word, label) of each place where a phrase's words stand consecutively."""
    text = text.lower()
    found = text.translate(_SEPARATORS).split()
    places = []
    for phrase, label in phrases.items():
        ws = phrase.encode().split()
        if all(w in text for w in ws):
            at = -1
            while True:
                try:
                    at = found.index(ws[0], at + 1)
                except ValueError:
                    break
                if found[at : at + len(ws)] == ws:
                    places.append((at, label))
    return len(found), sorted(places)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, form, start, end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                t = t or ""
                n, places = word_places(t.encode("utf-8", "surrogatepass"))
                hits = detect(t)
                base = sorted({label for _, label in places})
                miss = (1 - BASE_CONFIDENCE) if places else 1.0
                best: dict[str, float] = {}
                for d in hits:
                    best[d.rule.label] = max(d.rule.confidence, best.get(d.rule.label, 0.0))
                for _, confidence in sorted(best.items()):
                    miss *= 1 - confidence
                rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *(d.rule.label for d in hits)})), 1 - miss, [{"label": d.rule.label, "form": d.rule.form, "start": d.start, "end": d.end} for d in hits]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,form:string,start:int,end:int>>")
