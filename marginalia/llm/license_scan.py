"""License scans by ordered signature rules.

Rules are regular expressions over a text's words, joined by single spaces. A rule is tried only on texts that have its keyword (one
pass over the words' hashes finds the keywords of all rules). Rules have an order: a detection that lies within a detection of
higher priority, or of the same priority and earlier in the order, is suppressed, so a longer, more specific signature hides the
mention of a name inside it. The words of the three base phrases are counted apart, at all their places.

Rules are hand-written: phrases of license bodies and notices, each with its label and keyword, and the names, tags and addresses in the table of licenses: for each license a tag rule (an SPDX identifier), a grant rule ("licensed under the ..."), a name
rule and, where there is one, an address rule.

Cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned again; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import words as wd

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
RESULT = "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, n_detections: long>"

#: Licenses: label, SPDX identifiers, names, address (all as words: lower case, no punctuation)
LICENSES = [
    ("mit", "mit|mit 0", "mit license|expat license|x11 license", "opensource org licenses mit"),
    ("apache", "apache", "apache license|apache software license", "apache org licenses"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?license version 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache 2 0", "apache (?:software )?license (?:version )?2(?: 0)?|apache 2 0 license|apache2 license", "apache org licenses license 2 0"),
    ("gpl", "gpl", "(?:gnu )?general public license|gnu gpl|gnu public license", "gnu org licenses gpl"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?1(?: 0)?|gplv1", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?|gplv2|gnu gpl (?:version|v) ?2", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?|gplv3|gnu gpl (?:version|v) ?3", "gnu org licenses gpl 3 0"),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) general public license|gnu lgpl", "gnu org licenses lgpl"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?lesser general public license (?:version|v) ?2 1|lgplv2 1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "(?:gnu )?lesser general public license (?:version|v) ?3(?: 0)?|lgplv3", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "(?:gnu )?affero general public license(?: (?:version|v) ?3(?: 0)?)?|agplv3|gnu agpl", "gnu org licenses agpl 3 0"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?", "(?:gnu )?free documentation license(?: version 1 [123])?", "gnu org licenses fdl"),
    ("bsd-2-clause", "bsd 2 clause", "(?:2|two) clause bsd license|bsd 2 clause(?: license)?|simplified bsd license|freebsd license", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", "(?:3|three) clause bsd license|bsd 3 clause(?: license)?|(?:new|modified|revised) bsd license", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", "(?:4|four) clause bsd license|bsd 4 clause(?: license)?|original bsd license", ""),
    ("0bsd", "0bsd", "zero clause bsd(?: license)?|bsd zero clause license", "opensource org licenses 0bsd"),
    ("bsd", "bsd", "bsd license|bsd style license|bsd type license|bsd licence", "opensource org licenses bsd license"),
    ("isc", "isc", "isc license", "opensource org licenses isc"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license (?:version |v )?1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license (?:version |v )?2(?: 0)?", "mozilla org mpl 2 0"),
    ("mpl", "mpl", "mozilla public license", "mozilla org mpl"),
    ("epl-1.0", "epl 1 0", "eclipse public license (?:version |v )?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", "eclipse public license (?:version |v )?2(?: 0)?", "eclipse org legal epl 2 0"),
    ("epl", "epl", "eclipse public license", "eclipse org legal epl"),
    ("edl-1.0", "edl 1 0", "eclipse distribution license(?: (?:version |v )?1 0)?", "eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license(?: (?:version |v )?1 0)?", "opensource org licenses cddl"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: (?:version |v )?1 0)?", "opensource org licenses cpl1"),
    ("artistic-1.0", "artistic 1 0", "artistic license (?:version |v )?1(?: 0)?", ""),
    ("artistic-2.0", "artistic 2 0", "artistic license (?:version |v )?2(?: 0)?", "opensource org licenses artistic license 2 0"),
    ("artistic", "artistic", "artistic license", "dev perl org licenses artistic"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: (?:version |v )?1 0)?", "boost org license 1 0"),
    ("zlib", "zlib", "zlib license|zlib libpng license", "opensource org licenses zlib"),
    ("libpng", "libpng", "libpng license", ""),
    ("unlicense", "unlicense", "the unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "wtfpl net"),
    ("cc0-1.0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)? license|creative commons zero|cc0 1 0 universal", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc by (?:1|2|2 5|3|4) 0", "creative commons attribution(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by (?:2|2 5|3|4) 0", "creativecommons org licenses by (?:1|2|3|4)"),
    ("cc-by-sa", "cc by sa (?:1|2|2 5|3|4) 0", "creative commons attribution share ?alike(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by sa (?:2|2 5|3|4) 0", "creativecommons org licenses by sa"),
    ("cc-by-nc", "cc by nc (?:1|2|2 5|3|4) 0", "creative commons attribution non ?commercial(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by nc (?:2|2 5|3|4) 0", "creativecommons org licenses by nc"),
    ("cc-by-nd", "cc by nd (?:1|2|2 5|3|4) 0", "creative commons attribution no ?deriv(?:ative)?s(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by nd (?:2|2 5|3|4) 0", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "cc by nc sa (?:1|2|2 5|3|4) 0", "creative commons attribution non ?commercial share ?alike(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by nc sa (?:2|2 5|3|4) 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd (?:1|2|2 5|3|4) 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: (?:1|2|3|4) 0)?(?: (?:international|unported|generic))?(?: public)? license|cc by nc nd (?:2|2 5|3|4) 0", "creativecommons org licenses by nc nd"),
    ("python-2.0", "python 2 0|psf 2 0", "python software foundation license(?: version 2)?|psf license", "docs python org [0-9 ]*license"),
    ("ruby", "ruby", "ruby license", "ruby lang org [a-z ]*license txt"),
    ("php-3.01", "php 3 01", "php license (?:version |v )?3 01|php license", "php net license"),
    ("postgresql", "postgresql", "postgresql license", "postgresql org about licence"),
    ("openssl", "openssl", "openssl license", "openssl org source license"),
    ("curl", "curl", "curl license", ""),
    ("vim", "vim", "vim license", ""),
    ("ofl-1.1", "ofl 1 1", "sil open font license(?: version 1 1)?|open font license", "scripts sil org ofl"),
    ("ms-pl", "ms pl", "microsoft public license", "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal license", "opensource org licenses ms rl"),
    ("ncsa", "ncsa", "university of illinois(?: ncsa)?(?: open source)? license|ncsa open source license", "opensource org licenses ncsa"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: (?:version |v ?)?1 2)?", "joinup ec europa eu [a-z ]*eupl"),
    ("cecill-2.1", "cecill 2 1", "cecill(?: free software)? license(?: agreement)?", "cecill info licences"),
    ("osl-3.0", "osl 3 0", "open software license(?: (?:version |v )?3 0)?", "opensource org licenses osl 3 0"),
    ("afl-3.0", "afl 3 0", "academic free license(?: (?:version |v )?3 0)?", "opensource org licenses afl 3 0"),
    ("upl-1.0", "upl 1 0", "universal permissive license(?: (?:version |v )?1 0)?", "oss oracle com licenses upl"),
    ("ecl-2.0", "ecl 2 0", "educational community license(?: (?:version |v )?2 0)?", "opensource org licenses ecl 2 0"),
    ("odbl-1.0", "odbl 1 0", "open (?:data commons open )?database license(?: (?:version |v )?1 0)?", "opendatacommons org licenses odbl"),
    ("busl-1.1", "busl 1 1", "business source license(?: 1 1)?", "mariadb com bsl11"),
    ("sspl-1.0", "sspl 1 0", "server side public license(?: (?:version |v )?1)?", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic 2 0", "elastic license(?: 2 0| v2)?", "elastic co licensing elastic license"),
    ("openrail", "openrail|bigscience openrail m|creativeml openrail m", "(?:creativeml |bigscience )?open ?rail(?: m| [+]{2}m)? license|responsible ai license", "huggingface co spaces [a-z ]*license"),
]

#: Phrases of license bodies and notices: label, keyword (a word of every match), pattern
PHRASES = [
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "foundation", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "option", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "option", "either version 3 of the license or at your option any later version"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "affero", "you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in ?to|to|in) the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("proprietary", "reserved", "(?:copyright |c )?(?:[0-9]{4} )?(?:[a-z0-9]+ ){0,4}all rights reserved"),
    ("proprietary", "confidential", "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) (?:of this [a-z]+ )?(?:via any medium )?is strictly prohibited"),
    ("ofl-1.1", "sil", "licensed under the sil open font license version 1 1"),
    ("cc", "creativecommons", "creativecommons org licenses"),
    ("cc", "creative", "(?:this|the) (?:work|article|text|content) is licensed under (?:a|the) creative commons"),
    ("dual", "dual", "dual licensed under"),
    ("perl", "perl", "(?:same terms as perl itself|under the same terms as perl)"),
    ("mit", "conditions", "subject to the following conditions the above copyright notice and this permission notice"),
    ("mit", "deal", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    ("isc", "disclaims", "(?:the )?software is provided as is and (?:isc|the author) disclaims all warranties"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "supporting", "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "exemplary", "in no event shall the (?:copyright (?:holder|owner)|regents|author)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "procurement", "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", "neither", "neither the name of (?:the )?(?:[a-z0-9]+ ){1,6}nor the names of its contributors may be used"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "university", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-4-clause", "includes", "this product includes software developed by"),
    ("apache-1.1", "includes", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", "perpetual", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "contributor", "subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "prominent", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "notice", "if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "licensed", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "appendix", "appendix how to apply the apache license to your work"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom"),
    ("gpl-2.0", "yoyodyne", "yoyodyne inc hereby disclaims all copyright interest in the program"),
    ("gpl-2.0", "franklin", "51 franklin (?:street|st) fifth floor boston ma 02110 1301"),
    ("gpl-2.0", "temple", "59 temple place suite 330 boston ma 02111 1307"),
    ("gpl-2.0-only", "version", "gnu general public license version 2 only"),
    ("gpl-3.0", "tivoization", "tivoization"),
    ("gpl-3.0", "installation", "installation information for a user product"),
    ("gpl-3.0", "propagate", "to propagate a work means to do anything with it that without permission"),
    ("gpl-3.0", "convey", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-classpath", "independent", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", "runtime", "gcc runtime library exception"),
    ("autoconf-exception", "autoconf", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("linking-exception", "special", "as a special exception (?:you|the copyright holders) (?:may|give (?:you )?permission to) (?:link|combine)"),
    ("lgpl-2.1", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.0", "library", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-3.0", "combined", "a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3.0", "network", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fsf-all-permissive", "medium", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("epl-1.0", "accompanies", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2.0", "secondary", "this source code may also be made available under the following secondary licenses when the conditions"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-1.0", "eclipse", "under the terms of the eclipse distribution license v1 0"),
    ("cddl-1.0", "development", "(?:subject to the terms of|governed by) the common development and distribution license"),
    ("cddl-1.0", "cddl", "you can obtain a copy of the license at (?:http|https) (?:glassfish|www) (?:[a-z0-9]+ ){1,4}cddl"),
    ("cpl-1.0", "agreement", "the accompanying program is provided under the terms of this common public license agreement"),
    ("ipl-1.0", "ibm", "ibm public license version 1 0"),
    ("artistic", "perl", "this is free software you can redistribute it and or modify it under the same terms as (?:the )?perl 5 (?:programming language )?(?:system )?itself"),
    ("artistic-1.0", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "package", "distribution of modified versions of the package as source"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "disclaim", "the contributing authors and group 42 inc disclaim all warranties"),
    ("bsl-1.0", "obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("cc0-1.0", "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "dedicated", "dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc0-1.0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc-by", "attribution", "this work is licensed under (?:a|the) creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)? license"),
    ("cc-by-sa", "sharealike", "this work is licensed under (?:a|the) creative commons attribution sharealike(?: [0-9] [0-9])?(?: international| unported| generic)? license"),
    ("cc-by-nc", "noncommercial", "this work is licensed under (?:a|the) creative commons attribution noncommercial(?: [0-9] [0-9])?(?: international| unported| generic)? license"),
    ("cc", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc", "moral", "moral rights such as the right of integrity are not licensed under this public license"),
    ("python-2.0", "psf", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python-2.0", "beopen", "beopen python open source license agreement"),
    ("cnri-python", "cnri", "cnri open source license agreement"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("ruby", "bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric", "this product includes cryptographic software written by eric young"),
    ("curl", "stenberg", "copyright and permission notice copyright c (?:[0-9 ]+)?daniel stenberg"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("icu", "icu", "icu license icu 1 8 1 and later"),
    ("unicode-dfs", "unicode", "unicode data files and software"),
    ("unicode-dfs", "unicode", "unicode inc license agreement data files and software"),
    ("ofl-1.1", "font", "the font software may be sold as part of a larger software package but no copy"),
    ("ofl-1.1", "reserved", "no modified version of the font software may use the reserved font name"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-eula", "microsoft", "microsoft software license terms"),
    ("ncsa", "deal", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version)?(?: v)?(?: 1 [12])?"),
    ("eupl-1.2", "european", "the european union public licence the eupl applies to the work"),
    ("cecill-2.1", "cecill", "ce logiciel est (?:régi|regi) par la licence cecill"),
    ("cecill-2.1", "cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("osl-3.0", "licensed", "licensed under the open software license version 3 0"),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0"),
    ("upl-1.0", "larger", "the larger works to which the software is contributed"),
    ("ecl-2.0", "educational", "educational community license version 2 0"),
    ("odbl-1.0", "database", "(?:is )?made available under the open database license"),
    ("odc-by", "attribution", "open data commons attribution license"),
    ("pddl-1.0", "dedication", "open data commons public domain dedication and licen[cs]e"),
    ("busl-1.1", "production", "make production use of the licensed work"),
    ("busl-1.1", "anniversary", "the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", "service", "making the functionality of the program or modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons", "commons clause license condition v1 0"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|strict|small business|perimeter) license"),
    ("llama", "llama", "llama (?:2|3|3 1) community license"),
    ("openrail", "restrictions", "use based restrictions as referenced in paragraph 5"),
    ("nasa-1.3", "nasa", "nasa open source agreement version 1 3"),
    ("apsl-2.0", "apple", "apple public source license"),
    ("apple-sample", "apple", "this apple software is supplied to you by apple"),
    ("intel", "intel", "intel (?:simplified software|open source) license"),
    ("nvidia", "nvidia", "nvidia corporation and its licensors retain all intellectual property"),
    ("w3c", "w3c", "w3c software notice and license"),
    ("tcl", "grant", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright (?:c )?[0-9 ]*the freetype project"),
    ("info-zip", "zip", "info zip (?:copyright and )?license"),
    ("bzip2", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product"),
    ("mulan-psl", "mulan", "mulan permissive software license v2"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("qpl-1.0", "q", "the q public license version 1 0"),
    ("lppl-1.3", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("proprietary", "disclosure", "subject to (?:a )?non disclosure agreement"),
    ("proprietary", "copy", "you may not copy(?: or [a-z]+)? (?:this|the) (?:software|file|document|work)"),
    ("proprietary", "redistribute", "you may not redistribute(?: or [a-z]+)? (?:this|the) (?:software|file|document|work)"),
    ("proprietary", "resell", "you may not resell(?: or [a-z]+)? (?:this|the) (?:software|file|document|work)"),
    ("proprietary", "sublicense", "you may not sublicense(?: or [a-z]+)? (?:this|the) (?:software|file|document|work)"),
    ("proprietary", "modify", "you may not modify(?: or [a-z]+)? (?:this|the) (?:software|file|document|work)"),
    ("proprietary", "reproduced", "(?:may not|no part of this [a-z]+ may) be reproduced"),
    ("proprietary", "copied", "(?:may not|no part of this [a-z]+ may) be copied"),
    ("proprietary", "distributed", "(?:may not|no part of this [a-z]+ may) be distributed"),
    ("proprietary", "republished", "(?:may not|no part of this [a-z]+ may) be republished"),
    ("proprietary", "trade", "contains (?:confidential information and )?trade secrets"),
    ("proprietary", "engineer", "reverse engineer decompile or disassemble"),
    ("proprietary", "evaluation", "for evaluation purposes only"),
    ("proprietary", "licensed", "this software is licensed not sold"),
    ("public-domain", "copyright", "no copyright is claimed"),
    ("public-domain", "government", "(?:is|this is) a work of the (?:u s|us|united states) government"),
    ("public-domain", "rights", "no rights reserved"),
    ("freeware", "freeware", "this (?:software|program) is freeware"),
    ("shareware", "shareware", "this (?:software|program) is shareware"),
]


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    confidence: float


_WORD = re.compile(r"[a-z0-9]{2,}")
_COMMON = frozenset("the of version public license licence licenses free software open org and or only later source com www to by for net".split())


def _keyword(pattern: str) -> str | None:
    """A word that every match of a pattern without outer alternatives holds, the longest of those that are uncommon."""
    plain = re.sub(r"\S*\((?:[^()]|\([^()]*\))*\)\??\S*|\S*\[[^\]]*\]\S*|\S+ \?\S+|\S+\?\S*", " ", pattern)
    found = [w for w in _WORD.findall(plain)]
    return max((w for w in found if w not in _COMMON), key=len, default=max(found, key=len, default=None))


def _alternatives(pattern: str) -> list[str]:
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


def _rules() -> list[Rule]:
    made = [(label, 60, keyword, body, 0.95) for label, keyword, body in PHRASES]
    for label, tags, names, address in LICENSES:
        for tag in _alternatives(tags):
            made.append((label, 90 + tag.count(" "), "spdx", f"spdx license identifier {tag}", 1.0))
        for name in _alternatives(names):
            exact = 10 * bool(re.search(r"\d", label))
            made.append((label, 70 + exact, _keyword(name) or "license", f"(?:licensed|released|distributed|published|available|provided) under (?:the |an? )?(?:terms of )?(?:the )?(?:{name})", 0.9))
            made.append((label, 40 + exact, _keyword(name) or "license", name, 0.7))
        for place in _alternatives(address):
            made.append((label, 50 + 10 * bool(re.search(r"\d", label)), _keyword(place) or "licenses", place, 0.85))
    return [Rule(label, priority, keyword, re.compile(rf"(?<![^ ]){body}(?![^ ])") if "|" not in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", body) else re.compile(rf"(?<![^ ])(?:{body})(?![^ ])"), sure) for label, priority, keyword, body, sure in made]


RULES = sorted(_rules(), key=lambda r: -r.priority)  # stable: the order of the tables within a priority


class Detection(NamedTuple):
    first_word: int
    end_word: int
    label: str
    priority: int
    order: int
    confidence: float


def detect(text: str, keywords: set[str]) -> list[Detection]:
    """Detections in a text (words joined by single spaces) that has these keywords, without the suppressed ones."""
    starts: np.ndarray | None = None
    found = []
    for order, rule in enumerate(RULES):
        if rule.keyword not in keywords:
            continue
        for m in rule.pattern.finditer(text):
            if starts is None:
                starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) + 1))
            a, b = np.searchsorted(starts, (m.start(), m.end()), "right")
            found.append(Detection(int(a) - 1, int(b), rule.label, rule.priority, order, rule.confidence))
    return sorted(unsuppressed(found))


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Detections that do not lie within one of higher priority, or of the same priority and earlier in the order.

    Only the widest kept intervals are looked at: none holds another, so their ends rise with their begins and one search tells."""
    kept, begins, ends = [], [], []
    for d in sorted(found, key=lambda d: (-d.priority, d.order, d.first_word)):
        at = bisect_right(begins, d.first_word)
        if at and ends[at - 1] >= d.end_word:
            continue
        kept.append(d)
        low, high = bisect_left(begins, d.first_word), bisect_right(ends, d.end_word)
        begins[low : max(low, high)], ends[low : max(low, high)] = [d.first_word], [d.end_word]
    return kept


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return wd.words(data, np.array([0, len(data)]))[0][0]


class Scanner:
    def __init__(self):
        names = sorted({r.keyword for r in RULES})
        hashes = np.array([_hash(n) for n in names], np.uint64)
        order = np.argsort(hashes)
        self.names, self.hashes = [names[i] for i in order], hashes[order]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(hashes >> np.uint64(48)).view(np.int64)] = True
        self.base = [(label, np.array([_hash(w) for w in phrase.split()], np.uint64)) for phrase, label in BASE.items()]

    def scan(self, column: pa.Array) -> pa.Array:
        rows = []
        for a, b, buf, offs in wd.text_slices(column):
            h, start, stop, first = wd.words(buf, offs)
            n_words = np.diff(first)
            near = np.flatnonzero(self.gate[(h >> np.uint64(48)).view(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            real = self.hashes[at] == h[near]
            owner = np.searchsorted(first, near[real], "right") - 1
            keywords: dict[int, set[str]] = {}
            for d, k in zip(owner.tolist(), at[real].tolist()):
                keywords.setdefault(d, set()).add(self.names[k])
            places: dict[int, list[tuple[int, str]]] = {}
            for label, phrase in self.base:
                hit = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
                for j in range(1, len(phrase)):
                    hit = hit[h[hit + j] == phrase[j]]
                doc = np.searchsorted(first, hit, "right") - 1
                inside = hit + len(phrase) <= first[doc + 1]
                for d, p in zip(doc[inside].tolist(), hit[inside].tolist()):
                    places.setdefault(d, []).append((p - int(first[d]), label))
            for d in range(b - a):
                found = places.get(d, [])
                base = {label for _, label in found}
                detections = []
                if d in keywords:
                    lo, hi = int(first[d]), int(first[d + 1])
                    parts = [buf[i:j].tobytes() for i, j in zip(start[lo:hi].tolist(), stop[lo:hi].tolist())]
                    detections = detect(b" ".join(parts).decode("utf-8", "replace").translate(_LOWER), keywords[d])
                rows.append({
                    "n_words": int(n_words[d]), "n_base": len(found), "first_word": min(found)[0] if found else None, "last_word": max(found)[0] if found else None,
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x.label for x in detections})), "score": max([x.confidence for x in detections] + [0.7] * bool(base), default=0.0), "n_detections": len(detections),
                })
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]
        return pa.array(rows, pa.struct(kinds))


_LOWER = {c: c + 32 for c in range(65, 91)}
_scanner: list[Scanner] = []


def scan(column: pa.Array) -> pa.Array:
    if not _scanner:  # once a worker
        _scanner.append(Scanner())
    return _scanner[0].scan(column)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the fields of RESULT."""
    run = F.arrow_udf(scan, RESULT)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("r")).select("doc_id", "r.*")
