"""Signature rules of licenses and rights notices, in order of precedence.

A pattern reads a text's words, lower-cased and joined by single spaces, so that punctuation and line
ends never matter: "Apache License, Version 2.0" is ``apache license version 2 0``. Every rule names
keywords, words that must all stand in a text before its pattern is tried.

Ranks: 1 identifiers and addresses, 2 names with a version, 3 names, 4 general wording.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Confidence of a detection by the rank of its rule.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.4}


@dataclass(frozen=True)
class Signature:
    label: str
    rank: int
    keywords: tuple[str, ...]
    pattern: str


#: Phrases that count as base detections, with their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: What may stand before a version; ``@`` in a pattern.
VERSION = "(?: version)?(?: v ?| )"

#: rank | label | keywords | pattern
WRITTEN = r"""
1|apache-2.0|apache licenses|(?:www )?apache org licenses license 2 0(?: txt| html)?
1|apache-1.1|apache licenses|(?:www )?apache org licenses license 1 1(?: txt| html)?
1|mit|opensource licenses mit|opensource org licenses mit(?: license)?(?: php| html)?
1|mpl-2.0|mozilla mpl|(?:www )?mozilla org (?:en us )?mpl 2 0
1|mpl-1.1|mozilla mpl|(?:www )?mozilla org mpl 1 1|mozilla org mpl mpl 1 1
1|epl-2.0|eclipse epl|(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
1|epl-1.0|eclipse epl|(?:www )?eclipse org legal epl v10(?: html)?
1|unlicense|unlicense|(?:www )?unlicense org
1|wtfpl|wtfpl|(?:www )?wtfpl net
1|boost-1.0|boost license|(?:www )?boost org license 1 0(?: txt)?
1|cc0-1.0|creativecommons zero|creativecommons org publicdomain zero 1 0
1|public-domain|creativecommons mark|creativecommons org publicdomain mark 1 0
1|artistic-2.0|opensource artistic|opensource org licenses artistic license 2 0
1|bsd-2-clause|opensource bsd|opensource org licenses bsd 2 clause
1|bsd-3-clause|opensource bsd|opensource org licenses bsd (?:3 clause|license(?: php)?)
1|isc|opensource isc|opensource org licenses isc(?: license)?(?: txt)?
1|zlib|opensource zlib|opensource org licenses zlib(?: license)?(?: php)?
1|ofl-1.1|scripts ofl|scripts sil org ofl
1|odbl-1.0|opendatacommons odbl|opendatacommons org licenses odbl(?: 1 0)?
1|odc-by-1.0|opendatacommons by|opendatacommons org licenses by(?: 1 0)?
1|pddl-1.0|opendatacommons pddl|opendatacommons org licenses pddl(?: 1 0)?
1|ogl-uk-3.0|nationalarchives doc|(?:www )?nationalarchives gov uk doc open government licence version 3
2|apache-2.0|apache license|(?:the )?apache (?:software )?license@2(?: 0)?
2|apache-1.1|apache license|(?:the )?apache (?:software )?license@1 1
2|apache-1.0|apache license|(?:the )?apache (?:software )?license@1 0
2|apache-2.0|apache|apache (?:v )?2 0 license(?:d)?
2|apache-2.0|asl|asl 2 0
2|apache-2.0|licensed asf|licensed to the apache software foundation asf under one or more contributor license agreements
2|mit|permission granted charge|permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){0,45} (?:copies|furnished)(?: of the software)?
2|mit|expat license|expat license
2|mit-0|mit attribution|mit no attribution(?: license)?
2|x11|x11 license|x11 license
2|isc|permission use copy modify|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
2|bsd-2-clause|bsd|(?:simplified|freebsd) bsd license|2 clause bsd(?: license)?|bsd 2 clause(?: license)?
2|bsd-2-clause|simplified bsd|simplified bsd(?: license)?
2|bsd-3-clause|bsd|3 clause bsd(?: license)?|bsd 3 clause(?: license)?
2|bsd-3-clause|bsd license|(?:new|modified|revised) bsd license
2|bsd-4-clause|bsd|4 clause bsd(?: license)?|bsd 4 clause(?: license)?
2|bsd-4-clause|original bsd|original bsd license
2|0bsd|bsd zero|(?:bsd )?zero clause bsd(?: license)?|bsd zero clause(?: license)?
2|0bsd|0bsd|0bsd
2|bsd|redistribution source binary forms|redistribution and use in source and binary forms with or without modification are permitted
2|bsd-3-clause|neither name endorse promote|neither the name of(?: \S+){1,20} may be used to endorse or promote products derived from this software
2|bsd-4-clause|advertising materials acknowledgement|all advertising materials mentioning features or use of this software must display the following acknowledgement
2|bsd-protection|bsd protection|bsd protection license
2|mpl-2.0|mozilla public|mozilla public license@2 0
2|mpl-2.0|mpl|mpl@2 0
2|mpl-1.1|mozilla public|mozilla public license@1 1
2|mpl-1.1|mpl|mpl@1 1
2|mpl-1.0|mozilla public|mozilla public license@1 0
2|mpl-2.0|mozilla source subject|this source code form is subject to the terms of the mozilla public license v 2 0
2|epl-2.0|eclipse public|eclipse public license@2 0
2|epl-1.0|eclipse public|eclipse public license@1 0
2|edl-1.0|eclipse distribution|eclipse distribution license@1 0
2|cddl-1.0|common development|common development and distribution license(?: cddl)?@1 0
2|cddl-1.1|common development|common development and distribution license(?: cddl)?@1 1
2|cpl-1.0|common public|common public license@1 0
2|ipl-1.0|ibm public|ibm public license@1 0
2|eupl-1.2|european union|european union public licen[sc]e@1 2
2|eupl-1.2|eupl|eupl@1 2
2|eupl-1.1|european union|european union public licen[sc]e@1 1
2|eupl-1.1|eupl|eupl@1 1
2|boost-1.0|boost software|boost software license@1 0
2|artistic-2.0|artistic|artistic license@2 0
2|artistic-1.0|artistic|artistic license@1 0
2|afl-3.0|academic free|academic free license@3 0
2|afl-2.1|academic free|academic free license@2 1
2|osl-3.0|open software|open software license@3 0
2|osl-2.1|open software|open software license@2 1
2|zpl-2.1|zope public|zope public license(?: zpl)?@2 1
2|zpl-2.0|zope public|zope public license(?: zpl)?@2 0
2|python-2.0|python software|python software foundation license(?: agreement)?@2
2|php-3.01|php license|php license@3 01
2|php-3.0|php license|php license@3 0
2|lppl-1.3c|latex project|latex project public license@1 3c?
2|ofl-1.1|sil open|sil open font license@1 1
2|ofl-1.0|sil open|sil open font license@1 0
2|ms-pl|microsoft public|microsoft public license(?: ms pl)?
2|ms-rl|microsoft reciprocal|microsoft reciprocal license(?: ms rl)?
2|apsl-2.0|apple source|apple public source license@2 0
2|qpl-1.0|q public|q public license@1 0
2|cecill-2.1|cecill|cecill(?: free software license agreement)?@2 1
2|cecill-b|cecill b|cecill b(?: license)?
2|cecill-c|cecill c|cecill c(?: license)?
2|mulan-psl-2.0|mulan|mulan permissive software license v ?2|mulan psl v ?2
2|upl-1.0|universal permissive|universal permissive license(?: upl)?@1 0
2|ncsa|illinois ncsa|university of illinois ncsa open source license
2|bsl-1.1|business source|business source license@1 1
2|sspl-1.0|server side|server side public license(?: sspl)?@1
2|elastic-2.0|elastic license|elastic license@2 0
2|polyform-nc-1.0|polyform|polyform noncommercial license(?: 1 0 0)?
2|openrail-m|openrail|(?:creativeml |bigscience )?(?:bigcode )?openrail (?:plus plus )?m(?: license)?
2|openrail-m|open rail|(?:creativeml |bigscience )?(?:bigcode )?open rail (?:plus plus )?m(?: license)?
2|openrail-m|rail license|(?:bigscience )?rail license@1 0
2|llama-2|llama community|llama 2 community license(?: agreement)?
2|llama-3|llama community|(?:meta )?llama 3(?: [123])? community license(?: agreement)?
2|gemma|gemma terms|gemma terms of use
2|odbl-1.0|open database|open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v1 0| 1 0| v 1 0)?
2|odc-by-1.0|open commons attribution|open data commons attribution licen[sc]e(?: odc by)?(?: v1 0| 1 0| v 1 0)?
2|pddl-1.0|public dedication|(?:open data commons )?public domain dedication and licen[sc]e(?: pddl)?(?: v1 0| 1 0)?
2|cdla-permissive-2.0|community data permissive|community data license agreement permissive@2 0
2|cdla-sharing-1.0|community data sharing|community data license agreement sharing@1 0
2|ogl-uk-3.0|open government licence|open government licence(?: for public sector information)? (?:v|version) ?3(?: 0)?
2|etalab-2.0|licence ouverte|licence ouverte(?: open licence)?@2 0
2|dl-de-by-2.0|datenlizenz|datenlizenz deutschland namensnennung (?:version )?2 0
2|dl-de-zero-2.0|datenlizenz|datenlizenz deutschland zero (?:version )?2 0
2|gfdl-1.3|gnu free documentation|gnu free documentation license@1 3
2|gfdl-1.2|gnu free documentation|gnu free documentation license@1 2
2|cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
2|cc0-1.0|creative commons zero|creative commons zero(?: v1 0| 1 0)?(?: universal)?
2|gpl-with-classpath|classpath exception|(?:with the )?classpath exception
2|gpl-with-font|font exception|(?:with the )?font exception
3|mit|mit|(?:the )?mit(?: x11| expat)? licen[sc]e
3|mit|licensed mit|licensed under(?: the)? mit
3|apache|apache|(?:the )?apache (?:software |public )?licen[sc]e
3|gpl|gnu general public|(?:the )?gnu general public licen[sc]e
3|gpl|gpl|(?:gnu )?gpl(?: licen[sc]e)?
3|lgpl|gnu public|(?:the )?gnu (?:lesser|library) general public licen[sc]e
3|lgpl|lgpl|(?:gnu )?lgpl(?: licen[sc]e)?
3|agpl|gnu affero|(?:the )?gnu affero general public licen[sc]e
3|agpl|agpl|(?:gnu )?agpl(?: licen[sc]e)?
3|gfdl|gnu free documentation|(?:the )?gnu free documentation licen[sc]e
3|gfdl|gfdl|gfdl
3|cc-by|cc by|cc by
3|creative-commons|creative commons|(?:a )?creative commons(?: public)? licen[sc]e
3|creative-commons|creativecommons|(?:www )?creativecommons org licenses?
3|bsd|bsd|(?:the )?bsd(?: style)? licen[sc]e
3|mpl|mozilla public|(?:the )?mozilla public licen[sc]e
3|epl|eclipse public|(?:the )?eclipse public licen[sc]e
3|cddl|cddl|cddl(?: licen[sc]e)?
3|eupl|european union|(?:the )?european union public licen[sc]e
3|isc|isc|(?:the )?isc licen[sc]e
3|zlib|zlib|(?:the )?zlib(?: libpng)? licen[sc]e
3|libpng|libpng|(?:the )?libpng (?:reference library )?licen[sc]e(?: version 2)?
3|libpng|png reference|(?:the )?png reference library licen[sc]e(?: version 2)?
3|openssl|openssl|(?:the )?openssl licen[sc]e
3|unlicense|unlicense|(?:the )?unlicense
3|wtfpl|wtfpl|wtfpl
3|wtfpl|fuck want public|do what the fuck you want to public licen[sc]e
3|beerware|beerware|(?:the )?beerware(?: licen[sc]e)?
3|beerware|beer ware|(?:the )?beer ware licen[sc]e
3|artistic|artistic|(?:the )?artistic licen[sc]e
3|perl|terms perl itself|(?:under )?the same terms as perl itself
3|ruby|ruby|(?:the )?ruby(?: s)? licen[sc]e
3|python|psf|(?:the )?psf licen[sc]e
3|python|python|(?:the )?python(?: software foundation)? licen[sc]e
3|php|php|(?:the )?php licen[sc]e
3|postgresql|postgresql|(?:the )?postgresql licen[sc]e
3|boost|boost|(?:the )?boost(?: software)? licen[sc]e
3|afl|academic free|(?:the )?academic free licen[sc]e
3|osl|open software|(?:the )?open software licen[sc]e
3|ofl|open font|(?:the )?(?:sil )?open font licen[sc]e
3|lppl|latex project|(?:the )?latex project public licen[sc]e
3|icu|unicode|unicode(?: inc)? licen[sc]e(?: agreement)?
3|w3c|w3c|(?:the )?w3c (?:software )?(?:notice and )?licen[sc]e
3|json|used good evil|shall be used for good not evil
3|curl|curl|(?:the )?curl licen[sc]e
3|vim|vim|(?:the )?vim licen[sc]e
3|freetype|freetype|(?:the )?freetype (?:project )?licen[sc]e
3|ijg|independent jpeg|(?:the )?independent jpeg group(?: s)? licen[sc]e
3|gust|gust font|gust font licen[sc]e
3|odbl|odbl|odbl
3|ogl|open government licence|open government licence
3|public-domain|public domain|(?:released |dedicated |placed |is |are )?(?:in|into|to) the public domain
3|public-domain|public domain|public domain(?: work| mark| dedication)
3|proprietary|proprietary confidential|proprietary and confidential|confidential and proprietary
3|proprietary|end user agreement|end user licen[sc]e agreement
3|non-commercial|non commercial only|(?:for )?non commercial (?:use|purposes) only
3|non-commercial|noncommercial only|(?:for )?noncommercial (?:use|purposes) only
3|no-derivatives|derivative works permitted|no derivative works(?: are)? permitted
3|research-only|research purposes only|(?:for )?(?:academic )?research purposes only
4|all-rights-reserved|rights reserved|all rights reserved
4|all-rights-reserved|tous droits|tous droits r(?:é|e)serv(?:é|e)s
4|all-rights-reserved|alle rechte vorbehalten|alle rechte vorbehalten
4|all-rights-reserved|todos derechos reservados|todos los derechos reservados
4|some-rights-reserved|some rights reserved|some rights reserved
4|no-reproduction|reproduced permission|may not be reproduced(?: \S+){0,12} permission
4|no-training|used train|may not be used to train(?: \S+){0,6} models?
4|open-source|open source|(?:an )?(?:osi approved )?open source licen[sc]e
4|copyright|copyright|copyright(?: c| ©)?(?: \d{4}){1,4}
4|copyright|©|©(?: \d{4}){1,4}
4|licensed|licensed under|licensed under(?: the terms of)?(?: a| an| the)?(?: \S+){0,6} licen[sc]e
"""

#: Identifiers of the public license list that the families below don't make.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 APSL-2.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 Beerware
BlueOak-1.0.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1
CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0
EUPL-1.1 EUPL-1.2 Elastic-2.0 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 HPND ICU IJG IPL-1.0 ISC JSON LPPL-1.3c
Libpng MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODC-By-1.0 ODbL-1.0 OFL-1.0
OFL-1.1 OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PSF-2.0 PostgreSQL Python-2.0 QPL-1.0 Ruby
SSPL-1.0 UPL-1.0 Unicode-DFS-2016 Unlicense Vim W3C WTFPL X11 ZPL-2.0 ZPL-2.1 Zlib curl
"""

#: Creative Commons terms and what they are called in full.
TERMS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
#: Short name, middle of the full name, versions.
GNU = {
    "gpl": ("gpl", "", ("1.0", "2.0", "3.0")),
    "lgpl": ("lgpl", "(?:lesser |library )", ("2.0", "2.1", "3.0")),
    "agpl": ("agpl", "affero ", ("1.0", "3.0")),
}


def spaced(text: str) -> str:
    """An identifier or version as words."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def families() -> list[Signature]:
    """Rules that follow from an identifier or from terms and versions."""
    out = []
    for name in IDENTIFIERS.split():
        out.append(Signature(name.lower(), 1, ("spdx",), f"spdx license identifier {spaced(name)}"))
    for terms, full in TERMS.items():
        short = spaced(terms)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label, v = f"cc-{terms}-{version}", spaced(version)
            out.append(Signature(label, 1, ("spdx", "cc"), f"spdx license identifier cc {short} {v}"))
            out.append(Signature(label, 1, ("creativecommons",), f"creativecommons org licenses {short} {v}"))
            out.append(Signature(label, 2, ("cc", "by"), f"cc {short} (?:version )?(?:v ?)?{v}"))
            out.append(Signature(label, 2, ("commons", "attribution"), f"creative commons {full} {v}"))
        out.append(Signature(f"cc-{terms}", 3, ("cc", "by"), f"cc {short}"))
        out.append(Signature(f"cc-{terms}", 3, ("commons", "attribution"), f"creative commons {full}"))
    for kind, (short, middle, versions) in GNU.items():
        for version in versions:
            v = spaced(version)
            number = v.removesuffix(" 0") + ("(?: 0)?" if v.endswith(" 0") else "")
            first = v[0]
            later = "(?: or (?:at your option )?(?:any )?later(?: version)?)"
            for ending, more in (("", ""), ("-or-later", later)):
                label = f"{kind}-{version}{ending}"
                code = "(?: only)?" if not ending else "(?: or later)"
                out.append(Signature(label, 1, ("spdx", short), f"spdx license identifier {short} {v}{code}"))
                out.append(Signature(label, 2, ("gnu", "public"), f"(?:the )?gnu {middle}general public licen[sc]e(?: {short})?(?: as published by the free software foundation)?(?: either)?{VERSION}{number}(?: of the licen[sc]e)?{more}"))
                out.append(Signature(label, 2, (short,), f"(?:gnu )?{short}{VERSION}{number}{more}"))
                out.append(Signature(label, 2, (f"{short}v{first}",), f"(?:gnu )?{short}v{number}{more}"))
            out.append(Signature(f"{kind}-{version}", 1, ("gnu", "licenses"), f"(?:www )?gnu org licenses (?:old licenses )?{short} {number}(?: en)?(?: html| txt)?"))
    return out


@lru_cache(maxsize=1)
def rules() -> tuple[Signature, ...]:
    """All rules in order of precedence: by rank, then as they stand above, families last."""
    out = []
    for line in WRITTEN.strip().splitlines():
        rank, label, keywords, pattern = line.split("|", 3)
        out.append(Signature(label, int(rank), tuple(keywords.split()), pattern.replace("@", VERSION)))
    for label, phrase in BASE:
        out.append(Signature(label, 3, tuple(phrase.split()), phrase))
    return tuple(sorted(out + families(), key=lambda r: r.rank))
