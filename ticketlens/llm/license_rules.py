"""Signature rules for licences, over texts of lower-case words with one blank between.

A line is ``level | label | words | pattern``: the level orders the rules (1: grant of a named licence, 2: name with version or full name, 3: short
name or identifier, 4: hint), every match holds all ``words``, which gate the pattern, and the first of which is looked up. In patterns
``<2.1>`` is a version in its usual spellings, ``<under>`` the beginning of a grant, ``<the>`` an optional article, ``~3`` up to three other words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Phrases that are always reported, as (label, first word to look up, phrase).
BASE = (("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved"))

HAND_WRITTEN = r"""
1 | mit | license mit | <under> mit(?: expat)? license
1 | mit | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy
2 | mit | license mit | <the>mit license(?: mit)?
2 | mit | license mit | mit style license
2 | mit | license expat | <the>expat license
3 | mit | spdx mit | spdx license identifier mit
3 | mit | license mit | license mit
2 | mit-0 | attribution mit | mit no attribution(?: license)?
2 | mit-0 | mit 0 | mit 0 license
1 | apache-2.0 | apache license | <under> apache (?:software )?license <2>
1 | apache-2.0 | apache license | you may not use this file except in compliance with the license ~40 apache license <2>
2 | apache-2.0 | apache license | <the>apache (?:software )?license <2>
3 | apache-2.0 | apache 2 | apache <2>(?: license| licence)?
3 | apache-2.0 | spdx apache | spdx license identifier apache 2 0
2 | apache-2.0 | apache2 | apache2(?: 0)?(?: license)?
1 | apache-1.1 | apache license | <under> apache (?:software )?license <1.1>
2 | apache-1.1 | apache license | <the>apache (?:software )?license <1.1>
2 | apache-1.0 | apache license | <the>apache (?:software )?license <1.0>
3 | apache | apache | apache (?:software )?licen[cs]e
1 | bsd-3-clause | bsd license | <under> (?:3 clause|three clause|new|modified|revised) bsd license
1 | bsd-3-clause | neither endorse | neither the name of ~12 nor the names of its contributors may be used to endorse
2 | bsd-3-clause | bsd clause | (?:3|three) clause bsd(?: license)?
2 | bsd-3-clause | bsd clause | bsd (?:3|three) clause(?: license)?
2 | bsd-3-clause | bsd license | (?:new|modified|revised) bsd license
1 | bsd-2-clause | bsd license | <under> (?:2 clause|two clause|simplified|freebsd) bsd license
2 | bsd-2-clause | bsd clause | (?:2|two) clause bsd(?: license)?
2 | bsd-2-clause | bsd clause | bsd (?:2|two) clause(?: license)?
2 | bsd-2-clause | bsd license | simplified bsd license
2 | bsd-2-clause | freebsd license | freebsd license
1 | bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display
2 | bsd-4-clause | bsd clause | (?:4|four) clause bsd(?: license)?
2 | bsd-4-clause | bsd clause | bsd (?:4|four) clause(?: license)?
2 | bsd-4-clause | bsd license | (?:original|old) bsd license
2 | 0bsd | bsd clause | (?:0|zero) clause bsd(?: license)?
3 | 0bsd | 0bsd | 0bsd
1 | bsd | redistribution binary | redistribution and use in source and binary forms with or without modification
3 | bsd | bsd | <the>bsd licen[cs]e
3 | bsd | bsd | bsd style licen[cs]e
1 | mpl-2.0 | mozilla public | subject to the terms of the mozilla public license <2>
1 | mpl-2.0 | mozilla public | <under> mozilla public license <2>
2 | mpl-2.0 | mozilla public | mozilla public license <2>
3 | mpl-2.0 | mpl 2 | mpl <2>
3 | mpl-2.0 | mpl2 | mpl2(?: 0)?
1 | mpl-1.1 | mozilla public | <under> mozilla public license <1.1>
2 | mpl-1.1 | mozilla public | mozilla public license <1.1>
3 | mpl-1.1 | mpl 1 | mpl <1.1>
3 | mpl | mozilla public | mozilla public licen[cs]e
1 | epl-2.0 | eclipse public | <under> eclipse public license <2>
2 | epl-2.0 | eclipse public | eclipse public license <2>
3 | epl-2.0 | epl 2 | epl <2>
1 | epl-1.0 | eclipse public | <under> eclipse public license <1>
2 | epl-1.0 | eclipse public | eclipse public license <1>
3 | epl-1.0 | epl 1 | epl <1>
3 | epl | eclipse public | eclipse public licen[cs]e
2 | edl-1.0 | eclipse distribution | eclipse distribution license(?: <1>)?
1 | eupl-1.2 | european union | <under> european union public licence <1.2>
2 | eupl-1.2 | european union | european union public licen[cs]e <1.2>
2 | eupl-1.1 | european union | european union public licen[cs]e <1.1>
3 | eupl-1.2 | eupl 1 | eupl <1.2>
3 | eupl-1.1 | eupl 1 | eupl <1.1>
3 | eupl | european union | european union public licen[cs]e
2 | cddl-1.1 | cddl 1 | cddl <1.1>
2 | cddl-1.0 | cddl 1 | cddl <1.0>
2 | cddl-1.0 | distribution common | common development and distribution license(?: cddl)? <1.0>
2 | cddl-1.1 | distribution common | common development and distribution license(?: cddl)? <1.1>
3 | cddl | distribution common | common development and distribution licen[cs]e
2 | cpl-1.0 | common public | common public license(?: <1>)?
2 | ipl-1.0 | ibm public | ibm public license(?: <1>)?
1 | artistic-2.0 | artistic license | <under> artistic license <2>
2 | artistic-2.0 | artistic license | <the>artistic license <2>
2 | artistic-1.0 | artistic license | <the>artistic license <1>
3 | artistic | artistic | <the>artistic licen[cs]e
1 | artistic-1.0 | perl itself | under the same terms as perl(?: itself)?
1 | isc | permission sufficient copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 | isc | isc license | <under> isc license
2 | isc | isc | <the>isc licen[cs]e
3 | isc | spdx isc | spdx license identifier isc
1 | zlib | zlib license | <under> zlib license
2 | zlib | zlib | <the>zlib(?: libpng)? licen[cs]e
1 | zlib | altered misrepresented | altered source versions must be plainly marked as such
1 | bsl-1.0 | boost software | <under> boost software license <1>
2 | bsl-1.0 | boost software | boost software license(?: <1>)?
3 | bsl-1.0 | bsl 1 | bsl 1 0
2 | busl-1.1 | business source | business source license(?: <1.1>)?
1 | unlicense | encumbered unencumbered | this is free and unencumbered software released into the public domain
2 | unlicense | unlicense | <the>unlicense(?: org)?
1 | public-domain | domain public | (?:released|placed|dedicated) (?:in|into|to) the public domain
2 | public-domain | domain public | (?:is|are) in the public domain
2 | public-domain | dedication domain | public domain dedication(?: and license)?
3 | public-domain | domain public | public domain
2 | pddl-1.0 | pddl | pddl(?: <1>)?
2 | pddl-1.0 | commons dedication | open data commons public domain dedication(?: and)? license
2 | odbl-1.0 | commons database | open data commons open database license(?: odbl)?(?: <1>)?
2 | odbl-1.0 | database open | open database license(?: odbl)?(?: <1>)?
3 | odbl-1.0 | odbl | odbl(?: <1>)?
2 | odc-by-1.0 | odc attribution | odc by(?: <1>)?
2 | odc-by-1.0 | commons attribution data | open data commons attribution license(?: <1>)?
2 | wtfpl | wtfpl | wtfpl(?: <2>)?
2 | wtfpl | fuck public | do what the fuck you want to public license
2 | afl-3.0 | academic free | academic free license <3>
3 | afl | academic free | academic free licen[cs]e
2 | osl-3.0 | software open | open software license <3>
3 | osl | software open | open software licen[cs]e
2 | ecl-2.0 | educational community | educational community license <2>
2 | ms-pl | microsoft public | microsoft public license(?: ms pl)?
2 | ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
3 | ms-pl | ms pl | ms pl
2 | ofl-1.1 | sil font | sil open font license(?: <1.1>)?
3 | ofl-1.1 | ofl 1 | ofl <1.1>
2 | ofl-1.1 | font open | open font license <1.1>
2 | psf-2.0 | python foundation | python software foundation license(?: <2>)?
3 | psf-2.0 | psf license | psf license(?: agreement)?
2 | python-2.0 | python license | python license(?: <2>)?
2 | php-3.01 | php license | php license(?: (?:version |v |v)?3 01)?
2 | ruby | ruby license | ruby license
1 | ruby | ruby terms | under the same terms as ruby(?: itself)?
2 | postgresql | postgresql | postgresql licen[cs]e
2 | openssl | openssl | (?:openssl|openssl ssleay) licen[cs]e
2 | w3c | w3c license | w3c software (?:notice and )?license
2 | x11 | x11 | x11 licen[cs]e
2 | ncsa | ncsa license | (?:university of illinois )?(?:ncsa|ncsa open source) license
2 | vim | vim | vim licen[cs]e
2 | curl | curl | curl licen[cs]e
2 | libpng | libpng | libpng licen[cs]e(?: <2>)?
2 | ijg | jpeg independent | independent jpeg group(?: s)? licen[cs]e
2 | unicode | unicode | unicode (?:dfs |data files )?licen[cs]e
2 | icu | icu | icu licen[cs]e
2 | json | json | json licen[cs]e
1 | json | evil good | the software shall be used for good not evil
2 | beerware | beerware | beerware(?: license)?
2 | beerware | beer ware | beer ware licen[cs]e
2 | cecill-2.1 | cecill 2 | cecill(?: free software licen[cs]e)?(?: agreement)? <2.1>
3 | cecill | cecill | cecill(?: [bc])?
2 | upl-1.0 | universal permissive | universal permissive license(?: <1>)?
2 | mulan-psl-2.0 | mulan license | mulan (?:permissive software license|psl)(?: <2>)?
2 | sspl-1.0 | side server | server side public license(?: <1>)?
2 | elastic-2.0 | elastic license | elastic license(?: <2>)?
2 | commons-clause | clause commons | commons clause(?: license condition)?
2 | polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter) license(?: <1>)?
2 | openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
2 | openrail | rail license | (?:responsible ai|rail) license
2 | llama-community | llama community | llama ~2 community license(?: agreement)?
2 | ogl-3.0 | government open | open government licen[cs]e <3>
2 | ogl-2.0 | government open | open government licen[cs]e <2>
3 | ogl | government open | open government licen[cs]e
1 | contains-ogl | sector public information | contains public sector information licensed under the open government licence(?: <3>)?
2 | cc0-1.0 | cc0 | cc0(?: <1>)?(?: universal)?
2 | cc0-1.0 | cc zero | cc zero(?: <1>)?
1 | cc0-1.0 | commons cc0 | <under> creative commons (?:cc0|zero)(?: <1>)?
2 | cc0-1.0 | commons zero | creative commons zero(?: <1>)?
2 | cc-pdm | mark domain | public domain mark(?: <1>)?
3 | creative-commons | commons creative | creative commons licen[cs]e
3 | creative-commons | creativecommons | creativecommons org licenses
2 | gfdl-1.3 | gnu documentation | gnu free documentation license <1.3>
2 | gfdl-1.2 | gnu documentation | gnu free documentation license <1.2>
3 | gfdl | gnu documentation | gnu free documentation licen[cs]e
3 | gfdl | gfdl | gfdl
2 | gpl | gpl compatible | gpl compatible
3 | gpl | gpl | gnu gpl
3 | lgpl | lgpl | gnu lgpl
3 | agpl | agpl | gnu agpl
3 | gpl | gpl | <the>gpl
3 | lgpl | lgpl | <the>lgpl
3 | agpl | agpl | <the>agpl
4 | proprietary | proprietary | proprietary (?:and confidential|software|license|information)
2 | proprietary | confidential proprietary | confidential and proprietary
2 | proprietary | unauthorized prohibited | unauthorized (?:copying|reproduction|distribution|use) ~12 (?:is )?(?:strictly )?prohibited
2 | proprietary | reproduced permission | (?:no part|may not be reproduced) ~24 without ~4(?:written )?permission
2 | proprietary | commercial license | commercial license agreement
2 | eula | eula | end user license agreement eula
2 | eula | user agreement | end user licen[cs]e agreement
3 | eula | eula | eula
2 | non-commercial | commercial non | for non commercial (?:use|purposes)(?: only)?
2 | non-commercial | noncommercial | for noncommercial (?:use|purposes)(?: only)?
2 | no-derivatives | derivatives | no derivatives(?: licen[cs]e)?
2 | evaluation | evaluation | for evaluation purposes only
4 | copyright | copyright | copyright (?:c )?(?:[12][0-9]{3} )+~6 all rights reserved
4 | copyright | copyright | copyright (?:c )?[12][0-9]{3}
4 | copyright | copyright | copyright c
4 | copyright | © | ©(?: copyright)?(?: [12][0-9]{3})?
4 | copyright | holder copyright | copyright holders?
4 | reserved | reserved | some rights reserved
4 | reserved | reserved | no rights reserved
4 | license | licensed | licen[cs]ed under
4 | license | licenced | licen[cs]ed under
4 | license | license | (?:see|read) (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?(?: for details)?
4 | license | spdx | spdx license identifier [^ ]+
4 | license | license | (?:open source|free software) license
4 | license | lizenz | (?:lizenziert|veröffentlicht) unter (?:der |einer )?[^ ]+ lizenz
4 | license | licence | (?:sous|selon) (?:la )?licence [^ ]+
4 | license | licencia | bajo (?:la )?licencia [^ ]+
4 | reserved | rechte | alle rechte vorbehalten
4 | reserved | droits | tous droits réservés
4 | reserved | derechos | todos los derechos reservados
"""

_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_GNU = (("gpl", "", ("1", "2", "3")), ("lgpl", "(?:lesser|library) ", ("2", "2.1", "3")), ("agpl", "affero ", ("1", "3")))
_MACROS = {
    "<under>": "(?:licensed|released|distributed|available|provided|published) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?",
    "<the>": "(?:the )?",
}
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.6, 4: 0.3}


@dataclass(frozen=True)
class Rule:
    number: int
    level: int
    label: str
    words: tuple[str, ...]
    pattern: str
    base: bool = False


def _version(match: re.Match) -> str:
    major, _, minor = match[1].partition(".")
    tail = f" {minor}" if minor else "(?: 0)?"
    return f"(?:version |v |v)?{major}{tail}"


def _expand(pattern: str) -> str:
    for name, meaning in _MACROS.items():
        pattern = pattern.replace(name + " ", meaning).replace(name, meaning)
    pattern = re.sub(r"<([0-9.]+)>", _version, pattern)
    return re.sub(r"~([0-9]+) ?", r"(?:[^ ]+ ){0,\1}?", pattern)


def _families() -> list[str]:
    """Lines for the licences that come in many versions: Creative Commons by its parts, and the GNU licences."""
    lines = []
    for parts in _PARTS:
        label = "cc-" + parts.replace(" ", "-")
        words = " ".join(f"(?:{_WORDS[p]})" for p in parts.split())
        for v in _CC_VERSIONS:
            lines += [
                f"1 | {label}-{v} | cc by | <under> (?:creative commons )?cc {parts} <{v}>", f"2 | {label}-{v} | cc by | cc {parts} <{v}>",
                f"2 | {label}-{v} | commons attribution | (?:creative commons )?{words} <{v}>(?: international| unported| generic)?",
                f"3 | {label}-{v} | licenses by | creativecommons org licenses {parts} {v.replace('.', ' ')}",
            ]
        lines += [f"3 | {label} | cc by | cc {parts}", f"3 | {label} | commons attribution | creative commons {words}"]
    for label, kind, versions in _GNU:
        name = f"(?:gnu )?{kind}general public licen[cs]e"
        for v in versions:
            full = f"{label}-{v if '.' in v else v + '.0'}"
            lines += [
                f"1 | {full} | general public | <under> {name} <{v}>", f"2 | {full} | general public | {name}(?: {label})? <{v}>",
                f"1 | {full}-or-later | general public later | {name} ~8 <{v}> (?:of the license )?or (?:at your option )?any later(?: version)?",
                f"2 | {full} | {label} {v[0]} | {label} <{v}>(?: only)?", f"3 | {full} | {label}v{v[0]} | {label}v{v.replace('.', ' ')}(?: 0)?(?: only)?",
                f"1 | {full}-or-later | {label} {v[0]} later | {label} <{v}> or later",
            ]
        lines.append(f"2 | {label} | general public | {name}")
    return lines


def license_rules() -> list[Rule]:
    """All rules in order: the base phrases, the lines written by hand, and the families."""
    rules = [Rule(i, 3, label, (word,), phrase, True) for i, (label, word, phrase) in enumerate(BASE)]
    for line in [*HAND_WRITTEN.strip().splitlines(), *_families()]:
        level, label, words, pattern = (part.strip() for part in line.split(" | "))
        rules.append(Rule(len(rules), int(level), label, tuple(words.split()), _expand(pattern)))
    return rules
