"""Ordered signature rules for license statements.

A rule is a regular expression over a text's normal form: lower-case words joined by single spaces,
with a space at both ends. Rules are hand-written; ``needs``, strings of which every match has one,
is read off their expressions. Lower priority numbers win over higher ones.
"""

import re
from dataclasses import dataclass

from ..functions.literals import needed

#: Fixed base phrases: label, words.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


@dataclass(frozen=True)
class Rule:
    """One signature: what it says, how strongly, and what must be in a text for it to be tried."""

    label: str
    priority: int
    needs: tuple[str, ...]
    pattern: str
    confidence: float

    def compiled(self) -> re.Pattern:
        return re.compile(f"(?<= )(?:{self.pattern})(?= )")


_SAID = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|made available|dual licen[sc]ed)"
_UNDER = r"(?:under|by|per|subject to|according to)"
_THE = r"(?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"

#: label; names by which the license is called (regexes); SPDX identifiers as words.
NAMED = (
    ("mit", (r"mit licen[sc]e", r"mit x11 licen[sc]e", r"expat licen[sc]e"), (r"mit",)),
    ("mit-0", (r"mit no attribution(?: licen[sc]e)?",), (r"mit 0",)),
    ("x11", (r"x11 licen[sc]e", r"x consortium licen[sc]e"), (r"x11",)),
    ("apache-1", (r"apache (?:software )?licen[sc]e (?:version |v )?1(?: [01])?",), (r"apache 1 [01]",)),
    ("apache-2", (r"apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?", r"apache 2 0 licen[sc]e"), (r"apache 2 0",)),
    ("apache", (r"apache (?:software )?licen[sc]e",), ()),
    ("bsd-2-clause", (r"(?:bsd )?2 clause bsd licen[sc]e", r"bsd 2 clause (?:simplified )?licen[sc]e", r"simplified bsd licen[sc]e", r"freebsd licen[sc]e"), (r"bsd 2 clause",)),
    ("bsd-3-clause", (r"3 clause bsd licen[sc]e", r"bsd 3 clause (?:new |revised )?licen[sc]e", r"(?:new|modified|revised) bsd licen[sc]e"), (r"bsd 3 clause",)),
    ("bsd-4-clause", (r"4 clause bsd licen[sc]e", r"(?:original|old) bsd licen[sc]e"), (r"bsd 4 clause",)),
    ("0bsd", (r"zero clause bsd(?: licen[sc]e)?", r"bsd zero clause licen[sc]e", r"free public licen[sc]e 1 0 0"), (r"0bsd",)),
    ("bsd", (r"bsd(?: style)? licen[sc]e",), ()),
    ("isc", (r"isc licen[sc]e",), (r"isc",)),
    ("gpl-1", (r"gnu general public licen[sc]e (?:version |v )?1(?: 0)?",), (r"gpl 1 0(?: only| or later)?",)),
    ("gpl-2", (r"gnu general public licen[sc]e (?:version |v )?2(?: 0)?", r"gnu gpl (?:version |v ?)?2", r"gplv2"), (r"gpl 2 0(?: only| or later)?",)),
    ("gpl-3", (r"gnu general public licen[sc]e (?:version |v )?3(?: 0)?", r"gnu gpl (?:version |v ?)?3", r"gplv3"), (r"gpl 3 0(?: only| or later)?",)),
    ("gpl", (r"gnu general public licen[sc]e", r"gnu gpl", r"gpl licen[sc]e"), ()),
    ("lgpl-2", (r"gnu (?:library|lesser) general public licen[sc]e (?:version |v )?2(?: 0)?", r"lgplv2"), (r"lgpl 2 0(?: only| or later)?",)),
    ("lgpl-2.1", (r"gnu lesser general public licen[sc]e (?:version |v )?2 1", r"lgplv2 1"), (r"lgpl 2 1(?: only| or later)?",)),
    ("lgpl-3", (r"gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)?", r"lgplv3"), (r"lgpl 3 0(?: only| or later)?",)),
    ("lgpl", (r"gnu (?:lesser|library) general public licen[sc]e", r"gnu lgpl"), ()),
    ("agpl-3", (r"gnu affero general public licen[sc]e (?:version |v )?3(?: 0)?", r"agplv3"), (r"agpl 3 0(?: only| or later)?",)),
    ("agpl", (r"(?:gnu )?affero general public licen[sc]e", r"gnu agpl"), ()),
    ("gfdl", (r"gnu free documentation licen[sc]e(?: (?:version |v )?1 [123])?",), (r"gfdl 1 [123](?: only| or later)?",)),
    ("mpl-1", (r"mozilla public licen[sc]e (?:version |v )?1(?: [01])?",), (r"mpl 1 [01]",)),
    ("mpl-2", (r"mozilla public licen[sc]e (?:version |v )?2(?: 0)?",), (r"mpl 2 0",)),
    ("mpl", (r"mozilla public licen[sc]e",), ()),
    ("epl-1", (r"eclipse public licen[sc]e (?:version |v )?1(?: 0)?",), (r"epl 1 0",)),
    ("epl-2", (r"eclipse public licen[sc]e (?:version |v )?2(?: 0)?",), (r"epl 2 0",)),
    ("edl", (r"eclipse distribution licen[sc]e(?: 1 0)?",), ()),
    ("cddl-1", (r"common development and distribution licen[sc]e(?: (?:version |v )?1 [01])?",), (r"cddl 1 [01]",)),
    ("cpl-1", (r"common public licen[sc]e(?: (?:version |v )?1(?: 0)?)?",), (r"cpl 1 0",)),
    ("artistic-1", (r"artistic licen[sc]e (?:version |v )?1(?: 0)?",), (r"artistic 1 0",)),
    ("artistic-2", (r"artistic licen[sc]e (?:version |v )?2(?: 0)?",), (r"artistic 2 0",)),
    ("artistic", (r"(?:perl )?artistic licen[sc]e",), ()),
    ("zlib", (r"zlib(?: libpng)? licen[sc]e",), (r"zlib",)),
    ("libpng", (r"libpng licen[sc]e(?: version 2)?",), (r"libpng 2 0",)),
    ("bsl-1", (r"boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?",), (r"bsl 1 0",)),
    ("bsl-1.1", (r"business source licen[sc]e(?: (?:version |v )?1 1)?",), (r"busl 1 1",)),
    ("unlicense", (r"the unlicen[sc]e",), (r"unlicen[sc]e",)),
    ("wtfpl", (r"do what the fuck you want to public licen[sc]e",), (r"wtfpl",)),
    ("cc0", (r"cc0 1 0 universal", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"), (r"cc0 1 0",)),
    ("cc-by", (r"creative commons attribution (?:[1234] [05] )?(?:international |generic |unported )?licen[sc]e",), (r"cc by [1234] [05]",)),
    ("cc-by-sa", (r"creative commons attribution share ?alike(?: [1234] [05])?",), (r"cc by sa(?: [1234] [05])?",)),
    ("cc-by-nd", (r"creative commons attribution no ?deriv(?:ative|ative works|atives|s)(?: [1234] [05])?",), (r"cc by nd(?: [1234] [05])?",)),
    ("cc-by-nc", (r"creative commons attribution non ?commercial(?: [1234] [05])?",), (r"cc by nc [1234] [05]",)),
    ("cc-by-nc-sa", (r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?",), (r"cc by nc sa(?: [1234] [05])?",)),
    ("cc-by-nc-nd", (r"creative commons attribution non ?commercial no ?deriv(?:ative|ative works|atives|s)(?: [1234] [05])?",), (r"cc by nc nd(?: [1234] [05])?",)),
    ("odbl", (r"open data(?:base)? (?:commons )?(?:open database )?licen[sc]e(?: 1 0)?",), (r"odbl 1 0",)),
    ("pddl", (r"public domain dedication and licen[sc]e",), (r"pddl 1 0",)),
    ("odc-by", (r"open data commons attribution licen[sc]e",), (r"odc by(?: 1 0)?",)),
    ("ofl-1", (r"sil open font licen[sc]e(?: (?:version |v )?1 [01])?",), (r"ofl 1 [01]",)),
    ("psf-2", (r"python software foundation licen[sc]e(?: (?:version )?2)?", r"psf licen[sc]e"), (r"psf 2 0", r"python 2 0")),
    ("ruby", (r"ruby licen[sc]e",), ()),
    ("php-3", (r"php licen[sc]e(?: (?:version |v )?3(?: 0| 01)?)?",), (r"php 3 0(?:1)?",)),
    ("postgresql", (r"postgresql licen[sc]e",), (r"postgresql",)),
    ("ncsa", (r"university of illinois (?:ncsa )?open source licen[sc]e", r"ncsa open source licen[sc]e"), (r"ncsa",)),
    ("osl-3", (r"open software licen[sc]e(?: (?:version |v )?3(?: 0)?)?",), (r"osl 3 0",)),
    ("afl-3", (r"academic free licen[sc]e(?: (?:version |v )?[123](?: [01])?)?",), (r"afl [123] [01]",)),
    ("eupl-1", (r"european union public licen[sc]e(?: (?:version |v )?1 [012])?",), (r"eupl 1 [012]",)),
    ("cecill", (r"cecill (?:b |c )?(?:free software )?licen[sc]e",), (r"cecill(?: [12] [01]| b| c)",)),
    ("ms-pl", (r"microsoft public licen[sc]e",), (r"ms pl",)),
    ("ms-rl", (r"microsoft reciprocal licen[sc]e",), (r"ms rl",)),
    ("upl-1", (r"universal permissive licen[sc]e(?: (?:version |v )?1(?: 0)?)?",), (r"upl 1 0",)),
    ("blueoak-1", (r"blue oak model licen[sc]e",), (r"blueoak 1 0 0",)),
    ("sspl-1", (r"server side public licen[sc]e(?: (?:version |v )?1)?",), (r"sspl 1 0",)),
    ("elastic-2", (r"elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?",), (r"elastic 2 0",)),
    ("openssl", (r"openssl(?: ssleay)? licen[sc]e",), (r"openssl",)),
    ("curl", (r"curl licen[sc]e",), (r"curl",)),
    ("vim", (r"vim licen[sc]e",), (r"vim",)),
    ("json", (r"json licen[sc]e",), (r"json",)),
    ("w3c", (r"w3c software(?: notice and)? licen[sc]e",), (r"w3c",)),
    ("lppl-1", (r"latex project public licen[sc]e(?: (?:version |v )?1 [0123][a-c]?)?",), (r"lppl 1 [0123][a-c]?",)),
    ("qpl-1", (r"q public licen[sc]e(?: 1 0)?",), (r"qpl 1 0",)),
    ("zpl-2", (r"zope public licen[sc]e(?: (?:version |v )?2 [01])?",), (r"zpl 2 [01]",)),
    ("tcl", (r"tcl(?: tk)? licen[sc]e",), (r"tcl",)),
    ("hpnd", (r"historical permission notice and disclaimer",), (r"hpnd",)),
    ("cpal-1", (r"common public attribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?",), (r"cpal 1 0",)),
    ("rpl-1", (r"reciprocal public licen[sc]e(?: (?:version |v )?1 [15])?",), (r"rpl 1 [15]",)),
    ("sleepycat", (r"sleepycat licen[sc]e",), (r"sleepycat",)),
    ("openrail", (r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e",), (r"(?:creativeml |bigscience )?openrail(?: m)?",)),
    ("llama-2", (r"llama 2 community licen[sc]e(?: agreement)?",), (r"llama2",)),
    ("llama-3", (r"(?:meta )?llama 3 community licen[sc]e(?: agreement)?",), (r"llama3",)),
)

#: Sentences of license texts and notices that name no license themselves: label, priority, pattern, confidence.
SENTENCES = (
    ("mit", 20, r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.95),
    ("isc", 20, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", 21, r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-3-clause", 20, r"neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", 0.9),
    ("bsd-4-clause", 20, r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("gpl", 22, r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.95),
    ("lgpl", 22, r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 0.95),
    ("agpl", 22, r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 0.95),
    ("gpl-2", 12, r"gnu general public licen[sc]e as published by the free software foundation either version 2", 0.98),
    ("gpl-3", 12, r"gnu general public licen[sc]e as published by the free software foundation either version 3", 0.98),
    ("lgpl-2.1", 12, r"gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 0.98),
    ("lgpl-3", 12, r"gnu lesser general public licen[sc]e as published by the free software foundation either version 3", 0.98),
    ("agpl-3", 12, r"gnu affero general public licen[sc]e as published by the free software foundation either version 3", 0.98),
    ("apache-2", 12, r"http www apache org licenses license 2 0", 0.98),
    ("mit", 12, r"https? opensource org licenses mit", 0.98),
    ("gpl", 23, r"https? www gnu org licenses(?: gpl)?", 0.7),
    ("mpl-2", 12, r"https? mozilla org mpl 2 0", 0.98),
    ("cc-by", 13, r"https? creativecommons org licenses by [1234] [05]", 0.98),
    ("cc-by-sa", 12, r"https? creativecommons org licenses by sa [1234] [05]", 0.98),
    ("cc-by-nc", 12, r"https? creativecommons org licenses by nc [1234] [05]", 0.98),
    ("cc-by-nd", 12, r"https? creativecommons org licenses by nd [1234] [05]", 0.98),
    ("cc-by-nc-sa", 11, r"https? creativecommons org licenses by nc sa [1234] [05]", 0.98),
    ("cc-by-nc-nd", 11, r"https? creativecommons org licenses by nc nd [1234] [05]", 0.98),
    ("cc0", 12, r"https? creativecommons org publicdomain zero 1 0", 0.98),
    ("unlicense", 20, r"this is free and unencumbered software released into the public domain", 0.98),
    ("public-domain", 30, r"(?:placed|released|dedicated|is) (?:in|into|to|in to) the public domain", 0.8),
    ("zlib", 20, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("bsl-1", 20, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 0.95),
    ("proprietary", 30, r"all rights reserved", 0.5),
    ("proprietary", 29, r"proprietary and confidential", 0.8),
    ("proprietary", 29, r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("wtfpl", 20, r"you just do what the fuck you want to", 0.95),
)


def rules() -> tuple[Rule, ...]:
    """All rules in order: for each named license its name, a statement with its name and its SPDX tag; then the sentences."""
    made = []
    for label, names, tags in NAMED:
        for name in names:
            # Names, identifiers and sentences have a space on both sides wherever they match.
            broad, needs = not re.search(r"\d", name), needed(f" {name} ")
            made.append(Rule(label, 15 + 3 * broad, needs, name, 0.85 - 0.1 * broad))
            made.append(Rule(label, 10 + 3 * broad, needs, f"{_SAID} {_UNDER} {_THE}{name}", 0.97 - 0.05 * broad))
        for tag in tags:
            made.append(Rule(label, 5, ("spdx license identifier",), f"spdx license identifier {tag}", 1.0))
            made.append(Rule(label, 9, needed(f" {tag} "), f"{_SAID} {_UNDER} {_THE}{tag}(?: licen[sc]e)?", 0.95))
    made += [Rule(label, priority, needed(f" {pattern} "), pattern, confidence) for label, priority, pattern, confidence in SENTENCES]
    return tuple(sorted(made, key=lambda r: (r.priority, -len(r.pattern), r.label)))
