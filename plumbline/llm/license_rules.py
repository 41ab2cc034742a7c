"""The signature rules of the license scan.

Three kinds, all written by hand: sentences and addresses that a licence's own
text or header has (SENTENCES), identifiers after an SPDX tag (SPDX), and names
of licences (NOTICES), each looked for alone and in the forms of FORMS, such as
"licensed under the". That makes some hundreds of rules in a fixed order: by
priority, then by place in the tables. A rule is tried only on texts that
contain its keywords; a keyword with | is there if one of its parts is.
"""

from __future__ import annotations

#: Label, keyword, pattern of the name in lower-case text.
NOTICES = [
    ("apache-2.0", "apache", r"apache(?: software)?[ -]licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?[ -]licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?1\.1"),
    ("agpl-3.0", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e(?:[,;]?\s+(?:version\s+|v\.?\s?)?3(?:\.0)?)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?3(?:\.0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?2\.1"),
    ("lgpl", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e"),
    ("gpl-3.0", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?3(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?2(?:\.0)?"),
    ("gpl", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e"),
    ("agpl-3.0", "agpl", r"agpl[ -]?v?3(?:\.0)?"),
    ("lgpl-3.0", "lgpl", r"lgpl[ -]?v?3(?:\.0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl[ -]?v?2\.1"),
    ("gpl-3.0", "gpl", r"gpl[ -]?v?3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"gpl[ -]?v?2(?:\.0)?"),
    ("mit", "licen", r"mit(?:/x11)?[ -]licen[sc]e"),
    ("x11", "licen", r"x11[ -]licen[sc]e"),
    ("isc", "licen", r"isc[ -]licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified\s+bsd|bsd[ -]2[ -]clause|2[ -]clause\s+bsd)(?:\s+licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new\s+bsd|modified\s+bsd|bsd[ -]3[ -]clause|3[ -]clause\s+bsd)(?:\s+licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original\s+bsd|bsd[ -]4[ -]clause|4[ -]clause\s+bsd)(?:\s+licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:zero[ -]clause\s+bsd|0bsd)(?:\s+licen[sc]e)?"),
    ("bsd", "bsd", r"bsd[ -](?:style\s+)?licen[sc]e"),
    ("mpl-2.0", "mozilla", r"mozilla\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?2(?:\.0)?"),
    ("mpl-1.1", "mozilla", r"mozilla\s+public\s+licen[sc]e[,;]?\s+(?:version\s+|v\.?\s?)?1\.1"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[sc]e"),
    ("epl-2.0", "eclipse", r"eclipse\s+public\s+licen[sc]e(?:[,;]?\s+(?:version\s+|v\.?\s?)?2(?:\.0)?)"),
    ("epl-1.0", "eclipse", r"eclipse\s+public\s+licen[sc]e(?:[,;]?\s+(?:version\s+|v\.?\s?)?1(?:\.0)?)?"),
    ("cddl-1.0", "common development", r"common\s+development\s+and\s+distribution\s+licen[sc]e"),
    ("artistic-2.0", "artistic", r"artistic\s+licen[sc]e(?:\s+2(?:\.0)?)"),
    ("artistic-1.0", "artistic", r"artistic\s+licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)?[ -]licen[sc]e"),
    ("boost-1.0", "boost", r"boost\s+software\s+licen[sc]e"),
    ("python-2.0", "python", r"python\s+software\s+foundation\s+licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl-1.1", "open font", r"(?:sil\s+)?open\s+font\s+licen[sc]e(?:[,;]?\s+(?:version\s+|v\.?\s?)?1\.1)?"),
    ("odbl-1.0", "open database", r"open\s+database\s+licen[sc]e"),
    ("eupl-1.2", "european union public", r"european\s+union\s+public\s+licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?"),
    ("cc-by-nc-sa", "cc by|cc-by", r"cc[ -]by[ -]nc[ -]sa(?:[ -]\d\.\d)?"),
    ("cc-by-nc-nd", "cc by|cc-by", r"cc[ -]by[ -]nc[ -]nd(?:[ -]\d\.\d)?"),
    ("cc-by-nc", "cc by|cc-by", r"cc[ -]by[ -]nc(?:[ -]\d\.\d)?"),
    ("cc-by-nd", "cc by|cc-by", r"cc[ -]by[ -]nd(?:[ -]\d\.\d)?"),
    ("cc-by-sa", "cc by|cc-by", r"cc[ -]by[ -]sa(?:[ -]\d\.\d)?"),
    ("cc-by-4.0", "cc by|cc-by", r"cc[ -]by[ -]4\.0"),
    ("cc-by-sa", "creative commons", r"creative\s+commons\s+attribution[ -]share[ -]?alike"),
    ("cc-by-nc", "creative commons", r"creative\s+commons\s+attribution[ -]non[ -]?commercial"),
    ("creative-commons", "creative commons", r"creative\s+commons(?:\s+licen[sc]e)?"),
    ("public-domain", "public domain", r"public\s+domain"),
    ("proprietary", "proprietary", r"proprietary(?:\s+and\s+confidential)?"),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)\s*|©\s*)?(?:19|20)\d\d"),
    ("no-warranty", "warranty", r"without\s+(?:any\s+)?warranty(?:\s+of\s+any\s+kind)?"),
]

#: Label, keyword, what a licence's text or header says, in lower-case text.
SENTENCES = [
    ("mit", "hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("mit", "permission notice", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included"),
    ("mit", "opensource.org", r"opensource\.org/licenses/mit"),
    ("boost-1.0", "hereby granted", r"to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software\s+and\s+accompanying\s+documentation"),
    ("boost-1.0", "boost.org", r"boost\.org/license_1_0\.txt"),
    ("isc", "hereby granted", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    ("postgresql", "hereby granted", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose"),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification"),
    ("bsd", "redistributions", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice"),
    ("bsd-3-clause", "endorse", r"neither\s+the\s+names?\s+of\s+[^.]{1,120}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote"),
    ("bsd-4-clause", "advertising", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("apache-2.0", "compliance with the license", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "contributor license agreements", r"contributor\s+license\s+agreements\.\s+see\s+the\s+notice\s+file"),
    ("gpl-3.0", "redistribute", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license[^.]{1,120}?version\s+3"),
    ("gpl-2.0", "redistribute", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license[^.]{1,120}?version\s+2"),
    ("lgpl", "redistribute", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+license"),
    ("agpl-3.0", "redistribute", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license"),
    ("gpl", "free software", r"this\s+(?:program|file|package)\s+is\s+free\s+software[:;]"),
    ("lgpl", "free software", r"this\s+library\s+is\s+free\s+software[:;]"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl"),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/lgpl"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/agpl"),
    ("gfdl", "documentation license", r"gnu\s+free\s+documentation\s+license"),
    ("mpl-2.0", "source code form", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("epl-2.0", "accompanying materials", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license,?\s+(?:v\.?\s?|version\s+)?2"),
    ("epl-1.0", "accompanying materials", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license,?\s+(?:v\.?\s?|version\s+)?1"),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "public license", r"do\s+what\s+the\s+f\w{1,6}\s+you\s+want\s+to\s+public\s+license"),
    ("zlib", "plainly marked", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("zlib", "misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("cc0-1.0", "possible under law", r"to\s+the\s+extent\s+possible\s+under\s+law,[^.]{1,160}?waived\s+all\s+copyright"),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc(?=/|$|\s)"),
    ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by(?=/|$|\s)"),
    ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("artistic-1.0", "intent of this document", r"the\s+intent\s+of\s+this\s+document\s+is\s+to\s+state\s+the\s+conditions\s+under\s+which\s+a\s+package\s+may\s+be\s+copied"),
    ("python-2.0", "psf", r"psf\s+is\s+making\s+python\s+[^.]{0,40}?available\s+to\s+licensee"),
    ("ms-pl", "microsoft", r"microsoft\s+public\s+license"),
    ("ms-rl", "microsoft", r"microsoft\s+reciprocal\s+license"),
    ("cecill-2.1", "cecill", r"cecill\s+(?:v\.?\s?|version\s+)?2(?:\.1)?"),
    ("openssl", "openssl", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project"),
    ("php-3.01", "php", r"php\s+license,?\s+version\s+3\.01"),
    ("beerware", "beer", r"you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return"),
    ("no-warranty", "as is", r"(?:provided|distributed)\s+(?:by\s+[^.]{1,60}?)?[\"']?as\s+is[\"']?,?\s+(?:and\s+any\s+express|without\s+(?:any\s+)?(?:express|warrant))"),
    ("no-warranty", "held liable", r"in\s+no\s+event\s+will\s+the\s+authors?\s+be\s+held\s+liable"),
    ("no-warranty", "be liable", r"in\s+no\s+event\s+shall\s+the\s+(?:authors|copyright)\s+[^.]{0,60}?be\s+liable"),
    ("no-warranty", "merchantability", r"implied\s+warrant(?:y|ies)\s+of\s+merchantability\s+(?:or|and)\s+fitness"),
    ("proprietary", "unauthorized", r"unauthorized\s+(?:copying|reproduction|use|distribution)\s+(?:of\s+this\s+\w+[^.]{0,60}?)?is\s+(?:strictly\s+)?prohibited"),
    ("proprietary", "confidential", r"confidential\s+and\s+proprietary"),
    ("proprietary", "permission", r"(?:may|must)\s+not\s+be\s+(?:copied|reproduced|distributed|used)[^.]{0,80}?without\s+(?:the\s+)?(?:prior\s+|express\s+)*(?:written\s+)?permission"),
]

#: Identifiers after an SPDX tag, in lower case.
SPDX = """
0bsd aal afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0
cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3
gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu intel isc jpnic lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0
python-2.0 qpl-1.0 ruby sissl sleepycat spl-1.0 sspl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1
""".split()

#: Form, priority (higher first), confidence, keyword, what stands before the name.
FORMS = [
    ("licensed-under", 8, 0.95, "licensed", r"(?:dual-)?licensed\s+(?:to\s+\w+\s+)?under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"),
    ("released-under", 7, 0.95, "released", r"(?:is\s+)?released\s+(?:in)?(?:under|to|into)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"),
    ("distributed-under", 6, 0.9, "distribut", r"(?:re)?distributed\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"),
    ("available-under", 5, 0.9, "available", r"(?:made\s+)?available\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"),
    ("subject-to", 4, 0.8, "subject to", r"subject\s+to\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?"),
    ("under-the-terms", 3, 0.8, "terms", r"under\s+the\s+terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?"),
    ("named", 1, 0.6, "", r""),
]

#: Short names that are one only after such a form or tag, for they are words or parts of others.
SHORT_NAMES = [("mit", r"mit(?!/| licen)"), ("isc", r"isc(?! licen)"), ("bsd", r"bsd(?![ -])"), ("gpl", r"gpl(?![ -]?v?\d)"), ("lgpl", r"lgpl(?![ -]?v?\d)"), ("apache-2.0", r"apache[ -]2(?:\.0)?"), ("mpl-2.0", r"mpl[ -]?v?2(?:\.0)?"), ("cc0-1.0", r"cc0")]

#: Keyword and beginning of what an SPDX tag is followed by: one or several identifiers in one line.
TAG = "spdx-license-identifier"


def rules() -> list[tuple[int, int, str, float, str, str, str]]:
    """(order, priority, label, confidence, form's keyword, rule's keyword, pattern), first the highest priority."""
    found = []

    def add(priority: int, label: str, confidence: float, form_word: str, word: str, pattern: str) -> None:
        found.append((len(found), priority, label, confidence, form_word, word, pattern))

    for name in SPDX:
        add(10, name, 1.0, "", TAG, rf"(?<={TAG}:[^\n]{{0,120}}[\s(]){name.replace('.', chr(92) + '.')}(?:\+)?(?![a-z0-9.+-])")
    for label, word, sentence in SENTENCES:
        add(9, label, 0.98, "", word, rf"(?<![a-z0-9]){sentence}")
    for form, priority, confidence, form_word, before in FORMS:
        for label, word, name in NOTICES:
            add(priority, label, confidence, form_word, word, rf"(?<![a-z0-9]){before}{name}(?![a-z0-9])")
        for label, name in SHORT_NAMES if form != "named" else ():
            add(priority, label, confidence, form_word, form_word, rf"(?<![a-z0-9]){before}{name}(?![a-z0-9])")
    return found
