"""License scan: ordered signature rules behind a keyword filter, with priority and interval suppression.

A rule is (priority, label, keyword, regular expression, confidence), written by hand below. Texts without any of a dozen
stems go by after one look. The others are lower-cased and their white space is evened out: a run of blanks is one blank, a line
break with the comment marks after it is one line break. Rules whose keyword occurs are applied to that form; every match is a
detection with its interval of characters. Of detections with one interval the first rule's stays; a detection that lies
within the interval of another one of a better priority, or within a longer one of its own priority, is dropped, by
running maxima over the detections of a document in order of their start, one for each priority; no pairs of detections are made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import text_or_empty

#: What parts words: all of ASCII but letters and digits, one by one, which Java looks up in a table (ranges it tries in turn).
PARTING = "".join(rf"\x{b:02X}" for b in range(128) if not chr(b).isalnum())
W = f"[^{PARTING}]"
N = f"[{PARTING}]"

# White space in texts: runs of blanks, and line breaks with marks of comments after them.
B = r"[\x20\t\x0B\f\r ]"
BREAK = rf"{B}*+(?:\n{B}*+(?:(?:[*#/;%>|!]++|--++){B}*+)?+)++"
BLANKS = rf"{B}++"
#: Between two words of a rule, once white space is evened out.
GAP = r"[\x20\n]"

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Every match of a rule holds one of these, or a short name.
STEMS = ["licen", "permission", "redistribut", "domain", "copyleft", "commons", "reserved", "proprietary", "spdx", "apache", "warrant", "attribution", "perl", "jpeg", "evil", "endorse", "advertising", "freedom", "mulan", "cecill", "wtfpl", "mozilla"]
SHORT_PARTS = ["gpl", "epl", "mpl", "cddl", "eupl", "lppl", "fdl", "bsd", "cc"]
SHORT = r"\b(?:(?:[la]?gp|ep|mp|cdd|eup|lpp)l|g?fdl|bsd|0bsd|freebsd|cc0|cc(?=[\s*#/;%>|!-]+by))(?:d|v|ver|version)?(?![a-z])"


# The rules: label; keyword; expression. A space is any gap. <2> is version 2: with or without the word, with or without .0 after it;
# it may be on the next line unless it looks like the number of a list there. Keywords are words that a match always holds.
VERSIONED = r"""
gpl-1.0; gpl; \bgpl<1>
gpl-2.0; gpl; \bgpl<2>
gpl-3.0; gpl; \bgpl<3>
gpl-1.0; general; \b(?:gnu )?general public licen[cs]e<1>
gpl-2.0; general; \b(?:gnu )?general public licen[cs]e<2>
gpl-3.0; general; \b(?:gnu )?general public licen[cs]e<3>
gpl-2.0; general; \b(?:gnu )?general public licen[cs]e \(gpl\)<2>
gpl-3.0; general; \b(?:gnu )?general public licen[cs]e \(gpl\)<3>
gpl-2.0; general; \bversion 2 of the (?:gnu )?general public licen[cs]e\b
gpl-3.0; general; \bversion 3 of the (?:gnu )?general public licen[cs]e\b
gpl-2.0; general; \bgeneral public licen[cs]e as published by the free software foundation[,;] (?:either )?version 2\b
gpl-3.0; general; \bgeneral public licen[cs]e as published by the free software foundation[,;] (?:either )?version 3\b
gpl-2.0-classpath; classpath; \bgpl<2> with (?:the )?classpath exception\b
lgpl-2.0; lgpl; \blgpl<2>
lgpl-2.1; lgpl; \blgpl<2.1>
lgpl-3.0; lgpl; \blgpl<3>
lgpl-2.0; library; \b(?:gnu )?library (?:or lesser )?general public licen[cs]e<2>
lgpl-2.1; lesser; \b(?:gnu )?lesser (?:or library )?general public licen[cs]e<2.1>
lgpl-2.0; lesser; \b(?:gnu )?lesser general public licen[cs]e<2>
lgpl-3.0; lesser; \b(?:gnu )?lesser general public licen[cs]e<3>
lgpl-2.1; lesser; \bversion 2\.1 of the (?:gnu )?lesser general public licen[cs]e\b
lgpl-3.0; lesser; \bversion 3 of the (?:gnu )?lesser general public licen[cs]e\b
lgpl-2.1; lesser; \blesser general public licen[cs]e as published by the free software foundation[,;] (?:either )?version 2\.1\b
lgpl-3.0; lesser; \blesser general public licen[cs]e as published by the free software foundation[,;] (?:either )?version 3\b
agpl-1.0; affero; \b(?:gnu )?affero general public licen[cs]e<1>
agpl-3.0; affero; \b(?:gnu )?affero general public licen[cs]e<3>
agpl-3.0; affero; \bversion 3 of the (?:gnu )?affero general public licen[cs]e\b
agpl-3.0; affero; \baffero general public licen[cs]e as published by the free software foundation[,;] (?:either )?version 3\b
agpl-1.0; agpl; \bagpl<1>
agpl-3.0; agpl; \bagpl<3>
gfdl-1.1; documentation; \b(?:gnu )?free documentation licen[cs]e<1.1>
gfdl-1.2; documentation; \b(?:gnu )?free documentation licen[cs]e<1.2>
gfdl-1.3; documentation; \b(?:gnu )?free documentation licen[cs]e<1.3>
gfdl-1.2; fdl; \bg?fdl<1.2>
gfdl-1.3; fdl; \bg?fdl<1.3>
apache-1.0; apache; \bapache(?: software)?(?: foundation)? licen[cs]e<1>
apache-1.1; apache; \bapache(?: software)?(?: foundation)? licen[cs]e<1.1>
apache-2.0; apache; \bapache(?: software)?(?: foundation)? licen[cs]e<2>
apache-2.0; apache; \bapache-?2(?:\.0)?(?: licen[cs]e)?\b
apache-2.0; apache; \bapache v2(?:\.0)?\b
apache-2.0; apache\.org; \bapache\.org/licenses/license-2\.0\b
apache-1.1; apache\.org; \bapache\.org/licenses/license-1\.1\b
mpl-1.0; mozilla; \bmozilla public licen[cs]e<1>
mpl-1.1; mozilla; \bmozilla public licen[cs]e<1.1>
mpl-2.0; mozilla; \bmozilla public licen[cs]e<2>
mpl-1.1; mpl; \bmpl<1.1>
mpl-2.0; mpl; \bmpl<2>
mpl-2.0; mozilla; \bmozilla\.org/mpl/2\.0\b
epl-1.0; eclipse; \beclipse public licen[cs]e<1>
epl-2.0; eclipse; \beclipse public licen[cs]e<2>
epl-1.0; epl; \bepl<1>
epl-2.0; epl; \bepl<2>
edl-1.0; eclipse; \beclipse distribution licen[cs]e<1>
cddl-1.0; cddl; \bcddl<1>
cddl-1.1; cddl; \bcddl<1.1>
cddl-1.0; distribution; \bcommon development and distribution licen[cs]e(?: \(cddl\))?<1>
cddl-1.1; distribution; \bcommon development and distribution licen[cs]e(?: \(cddl\))?<1.1>
cpl-1.0; common; \bcommon public licen[cs]e<1>
cpal-1.0; attribution; \bcommon public attribution licen[cs]e<1>
ipl-1.0; ibm; \bibm public licen[cs]e<1>
eupl-1.0; european; \beuropean union public licen[cs]e<1>
eupl-1.1; european; \beuropean union public licen[cs]e<1.1>
eupl-1.2; european; \beuropean union public licen[cs]e<1.2>
eupl-1.1; eupl; \beupl<1.1>
eupl-1.2; eupl; \beupl<1.2>
osl-1.0; open; \bopen software licen[cs]e<1>
osl-2.0; open; \bopen software licen[cs]e<2>
osl-2.1; open; \bopen software licen[cs]e<2.1>
osl-3.0; open; \bopen software licen[cs]e<3>
afl-1.2; academic; \bacademic free licen[cs]e<1.2>
afl-2.0; academic; \bacademic free licen[cs]e<2>
afl-2.1; academic; \bacademic free licen[cs]e<2.1>
afl-3.0; academic; \bacademic free licen[cs]e<3>
artistic-1.0; artistic; \bartistic licen[cs]e<1>
artistic-2.0; artistic; \bartistic licen[cs]e<2>
zpl-1.1; zope; \bzope public licen[cs]e<1.1>
zpl-2.0; zope; \bzope public licen[cs]e<2>
zpl-2.1; zope; \bzope public licen[cs]e<2.1>
lppl-1.0; latex; \blatex project public licen[cs]e<1>
lppl-1.2; latex; \blatex project public licen[cs]e<1.2>
lppl-1.3; latex; \blatex project public licen[cs]e<1.3>
lppl-1.3c; lppl; \blppl,? (?:version )?1\.3c\b
ecl-1.0; educational; \beducational community licen[cs]e<1>
ecl-2.0; educational; \beducational community licen[cs]e<2>
upl-1.0; universal; \buniversal permissive licen[cs]e<1>
bsl-1.0; boost; \bboost software licen[cs]e<1>
busl-1.1; business; \bbusiness source licen[cs]e<1.1>
sspl-1.0; side; \bserver side public licen[cs]e<1>
elastic-2.0; elastic; \belastic licen[cs]e<2>
php-3.0; php; \bphp licen[cs]e<3>
php-3.01; php; \bphp licen[cs]e<3.01>
psf-2.0; python; \bpython software foundation licen[cs]e<2>
ofl-1.0; font; \b(?:sil )?open font licen[cs]e<1>
ofl-1.1; font; \b(?:sil )?open font licen[cs]e<1.1>
apsl-1.0; apple; \bapple public source licen[cs]e<1>
apsl-1.1; apple; \bapple public source licen[cs]e<1.1>
apsl-1.2; apple; \bapple public source licen[cs]e<1.2>
apsl-2.0; apple; \bapple public source licen[cs]e<2>
npl-1.0; netscape; \bnetscape public licen[cs]e<1>
npl-1.1; netscape; \bnetscape public licen[cs]e<1.1>
cecill-1.0; cecill; \bcecill(?: free software)?(?: licen[cs]e)?<1>
cecill-2.0; cecill; \bcecill(?: free software)?(?: licen[cs]e)?<2>
cecill-2.1; cecill; \bcecill(?: free software)?(?: licen[cs]e)?<2.1>
cecill-b; cecill; \bcecill-b\b
cecill-c; cecill; \bcecill-c\b
rpl-1.1; reciprocal; \breciprocal public licen[cs]e<1.1>
rpl-1.5; reciprocal; \breciprocal public licen[cs]e<1.5>
ms-pl; microsoft; \bmicrosoft public licen[cs]e\b
ms-rl; microsoft; \bmicrosoft reciprocal licen[cs]e\b
qpl-1.0; public; \bq public licen[cs]e<1>
sleepycat; sleepycat; \bsleepycat (?:public )?licen[cs]e\b
unicode-3.0; unicode; \bunicode licen[cs]e<3>
w3c; w3c; \bw3c software (?:notice and|and document) licen[cs]e\b
blueoak-1.0; oak; \bblue oak model licen[cs]e<1>
mulan-1.0; mulan; \bmulan (?:psl|permissive software licen[cs]e)<1>
mulan-2.0; mulan; \bmulan (?:psl|permissive software licen[cs]e)<2>
vim; vim; \bvim licen[cs]e\b
odbl-1.0; database; \bopen database licen[cs]e(?: \(odbl\))?<1>
odc-by-1.0; commons; \bopen data commons attribution licen[cs]e<1>
pddl-1.0; domain; \bpublic domain dedication and licen[cs]e(?: \(pddl\))?<1>
etalab-2.0; licence; \b(?:etalab )?(?:licence ouverte|open licence)(?: etalab)?<2>
ogl-uk-3.0; government; \bopen government licen[cs]e<3>
ogl-uk-2.0; government; \bopen government licen[cs]e<2>
bsd-2-clause; bsd; \b(?:bsd[ \n-]2[ \n-]clause|2[ \n-]clause bsd|two[ \n-]clause bsd|simplified bsd|freebsd)(?:[ \n-]licen[cs]e)?\b
bsd-3-clause; bsd; \b(?:bsd[ \n-]3[ \n-]clause|3[ \n-]clause bsd|three[ \n-]clause bsd|(?:new|modified|revised) bsd)(?:[ \n-]licen[cs]e)?\b
bsd-4-clause; bsd; \b(?:bsd[ \n-]4[ \n-]clause|4[ \n-]clause bsd|four[ \n-]clause bsd|(?:original|old) bsd)(?:[ \n-]licen[cs]e)?\b
bsd-0-clause; bsd; \b(?:bsd[ \n-]zero[ \n-]clause|zero[ \n-]clause bsd|0bsd)(?:[ \n-]licen[cs]e)?\b
mit-0; mit; \bmit[ \n-](?:no attribution|0) licen[cs]e\b
mit-modern; mit; \bmodern mit licen[cs]e\b
"""
CREATIVE = r"""
cc-by-1.0; cc; \bcc[ \n-]by<1>
cc-by-2.0; cc; \bcc[ \n-]by<2>
cc-by-2.5; cc; \bcc[ \n-]by<2.5>
cc-by-3.0; cc; \bcc[ \n-]by<3>
cc-by-4.0; cc; \bcc[ \n-]by<4>
cc-by-sa-1.0; cc; \bcc[ \n-]by-sa<1>
cc-by-sa-2.0; cc; \bcc[ \n-]by-sa<2>
cc-by-sa-2.5; cc; \bcc[ \n-]by-sa<2.5>
cc-by-sa-3.0; cc; \bcc[ \n-]by-sa<3>
cc-by-sa-4.0; cc; \bcc[ \n-]by-sa<4>
cc-by-nd-2.0; cc; \bcc[ \n-]by-nd<2>
cc-by-nd-3.0; cc; \bcc[ \n-]by-nd<3>
cc-by-nd-4.0; cc; \bcc[ \n-]by-nd<4>
cc-by-nc-2.0; cc; \bcc[ \n-]by-nc<2>
cc-by-nc-2.5; cc; \bcc[ \n-]by-nc<2.5>
cc-by-nc-3.0; cc; \bcc[ \n-]by-nc<3>
cc-by-nc-4.0; cc; \bcc[ \n-]by-nc<4>
cc-by-nc-sa-2.0; cc; \bcc[ \n-]by-nc-sa<2>
cc-by-nc-sa-2.5; cc; \bcc[ \n-]by-nc-sa<2.5>
cc-by-nc-sa-3.0; cc; \bcc[ \n-]by-nc-sa<3>
cc-by-nc-sa-4.0; cc; \bcc[ \n-]by-nc-sa<4>
cc-by-nc-nd-2.0; cc; \bcc[ \n-]by-nc-nd<2>
cc-by-nc-nd-3.0; cc; \bcc[ \n-]by-nc-nd<3>
cc-by-nc-nd-4.0; cc; \bcc[ \n-]by-nc-nd<4>
cc-by-4.0; commons; \bcreative commons attribution(?: licen[cs]e)?<4>
cc-by-3.0; commons; \bcreative commons attribution(?: licen[cs]e)?<3>
cc-by-sa-3.0; commons; \bcreative commons attribution[ \n-]share[ \n-]?alike(?: licen[cs]e)?<3>
cc-by-sa-4.0; commons; \bcreative commons attribution[ \n-]share[ \n-]?alike(?: licen[cs]e)?<4>
cc-by-nc-4.0; commons; \bcreative commons attribution[ \n-]non-?commercial(?: licen[cs]e)?<4>
cc-by-nc-sa-4.0; commons; \bcreative commons attribution[ \n-]non-?commercial[ \n-]share[ \n-]?alike(?: licen[cs]e)?<4>
cc-by-4.0; creativecommons; \bcreativecommons\.org/licenses/by/4\.0\b
cc-by-3.0; creativecommons; \bcreativecommons\.org/licenses/by/3\.0\b
cc-by-sa-3.0; creativecommons; \bcreativecommons\.org/licenses/by-sa/3\.0\b
cc-by-sa-4.0; creativecommons; \bcreativecommons\.org/licenses/by-sa/4\.0\b
cc-by-nc-4.0; creativecommons; \bcreativecommons\.org/licenses/by-nc/4\.0\b
cc-by-nc-sa-4.0; creativecommons; \bcreativecommons\.org/licenses/by-nc-sa/4\.0\b
cc-by-nc-nd-4.0; creativecommons; \bcreativecommons\.org/licenses/by-nc-nd/4\.0\b
cc0; creativecommons; \bcreativecommons\.org/publicdomain/zero/1\.0\b
cc0; cc0; \bcc0(?:[ \n-]1(?:\.0)?)?\b
cc0; commons; \bcreative commons zero(?: v?1(?:\.0)?)?\b
"""
NAMES = r"""
gpl; gpl; \bgpl(?:'?d| licen[cs]ed?)?\b
gpl; general; \b(?:gnu )?general public licen[cs]e\b
gpl; gnu; \bgnu gpl\b
lgpl; lgpl; \blgpl(?: licen[cs]ed?)?\b
lgpl; lesser; \b(?:gnu )?lesser general public licen[cs]e\b
lgpl; library; \b(?:gnu )?library general public licen[cs]e\b
agpl; affero; \b(?:gnu )?affero general public licen[cs]e\b
agpl; agpl; \bagpl(?: licen[cs]ed?)?\b
gfdl; documentation; \b(?:gnu )?free documentation licen[cs]e\b
apache; apache; \bapache(?: software)?(?: foundation)? licen[cs]ed?\b
mpl; mozilla; \bmozilla public licen[cs]e\b
mpl; mpl; \bmpl licen[cs]ed?\b
epl; eclipse; \beclipse public licen[cs]e\b
cddl; distribution; \bcommon development and distribution licen[cs]e\b
cpl; common; \bcommon public licen[cs]e\b
eupl; european; \beuropean union public licen[cs]e\b
osl; open; \bopen software licen[cs]e\b
afl; academic; \bacademic free licen[cs]e\b
artistic; artistic; \bartistic licen[cs]e\b
zpl; zope; \bzope public licen[cs]e\b
lppl; latex; \blatex project public licen[cs]e\b
ecl; educational; \beducational community licen[cs]e\b
upl; universal; \buniversal permissive licen[cs]e\b
bsl; boost; \bboost software licen[cs]e\b
busl; business; \bbusiness source licen[cs]e\b
sspl; side; \bserver side public licen[cs]e\b
elastic; elastic; \belastic licen[cs]e\b
php; php; \bphp licen[cs]e\b
psf; python; \bpython (?:software foundation )?licen[cs]e\b
ofl; font; \b(?:sil )?open font licen[cs]e\b
apsl; apple; \bapple public source licen[cs]e\b
npl; netscape; \bnetscape public licen[cs]e\b
cecill; cecill; \bcecill(?: free software)? licen[cs]e\b
rpl; reciprocal; \breciprocal public licen[cs]e\b
odbl; database; \bopen database licen[cs]e\b
ogl; government; \bopen government licen[cs]e\b
unicode; unicode; \bunicode(?: data files and software)? licen[cs]e\b
mit; mit; \bmit(?:[ \n-]style)? licen[cs]ed?\b
mit; mit; \blicen[cs]ed under (?:the )?mit\b
mit; permission; \bpermission is hereby granted, free of charge, to any person obtaining a copy\b
x11; x11; \bx11 licen[cs]e\b
expat; expat; \bexpat licen[cs]e\b
isc; isc; \bisc licen[cs]ed?\b
isc; permission; \bpermission to use, copy, modify, and(?:/or)? distribute this software\b
ntp; permission; \bpermission to use, copy, modify,? and distribute this software and its documentation\b
bsd; bsd; \bbsd(?:[ \n-]style)? licen[cs]ed?\b
bsd; redistribution; \bredistribution and use in source and binary forms\b
bsd; redistribution; \bredistributions of source code must retain\b
bsd-3-clause; endorse; \bmay be used to endorse or promote products derived from this software without\b
bsd-4-clause; advertising; \ball advertising materials mentioning features or use of this software must display\b
apache-2.0; grant; \bgrant of copyright licen[cs]e\. subject to the terms and conditions of this licen[cs]e\b
mpl-2.0; source; \bthis source code form is subject to the terms of the mozilla public licen[cs]e\b
gpl; freedom; \bdesigned to take away your freedom to share and change\b
gpl; redistribute; \byou can redistribute it and/or modify it under the terms of the gnu\b
zlib; zlib; \bzlib(?:/libpng)? licen[cs]e\b
zlib; provided; \bthis software is provided 'as-is', without any express or implied warranty\b
libpng; libpng; \blibpng licen[cs]e\b
ijg; jpeg; \bindependent jpeg group'?s? (?:licen[cs]e|software)\b
unlicense; unlicense; \bunlicense\b
unlicense; unencumbered; \bfree and unencumbered software released into the public domain\b
wtfpl; want; \bdo what the f\w+ you want to public licen[cs]e\b
wtfpl; wtfpl; \bwtfpl\b
beerware; beer; \bbeer-?ware licen[cs]e\b
json; evil; \bthe software shall be used for good, not evil\b
ncsa; illinois; \buniversity of illinois(?:/ncsa)? open source licen[cs]e\b
ncsa; ncsa; \bncsa open source licen[cs]e\b
postgresql; postgresql; \bpostgresql licen[cs]e\b
openssl; openssl; \bopenssl licen[cs]e\b
curl; curl; \bcurl licen[cs]e\b
ruby; ruby; \bruby licen[cs]e\b
perl; perl; \bsame terms as perl itself\b
tcl; tcl; \btcl/tk licen[cs]e\b
hpnd; historical; \bhistorical permission notice and disclaimer\b
cc-by; cc; \bcc[ \n-]by(?![\w-])
cc-by-sa; cc; \bcc[ \n-]by-sa(?![\w-])
cc-by-nd; cc; \bcc[ \n-]by-nd(?![\w-])
cc-by-nc; cc; \bcc[ \n-]by-nc(?![\w-])
cc-by-nc-sa; cc; \bcc[ \n-]by-nc-sa(?![\w-])
cc-by-nc-nd; cc; \bcc[ \n-]by-nc-nd(?![\w-])
cc-by; commons; \bcreative commons attribution\b
cc-by-sa; commons; \bcreative commons attribution[ \n-]share[ \n-]?alike\b
cc-by-nd; commons; \bcreative commons attribution[ \n-]no[ \n-]?deriv(?:ative)?s?\b
cc-by-nc; commons; \bcreative commons attribution[ \n-]non-?commercial\b
cc-by-nc-sa; commons; \bcreative commons attribution[ \n-]non-?commercial[ \n-]share[ \n-]?alike\b
cc-by-nc-nd; commons; \bcreative commons attribution[ \n-]non-?commercial[ \n-]no[ \n-]?deriv(?:ative)?s?\b
cc; commons; \bcreative commons\b
commercial; commercial; \bcommercial licen[cs]e\b
evaluation; evaluation; \bevaluation licen[cs]e\b
eula; user; \bend[ \n-]user licen[cs]e agreement\b
"""
MENTIONS = r"""
public-domain; domain; \bpublic domain\b
proprietary; reserved; \ball rights reserved\b
proprietary; proprietary; \bproprietary (?:and confidential|licen[cs]e)\b
proprietary; confidential; \bconfidential and proprietary\b
copyleft; copyleft; \bcopyleft\b
unknown-license; licen; \blicen[cs]ed? under\b
unknown-license; licen; \breleased under (?:the|a) [\w.-]+ licen[cs]e\b
unknown-license; licen; \bterms (?:and conditions )?of (?:the|this) licen[cs]e\b
"""
# Identifiers that stand after SPDX-License-Identifier; a rule of best priority is made of each.
TAGS = """gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 agpl-1.0 agpl-3.0 gfdl-1.2 gfdl-1.3 apache-1.0 apache-1.1 apache-2.0 mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1
cpl-1.0 eupl-1.1 eupl-1.2 osl-3.0 afl-3.0 artistic-1.0 artistic-2.0 zpl-2.0 zpl-2.1 lppl-1.3c ecl-2.0 upl-1.0 bsl-1.0 busl-1.1 sspl-1.0 elastic-2.0 php-3.01 psf-2.0 ofl-1.1 apsl-2.0 mit mit-0 isc
bsd-2-clause bsd-3-clause bsd-4-clause 0bsd zlib unlicense wtfpl ncsa postgresql openssl curl x11 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0""".split()


def _number(v: str) -> str:
    """Version v on the same line, or on another line if it does not look like a list's number there; with or without trailing .0."""
    n = v.replace(".", "[.]")
    listed = "" if "." in v else r"(?![.)](?:\s|$))"
    word = rf",?(?:{GAP}?(?:[-–]{GAP}?)?(?:version|ver|v)[.]?{GAP}?|{GAP}v|-v?|\x20?[.]?\x20?)"
    return rf"(?:{word}{n}(?:[.]0)*|,?\n{n}(?:(?:[.]0)+|{listed}))(?![0-9]|[.][0-9])"


def _expression(written: str) -> str:
    """A rule's expression: <v> is a version, a space outside of brackets any gap."""
    parts = written.split("<")
    out = parts[0].replace(" ", GAP)
    for part in parts[1:]:
        v, rest = part.split(">", 1)
        out += _number(v) + rest.replace(" ", GAP)
    return out.replace(f"[{GAP}", r"[\x20")


def rules() -> list[tuple[int, str, str, str, float]]:
    """All rules, best priority (0) first: tags, names with a version, names and sentences of the texts themselves, and mere mentions."""
    out: list[tuple[int, str, str, str, float]] = []
    for tag in TAGS:
        name = tag.replace(".", "[.]")
        out.append((0, tag.removesuffix("-1.0") if tag == "cc0-1.0" else tag, "spdx", rf"\bspdx-license-identifier:\s?[(]?{name}(?:-only|-or-later|\+)?(?![\w.-])", 1.0))
    for priority, confidence, table in ((1, 0.95, VERSIONED), (1, 0.95, CREATIVE), (2, 0.7, NAMES), (3, 0.3, MENTIONS)):
        for line in table.strip().split("\n"):
            label, keyword, written = line.split("; ", 2)
            out.append((priority, label, keyword.replace("\\", ""), _expression(written), confidence))
    return out


PRIORITIES = 4
KEYWORDS = sorted({r[2] for r in rules()})


def _base(t: Column) -> dict[str, Column]:
    """Number of base phrases, first and last word they start at, and their labels, from one text column."""
    body = {p: N.join([""]) + f"{N}+".join(p.split(" ")) for p in PHRASES}
    any_ = rf"(?i)(?<!{W})(?:{'|'.join(body.values())})(?!{W})"
    n = F.regexp_count(t, F.lit(any_))
    # Word numbers: words before the first place, and words after the last one.
    before = F.try_element_at(F.split(t, any_, 2), F.lit(1))
    after = F.try_element_at(F.split(t, any_, -1), F.lit(-1))
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(any_), F.lit(0)), F.lit(-1))
    words = lambda c: F.regexp_count(c, F.lit(f"{W}+")).cast("long")
    labels = F.filter(F.array(*(F.when(F.regexp_like(t, F.lit(rf"(?i)(?<!{W}){body[p]}(?!{W})")), F.lit(label)) for p, label in PHRASES.items())), lambda x: x.isNotNull())
    return {"n": n.cast("long"), "first": words(before), "last": words(t) - words(after) - words(last), "labels": F.array_sort(F.array_distinct(labels))}


def _evened(low: Column) -> Column:
    """Lower-case texts with one blank for a run of blanks, and one line break for line breaks with blanks and comment marks around them."""
    return F.regexp_replace(F.regexp_replace(low, BREAK, "\n"), BLANKS, " ")


def _may_hold(low: Column) -> Column:
    """Whether a lower-case text has a stem or a short name. The text is bound to a variable, so that it is lower-cased once, not for every stem."""
    any_of = lambda x, names: functools.reduce(lambda a, b: a | b, (F.contains(x, F.lit(n)) for n in names))
    return F.exists(F.array(low), lambda x: any_of(x, STEMS) | (any_of(x, SHORT_PARTS) & F.regexp_like(x, F.lit(SHORT))))


def _hits(low: str) -> Column:
    """The keywords that occur in a column of lower-case texts."""
    return F.array_compact(F.array(*(F.when(F.contains(F.col(low), F.lit(k)), F.lit(k)) for k in KEYWORDS)))


def _detections(rows: DataFrame, key: list[str], text: str, hits: str) -> DataFrame:
    """(key, priority, label, confidence, start, end) of matches of the rules whose keyword occurs; key names one row.

    Where several rules match one interval, the first of them in order of the rules counts.
    """
    numbered = [(n, *r) for n, r in enumerate(rules())]
    table = rows.sparkSession.createDataFrame(numbered, "o int, p int, label string, k string, _r string, c double")
    tried = rows.select(*key, text, F.explode(hits).alias("k")).join(F.broadcast(table), "k")  # as many rows as there are rules
    found = tried.select(*key, F.struct("o", "p", "label", "c").alias("r"), F.regexp_extract_all(text, F.col("_r"), F.lit(0)).alias("m"), F.col(text).alias("_x"), F.col("_r").alias("_y")).where(F.size("m") > 0)
    # Where each match lies: the parts between matches have the rest of the length.
    zipped = F.transform(F.arrays_zip(F.split("_x", F.col("_y"), -1).alias("between"), "m"), lambda z: F.struct(F.length(z["between"]).alias("b"), F.length(z["m"]).alias("l")))
    parts = found.select(*key, "r", F.posexplode(zipped).alias("i", "z"))
    up_to = Window.partitionBy(*key, "r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = parts.withColumn("end", F.sum(F.col("z.b") + F.coalesce("z.l", F.lit(0))).over(up_to)).where(F.col("z.l").isNotNull())
    first = at.groupBy(*key, (F.col("end") - F.col("z.l")).alias("start"), "end").agg(F.min("r").alias("r"))
    return first.select(*key, F.col("r.p").alias("priority"), F.col("r.label").alias("label"), F.col("r.c").alias("confidence"), "start", "end")


def suppressed(found: DataFrame, key: list[str]) -> DataFrame:
    """Without the detections that lie within the interval of one of a better priority, or within a longer one of their own."""
    order = Window.partitionBy(*key).orderBy("start", F.col("end").desc(), "priority")
    kept = found
    for p in range(PRIORITIES - 1):
        kept = kept.withColumn(f"_r{p}", F.max(F.when(F.col("priority") == p, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.greatest(*(F.when(F.col("priority") > p, F.coalesce(F.col(f"_r{p}"), F.lit(-1))).otherwise(F.lit(-1)) for p in range(PRIORITIES - 1)))
    own = Window.partitionBy(*key, "priority").orderBy("start")
    earlier, so_far = (F.coalesce(F.max("end").over(own.rangeBetween(Window.unboundedPreceding, to)), F.lit(-1)) for to in (-1, 0))
    kept = kept.withColumn("_longer", (earlier >= F.col("end")) | (so_far > F.col("end")))
    return kept.where((covered < F.col("end")) & ~F.col("_longer")).drop("_longer", *(f"_r{p}" for p in range(PRIORITIES - 1)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, row_hash.

    A-Z count as a-z; words are runs of ASCII letters, digits and non-ASCII characters. n_base counts the places where
    the words of a base phrase stand one after another; first_word and last_word are the least and largest word number
    such a place starts at, null without one. labels adds those of the rules' detections that are left. score is the
    best confidence of a detection (1 for a base phrase's own text is not needed: 0.7 at least), 0 without any. A null text
    counts as empty; repeated rows each get their result; texts may have any length; an empty table gives an empty result.
    Only the two named columns are read, so others may have any name.
    """
    t = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(t).alias("_th"), t.alias("_t"), F.lower(t).alias("_low"))
    key = ["_k", "_th"]
    id_ = F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))).alias("_k")
    b = _base(F.col("_t"))
    none = F.array().cast("array<string>")
    near = F.contains("_low", F.lit("license"))
    base = rows.select("_id", "_th", id_, F.regexp_count("_t", F.lit(f"{W}+")).cast("long").alias("n_words"), F.when(near, F.struct(*(c.alias(n) for n, c in b.items()))).alias("b"))
    # Texts stay where they are read: only places and lengths of matches are shuffled.
    each = rows.where(_may_hold(F.col("_low"))).select(F.monotonically_increasing_id().alias("_row"), id_, "_th", _evened(F.col("_low")).alias("_e"))
    each = each.select("_row", *key, "_e", _hits("_e").alias("_h"))
    found = suppressed(_detections(each, ["_row", *key], "_e", "_h"), ["_row", *key])
    per = found.groupBy(*key).agg(F.collect_set("label").alias("_l"), F.max("confidence").alias("_c"))
    out = base.join(per, key, "left")
    hit = F.coalesce(F.col("b.n"), F.lit(0)) > 0
    base_labels = F.when(hit, F.col("b.labels")).otherwise(none)
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("_l", none))))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce(F.col("b.n"), F.lit(0)).cast("long").alias("n_base"),
        F.when(hit, F.col("b.first")).alias("first_word"),
        F.when(hit, F.col("b.last")).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("_c", F.lit(0.0)), F.when(hit, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
        F.col("_th").alias("row_hash"),
    )
